"""Streams: new pages into a collection, and quotas over live events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.config import Config
from lectern.operators.chunking import library
from lectern.sources.sinks import add_chunks


def ingest_pages(spark: SparkSession, folder: str, collection: str, checkpoint: str, schema, config: Config = Config(), once: bool = True) -> StreamingQuery:
    """Chunk every page file that appears in a folder and add what the collection lacks, index included; files are taken once."""
    pages = spark.readStream.schema(schema).parquet(folder)

    def add(batch: DataFrame, _: int) -> None:
        add_chunks(library(batch, config), collection)

    writer = pages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def live_quota(events: DataFrame, limit: int = 5, seconds: float = 900.0) -> DataFrame:
    """(user_id, event_id, allowed) of a stream (user_id, event_id, ts): the window begins with a user's first event and is kept as state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        allowed = []
        for t in rows["ts"].map(lambda x: x.timestamp()):
            if start is None or t - start > seconds:
                start, n = float(t), 0
            allowed.append(n < limit)
            n += allowed[-1]
        state.update((start, n))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "allowed": allowed})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, event_id bigint, allowed boolean", "start double, n int", "append", GroupStateTimeout.NoTimeout)
