"""State kept per key over ordered events: rate limit, quota, cache, conversation window, intervals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.operators import ordered


def emit_times(events: DataFrame, key: str = "user_id", ts: str = "ts", order: str = "event_id", interval: float = 1.0) -> DataFrame:
    """(key, order, emit_at): when each call of a key may go, at least `interval` seconds after the one before."""
    t = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    return ordered.spaced(events.select(key, order, t.alias("t")), key, F.col("t"), order, interval, "emit_at").select(key, order, F.round("emit_at", 3).alias("emit_at"))


def cache_hits(events: DataFrame, key: list[str], ts: str = "ts", order: str = "event_id", ttl: float = 3600.0) -> DataFrame:
    """(order, hit): a lookup of a key hits if its entry was put at most ttl seconds before; a miss puts it anew.

    The age counts from the put, so an entry's misses follow from its own lookups alone.
    """
    return _folded(events, key, ts, order, lambda: _Ttl(ttl), "hit boolean", ttl)


def quota(events: DataFrame, key: list[str], ts: str = "ts", order: str = "event_id", limit: int = 5, seconds: float = 900.0) -> DataFrame:
    """(order, allowed): a window begins with a key's first event and again with the first later than `seconds` after; within it `limit` are allowed."""
    return _folded(events, key, ts, order, lambda: _Quota(limit, seconds), "allowed boolean", seconds)


class _Ttl:
    def __init__(self, ttl: float):
        self.ttl, self.put = ttl, None

    def step(self, t: float) -> bool:
        if self.put is not None and t - self.put <= self.ttl:
            return True
        self.put = t
        return False


class _Quota:
    def __init__(self, limit: int, seconds: float):
        self.limit, self.seconds, self.start, self.n = limit, seconds, None, 0

    def step(self, t: float) -> bool:
        if self.start is None or t - self.start > self.seconds:
            self.start, self.n = t, 0
        if self.n >= self.limit:
            return False
        self.n += 1
        return True


def _folded(events: DataFrame, key: list[str], ts: str, order: str, new, result: str, apart: float) -> DataFrame:
    """Folds each key's events in order.

    An event more than `apart` seconds after the one before it begins anew whatever came before, so a key's events are cut
    there and the stretches of one key go to different tasks. Rows stream through sorted partitions: the state is a few
    numbers, whatever the number of events.
    """
    src = events.select(F.concat_ws("\u0001", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]).alias("k"), F.col(order).cast("bigint").alias("o"), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("t")).where("t is not null")
    width = max(apart, 3600.0)
    src = ordered.previous(src, "k", "t", "o", "_prev", width)
    src = src.withColumn("stretch", F.when(F.col("_prev").isNull() | (F.col("t") - F.col("_prev") > apart), F.col("t")))
    src = ordered.last_known(src, "k", "t", "o", "stretch", width).select("k", "stretch", "t", "o")
    src = src.repartition("k", "stretch").sortWithinPartitions("k", "stretch", "t", "o")
    name = result.split(" ")[0]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for f in frames:
            out = []
            for k, stretch, t in zip(f["k"], f["stretch"], f["t"]):
                if state is None or (k, stretch) != last:
                    last, state = (k, stretch), new()
                out.append(state.step(t))
            yield pd.DataFrame({order: f["o"], name: out})

    return src.mapInPandas(run, f"{order} bigint, {result}")


def last_messages(chat: DataFrame, n: int = 10, cut: int | None = None) -> DataFrame:
    """(conv_id, history): the last n messages with content, in order, roles in upper case; cut shortens each, with an ellipsis."""
    rows = chat.where("content is not null").withColumn("_n", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("_n") <= n)
    text = F.col("content") if cut is None else F.when(F.length("content") > cut, F.concat(F.substring("content", 1, cut), F.lit("..."))).otherwise(F.col("content"))
    item = F.struct("turn", F.concat(F.upper(F.trim("role")), F.lit(": "), text).alias("s"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["s"]), "\n").alias("history"))


def merged_intervals(rows: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """(*key, start, end, n): intervals that overlap or touch, joined; nulls and empty intervals are left out."""
    w = W.partitionBy(*key).orderBy(start, end)
    seen = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    iv = rows.where(F.col(start).isNotNull() & (F.col(end) > F.col(start))).withColumn("_new", F.when(F.col(start) <= seen, 0).otherwise(1))
    iv = iv.withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return iv.groupBy(*key, "_island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n")).drop("_island")
