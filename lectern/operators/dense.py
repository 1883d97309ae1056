"""Exact nearest neighbours of a stated set of query vectors, in blocks against all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.present import similarity
from lectern.operators.best import QUERIES_AT_ONCE, Best, rows_at_once
from lectern.session import written


def nearest(rows: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", group: str | None = None, same: bool = False, load: Callable | None = None) -> DataFrame:
    """(query_id, key, distance, similarity, rank [, group]): the k rows of least squared distance to each query.

    With group, the k best within each value of that column (a row's null group is one of its own); with same, only
    rows whose group equals the query's are scored. The rows are read once, the stated queries are broadcast in blocks of
    QUERIES_AT_ONCE, each different vector once, however many queries have it. Each task keeps k candidates a vector, so that
    what is shuffled is bounded by tasks times vectors times k (times groups). Null vectors are left out; ties go to the
    smaller key. With load, the loader of an embedder, the rows have a text in the column `vector`, which the tasks embed
    where they score it; a null text has the embedder's vector.
    """
    q = queries.where(F.col(vector).isNotNull()).select(F.col(query_key).cast("bigint").alias("q"), F.col(vector).cast("array<double>").alias("v"), (F.col(group).cast("string") if same else F.lit(None).cast("string")).alias("g"))
    asked = written(q.groupBy("v", "g").agg(F.collect_list(F.struct("q")).alias("asked")).withColumn("q", F.monotonically_increasing_id()), "vectors")
    out = _candidates(rows, _blocks(asked.select("q", "v", "g")), k, key, vector, group, same, load).withColumnRenamed("query_id", "q")
    by = ["group_value"] if group and not same else []
    best = lambda found, of: found.withColumn("rank", F.row_number().over(W.partitionBy(of, *by).orderBy(F.round("distance", 9), "key"))).where(F.col("rank") <= k)
    ids = asked.select("q", F.explode("asked").alias("asked")).select("q", F.col("asked.q").alias("query_id"))
    ranked = best(best(out, "q").drop("rank").join(ids, "q"), "query_id")  # a query has one vector, or the best of several
    extra = [F.col("group_value").alias(group)] if group and not same else []
    return ranked.select("query_id", F.col("key").alias(key), F.round("distance", 6).alias("distance"), F.round(similarity(F.col("distance")), 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"), *extra)


def _blocks(q: DataFrame) -> list[Broadcast]:
    """Blocks of (ids, vectors, groups); the driver holds one at a time."""
    sc, out, block = q.sparkSession.sparkContext, [], []

    def send() -> None:
        out.append(sc.broadcast((np.array([r.q for r in block]), np.array([r.v for r in block], dtype=np.float64), np.array([r.g for r in block], dtype=object))))
        block.clear()

    for r in q.toLocalIterator():
        block.append(r)
        if len(block) == QUERIES_AT_ONCE:
            send()
    if block:
        send()
    return out


def _candidates(rows: DataFrame, blocks: list[Broadcast], k: int, key: str, vector: str, group: str | None, same: bool, load: Callable | None = None) -> DataFrame:
    g = F.col(group).cast("string") if group else F.lit(None).cast("string")
    some, v = (rows, F.col(vector)) if load else (rows.where(F.col(vector).isNotNull()), F.col(vector).cast("array<double>"))
    src = some.select(F.col(key).cast("bigint").alias("key"), g.alias("g"), v.alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, str | None], Best] = {}
        left: dict[tuple[int, str | None], tuple[np.ndarray, np.ndarray]] = {}
        model = load() if load else None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            x = np.stack(list(model(pd.Series(b.column(2).to_pylist(), dtype=object)))) if model else b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            right = np.column_stack((x, np.ones(n), (x * x).sum(axis=1)))
            keys = b.column(0).to_numpy(zero_copy_only=False)
            parts = [(None, np.arange(n))]
            if group:
                groups = np.array(b.column(1).to_pylist(), dtype=object)
                parts = [(v, np.flatnonzero(groups == v)) for v in set(groups)]
            for nth, block in enumerate(blocks):
                ids, m, wanted = block.value
                for v, at in parts:
                    own = (nth, v if same else None)
                    if own not in left:  # the squared distance is the product of (-2 m, m m, 1) and (x, 1, x x)
                        which = np.flatnonzero(wanted == v) if same else np.arange(len(ids))
                        mine = m[which]
                        left[own] = which, np.column_stack((-2 * mine, (mine * mine).sum(axis=1), np.ones(len(which)))) if len(which) else mine
                    which, mine = left[own]
                    if same and v is None or not len(which):
                        continue
                    if (nth, v) not in best:
                        best[nth, v] = Best(k, len(ids))
                    step = rows_at_once(len(which))
                    for low in range(0, len(at), step):
                        some = at[low : low + step]
                        best[nth, v].add(which, keys[some], mine @ right[some].T)
        for (nth, v), c in best.items():
            q, key_, d = c.settle()
            yield pa.RecordBatch.from_arrays([pa.array(blocks[nth].value[0][q], pa.int64()), pa.array(key_, pa.int64()), pa.array(np.maximum(d, 0), pa.float64()), pa.array([v] * len(q), pa.string())], names=["query_id", "key", "distance", "group_value"])

    return src.mapInArrow(run, "query_id bigint, key bigint, distance double, group_value string")
