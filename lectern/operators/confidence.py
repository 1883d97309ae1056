"""Confidence of an answer from the similarities of its sources; checks of relevance; search by author."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.ingest import tokens

HIGH, HIGH_MEAN, MEDIUM, LOW = 0.75, 0.65, 0.60, 0.50


def level(top: Column, mean3: Column, least: float = LOW) -> Column:
    """Level by the greatest similarity and the mean of the best three; null (no hits) is insufficient."""
    return F.when(top.isNull() | (top < least), "insufficient").when((top > HIGH) & (mean3 > HIGH_MEAN), "high").when(top > MEDIUM, "medium").otherwise("low")


def confidence(hits: DataFrame, queries: DataFrame | None = None, least: float = LOW) -> DataFrame:
    """(query_id, level, score, avg_similarity, should_respond); queries adds those without hits. Null similarities don't count."""
    good = hits.where("similarity is not null")
    best = good.withColumn("_n", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity")))).where("_n <= 3")
    agg = best.groupBy("query_id").agg(F.max("similarity").alias("score"), F.avg("similarity").alias("avg_similarity"))
    if queries is not None:
        agg = queries.select("query_id").distinct().join(agg, "query_id", "left")
    lv = level(F.col("score"), F.col("avg_similarity"), least)
    return agg.select("query_id", lv.alias("level"), F.coalesce("score", F.lit(0.0)).alias("score"), F.round(F.coalesce("avg_similarity", F.lit(0.0)), 9).alias("avg_similarity"), (lv != "insufficient").alias("should_respond"))


def relevant(query: Column, content: Column, share: float = 0.2) -> Column:
    """Default verdict, a stand-in for a model: enough of the query's words stand in the first 2,000 characters; under 50 characters never."""
    q = F.array_distinct(tokens(query))
    hit = F.size(F.array_intersect(q, tokens(F.substring(content, 1, 2000)))) / F.nullif(F.size(q), F.lit(0))
    return F.when(F.coalesce(F.length(content), F.lit(0)) < 50, False).otherwise(F.coalesce(hit >= share, F.lit(True)))


def verified(hits: DataFrame, verdict: Column, first: int = 5) -> DataFrame:
    """hits with `verified`: the first few of each query are judged, the rest follow unjudged; none is left if all judged ones fail."""
    judged = hits.withColumn("_ok", F.when(F.col("rank") <= first, verdict))
    any_ok = F.coalesce(F.max(F.when(F.col("rank") <= first, F.col("_ok").cast("int"))).over(W.partitionBy("query_id")), F.lit(0)) == 1
    kept = judged.withColumn("_any", any_ok).where(F.col("_any") & ((F.col("rank") > first) | F.col("_ok")))
    return kept.withColumn("verified", F.col("rank") <= first).drop("_ok", "_any")


def verified_confidence(hits: DataFrame, verdict: Column, queries: DataFrame, least: float = LOW) -> DataFrame:
    """confidence() of what verified() leaves; a query whose judged hits all fail is low with score 0 and goes on to a deeper search."""
    left = verified(hits, verdict)
    sure = confidence(left, queries, least)
    failed = hits.select("query_id").distinct().join(left.select("query_id").distinct(), "query_id", "left_anti").withColumn("_failed", F.lit(True))
    r = sure.join(failed, "query_id", "left").withColumn("_failed", F.coalesce("_failed", F.lit(False)))
    pick = lambda bad, c: F.when(F.col("_failed"), F.lit(bad)).otherwise(F.col(c)).alias(c)
    return r.select("query_id", pick("low", "level"), pick(0.0, "score"), pick(0.0, "avg_similarity"), pick(True, "should_respond"))


def first_relevant_author(hits: DataFrame, authors: DataFrame, verdict: Column, per_author: int = 3, floor: float = 0.9) -> DataFrame:
    """All hits of the first author, by position, of whose best hits one is relevant; their similarity is at least `floor`.

    hits: (query_id, chunk_id, author, similarity, rank, ...), authors: (author, position).
    """
    top = hits.join(authors, "author").withColumn("_n", F.row_number().over(W.partitionBy("query_id", "author").orderBy(F.desc_nulls_last("similarity"), "rank", "chunk_id"))).where(F.col("_n") <= per_author)
    judged = top.withColumn("_ok", verdict)
    won = judged.where("_ok").groupBy("query_id").agg(F.min("position").alias("position"))
    return judged.join(won, ["query_id", "position"]).withColumn("similarity", F.greatest(F.coalesce("similarity", F.lit(0.0)), F.lit(floor))).drop("_n", "_ok")
