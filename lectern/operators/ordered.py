"""Running values over long ordered groups, in two levels.

A window over a whole group puts the group into one task, and one group may hold a third of all rows. Here each group is
cut into buckets of the ordering number; a value per bucket is carried over the few buckets, then the rows of a bucket are
windowed by themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Values of the ordering number that make a bucket.
BUCKET = 4_096


def _bucketed(rows: DataFrame, number: str, width: float) -> DataFrame:
    return rows.withColumn("_bucket", F.coalesce(F.floor(F.col(number) / width), F.lit(-(1 << 40))))


def last_known(rows: DataFrame, group: str, number: str, tie: str, value: str, width: float = BUCKET) -> DataFrame:
    """rows with `value` replaced by the last one that isn't null up to each row, in order of number and tie; null numbers come first."""
    b = _bucketed(rows, number, width)
    # Every bucket, also one without a value, takes over from the ones before.
    every = b.groupBy(group, "_bucket").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(number, tie))).alias("_last"))
    before = W.partitionBy(group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carry = every.select(F.col(group).alias("_g"), F.col("_bucket").alias("_b"), F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    inside = W.partitionBy(group, "_bucket").orderBy(number, tie).rowsBetween(W.unboundedPreceding, 0)
    joined = b.join(carry, b[group].eqNullSafe(F.col("_g")) & (F.col("_bucket") == F.col("_b")), "left")
    return joined.withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(inside), "_carry")).drop("_bucket", "_g", "_b", "_carry")


def previous(rows: DataFrame, group: str, number: str, tie: str, name: str, width: float = BUCKET) -> DataFrame:
    """rows with `name`: the ordering number of the row before in the group, null for the first."""
    b = _bucketed(rows, number, width)
    most = b.groupBy(group, "_bucket").agg(F.max(number).alias("_most"))
    before = W.partitionBy(group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carry = most.select(F.col(group).alias("_g"), F.col("_bucket").alias("_b"), F.max("_most").over(before).alias("_carry"))
    joined = b.join(carry, b[group].eqNullSafe(F.col("_g")) & (F.col("_bucket") == F.col("_b")), "left")
    inside = W.partitionBy(group, "_bucket").orderBy(number, tie)
    return joined.withColumn(name, F.coalesce(F.lag(number).over(inside), "_carry")).drop("_bucket", "_g", "_b", "_carry")


def total_before(rows: DataFrame, group: str, number: str, tie: str, value: str, name: str, width: float = BUCKET) -> DataFrame:
    """rows with `name`: the sum of value over the rows of the group before each row, in order of number and tie."""
    b = _bucketed(rows, number, width)
    sums = b.groupBy(group, "_bucket").agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(F.col(group).alias("_g"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy(group, "_bucket").orderBy(number, tie).rowsBetween(W.unboundedPreceding, -1)
    joined = b.join(offsets, b[group].eqNullSafe(F.col("_g")) & (F.col("_bucket") == F.col("_b")), "left")
    return joined.withColumn(name, F.col("_offset") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_bucket", "_g", "_b", "_offset")


def spaced(rows: DataFrame, group: str, time: Column, tie: str, interval: float, name: str, width: float = 3600.0) -> DataFrame:
    """rows with `name`: the earliest time at or after each row's own that is `interval` after the one before it in its group.

    In closed form it is i*d + max over j<=i of (t_j - j*d); the count and the maximum of a bucket of time carry over.
    """
    b = _bucketed(rows.withColumn("_t", time), "_t", width)
    inside = W.partitionBy(group, "_bucket").orderBy("_t", tie)
    b = b.withColumn("_i", F.row_number().over(inside)).withColumn("_slack", F.col("_t") - F.col("_i") * interval)
    per = b.groupBy(group, "_bucket").agg(F.count("*").alias("_n"), F.max("_slack").alias("_most"))
    before = W.partitionBy(group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    per = per.withColumn("_before", F.max(F.col("_most") - F.col("_offset") * interval).over(before))
    per = per.select(F.col(group).alias("_g"), F.col("_bucket").alias("_b"), "_offset", "_before")
    joined = b.join(per, b[group].eqNullSafe(F.col("_g")) & (F.col("_bucket") == F.col("_b")), "left")
    most = F.greatest(F.max("_slack").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("_offset") * interval, F.col("_before"))
    return joined.withColumn(name, most + (F.col("_i") + F.col("_offset")) * interval).drop("_bucket", "_g", "_b", "_t", "_i", "_slack", "_offset", "_before")
