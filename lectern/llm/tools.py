"""Small helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import clear, shared_dir, written

__all__ = ["clear", "shared_dir", "small", "table", "written"]

#: Bytes, as JSON text, up to which a written table is marked for broadcast; beyond it Spark joins by shuffle.
BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its measured size allows; else Spark joins it by shuffle."""
    size = df.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df
