"""Writing collections, indexes and state."""

from __future__ import annotations

import logging
import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators import bm25
from lectern.schema import CHUNK
from lectern.sources.collections import stored

log = logging.getLogger("lectern")
#: Parts of a collection: each source is in one, so that deleting a file rewrites one part.
PARTS = 64


def part_of(source_file: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(source_file, F.lit(""))), F.lit(PARTS)).cast("int")


def _typed(df: DataFrame) -> DataFrame:
    """df in the chunk schema: missing columns are null, others are left out."""
    want = T._parse_datatype_string(CHUNK)
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])


def new_chunks(chunks: DataFrame, existing: DataFrame) -> DataFrame:
    """Chunks whose id isn't stored yet, one of each id: the first by index and text. Chunks without an id can't be told apart and are left out."""
    order = [F.col(c) for c in ("chunk_index", "text") if c in chunks.columns]
    one = chunks.where("chunk_id is not null").withColumn("_n", F.row_number().over(W.partitionBy("chunk_id").orderBy(*order or ["chunk_id"]))).where("_n = 1").drop("_n")
    return one.join(existing.select("chunk_id"), "chunk_id", "left_anti")


def new_files(files: DataFrame, existing: DataFrame, key: str = "source_path") -> DataFrame:
    return files.join(existing.select(key).distinct(), key, "left_anti")


def add_chunks(chunks: DataFrame, path: str, index: bool = True, dry_run: bool = False) -> dict[str, int]:
    """Append the chunks that aren't stored yet, and their postings to the sparse index, of which only the terms are counted anew.

    Returns {added, skipped, errors}: errors counts chunks without an id. A failed write is an exception, never a silent
    loss. With dry_run nothing is written.
    """
    spark = chunks.sparkSession
    began = time.time()
    given = Observation("given")
    chunks = chunks.observe(given, F.count("*").alias("n"), F.count_if(F.col("chunk_id").isNull()).alias("bad"))
    fresh = _typed(new_chunks(chunks, stored(spark, path, "chunks")))
    if dry_run:
        n = fresh.count()
        return {"added": 0, "skipped": given.get["n"] - given.get["bad"] - n, "errors": given.get["bad"]}
    # Written aside first, so that chunks and index get the same rows whatever happens in between.
    aside, done = f"{path}/_batch-{uuid.uuid4().hex}", Observation("added")
    fresh.observe(done, F.count("*").alias("n")).withColumn("source_part", part_of(F.col("source_file"))).write.option("compression", "zstd").parquet(aside)
    batch = spark.read.parquet(aside)
    if index:
        _write_index(batch, path, "append")
    batch.write.mode("append").option("compression", "zstd").partitionBy("source_part").parquet(f"{path}/chunks")
    _delete(spark, aside)
    if index:
        save_terms(spark, path)
    log_throughput("add_chunks", done.get["n"], time.time() - began)
    return {"added": done.get["n"], "skipped": given.get["n"] - given.get["bad"] - done.get["n"], "errors": given.get["bad"]}


def _write_index(chunks: DataFrame, path: str, mode: str) -> None:
    """Postings and lengths of chunks with their source_part; mode overwrite replaces the parts that the chunks are in."""
    for name, df in (("postings", bm25.postings(chunks, "chunk_id", keep=("source_part",))), ("lengths", bm25.lengths(chunks, "chunk_id", keep=("source_part",)))):
        df.write.mode(mode).option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy("source_part").parquet(f"{path}/{name}")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def save_terms(spark: SparkSession, path: str) -> None:
    """The terms of the stored postings."""
    bm25.index_stats(stored(spark, path, "postings"), stored(spark, path, "lengths")).write.mode("overwrite").parquet(f"{path}/terms")


def save_sparse_index(spark: SparkSession, path: str) -> None:
    """The index of all stored chunks anew."""
    for name in ("postings", "lengths"):
        _delete(spark, f"{path}/{name}")
    _write_index(stored(spark, path, "chunks", parts=True), path, "append")
    save_terms(spark, path)


def reset(spark: SparkSession, path: str, description: str = "", model: str = "") -> DataFrame:
    """An empty collection in place of the one at path, if any."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in ("chunks", "postings", "lengths", "terms"):
        _delete(spark, f"{path}/{name}")
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        p.getFileSystem(conf).mkdirs(p)
    meta = spark.range(1).select(F.lit(description).alias("description"), F.lit(model).alias("embedding_model"), F.current_timestamp().alias("created_at"))
    meta.write.mode("overwrite").parquet(f"{path}/meta")
    return stored(spark, path, "chunks")


def without_file(chunks: DataFrame, source_file: str) -> DataFrame:
    """Chunks that stay when a file is deleted; rows without a file stay."""
    return chunks.where(~F.col("source_file").eqNullSafe(F.lit(source_file)))


def delete_file(spark: SparkSession, path: str, source_file: str) -> int:
    """Delete a file's chunks and postings; only the part of the collection that the file is in is rewritten. Returns how many are gone.

    What stays is written beside the collection first, then takes the part's place.
    """
    part = spark.range(1).select(part_of(F.lit(source_file))).first()[0]
    chunks = stored(spark, path, "chunks", parts=True).where(F.col("source_part") == part)
    gone = chunks.where(F.col("source_file") == source_file).count()
    if gone:
        aside = f"{path}/_kept-{uuid.uuid4().hex}"
        without_file(chunks, source_file).write.parquet(aside)
        kept = spark.read.parquet(aside)
        for name in ("chunks", "postings", "lengths"):
            _delete(spark, f"{path}/{name}/source_part={part}")
        kept.write.mode("append").partitionBy("source_part").parquet(f"{path}/chunks")
        _write_index(kept, path, "append")
        _delete(spark, aside)
        save_terms(spark, path)
    return gone


def exported(chunks: DataFrame) -> DataFrame:
    """Chunks as flat text fields: missing text is '', a missing chapter -1, arrays are joined by commas, other nested values are JSON."""
    out = []
    for f in chunks.schema:
        c = F.col(f.name)
        if f.name == "chapter":
            c = F.coalesce(F.nullif(c, F.lit(0)), F.lit(-1))
        elif isinstance(f.dataType, T.StringType):
            c = F.coalesce(c, F.lit(""))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            c = F.coalesce(F.concat_ws(",", c), F.lit(""))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = F.coalesce(F.to_json(c), F.lit(""))
        out.append(c.alias(f.name))
    return chunks.select(*out)


def quota_json(count: Column, start_time: Column) -> Column:
    return F.to_json(F.struct(count.alias("count"), start_time.alias("start_time")))


def log_throughput(what: str, n: int, seconds: float) -> float:
    rate = n / seconds if seconds > 0 else 0.0
    log.info("%s: %d items in %.2f s (%.1f a second)", what, n, seconds, rate)
    return rate
