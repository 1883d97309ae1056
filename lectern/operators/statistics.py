"""Counts and distinct values of a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.ingest import SOURCE_TYPES


def collection_stats(chunks: DataFrame) -> DataFrame:
    """(dimension, value, n, n_files): counts by source type, author and language, and in all, in one scan."""
    known = lambda c: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit("unknown")).alias(c)
    rows = chunks.select(known("source_type"), known("author"), known("language"), "source_file")
    # Files are counted in two steps, so that no task holds the files of a hot value.
    sets = rows.groupingSets([("source_type", "source_file"), ("author", "source_file"), ("language", "source_file"), ("source_file",)], "source_type", "author", "language", "source_file").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    named = sets.select(
        F.when(F.col("g").bitwiseAND(8) == 0, "source_type").when(F.col("g").bitwiseAND(4) == 0, "author").when(F.col("g").bitwiseAND(2) == 0, "language").otherwise("all").alias("dimension"),
        F.coalesce("source_type", "author", "language", F.lit("")).alias("value"), "source_file", "n",
    )
    return named.groupBy("dimension", "value").agg(F.sum("n").alias("n"), F.count("source_file").alias("n_files"))


def distinct_values(chunks: DataFrame, field: str) -> DataFrame:
    """Sorted distinct values of a field as strings, without missing and empty ones."""
    v = F.col(field).cast("string")
    return chunks.select(v.alias("value")).where("value is not null and value <> ''").distinct().orderBy("value")


def count_by_type(files: DataFrame) -> DataFrame:
    """(source_type, n_files): every known type, also those without files."""
    types = files.sparkSession.createDataFrame([(t,) for t in SOURCE_TYPES.values()], "source_type string")
    counts = files.select("source_type", "source_path").distinct().groupBy("source_type").agg(F.count("*").alias("n"))
    return types.join(counts, "source_type", "left").select("source_type", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_files"))


def top_authors(chunks: DataFrame, k: int = 10) -> DataFrame:
    named = chunks.where("author is not null and trim(author) <> '' and lower(author) <> 'unknown'")
    return named.groupBy("author").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "author").limit(k)


def priority_authors(chunks: DataFrame, first: list[str]) -> DataFrame:
    """(author, position): authors that contain a listed name come first, each part in order of name."""
    low = F.lower("author")
    listed = F.lit(False)
    for name in first:
        listed = listed | F.contains(low, F.lit(name.lower()))
    named = chunks.where("author is not null and trim(author) <> '' and lower(author) <> 'unknown'").select("author").distinct()
    # One row an author: a window over authors, not over chunks.
    from pyspark.sql import Window as W

    return named.select("author", F.row_number().over(W.orderBy(F.when(listed, 0).otherwise(1), "author")).cast("bigint").alias("position"))


def chunking_stats(chunks: DataFrame) -> DataFrame:
    """(source_type, n_documents, n_pages, n_chunks, mean_chars) of children, by type."""
    per_page = chunks.where("not coalesce(is_parent, false)").groupBy("source_type", "source_file", "page").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.count("text").alias("texts"))
    per_doc = per_page.groupBy("source_type", "source_file").agg(F.count("page").alias("pages"), F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.sum("texts").alias("texts"))
    return per_doc.groupBy("source_type").agg(F.count("source_file").alias("n_documents"), F.sum("pages").alias("n_pages"), F.sum("n").alias("n_chunks"), F.round(F.sum("chars") / F.sum("texts"), 6).alias("mean_chars"))
