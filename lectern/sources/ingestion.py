"""From files to a collection: what is new is extracted, chunked, appended and indexed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.config import Config
from lectern.functions import ingest
from lectern.operators import chunking
from lectern.sources import sinks
from lectern.sources.collections import extract_pages, find_files, open_collection, stored


def described(pages: DataFrame, known: Sequence[str] = ()) -> DataFrame:
    """Raw pages (source_path, page_number, text) with what follows from path and text: the columns of a page."""
    p = pages.withColumn("source_file", F.element_at(F.split("source_path", "/"), -1)).withColumn("source_type", ingest.source_type(F.col("source_path")))
    p = p.withColumn("page_id", F.xxhash64("source_path", "page_number"))
    first = p.groupBy("source_path").agg(F.min_by(F.struct("source_file", "text"), "page_number").alias("f"))
    authors = first.select("source_path", ingest.author(F.col("f.source_file"), F.col("f.text"), known).alias("author"))
    chapters = chunking.chapter_carry(p)
    p = p.join(authors, "source_path").join(chapters, "page_id")
    return p.withColumn("text", ingest.clean(F.col("text"))).withColumn("language", ingest.language_heuristic(F.col("text"))).withColumn("has_latex", ingest.has_latex(F.col("text")))


def ingest_pages(pages: DataFrame, path: str, config: Config = Config(), dry_run: bool = False) -> dict[str, int]:
    """Chunks and parents of pages into the collection at path; see add_chunks()."""
    return sinks.add_chunks(chunking.library(pages, config), path, dry_run=dry_run)


def ingest_files(spark: SparkSession, folder: str, path: str, parse: Callable[[str, bytes], list[dict]], pattern: str = "*.pdf", known: Sequence[str] = (), config: Config = Config(), dry_run: bool = False) -> tuple[dict[str, int], DataFrame]:
    """Files below a folder of which no chunk is stored, into the collection at path, made if it is missing: (counts, files that failed).

    parse(path, content) gives a file's pages as rows (page_number, text).
    """
    open_collection(spark, path, create=True)
    files = find_files(spark, folder, pattern, content=True).withColumn("source_path", F.regexp_replace("path", "^[a-z]+:/*", "/"))
    fresh = sinks.new_files(files, stored(spark, path, "chunks"))
    pages, errors = extract_pages(fresh, parse, "page_number int, text string", keep=("source_path",))
    return ingest_pages(described(pages, known), path, config, dry_run), errors
