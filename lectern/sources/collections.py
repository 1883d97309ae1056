"""Reading files, collections and state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.ingest import source_type
from lectern.schema import CHUNK, LENGTHS, POSTINGS, QUOTA_STATE, TERMS


class MissingCollection(LookupError):
    """The collection must exist and doesn't."""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def find_files(spark: SparkSession, folder: str, pattern: str = "*.pdf", content: bool = False) -> DataFrame:
    """(path, source_file, source_type, length, modified [, content]) of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    cols = [F.col("path"), F.element_at(F.split("path", "/"), -1).alias("source_file"), source_type(F.col("path")).alias("source_type"), "length", F.col("modificationTime").alias("modified")]
    return files.select(*cols, *(["content"] if content else []))


def extract_pages(files: DataFrame, parse: Callable[[str, bytes], list[dict]], schema: str, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(pages, errors): parse(path, content) gives a file's pages as rows of schema, beside the columns in keep; a file it fails on becomes (path, error)."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content, *kept in zip(f["path"], f["content"], *(f[c] for c in keep)):
                own = {"_path": path, **dict(zip(keep, kept))}
                try:
                    rows += [{**r, **own, "_error": None} for r in parse(path, content)]
                except Exception as e:  # one bad file doesn't end the job
                    rows.append({**own, "_error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=[*names, *keep, "_path", "_error"], dtype=object)

    kinds = "".join(f", {c} {files.schema[c].dataType.simpleString()}" for c in keep)
    both = files.select("path", "content", *keep).mapInPandas(run, f"{schema}{kinds}, _path string, _error string")
    return both.where("_error is null").drop("_path", "_error"), both.where("_error is not null").select(F.col("_path").alias("path"), F.col("_error").alias("error"))


def open_collection(spark: SparkSession, path: str, create: bool = False, description: str = "", model: str = "") -> DataFrame:
    """The chunk table at a path. With create, one is made if it is missing; else a missing one is an error."""
    try:
        return stored(spark, path, "chunks")
    except AnalysisException:
        if not create:
            raise MissingCollection(path) from None
    from lectern.sources.sinks import reset

    return reset(spark, path, description, model)


def properties(spark: SparkSession, path: str) -> DataFrame:
    """(description, embedding_model, created_at) of a collection."""
    return spark.read.parquet(f"{path}/meta")


def lookup(chunks: DataFrame, predicate: Column, *fields: str) -> DataFrame:
    """Rows that fulfil a predicate, with the fields asked for; both reach the scan."""
    return chunks.where(predicate).select(*fields) if fields else chunks.where(predicate)


def stored(spark: SparkSession, path: str, name: str, parts: bool = False) -> DataFrame:
    """One of a collection's tables; parts adds source_part, the part that a row's source is in."""
    df = spark.read.schema({"chunks": CHUNK, "postings": POSTINGS, "lengths": LENGTHS}[name] + ", source_part int").parquet(f"{path}/{name}")
    return df if parts else df.drop("source_part")


def sparse_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, lengths, terms) of a collection; empty tables if the index was never written."""
    out = []
    for name, schema in (("postings", POSTINGS), ("lengths", LENGTHS), ("terms", TERMS)):
        try:
            out.append(spark.read.schema(schema).parquet(f"{path}/terms") if name == "terms" else stored(spark, path, name))
        except AnalysisException:
            out.append(spark.createDataFrame([], schema))
    return tuple(out)


def quota_state(text: Column) -> Column:
    """State of a session from its JSON text; null if it isn't valid."""
    return F.from_json(text, QUOTA_STATE)


__all__ = ["CHUNK", "MissingCollection", "extract_pages", "find_files", "lookup", "open_collection", "properties", "quota_state", "sparse_index", "table"]
