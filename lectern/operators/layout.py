"""Recurring text in the margins of documents, and the text of pages without it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.ingest import block_text
from lectern.operators import ordered


def sampled_pages(blocks: DataFrame, most: int = 10) -> DataFrame:
    """(source_path, page, n_sampled): at most `most` evenly spaced pages from the middle half of each document."""
    pages = blocks.select("source_path", "page").distinct()
    # Positions are counted in buckets of pages, so no task holds the pages of a long document.
    idx = ordered.total_before(pages.withColumn("one", F.lit(1)), "source_path", "page", "page", "one", "i")
    sizes = pages.groupBy("source_path").agg(F.count("*").alias("n"))
    idx = idx.join(sizes.withColumnRenamed("source_path", "_doc"), F.col("source_path").eqNullSafe(F.col("_doc"))).drop("_doc")
    start, stop = F.floor(F.col("n") / 4), F.least(F.col("n"), F.floor(F.col("n") / 4) + F.floor(F.col("n") / 2))
    step = F.greatest(F.lit(1), F.floor((stop - start) / 10))
    middle = (F.col("i") >= start) & (F.col("i") < stop) & ((F.col("i") - start) % step == 0) & ((F.col("i") - start) / step < most)
    chosen = idx.where(F.when(stop > start, middle).otherwise(F.col("i") < most)).select("source_path", "page")
    return chosen.withColumn("n_sampled", F.count("*").over(W.partitionBy("source_path")))  # `most` rows a document


def margins(blocks: DataFrame, share: float = 0.4, zone: float = 0.15) -> DataFrame:
    """(source_path, header_height, footer_height, recurring): what recurs in the top and bottom zones of a document's sampled pages.

    Positions (rounded) and texts on at least `share` of the sampled pages count; without any, the heights are 50.
    """
    b = blocks.where("lines is not null").select("source_path", "page", "page_height", F.col("bbox")[1].alias("y0"), F.col("bbox")[3].alias("y1"), F.regexp_replace(block_text(F.col("lines")), r"(?U)^\s+|\s+$", "").alias("text"))
    b = b.join(sampled_pages(blocks), ["source_path", "page"])
    top, foot = F.col("y1") < zone * F.col("page_height"), F.col("y0") > (1 - zone) * F.col("page_height")
    m = b.where(top | foot).select("source_path", "n_sampled", F.when(top, "top").otherwise("foot").alias("zone"), F.round(F.when(top, F.col("y1")).otherwise(F.col("y0"))).alias("y"), "text", "page_height")
    ys = m.groupBy("source_path", "n_sampled", "zone", "y").agg(F.count("*").alias("c"), F.max("page_height").alias("h")).where(F.col("c") >= share * F.col("n_sampled"))
    heights = ys.groupBy("source_path").agg((F.max(F.when(F.col("zone") == "top", F.col("y"))) + 5).alias("header_height"), (F.max("h") - F.min(F.when(F.col("zone") == "foot", F.col("y"))) + 5).alias("footer_height"))
    texts = m.where("text <> ''").groupBy("source_path", "n_sampled", "zone", "text").agg(F.count("*").alias("c")).where(F.col("c") >= share * F.col("n_sampled"))
    # At most 1/share texts a zone can recur on so many pages of one block each, so the list is short.
    recurring = texts.groupBy("source_path").agg(F.array_sort(F.collect_set("text")).alias("recurring"))
    docs = blocks.select("source_path").distinct()
    return docs.join(heights, "source_path", "left").join(recurring, "source_path", "left").select(
        "source_path", F.coalesce("header_height", F.lit(50.0)).alias("header_height"), F.coalesce("footer_height", F.lit(50.0)).alias("footer_height"), F.coalesce("recurring", F.array().cast("array<string>")).alias("recurring")
    )


def page_text(blocks: DataFrame, marks: DataFrame) -> DataFrame:
    """(source_path, page, text) of blocks that are text, neither recurring nor a number in a margin."""
    b = blocks.where("lines is not null").withColumn("raw", block_text(F.col("lines"))).withColumn("text", F.regexp_replace("raw", r"(?U)^\s+|\s+$", "")).where("text <> ''").join(marks, "source_path")
    number = F.regexp_like(F.replace("text", F.lit(" "), F.lit("")), F.lit(r"^\p{Nd}+$"))
    in_zone = (F.col("bbox")[3] < F.col("header_height")) | (F.col("bbox")[1] > F.col("page_height") - F.col("footer_height"))
    kept = b.where(~F.array_contains("recurring", F.col("text")) & ~(in_zone & number))
    item = F.struct("block_id", "raw")
    return kept.groupBy("source_path", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["raw"]), "\n").alias("text"))
