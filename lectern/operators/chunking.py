"""Chunks of pages and the parents they are packed into."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.config import Config
from lectern.functions import ingest, segment
from lectern.operators import ordered
from lectern.session import written


def _exploded(pages: DataFrame, of, name: str) -> DataFrame:
    """(page_id, pos, name) of the pieces that of(text) gives for each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, pos, texts = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for k, piece in enumerate(of(t)):
                    at.append(i)
                    pos.append(k)
                    texts.append(piece)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(pos, pa.int32()), pa.array(texts, pa.string())], names=["page_id", "pos", name])

    src = pages.select(F.col("page_id").cast("bigint"), "text").where("text is not null and trim(text) <> ''")
    return src.mapInArrow(run, f"page_id bigint, pos int, {name} string")


def atomic_blocks(pages: DataFrame, config: Config = Config()) -> DataFrame:
    size = config.chunk_chars
    return _exploded(pages, lambda t: segment.atomic_blocks(t, size), "block")


_META = ("source_file", "source_path", "source_type", "author", "page", "chapter", "language", "has_latex")


def chunk_pages(pages: DataFrame, config: Config = Config()) -> DataFrame:
    """Children of every page in the chunk schema, with their running index in the document.

    Texts pass once through Python, which gives each page's chunks with their places, and are written. The index needs
    counts of earlier pages only: numbers are summed up over the pages of a document and joined to the chunks, so no task
    holds a document's texts. Pages without text have no chunk; repeated rows of a page are pages of their own.
    """
    size, overlap = config.chunk_chars, config.overlap_chars
    meta = [F.col("page_number").alias("page") if c == "page" else F.col(c) for c in _META]
    src = pages.where("text is not null and trim(text) <> ''").select(F.col("page_id").cast("bigint"), *meta, "text").withColumn("row_id", F.monotonically_increasing_id())
    names = ["page_id", *_META, "row_id", "chunks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, texts, starts = [0], [], []
            for t in b.column("text").to_pylist():
                for piece in segment.page_chunks(t, size, overlap):
                    texts.append(piece)
                    starts.append(max(0, t.find(piece[:50])))
                ends.append(len(texts))
            one = pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(starts, pa.int32())], names=["text", "start_char"])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:-1]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), one)], names=names)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema if f.name != "text")
    parts = written(src.mapInArrow(run, kinds + ", chunks array<struct<text:string,start_char:int>>").where("size(chunks) > 0"), "page-chunks")
    counted = parts.select("source_path", "page", "page_id", "row_id", F.size("chunks").alias("n"))
    offsets = ordered.total_before(counted.withColumn("tie", F.struct("page_id", "row_id")), "source_path", "page", "tie", "n", "first").select("row_id", "first")
    rows = parts.join(offsets, "row_id").select("page_id", *_META, "first", F.posexplode("chunks").alias("pos", "c"))
    rows = rows.select("page_id", "pos", F.col("c.text").alias("text"), *_META, (F.col("first") + F.col("pos")).cast("int").alias("chunk_index"), "c.start_char")
    rows = rows.withColumns({"block_type": ingest.block_type(F.col("text")), **ingest.content_flags(F.col("text")), "end_char": F.col("start_char") + F.length("text")})
    return rows.withColumn("chunk_id", ingest.chunk_id(F.col("source_file"), F.col("page"), F.col("chunk_index"), F.col("text"))).drop("pos")


def library(pages: DataFrame, config: Config = Config()) -> DataFrame:
    """Children and parents of pages in one table: children carry their parent's id and text, parents the ids of their children."""
    up, children = parents(written(chunk_pages(pages, config), "chunks"), config.parent_chars)
    return children.drop("page_id").unionByName(up, allowMissingColumns=True)


def packed(children: DataFrame, limit: int, group: list[str], order: list[str], length: str = "chars") -> DataFrame:
    """children with parent_seq: greedy packing in order within each group; a parent is closed when the next child would pass the limit.

    group must be bounded, as a page is: its lengths are folded in one row. Two characters join two children.
    """
    state = "struct<size:bigint,seq:int,seqs:array<int>>"
    lens = F.transform("_items", lambda x: x["_len"])
    zero = F.struct(F.lit(0).cast("bigint").alias("size"), F.lit(0).alias("seq"), F.array().cast("array<int>").alias("seqs")).cast(state)

    def step(acc, n):
        flush = (acc["size"] > 0) & (acc["size"] + n + 2 > limit)
        seq = F.when(flush, acc["seq"] + 1).otherwise(acc["seq"])
        size = F.when(flush | (acc["size"] == 0), n).otherwise(acc["size"] + n + 2)
        return F.struct(size.cast("bigint").alias("size"), seq.cast("int").alias("seq"), F.concat(acc["seqs"], F.array(seq.cast("int"))).alias("seqs")).cast(state)

    item = F.struct(*[F.col(o).alias(f"_o{k}") for k, o in enumerate(order)], F.coalesce(F.col(length), F.lit(0)).cast("bigint").alias("_len"), F.struct(*[c for c in children.columns if c not in group]).alias("_row"))
    grouped = children.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    folded = grouped.withColumn("_seqs", F.aggregate(lens, zero, step)["seqs"])
    pairs = folded.select(*group, F.explode(F.arrays_zip("_items", "_seqs")).alias("_p"))
    return pairs.select(*group, F.col("_p._items._row.*"), F.col("_p._seqs").alias("parent_seq"))


def parents(children: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(parents, children with parent_id and parent_content): children of a page rolled up to parents."""
    group = ["source_path", "page"]
    seq = packed(children.select(*group, "chunk_index", "chunk_id", F.length("text").alias("chars")), limit, group, ["chunk_index", "chunk_id"])
    tagged = children.join(seq.select(*group, "chunk_index", "chunk_id", "parent_seq"), [*group, "chunk_index", "chunk_id"])
    item = F.struct("chunk_index", "chunk_id", "text")
    first = F.min_by(F.struct("source_file", "source_type", "author", "chapter", "language", "has_latex", "block_type", "has_theorem", "has_proof", "has_definition"), F.struct("chunk_index", "chunk_id"))
    up = tagged.groupBy(*group, "parent_seq").agg(F.array_sort(F.collect_list(item)).alias("_c"), first.alias("_m"))
    text = F.array_join(F.transform("_c", lambda c: c["text"]), "\n\n")
    up = up.withColumn("text", text).withColumn("child_ids", F.transform("_c", lambda c: c["chunk_id"])).withColumn("child_count", F.size("_c")).withColumn("chunk_index", F.col("_c")[0]["chunk_index"])
    up = up.select(*group, "parent_seq", "_m.*", "text", "child_ids", "child_count", "chunk_index", F.lit(True).alias("is_parent"))
    up = up.withColumn("chunk_id", F.concat(F.lit("parent_"), ingest.chunk_id(F.col("source_file"), F.col("page"), F.col("chunk_index"), F.col("text"))))
    link = up.select(*group, "parent_seq", F.col("chunk_id").alias("parent_id"), F.col("text").alias("parent_content"))
    return up.drop("parent_seq"), tagged.join(link, [*group, "parent_seq"]).drop("parent_seq").withColumn("is_parent", F.lit(False))


def chapter_carry(pages: DataFrame) -> DataFrame:
    """(page_id, chapter): the last chapter detected up to each page of a document, in page order; 0 is none.

    Only numbers are windowed, never texts, and a long document in buckets of pages.
    """
    found = pages.select("page_id", "source_path", "page_number", F.nullif(ingest.chapter(F.col("text")), F.lit(0)).alias("c"))
    return ordered.last_known(found, "source_path", "page_number", "page_id", "c").select("page_id", F.col("c").alias("chapter"))
