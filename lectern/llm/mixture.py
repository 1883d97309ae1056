"""Problem 7: mix sources to target weights.

Weighted sampling without replacement after Efraimidis and Spirakis: each document draws an exponential key divided by
its quality weight; documents in key order, prefix-summed in tokens, fill the source's budget. A budget larger than the
source takes whole epochs first and a fractional selection last, at most max_repeats in all.

The prefix sums of a source run over ordered buckets of keys: sums per bucket first, then offsets over the few buckets,
then a window inside each bucket, so that a source with a third of all documents is never one task.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.tools import written

#: Quality weight of a document that has none.
LEAST_QUALITY = 0.05
#: Entries of the table of hashed byte trigrams, as a power of two.
TRIGRAM_BITS = 18
#: Folder of the public tokenizer files; see with_tokens().
TOKENIZERS = os.environ.get("LECTERN_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the pre-tokenisation pattern published with byte-level BPE vocabularies of 50k entries.
BPE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def source_name(c: Column | str) -> Column:
    """Sources that differ only in case, blanks or separators have one name; null or blank sources have none."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.regexp_replace(F.lower(c.cast("string")), r"(?U)[\s\p{Z}\p{Cf}_\-‐-―./\\|:+·]+", ""), F.lit(""))


def quarter_chars(text: Column | str = "text") -> Column:
    """Size of a document: a quarter of its text's length, rounded down; a missing text has 0."""
    c = F.col(text) if isinstance(text, str) else text
    return F.floor(F.coalesce(F.length(c), F.lit(0)) / 4).cast("bigint")


def with_tokens(docs: DataFrame, *keep: str, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(*keep, size): tokens of the text under a public byte-level BPE vocabulary; null and empty texts have 0.

    The vocabulary is a file on the driver; Spark sends it to the executors.
    """
    path = vocabulary or f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken"
    docs.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)
    src = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    names = [*keep, "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        bpe = tiktoken.Encoding("public", pat_str=BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            *columns, texts = b.columns
            sizes = [0 if not t else len(bpe.encode_ordinary(t)) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64())], names=names)

    return src.mapInArrow(run, ", ".join([*(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep), "size bigint"]))


def _trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a text's byte trigrams, hashed, and of the two bytes before each third one."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
    two = (b[:-2] << 8) | b[1:-1]
    return ((((two << 8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(32 - TRIGRAM_BITS)).astype(np.int64), two.astype(np.int64)


def trigram_counts(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed byte trigrams and of byte pairs over all documents: two tables of a fixed size, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((1 << TRIGRAM_BITS) + (1 << 16), dtype=np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                if len(t) > 2:
                    three, two = _trigrams(t)
                    n[: 1 << TRIGRAM_BITS] += np.bincount(three, minlength=1 << TRIGRAM_BITS)
                    n[1 << TRIGRAM_BITS :] += np.bincount(two, minlength=1 << 16)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["at", "n"])

    raw = docs.select(F.col(text).cast("string").alias("text")).where("text is not null").mapInArrow(run, "at bigint, n bigint")
    n = np.zeros((1 << TRIGRAM_BITS) + (1 << 16), dtype=np.int64)
    for b in raw.groupBy("at").agg(F.sum("n").alias("n")).toArrow().to_batches():  # at most as many rows as the tables have entries
        n[b.column(0).to_numpy()] = b.column(1).to_numpy()
    return n[: 1 << TRIGRAM_BITS], n[1 << TRIGRAM_BITS :]


def with_quality(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """(*keep, quality): a weight in [0.05, 1] from corpus evidence; a missing text or one under three bytes has the least.

    The mean probability of a byte after the two before it, under counts over all documents (damaged or random text is
    unlikely), times the share of its words that are different, as far as it is below a half (repetition is likely, but
    worth little).
    """
    three, two = trigram_counts(docs, text)
    logs = docs.sparkSession.sparkContext.broadcast((np.log(three + 0.5).astype(np.float32), np.log(two + 0.5 * 256).astype(np.float32)))
    src = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    names = [*keep, "quality"]

    def quality(t: str | None) -> float:
        if not t or len(t) < 3:
            return LEAST_QUALITY
        a, b = _trigrams(t)
        likely = float(np.exp(np.mean(logs.value[0][a] - logs.value[1][b])))
        words = t.split()
        return max(LEAST_QUALITY, min(1.0, likely * min(1.0, 2 * len(set(words)) / max(1, len(words)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            *columns, texts = b.columns
            yield pa.RecordBatch.from_arrays([*columns, pa.array([quality(t) for t in texts.to_pylist()], pa.float64())], names=names)

    return src.mapInArrow(run, ", ".join([*(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep), "quality double"]))


def mixture_report(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per listed source: its size, share, the size it can reach and whether that stays below its target.

    sized: (source, size) per document, in any spelling of the sources; sources that are not listed and missing ones
    don't count. targets: (source, weight, max_repeats). Nulls count as 0. A source without documents has size 0.
    """
    t = targets.select(F.col("source"), source_name("source").alias("name"), F.coalesce("weight", F.lit(0)).cast("double").alias("weight"), F.coalesce("max_repeats", F.lit(0)).cast("bigint").alias("max_repeats"))
    per = sized.select(source_name("source").alias("name"), "size").groupBy("name").agg(F.sum("size").alias("size"), F.count("*").alias("n_docs"))
    # The targets are a small table of one row a source; the window over all of them holds no documents.
    everything = W.partitionBy(F.lit(0))
    r = t.join(per, "name", "left").withColumn("size", F.coalesce("size", F.lit(0))).withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))
    r = r.withColumn("weights", F.sum("weight").over(everything)).withColumn("total", F.sum("size").over(everything))
    r = r.withColumn("share", F.when(F.col("weights") > 0, F.col("weight") / F.col("weights")).otherwise(0.0))
    r = r.withColumn("budget", F.col("share") * F.col("total"))
    # size * max_repeats < share * total, multiplied out so that no rounding decides.
    return r.withColumn("reach", F.col("size") * F.col("max_repeats")).withColumn("below_target", F.col("reach") * F.col("weights") < F.col("weight") * F.col("total"))


def mixture(docs: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", size: str = "size", quality: str = "quality", seed: int = 7, buckets: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(mix: key, source, repeats, size), (report per source with target and actual share).

    docs has a size and a quality weight for each document; missing ones count as 0 and as the least weight. Every
    document of a listed source is used `epochs` times, and those whose prefix sum fits the rest of the budget once more.
    Ties of keys go to the smaller document key; a repeated row is a document of its own. Documents of size 0 follow the
    same rule and add nothing.
    """
    u = (F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
    weight = F.greatest(F.coalesce(F.col(quality), F.lit(LEAST_QUALITY)), F.lit(1e-6))
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(source).alias("source"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("size"), (-F.log(u) / weight).alias("draw"))
    rows = written(rows, "mix-rows")
    report = written(mixture_report(rows.select("source", "size"), targets), "mix-report")
    plan = report.select("name", F.col("source").alias("listed"), "budget", F.col("size").alias("source_size"), "max_repeats")
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("budget") / F.col("source_size")), F.col("max_repeats"))).otherwise(0))
    plan = plan.withColumn("rest", F.when(F.col("epochs") < F.col("max_repeats"), F.col("budget") - F.col("epochs") * F.col("source_size")).otherwise(0.0))
    # A monotone function of the draw cuts each source into ordered buckets.
    keyed = rows.withColumn("name", source_name("source")).drop("source").withColumn("bucket", F.floor(F.col("draw") / (1 + F.col("draw")) * buckets))
    sums = keyed.groupBy("name", "bucket").agg(F.sum("size").alias("s"))
    before = sums.withColumn("offset", F.sum("s").over(W.partitionBy("name").orderBy("bucket")) - F.col("s")).drop("s")
    inside = W.partitionBy("name", "bucket").orderBy("draw", "key")
    chosen = keyed.join(plan, "name").join(before, ["name", "bucket"])
    chosen = chosen.withColumn("prefix", F.col("offset") + F.sum("size").over(inside))
    mix = chosen.withColumn("repeats", (F.col("epochs") + F.when(F.col("prefix") <= F.col("rest"), 1).otherwise(0)).cast("int")).where("repeats > 0")
    mix = mix.select(F.col("key").alias(key), F.col("listed").alias("source"), "repeats", "size")
    used = mix.groupBy("source").agg(F.sum(F.col("size") * F.col("repeats")).alias("used"))
    actual = report.join(used, "source", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    actual = actual.withColumn("actual_share", F.col("used") / F.nullif(F.sum("used").over(W.partitionBy(F.lit(0))), F.lit(0)))
    return mix, actual.select("source", "n_docs", "size", "max_repeats", "share", "budget", "used", "actual_share", "below_target")
