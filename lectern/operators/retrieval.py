"""Fusion, reranking, query expansion, neighbouring pages and contexts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.ingest import tokens
from lectern.functions.present import citation, context_text, sigmoid
from lectern.session import written


def where(source_type: str | None = None, author: str | None = None, language: str | None = None, **filters) -> Column | None:
    """Conjunction of equalities; missing values, an empty or 'all' source type and null custom filters set no condition."""
    named = {"source_type": None if (source_type or "all").lower() == "all" else source_type, "author": author or None, "language": language or None, **filters}
    leaves = [F.col(k) == v for k, v in named.items() if v is not None]
    return reduce(lambda a, b: a & b, leaves) if leaves else None


def fuse(dense: DataFrame, sparse: DataFrame, cut: int, k: int = 60) -> DataFrame:
    """(query_id, chunk_id, rrf_score, dense_rank, sparse_rank, rank): reciprocal rank fusion of two ranked lists.

    Ties keep the order of the dense list, then of the sparse one.
    """
    both = dense.select("query_id", "chunk_id", F.col("rank").alias("r"), F.lit("d").alias("list")).unionByName(sparse.select("query_id", "chunk_id", F.col("rank").alias("r"), F.lit("s").alias("list")))
    rank_in = lambda x: F.min(F.when(F.col("list") == x, F.col("r")))
    scores = both.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (k + F.col("r"))).alias("rrf_score"), rank_in("d").alias("dense_rank"), rank_in("s").alias("sparse_rank"))
    order = W.partitionBy("query_id").orderBy(F.round("rrf_score", 12).desc(), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"))
    return scores.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= cut)


def rerank(hits: DataFrame, k: int, query: str = "query", text: str = "text") -> DataFrame:
    """hits with similarity and rank: the default cross scorer, a logit of the share of query words found in the text.

    A stand-in for a model; pass a scored frame through top_ranked() to use one.
    """
    q, t = F.array_distinct(tokens(F.col(query))), F.array_distinct(tokens(F.col(text)))
    share = F.size(F.array_intersect(q, t)) / F.nullif(F.size(q), F.lit(0))
    return top_ranked(hits.withColumn("similarity", F.round(sigmoid(6 * F.coalesce(share, F.lit(0.0)) - 3), 6)), k)


def top_ranked(hits: DataFrame, k: int) -> DataFrame:
    """The k best by similarity for each query; ties keep their earlier rank."""
    order = W.partitionBy("query_id").orderBy(F.desc("similarity"), "rank")
    return hits.withColumn("_new", F.row_number().over(order).cast("bigint")).where(F.col("_new") <= k).drop("rank").withColumnRenamed("_new", "rank")


#: Terms of a dictionary at most: each text is searched for every one of them.
DICTIONARY_TERMS = 100_000


def _dictionary(terms: DataFrame) -> DataFrame:
    n = terms.count()
    if n > DICTIONARY_TERMS:
        raise ValueError(f"{n} terms are no dictionary; at most {DICTIONARY_TERMS} are sent to all tasks")
    return F.broadcast(terms)


def expanded(queries: DataFrame, terms: DataFrame, m: int = 3, query: str = "query") -> DataFrame:
    """queries with `expanded`: the first m synonyms of the longest dictionary term within the query are appended.

    The dictionary is a small table; a query takes one term at most, of equal lengths the first by name.
    """
    d = terms.where("term is not null and term <> ''").groupBy(F.lower("term").alias("term")).agg(F.min("expansions").alias("expansions"))
    best = F.max_by(F.struct("term", "expansions"), F.struct(F.length("term"), F.transform(F.split("term", ""), lambda c: -F.ascii(c))))
    q = queries.withColumn("_low", F.lower(F.coalesce(F.col(query), F.lit(""))))
    distinct = q.select("_low").distinct()
    hit = distinct.join(_dictionary(d), F.contains(distinct["_low"], d["term"])).groupBy("_low").agg(best.alias("_hit"))
    joined = q.join(hit, "_low", "left")
    more = F.array_join(F.slice("_hit.expansions", 1, m), " ")
    return joined.withColumn("expanded", F.when(F.col("_hit").isNull() | (more == ""), F.col(query)).otherwise(F.concat(F.col(query), F.lit(" "), more))).withColumn("term", F.col("_hit.term")).drop("_low", "_hit")


def expansion_matches(queries: DataFrame, terms: DataFrame, key: list[str], query: str = "query") -> DataFrame:
    """(*key, term, position, n_expansions) of every dictionary term within each query."""
    d = terms.where("term is not null and term <> ''").select(F.lower("term").alias("term"), F.size("expansions").cast("bigint").alias("n_expansions"))
    q = queries.select(*key, F.lower(query).alias("_low"))
    return q.join(_dictionary(d), F.contains(F.col("_low"), F.col("term"))).select(*key, "term", (F.position(F.col("term"), F.col("_low")) - 1).cast("bigint").alias("position"), "n_expansions")


def first_of(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    """One row of each key: the first in the given order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


#: Bytes of a table at most that is sent to all tasks; a larger one is shuffled.
SENT_BYTES = 8_000_000


def sent(rows: DataFrame, row_bytes: int = 40) -> DataFrame:
    """rows, a stored table of a few numbers a row, as one that a join sends to all tasks if it is small; it is counted first."""
    return F.broadcast(rows) if rows.count() * row_bytes <= SENT_BYTES else rows


def first_of_wide(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    """first_of() of rows with texts, few of them repeated: a row alone of its key goes by as it is read, others are shuffled.

    Keys are told by their hashes, so that rows of another key with the same hash are shuffled too. Where too many are
    repeated to be sent to all tasks, all rows are shuffled.
    """
    h = F.xxhash64(*key)
    repeated = written(rows.groupBy(h.alias("_h")).agg(F.count("*").alias("n")).where("n > 1").select("_h"), "repeated")
    if (n := repeated.count()) * 32 > SENT_BYTES:
        return first_of(rows, key, *order)
    if not n:
        return rows
    hashed = rows.withColumn("_h", h)
    more = first_of(hashed.join(F.broadcast(repeated), "_h", "left_semi"), key, *order)  # measured above
    return hashed.join(F.broadcast(repeated), "_h", "left_anti").unionByName(more).drop("_h")


def with_neighbours(hits: DataFrame, chunks: DataFrame, pages: int = 1, cap: int = 25) -> DataFrame:
    """(query_id, chunk_id, source_file, page, similarity, initial): hits and the chunks of neighbouring pages.

    hits: (query_id, chunk_id, source_file, page, similarity, rank), one row a chunk. Files come in the order of their
    first hit, pages and chunk ids ascending; the total is cut at cap, but never below the hits there are. Neighbours
    have similarity max(0.3, least of the hits - 0.05). Hits without file or page have no neighbours.
    """
    files = hits.where("source_file is not null and source_file <> '' and page is not null and page > 0")
    order = files.groupBy("query_id", "source_file").agg(F.min("rank").alias("file_order"))
    around = files.select("query_id", "source_file", F.explode(F.sequence(F.greatest(F.lit(1), F.col("page") - pages), F.col("page") + pages)).alias("page")).distinct()
    cand = around.join(order, ["query_id", "source_file"]).join(chunks.select("chunk_id", "source_file", "page").distinct(), ["source_file", "page"])
    fresh = cand.join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    fresh = fresh.groupBy("query_id", "chunk_id").agg(F.min(F.struct("file_order", "source_file", "page")).alias("at")).select("query_id", "chunk_id", "at.*")
    count = hits.groupBy("query_id").agg(F.count("*").alias("n_hits"), F.greatest(F.lit(0.3), F.min("similarity") - 0.05).alias("floor"))
    pos = F.row_number().over(W.partitionBy("query_id").orderBy("file_order", "source_file", "page", "chunk_id"))
    added = fresh.join(count, "query_id").withColumn("pos", pos).where(F.col("pos") <= cap - F.col("n_hits"))
    new = added.select("query_id", "chunk_id", "source_file", "page", F.coalesce("floor", F.lit(0.3)).alias("similarity"), F.lit(False).alias("initial"))
    return hits.select("query_id", "chunk_id", "source_file", "page", "similarity", F.lit(True).alias("initial")).unionByName(new)


def flat_context(hits: DataFrame) -> DataFrame:
    """(query_id, context): '[Source i - citation]' and text of each hit, in order of rank."""
    part = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit(" - "), citation(F.col("author"), F.col("chapter"), F.col("page")), F.lit("]\n"), context_text(F.col("parent_content"), F.col("text")))
    one = hits.select("query_id", F.struct(F.col("rank"), part.alias("s")).alias("p"))
    return one.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["s"]), "\n\n---\n\n").alias("context"))


def grouped_context(hits: DataFrame) -> DataFrame:
    """(query_id, context): citation and text of each hit in reading order, with a header of author and file where the file changes."""
    order = W.partitionBy("query_id").orderBy("source_file", "page", F.desc("similarity"), "chunk_id")
    same = F.lag("source_file").over(order).eqNullSafe(F.col("source_file")) & (F.row_number().over(order) > 1)
    head = F.concat(F.lit("\n=== From: "), F.coalesce("author", F.lit("Unknown")), F.lit(" - "), F.coalesce("source_file", F.lit("Unknown")), F.lit(" ===\n\n"))
    part = F.concat(F.lit("["), citation(F.col("author"), F.col("chapter"), F.col("page")), F.lit("]\n"), F.coalesce(context_text(F.col("parent_content"), F.col("text")), F.lit("")), F.lit("\n"))
    one = hits.select("query_id", F.struct(F.row_number().over(order).alias("n"), F.concat(F.when(same, F.lit("")).otherwise(head), part).alias("s")).alias("p"))
    return one.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["s"]), "\n").alias("context"))
