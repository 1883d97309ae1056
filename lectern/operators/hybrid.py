"""Retrieval of text questions: dense and sparse search over the same chunks, fused and reranked; by filters; author by author."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.config import Config
from lectern.functions import models
from lectern.operators import bm25, dense, retrieval
from lectern.session import written


def embedded(rows: DataFrame, text: str, embedder=None) -> DataFrame:
    """rows with `embedding`; where a collection stores vectors this isn't needed."""
    return rows if "embedding" in rows.columns else rows.withColumn("embedding", models.embedding(F.col(text), embedder))


def nearest_chunks(questions: DataFrame, chunks: DataFrame, k: int, filters: Column | None = None, group: str | None = None) -> DataFrame:
    """(query_id, chunk_id, distance, similarity, rank [, group]) of questions (query_id, query) among chunks (chunk_id, text, ...); filters reach the scan, before any scoring."""
    chosen = chunks if filters is None else chunks.where(filters)
    kept = "embedding" in chunks.columns
    vector, load = ("embedding", None) if kept else ("text", models.hashed_embedder())
    rows = chosen.select("chunk_id", vector, *([group] if group else []))
    asked = embedded(questions.select("query_id", "query"), "query").withColumnRenamed("embedding", vector)
    return dense.nearest(rows, asked, k, key="chunk_id", vector=vector, group=group, load=load)


def fused(questions: DataFrame, chunks: DataFrame, k: int, terms: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """(query_id, chunk_id, rrf_score, dense_rank, sparse_rank, rank): the best 2k; terms, the dictionary, expands the words of the sparse search only."""
    near = nearest_chunks(questions, chunks, config.overfetch * k)
    asked = questions.select("query_id", "query")
    if terms is not None and config.expands():
        asked = retrieval.expanded(asked, terms, 2).select("query_id", F.col("expanded").alias("query"))
    sparse = bm25.search(asked, chunks, "chunk_id", config.overfetch * k, query_text="query")
    return retrieval.fuse(near, sparse, 2 * k, config.rrf_k)


def hybrid(questions: DataFrame, chunks: DataFrame, k: int, terms: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """(query_id, chunk_id, query, text, similarity, rank): the k best of both searches after reranking."""
    hits = written(fused(questions, chunks, k, terms, config).select("query_id", "chunk_id", "rank"), "fused")
    texts = retrieval.sent(hits).join(chunks.select("chunk_id", "text"), "chunk_id").join(questions.select("query_id", "query"), "query_id")
    return retrieval.rerank(texts, k).select("query_id", "chunk_id", "query", "text", "similarity", "rank")


def retrieved(questions: DataFrame, chunks: DataFrame, k: int, filters: Column | None = None, terms: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """(query_id, chunk_id, similarity, rank): dense search where filters are set, else both searches."""
    hits = hybrid(questions, chunks, k, terms, config) if filters is None else nearest_chunks(questions, chunks, k, filters)
    return hits.select("query_id", "chunk_id", "similarity", "rank")


def by_author(questions: DataFrame, chunks: DataFrame, rewritten: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, chunk_id, author, similarity, rank): the k best chunks of every author for each question, and those for its rewritten form that are new.

    A search for each author would read the chunks once an author; one search keeps the best of each author.
    """
    named = chunks.where("author is not null and trim(author) <> ''")
    one = lambda q, n: nearest_chunks(q, named, k, group="author").withColumn("_list", F.lit(n))
    both = one(questions, 0).unionByName(one(rewritten, 1))
    return retrieval.first_of(both, ["query_id", "chunk_id"], "_list").select("query_id", "chunk_id", "author", "similarity", (F.col("rank") + F.col("_list") * k).alias("rank"))
