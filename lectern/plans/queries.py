"""Named queries over the given tables, one or more for each operator.

Searches take as queries the rows whose id is divisible by 100, against all rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.config import Config
from lectern.functions import ingest, latex, models, present
from lectern.operators import bm25, chunking, confidence, dense, hybrid, layout, ordered, retrieval, state, statistics
from lectern.session import shared_dir, written
from lectern.sources import ingestion, sinks
from lectern.sources.collections import open_collection, sparse_index, table

K = Config().top_k
FETCH = Config().overfetch * K


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, query): the titles of the documents whose id is divisible by 100."""
    return table(spark, d, "documents").where("doc_id % 100 = 0 and title is not null").select(F.col("doc_id").alias("query_id"), F.col("title").alias("query"))


def _library(spark: SparkSession, d: str, *extra: str) -> DataFrame:
    """The chunks that are searched, with the columns asked for: one of each id, by its number, stored as a collection is, as searches read it several times."""
    rows = table(spark, d, "text_chunks").select("chunk_id", "chunk_key", "source_file", "page", "text", *extra).where("chunk_id is not null")
    return written(retrieval.first_of_wide(rows, ["chunk_id"], "chunk_key").drop("chunk_id").withColumnRenamed("chunk_key", "chunk_id"), "library")


def _chunks(spark: SparkSession, d: str, *extra: str) -> DataFrame:
    """One row a chunk id: the first indexed; repeated rows are left out."""
    cols = ["chunk_id", "chunk_key", "source_file", "page", *extra]
    return retrieval.first_of(table(spark, d, "text_chunks").select(*cols).where("chunk_id is not null"), ["chunk_id"], "chunk_key")


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, chunk_id, source_file, page, similarity, rank): one row a query and chunk, ranked anew by the given rank."""
    h = table(spark, d, "retrieval_hits").select("query_id", "chunk_id", "source_file", "page", "similarity", "rank", "hit_id").where("query_id is not null and chunk_id is not null")
    one = retrieval.first_of(h, ["query_id", "chunk_id"], "rank", "hit_id")
    order = W.partitionBy("query_id").orderBy("rank", "hit_id")
    return one.withColumn("rank", F.row_number().over(order).cast("bigint")).drop("hit_id")


def _hydrated(spark: SparkSession, d: str) -> DataFrame:
    c = _chunks(spark, d, "text", "author", "chapter", "parent_content", "source_type").drop("source_file", "page", "chunk_key")
    return _hits(spark, d).join(c, "chunk_id")


def _query_texts(spark: SparkSession, d: str) -> DataFrame:
    """A text for each query id of the hits: the test items in turn, however many there are."""
    items = table(spark, d, "benchmark_items").where("item_id is not null")
    slots = items.select((F.row_number().over(W.orderBy("item_id")) - 1).alias("slot"), F.col("text").alias("query"))  # a small stated set
    n = items.agg(F.count("*").alias("n"))
    ids = table(spark, d, "retrieval_hits").where("query_id is not null").select("query_id").distinct()
    return ids.crossJoin(F.broadcast(n)).withColumn("slot", F.pmod("query_id", "n")).join(slots, "slot").select("query_id", "query")  # one row


# --- sparse, dense and hybrid search


def bm25_term_stats(spark: SparkSession, d: str) -> DataFrame:
    return bm25.term_stats(table(spark, d, "documents"), "doc_id").select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_multi_query_topk(spark: SparkSession, d: str) -> DataFrame:
    r = bm25.search(_questions(spark, d), table(spark, d, "documents"), "doc_id", FETCH, query_text="query")
    return r.select("query_id", F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


def stored_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """The search of a collection's stored index, which two appends have built."""
    path = f"{shared_dir(spark)}/collection-{uuid.uuid4().hex}"
    open_collection(spark, path, create=True)
    chunks = table(spark, d, "text_chunks").where("chunk_id is not null")
    sinks.add_chunks(chunks.where("indexed_at < '2025-01-01'"), path)
    sinks.add_chunks(chunks, path)
    return bm25.search_index(_questions(spark, d), *sparse_index(spark, path), FETCH, query_text="query").select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def _vector_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return dense.nearest(table(spark, d, "embeddings"), _vector_queries(spark, d), FETCH)


def dense_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Only rows with the query's own label are scored."""
    return dense.nearest(table(spark, d, "embeddings"), _vector_queries(spark, d), K, group="label", same=True)


def dense_topk_per_label(spark: SparkSession, d: str) -> DataFrame:
    return dense.nearest(table(spark, d, "embeddings"), _vector_queries(spark, d), 3, group="label")


def dense_topk_where(spark: SparkSession, d: str) -> DataFrame:
    """Chosen filters: they reach the scan."""
    hits = hybrid.retrieved(_questions(spark, d), _library(spark, d, "source_type"), K, retrieval.where(source_type=present.SOURCE_TYPE_OF_LABEL["Books"], author=None, language=""))
    return hits.select("query_id", "chunk_id", "similarity", "rank")


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return hybrid.fused(_questions(spark, d), _library(spark, d), K).select("query_id", "chunk_id", F.round("rrf_score", 9).alias("rrf_score"), "rank")


def rrf_fusion_expanded(spark: SparkSession, d: str) -> DataFrame:
    return hybrid.fused(_questions(spark, d), _library(spark, d), K, table(spark, d, "query_expansions")).select("query_id", "chunk_id", F.round("rrf_score", 9).alias("rrf_score"), "rank")


def hybrid_reranked(spark: SparkSession, d: str) -> DataFrame:
    r = hybrid.hybrid(_questions(spark, d), _library(spark, d), K, table(spark, d, "query_expansions"))
    return r.select("query_id", "chunk_id", "similarity", "rank", present.snippet(F.col("text"), 200).alias("snippet"))


def retrieved_context(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval without an answer: the context of each question's hits."""
    library = _library(spark, d, "author", "chapter", "parent_content")
    hits = written(hybrid.retrieved(_questions(spark, d), library, K, terms=table(spark, d, "query_expansions")), "hits")
    c = retrieval.flat_context(retrieval.sent(hits).join(library, "chunk_id"))
    return c.select("query_id", F.md5(F.col("context").cast("binary")).alias("digest"), F.length("context").cast("bigint").alias("n_chars"))


def expanded_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Each question's hits and the chunks of the two pages around them."""
    library = _library(spark, d)
    hits = retrieval.sent(written(hybrid.retrieved(_questions(spark, d), library, K, terms=table(spark, d, "query_expansions")), "hits")).join(library.select("chunk_id", "source_file", "page"), "chunk_id")
    return retrieval.with_neighbours(hits, library, pages=2).select("query_id", "chunk_id", "similarity", "initial")


def deep_search_by_author(spark: SparkSession, d: str) -> DataFrame:
    """The first author, by position, one of whose own best chunks is relevant, searched for in both wordings."""
    q, library = _questions(spark, d), _library(spark, d, "author", "parent_content")
    other = retrieval.expanded(q, table(spark, d, "query_expansions")).select("query_id", F.col("expanded").alias("query"))
    hits = hybrid.by_author(q, library, other).join(library.select("chunk_id", "text", "parent_content"), "chunk_id").join(q, "query_id")
    authors = statistics.priority_authors(table(spark, d, "text_chunks"), ["Kelmora", "Duvarin"])
    r = confidence.first_relevant_author(hits, authors, confidence.relevant(F.col("query"), present.context_text(F.col("parent_content"), F.col("text"))), per_author=6)
    return r.select("query_id", "chunk_id", "author", "similarity")


# --- query expansion


def _user_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chat_messages").where("lower(trim(role)) = 'user' and content is not null").select("conv_id", "turn", F.col("content").alias("query"))


def query_expansion(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.expanded(_user_queries(spark, d), table(spark, d, "query_expansions")).select("conv_id", "turn", "term", "expanded")


def expansion_info(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.expansion_matches(_user_queries(spark, d), table(spark, d, "query_expansions"), ["conv_id", "turn"])


# --- contexts


def neighbour_expansion(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.with_neighbours(_hits(spark, d), _chunks(spark, d)).select("query_id", "chunk_id", "similarity", "initial")


def context_flat(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.flat_context(_hydrated(spark, d)).select("query_id", F.md5(F.col("context").cast("binary")).alias("digest"), F.length("context").cast("bigint").alias("n_chars"))


def context_grouped(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.grouped_context(_hydrated(spark, d)).select("query_id", F.md5(F.col("context").cast("binary")).alias("digest"), F.length("context").cast("bigint").alias("n_chars"))


def reading_order(spark: SparkSession, d: str) -> DataFrame:
    """Positions of a query's hits by source, page and similarity, and by similarity alone."""
    h = _hits(spark, d)
    read = W.partitionBy("query_id").orderBy("source_file", "page", F.desc_nulls_last("similarity"), "chunk_id")
    shown = W.partitionBy("query_id").orderBy(F.desc_nulls_last("similarity"), "source_file", "page", "chunk_id")
    return h.select("query_id", "chunk_id", F.row_number().over(read).cast("bigint").alias("read_pos"), F.row_number().over(shown).cast("bigint").alias("shown_pos"))


def confidence_batch(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "retrieval_hits").where("query_id is not null")
    return confidence.confidence(h, h.select("query_id"))


def relevance_top5_filter(spark: SparkSession, d: str) -> DataFrame:
    hits = _hydrated(spark, d).join(_query_texts(spark, d), "query_id")
    return confidence.verified(hits, confidence.relevant(F.col("query"), F.col("text"))).select("query_id", "chunk_id", "rank", "verified")


def verified_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Confidence after the check of relevance, with what is said before an answer of low confidence."""
    q = _query_texts(spark, d)
    hits = _hydrated(spark, d).join(q, "query_id")
    r = confidence.verified_confidence(hits, confidence.relevant(F.col("query"), F.col("text")), q)
    return r.select("*", present.low_confidence_notice(F.col("level")).alias("notice"))


def deep_search_first_author(spark: SparkSession, d: str) -> DataFrame:
    hits = _hydrated(spark, d).join(_query_texts(spark, d), "query_id")
    authors = statistics.priority_authors(table(spark, d, "text_chunks"), ["Kelmora", "Duvarin"])
    r = confidence.first_relevant_author(hits, authors, confidence.relevant(F.col("query"), present.context_text(F.col("parent_content"), F.col("text"))))
    return r.select("query_id", "chunk_id", "author", "similarity")


def answer_prompts(spark: SparkSession, d: str) -> DataFrame:
    """What the generator is asked: the verified hits as context, the question and the language to answer in."""
    q = _query_texts(spark, d)
    hits = _hydrated(spark, d).join(q, "query_id")
    left = confidence.verified(hits, confidence.relevant(F.col("query"), F.col("text")))
    left = left.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank")).cast("bigint"))
    asked = q.join(retrieval.flat_context(left), "query_id", "left")
    lang = present.answer_language(F.col("query"), ingest.language_heuristic(F.col("query")))
    p = present.prompt(F.col("context"), F.lit(""), F.col("query"), lang)
    return asked.select("query_id", lang.alias("language"), F.md5(p.cast("binary")).alias("digest"), present.token_estimate(p).alias("tokens"))


def answer_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Hits with neighbours, confidence, context and prompt, and an answer where the confidence allows one."""
    texts = _chunks(spark, d, "text", "author", "chapter", "parent_content").drop("chunk_key")
    wide = retrieval.with_neighbours(_hits(spark, d), _chunks(spark, d))
    order = W.partitionBy("query_id").orderBy(F.desc_nulls_last("similarity"), "source_file", "page", "chunk_id")
    ranked = wide.select("query_id", "chunk_id", "similarity").join(texts, "chunk_id").withColumn("rank", F.row_number().over(order).cast("bigint"))
    context = retrieval.flat_context(ranked)
    sure = confidence.confidence(table(spark, d, "retrieval_hits"))
    q = _query_texts(spark, d).join(sure, "query_id").join(context, "query_id", "left")
    lang = present.answer_language(F.col("query"), ingest.language_heuristic(F.col("query")))
    q = q.withColumn("prompt", present.prompt(F.col("context"), F.lit(""), F.col("query"), lang))
    answer = F.when(F.col("should_respond"), latex.normalize_latex(models.extractive_answer(F.col("query"), F.col("context")))).otherwise("Not enough evidence was found.")
    return q.select("query_id", "level", lang.alias("language"), present.token_estimate(F.col("prompt")).alias("prompt_tokens"), answer.alias("answer"))


# --- statistics and maintenance


def collection_stats(spark: SparkSession, d: str) -> DataFrame:
    return statistics.collection_stats(table(spark, d, "text_chunks"))


def distinct_values(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "text_chunks")
    return statistics.distinct_values(c, "author").select(F.lit("author").alias("field"), "value").unionByName(statistics.distinct_values(c, "source_file").select(F.lit("source_file").alias("field"), "value"))


def count_by_type_zero_filled(spark: SparkSession, d: str) -> DataFrame:
    return statistics.count_by_type(table(spark, d, "extracted_pages"))


def top_authors(spark: SparkSession, d: str) -> DataFrame:
    return statistics.top_authors(table(spark, d, "text_chunks"))


def priority_authors(spark: SparkSession, d: str) -> DataFrame:
    return statistics.priority_authors(table(spark, d, "text_chunks"), ["Kelmora", "Duvarin"])


def chunking_stats(spark: SparkSession, d: str) -> DataFrame:
    return statistics.chunking_stats(table(spark, d, "text_chunks"))


def incremental_new_files(spark: SparkSession, d: str) -> DataFrame:
    """Paths of pages of which no chunk is stored."""
    return sinks.new_files(table(spark, d, "extracted_pages").select("source_path").where("source_path is not null").distinct(), table(spark, d, "text_chunks"))


def incremental_new_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Ids indexed in 2025 or later that weren't before."""
    c = table(spark, d, "text_chunks").where("chunk_id is not null")
    return sinks.new_chunks(c.where("indexed_at >= '2025-01-01'").select("chunk_id"), c.where("indexed_at < '2025-01-01'"))


def delete_by_file(spark: SparkSession, d: str) -> DataFrame:
    """What is left of each type in a collection when the largest file is deleted from it, and what goes."""
    path = f"{shared_dir(spark)}/collection-{uuid.uuid4().hex}"
    open_collection(spark, path, create=True)
    sinks.add_chunks(table(spark, d, "text_chunks"), path, index=False)
    count = lambda name: open_collection(spark, path).groupBy("source_type").agg(F.count("*").alias(name))
    before = written(count("before"), "before")
    largest = open_collection(spark, path).where("source_file is not null").groupBy("source_file").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_file").first()
    if largest:
        sinks.delete_file(spark, path, largest.source_file)
    after = count("remaining").withColumnRenamed("source_type", "_type")
    both = before.join(after, F.col("source_type").eqNullSafe(F.col("_type")), "left").withColumn("remaining", F.coalesce("remaining", F.lit(0)).cast("bigint"))
    return both.select("source_type", "remaining", (F.col("before") - F.col("remaining")).alias("deleted"))


def hit_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of the stored chunks with the values that stand for missing ones."""
    c = table(spark, d, "text_chunks")
    return c.select("chunk_key", present.defaulted(*[F.col(x) for x in ("source_file", "page", "author", "source_type", "chapter")]).alias("f")).select("chunk_key", "f.*")


def exported_chunks(spark: SparkSession, d: str) -> DataFrame:
    return sinks.exported(table(spark, d, "text_chunks").select("chunk_key", "author", "chapter", "parent_id", "child_ids", "has_latex"))


# --- scalar functions


def citations(spark: SparkSession, d: str) -> DataFrame:
    a, c, p = F.col("author"), F.col("chapter"), F.col("page")
    return table(spark, d, "text_chunks").select("chunk_key", present.citation(a, c, p).alias("citation"), present.ui_citation(a, c, p).alias("ui_citation"))


def snippets(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "text_chunks").select("chunk_key", present.snippet(t, 200).alias("snippet"), present.token_estimate(t).alias("tokens"), ingest.word_count(t).cast("bigint").alias("words"), F.length(present.context_text(F.col("parent_content"), t)).cast("bigint").alias("context_chars"))


def similarity_scores(spark: SparkSession, d: str) -> DataFrame:
    s = present.similarity(F.col("distance"))
    return table(spark, d, "retrieval_hits").select("hit_id", F.round(s, 9).alias("from_distance"), F.round(present.sigmoid(F.col("similarity")), 9).alias("logistic"))


def source_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extracted_pages").select("page_id", ingest.source_type(F.col("source_path")).alias("source_type"), ingest.stem(F.col("source_file")).alias("stem"))


def author_infer(spark: SparkSession, d: str) -> DataFrame:
    """By file: known names are looked for in its name and its first page."""
    p = table(spark, d, "extracted_pages").where("source_file is not null")
    first = p.groupBy("source_file").agg(F.min_by("text", F.struct("page_number", "page_id")).alias("text"))
    return first.select("source_file", ingest.author(F.col("source_file"), F.col("text"), ["Kelmora", "Morvanic", "Duvarin", "Yaldure"]).alias("author"))


def language_heuristic(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extracted_pages").select("page_id", ingest.language_heuristic(F.col("text")).alias("language"))


def chapter_carry(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chapter_carry(table(spark, d, "extracted_pages"))


def latex_flag_and_tag(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "extracted_pages").select("page_id", ingest.has_latex(t).alias("has_latex"), F.md5(ingest.tag_latex(t).cast("binary")).alias("tagged"))


def latex_split_hints(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extracted_pages").select("page_id", F.md5(ingest.split_hints(ingest.tag_latex(F.col("text"))).cast("binary")).alias("digest"))


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extracted_pages").select("page_id", ingest.clean(F.col("text")).alias("text"))


def clean_text_recurring(spark: SparkSession, d: str) -> DataFrame:
    """Pages without what recurs in the margins of their document."""
    marks = layout.margins(table(spark, d, "page_blocks")).select("source_path", "recurring")
    p = table(spark, d, "extracted_pages").select("page_id", "source_path", "text").join(marks, "source_path", "left")
    return p.select("page_id", ingest.clean(F.col("text"), F.col("recurring")).alias("text"))


def block_types(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "text_chunks").select("chunk_key", ingest.block_type(t).alias("block_type"), *[c.alias(n) for n, c in ingest.content_flags(t).items()])


def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "text_chunks").select("chunk_key", ingest.chunk_id(F.col("source_file"), F.col("page"), F.col("chunk_index"), F.col("text")).alias("made_id"))


def char_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Where each child's beginning stands in the first page row of its file and number."""
    p = table(spark, d, "extracted_pages").where("source_file is not null and page_number is not null").groupBy("source_file", "page_number").agg(F.min_by("text", "page_id").alias("page_text"))
    c = table(spark, d, "text_chunks").where("not coalesce(is_parent, false)").select("chunk_key", "source_file", "page", "text")
    both = c.join(p, (c["source_file"] == p["source_file"]) & (c["page"] == p["page_number"]))
    s, e = ingest.char_offsets(F.col("text"), F.col("page_text"))
    return both.select("chunk_key", s.cast("bigint").alias("start_char"), e.cast("bigint").alias("end_char"))


def normalised_latex(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "text_chunks").select("chunk_key", latex.normalize_latex(F.col("text")).alias("text"))


def highlights(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "text_chunks").select("chunk_key", latex.highlight(F.col("parent_content"), F.col("text")).alias("shown"))


def source_records(spark: SparkSession, d: str) -> DataFrame:
    r = present.source_record(*[F.col(c) for c in ("author", "page", "chapter", "source_type", "text")])
    return table(spark, d, "text_chunks").select("chunk_key", r.alias("r")).select("chunk_key", "r.*")


def badges(spark: SparkSession, d: str) -> DataFrame:
    emoji, colour = present.badge(F.col("level"))
    return confidence_batch(spark, d).select("query_id", emoji.alias("emoji"), colour.alias("colour"))


# --- layout and chunking


def layout_recurring_text(spark: SparkSession, d: str) -> DataFrame:
    m = layout.margins(table(spark, d, "page_blocks"))
    return m.select("source_path", F.round("header_height", 3).alias("header_height"), F.round("footer_height", 3).alias("footer_height"), F.array_join("recurring", "|").alias("recurring"))


def layout_pages(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "page_blocks")
    return layout.page_text(b, layout.margins(b))


def atomic_blocks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.atomic_blocks(table(spark, d, "extracted_pages"))


def chunk_pages(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_pages(table(spark, d, "extracted_pages")).select("chunk_id", "source_path", "page", "chunk_index", "block_type", "start_char", "end_char", "text")


def parent_packing(spark: SparkSession, d: str) -> DataFrame:
    """Parents by page of the stored children: greedy packing to 5,000 characters in order of index."""
    c = table(spark, d, "text_chunks").where("not coalesce(is_parent, false) and source_path is not null and page is not null")
    return chunking.packed(c.select("source_path", "page", "chunk_index", "chunk_key", F.length("text").alias("chars")), Config().parent_chars, ["source_path", "page"], ["chunk_index", "chunk_key"]).select("chunk_key", "parent_seq")


def parents(spark: SparkSession, d: str) -> DataFrame:
    up, _ = chunking.parents(written(chunking.chunk_pages(table(spark, d, "extracted_pages")), "chunks"), Config().parent_chars)
    return up.select("chunk_id", "source_path", "page", "child_count", F.concat_ws(",", "child_ids").alias("child_ids"), "text")


def ingested_library(spark: SparkSession, d: str) -> DataFrame:
    """(rule, n): what holds of the pages once they are chunked, packed and stored in a collection; adding them again adds nothing."""
    pages, c = table(spark, d, "extracted_pages"), Config()
    path = f"{shared_dir(spark)}/collection-{uuid.uuid4().hex}"
    open_collection(spark, path, create=True)
    first, again = ingestion.ingest_pages(pages, path), ingestion.ingest_pages(pages, path)
    rows = open_collection(spark, path)
    kids, up = rows.where("not is_parent"), rows.where("is_parent")
    of = lambda rule, df, n: df.agg(F.coalesce(n, F.lit(0)).cast("bigint").alias("n")).select(F.lit(rule).alias("rule"), "n")
    runs = kids.groupBy("source_path").agg(F.count("*").alias("n"), F.count_distinct("chunk_index").alias("different"), F.max("chunk_index").alias("last"))
    return (
        of("different pages with chunks", kids.select("source_path", "page").distinct(), F.count("*"))
        .unionByName(of("chunks over the limit", kids.where(F.length("text") > c.chunk_chars), F.count("*")))
        .unionByName(of("documents whose index has gaps or repeats", runs.where("n <> different or last <> n - 1"), F.count("*")))
        .unionByName(of("children without a parent", kids.join(up.select(F.col("chunk_id").alias("parent_id")), "parent_id", "left_anti"), F.count("*")))
        .unionByName(of("children not counted by a parent", kids.agg(F.count("*").alias("k")).crossJoin(up.agg(F.sum("child_count").alias("p"))), F.sum(F.abs(F.col("k") - F.col("p")))))  # one row each
        .unionByName(of("parents over the limit with several children", up.where((F.length("text") > c.parent_chars) & (F.col("child_count") > 1)), F.count("*")))
        .unionByName(of("chunks not stored", spark.range(1), F.lit(first["added"]) - F.lit(rows.count())))
        .unionByName(of("chunks added twice", spark.range(1), F.lit(again["added"])))
    )


# --- conversations and state


def chat_window_prompt(spark: SparkSession, d: str) -> DataFrame:
    chat = table(spark, d, "chat_messages")
    history = state.last_messages(chat, 10)
    asked = chat.where("lower(trim(role)) = 'user' and content is not null").groupBy("conv_id").agg(F.max_by("content", "turn").alias("question"))
    p = present.prompt(F.lit(""), F.col("history"), F.col("question"), F.lit("en"))
    return history.join(asked, "conv_id").select("conv_id", p.alias("prompt"), present.token_estimate(p).alias("tokens"))


def rewrite_history(spark: SparkSession, d: str) -> DataFrame:
    return state.last_messages(table(spark, d, "chat_messages"), 3, 200)


def rewrites(spark: SparkSession, d: str) -> DataFrame:
    """The user's questions as a stand-in rewriter words them, in quotes, and what is then asked of the generator."""
    c = retrieval.expanded(_user_queries(spark, d), table(spark, d, "query_expansions"))
    c = c.withColumn("rewrite", present.sanitised_rewrite(F.col("query"), F.concat(F.lit('"'), F.col("expanded"), F.lit('"'))))
    return c.select("conv_id", "turn", "rewrite", present.generation_query(F.col("query"), F.col("rewrite")).alias("asked"))


def scope_checks(spark: SparkSession, d: str) -> DataFrame:
    """Which questions hold a term of the dictionary: the stand-in for a model's verdict on their scope."""
    vocabulary = [r[0] for r in table(spark, d, "query_expansions").where("term <> ''").select(F.lower("term")).distinct().limit(1000).collect()]  # a dictionary of a field
    return _user_queries(spark, d).select("conv_id", "turn", models.in_scope(F.col("query"), vocabulary).alias("in_scope"))


def answer_language(spark: SparkSession, d: str) -> DataFrame:
    q = _user_queries(spark, d)
    return q.select("conv_id", "turn", present.answer_language(F.col("query"), ingest.language_heuristic(F.col("query"))).alias("language"))


def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the user's questions with the message before them as context; turns are found in buckets, however long a conversation is."""
    c = table(spark, d, "chat_messages")
    turns = ordered.previous(c.select("conv_id", "turn"), "conv_id", "turn", "turn", "_before")
    asked = c.where("lower(trim(role)) = 'user' and content is not null").join(turns, ["conv_id", "turn"])
    before = c.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), F.col("content").alias("before"))
    both = asked.join(before, (F.col("conv_id") == F.col("_conv")) & (F.col("_before") == F.col("_turn")), "left")
    return both.select("conv_id", "turn", present.cache_key(F.col("content"), F.coalesce("before", F.lit(""))).alias("cache_key"))


def cache_ttl_hits(spark: SparkSession, d: str) -> DataFrame:
    return state.cache_hits(table(spark, d, "events"), ["user_id", "event_type"])


def rate_limit_emit_times(spark: SparkSession, d: str) -> DataFrame:
    return state.emit_times(table(spark, d, "events"))


def session_quota(spark: SparkSession, d: str) -> DataFrame:
    return state.quota(table(spark, d, "events"), ["user_id"])


def interval_merge(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of each page that its children cover."""
    c = table(spark, d, "text_chunks").where("not coalesce(is_parent, false) and source_file is not null and page is not null")
    return state.merged_intervals(c, ["source_file", "page"], "start_char", "end_char")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from inspect import isfunction

    return {k: f for k, f in globals().items() if isfunction(f) and f.__module__ == __name__ and k[0] != "_" and k != "queries"}
