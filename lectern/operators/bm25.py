"""BM25 over tables: term statistics in one pass, searches that keep the best documents in each task, and a stored index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.ingest import tokens
from lectern.operators.best import CELLS, QUERIES_AT_ONCE, Best, merged, rows_at_once
from lectern.session import written

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Blanks as tokens() knows them, and controls that Arrow alone takes for blanks.
BLANKS, CONTROLS = "[\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+", "[\\x1c-\\x1f]"
#: Words whose documents a task counts before it passes them on.
COUNTED_AT_ONCE = 500_000
#: A word is rare if at most one document in so many has it: the documents of a query's rare words are scored one by one.
RARE = 16
#: Texts whose postings a task makes at once.
TEXTS_AT_ONCE = 1_000


def _words(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("chunk_id"), F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("words"))


def postings(docs: DataFrame, key: str, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(chunk_id, term, tf, dl, *keep): what an index stores, with columns of docs. Null and empty texts have none. A text is counted where it is read, nothing is shuffled."""
    src = docs.select(F.col(key).alias("chunk_id"), F.lower(F.col(text)).alias("text"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, TEXTS_AT_ONCE):
                some = b.slice(low, TEXTS_AT_ONCE)
                coded, doc, word, tf, dl = _counted(some.column(1))
                at = pa.array(doc)
                cols = [some.column(0).take(at), coded.take(pa.array(word)), pa.array(tf, pa.int64()), pa.array(dl[doc], pa.int64()), *(c.take(at) for c in some.columns[2:])]
                yield pa.RecordBatch.from_arrays(cols, names=["chunk_id", "term", "tf", "dl", *keep])

    types = dict(src.dtypes)
    return src.mapInArrow(run, f"chunk_id {types['chunk_id']}, term string, tf bigint, dl bigint" + "".join(f", {c} {types[c]}" for c in keep))


def lengths(docs: DataFrame, key: str, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(chunk_id, dl, *keep) of every document; null texts have length 0."""
    return docs.select(F.col(key).alias("chunk_id"), F.size(F.coalesce(tokens(F.col(text)), F.array().cast("array<string>"))).cast("bigint").alias("dl"), *keep)


def term_stats(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(term, df, idf, n_docs, avgdl): a negative idf becomes EPSILON times the mean over the vocabulary.

    One pass: each document gives its different words and one row without a term, which counts documents and lengths. What
    is shuffled is the vocabulary of each task; the counts, one row a word, are written once.
    """
    words = _words(docs, key, text).select(F.size("words").cast("bigint").alias("dl"), F.explode(F.concat(F.array_distinct("words"), F.array(F.lit(None).cast("string")))).alias("term"))
    return _with_idf(words.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("dls")))


def index_stats(postings: DataFrame, lengths: DataFrame) -> DataFrame:
    """term_stats() of a stored index."""
    df = postings.groupBy("term").agg(F.count("*").alias("df"), F.lit(None).cast("bigint").alias("dls"))
    return _with_idf(df.unionByName(lengths.agg(F.count("*").alias("df"), F.sum("dl").alias("dls")).select(F.lit(None).cast("string").alias("term"), "df", "dls")))


def _with_idf(counts: DataFrame) -> DataFrame:
    counts = written(counts, "term-counts")
    whole = counts.where("term is null").select(F.col("df").alias("n_docs"), (F.col("dls") / F.col("df")).alias("avgdl"))
    raw = counts.where("term is not null").crossJoin(F.broadcast(whole)).withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # one row
    mean = raw.agg(F.avg("raw").alias("mean_raw"))
    idf = F.when(F.col("raw") >= 0, F.col("raw")).otherwise(EPSILON * F.col("mean_raw"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", idf.alias("idf"), "n_docs", "avgdl")  # one row


def _said(queries: DataFrame, query_key: str, text: str) -> DataFrame:
    """(query_id, term, times), written once."""
    q = queries.select(F.col(query_key).alias("query_id"), F.explode(tokens(F.col(text))).alias("term"))
    return written(q.groupBy("query_id", "term").agg(F.count("*").alias("times")), "asked")


def _weights(said: DataFrame, stats: DataFrame) -> DataFrame:
    return said.join(stats, "term").select("query_id", "term", (F.col("idf") * F.col("times")).alias("w"), "avgdl", (F.col("df") * RARE <= F.col("n_docs")).alias("rare"))


def split(lower: pa.Array) -> pa.Array:
    """The words of lower-case texts as tokens() has them, and perhaps empty ones; nulls stay."""
    odd = pc.any(pc.match_substring_regex(lower, CONTROLS)).as_py()
    return pc.split_pattern_regex(lower, BLANKS) if odd else pc.utf8_split_whitespace(lower)


def _counted(lower: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(different words, documents, places of words, times, lengths): documents' words by document, and the length of every document."""
    lists = split(lower)
    flat = lists.flatten()
    doc = np.repeat(np.arange(len(lower)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    coded, doc = flat.filter(pa.array(full)).dictionary_encode(), doc[full]
    n = max(1, len(coded.dictionary))
    pairs, tf = np.unique(doc * n + coded.indices.to_numpy(), return_counts=True)
    return coded.dictionary, *np.divmod(pairs, n), tf, np.bincount(doc, minlength=len(lower))


def _scanned(docs: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """One pass over the texts, written once: rows (chunk_id, dl, words, tfs) of documents with some of the terms, words being places in terms;
    and rows (term, df, dls) as term_stats() counts them, several a term."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)
    src = docs.select(F.col(key).alias("chunk_id"), F.lower(F.col(text)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, counts, n_docs, dls, schema = pa.array(sent.value, pa.string()), {}, 0, 0, None

        def counted(terms: list, dfs: list, sums: list) -> pa.RecordBatch:
            cols = {"term": pa.array(terms, pa.string()), "df": pa.array(dfs, pa.int64()), "dls": pa.array(sums, pa.int64())}
            return pa.RecordBatch.from_arrays([cols.get(f.name, pa.nulls(len(terms), f.type)) for f in schema], schema=schema)

        for b in batches:
            n = b.num_rows
            schema = pa.schema([("chunk_id", b.column(0).type), ("dl", pa.int64()), ("words", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())), ("term", pa.string()), ("df", pa.int64()), ("dls", pa.int64())])
            coded, doc, word, tf, dl = _counted(b.column(1))
            n_docs, dls = n_docs + n, dls + int(dl.sum())
            for t, df in zip(coded.to_pylist(), np.bincount(word, minlength=len(coded)).tolist()):
                counts[t] = counts.get(t, 0) + df
            if len(counts) > COUNTED_AT_ONCE:
                yield counted([*counts], [*counts.values()], [None] * len(counts))
                counts = {}
            place = pc.fill_null(pc.index_in(coded, asked), -1).to_numpy()[word]
            at = np.flatnonzero(place >= 0)
            if len(at):
                starts = np.flatnonzero(np.concatenate(([True], doc[at][1:] != doc[at][:-1])))
                edges = pa.array(np.append(starts, len(at)), pa.int32())
                have = doc[at][starts]
                lists = [pa.ListArray.from_arrays(edges, pa.array(x[at], pa.int32())) for x in (place, tf)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(have)), pa.array(dl[have], pa.int64()), *lists, *(pa.nulls(len(have), schema.field(k).type) for k in (4, 5, 6))], schema=schema)
        if schema:
            yield counted([*counts, None], [*counts.values(), n_docs], [None] * len(counts) + [dls])

    kind = dict(src.dtypes)["chunk_id"]
    return written(src.mapInArrow(run, f"chunk_id {kind}, dl bigint, words array<int>, tfs array<int>, term string, df bigint, dls bigint"), "scanned")


def search(queries: DataFrame, docs: DataFrame, key: str, k: int, text: str = "text", query_key: str = "query_id", query_text: str = "text") -> DataFrame:
    """(query_id, chunk_id, score, rank): the best k documents of each query; repeated query words count again, ties go to the smaller chunk_id.

    key is unique. The words of the queries are broadcast, the texts are read once, for the counts of all words and the
    places of those asked for; then each task keeps k candidates a query. What is shuffled is bounded by tasks times queries
    times k, however many documents have a word. A query with fewer matches is filled up with documents of score 0.
    """
    said = _said(queries, query_key, query_text)
    terms = said.select("term").distinct().toArrow()["term"].to_pylist()
    scanned = _scanned(docs, key, text, terms)
    stats = _with_idf(scanned.where("df is not null").groupBy("term").agg(F.sum("df").alias("df"), F.sum("dls").alias("dls")))
    found = scanned.where("words is not null").select("chunk_id", "dl", "words", "tfs")
    return _best(queries, found, _weights(said, stats), terms, docs.select(F.col(key).alias("chunk_id")), k, query_key)


def search_index(queries: DataFrame, postings: DataFrame, lengths: DataFrame, stats: DataFrame, k: int, query_key: str = "query_id", query_text: str = "text") -> DataFrame:
    """search() in a stored index; the words of the queries are broadcast, and only postings of words that some query has are gathered by document."""
    said = _said(queries, query_key, query_text)
    asked = said.select("term").distinct()
    found = postings.join(F.broadcast(asked), "term", "left_semi").groupBy("chunk_id", "dl").agg(F.collect_list(F.struct("term", "tf")).alias("p"))
    terms = asked.toArrow()["term"].to_pylist()
    return _best(queries, found.select("chunk_id", "dl", F.col("p.term").alias("words"), F.col("p.tf").alias("tfs")), _weights(said, stats), terms, lengths.select("chunk_id"), k, query_key)


def _grouped(asked: pa.Table, terms: list[str]) -> tuple[list[tuple], np.ndarray, np.ndarray, bool]:
    """Blocks of different queries; the ids of all queries, and the place of each one's query; whether all weights are positive.

    Queries that have their words and weights but the rare ones in common are beside each other, as `common` words that are
    scored once. A block has (words of its commons, words of its rare rest, the common of each query); words are (queries
    or commons, weights, starts by code).
    """
    ids, q = np.unique(asked["query_id"].to_numpy(), return_inverse=True)
    code = pc.index_in(asked["term"], pa.array(terms, pa.string())).to_numpy()
    w = asked["w"].to_numpy()
    told = bool(len(w)) and bool(w.min() > 0)
    rare = asked["rare"].to_numpy(zero_copy_only=False).astype(bool) if told else np.zeros(len(w), dtype=bool)
    order = np.lexsort((code, rare, q))
    parts = np.split(order, np.flatnonzero(np.diff(q[order])) + 1) if len(order) else []
    each = [(tuple(zip(code[x[~rare[x]]].tolist(), w[x[~rare[x]]].tolist())), tuple(zip(code[x[rare[x]]].tolist(), w[x[rare[x]]].tolist()))) for x in parts]
    different = sorted(set(each))
    place = {x: n for n, x in enumerate(different)}

    def by_code(lists: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = sorted((c, n, v) for n, x in enumerate(lists) for c, v in x)
        return np.array([n for _, n, _ in flat], np.int64), np.array([v for *_, v in flat], np.float64), np.searchsorted(np.array([c for c, *_ in flat], np.int64), np.arange(len(terms) + 1))

    blocks = []
    for low in range(0, len(different), QUERIES_AT_ONCE):
        own = different[low : low + QUERIES_AT_ONCE]
        commons = {c: n for n, c in enumerate(dict.fromkeys(c for c, _ in own))}
        blocks.append((by_code([*commons]), by_code([r for _, r in own]), np.array([commons[c] for c, _ in own], np.int64)))
    return blocks, ids, np.array([place[x] for x in each], np.int64), told


def _candidates(docs: DataFrame, weights: DataFrame, terms: list[str], k: int) -> DataFrame:
    """(query_id, chunk_id, score): of docs (chunk_id, dl, words, tfs) each task's k best for each different query, and thereby for
    all with the same words; words are terms or places in terms.

    The driver holds the words of all queries once, and so does each task. What common words add to a document is found
    once for all queries that have them; the k best of a query are among the k best by its common words and the documents
    with its rare words, as these only add to a score.
    """
    asked = weights.toArrow()
    blocks, ids, place, told = _grouped(asked, terms)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((terms, blocks, told, asked["avgdl"][0].as_py() if len(asked) else 1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, blocks, told, avgdl = sent.value
        best = [(Best(k, int(of.max()) + 1), Best(k, len(of))) for *_, of in blocks]
        step = rows_at_once(max((int(of.max()) + 1 for *_, of in blocks), default=1))
        for b in batches:
            kind = b.column(0).type
            keys = b.column(0).to_numpy() if pa.types.is_integer(kind) else np.array(b.column(0).to_pylist(), dtype=object)
            for (low, high), code, doc, factor in _matches(b, pa.array(terms, pa.string()), avgdl, step):
                for (common, rare, of), (by_common, by_rare) in zip(blocks, best):
                    d = _add(by_common, *common, int(of.max()) + 1, keys[low:high], code, doc, factor, told)
                    _add_rare(by_rare, *rare, of, d, keys[low:high], code, doc, factor)
        for nth, ((*_, of), (by_common, by_rare)) in enumerate(zip(blocks, best)):
            c, key, d = by_common.settle()
            starts, order = np.searchsorted(np.sort(of), np.arange(int(of.max()) + 2)), np.argsort(of, kind="stable")
            each, at = _spread(starts[c], starts[c + 1] - starts[c])
            q, key, d = merged(k, by_rare.settle(), (order[at], key[each], d[each])) if len(c) else by_rare.settle()
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(q + nth * QUERIES_AT_ONCE, pa.int64()), pa.array(key.tolist() if key.dtype == object else key, kind), pa.array(-d)], names=["query_id", "chunk_id", "score"])

    types = dict(weights.dtypes) | dict(docs.dtypes)
    found = docs.mapInArrow(run, f"query_id bigint, chunk_id {types['chunk_id']}, score double").withColumnRenamed("query_id", "nth")
    found = found.withColumn("rank", F.row_number().over(W.partitionBy("nth").orderBy(F.round("score", 9).desc(), "chunk_id"))).where(F.col("rank") <= k)
    named = spark.createDataFrame(pa.table({"query_id": pa.array(ids.tolist(), asked.schema.field("query_id").type), "nth": pa.array(place, pa.int64())}), f"query_id {types['query_id']}, nth bigint")
    return found.join(named, "nth").select("query_id", "chunk_id", "score")


def _spread(low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, place): the places low, low + 1, ... of ranges of n each, one after the other."""
    each = np.repeat(np.arange(len(n)), n)
    return each, np.arange(len(each)) + np.repeat(low - np.cumsum(n) + n, n)


def _matches(b: pa.RecordBatch, terms: pa.Array, avgdl: float, step: int) -> Iterator[tuple]:
    """((low, high), places in terms, documents, factors) of each `step` documents of a batch, by term; documents count from low."""
    n, flat = b.num_rows, b.column(2).flatten()
    code = (flat if pa.types.is_integer(flat.type) else pc.index_in(flat, terms)).to_numpy()
    doc = np.repeat(np.arange(n), pc.list_value_length(b.column(2)).to_numpy())
    tf, dl = b.column(3).flatten().to_numpy(), b.column(1).to_numpy()[doc]
    factor = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
    order = np.lexsort((doc, code, doc // step))
    code, doc, factor = code[order], doc[order], factor[order]
    slot = doc // step
    edges = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1], [True]))) if len(slot) else []
    for lo, hi in zip(edges, edges[1:]):
        low = int(slot[lo]) * step
        yield (low, min(n, low + step)), code[lo:hi], doc[lo:hi] - low, factor[lo:hi]


def _add(best: Best, q: np.ndarray, w: np.ndarray, starts: np.ndarray, n: int, keys: np.ndarray, code: np.ndarray, doc: np.ndarray, factor: np.ndarray, told: bool) -> np.ndarray:
    """The documents `keys` into the best of n queries, and their values: scores below zero. Unless scores tell a match, as with positive weights, matches are marked."""
    d = np.zeros((n, len(keys)))
    seen = None if told else np.zeros(d.shape, dtype=bool)
    edges = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1], [True])))
    for lo, hi in zip(edges, edges[1:]):
        a, z = starts[code[lo]], starts[code[lo] + 1]
        if a == z:
            continue
        at = (q[a:z, None] * d.shape[1] + doc[None, lo:hi]).ravel()
        d.ravel()[at] -= (w[a:z, None] * factor[None, lo:hi]).ravel()
        if seen is not None:
            seen.ravel()[at] = True
    if seen is not None:
        d[~seen] = np.inf
    best.add(np.arange(n), keys, d, 0.0 if told else np.inf)
    return d


def _add_rare(best: Best, q: np.ndarray, w: np.ndarray, starts: np.ndarray, of: np.ndarray, common: np.ndarray, keys: np.ndarray, code: np.ndarray, doc: np.ndarray, factor: np.ndarray) -> None:
    """The documents with rare words into the best of each query that has these; common: values by the query's common words, which `of` tells."""
    n = starts[code + 1] - starts[code]
    at = np.flatnonzero(n)
    if not len(at):
        return
    code, doc, factor, n = code[at], doc[at], factor[at], n[at]
    parts = (np.cumsum(np.bincount(doc, n, len(keys))) // CELLS)[doc]  # all of a document in one
    for part in np.unique(parts):
        own = np.flatnonzero(parts == part)
        each, word = _spread(starts[code[own]], n[own])
        each = own[each]
        flat, d = q[word] * len(keys) + doc[each], -w[word] * factor[each]
        order = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], flat[order][1:] != flat[order][:-1])))
        which, row = np.divmod(flat[order[first]], len(keys))
        best.add_some(which, keys[row], np.add.reduceat(d[order], first) + common[of[which], row])


def _best(queries: DataFrame, docs: DataFrame, weights: DataFrame, terms: list[str], ids: DataFrame, k: int, query_key: str) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "chunk_id")
    best = written(_candidates(docs, weights, terms, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")
    # Among the 2k smallest ids are k that a query with fewer than k hits hasn't found.
    first = ids.orderBy("chunk_id").limit(2 * k)
    short = queries.select(F.col(query_key).alias("query_id")).distinct().join(best.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").where(F.coalesce("n", F.lit(0)) < k)
    zero = short.crossJoin(F.broadcast(first)).join(best.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")  # 2k rows
    zero = zero.withColumn("rank", F.coalesce("n", F.lit(0)) + F.row_number().over(W.partitionBy("query_id").orderBy("chunk_id"))).where(F.col("rank") <= k)
    both = best.select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))
    return both.unionByName(zero.select("query_id", "chunk_id", F.lit(0.0).alias("score"), F.col("rank").cast("bigint").alias("rank")))
