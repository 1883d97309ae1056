"""Searches of many queries: what each task keeps, and that nothing is lost by it."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.functions.ingest import tokens
from lectern.operators import best, bm25


def test_bm25_passes_on_the_best_of_each_task_only(spark, monkeypatch):
    monkeypatch.setattr(bm25, "QUERIES_AT_ONCE", 7)
    docs = spark.range(2000).select("id", F.concat(F.lit("a b w"), F.col("id") % 10).alias("text")).repartition(3)
    q = spark.range(50).select(F.col("id").alias("query_id"), F.concat(F.lit("a w"), F.col("id") % 10).alias("text"))
    passed, real = [], bm25._candidates
    monkeypatch.setattr(bm25, "_candidates", lambda *x: passed.append(real(*x)) or passed[-1])
    got = bm25.search(q, docs, "id", 5).collect()
    assert sorted((r.query_id, r.rank, r.chunk_id) for r in got) == [(i, n + 1, i % 10 + 10 * n) for i in range(50) for n in range(5)]
    assert passed[0].count() <= 8 * 50 * 5  # 500,000 documents have a word of some query


def test_bm25_matches_of_score_zero_come_before_no_match(spark):
    docs = spark.createDataFrame([("a", "y"), ("b", "y"), ("c", "x"), ("d", "x")], "id string, text string")
    q = spark.createDataFrame([("q", "x")], "query_id string, text string")  # log(2.5) - log(2.5) is 0
    for found in (bm25.search(q, docs, "id", 3), bm25.search_index(q, p := bm25.postings(docs, "id"), n := bm25.lengths(docs, "id"), bm25.index_stats(p, n), 3)):
        assert [(r.chunk_id, r.score) for r in found.orderBy("rank").collect()] == [("c", 0.0), ("d", 0.0), ("a", 0.0)]


def test_words_are_those_of_the_columns(spark):
    odd = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b" for c in odd] + [" ", "", "\u3000a  b\n", None, "c\x1cd\u00a0e"]
    want = [r.w for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").orderBy("i").select(tokens(F.col("text")).alias("w")).collect()]
    low = [r.t for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").orderBy("i").select(F.lower("text").alias("t")).collect()]
    for cut in ([t for t in low if t is None or not any(c in t for c in "\x1c\x1d\x1e\x1f")], low):  # both ways of splitting
        have = {t: w for t, w in zip(low, want)}
        assert [w and [x for x in w if x] for w in bm25.split(pa.array(cut, pa.string())).to_pylist()] == [have[t] for t in cut]


@pytest.mark.parametrize("kind", [int, str])
def test_best_equals_sorting(kind):
    rng = np.random.default_rng(1)
    d = np.round(rng.random((6, 500)), 2)
    d[5] = np.inf
    d[5, 400:402] = 1.0
    keys = np.array([kind(10_000 + i) for i in rng.permutation(500)], dtype=np.int64 if kind is int else object)
    b = best.Best(4, 6)
    for low in range(0, 500, 30):
        b.add(np.arange(6), keys[low : low + 30], d[:, low : low + 30])
    q, key, v = b.settle()
    assert sorted(zip(q.tolist(), v.tolist(), key.tolist())) == [(i, x, k) for i in range(6) for x, k in sorted(zip(d[i].tolist(), keys.tolist()))[:4] if x < np.inf]


def test_vectors_of_words():
    import hashlib

    import pandas as pd

    from lectern.functions import models

    texts = ["One one two", "", None, "x\x1cy"]
    for t, v in zip(texts, models.hashed_embedder(8)()(pd.Series(texts, dtype=object))):
        want = np.zeros(8)
        for w in (t or "").lower().split():
            h = hashlib.md5(w.encode()).hexdigest()
            want[int(h[:4], 16) % 8] += 1 if h[4] >= "8" else -1
        assert v.tolist() == (want / (np.linalg.norm(want) or 1)).tolist()


@pytest.mark.parametrize("same", [False, True])
def test_dense_holds_few_distances_at_once(spark, monkeypatch, same):
    """Blocks of rows and queries, with repeated vectors across their edges."""
    from lectern.operators import dense

    shapes, real = [], best.Best.add
    monkeypatch.setattr(best.Best, "add", lambda self, which, keys, d, *x: shapes.append(d.shape) or real(self, which, keys, d, *x))
    monkeypatch.setattr(best, "CELLS", 64)
    rng = np.random.default_rng(2)
    m, x = rng.integers(0, 3, (40, 2)).astype(float), rng.integers(0, 3, (300, 2)).astype(float)

    class Sent:
        value = (np.arange(40), m, np.array(["g"] * 40, dtype=object))

    class Rows:
        def where(self, *_):
            return self

        select = where

        def mapInArrow(self, run, _):
            batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(["g"] * 300), pa.array(x.tolist())], names=["key", "g", "v"])
            return [r for b in run(iter([batch])) for r in b.to_pylist()]

    got = dense._candidates(Rows(), [Sent()], 3, "key", "v", "g", same)
    dist = ((m[:, None] - x[None]) ** 2).sum(axis=2)
    assert sorted((r["query_id"], round(r["distance"], 9), r["key"]) for r in got) == [(i, d, k) for i in range(40) for d, k in sorted(zip(dist[i].tolist(), range(300)))[:3]]
    assert max(a * b for a, b in shapes) <= 40 * 16


def test_postings_are_counted_without_a_shuffle(spark):
    docs = spark.createDataFrame([("a", "x Y y", 3), ("b", None, 4), ("c", " ", 5)], "id string, text string, part int")
    made = bm25.postings(docs, "id", keep=("part",))
    assert sorted(made.collect()) == [("a", "x", 1, 3, 3), ("a", "y", 2, 3, 3)]
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted(bm25.lengths(docs, "id", keep=("part",)).collect()) == [("a", 3, 3), ("b", 0, 4), ("c", 0, 5)]


def test_repeated_vectors_are_searched_once(spark, monkeypatch):
    from lectern.operators import dense

    rows = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(60)], "vec_id bigint, embedding array<double>")
    asked = [(i, [float(i % 3), 1.0]) for i in range(9)] + [(9, [0.0, 1.0]), (9, [5.0, 1.0])]  # the last has two vectors
    sent, real = [], dense._blocks
    monkeypatch.setattr(dense, "_blocks", lambda q: sent.extend(real(q)) or sent)
    got = dense.nearest(rows, spark.createDataFrame(asked, "query_id bigint, embedding array<double>"), 4).collect()
    want = [(i, n + 1, i % 3 + 7 * n) for i in range(9) for n in range(4)] + [(9, n + 1, v) for n, v in enumerate((0, 5, 7, 12))]
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == want
    assert sum(len(b.value[0]) for b in sent) == 4


@pytest.mark.parametrize("most", [8_000_000, 0])
def test_first_of_wide_rows(spark, monkeypatch, most):
    """Rows alone of their key aren't shuffled; those repeated, or with a null key, give one."""
    from lectern.operators import retrieval

    monkeypatch.setattr(retrieval, "SENT_BYTES", most)
    made = lambda d: spark.createDataFrame(d, "id string, n int, text string")
    d = [("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z"), (None, 4, "u"), (None, 3, "v"), ("c", None, "w"), ("c", 0, "t")]
    assert sorted(r.text for r in retrieval.first_of_wide(made(d), ["id"], "n").collect()) == ["v", "w", "y", "z"]
    assert sorted(r.text for r in retrieval.first_of_wide(made(d[1:3]), ["id"], "n").collect()) == ["y", "z"]
    assert retrieval.first_of_wide(made([]), ["id"], "n").count() == 0


@pytest.mark.parametrize("at_once", [4096, 5])
def test_common_words_are_scored_once_and_rare_ones_added(spark, monkeypatch, at_once):
    """Repeated queries, queries that differ in a rare word, or have only rare words: the same as scoring each for itself."""
    monkeypatch.setattr(bm25, "QUERIES_AT_ONCE", at_once)
    texts = [" ".join(["a"] * (i % 3 + 1) + ["b"] * (i % 5 == 0) + [f"r{i % 40}"] + ["x"] * (i % 7)) for i in range(400)]
    asked = [f"a b r{i % 9}" for i in range(30)] + ["a b", "r3 r4", "r5 r5 a", "a b r1 r2", "none"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    sent, real = [], bm25._grouped
    monkeypatch.setattr(bm25, "_grouped", lambda *x: sent.append(real(*x)) or sent[-1])
    got = sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 8)) for r in bm25.search(q, docs, "id", 6).collect())
    idf = {r.term: r.idf for r in bm25.term_stats(docs, "id").collect()}
    words, want = [t.split() for t in texts], []
    mean = sum(map(len, words)) / len(words)
    for n, query in enumerate(asked):
        score = [sum(idf.get(t, 0) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / mean)) for t in query.split()) for w in words]
        want += [(n, k + 1, i, round(score[i], 8)) for k, i in enumerate(sorted(range(400), key=lambda i: (-round(score[i], 9), i))[:6])]
    assert [x[:3] for x in got] == [x[:3] for x in want] and np.allclose([x[3] for x in got], [x[3] for x in want])
    blocks = sent[0][0]
    assert sum(len(of) for *_, of in blocks) == 13  # different queries, with words that are there
    assert at_once < 13 or len(blocks) == 1 and blocks[0][2].max() + 1 == 3  # a b, a, and none


def test_texts_are_embedded_where_they_are_scored(spark):
    """Null and empty texts have the zero vector, as in a column of vectors; no column of vectors is made on the way."""
    from lectern.functions import models
    from lectern.operators import hybrid

    chunks = spark.createDataFrame([(1, "One two"), (2, None), (3, "two  three "), (4, ""), (5, "one TWO")], "chunk_id long, text string")
    asked = spark.createDataFrame([(0, "two one"), (7, None), (8, "three"), (9, "two one")], "query_id long, query string")
    found = hybrid.nearest_chunks(asked, chunks, 4)
    want = hybrid.nearest_chunks(asked, chunks.withColumn("embedding", models.embedding(F.col("text"))), 4)
    assert sorted(found.collect()) == sorted(want.collect())
    assert [(r.chunk_id, r.distance) for r in found.where("query_id = 9").orderBy("rank").collect()][:2] == [(1, 0.0), (5, 0.0)]
    assert "ArrowEvalPython" not in found._jdf.queryExecution().optimizedPlan().toString()
