"""Micro cases of the operators, with values derived from the semantics; and brute force where SQL can't say it."""

import math
import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern import config
from lectern.functions import ingest, latex, models, present, segment
from lectern.operators import bm25, chunking, confidence, dense, hybrid, layout, ordered, retrieval, state, statistics
from lectern.sources import collections, ingestion, sinks


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in ((k, "double" if isinstance(v, float) else "int" if isinstance(v, int) else "string") for k, v in values.items()))) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def rows(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


# --- fusion, confidence, presentation


def test_rrf(spark):
    lists = lambda xs: spark.createDataFrame([(1, x, k + 1) for k, x in enumerate(xs)], "query_id int, chunk_id string, rank int")
    got = retrieval.fuse(lists("ABC"), lists("BD"), 10).orderBy("rank").collect()
    assert [(r.chunk_id, round(r.rrf_score, 6)) for r in got] == [("B", 0.032522), ("A", 0.016393), ("D", 0.016129), ("C", 0.015873)]
    assert [r.chunk_id for r in retrieval.fuse(lists("A"), lists("B"), 10).orderBy("rank").collect()] == ["A", "B"]


@pytest.mark.parametrize("sims, level", [([0.85, 0.72, 0.68, 0.55, 0.42], "high"), ([0.80, 0.50, 0.50], "medium"), ([0.60], "low"), ([0.50], "low"), ([0.499], "insufficient"), ([None], "insufficient")])
def test_confidence(spark, sims, level):
    hits = spark.createDataFrame([(1, s) for s in sims], "query_id int, similarity double")
    r = confidence.confidence(hits, hits.select("query_id")).first()
    assert r.level == level and r.should_respond == (level != "insufficient")


def test_presentation(spark):
    text = F.lit("aa bb cc dd")
    assert one(spark, present.snippet(text, 7)) == "aa bb..."
    assert one(spark, present.citation(F.lit("Ross"), F.lit(-1), F.lit(12))) == "Ross, page 12"
    assert one(spark, present.citation(F.lit("unknown"), F.lit(0), F.lit(0))) == "Unknown source"
    assert [one(spark, present.similarity(F.lit(float(d)))) for d in range(4)] == [1.0, 0.5, 0.0, 0.0]
    assert one(spark, present.sigmoid(F.lit(-1000.0))) == 0.0
    assert one(spark, present.sanitised_rewrite(F.lit("query"), F.lit("x" * 301))) == "query"
    assert one(spark, present.sanitised_rewrite(F.lit("query"), F.lit('"better"'))) == "better"
    assert [one(spark, present.verdict(F.lit(a))) for a in ("IRRELEVANT.", "relevant", "maybe")] == [False, True, True]
    assert one(spark, present.answer_language(F.lit("¿Qué es una urna?"), F.lit("es"))) == "en"
    assert [one(spark, c) for c in present.badge(F.lit("low"))] == ["🔴", "#dc3545"] and [one(spark, c) for c in present.badge(F.lit("?"))] == ["⚪", "#6c757d"]
    p = one(spark, present.prompt(F.lit(" "), F.lit(""), F.lit("q"), F.lit("es")))
    assert p == "\n\n=== NO RELEVANT CONTEXT FOUND ===\n\n\n\n\nQUESTION: q\n\nANSWER (with citations):\n\nCRITICAL: The user asked in Spanish. You MUST respond in SPANISH."
    p = one(spark, present.prompt(F.lit("c"), F.lit("USER: x"), F.lit("q"), F.lit("en")))
    assert "\n=== CONTEXT FROM BIBLIOGRAPHY ===\n\nc\n\n=== END OF CONTEXT ===\n" in p and "\n=== PREVIOUS CONVERSATION ===\nUSER: x\n=== END OF CONVERSATION ===\n" in p and p.endswith("ENGLISH.")
    assert one(spark, present.generation_query(F.lit("a"), F.lit("b"))).endswith("for 'b']")


def test_where():
    assert retrieval.where(source_type="ALL", author="", k=None) is None


def test_where_filters(spark):
    df = spark.createDataFrame([("x", "book"), ("y", "book")], "author string, source_type string")
    assert df.where(retrieval.where(source_type="all", author="x")).count() == 1
    assert df.where(retrieval.where(source_type="book", author="x")).count() == 1


# --- ingestion


def test_ingest_scalars(spark):
    assert one(spark, ingest.source_type(F.lit("/x/Lecture_Notes/a.pdf"))) == "lecture_notes"
    assert one(spark, ingest.source_type(F.lit("/x/y/a.pdf"))) == "book"
    assert one(spark, ingest.tag_latex(F.lit("a $x$ b"))) == "a [LATEX]$x$[/LATEX] b"
    assert one(spark, ingest.clean(F.lit("prob-\nability\n12\nñan-\ndú"))) == "probability\n\nñandú"
    assert one(spark, ingest.clean(F.lit("keep HEAD this"), F.array(F.lit("HEAD ")))) == "keep this"
    assert one(spark, ingest.block_type(F.lit("Proof of the theorem"))) == "theorem"
    assert one(spark, ingest.chapter(F.lit("x\nCAPÍTULO 12. y"))) == 12 and one(spark, ingest.chapter(F.lit("Chapter 99999999999"))) is None
    assert one(spark, ingest.author(F.lit("an_unknown.pdf"), F.lit("by Ross"), ["Ross"])) == "Ross"
    assert one(spark, ingest.author(F.lit("feller-vol1.pdf"), F.lit(None).cast("string"), ["Ross"])) == "Feller"
    assert one(spark, ingest.split_hints(F.lit("a [LATEX]x[/LATEX] b"))) == "a \n\n[LATEX]x[/LATEX]\n\n b"
    assert one(spark, ingest.language_heuristic(F.lit("the and is el la los"))) == "mixed"


def test_chapter_carry(spark):
    texts = ["none", "Chapter 3", "none", "Chapter 0", "Chapter 7"]
    df = spark.createDataFrame([(k, "f", k, t) for k, t in enumerate(texts)], "page_id int, source_path string, page_number int, text string")
    assert [c for _, c in rows(chunking.chapter_carry(df))] == [None, 3, 3, 3, 7]


def test_atomic_blocks():
    assert segment.atomic_blocks("Theorem 1. A\n\nProof. b\n\nQED\n\nplain", 100) == ["Theorem 1. A\n\nProof. b\n\nQED", "plain"]
    assert segment.atomic_blocks("Lemma 1. x QED\n\nplain", 100) == ["Lemma 1. x QED\n\nplain"]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab .\n,", max_size=300), st.integers(10, 60), st.integers(0, 9))
def test_windows_keep_to_size(text, size, overlap):
    out = segment.windows(text, size, overlap)
    assert all(0 < len(p) <= size for p in out)
    assert set("".join(text.split())) == set("".join("".join(out).split()))


def test_page_chunks():
    text = "\n\n".join("word " * 30 for _ in range(8))
    out = segment.page_chunks(text, 400, 50)
    assert all(len(c) <= 400 for c in out) and segment.page_chunks(" ", 400, 50) == [] and segment.page_chunks("", 1, 0) == []


def test_packing(spark):
    df = spark.createDataFrame([("f", 1, k, n) for k, n in enumerate([3, 4, 5, 2, 9, 1])] + [("g", 1, 0, None)], "source_path string, page int, chunk_index int, chars int")
    got = rows(chunking.packed(df, 8, ["source_path", "page"], ["chunk_index"]), "source_path", "chunk_index", "parent_seq")
    # 3+4+2 > 8, 4+5+2 > 8, 5+2+2 > 8
    assert got == [("f", 0, 0), ("f", 1, 1), ("f", 2, 2), ("f", 3, 3), ("f", 4, 4), ("f", 5, 5), ("g", 0, 0)]
    exact = spark.createDataFrame([("f", 1, k, n) for k, n in enumerate([10, 10, 30])], "source_path string, page int, chunk_index int, chars int")
    assert [s for *_, s in rows(chunking.packed(exact, 22, ["source_path", "page"], ["chunk_index"]), "chunk_index", "parent_seq")] == [0, 0, 1]


def test_chunk_and_parents(spark):
    pages = spark.createDataFrame(
        [(1, "Theorem 1. One.\n\nTwo two.", 1, "a b.pdf", "/books/a b.pdf", "book", "X", None, "en", False), (2, None, 2, "a b.pdf", "/books/a b.pdf", "book", "X", None, "en", False), (3, "Later text.", 3, "a b.pdf", "/books/a b.pdf", "book", "X", 2, "en", False)],
        "page_id long, text string, page_number int, source_file string, source_path string, source_type string, author string, chapter int, language string, has_latex boolean",
    )
    c = chunking.chunk_pages(pages)
    assert rows(c, "page", "chunk_index") == [(1, 0), (3, 1)]
    up, kids = chunking.parents(c, 5000)
    assert up.count() == 2 and {r.parent_content for r in kids.collect()} == {"Theorem 1. One.\n\nTwo two.", "Later text."}
    assert chunking.chunk_pages(pages.limit(0)).count() == 0


def test_library_has_children_and_parents(spark):
    page = ("Theorem 1. One.\n\nTwo two.", 1, "a.pdf", "/books/a.pdf", "book", "X", None, "en", False)
    pages = spark.createDataFrame([(1, *page), (1, *page), (2, "  ", *page[1:])], "page_id long, text string, page_number int, source_file string, source_path string, source_type string, author string, chapter int, language string, has_latex boolean")
    both = chunking.library(pages).collect()
    kids = [r for r in both if not r.is_parent]
    assert sorted(r.chunk_index for r in kids) == [0, 1] and len(both) == 3
    assert {r.parent_id for r in kids} == {r.chunk_id for r in both if r.is_parent} and {c for r in both if r.is_parent for c in r.child_ids} == {r.chunk_id for r in kids}


def test_files_become_a_collection(spark, tmp_path):
    (tmp_path / "books").mkdir()
    for name, text in (("ross-a.pdf", "Chapter 2\nThe walk stays below the bound.|The coin is fair."), ("bad.pdf", "!")):
        (tmp_path / "books" / name).write_text(text)

    def parse(path, content):
        text = content.decode()
        if text == "!":
            raise ValueError("no pages")
        return [{"page_number": k + 1, "text": t} for k, t in enumerate(text.split("|"))]

    path = str(tmp_path / "c")
    counts, errors = ingestion.ingest_files(spark, str(tmp_path / "books"), path, parse)
    assert counts == {"added": 4, "skipped": 0, "errors": 0} and [r.error for r in errors.collect()] == ["ValueError: no pages"]
    c = collections.open_collection(spark, path)
    assert rows(c.where("not is_parent"), "page", "author", "chapter", "source_type") == [(1, "Ross", 2, "book"), (2, "Ross", 2, "book")]
    assert collections.sparse_index(spark, path)[1].count() == 4
    again, _ = ingestion.ingest_files(spark, str(tmp_path / "books"), path, parse)
    assert again["added"] == 0


def test_verified_confidence(spark):
    hits = spark.createDataFrame([(1, "a", 1, 0.9, False), (1, "b", 2, 0.7, True), (2, "c", 1, 0.9, False), (2, "d", 6, 0.8, True)], "query_id long, chunk_id string, rank int, similarity double, ok boolean")
    r = {x.query_id: x for x in confidence.verified_confidence(hits, F.col("ok"), spark.range(1, 4).withColumnRenamed("id", "query_id")).collect()}
    assert (r[1].level, r[1].score) == ("medium", 0.7) and (r[2].level, r[2].score, r[2].should_respond) == ("low", 0.0, True)
    assert r[3].level == "insufficient" and not r[3].should_respond
    assert one(spark, present.low_confidence_notice(F.lit("low"))).startswith("⚠️") and one(spark, present.low_confidence_notice(F.lit("high"))) is None
    assert [one(spark, present.source_type_of_label(F.lit(x))) for x in ("All", "Books", "Lecture Notes", "Exercises", "?")] == [None, "book", "lecture_notes", "exercises", None]


def test_search_by_author_finds_authors_outside_the_best(spark):
    lib = spark.createDataFrame([(k, f"walk bound coin {k}", "A") for k in range(30)] + [(90, "an urn of balls", "B"), (91, None, "C"), (92, "x", None)], "chunk_id long, text string, author string")
    q = spark.createDataFrame([(1, "walk bound")], "query_id long, query string")
    got = hybrid.by_author(q, lib, q, 2)
    assert {(r.author, r.chunk_id) for r in got.collect()} >= {("B", 90), ("C", 91)} and got.where("author = 'A'").count() == 2
    assert hybrid.retrieved(q, lib, 3, retrieval.where(author="B")).count() == 1
    assert hybrid.hybrid(q, lib.limit(0), 3).count() == 0


def test_layout(spark):
    span = lambda t: [{"spans": [{"text": t}]}]
    blocks = []
    for p in range(1, 9):
        blocks += [(10 * p, "d", p, 800.0, [0.0, 10.0, 1.0, 40.0], span("Title")), (10 * p + 1, "d", p, 800.0, [0.0, 20.0, 1.0, 41.0], span(f"{p} {p}")), (10 * p + 2, "d", p, 800.0, [0.0, 300.0, 1.0, 400.0], span(f"Body {p}")), (10 * p + 3, "d", p, 800.0, [0.0, 400.0, 1.0, 500.0], None)]
    df = spark.createDataFrame(blocks, "block_id long, source_path string, page int, page_height double, bbox array<double>, lines array<struct<spans:array<struct<text:string>>>>")
    m = layout.margins(df).first()
    assert m.recurring == ["Title"] and m.header_height == 46.0 and m.footer_height == 50.0
    assert rows(layout.page_text(df, layout.margins(df)), "page", "text") == [(p, f"Body {p}\n") for p in range(1, 9)]


@pytest.mark.parametrize("n, want", [(1, [0]), (40, list(range(10, 30, 2)))])
def test_sampled_pages(spark, n, want):
    df = spark.range(n).select(F.lit("d").alias("source_path"), F.col("id").alias("page"))
    assert sorted(r.page for r in layout.sampled_pages(df).collect()) == want


# --- search


def test_bm25_against_plain_python(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choices(["a", "b", "c", "d", "e", "the"], weights=[1, 2, 3, 4, 1, 30], k=rng.randint(0, 30)))) for i in range(60)] + [(99, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame([(1, "the a a zzz"), (2, "zzz"), (3, None)], "query_id long, text string")
    found = bm25.search(q, df, "doc_id", 100).collect()
    got = {r.chunk_id: r.score for r in found if r.query_id == 1}
    assert len(got) == 61 and sorted((r.rank, r.chunk_id) for r in found if r.query_id == 2) == [(k + 1, i) for k, (i, _) in enumerate(docs)]
    tf, dl = bm25.postings(df, "doc_id"), bm25.lengths(df, "doc_id")
    assert rows(bm25.search_index(q, tf, dl, bm25.index_stats(tf, dl), 7)) == rows(bm25.search(q, df, "doc_id", 7))
    assert rows(bm25.index_stats(tf, dl)) == rows(bm25.term_stats(df, "doc_id"))
    assert bm25.search(q, df.limit(0), "doc_id", 7).count() == 0
    words = {i: (t or "").split() for i, t in docs}
    n, avg = len(docs), sum(map(len, words.values())) / len(docs)
    df_of = lambda t: sum(t in w for w in words.values())
    vocab = {t for w in words.values() for t in w}
    raw = {t: math.log(n - df_of(t) + 0.5) - math.log(df_of(t) + 0.5) for t in vocab}
    idf = {t: r if r >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, r in raw.items()}
    for i, w in words.items():
        s = sum(idf.get(t, 0) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avg)) for t in "the a a zzz".split() if t in w)
        assert abs(got.get(i, 0) - s) < 1e-9


def test_dense_blocks_and_ties(spark, monkeypatch):
    vecs = [(i, [float(i % 5), float(i % 3)], i % 2) for i in range(40)] + [(50, None, 0), (51, [0.0, 0.0], None)]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<float>, label int").repartition(3)
    q = df.where("vec_id < 4").withColumnRenamed("vec_id", "query_id")
    want = {}
    for i, v, g in vecs[:4]:
        want[i] = [k for _, k in sorted((sum((a - b) ** 2 for a, b in zip(v, x)), k) for k, x, _ in vecs if x)[:6]]
    for at_once in (100, 3):
        monkeypatch.setattr(dense, "QUERIES_AT_ONCE", at_once)
        got = {}
        for r in dense.nearest(df, q, 6).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert got == want
    same = dense.nearest(df, q, 3, group="label", same=True).collect()
    assert len(same) == 12 and all((r.vec_id - r.query_id) % 2 == 0 for r in same)
    assert dense.nearest(df.limit(0), q, 3).count() == 0 and dense.nearest(df, q.limit(0), 3).count() == 0


def test_neighbours(spark):
    chunks = spark.createDataFrame([(f"c{p}{k}", "f", p) for p in range(1, 5) for k in range(2)] + [("x", None, 1)], "chunk_id string, source_file string, page int")
    hits = spark.createDataFrame([(1, "c10", "f", 1, 0.5, 1), (1, "x", None, 1, 0.2, 2), (2, "c30", "f", 3, 0.9, 1)], "query_id int, chunk_id string, source_file string, page int, similarity double, rank int")
    got = retrieval.with_neighbours(hits, chunks, pages=1, cap=4)
    assert rows(got.where("query_id = 1"), "chunk_id", "similarity") == [("c10", 0.5), ("c11", 0.3), ("c20", 0.3), ("x", 0.2)]
    assert rows(got.where("query_id = 2"), "chunk_id") == [("c20",), ("c21",), ("c30",), ("c31",)]
    assert retrieval.with_neighbours(hits, chunks, cap=1).where("query_id = 1").count() == 2
    assert rows(retrieval.with_neighbours(hits.where("similarity > 0.4 and query_id = 1"), chunks), "similarity")[1] == (0.45,)


def test_expansion(spark):
    terms = spark.createDataFrame([("urn", ["jar"]), ("urn model", ["a", "b", "c", "d"]), ("", ["z"]), (None, ["z"])], "term string, expansions array<string>")
    q = spark.createDataFrame([(1, "an Urn Model here"), (2, "nothing"), (3, None), (1, "an Urn Model here")], "id int, query string")
    got = rows(retrieval.expanded(q, terms).fillna("-", ["expanded", "term"]), "id", "term", "expanded")
    assert got == [(1, "urn model", "an Urn Model here a b c")] * 2 + [(2, "-", "nothing"), (3, "-", "-")]
    assert rows(retrieval.expansion_matches(q.where("id = 1").distinct(), terms, ["id"]), "term", "position") == [("urn", 3), ("urn model", 3)]


def test_verification(spark):
    hits = spark.createDataFrame([(q, f"c{r}", r, (q == 1 and r in (2, 7))) for q in (1, 2) for r in range(1, 8)], "query_id int, chunk_id string, rank int, good boolean")
    got = rows(confidence.verified(hits, F.col("good")), "query_id", "rank", "verified")
    assert got == [(1, 2, True), (1, 6, False), (1, 7, False)]


def test_first_relevant_author(spark):
    hits = spark.createDataFrame([(1, "a1", "A", 0.8, 1, False), (1, "b1", "B", 0.3, 2, False), (1, "b2", "B", None, 3, True), (1, "c1", "C", 0.9, 4, True)], "query_id int, chunk_id string, author string, similarity double, rank int, good boolean")
    authors = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3)], "author string, position int")
    assert rows(confidence.first_relevant_author(hits, authors, F.col("good")), "chunk_id", "similarity") == [("b1", 0.9), ("b2", 0.9)]
    names = spark.createDataFrame([("Ross",), ("Ferrari",), ("Devore",), (None,), ("unknown",)], "author string")
    assert [r.author for r in statistics.priority_authors(names, ["devore", "ferrari"]).orderBy("position").collect()] == ["Devore", "Ferrari", "Ross"]


# --- running values


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_two_levels_equal_one_window(spark, width):
    rng = random.Random(width)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, *range(20)]), k, rng.choice([None, None, 1, 2, 3]), float(rng.randint(0, 15))) for k in range(120)]
    df = spark.createDataFrame(data, "g string, n int, k long, v int, t double")
    key = lambda r: (-1 if r[1] is None else r[1], r[2])
    last, total, emit = {}, {}, {}
    for g in ("a", "b", None):
        seen, s, prev = None, 0, None
        for r in sorted((r for r in data if r[0] == g), key=key):
            total[r[2]] = s
            s += r[3] or 0
            seen = r[3] if r[3] is not None else seen
            last[r[2]] = seen
        for r in sorted((r for r in data if r[0] == g), key=lambda r: (r[4], r[2])):
            prev = r[4] if prev is None else max(r[4], prev + 0.5)
            emit[r[2]] = prev
    assert {r.k: r.v for r in ordered.last_known(df, "g", "n", "k", "v", width).collect()} == last
    assert {r.k: r.before for r in ordered.total_before(df, "g", "n", "k", "v", "before", width).collect()} == total
    assert {r.k: round(r.at, 6) for r in ordered.spaced(df, "g", F.col("t"), "k", 0.5, "at", width).collect()} == emit


# --- state


def _events(spark, times, user=1):
    t0 = datetime(2026, 1, 1)
    return spark.createDataFrame([(k, user, t0 + timedelta(seconds=t)) for k, t in enumerate(times)], "event_id long, user_id long, ts timestamp")


def test_rate_limit(spark):
    got = [r.emit_at for r in state.emit_times(_events(spark, [0, 0.2, 3])).orderBy("event_id").collect()]
    assert [round(x - got[0], 3) for x in got] == [0, 1, 3]


def test_quota(spark):
    got = [r.allowed for r in state.quota(_events(spark, [0, 1, 2, 3, 4, 5, 900, 901]), ["user_id"]).orderBy("event_id").collect()]
    assert got == [True] * 5 + [False, False, True]


def test_cache(spark):
    got = [r.hit for r in state.cache_hits(_events(spark, [0, 3600, 3601, 7000]), ["user_id"]).orderBy("event_id").collect()]
    assert got == [False, True, False, True]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 4000), max_size=40))
def test_quota_equals_loop(spark, times):
    times = sorted(times)
    start, n, want = None, 0, []
    for t in times:
        if start is None or t - start > 900:
            start, n = t, 0
        want.append(n < 5)
        n += want[-1]
    ev = _events(spark, times) if times else _events(spark, [0]).limit(0)
    assert [r.allowed for r in state.quota(ev, ["user_id"]).orderBy("event_id").collect()] == want


def test_history_and_intervals(spark):
    chat = spark.createDataFrame([(1, t, "user" if t % 2 == 0 else " Assistant", f"m{t}" if t != 13 else None) for t in range(14)], "conv_id long, turn int, role string, content string")
    h = state.last_messages(chat, 10).first().history.split("\n")
    assert len(h) == 10 and h[0] == "ASSISTANT: m3" and h[-1] == "USER: m12"
    assert state.last_messages(chat, 1, 2).first().history == "USER: m1..."
    iv = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 9), (1, 8, 12), (1, 2, 3), (1, None, 4)], "k int, s int, e int")
    assert rows(state.merged_intervals(iv, ["k"], "s", "e"), "start", "end", "n") == [(0, 7, 3), (8, 12, 1)]


# --- formulas and models


def test_latex(spark):
    norm = lambda t: one(spark, latex.normalize_latex(F.lit(t)))
    assert norm("* $x$") == "- $x$" and one(spark, latex.normalize_latex(F.lit(None).cast("string"))) == ""
    assert norm("The limit `\\frac{a}{b}` holds") == "The limit $ \\frac{a}{b} $ holds"
    assert norm("`u_n` and `code`") == "$u_n$ and `code`"
    assert norm("\\frac{1}{2} = x") == "$$\n\\frac{1}{2} = x\n$$"
    assert norm("value \\sigma^2 is finite (Ross, page 3)") == "value $ \\sigma^2 $ is finite (Ross, page 3)"
    assert norm("\\(a\\) and \\[b\\]") == "$ a $ and \n$$\nb\n$$"
    assert norm("α here") == "$ \\alpha $  here" and norm("already $\\mu$ done") == "already $\\mu$ done"


def test_latex_leaves_prose_and_long_lines(spark):
    norm = lambda t: one(spark, latex.normalize_latex(F.lit(t)))
    assert norm("so x = \\frac{a}{b} + 1 holds, as \\mu is.") == "so $ x = \\frac{a}{b} + 1 $ holds, as $ \\mu $ is."
    assert norm("$$\n\\mu\n$$ and $\\nu$") == "$$\n\\mu\n$$ and $\\nu$" and norm("no command \\foo here") == "no command \\foo here"
    assert norm("{" * 5000 + "\\frac{a" + "(x+" * 5000)


def test_highlight(spark):
    assert ":orange" in one(spark, latex.highlight(F.lit("x " * 150 + "Some  Text" + " y" * 150), F.lit("some text")))
    assert one(spark, latex.highlight(F.lit("parent"), F.lit("other"))) == "... other ..."


def test_models(spark):
    df = spark.createDataFrame([("random walk",), ("random walk",), (None,)], "t string")
    v = [r.v for r in df.select(models.embedding(F.col("t")).alias("v")).collect()]
    assert v[0] == v[1] and abs(sum(x * x for x in v[0]) - 1) < 1e-6 and not any(v[2])
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError
        return x.upper()

    pauses = []
    assert models.retried(flaky, sleep=pauses.append)("a") == "A" and pauses == [2.0, 4.0]
    assert models.retried(lambda x: 1 / 0, tries=2, sleep=pauses.append)("a") is None


# --- collections, configuration


def test_collection_round_trip(spark, tmp_path):
    path = str(tmp_path / "c")
    with pytest.raises(collections.MissingCollection):
        collections.open_collection(spark, path)
    assert collections.sparse_index(spark, path)[0].count() == 0
    assert collections.open_collection(spark, path, create=True, description="d").count() == 0
    new = spark.createDataFrame([("a", "one two", "f.pdf"), ("a", "one two", "f.pdf"), ("b", None, "g.pdf")], "chunk_id string, text string, source_file string")
    assert sinks.add_chunks(new, path, dry_run=True)["added"] == 0
    assert sinks.add_chunks(new, path) == {"added": 2, "skipped": 1, "errors": 0}
    assert sinks.add_chunks(new, path, index=False) == {"added": 0, "skipped": 3, "errors": 0}
    tf, dl, terms = collections.sparse_index(spark, path)
    assert tf.count() == 2 and terms.count() == 2 and rows(dl, "chunk_id", "dl") == [("a", 2), ("b", 0)]
    assert sinks.add_chunks(spark.createDataFrame([("c", "two three", "f2.pdf"), (None, "no id", "f.pdf")], new.schema), path) == {"added": 1, "skipped": 0, "errors": 1}
    grown = [rows(x) for x in collections.sparse_index(spark, path)]
    sinks.save_sparse_index(spark, path)
    assert grown == [rows(x) for x in collections.sparse_index(spark, path)]
    assert sinks.delete_file(spark, path, "f.pdf") == 1 and collections.open_collection(spark, path).count() == 2
    assert sinks.delete_file(spark, path, "f.pdf") == 0 and rows(collections.sparse_index(spark, path)[1], "chunk_id") == [("b",), ("c",)]
    assert sinks.delete_file(spark, path, "f2.pdf") == 1 and collections.sparse_index(spark, path)[2].count() == 0
    flat = sinks.exported(spark.read.parquet(f"{path}/chunks")).first()
    assert flat.text == "" and flat.chapter == -1 and collections.properties(spark, path).first().description == "d"


def test_extract_pages(spark, tmp_path):
    for name in ("a.pdf", "bad.pdf", "c.txt"):
        (tmp_path / "Books").mkdir(exist_ok=True)
        (tmp_path / "Books" / name).write_bytes(name.encode())

    def parse(path, content):
        if b"bad" in content:
            raise ValueError("broken")
        return [{"text": content.decode(), "page_number": 1}]

    files = collections.find_files(spark, str(tmp_path), content=True)
    pages, errors = collections.extract_pages(files, parse, "text string, page_number int")
    assert rows(pages) == [("a.pdf", 1)] and "broken" in errors.first().error
    assert {r.source_type for r in files.collect()} == {"book"}


def test_quota_state(spark):
    assert one(spark, collections.quota_state(F.lit('{"count": 2, "start_time": 1.5}'))["count"]) == 2
    assert one(spark, sinks.quota_json(F.lit(1), F.lit(2.0))) == '{"count":1,"start_time":2.0}'


def test_config(tmp_path):
    c = config.from_env({"LECTERN_CHUNK_SIZE": "50", "LECTERN_TEMPERATURE": "3", "LECTERN_API_KEY": "k" * 30, "LECTERN_DATA_DIR": str(tmp_path)})
    assert len(c.problems()) == 3 and "kkk" not in repr(c) and c.parent_chars == 400
    assert config.Config().expands() and not config.Config(expand_query=False).expands() and config.placeholder_key("YOUR_KEY")


def test_statistics_of_nothing(spark):
    empty = spark.createDataFrame([], "source_type string, author string, language string, source_file string, source_path string, page int, text string, is_parent boolean")
    assert statistics.count_by_type(empty).count() == 3 and statistics.top_authors(empty).count() == 0 and statistics.chunking_stats(empty).count() == 0
