"""Small cases of the text operators: nulls, empty and long texts, ties, repeats, empty tables, clashing columns; and brute force."""

import itertools
import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import forms, furniture, languages, leaks, mixture, scans, sentences, splitting


def rows(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


# --- 1


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n?é字", max_size=400), st.integers(8, 60), st.integers(0, 7))
def test_pieces_cover_and_overlap(text, limit, overlap):
    out = splitting.pieces(text, limit, overlap)
    assert all(e - s <= limit for s, e in out)
    if text:
        assert out[0][0] == 0 and out[-1][1] == len(text)
    for (_, e), (s, _) in zip(out, out[1:]):
        assert s == max(0, e - overlap)


def test_pieces_end_at_the_highest_boundary():
    text = "One two three. Four five six.\n\nSeven eight nine ten. Eleven twelve."
    ends = [text[s:e] for s, e in splitting.pieces(text, 40, 5)]
    assert ends[0].endswith("six.\n\n")


def test_split_oversized_edges(spark):
    long = ("word " * 5000).strip()
    df = spark.createDataFrame([(1, None, False, 9), (2, "", None, 9), (3, "x" * 3000, None, 9), (3, "x" * 3000, None, 9), (4, "x" * 3000, True, 9), (5, long, False, 9)], "chunk_key bigint, text string, is_parent boolean, piece_no int")
    out = splitting.split_oversized(df, "chunk_key", limit=splitting.chunk_limit())
    got = rows(out.groupBy("key").agg(F.count("*").alias("n"), F.max(F.length("piece")).alias("longest")))
    assert [g[0] for g in got] == [3, 5] and got[0][1] == 4 and all(g[2] <= 2500 for g in got)
    assert splitting.split_oversized(df.limit(0), "chunk_key").count() == 0


def test_located_pieces(spark):
    page = "Intro.\n\n" + " ".join(f"Sentence number {i} of the page." for i in range(200))
    chunk = page[8:]
    pages = spark.createDataFrame([("f", 1, page), ("f", 1, page), ("f", 2, None)], "source_file string, page_number int, text string")
    chunks = spark.createDataFrame([(1, chunk, False, "f", 1, 8), (2, chunk, False, "f", 1, 0), (3, chunk, False, "f", 7, None)], "chunk_key bigint, text string, is_parent boolean, source_file string, page int, start_char int")
    for r in splitting.located_pieces(chunks, pages).collect():
        assert r.located == (r.chunk_key < 3)
        if r.located:
            assert page[r.start_char : r.end_char] == r.text


def test_pieces_prefer_paragraphs_to_fullness():
    text = ("One two three. " * 4).strip() + "\n\n" + ("Four five six. " * 30).strip()
    assert splitting.pieces(text, 90, 5)[0] == (0, text.index("Four"))


def test_pieces_are_seen_in_other_spelling(spark):
    page = "Intro.\n\n" + "\n".join(f"Sentence number {i} of the p\u00e1ge." for i in range(200))
    other = page[8:].replace("\n", "  ").replace("\u00e1", "a\u0301").replace("Sentence", "Sеntence\u200b")
    children = page[8:2000].strip() + "\n\n" + page[2200:6000].strip()
    chunks = spark.createDataFrame([(1, other, False, "f", 1, 0), (2, children, True, "f", 1, 0), (3, "zz " * 1000, False, "f", 1, 7)], "chunk_key bigint, text string, is_parent boolean, source_file string, page int, start_char int")
    pages = spark.createDataFrame([("f", 1, page)], "source_file string, page_number int, text string")
    bare = lambda t: "".join(forms.visual_form(t).split())
    got = splitting.located_pieces(chunks, pages).collect()
    assert {r.chunk_key for r in got} == {1, 2, 3}
    for r in got:
        assert r.located == (r.chunk_key < 3)
        if r.chunk_key == 1:
            assert bare(page[r.start_char : r.end_char]) == bare(r.text)
        if r.chunk_key == 2 and r.piece_no == 0:
            assert page[r.start_char : r.end_char] == page[8:2000] + page[2000 : r.end_char]


# --- 2


def _samples(spark):
    text = {"en": ["the random walk stays below the bound", "every fair coin depends only on the first draw"], "es": ["el paseo al azar permanece por debajo de la cota", "toda moneda depende solo de la primera extracción"], "de": ["die zufällige Irrfahrt bleibt unter der Schranke", "jede faire Münze hängt nur von der ersten Ziehung ab"]}
    return spark.createDataFrame([(x, t) for x, ts in text.items() for t in ts], "lang string, text string")


def test_page_languages(spark):
    en = "The random walk stays below the bound. Every coin depends only on the first draw. The walk stays."
    es = "El paseo permanece por debajo de la cota. Toda moneda depende de la primera extracción. El paseo al azar."
    cases = [(1, en, "en"), (2, es, "en-GB"), (3, en + "\n\n" + es, "en"), (4, "", None), (5, None, None), (6, "$$ a + b $$", None), (7, en, None), (8, es, "Spanish"), (9, en + " Toda moneda depende de la cota. " + en, "English"), (2, es, "en-GB")]
    pages = spark.createDataFrame([(i, t, lb, "f", "book", None, 3) for i, t, lb in cases], "page_id bigint, text string, language string, source_file string, source_type string, source_path string, key int")
    got = rows(languages.found(pages.drop("key"), _samples(spark)).distinct())
    assert got == [(2, -1, "es"), (3, -1, "mixed"), (3, 0, "en"), (3, 1, "es"), (7, -1, "en")]
    page = languages.page_languages(pages.drop("key"), _samples(spark))
    every = {r.key: r for r in page.collect()}
    assert page.count() == len(cases) and not every[4].running and every[4].lang and every[4].confidence < every[1].confidence
    assert rows(languages.paragraph_languages(page), "key", "para_no", "lang", "running") == [(3, 0, "en", True), (3, 1, "es", True)]
    assert languages.page_languages(pages.limit(0), _samples(spark)).count() == 0
    assert languages.sampled(_samples(spark), 3).groupBy("lang").count().where("count = 1").count() == 3


def test_label_codes(spark):
    df = spark.createDataFrame([(x,) for x in ("en-US", "EN ", "español", "n/a", "", None, "klingon", "pt_BR")], "l string")
    assert [r[0] for r in df.select(languages.label_code(F.col("l"))).collect()] == ["en", "en", "es", None, None, None, "klingon", "pt"]


# --- 3


def test_lookalike_pairs(spark):
    texts = ["Plain x² text", "Plаin x² text", "Plain  x² te​xt", "plain x² text", "Plain x2 text", "Ｐlain x² text", None, "", "​", " ", "Plain x² text", "café", "café", "cafe"]
    df = spark.createDataFrame(list(enumerate(texts)), "page_id bigint, text string")
    got = {(r.key_a, r.key_b) for r in forms.lookalike_pairs([("t", df, "page_id")]).collect()}
    same = [0, 1, 2, 5, 10]
    want = {(a, b) for a, b in itertools.combinations(same, 2) if texts[a] != texts[b]} | {(11, 12)}
    assert got == want
    assert forms.lookalike_pairs([("t", df.limit(0), "page_id")]).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_forms_are_stable(text):
    assert forms.visual_form(forms.visual_form(text)) == forms.visual_form(text)
    assert forms.comparison_form(forms.comparison_form(text)) == forms.comparison_form(text)
    assert unicodedata.is_normalized("NFC", forms.visual_form(text))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("ÅKΩ가क़ே豈їё\u0308\u0301\u200d")), max_size=40))
def test_canonically_equal_texts_look_the_same(text):
    for f in ("NFC", "NFD"):
        assert forms.visual_form(unicodedata.normalize(f, text)) == forms.visual_form(text)


def test_lookalike_classes_state_the_pairs(spark):
    df = spark.createDataFrame([(5, "a b"), (2, "a  b"), (9, "a b"), (7, "a  b"), (1, "c"), (3, None), (2, "a  b")], "page_id bigint, text string")
    assert rows(forms.lookalike_classes([("t", df, "page_id")])) == [("t", 2, 2, 2), ("t", 5, 2, 5), ("t", 7, 2, 2), ("t", 9, 2, 5)]
    assert rows(forms.lookalike_pairs([("t", df, "page_id")])) == [("t", 2, 5), ("t", 2, 9), ("t", 5, 7), ("t", 7, 9)]


def test_normalised_keeps_rows(spark):
    df = spark.createDataFrame([(1, "ＡＢ"), (1, "ＡＢ"), (2, None), (3, "")], "key bigint, text string")
    assert [r.norm_text for r in forms.normalised(df, "key").orderBy("key").collect()] == ["ab", "ab", None, ""]


def test_both_tables_have_a_form_that_keeps_apart_what_differs(spark, tmp_path):
    from lectern.llm import queries

    texts = ["Plаin x²", "Plain  x²", "plain x²", "Plain x2", None, ""]
    for name, key in (("extracted_pages", "page_id"), ("text_chunks", "chunk_key")):
        spark.createDataFrame(list(enumerate(texts)), f"{key} bigint, text string").write.parquet(f"{tmp_path}/{name}.parquet")
    got = rows(queries.queries()["p3_normalised"](spark, str(tmp_path)))
    want = [("Plain x²", "plain x2"), ("Plain x²", "plain x2"), ("plain x²", "plain x2"), ("Plain x2", "plain x2"), (None, None), ("", "")]
    assert got == [(tbl, k, *w) for tbl in ("extracted_pages", "text_chunks") for k, w in enumerate(want)]


# --- 4


def test_furniture(spark):
    pages = []
    for n in range(1, 41):
        head = "A course on chance" if n % 2 else "A c0urse on chancc"
        foot = "All rights reserved here" if n <= 5 else ["Under the bridge", "Quite another ending", "Some words at last", "Nothing to be seen", "Mountain and valley", "Kitchen garden plan", "Zebras cross slowly"][n % 7] + f" {n}"
        pages.append((n, f"{head}   {n}\nbody line {'xyzw'[n % 4] * (n + 3)} text\n{n}\n{foot}", n, "f"))
    pages += [(100, "A course on chance", None, "f"), (101, None, 1, "f"), (102, "A course on chance", 1, None), (103, "A course on chance   1", 1, "g")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id bigint, text string, page_number int, source_file string, line int")
    per, found = furniture.furniture_lines(df)
    assert {(r.key, r.line_no) for r in found.collect()} == {(n, 0) for n in range(1, 41)}
    assert [r.n_pages for r in per.collect()] == [40]
    clean = {r.page_id: r.clean_text for r in furniture.without_lines(df, found).collect()}
    assert len(clean) == len(pages) and clean[1].startswith("body line") and clean[101] is None and clean[100] == "A course on chance"
    per, found = furniture.furniture_lines(df.limit(0))
    assert found.count() == 0


def test_line_keys_agree_with_single_lines():
    text = "Линия номер один 3\nA c0urse, vol. 5\nμ σ ab\n12\n\nSO8RE EL AZAR\nla clensidad   44"
    assert furniture.line_keys(text) == [furniture.line_key(x) for x in text.split("\n")]


# --- 5


def test_scan_lines(spark):
    word = "the density of the random variable converges to the bound and the martingale stays"
    body = "\n".join([word] * 3)
    pages = [(n, f"A course on chance   {n}\n{body}\n- {n} -", n) for n in range(1, 8)]
    pages += [(50, "Chapter 2. Urns\nthe clensity of the ran-\ndom variable c0nverges\n· l2 ·", 12), (51, None, 1), (52, "", 2), (53, "see page 3 of the\nbook", None), (50, "Chapter 2. Urns\nthe clensity of the ran-\ndom variable c0nverges\n· l2 ·", 12)]
    pages += [(60 + n, f"{body}\n{n}", n + 4) for n in range(1, 6)] + [(70, f"{body}\n23", 25)]
    df = spark.createDataFrame([(*p, "x", "g.pdf" if 60 < p[0] < 70 else None if p[0] == 51 else "f.pdf") for p in pages], "page_id bigint, text string, page_number int, kind string, source_file string")
    got = set(rows(scans.scan_lines(df)))
    assert {g for g in got if g[0] == 50} == {(50, 0, "header"), (50, 1, "misread"), (50, 1, "hyphen"), (50, 2, "misread"), (50, 3, "page_no"), (50, 3, "misread")}
    assert {g for g in got if g[0] == 3} == {(3, 0, "header"), (3, 4, "page_no")}
    assert {g for g in got if g[0] > 60} == {(60 + n, 3, "page_no") for n in range(1, 6)}
    paragraphs = {r.paragraph for r in scans.scan_paragraphs(df).where("page_id = 50").collect()}
    assert paragraphs == {"the density of the random variable converges"}
    assert scans.scan_lines(df.limit(0)).count() == 0


def test_decoder_joins_and_parts():
    d = scans.Decoder({"random": 500, "walk": 500, "variable": 400, "the": 9000})
    assert d.joined("randomwalk") == ("random", "walk") and d.joined("random") is None
    assert d.parted("vari", "able") == "variable" and d.parted("the", "walk") is None


def test_stretches_are_read_whole():
    d = scans.Decoder({"the": 9000, "set": 3000, "of": 9000, "random": 500, "variable": 400, "well-known": 30, "well": 300, "known": 300, "distance": 200})
    read = lambda t: scans.paragraphs(t, 1, None, d, frozenset())
    kinds = lambda t: scans.line_kinds(t, 1, None, d, frozenset())
    assert read("the tbeset of") == ["the the set of"] and kinds("of\nthe tbeset of") == [(1, "misread")]
    assert read("the vari ab1e of") == ["the variable of"] and kinds("the vari ab1e of") == [(0, "misread")]
    assert read("the Well-\nknown set") == ["the Well-known set"] and kinds("the well-\nknown set") == []
    assert read("the ran-\nd0m set") == ["the random set"] and kinds("the ran-\nd0m set") == [(0, "hyphen"), (1, "misread")]
    assert read("the qwx-\nzzk set") == ["the qwxzzk set"] and kinds("the qwx-\nzzk set") == [(0, "hyphen")]
    assert read("the $x$ ran dom $vari$ able") == ["the $x$ random $vari$ able"]


def test_no_limits_on_confusions_and_lengths():
    d = scans.Decoder({"theorem": 500_000, "the": 9_000_000, "supercalifragilisticexpialidociousness": 50_000, "of": 9_000_000, "zap": 40_000}, confusions=scans.CONFUSIONS | {"q": ("z",)})
    kinds = lambda t: scans.line_kinds(t, 7, None, d, {scans.title_key("the of " * 40)})
    assert kinds("of\nthe thcorcrn of") == [(1, "misread")]
    assert kinds("the qap of") == [(0, "misread")]
    assert kinds("supercalifragilisticexpialidociousnesstheorem of") == []
    assert scans.paragraphs("supercalifragilisticexpialidociousnesstheorem of", 1, None, d, ()) == ["supercalifragilisticexpialidociousness theorem of"]
    assert kinds("the of " * 40 + "\nof") == [(0, "header")]
    long = "\n".join(["the theorem of"] * 3000)
    assert len(scans.paragraphs(long, 1, None, d, ())) == 1


def test_rare_words_stay_at_any_size(spark):
    """Four million words more change nothing for a word seen three times."""
    texts = [(n, "the bail of the case stays") for n in range(1, 61)] + [(n, "one ball of the case stays") for n in range(61, 64)]
    df = spark.createDataFrame([(n, t, n, "f.pdf") for n, t in texts], "page_id bigint, text string, page_number int, source_file string")
    more = spark.range(100, 140).select(F.col("id").alias("page_id"), F.expr("repeat('the ', 100000)").alias("text"), F.col("id").cast("int").alias("page_number"), F.lit("f.pdf").alias("source_file"))
    assert scans.scan_lines(df).count() == scans.scan_lines(df.unionByName(more)).count() == 0


# --- 6


def test_leaks_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(8, 40)))) for i in range(12)] + [(99, None), (98, "")]
    docs = []
    for i in range(120):
        w = rng.choices(vocabulary + ["other"], k=rng.randint(0, 60))
        if i % 3 == 0:
            src = items[rng.randrange(12)][1].split()
            k = rng.randrange(max(1, len(src) - 11))
            w[5:5] = src[k : k + rng.randint(10, 16)]
        docs.append((i, " ".join(x.upper() if rng.random() < 0.2 else x for x in w)))
    docs += [(500, None), (501, ""), (0, docs[0][1])]
    D = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, item_id string")
    I = spark.createDataFrame(items, "item_id bigint, text string")
    grams = {}
    for i, t in items:
        w = (t or "").split()
        for k in range(len(w) - 11):
            grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    want = {(d, i) for d, t in docs if t for w in [t.lower().split()] for k in range(len(w) - 11) for i in grams.get(tuple(w[k : k + 12]), ())}
    for shard, at_once in ((10**6, 100), (50, 5)):
        got = leaks.leaked(D, I, shard_words=shard, at_once=at_once)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    assert leaks.leaked(D.limit(0), I).count() == 0 and leaks.leaked(D, I.limit(0)).count() == 0


def test_leaks_see_through_disguise(spark):
    item = "the keeper of the mill mixes ten tin badges with nine glass beads today"
    doc = "Now: The Kееper of the mill [3] mixes ten tin bad-\nges, with ni​ne ｇlass beads today!"
    D = spark.createDataFrame([(1, doc)], "doc_id bigint, text string")
    r = leaks.leaked(D, spark.createDataFrame([(7, item)], "item_id bigint, text string")).collect()
    assert [(x.doc_id, x.item_id) for x in r] == [(1, 7)] and doc[r[0].start_char : r[0].end_char] == doc[5:-1]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aé1-,. \n[]³­​éﬁΑ", max_size=40))
def test_word_spans_match_words(text):
    assert len(leaks.word_spans(text)) == len(leaks.words(text))


def test_wavelet_rank():
    seq = np.array([3, 0, 2, 3, 3, 1, 0, 2])
    t = leaks.WaveletTree(seq, 2)
    for s in range(4):
        for p in range(len(seq) + 1):
            assert t.rank(np.array([s]), np.array([p]))[0] == (seq[:p] == s).sum()


# --- 7


def test_mixture(spark):
    docs = [(i, "word " * (i % 7 + 1), ["Big Source", "big-source", "small", None, "other"][i % 5]) for i in range(200)] + [(900, None, "small"), (901, "", "small")]
    D = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, source string, size int").drop("size")
    T = spark.createDataFrame([("big_source", 1, 3), ("small", 3, 2), ("none", 1, 5)], "source string, weight int, max_repeats int")
    D = mixture.with_quality(D.withColumn("size", mixture.quarter_chars()), *D.columns, "size")
    mix, report = mixture.mixture(D, T)
    got = mix.collect()
    limit = {"big_source": 3, "small": 2}
    assert all(1 <= r.repeats <= limit[r.source] for r in got) and len({r.doc_id for r in got}) == len(got)
    rep = {r.source: r for r in report.collect()}
    size = {s: sum(len(t or "") // 4 for _, t, x in docs if x and x.lower().replace(" ", "_").replace("-", "_") == s) for s in limit}
    total = sum(size.values())
    assert {s for s, r in rep.items() if r.below_target} == {s for s, w, m in (("big_source", 1, 3), ("small", 3, 2), ("none", 1, 5)) if size.get(s, 0) * m < w / 5 * total}
    assert all(r.used <= r.budget + 1e-6 for r in rep.values()) and abs(sum(r.actual_share for r in rep.values()) - 1) < 1e-9
    again, _ = mixture.mixture(D, T, buckets=1)
    assert rows(again) == rows(mix)  # buckets don't change what is chosen
    mix, report = mixture.mixture(D.limit(0), T)
    assert mix.count() == 0 and report.count() == 3
    twice, _ = mixture.mixture(D.where("source = 'small'").unionByName(D.where("source = 'small'")), T)
    assert twice.groupBy("doc_id").count().agg(F.max("count")).first()[0] == 2
    sized = rows(mixture.with_tokens(D, "doc_id").where("doc_id in (0, 6, 900, 901)"))
    assert sized == [(0, 2), (6, 8), (900, 0), (901, 0)]


def test_quality_tells_damage_and_repetition(spark):
    good = [(i, f"the walk {'abcdefghij'[i % 10]} stays below the bound of the chain number {i}", "x") for i in range(200)]
    odd = [(900, "qz#7 jx~~ vk%% wq@9 zj$$ kx&&", "x"), (901, "the walk " * 40, "x"), (902, None, "x"), (903, "", "x"), (904, "ab", "x")]
    D = spark.createDataFrame(good + odd, "doc_id bigint, text string, quality string")
    q = {r.doc_id: r.quality for r in mixture.with_quality(D, "doc_id").collect()}
    assert len(q) == 205 and all(0.05 <= v <= 1 for v in q.values())
    assert q[900] < q[1] / 2 and q[901] < q[1] / 2 and q[902] == q[903] == q[904] == 0.05
    assert mixture.with_quality(D.limit(0), "doc_id").count() == 0


# --- 8

_MODEL = sentences.Model(frozenset(["Fig", "Dr", "etc", "cf", "p"]), frozenset(["The", "It", "In"]), frozenset(["Ardelan"]))


@pytest.mark.parametrize(
    "text, want",
    [
        ("The bound is 0.5. It holds.", ["The bound is 0.5.", "It holds."]),
        ("See Fig. 3 on p. 4. Dr. N. P. Ardelan agrees.", ["See Fig. 3 on p. 4.", "Dr. N. P. Ardelan agrees."]),
        ("It converges a.s. The limit is X. In all.", ["It converges a.s.", "The limit is X.", "In all."]),
        ('He wrote: "It is. It was." The end.', ['He wrote: "It is. It was."', "The end."]),
        ('"Is it finite?" asked Ardelan.', ['"Is it finite?" asked Ardelan.']),
        ("Heading\n \nBody one\ntwo. (A case.) Last", ["Heading", "Body one\ntwo.", "(A case.)", "Last"]),
        ("1) First item.\n2) Second item.\n3. Third.", ["1) First item.", "2) Second item.", "3. Third."]),
        ("和是有限的。它有12项。老师说：“好。再见。”完", ["和是有限的。", "它有12项。", "老师说：“好。再见。”", "完"]),
        ("“有限吗？”学生问道。", ["“有限吗？”学生问道。"]),
        ("先生は「有限である。」と述べた。次。", ["先生は「有限である。」と述べた。", "次。"]),
        ("योग परिमित है। डॉ. मेल्वारी ने पाया।", ["योग परिमित है।", "डॉ. मेल्वारी ने पाया।"]),
        ("ในกรณีนี้ค่า12 ดูรูปที่5.11 จบ", ["ในกรณีนี้ค่า12", "ดูรูปที่5.11", "จบ"]),
        ("هل هو منته؟ نعم.", ["هل هو منته؟", "نعم."]),
        ("La somme est finie ? Oui. « Elle est. » Fin.", ["La somme est finie ?", "Oui.", "« Elle est. »", "Fin."]),
        ("The bound is 0.5.The sum of σ.A walk stays.It ends at X.So it is.", ["The bound is 0.5.", "The sum of σ.", "A walk stays.", "It ends at X.", "So it is."]),
        ("الزيادات مستقلة.في هذه", ["الزيادات مستقلة.", "في هذه"]),
        ("See N.P. Ardelan and example.Com for e.g. this.", ["See N.P. Ardelan and example.", "Com for e.g. this."]),
        ("ก\n 1", ["ก\n 1"]),
        ("", []), (" \n\n ", []), ("...", ["..."]),
    ],
)
def test_sentences(text, want):
    assert [text[s:e] for s, e in sentences.spans(text, _MODEL)] == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB .!?\n\"()«»…。ก1字", max_size=80))
def test_units_are_ordered_and_cover(text):
    out = sentences.spans(text, _MODEL)
    assert all(a < b for a, b in out) and all(x[1] <= y[0] for x, y in zip(out, out[1:]))
    inside = set(itertools.chain.from_iterable(range(a, b) for a, b in out))
    assert all(i in inside for i, ch in enumerate(text) if not ch.isspace())
    assert all(not text[a].isspace() and not text[b - 1].isspace() for a, b in out)


def test_sentence_units(spark):
    df = spark.createDataFrame([(1, "One is here. Two is there.", "x"), (2, None, "x"), (3, "", "x"), (1, "One is here. Two is there.", "x"), (4, "word " * 50_000, "x")], "doc_id bigint, text string, unit string")
    got = rows(sentences.sentence_units(df), "doc_id", "start_char", "end_char")
    assert got == [(1, 0, 12), (1, 0, 12), (1, 13, 26), (1, 13, 26), (4, 0, 249_999)]
    assert sentences.sentence_units(df.limit(0)).count() == 0


def test_the_document_comes_before_the_corpus():
    cut = lambda t, m: [t[a:b] for a, b in sentences.spans(t, m)]
    corpus = sentences.Model(frozenset(["sol", "cap"]), frozenset(), frozenset())
    assert cut("El sol brilla. Vemos el sol. 3 casas hay. Luego el sol canta.", corpus) == ["El sol brilla.", "Vemos el sol.", "3 casas hay.", "Luego el sol canta."]
    assert cut("See Propos. 3 here. By Propos. 4 it holds.", corpus) == ["See Propos. 3 here.", "By Propos. 4 it holds."]
    assert cut("Read cap. 3 now.", corpus) == ["Read cap. 3 now."] and cut("It ends. 3 more follow.", corpus) == ["It ends.", "3 more follow."]
    assert cut("He left (see the long list of the names). Then he came. (in part, cap. 3.) So", corpus) == ["He left (see the long list of the names).", "Then he came.", "(in part, cap. 3.)", "So"]


def test_long_runs_without_blanks_take_linear_time():
    for t in ("A." * 20_000, "A. " * 20_000, "(" * 20_000 + "a. B", "1. " * 20_000, "ก " + "$ " * 20_001, "ก ข " * 10_000):
        assert sentences.spans(t, _MODEL)


def test_one_shortened_document_leaves_titles(spark):
    texts = [f"We met Dr. Ardelan {'again ' * (i % 5)}there. It rained. All went home.\n\nThe rest was calm." for i in range(400)]
    last = "She knows Dr. Melvari well."
    for more in ([], ["Then came Dr."]):
        df = spark.createDataFrame([(i, t) for i, t in enumerate([last, *texts, *more])], "doc_id bigint, text string")
        assert rows(sentences.sentence_units(df).where("doc_id = 0"), "unit") == [(last,)]


def test_line_keys_ignore_kinds_of_blanks_and_confusions():
    assert furniture.line_key("Send corrections to room 9") == furniture.line_key("Send corrections to room 12")
    for a, b in (("curso nocturno", "curso nocturrio"), ("alumnos inscritos", "aliimnos inscrifos"), ("Chapter 2. Order", "Chaptcr 7. 0rcler"), ("función", "funci6n"), ("the share", "tbe sbare"), ("EXERCISE", "FXERCI5E")):
        assert furniture.line_key(a) == furniture.line_key(b)
    assert furniture.line_key("limitam ρ") != furniture.line_key("limitam ν")


def test_short_furniture_with_other_letters_misread(spark):
    heads = ["Kurs Zwei"] * 5 + ["Kurs Zwoi", "Kuxs Zwei", "Kuxs Zwoi"]
    pages = [(n, f"{h}\nLine with the words {'abcdefgh'[n] * 9} only", n, "f") for n, h in enumerate(heads)]
    pages += [(20 + n, h, n, "g") for n, h in enumerate(["Big 6ook of sums", "Big book of sums"] * 3)]
    df = spark.createDataFrame(pages, "page_id bigint, text string, page_number int, source_file string")
    _, found = furniture.furniture_lines(df)
    assert {(r.key, r.line_no) for r in found.collect()} == {(n, 0) for n in range(8)} | {(20 + n, 0) for n in range(6)}
