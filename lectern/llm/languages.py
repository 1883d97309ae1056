"""Problem 2: the language of each page and of each paragraph of a page in several languages.

Evidence is fused by Bayes' rule: the likelihood of the text under character n-gram models, the declared label, a
language code in the address (path or host suffix), and a prior of the source, smoothed towards that of its type and of
the corpus, which grouped aggregation computes from all pages.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.forms import fold_visible
from lectern.llm.tools import small, written

LANGUAGES = ("en", "es", "pt", "fr", "de", "it")
#: Labelled rows used at most for fitting the character models; of each language the same number.
SAMPLE_ROWS = 20_000

# Spellings of labels beside the code, which may carry a region; and those that say nothing.
LABELS = {
    "en": ("en", "eng", "english", "inglés", "ingles"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "it": ("it", "ita", "italian", "italiano"),
    "mixed": ("mixed", "multi", "mul", "multiple", "multilingual"),
}
NO_LABEL = ("", "unknown", "n/a", "na", "und", "none", "null", "-", "?", "zxx", "undetermined")

_WORD = re.compile(r"[^\W\d_]+")
_MATH = re.compile(r"\$\$.*?\$\$|\$[^$\n]*\$|\\\([^)]*\\\)", re.S)
_CUT = re.compile(r"[-‐¬­](?<=[^\W\d_][-‐¬­])­?\n(?=[^\W\d_])")
_STOP = re.compile(r"\s(?<=[.?!…»”\")]\s)\s*(?=[A-ZÀ-ÖØ-Þ¿¡«“„\"(])")
_ENDED = re.compile(r"[.?!…:;,][\"”»)\]“]*\s*$|[.?!…] ?[»“”]\s*$|[-‐¬\u00ad]\s*$")
_SENTENCE_END = re.compile(r"[.?!…][\"”»)\]“]*[^\S\n]*(?:\n|\Z)|[.?!…] ?[»“”]")


def label_code(c: Column) -> Column:
    """Declared label as a code of LANGUAGES or 'mixed'; null if it says nothing; any other text is kept and is wrong."""
    t = F.lower(F.trim(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")))
    base = F.regexp_replace(t, r"^([a-z]{2,3})[-_][a-z0-9]{2,4}$", "$1")
    known = F.create_map(*[F.lit(x) for code, names in LABELS.items() for n in names for x in (n, code)])
    return F.when(c.isNull() | t.isin(*NO_LABEL), F.lit(None).cast("string")).otherwise(F.coalesce(F.try_element_at(known, base), t))


def address_code(c: Column) -> Column:
    """A language code that ends a host or a file name (site.es, notes_fr.pdf, /de/); null if there is none."""
    one = F.regexp_extract(F.lower(c), r"(?:^|[./_-])(" + "|".join(LANGUAGES) + r")(?:/|\.[a-z0-9]{2,5}$|$)", 1)
    return F.nullif(one, F.lit(""))


class NgramModel:
    """Character n-grams (1 to 4, with word ends) of each language; words are scored once and kept."""

    def __init__(self, samples: Sequence[tuple[str, str]], languages: Sequence[str]):
        self.languages = tuple(languages)
        counts = [defaultdict(Counter) for _ in languages]
        for lang, text in samples:
            if lang in self.languages and text:
                for w in words(text):
                    for n, g in _grams(w):
                        counts[self.languages.index(lang)][n][g] += 1
        self.logs: dict[str, np.ndarray] = {}
        for n in (1, 2, 3, 4):
            every = {g for c in counts for g in c[n]}
            totals = [sum(c[n].values()) + 0.5 * len(every) + 1 for c in counts]
            for g in every:
                self.logs[g] = np.array([math.log((c[n][g] + 0.5) / t) for c, t in zip(counts, totals)])
        self.unseen = np.array([math.log(0.5 / (sum(c[4].values()) + 1)) for c in counts]).mean() * np.ones(len(languages))
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, len(languages)), dtype=np.float32)

    def row(self, w: str) -> int:
        k = self.known.get(w)
        if k is None:
            k = self.known[w] = len(self.known)
            if k >= len(self.table):
                self.table = np.concatenate((self.table, np.zeros_like(self.table)))
            gs = [self.logs.get(g, self.unseen) for n, g in _grams(w)]
            v = np.sum(gs, axis=0) / 4
            self.table[k] = np.clip(v - v.max(), -8, 0)
        return k

    def rows(self, ws: list[str]) -> list[int]:
        """Rows of the table for words; they hold until forget() is called."""
        get = self.known.get
        return [r if (r := get(w)) is not None else self.row(w) for w in ws]

    def forget(self) -> None:
        """Drop the kept scores once they are many; a word's score doesn't depend on others."""
        if len(self.known) > 300_000:
            self.known.clear()


def robust_scores(table: np.ndarray, rows: list[int], sentences: list[int], paragraphs: list[int], foreign: float = 0.05) -> np.ndarray:
    """Log likelihoods by paragraph. sentences, paragraphs: where each begins, in rows and in sentences.

    Each sentence is in the paragraph's language, or with a small probability in any other, so that one foreign sentence
    weighs against a language by a bounded amount however long it is.
    """
    own = np.add.reduceat(table[rows].astype(np.float64), sentences, axis=0)
    top = own.max(axis=1, keepdims=True)
    p = np.exp(own - top)
    mixed = np.log((1 - foreign) * p + foreign * p.sum(axis=1, keepdims=True) / p.shape[1])
    return np.add.reduceat(mixed, paragraphs, axis=0)


def with_page(scores: np.ndarray, page: np.ndarray, body: np.ndarray, weight: float = 3.0) -> np.ndarray:
    """Adds the page's prior: its paragraphs together favour one language, which a paragraph leaves on strong evidence only."""
    starts = np.flatnonzero(np.concatenate(([True], page[1:] != page[:-1])))
    total = np.add.reduceat(np.where(body[:, None], scores, 0), starts, axis=0)
    best = np.repeat(total.argmax(axis=1), np.diff(np.append(starts, len(page))))
    out = scores.copy()
    out[np.arange(len(page)), best] += weight
    return out


def _grams(w: str) -> list[tuple[int, str]]:
    t = f"^{w}$"
    return [(n, t[i : i + n]) for n in (1, 2, 3, 4) for i in range(len(t) - n + 1)]


def without_edges(paragraph: str, first: bool, last: bool) -> str:
    """A page's first paragraph without up to four heading lines at its top, its last without up to three at its foot.

    A heading line has no end mark, and what follows it doesn't go on in lower case.
    """
    lines = paragraph.split("\n")
    if first:
        for _ in range(4):
            if len(lines) > 1 and len(lines[0]) < 70 and not _ENDED.search(lines[0]) and not lines[1].lstrip()[:1].islower():
                lines = lines[1:]
    if last:
        for _ in range(3):
            if len(lines) > 1 and len(lines[-1]) < 70 and not _ENDED.search(lines[-1]) and (_ENDED.search(lines[-2]) or not lines[-1].strip()):
                lines = lines[:-1]
    return "\n".join(lines)


def words(text: str) -> list[str]:
    return [w for s in sentence_words(text) for w in s]


def sentence_words(text: str) -> list[list[str]]:
    """Words of each sentence of a paragraph, without formulas; sentences without words are left out."""
    t = text if text.isascii() else fold_visible(text.replace("­\n", "-\n"))
    if "\n" in t:
        t = _CUT.sub("", t)
    return [w for s in _STOP.split(_MATH.sub(" ", t)) if (w := _WORD.findall(s.lower()))]


def sampled(samples: DataFrame, rows: int) -> DataFrame:
    """(lang, text) of at most `rows` labelled rows: of each language the same number at most, chosen by a hash of the text."""
    s = samples.where("lang is not null and text is not null").select("lang", "text")
    n = max(1, s.select("lang").distinct().count())
    order = W.partitionBy("lang").orderBy(F.xxhash64("text"), "text")
    return s.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max(1, rows // n)).drop("_n")


_PARAGRAPH = "struct<para_no:int,n_words:int,n_sent:int,body:boolean,scores:array<double>>"


def page_scores(pages: DataFrame, samples: DataFrame, languages: Sequence[str], least_words: int) -> DataFrame:
    """(key, declared, code, source, kind, paras) of pages (key, text, declared, code, source, kind), a row a page.

    paras has an entry for each paragraph with a word. scores: its log likelihood in each language. body: it reads as
    running text, with least_words words and an end mark at the end of a line, and is not only a heading or page furniture.
    """
    rows = [(r[0], r[1]) for r in sampled(samples, SAMPLE_ROWS).orderBy("lang", "text").collect()]
    model = pages.sparkSession.sparkContext.broadcast((rows, tuple(languages)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = NgramModel(*model.value)
        for b in batches:
            m.forget()
            at, no, n_words, n_sent, body, rows, sent, para = [], [], [], [], [], [], [], []
            ends = [0]
            for i, t in enumerate(b.column(1).to_pylist()):
                ps = t.split("\n\n")
                for k, p in enumerate(ps):
                    ss = sentence_words(without_edges(p, k == 0, k == len(ps) - 1) if k in (0, len(ps) - 1) else p)
                    if not ss:
                        continue
                    at.append(i)
                    no.append(k)
                    n = sum(map(len, ss))
                    n_words.append(n)
                    n_sent.append(len(ss))
                    body.append(n >= least_words and bool(_SENTENCE_END.search(p)))
                    para.append(len(sent))
                    for ws in ss:
                        sent.append(len(rows))
                        rows += m.rows(ws)
                ends.append(len(at))
            scores = with_page(robust_scores(m.table, rows, sent, para), np.array(at), np.array(body)).ravel() if at else []
            offsets = pa.array(np.arange(len(at) + 1) * len(m.languages), pa.int32())
            ints = [pa.array(x, pa.int32()) for x in (no, n_words, n_sent)]
            one = pa.StructArray.from_arrays([*ints, pa.array(body, pa.bool_()), pa.ListArray.from_arrays(offsets, pa.array(scores, pa.float64()))], names=["para_no", "n_words", "n_sent", "body", "scores"])
            paras = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), one)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (0, 2, 3, 4, 5)), paras], names=["key", "declared", "code", "source", "kind", "paras"])

    return pages.mapInArrow(run, f"key bigint, declared string, code string, source string, kind string, paras array<{_PARAGRAPH}>")


def page_languages(
    pages: DataFrame, samples: DataFrame, key: str = "page_id", text: str = "text", label: str = "language", source: str = "source_file", kind: str = "source_type", address: str = "source_path",
    languages: Sequence[str] = LANGUAGES, smoothing: float = 20.0, least_words: int = 6,
) -> DataFrame:
    """(key, lang, confidence, declared, running, paras), a row for each row of pages.

    paras: (para_no, lang, confidence, n_words, n_sent, body) of each paragraph with a word. A page whose running
    paragraphs (body) are in two or more languages is 'mixed'. A page without running text (blank, figures, formulas, too
    short) has running=false and the language that its few words, label, address and source speak for, with the low
    confidence that follows. Null texts count as blank; null labels, sources and addresses give no evidence; null keys
    are kept; repeated rows repeat their result.
    """
    L = len(languages)
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    src = pages.select(F.col(key).cast("bigint").alias("key"), named(text).alias("text"), label_code(F.col(label).cast("string")).alias("declared"), address_code(F.col(address).cast("string")).alias("code"), named(source).alias("source"), named(kind).alias("kind"))
    scored = written(page_scores(src, samples, languages, least_words), "page-scores")
    names = F.array(*map(F.lit, languages))
    best = lambda x: F.element_at(names, F.array_position(x, F.array_max(x)).cast("int"))
    # Host priors: counts of the likeliest languages by source, smoothed towards source type and corpus.
    body = scored.select("source", "kind", F.explode(F.filter("paras", lambda p: p["body"])).alias("p")).select("source", "kind", best(F.col("p.scores")).alias("lang"))
    counts = [F.count(F.when(F.col("lang") == x, 1)).cast("double").alias(x) for x in languages]
    wide = body.groupBy("source", "kind").agg(*counts)
    by_kind = wide.groupBy("kind").agg(*[F.sum(x).alias(f"k_{x}") for x in languages])
    corpus = wide.agg(*[F.coalesce(F.sum(x), F.lit(0.0)).alias(f"c_{x}") for x in languages])
    total = lambda pre: sum((F.coalesce(F.col(f"{pre}{x}"), F.lit(0.0)) for x in languages), F.lit(0.0))
    # Sources of which no page has running text take the prior of their type, or of the corpus.
    every = scored.select("source", "kind").distinct()
    pri = every.join(wide, ["source", "kind"], "left").join(by_kind, "kind", "left").crossJoin(F.broadcast(corpus))  # one row
    for x in languages:
        c = (F.col(f"c_{x}") + 1) / (total("c_") + L)
        k = (F.coalesce(F.col(f"k_{x}"), F.lit(0.0)) + smoothing * c) / (total("k_") + smoothing)
        pri = pri.withColumn(f"p_{x}", (F.coalesce(F.col(x), F.lit(0.0)) + smoothing * k) / (total("") + smoothing))
    pri = written(pri.select("source", "kind", F.array(*[F.log(f"p_{x}") for x in languages]).alias("prior")), "page-priors")
    # A right label is seen in most cases, a code in the address in many.
    evidence = F.array(*[F.when(F.col("declared") == x, F.lit(math.log(8.0))).otherwise(0.0) + F.when(F.col("code") == x, F.lit(math.log(4.0))).otherwise(0.0) for x in languages])
    rows = scored.join(small(pri), ["source", "kind"]).withColumn("known", F.zip_with("prior", evidence, lambda a, b: a + b))
    sure = lambda lp: 1 / F.aggregate(lp, F.lit(0.0), lambda s, v: s + F.exp(F.greatest(v - F.array_max(lp), F.lit(-700.0))))
    lp = F.transform("paras", lambda p: F.struct(p["para_no"].alias("para_no"), F.zip_with(p["scores"], "known", lambda a, b: a + b).alias("lp"), p["n_words"].alias("n_words"), p["n_sent"].alias("n_sent"), p["body"].alias("body")))
    rows = rows.select("key", "declared", "known", lp.alias("lps"))
    paras = F.transform("lps", lambda p: F.struct(p["para_no"].alias("para_no"), best(p["lp"]).alias("lang"), sure(p["lp"]).alias("confidence"), p["n_words"].alias("n_words"), p["n_sent"].alias("n_sent"), p["body"].alias("body")))
    rows = rows.withColumn("paras", paras).withColumn("bodies", F.filter("paras", lambda p: p["body"]))
    # Without running text the few words count together.
    few = F.aggregate("lps", F.col("known"), lambda s, p: F.zip_with(s, F.zip_with(p["lp"], "known", lambda a, b: a - b), lambda a, b: a + b))
    rows = rows.withColumn("few", few)
    running = F.size("bodies") > 0
    langs = F.array_distinct(F.transform("bodies", lambda p: p["lang"]))
    weights = F.aggregate("bodies", F.lit(0.0), lambda s, p: s + p["n_words"])
    mean = F.aggregate("bodies", F.lit(0.0), lambda s, p: s + p["confidence"] * p["n_words"]) / weights
    lang = F.when(~running, best(F.col("few"))).when(F.size(langs) > 1, "mixed").otherwise(F.element_at(langs, 1))
    return rows.select("key", lang.alias("lang"), F.when(running, mean).otherwise(sure(F.col("few"))).alias("confidence"), "declared", running.alias("running"), "paras")


def paragraph_languages(page: DataFrame) -> DataFrame:
    """(key, para_no, lang, confidence, running) of every paragraph with a word of the mixed pages of page_languages()."""
    return page.where("lang = 'mixed'").select("key", F.explode("paras").alias("p")).select("key", "p.para_no", "p.lang", "p.confidence", F.col("p.body").alias("running"))


def found(pages: DataFrame, samples: DataFrame) -> DataFrame:
    """(page_id, para_no, lang): right labels of pages whose own is missing or wrong, and running paragraphs of mixed pages."""
    page = page_languages(pages, samples).where("running and key is not null")
    one = lambda no, lang: F.struct(no.cast("int").alias("para_no"), lang.alias("lang"))
    whole = F.when(F.col("declared").isNull() | (F.col("declared") != F.col("lang")), F.array(one(F.lit(-1), F.col("lang"))))
    parts = F.when(F.col("lang") == "mixed", F.transform(F.filter("paras", lambda p: p["body"]), lambda p: one(p["para_no"], p["lang"])))
    none = F.array().cast("array<struct<para_no:int,lang:string>>")
    return page.select(F.col("key").alias("page_id"), F.explode(F.concat(F.coalesce(whole, none), F.coalesce(parts, none))).alias("f")).select("page_id", "f.para_no", "f.lang")
