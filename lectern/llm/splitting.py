"""Problem 1: split oversized texts at natural boundaries, with an overlap.

A hierarchy of separators (section, paragraph, sentence, word, character) cuts a text recursively until each part fits;
parts are then packed greedily to the limit. A piece ends at the last boundary of the highest level within its second
half. Each piece but the first begins exactly `overlap` characters before the end of the one before it, wherever that is.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.forms import fold_visible, ignorable

#: Characters of a piece's beginning and end that are looked for where its whole isn't found.
ENDS = 60
#: Limits in characters: of a chunk, of a parent, and of the overlap.
CHUNK_LIMIT, PARENT_LIMIT, OVERLAP = 2_500, 5_000, 500

# Words that open a section or a statement, in the corpus' languages.
_OPENERS = r"chapter|section|theorem|lemma|proposition|corollary|definition|exercise|example|proof|cap[íi]tulo|secci[óo]n|teorema|lema|proposici[óo]n|corolario|definici[óo]n|ejercicio|ejemplo|demostraci[óo]n|chapitre|th[ée]or[èe]me|exercice|kapitel|satz|aufgabe|capitolo|esercizio|exerc[íi]cio"
#: Where a part may end, level by level; a match's end is the place.
LEVELS = (
    re.compile(rf"\n\s*\n(?=(?:{_OPENERS})\b)|\f", re.I),
    re.compile(r"\n\s*\n+"),
    re.compile(r"(?<![\s.]\w)(?<!\b[A-Z][a-z])(?:[.!?…](?:[\"”»)\]]|\s»)*\s+(?=[^\W\d_a-zà-ÿ]|[¿¡«\"“„(\[$\\])|[。！？।॥؟](?:[”」』）\"]*)\s*)"),
    re.compile(r"\s+"),
)


def _parts(text: str, a: int, b: int, cap: int, level: int, ends_at: int) -> Iterator[tuple[int, int]]:
    """(end, level of the boundary there) of the parts of text[a:b], each at most cap long; ends_at is the level of b."""
    if b - a <= cap:
        yield b, ends_at
        return
    if level == len(LEVELS):
        for e in range(a + cap, b, cap):
            yield e, level
        yield b, ends_at
        return
    for m in LEVELS[level].finditer(text, a, b):
        if a < m.end() < b:
            yield from _parts(text, a, m.end(), cap, level + 1, level)
            a = m.end()
    yield from _parts(text, a, b, cap, level + 1, ends_at)


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """[start, end) of each piece; a text within the limit is one piece, an empty one none."""
    if len(text) <= limit:
        return [(0, len(text))] if text else []
    out, start = [], 0
    ends: list[tuple[int, int]] = []  # boundaries after the last cut, within reach of start
    for e in _parts(text, 0, len(text), limit - overlap, 0, -1):
        while ends and e[0] - start > limit:
            half = [x for x in ends if x[0] - start > max(limit // 2, overlap)] or ends[-1:]
            highest = min(level for _, level in half)
            cut = max(end for end, level in half if level == highest)
            out.append((start, cut))
            start = max(0, cut - overlap)
            ends = [x for x in ends if x[0] > cut]
        ends.append(e)
    out.append((start, len(text)))
    return out


def split_oversized(items: DataFrame, key: str, text: str = "text", limit: Column | int = CHUNK_LIMIT, overlap: int = OVERLAP, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, piece_no, piece_start, piece_end, piece, *carry) of every item longer than its limit.

    Positions are in the item's text: piece = text[piece_start:piece_end]. The filter on length runs before any Python,
    so items within their limit never leave the JVM. Null texts are not oversized; null limits take CHUNK_LIMIT. An
    overlap that isn't below the limit is an error.
    """
    lim = F.coalesce(limit if isinstance(limit, Column) else F.lit(limit), F.lit(CHUNK_LIMIT)).cast("int")
    src = items.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"), lim.alias("limit"), *carry).where(F.length("text") > F.col("limit"))
    names = ["key", "piece_no", "piece_start", "piece_end", "piece", *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, no, starts, ends, texts = [], [], [], [], []
            for i, (t, n) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                if overlap >= n:
                    raise ValueError(f"overlap {overlap} is not below the limit {n}")
                for k, (s, e) in enumerate(pieces(t, n, overlap)):
                    at.append(i)
                    no.append(k)
                    starts.append(s)
                    ends.append(e)
                    texts.append(t[s:e])
            take = pa.array(at, pa.int64())
            ints = [pa.array(x, pa.int32()) for x in (no, starts, ends)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), *ints, pa.array(texts, pa.string()), *(b.column(3 + k).take(take) for k in range(len(carry)))], names=names)

    kinds = ", ".join(f"{c} {src.schema[c].dataType.simpleString()}" for c in carry)
    return src.mapInArrow(run, "key bigint, piece_no int, piece_start int, piece_end int, piece string" + (", " + kinds if kinds else ""))


def chunk_limit() -> Column:
    """The limit of a row of text_chunks: a parent's or a child's; a null is_parent counts as a child."""
    return F.when(F.coalesce(F.col("is_parent"), F.lit(False)), PARENT_LIMIT).otherwise(CHUNK_LIMIT)


def _without_blanks(text: str) -> tuple[str, list[int]]:
    """The visual form of a text without blanks, and where in the stored text each of its characters stands."""
    chars, at, k = [], [], 0
    while k < len(text):
        j = k + 1
        while j < len(text) and not text[j].isascii() and (ignorable(text[j]) or unicodedata.combining(text[j])):
            j += 1  # accents and invisible characters belong to the character before them
        f = "".join(fold_visible(text[k:j]).split())
        chars.append(f)
        at.extend([k] * len(f))
        k = j
    return "".join(chars), [*at, len(text)]


def seen_at(piece: str, page: tuple[str, list[int]], text: str, near: int) -> tuple[int, int] | None:
    """[start, end) of what looks like the piece in a page, blanks apart: the place nearest to `near`. Parts of a page that the piece lacks
    (between the children of a parent) may lie between its beginning and its end."""
    p = _without_blanks(piece)[0]
    if not p:
        return None

    def nearest(s: str, least: int = 0) -> int:
        best, k = -1, page[0].find(s, least)
        while k >= 0:
            if best < 0 or abs(page[1][k] - near) < abs(page[1][best] - near):
                best = k
            k = page[0].find(s, k + 1)
        return best

    k, n = nearest(p), len(p)
    if k < 0 and len(p) > 2 * ENDS:
        k = nearest(p[:ENDS])
        e = page[0].find(p[-ENDS:], k + ENDS) if k >= 0 else -1
        if e < 0:
            return None
        n = e + ENDS - k
    if k < 0:
        return None
    end = page[1][k + n]
    while end > 0 and text[end - 1].isspace() and not piece[-1:].isspace():
        end -= 1
    return page[1][k], end


def located_pieces(chunks: DataFrame, pages: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """(chunk_key, piece_no, text, start_char, end_char, located) of every oversized chunk.

    start_char and end_char locate the piece in its page. The chunk's own offset is kept where the page has the chunk's
    text there; else the place where a page of that number has it, nearest to the stated one; else the place of what looks
    like it there (problem 3), blanks apart, whose length may differ from the piece's. A piece found in no page (a parent
    over several pages) keeps the chunk's stated offset and located=false.
    """
    cut = split_oversized(chunks, "chunk_key", limit=chunk_limit(), overlap=overlap, carry=("source_file", "page", "start_char"))
    # Texts of pages without an oversized chunk needn't move.
    wanted = chunks.where(F.length("text") > chunk_limit()).select(F.col("source_file").alias("p_file"), F.col("page").alias("p_page")).distinct()
    p = pages.where("text is not null").select(F.col("source_file").alias("p_file"), F.col("page_number").alias("p_page"), F.col("text").alias("p_text")).join(wanted, ["p_file", "p_page"], "left_semi")
    both = cut.join(p, (F.col("source_file") == F.col("p_file")) & (F.col("page") == F.col("p_page")), "left")
    stated = F.coalesce("start_char", F.lit(0)) + F.col("piece_start")
    at_stated = F.expr("substring(p_text, coalesce(start_char, 0) + piece_start + 1, length(piece)) = piece")
    place = F.when(at_stated, stated).otherwise(F.nullif(F.expr("position(piece, p_text)"), F.lit(0)) - 1).cast("int")
    both = both.select("key", "piece_no", "piece", stated.cast("int").alias("stated"), place.alias("place"), F.when(place.isNull(), F.col("p_text")).alias("p_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            starts, ends, last, page = [], [], None, None
            for piece, near, k, text in zip(*(b.column(c).to_pylist() for c in ("piece", "stated", "place", "p_text"))):
                span = None if k is None else (k, k + len(piece))
                if span is None and text is not None:
                    if last is not text and last != text:
                        last, page = text, _without_blanks(text)
                    span = seen_at(piece, page, text, near)
                starts.append(span and span[0])
                ends.append(span and span[1])
            cols = [b.column(c) for c in ("key", "piece_no", "piece", "stated", "place")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["key", "piece_no", "piece", "stated", "place", "s", "e"])

    seen = both.mapInArrow(run, "key bigint, piece_no int, piece string, stated int, place int, s int, e int")
    # Of several pages with that number, one with the stored text before one with what looks like it, then the nearest to the stated place.
    order = F.struct(F.col("place").isNull().alias("other"), F.abs(F.col("s") - F.col("stated")).alias("far"), "s", "e")
    best = seen.groupBy("key", "piece_no").agg(F.first("piece").alias("text"), F.first("stated").alias("stated"), F.min(F.when(F.col("s").isNotNull(), order)).alias("near"))
    start = F.coalesce("near.s", "stated").cast("int")
    end = F.coalesce("near.e", F.col("stated") + F.length("text")).cast("int")
    return best.select(F.col("key").alias("chunk_key"), "piece_no", "text", start.alias("start_char"), end.alias("end_char"), F.col("near").isNotNull().alias("located"))
