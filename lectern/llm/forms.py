"""Problem 3: one stored form for texts that look the same.

Two forms are made of each text. The *visual form* keeps everything a reader can tell apart (letter case, accents,
superscripts) and folds the rest: width variants, ligatures, decomposed accents, look-alike letters of other scripts,
invisible characters, kinds and widths of blanks. The *comparison form* adds compatibility normalisation of what is
left and full case folding.

The table of single characters is built once per process from unicodedata; a text is scanned by one regular
expression, and only the distinct special characters found are looked up.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.tools import written

# Letters of Greek and Cyrillic drawn like Latin ones, each beside the Latin letter.
LOOKALIKES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ο": "o", "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H",
    "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "а": "a", "е": "e", "ѕ": "s",
    "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "ϲ": "c", "ϳ": "j", "ѵ": "v", "ɑ": "a", "ɡ": "g", "ı": "i",
}
#: Decompositions that change only the width or the joining of letters; <super>, <sub>, <fraction>, <circle> show.
_UNSEEN_TAGS = ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Blocks whose <compat> forms look like their letters: Latin and Armenian ligatures, Arabic presentation forms.
_COMPAT_BLOCKS = ((0xFB00, 0xFB17), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC), (0x132, 0x133), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0x2024, 0x2026))


def ignorable(ch: str) -> bool:
    """Default-ignorable: format characters and fillers that are never drawn."""
    o = ord(ch)
    if unicodedata.category(ch) == "Cf":
        return not (0x600 <= o <= 0x605 or o in (0x6DD, 0x70F, 0x8E2, 0x110BD, 0x110CD))
    return o in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0) or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF


def seen_as(ch: str) -> str:
    """What one character is drawn as."""
    if ignorable(ch):
        return ""
    if ch in LOOKALIKES:
        return LOOKALIKES[ch]
    apart = unicodedata.normalize("NFD", ch)
    if len(apart) > 1 and apart[0] in LOOKALIKES:
        return unicodedata.normalize("NFC", LOOKALIKES[apart[0]] + apart[1:])
    tag = unicodedata.decomposition(ch).split(" ")[0]
    if tag in _UNSEEN_TAGS and (tag != "<compat>" or any(a <= ord(ch) <= b for a, b in _COMPAT_BLOCKS)):
        return "".join(LOOKALIKES.get(x, x) for x in unicodedata.normalize("NFKC", ch))
    return ch


def _build() -> tuple[dict[str, str], re.Pattern]:
    # Hangul, ideographs and private use hold nothing to fold, so the scan over code points leaves them out.
    spans = [(0xA0, 0x3400), (0xA000, 0xAC00), (0xF900, 0x20000), (0xE0000, 0xE0200)]
    folds = {ch: to for a, b in spans for ch in map(chr, range(a, b)) if (to := seen_as(ch)) != ch}
    one = sorted(map(ord, folds))
    parts, k = [], 0
    while k < len(one):
        j = k
        while j + 1 < len(one) and one[j + 1] == one[j] + 1:
            j += 1
        parts.append(re.escape(chr(one[k])) + ("-" + re.escape(chr(one[j])) if j > k else ""))
        k = j + 1
    return folds, re.compile("[" + "".join(parts) + "]")


FOLDS, SPECIAL = _build()


def fold_visible(text: str) -> str:
    """Width, look-alikes and invisible characters folded and accents composed; blanks and case stay."""
    if text.isascii():
        return text
    if SPECIAL.search(text):
        text = SPECIAL.sub(lambda m: FOLDS[m.group()], text)
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def visual_form(text: str) -> str:
    """Equal for two texts exactly if they look the same; every run of blanks or line ends counts as one blank."""
    return " ".join(fold_visible(text).split())


def comparison_form(text: str) -> str:
    """The visual form, compatibility-normalised, composed and case-folded: for comparisons that ignore case too."""
    t = visual_form(text)
    while (n := visual_form(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()))) != t:
        t = n  # what compatibility normalisation brings out, such as a blank or a look-alike, is folded in turn
    return t


def _per_distinct(values: pa.ChunkedArray | pa.Array, of) -> list:
    """of(value) for each value, computed once per distinct value of the batch."""
    coded = values.dictionary_encode()
    made = [None if v is None else of(v) for v in coded.dictionary.to_pylist()]
    return [None if k is None else made[k] for k in coded.indices.to_pylist()]


def normalised(df: DataFrame, key: str, text: str = "text", casefold: bool = True) -> DataFrame:
    """(key, text, norm_text) of every row: the comparison form, or with casefold=False the visual form.

    A null text stays null, an empty or invisible one becomes ''. Rows that repeat are repeated.
    """
    of = comparison_form if casefold else visual_form

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_per_distinct(b.column(1), of), pa.string())], names=["key", "text", "norm_text"])

    src = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    out = src.mapInArrow(run, f"key {src.schema['key'].dataType.simpleString()}, text string, norm_text string")
    return out.select(F.col("key").alias(key), F.col("text").alias(text), "norm_text")


def both_forms(tables: list[tuple[str, DataFrame, str]], text: str = "text") -> DataFrame:
    """(tbl, key, visual_form, comparison_form) of every row of all tables, given as (name, frame, key column); nulls and repeats as in normalised()."""
    rows = None
    for name, df, key in tables:
        seen = normalised(df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")), "key", casefold=False)
        # The comparison form is made from the visual form, so the stored text is read once.
        both = normalised(seen.select("key", F.col("norm_text").alias("visual_form")), "key", "visual_form")
        one = both.select(F.lit(name).alias("tbl"), "key", "visual_form", F.col("norm_text").alias("comparison_form"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def form_hashes(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, form, stored): 128-bit hashes of the visual form and of the stored text; rows with nothing visible are left out."""

    def digest(t: str) -> bytes | None:
        seen = visual_form(t)
        return xxhash.xxh3_128_digest(seen.encode("utf-8", "surrogatepass")) if seen else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms = pa.array(_per_distinct(b.column(1), digest), pa.binary())
            stored = pa.array(_per_distinct(b.column(1), lambda t: xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass"))), pa.binary())
            out = pa.RecordBatch.from_arrays([b.column(0), forms, stored], names=["key", "form", "stored"])
            yield out.filter(forms.is_valid())

    src = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text")).where("text is not null and key is not null")
    return src.mapInArrow(run, "key bigint, form binary, stored binary")


def _of_several_spellings(tables: list[tuple[str, DataFrame, str]], text: str) -> DataFrame:
    """(tbl, form, key, stored) of the rows whose form is stored in two ways or more, each row once.

    Copies stored alike are first counted as one class (form, stored), so that only forms with two classes, few by nature,
    are joined back.
    """
    rows = None
    for name, df, key in tables:
        one = form_hashes(df, key, text).withColumn("tbl", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    rows = written(rows, "forms")
    several = rows.groupBy("tbl", "form").agg(F.min("stored").alias("lo"), F.max("stored").alias("hi")).where("lo <> hi").select("tbl", "form")
    return written(rows.join(several, ["tbl", "form"], "left_semi").distinct(), "forms-several")


def lookalike_pairs(tables: list[tuple[str, DataFrame, str]], text: str = "text") -> DataFrame:
    """(tbl, key_a, key_b): two rows of one table, key_a < key_b, stored differently yet of one visual form.

    tables: (name, frame, key column). Null texts and texts with nothing visible form no pairs. The output itself grows
    with the square of a form's rows; lookalike_classes() states the same in a row a row.
    """
    rows = _of_several_spellings(tables, text)
    a = rows.select("tbl", "form", F.col("key").alias("key_a"), F.col("stored").alias("stored_a"))
    b = rows.select("tbl", "form", F.col("key").alias("key_b"), F.col("stored").alias("stored_b"))
    return a.join(b, ["tbl", "form"]).where("key_a < key_b and stored_a <> stored_b").select("tbl", "key_a", "key_b")


def lookalike_classes(tables: list[tuple[str, DataFrame, str]], text: str = "text") -> DataFrame:
    """(tbl, key, class_key, spelling_key): the rows of lookalike_pairs() with the least key of their form and of their stored text.

    Two rows are a pair if their class_key agrees and their spelling_key differs; the table grows with the rows, not the pairs.
    """
    rows = _of_several_spellings(tables, text)
    spelled = rows.groupBy("tbl", "form", "stored").agg(F.min("key").alias("spelling_key"))
    classes = spelled.groupBy("tbl", "form").agg(F.min("spelling_key").alias("class_key"))
    return rows.join(spelled, ["tbl", "form", "stored"]).join(classes, ["tbl", "form"]).select("tbl", "key", "class_key", "spelling_key")
