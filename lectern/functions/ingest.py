"""Scalar functions of ingestion, as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the data model names as types of a source, with the folder that stands for each.
SOURCE_TYPES = {"books": "book", "lecture_notes": "lecture_notes", "exercises": "exercises"}
# Words whose presence tells Spanish from English.
SPANISH = ("el ", "la ", "los ", "las ", "de ", "que ", "en ", "y ", "sea ", "para ", "por ", "como ", "con ", "se ")
ENGLISH = ("the ", "and ", "is ", "are ", "for ", "that ", "with ", "this ", "from ", "have ", "has ")
# Block types with the words that tell them, in order of precedence.
BLOCK_TYPES = (
    ("theorem", ("theorem", "teorema")), ("proof", ("proof", "demostración", "dem.", "prueba")), ("definition", ("definition", "definición")), ("example", ("example", "ejemplo")),
    ("lemma", ("lemma", "lema")), ("proposition", ("proposition", "proposición")), ("corollary", ("corollary", "corolario")), ("exercise", ("exercise", "ejercicio")),
)
# Fixed value: formulas as they are marked in text.
LATEX = r"(?s)\$[^$]+\$|\\\[.*?\\\]|\\\(.*?\\\)"


def source_type(path: Column) -> Column:
    """Type by the first folder of the path that names one, in any case; book if none does."""
    known = F.array(*map(F.lit, SOURCE_TYPES))
    first = F.try_element_at(F.filter(F.transform(F.split(path, "/"), F.lower), lambda x: F.array_contains(known, x)), F.lit(1))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SOURCE_TYPES.items() for x in kv]), first), F.lit("book"))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+$", "")


def author(name: Column, first_page: Column, known: Sequence[str]) -> Column:
    """A known name in the file's stem (any case), else in its first page; else the stem's first word capitalised; else ''."""
    low = F.lower(stem(name))
    in_name = [F.when(F.contains(low, F.lit(a.lower())), F.lit(a)) for a in known]
    in_text = [F.when(F.contains(first_page, F.lit(a)), F.lit(a)) for a in known]
    word = F.regexp_extract(F.regexp_replace(stem(name), "[_-]", " "), r"^\s*(\S+)", 1)
    return F.coalesce(*in_name, *in_text, F.initcap(word), F.lit(""))


def language_heuristic(text: Column) -> Column:
    """es or en if its indicator words outnumber the other's by more than half, else mixed."""
    low = F.lower(text)
    es = sum((F.contains(low, F.lit(w)).cast("int") for w in SPANISH), F.lit(0))
    en = sum((F.contains(low, F.lit(w)).cast("int") for w in ENGLISH), F.lit(0))
    return F.when(es > en * 1.5, "es").when(en > es * 1.5, "en").otherwise("mixed")


def chapter(text: Column) -> Column:
    """Number of the first chapter line; null if there is none or it doesn't fit an int."""
    return F.nullif(F.regexp_extract(text, r"(?imu)^(?:Chapter|Capítulo)\s*(\d+)", 1), F.lit("")).try_cast("int")


def has_latex(text: Column) -> Column:
    return F.regexp_like(text, F.lit(LATEX))


def tag_latex(text: Column) -> Column:
    return F.regexp_replace(text, LATEX, "[LATEX]$0[/LATEX]")


def split_hints(text: Column) -> Column:
    """A blank line before each tagged formula and after it, unless a line break is there already."""
    before = F.regexp_replace(text, r"(?<!\n)\[LATEX\]", "\n\n[LATEX]")
    return F.regexp_replace(before, r"\[/LATEX\](?!\n)", "[/LATEX]\n\n")


def clean(text: Column, recurring: Column | None = None) -> Column:
    """Recurring strings removed, cut words joined, runs of line breaks and blanks shortened, lines of digits emptied, ends trimmed."""
    t = text
    if recurring is not None:
        t = F.aggregate(F.coalesce(recurring, F.array().cast("array<string>")), t, lambda acc, x: F.replace(acc, x, F.lit("")))
    t = F.regexp_replace(t, r"(?U)(\w)-\n(\w)", "$1$2")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, r" +", " ")
    t = F.regexp_replace(t, r"(?m)^[^\S\n]*\d+[^\S\n]*$", "")
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def block_text(lines: Column) -> Column:
    """Text of a layout block: spans joined by a blank, every line ended by a line feed."""
    return F.array_join(F.transform(lines, lambda line: F.concat(F.array_join(F.transform(line["spans"], lambda s: s["text"]), " "), F.lit("\n"))), "")


def chunk_id(name: Column, page: Column, index: Column, text: Column) -> Column:
    """{base}_p{page}_seq{index}_{first six of md5}; base is the file without .pdf, blanks as underscores, 30 characters at most."""
    base = F.substring(F.replace(F.replace(F.replace(name, F.lit(".pdf"), F.lit("")), F.lit(" "), F.lit("_")), F.lit("__"), F.lit("_")), 1, 30)
    return F.concat(base, F.lit("_p"), page.cast("string"), F.lit("_seq"), index.cast("string"), F.lit("_"), F.substring(F.md5(text.cast("binary")), 1, 6))


def block_type(text: Column) -> Column:
    low = F.lower(F.substring(text, 1, 300))
    c = F.when(F.lit(False), F.lit(""))
    for kind, words in BLOCK_TYPES:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        c = c.when(hit, F.lit(kind))
    return c.otherwise("general")


def content_flags(text: Column) -> dict[str, Column]:
    return {
        "has_theorem": F.regexp_like(text, F.lit(r"(?iuU)\b(theorem|teorema)\b")),
        "has_proof": F.regexp_like(text, F.lit(r"(?iuU)\b(proof|demostración|dem\.|prueba|□|∎)\b")),
        "has_definition": F.regexp_like(text, F.lit(r"(?iuU)\b(definition|definición)\b")),
    }


def char_offsets(text: Column, page_text: Column) -> tuple[Column, Column]:
    """Where the chunk's first 50 characters stand in its page, 0 if nowhere; and that plus the chunk's length."""
    start = F.greatest(F.coalesce(F.position(F.substring(text, 1, 50), page_text), F.lit(0)) - 1, F.lit(0))
    return start, start + F.length(text)


def tokens(text: Column) -> Column:
    """Lower-case words between blanks."""
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda x: x != "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda x: x != ""))
