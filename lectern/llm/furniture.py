"""Problem 4: lines that recur over the documents of one source.

Each line gets a key that is equal for lines which agree apart from digits, blanks, case, disguised characters and
commonly misread letters. Different page numbers are counted per (source, key); keys that reach the threshold are the
source's furniture. Lines with misread letters of other kinds are attached to a frequent key by edit distance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.forms import fold_visible
from lectern.llm.tools import small, written

# Characters that scanners confuse, each with the one that stands for its class in a key. What may be read
# as 6 (é, ó) is left out, as is the 6.
MISREAD_CLASSES = {"0": "o", "1": "i", "5": "s", "8": "b", "9": "g", "|": "i", "!": "i", "l": "i", "j": "i", "e": "c", "t": "c", "f": "c", "h": "b", "q": "g", "6": "", "é": "", "ó": ""}
# Letters that scanners confuse with groups of letters, spelled out as the group's classes. As every letter
# is spelled out, whatever stands beside it, a line has the same key with and without the confusion.
SPELLED = (("m", "rri"), ("n", "ri"), ("u", "ii"), ("d", "ci"), ("w", "vv"), ("b", "ii"))
_SPELLED = [(a.encode(), b.encode()) for a, b in SPELLED]
_ACCENTS = dict(zip("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"))  # fixed values
_CLASS = {a: MISREAD_CLASSES.get(b, b) for a, b in _ACCENTS.items()} | {c: c for c in "abcdefghijklmnopqrstuvwxyzßæðøþ"} | MISREAD_CLASSES
#: The classes as a table of bytes; what has no class is deleted, but for line ends.
_TABLE = bytes(ord(_CLASS.get(chr(i)) or chr(i)) for i in range(256))
_DELETED = bytes(i for i in range(256) if not _CLASS.get(chr(i)) and chr(i) != "\n")
_NO_LETTERS = bytes(i for i in range(256) if not chr(i).isalpha() and chr(i) != "\n")
_NUMBER = re.compile(rb"(?<![a-z\xdf-\xff\d|!])[ilo|!]{0,2}\d[\d.,:/ilo|!-]*(?![a-z\xdf-\xff])")
_SIX = re.compile(r"6[^\W\d_]|[^\W\d_]6(?!\d)")
_BLANK = re.compile(r"[^\S\n -~]")
_OTHER = re.compile(r"[^\x00-\xff]")


def line_keys(text: str) -> list[str | None]:
    """For each line of a text its key, without blanks and digits, or None if it has fewer than four letters.

    All lines go through one pass as bytes of Latin-1; letters of other scripts follow after a ~, as they are.
    """
    t = (text if text.isascii() else _BLANK.sub(" ", fold_visible(text))).lower()
    try:
        raw, lines = t.encode("latin-1"), None
    except UnicodeEncodeError:
        raw, lines = t.encode("latin-1", "ignore"), t.split("\n")
    letters = raw.translate(None, _NO_LETTERS).split(b"\n")
    flat = _NUMBER.sub(b"", raw).translate(_TABLE, _DELETED)
    for a, b in _SPELLED:
        flat = flat.replace(a, b)
    keys = flat.decode("latin-1").split("\n")
    out = [k + "~" if len(x) >= 4 and k else None for k, x in zip(keys, letters)]
    if lines is not None:
        for k, line in enumerate(lines):
            if (others := _OTHER.findall(line)) and (tail := [c for c in others if c.isalpha()]) and len(letters[k]) + len(tail) >= 4:
                out[k] = keys[k] + "~" + "".join(tail)
    return out


def line_key(line: str) -> str | None:
    """Key of one line."""
    return line_keys(line.replace("\n", " "))[0]


def page_lines(pages: DataFrame, key: str, source: str, page: str, text: str = "text") -> DataFrame:
    """(key, line_no, source, page, line, line_key) of every line with at least four letters; null keys, sources, pages or texts have none.

    source and line are 64-bit hashes of the source and of line_key; what is grouped and shuffled later are numbers only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, no, keys = [], [], []
            for i, t in enumerate(b.column(3).to_pylist()):
                lines = t.split("\n") if _SIX.search(t) else ()
                for k, w in enumerate(line_keys(t)):
                    # A 6 may be a b: such a line has a second key.
                    for w in {w, line_key(lines[k].replace("6", "b"))} if lines and _SIX.search(lines[k]) else (w,):
                        if w is not None:
                            at.append(i)
                            no.append(k)
                            keys.append(w)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(no, pa.int32()), b.column(1).take(at), b.column(2).take(at), pa.array(keys, pa.string())], names=["key", "line_no", "source", "page", "line_key"])

    src = pages.where(F.col(source).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.xxhash64(F.col(source).cast("string")).alias("source"), F.col(page).cast("int").alias("page"), F.col(text).cast("string").alias("text"))
    src = src.where("key is not null and page is not null and text is not null")
    return src.mapInArrow(run, "key bigint, line_no int, source bigint, page int, line_key string").withColumn("line", F.xxhash64("line_key"))


def furniture_lines(pages: DataFrame, key: str = "page_id", source: str = "source_file", page: str = "page_number", text: str = "text", least_pages: int = 6, share: float = 0.05, core_share: float = 1 / 3) -> tuple[DataFrame, DataFrame]:
    """(per source: source_file, line_key, n_pages, file_pages), (per line: key, line_no).

    A line counts once per different page number. A line joins a core of its source if their keys are equal or if one has
    at most `misread_letters` others in place of the core's, both of one length (a letter that the key spells as a group, as m,
    counts for its group). Cores are the keys that stand unharmed on at least core_share of the needed pages, so a file with m lines a page has at most m / (share * core_share) of them, whatever its size. Lines
    meet the cores of their own source and length only: a hot source is spread over its lengths.
    """
    lines = written(page_lines(pages, key, source, page, text), "lines")
    named = pages.where(F.col(source).isNotNull() & F.col(page).isNotNull()).select(F.col(source).cast("string").alias("source_file"), F.col(page).cast("int").alias("page"))
    total = named.groupBy("source_file").agg(F.count_distinct("page").alias("file_pages")).withColumn("source", F.xxhash64("source_file"))
    total = written(total, "file-pages")
    needed = F.greatest(F.lit(float(least_pages)), F.col("file_pages") * share)
    # Distinct pages in two steps, so that a hot line is first reduced within each task.
    counts = lines.select("source", "line", "page").distinct().groupBy("source", "line").agg(F.count("*").alias("n_own")).where(F.col("n_own") >= least_pages * core_share)
    often = written(counts.join(small(total.select("source", "file_pages")), "source").where(F.col("n_own") >= needed * core_share).select("source", "line"), "line-often")
    keys = lines.join(small(often), ["source", "line"], "left_semi").select("source", "line_key").distinct()
    cores = written(keys.groupBy("source", F.length("line_key").alias("n")).agg(F.collect_list("line_key").alias("cores")), "line-cores")
    tail = lambda c: F.split(c, "~")[1]
    like = lambda c: (c == F.col("line_key")) | ((tail(c) == tail(F.col("line_key"))) & F.levenshtein(c, F.col("line_key"), 2).between(0, misread_letters(c)))
    near = lines.withColumn("n", F.length("line_key")).join(small(cores), ["source", "n"])
    near = near.select("key", "line_no", "source", "page", F.explode(F.filter("cores", like)).alias("core"))
    near = written(near, "line-near")
    per_core = near.select("source", "core", "page").distinct().groupBy("source", "core").agg(F.count("*").alias("n_pages"))
    frequent = written(per_core.join(small(total), "source").where(F.col("n_pages") >= needed), "line-frequent")
    found = near.join(small(frequent.select("source", "core")), ["source", "core"], "left_semi").select("key", "line_no").distinct()
    return frequent.select("source_file", F.col("core").alias("line_key"), "n_pages", "file_pages"), found


def misread_letters(line_key: Column) -> Column:
    """Letters of a key that may be misread otherwise than the key knows: two, and one where two would be half of it."""
    return F.when(F.length(line_key) - 1 >= 6, 2).otherwise(1)


def without_lines(pages: DataFrame, found: DataFrame, key: str = "page_id", text: str = "text") -> DataFrame:
    """Every row of pages with clean_text: its text without the lines found; rows without such lines keep theirs, null stays null."""
    gone = found.groupBy("key").agg(F.collect_set("line_no").alias("_gone"))
    parts = F.split(F.col(text), "\n", -1)
    kept = F.filter(parts, lambda line, i: ~F.array_contains("_gone", i))
    joined = pages.join(gone, pages[key].cast("bigint") == gone["key"], "left").drop(gone["key"])
    clean = F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn("clean_text", clean).drop("_gone")
