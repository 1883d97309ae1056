"""Problem 5: repair text from scanned pages.

A first pass counts words and title lines over all pages. A second decodes each page: its lines are joined to one
character stream in which a hyphen at a line end may be dropped, and every stretch that is not plainly a known word is
decoded by a noisy channel: letters may have been confused, a word split in two or two words run together; the likeliest
reading under the word counts is taken. Decoding is done once per distinct stretch in each task. Paragraph boundaries
are chosen by dynamic programming over the lines that are left.
"""

from __future__ import annotations

import math
import os
import re
import tempfile
import uuid
from collections import Counter
from collections.abc import Container, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.forms import fold_visible
from lectern.llm.furniture import line_key
from lectern.llm.tools import small, written

#: Entries of the lexicon that go to the driver in one piece.
AT_ONCE = 100_000
#: Looked-up strings that a task keeps.
KEPT = 500_000

# What scanners print, with the letters that may have stood there.
CONFUSIONS = {
    "c": ("e",), "ä": ("a",), "!": ("i",), "|": ("l", "i"), "f": ("t", "e"), "ri": ("n",), "5": ("s",), "0": ("o",), "1": ("l", "i"), "rn": ("m",),
    "m": ("rn",), "ii": ("u",), "cl": ("d",), "9": ("g",), "b": ("h",), "h": ("li",), "6": ("ó", "é", "b"), "8": ("b",), "l": ("i",), "vv": ("w",),
}
#: Share of a word's occurrences that one confusion takes at most: of a frequent reading less, as its count is sure.
CONFUSED_MOST, CONFUSED_OFTEN, FEW = math.log(0.05), math.log(0.025), 5
#: Log probability of one confusion, of a lost and of an inserted blank.
CONFUSED, JOINED, PARTED = math.log(0.05), math.log(0.05), math.log(1e-3)
#: Log probability of a cut at one of a word's few places, against a compound's own hyphen; of a hyphen between two words that are no known compound.
CUT, CUT_APART = math.log(1 / 3), math.log(0.05)

_MATH = re.compile(r"\$[^$\n]*\$|\\\([^\n]*?\\\)|\\[a-z]+\{[^}\n]*\}(?:\{[^}\n]*\})?|\\[a-z]+")
_CUT = re.compile(r"[-‐¬](?<=[^\W\d_][-‐¬])[^\S\n]*\n[^\S\n]*(?=[\w!|])")
_TOKEN = re.compile(r"[\w!|\x01]+")
_COMPOUND = re.compile(r"[^\W\d_]+(?:[-‐][^\W\d_]+)+")
_LETTER = re.compile(r"[^\W\d_\x01]")
_VARIABLE = re.compile(r"[^\W\d_]\d+")
_NUM = r"(?:[\dlIOoSBzZ|!]{1,4}|[ivxlc]{1,7})"
_PAGE_NO = re.compile(rf"\s*(?:[-—–·•*~]+\s*({_NUM})\s*[-—–·•*~]+|[\[({{<]\s*({_NUM})\s*[\])}}>]|(?:page|página|pagina|seite|pág\.?|pag\.?|pp?\.|s\.)\s*({_NUM})|({_NUM})\s*(?:/|of|de|von|sur|di)\s*{_NUM})\s*", re.I)
_BARE = re.compile(r"\s*([\dlIOoSBzZ|!]{1,4}|[ivxlc]{1,7})\s*")
_ATTACHED = re.compile(r"\s*([\dlIOoSB|!]{1,4})\s{2,}\S+(?:\s\S+)*\s*|\s*\S+(?:\s\S+)*\s{2,}([\dlIOoSB|!]{1,4})\s*")
_DIGITS = str.maketrans("lIOoSBzZ|!", "1100582211")
# The word for a chapter in the corpus' languages.
CHAPTER_WORDS = ("chapter", "capítulo", "chapitre", "kapitel", "capitolo")
_CHAPTER_KEYS = tuple(line_key(w)[:-1] for w in CHAPTER_WORDS)
#: Lines at the top and the foot of a page that may hold headers and page numbers.
EDGE = 4


def cased_stream(text: str) -> str:
    """Folded text with \\x02 for each formula, in which a cut word is one token with \\x01 at the cut; line ends stay."""
    t = text if text.isascii() else fold_visible(text.replace("­\n", "-\n"))
    return _CUT.sub("\x01", _MATH.sub("\x02", t))


def stream(text: str) -> str:
    """cased_stream in lower case."""
    return cased_stream(text).lower()


def edge_lines(lines: list[str]) -> list[int]:
    """Numbers of the first and the last few lines that aren't blank."""
    full = [k for k, line in enumerate(lines) if line and not line.isspace()]
    return full if len(full) <= 2 * EDGE else full[:EDGE] + full[-EDGE:]


def number(s: str) -> int | None:
    """The value of a printed page number, arabic (with misread digits) or roman."""
    if any(ch.isdigit() for ch in s):
        t = s.translate(_DIGITS)
        return int(t) if t.isdigit() else None
    values, total, last = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}, 0, 0
    for ch in reversed(s.lower()):
        v = values.get(ch)
        if v is None:
            return None
        total, last = (total - v, last) if v < last else (total + v, v)
    return total


def _misread_number(s: str) -> int | None:
    """The value of a number of which at least one digit is printed as a letter or sign."""
    t = s.translate(_DIGITS)
    return int(t) if t.isdigit() and not s.isdigit() else None


def title_key(line: str) -> str | None:
    """line_key of a title without its volume."""
    k = (line_key(line) or "").split("~")[0]
    return k[:-3] if k.endswith("voi") and len(k) > 7 else k or None


def lexicon(pages: DataFrame, page: str = "page_number", text: str = "text", source: str = "source_file", titles: DataFrame | None = None) -> tuple[str, int, DataFrame]:
    """(name of the files for Lexicon, sum of the word counts, a frame (source, offset)) of all pages.

    A title is a line at the top or foot that carries the page's own number beside it on some page; titles, a frame with
    a column `title`, adds known ones (a trailing number is dropped). Entries seen fewer than 3 times are left out,
    whatever the size of the input. A source has an offset if bare
    numbers at the edge of its pages differ from the page number by the same amount on a tenth of its pages, 3 at least;
    it stays a table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(words: Counter, others: Counter) -> pa.RecordBatch:
            words = Counter({w: n for w, n in words.items() if _LETTER.search(w)})
            return pa.RecordBatch.from_arrays(
                [pa.array(["w"] * len(words) + [k for k, _ in others], pa.string()), pa.array([*words, *(w for _, w in others)], pa.string()), pa.array([*words.values(), *others.values()], pa.int64())], names=["what", "word", "n"]
            )

        words: Counter = Counter()
        others: Counter = Counter()
        for b in batches:
            for n, t, src in zip(*(c.to_pylist() for c in b.columns)):
                s = stream(t)
                words.update(_TOKEN.findall(s))
                if "-" in s or "‐" in s:
                    words.update(w.replace("‐", "-") for w in _COMPOUND.findall(s))
                if n is None:
                    continue
                lines = t.split("\n")
                edge = edge_lines(lines)
                for k in edge:
                    line = lines[k]
                    if "  " in line and (m := _ATTACHED.fullmatch(fold_visible(line))):
                        v = number(m.group(1) or m.group(2))
                        if v is not None and abs(v - n) <= 20 and (w := title_key(line)):
                            others["t", w] += 1
                if src is not None:
                    for k in {edge[0], edge[-1]} if edge else ():
                        if (m := _BARE.fullmatch(fold_visible(lines[k]))) and m.group(1).isdigit():
                            others["o", f"{int(m.group(1)) - n} {src}"] += 1
            if len(words) + len(others) > 300_000:
                yield out(words, others)
                words, others = Counter(), Counter()
        yield out(words, others)

    src = pages.select(F.col(page).cast("int").alias("page"), F.col(text).cast("string").alias("text"), F.col(source).cast("string").alias("source")).where("text is not null")
    raw = src.mapInArrow(run, "what string, word string, n bigint")
    if titles is not None:
        # Title words are folded once per distinct title, after counting.
        known = titles.where("title is not null").groupBy(F.regexp_replace("title", r"\s+\d+$", "").alias("word")).agg(F.count("*").alias("n"))
        raw = raw.unionByName(known.select(F.lit("k").alias("what"), "word", "n"))
    counts = written(raw.groupBy("what", "word").agg(F.sum("n").alias("n")), "scan-counts")
    sizes = src.where("source is not null").groupBy("source").agg(F.count("*").alias("pages"))
    shifts = counts.where("what = 'o'").select(F.split("word", " ", 2)[1].alias("source"), F.split("word", " ", 2)[0].cast("int").alias("shift"), "n")
    best = shifts.groupBy("source").agg(F.max_by("shift", F.struct("n", -F.abs("shift"), "shift")).alias("shift"), F.max("n").alias("n"))
    offsets = written(best.join(sizes, "source").where("n >= 3 and n >= 0.1 * pages").select("source", "shift"), "scan-offsets")
    counts = counts.where("what <> 'o'")
    keep = counts.where("n >= 3")
    total = keep.where("what = 'w'").agg(F.sum("n")).first()[0] or 0
    return _filed(keep), total, offsets


def text_hash(s: str) -> int:
    h = xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >= 1 << 63 else h


def _filed(keep: DataFrame) -> str:
    """Words, their beginnings and title keys as the files of a Lexicon; their name."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: Counter = Counter()
            for what, word, n in zip(*(c.to_pylist() for c in b.columns)):
                if what == "w":
                    w = word.replace("\x01", "")
                    found[w] += n
                    for k in range(1, len(w)):
                        found[w[:k]] += 0
                elif k := word if what == "t" else title_key(word):
                    found["\x03" + k] += 1
            yield pa.RecordBatch.from_arrays([pa.array(map(text_hash, found), pa.int64()), pa.array(found.values(), pa.int64())], names=["hash", "n"])

    return filed(keep.select("what", "word", "n").mapInArrow(entries, "hash bigint, n bigint"))


def filed(found: DataFrame) -> str:
    """(hash, n) summed by hash as files of sorted hashes and counts, 16 bytes an entry, sent to all executors; their name.

    The driver writes them piece by piece, so neither it nor a task holds them.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, AT_ONCE):
                part = b.slice(k, AT_ONCE)
                yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy().tobytes()], pa.binary()) for c in part.columns], names=["hash", "n"])

    found = written(found.groupBy("hash").agg(F.sum("n").alias("n")), "scan-lexicon")
    name = f"scan-lexicon-{uuid.uuid4().hex}"
    at = tempfile.mkdtemp(prefix="spark-lectern-")  # executors fetch from there when they need the files
    paths = [os.path.join(at, f"{name}.{part}") for part in ("hash", "n")]
    with open(paths[0], "wb") as hashes, open(paths[1], "wb") as counts:
        for x in found.orderBy("hash").mapInArrow(packed, "hash binary, n binary").toLocalIterator():
            hashes.write(x[0])
            counts.write(x[1])
    for path in paths:
        found.sparkSession.sparkContext.addFile(path)
    return name


class Lexicon:
    """Word counts and title keys in files that are mapped into memory; only what was looked up lately is held."""

    def __init__(self, name: str):
        files = [SparkFiles.get(f"{name}.{part}") for part in ("hash", "n")]
        self.hashes, self.counts = (np.memmap(f, np.int64, "r") if os.path.getsize(f) else np.empty(0, np.int64) for f in files)
        self.seen: dict[str, int] = {}

    def get(self, s: str, missing: int = -1) -> int:
        """The count of a word, 0 of what only begins words, else missing."""
        n = self.seen.get(s)
        if n is None:
            if len(self.seen) > KEPT:
                self.seen.clear()
            h = np.int64(text_hash(s))
            k = self.hashes.searchsorted(h)
            n = self.seen[s] = int(self.counts[k]) if k < len(self.hashes) and self.hashes[k] == h else -1
        return missing if n < 0 else n

    def __contains__(self, title: str) -> bool:
        return self.get("\x03" + title) >= 0


class Step(NamedTuple):
    """One word of a reading: where it stands in the stretch, the word, the place of its first confusion or -1, hyphens dropped."""

    start: int
    end: int
    word: str
    first: int
    cuts: tuple[int, ...]


class Decoder:
    """The likeliest reading of a stretch of tokens; each distinct stretch is decoded once.

    A stretch is tokens parted by single blanks, with \x01 where a hyphen stood at a line end. Its reading is the best path
    of steps: a lexicon word with confusions undone, a blank or hyphen inside it dropped, a hyphen kept; a blank
    put in; or a token as it stands.
    """

    def __init__(self, words: dict[str, int] | Lexicon, total: int | None = None, confusions: dict[str, tuple[str, ...]] = CONFUSIONS):
        if isinstance(words, dict):
            total = sum(words.values())
            words = dict.fromkeys((w[:k] for w, n in words.items() if n >= 3 for k in range(1, len(w) + 1)), 0) | words
        self.words, self.total, self.confusions = words, max(1, total), confusions
        self.fine: set[str] = set()
        self.odd: set[str] = set()
        self.read: dict[str, list[Step] | None] = {}

    def unsure(self, token: str) -> bool:
        """Whether a token is more than a plainly known word."""
        if token in self.fine:
            return False
        if token in self.odd:
            return True
        if len(self.fine) + len(self.odd) > 400_000:
            self.fine.clear()
            self.odd.clear()
        w = token.replace("\x01", "")
        odd = not _fixed(w) and (w != token or self.words.get(w, 0) < 3 or self.path(token) is not None)
        (self.odd if odd else self.fine).add(token)
        return odd

    def path(self, stretch: str) -> list[Step] | None:
        """The steps of the likeliest reading, or None if all stands as it is."""
        if stretch in self.read:
            return self.read[stretch]
        if len(self.read) > 200_000:
            self.read.clear()
        got = self.read[stretch] = self._viterbi(stretch)
        return got

    def _viterbi(self, s: str) -> list[Step] | None:
        base, size = math.log(self.total), len(s)
        best: list[float] = [-math.inf] * (size + 1)
        back: list[tuple[int, Step | None]] = [(0, None)] * (size + 1)
        best[0] = 0.0
        ends = {m.start(): m.end() for m in _TOKEN.finditer(s)}
        fixed = {k: end for k, end in ends.items() if _fixed(s[k:end].replace("\x01", ""))}
        for i in range(size):
            at = best[i]
            if at == -math.inf:
                continue
            if s[i] in " \x01":
                cost = at + (CUT_APART if s[i] == "\x01" else 0.0)
                if cost > best[i + 1]:
                    best[i + 1], back[i + 1] = cost, (i, None)
                continue
            if i in ends:
                end = ends[i]
                w = s[i:end].replace("\x01", "")
                cost = at - base + math.log(self.words.get(w, 0) + 0.5) + (CUT if len(w) < end - i else 0.0)
                if cost > best[end]:
                    best[end], back[end] = cost, (i, Step(i, end, w, -1, tuple(_positions(s[:end], "\x01", i))))
                if i in fixed:
                    continue
            inside = i > 0 and s[i - 1] not in " \x01"
            for j, word, edits, first, cuts, cost in self._from(s, i, fixed):
                part = inside or j < size and s[j] not in " \x01"
                if part and (len(word) < 2 or edits and len(word) < 3):
                    continue
                n = self.words.get(word, 0)
                if edits:
                    own = self.words.get(s[i:j].replace("\x01", "").replace(" ", ""), 0)
                    if len(word) < 3 and n * 0.02 < own + 0.5:
                        continue
                    cost += (edits - 1) * CONFUSED + (CONFUSED_MOST if own <= FEW else CONFUSED_OFTEN)
                cost += at + math.log(n) - base + (JOINED if inside else 0.0)
                if cost > best[j]:
                    best[j], back[j] = cost, (i, Step(i, j, word, first, cuts))
        steps, j = [], size
        while j:
            j, step = back[j]
            if step:
                steps.append(step)
        steps.reverse()
        same = len(steps) == len(ends) and all(ends.get(x.start) == x.end and x.word == s[x.start : x.end] for x in steps)
        return None if same else steps

    def _from(self, s: str, i: int, fixed: dict[int, int]) -> Iterator[tuple[int, str, int, int, tuple[int, ...], float]]:
        """Lexicon words that may be printed from i on: (end, word, confusions, place of the first, hyphens dropped, cost of blanks and hyphens)."""
        find, size = self.words.get, len(s)
        stack = [(i, "", 0, -1, (), 0.0, False)]
        while stack:
            k, head, edits, first, cuts, cost, parted = stack.pop()
            if head and s[k - 1] not in " \x01" and find(head, 0) >= 3:
                yield k, head, edits, first, cuts, cost
            if k == size:
                continue
            ch = s[k]
            if ch == " ":
                if not parted and k + 1 < size and k + 1 not in fixed:
                    stack.append((k + 1, head, edits, first, cuts, cost + PARTED, True))
                continue
            if ch == "\x01":
                stack.append((k + 1, head, edits, first, (*cuts, k), cost + CUT, parted))
                if find(head + "-", -1) >= 0:
                    stack.append((k + 1, head + "-", edits, first, cuts, cost, parted))
                continue
            if find(head + ch, -1) >= 0:
                stack.append((k + 1, head + ch, edits, first, cuts, cost, parted))
            if 2 * edits <= k - i:  # one letter in two may be wrong, beyond that nothing is left to read
                for bad, end, more in ((ch, k + 1, 0.0), (s[k : k + 2], k + 2, 0.0), (ch + s[k + 2 : k + 3], k + 3, CUT)):
                    if more and s[k + 1 : k + 2] != "\x01" or end > size:
                        continue
                    for good in self.confusions.get(bad, ()):
                        if find(head + good, -1) >= 0:
                            stack.append((end, head + good, edits + 1, k if first < 0 else first, (*cuts, k + 1) if more else cuts, cost + more, parted))

    def parted(self, a: str, b: str) -> str | None:
        """The word of which two neighbouring tokens are the halves, if that is likelier than two words."""
        got = self.path(f"{a} {b}")
        return got[0].word if got and len(got) == 1 else None

    def joined(self, w: str) -> tuple[str, str] | None:
        """The two words that were run together as w, if that is likelier than one word."""
        got = self.path(w)
        return (got[0].word, got[1].word) if got and len(got) == 2 else None


def _fixed(w: str) -> bool:
    """Whether a token is no word: a number, a single letter, a variable."""
    return len(w) < 2 or not _LETTER.search(w) or _VARIABLE.fullmatch(w) is not None


def stretches(s: str, decoder: Decoder, cased: str | None = None) -> Iterator[tuple[list[tuple[int, int]], list[Step]]]:
    """(spans of its tokens in s, steps) for each stretch of s that doesn't stand as it is.

    A stretch is unsure tokens and the ones beside them, as far as nothing but blanks and at most one line end is between.
    cased is s before lower-casing: a token that begins with a capital is no second half.
    """
    if not any(decoder.unsure(t) for t in set(_TOKEN.findall(s)) - decoder.fine):
        return
    spans = [m.span() for m in _TOKEN.finditer(s)]
    odd = [k for k, (a, b) in enumerate(spans) if decoder.unsure(s[a:b])]
    wanted = sorted({k + d for k in odd for d in (-1, 0, 1) if 0 <= k + d < len(spans)})
    runs: list[list[int]] = []
    for k in wanted:
        a = spans[k][0]
        if runs and runs[-1][-1] == k - 1 and (gap := s[spans[k - 1][1] : a]).isspace() and gap.count("\n") < 2 and not (cased and cased[a].isupper()):
            runs[-1].append(k)
        else:
            runs.append([k])
    known = set(odd)
    for run in runs:
        if not known.isdisjoint(run):
            parts = [spans[k] for k in run]
            if steps := decoder.path(" ".join(s[a:b] for a, b in parts)):
                yield parts, steps


def _place(parts: list[tuple[int, int]], k: int) -> int:
    """Where in the text the k-th character of a stretch stands."""
    for a, b in parts:
        if k < b - a:
            return a + k
        k -= b - a + 1
    return parts[-1][1]


def line_kinds(text: str, page: int | None, shift: int | None, decoder: Decoder, titles: Container[str]) -> list[tuple[int, str]]:
    """(line_no, kind) of what a page's lines have: hyphen, misread, header, page_no."""
    out: set[tuple[int, str]] = set()
    cased = cased_stream(text)
    s = cased.lower()
    for parts, steps in stretches(s, decoder, cased if len(cased) == len(s) else None):
        for x in steps:
            # A hyphen that a compound keeps is no cut.
            out.update((_line(s, _place(parts, k)), "hyphen") for k in x.cuts)
            if x.first >= 0:
                out.add((_line(s, _place(parts, x.first)), "misread"))
    return sorted(out | edge_kinds(text, page, shift, titles))


def edge_kinds(text: str, page: int | None, shift: int | None, titles: Container[str]) -> set[tuple[int, str]]:
    """(line_no, kind) of the lines at the edges of a page: header, page_no, and misread where a digit of theirs is."""
    out: set[tuple[int, str]] = set()
    lines = text.split("\n")
    edge = edge_lines(lines)
    for r, k in enumerate(edge):
        line = lines[k]
        f = fold_visible(line)
        m = _PAGE_NO.fullmatch(f)
        if m:
            num = next(x for x in m.groups() if x)
            seen = _misread_number(num)
            near = seen is not None and page is not None and abs(seen - page) <= 20
            if near or number(num) is not None:
                out.add((k, "page_no"))
                if near or any(ch.isdigit() for ch in num) and not num.isdigit():
                    out.add((k, "misread"))
                continue
        if (r < 3 or r >= len(edge) - 3) and page is not None and (m := _BARE.fullmatch(f)):
            num = m.group(1)
            seen = _misread_number(num)
            v = int(num) if num.isdigit() else seen
            # A bare number counts where the source has them, or at the very edge; a roman one where it is the page's own.
            own = v is not None and v == page + (shift or 0) and (shift is not None or r in (0, len(edge) - 1) and any(ch.isdigit() for ch in num))
            if own or num.islower() and number(num) == page:
                out.add((k, "page_no"))
                if own and not num.isdigit():
                    out.add((k, "misread"))
                continue
        w = title_key(line)
        if w and (w in titles or w.startswith(_CHAPTER_KEYS) and not f.rstrip().endswith((".", ","))):
            out.add((k, "header"))
            m = _ATTACHED.fullmatch(f)
            num = m and (m.group(1) or m.group(2))
            if num and any(ch.isdigit() for ch in num) and not num.isdigit():
                out.add((k, "misread"))
    return out


def _line(s: str, k: int) -> int:
    return s.count("\n", 0, k) + s.count("\x01", 0, k)


def _positions(s: str, part: str, start: int = 0) -> Iterator[int]:
    k = s.find(part, start)
    while k >= 0:
        yield k
        k = s.find(part, k + len(part))


def _cased(right: str, seen: str) -> str:
    return right.upper() if seen.isupper() and len(seen) > 1 else right[:1].upper() + right[1:] if seen[:1].isupper() else right


_ENDS = (".", "!", "?", ":", "»", "”", '"', ")", "$", "。", "…")


def paragraphs(text: str, page: int | None, shift: int | None, decoder: Decoder, titles: Container[str]) -> list[str]:
    """Continuous paragraphs of a page: headers and page numbers dropped, cut words joined, misread words replaced."""
    gone = {k for k, kind in edge_kinds(text, page, shift, titles) if kind != "misread"}
    lines = [(k, line) for k, line in enumerate(fold_visible(text.replace("­\n", "-\n")).split("\n")) if k not in gone]
    blocks = _boundaries([line for _, line in lines])
    return [p for b in blocks if (p := _mended(" \n".join(b), decoder))]


def _boundaries(lines: list[str]) -> list[list[str]]:
    """Lines grouped to paragraphs at least cost, by dynamic programming over the places where one may begin."""
    full = [(k, line.strip()) for k, line in enumerate(lines) if line.strip()]
    if not full:
        return []
    width = sorted(len(s) for _, s in full)[len(full) * 3 // 4] or 1
    n = len(full)
    cost = [0.0] * (n + 1)
    back = [0] * (n + 1)
    # between[j]: cost of a boundary before line j, and of none there.
    gain = []
    for j in range(1, n):
        (ka, a), (kb, b) = full[j - 1], full[j]
        blank = kb - ka > 1
        g = 3.0 if blank else -2.0
        g += 1.5 if a.endswith(_ENDS) else -1.5
        g += 0.8 if len(a) < 0.7 * width else -0.5
        g += 0.5 if b[:1].isupper() or not b[:1].isalpha() else -1.5
        gain.append(-g)
    run = [0.0] * n
    for j in range(1, n):
        run[j] = run[j - 1] - gain[j - 1]  # price of crossing a likely boundary
    # A paragraph of lines i to j costs what it crosses, run[j - 1] - run[i], and its boundary; the best i so far is carried along.
    best, at = math.inf, 0
    for j in range(1, n + 1):
        i = j - 1
        c = cost[i] - run[i] / 2 + (gain[i - 1] / 2 if i else 0.0)
        if c < best:
            best, at = c, i
        cost[j], back[j] = best + run[j - 1] / 2, at
    cuts, j = [], n
    while j:
        cuts.append((back[j], j))
        j = back[j]
    return [[s for _, s in full[i:j]] for i, j in reversed(cuts)]


def _mended(block: str, decoder: Decoder) -> str:
    t = re.sub(r"(?<=[^\W\d_])[-‐¬]\s*\n\s*(?=[\w!|])", "\x01", block)
    t = " ".join(t.split())
    out, at = [], 0
    for m in _MATH.finditer(t):
        out += [_reread(t[at : m.start()], decoder), m.group()]
        at = m.end()
    out.append(_reread(t[at:], decoder))
    return "".join(out)


def _reread(t: str, decoder: Decoder) -> str:
    """Text without formulas, with the likeliest words in the case of what is printed."""
    s = t.lower()
    if len(s) != len(t):
        t = s
    out, at = [], 0
    for parts, steps in stretches(s, decoder, t):
        out.append(t[at : parts[0][0]])
        at = parts[-1][1]
        seen, end = " ".join(t[a:b] for a, b in parts), 0
        for x in steps:
            if x.start:
                out.append("-" if "\x01" in seen[end : x.start] else " ")
            end = x.end
            printed = seen[x.start : x.end].replace("\x01", "").replace(" ", "")
            out.append(printed if printed.lower() == x.word else _cased(x.word, printed))
    return ("".join(out) + t[at:]).replace("\x01", "")


def _decoded(pages: DataFrame, key: str, page: str, text: str, source: str, titles: DataFrame | None, schema: str, of, confusions: dict[str, tuple[str, ...]]) -> DataFrame:
    name, total, offsets = lexicon(pages, page, text, source, titles)
    kinds = [pa.int64(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = titles = Lexicon(name)
        decoder = Decoder(words, total, confusions)
        for b in batches:
            rows = [(k, *x) for k, n, t, shift in zip(*(c.to_pylist() for c in b.columns)) for x in of(t, n, shift, decoder, titles)]
            cols = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split(" ")[0] for x in schema.split(", ")])

    src = pages.select(F.col(key).cast("bigint").alias("key"), F.col(page).cast("int").alias("page"), F.col(text).cast("string").alias("text"), F.col(source).cast("string").alias("source")).where("key is not null and text is not null")
    return src.join(small(offsets), "source", "left").select("key", "page", "text", "shift").mapInArrow(run, schema)


def scan_lines(pages: DataFrame, key: str = "page_id", page: str = "page_number", text: str = "text", source: str = "source_file", titles: DataFrame | None = None, confusions: dict[str, tuple[str, ...]] = CONFUSIONS) -> DataFrame:
    """(page_id, line_no, kind), a row per kind that a line has. confusions: what scanners print, with what may have stood there. Null texts have none; a null page number matches no number without dress."""
    return _decoded(pages, key, page, text, source, titles, "page_id bigint, line_no int, kind string", line_kinds, confusions)


def scan_paragraphs(pages: DataFrame, key: str = "page_id", page: str = "page_number", text: str = "text", source: str = "source_file", titles: DataFrame | None = None, confusions: dict[str, tuple[str, ...]] = CONFUSIONS) -> DataFrame:
    """(page_id, para_no, paragraph): every page's text as continuous paragraphs; a blank page has none."""
    return _decoded(pages, key, page, text, source, titles, "page_id bigint, para_no int, paragraph string", lambda *x: enumerate(paragraphs(*x)), confusions)
