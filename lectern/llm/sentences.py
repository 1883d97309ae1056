"""Problem 8: sentence units of documents in many languages and scripts.

A full stop is ambiguous; whether the word before it is an abbreviation and whether the word after it is a name is
decided from unambiguous occurrences elsewhere in the document, and where it has none from counts over the whole
corpus (a first pass). Other end marks follow the rules of their script.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Container, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.forms import fold_visible
from lectern.llm.scans import Lexicon, filed, text_hash
from lectern.llm.tools import written

#: A title ends a paragraph at most at this share of the rate of all words before full stops, and as seldom by chance at most with this probability.
TITLE_RATE, BY_CHANCE = 0.05, 0.05
#: An abbreviation stands without its full stop at most so often, for each time with it, in the documents that have it.
PLAIN_SHARE = 1.0

# End marks by script, and pairs of quotes and brackets.
_MARK = re.compile(r"(?:[!?…。！？؟।॥۔｡]|\.(?![\d,;:$\\a-zà-ÿ]))[.!?…。！？؟।॥۔｡]*")
_QUOTED = re.compile(r'"[^"]*"|„[^“”„]*[“”]|“[^“”]*”|«[^«»]*»|»[^«»]*«|「[^「」]*」|『[^『』]*』|\((?:[^()]|\([^()]*\))*\)|（[^（）]*）|\[[^\[\]]*\]')
_CLOSERS = "\"“”»«」』)）]"
_BREAK = re.compile(r"\n[^\S\n]*\n\s*")
_NEXT_WORD = re.compile(r"[^\W\d_](?:[^\W_]|[​-‍⁠﻿­̀-ͯ])*")
_LIST_MARK = re.compile(r"(?:\(?\d{1,3}[.)]|\(?[^\W\d_][)]|[-–—•*·‣])\s")
_LIST_NUMBER = re.compile(r"\(?\d{1,3}$")
_THAI = re.compile(r"[฀-๿]")
_THAI_GAP = re.compile(r"[^\S\n]+")
# German words after which a number with a full stop is an ordinal.
_BEFORE_ORDINAL = frozenset("der die das den dem des am im vom zum beim ab bis seit".split())
_MATH_OR_NOISE = re.compile(r"\$[^$]*\$|\\\([^)]*\\\)|(?:[^\w$\\]|[\d_])+|[$\\]")
#: Scripts without letter case, in which a mark needs no blank after it.
_IDEOGRAPHIC = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
_ARABIC = re.compile(r"[\u0620-\u064a]")
_DEVANAGARI = re.compile(r"[ऀ-ॿ]")

_UP = "A-ZÀ-ÖØ-ÞЀ-Я"
_DOT = re.compile(r"\.(\s*)([^\W\d_]+|\S)?")
_CAPITAL = re.compile(rf" ([{_UP}]\w+)")
_TOKEN = re.compile(r"\w+\.?")
#: A full stop after a word, after which a sentence may plainly go on.
_GOES_ON = re.compile(r"\.(?<=\w\.)(?=([,;:]|[^\S\n][^\W_]))")
_INSIDE = frozenset("​‌‍⁠﻿­̧̀́̂̃̈")


class _Back:
    """Walks back over the word before a place; what was walked before the last full stop isn't walked again."""

    def __init__(self, text: str):
        self.text, self.stop, self.began = text, -1, 0

    def word(self, i: int, least: int) -> int:
        """Where the word that ends at i begins, least at the earliest; full stops between letters belong to it. i itself if there is none."""
        text, k = self.text, i
        while k > least:
            ch = text[k - 1]
            if ch.isalnum() or ch in _INSIDE:
                k -= 1
            elif ch == "." and k < i and k - 1 > least and text[k - 2].isalpha():
                k -= 1
                if k == self.stop:
                    k = max(self.began, least)
                    break
            else:
                break
        self.stop, self.began = i, k
        while k < i and not text[k].isalpha():
            k += 1
        return k


class Model:
    """abbreviations: words that end in a full stop within sentences. starters: capitalised words that are no names."""

    def __init__(self, abbreviations: Container[str] = frozenset(), starters: Container[str] = frozenset(), names: Container[str] = frozenset()):
        self.abbreviations, self.starters, self.names = abbreviations, starters, names


def evidence(text: str, into: Counter) -> None:
    """Counts ('d', word, kind) of words before full stops, of those ('d', word, 'plain') without one, and ('m' or 'i', word, '') of capitalised words."""
    back, dotted = _Back(text), set()
    for m in _DOT.finditer(text):
        i = m.start()
        b = back.word(i, 0)
        if b == i:
            continue
        word, gap, nxt = text[b:i], m.group(1), m.group(2)
        if any(ch.isdigit() for ch in word):
            continue
        if not nxt or gap.count("\n") > 1:
            kind = "end"
        elif not gap:
            if nxt[0].isalpha():
                continue  # within an abbreviation or a missing blank
            kind = "on" if nxt in ",;:" else "other"
        elif nxt.isdigit() or nxt in "($":
            kind = "num"
        elif nxt[0].islower():
            kind = "on"
        else:
            kind = "up"
            if len(word) > 4 and len(nxt) > 1:
                into["i", nxt, ""] += 1
        into["d", word, kind] += 1
        dotted.add(word)
    if dotted:
        words = Counter(_TOKEN.findall(text))
        for w in dotted:
            if n := words.get(w):
                into["d", w, "plain"] += n
    for m in _CAPITAL.finditer(text):
        i = m.start()
        if i and text[i - 1].isalpha():
            into["m", m.group(1), ""] += 1


class _Words:
    """The words of one kind in the files of a corpus model."""

    def __init__(self, lexicon: Lexicon, kind: str):
        self.lexicon, self.kind = lexicon, kind

    def __contains__(self, word: str) -> bool:
        return self.lexicon.get(self.kind + word) >= 0


def filed_model(name: str) -> Model:
    """The model in the files that corpus_model made; for use in tasks."""
    lexicon = Lexicon(name)
    return Model(*(_Words(lexicon, kind) for kind in "dsn"))


def corpus_model(docs: DataFrame, text: str = "text") -> str:
    """The model of all documents as files, by name: evidence is counted within the tasks and summed by word; words seen three times are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(c: Counter) -> pa.RecordBatch:
            kinds, ws, subs = zip(*c) if c else ((), (), ())
            ws = [fold_visible(w) for w in ws]
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(ws, pa.string()), pa.array(subs, pa.string()), pa.array(list(c.values()), pa.int64())], names=["what", "word", "kind", "n"])

        counts: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                evidence(t, counts)
            if len(counts) > 200_000:
                yield out(counts)
                counts = Counter()
        yield out(counts)

    raw = docs.select(F.col(text).cast("string").alias("text")).where("text is not null").mapInArrow(run, "what string, word string, kind string, n bigint")
    of = lambda *kinds: F.sum(F.when(F.col("kind").isin(*kinds), F.col("n")).otherwise(0))
    per = raw.groupBy(F.when(F.col("what") == "d", "d").otherwise("c").alias("what"), "word").agg(
        F.sum(F.when(F.col("kind") != "plain", F.col("n")).otherwise(0)).alias("n"), of("on", "num").alias("on"), of("end").alias("end"), of("up").alias("up"), of("plain").alias("plain"),
        F.sum(F.when(F.col("what") == "m", F.col("n")).otherwise(0)).alias("mid"), F.sum(F.when(F.col("what") == "i", F.col("n")).otherwise(0)).alias("init"),
    )
    per = written(per, "sentence-counts")  # the texts are read once
    rate = per.where("what = 'd'").agg((F.sum("end") / F.sum("n")).alias("rate"))
    # An abbreviation goes on in most cases and hardly stands without a stop; or it is a title that ends a paragraph far too seldom to be an ordinary word.
    keep = per.where("n >= 3").crossJoin(F.broadcast(rate)).withColumn("p", F.col("end") / F.col("n"))  # one row
    unlikely = keep.withColumn("odds", F.expr("n * (if(p > 0, p * ln(p / rate), 0) + if(p < 1 and rate < 1, (1 - p) * ln((1 - p) / (1 - rate)), 0))"))
    title = (F.col("p") <= TITLE_RATE * F.col("rate")) & (F.col("odds") >= -math.log(BY_CHANCE)) & F.expr("`on` <= 0.1 * n and up >= 0.5 * n")
    seldom_plain = F.col("plain") <= PLAIN_SHARE * F.col("n")
    keep = unlikely.where((F.col("what") == "c") | (seldom_plain & (F.expr("`on` >= 0.5 * n") | title)))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [text_hash(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array([1] * len(hashes), pa.int64())], names=["hash", "n"])

    kind = F.when(F.col("what") == "d", "d").when(F.col("init") > F.col("mid"), "s").otherwise("n")
    return filed(keep.select(F.concat(kind, "word").alias("word")).mapInArrow(hashed, "hash bigint, n bigint"))


class _Doc:
    """What one document itself tells of its words; asked only where a full stop is ambiguous."""

    def __init__(self, text: str, model: Model):
        self.text, self.model, self.thai = text, model, False
        self._names: dict[str, bool | None] = {}
        self._abbr: dict[tuple[str, bool], bool] = {}
        self._on: Counter | None = None
        self.back = _Back("")

    def closed_by_abbreviation(self, p: str, i: int, opened: int) -> bool:
        """Is the full stop at i, the last in a bracket opened within a sentence, one of an abbreviation or a number?"""
        b = self.back.word(i, opened + 1)
        return b == i or i - b == 1 or self.abbreviation(p[b:i])

    def places(self, w: str) -> Iterator[int]:
        """Where a word stands in the document, by itself."""
        t, n = self.text, len(w)
        k = t.find(w)
        while k >= 0:
            if not (k and (t[k - 1].isalnum() or t[k - 1] == "_")) and not t[k + n : k + n + 1].isalnum():
                yield k
            k = t.find(w, k + n)

    def name(self, w: str, unknown: bool) -> bool:
        """Is a capitalised word a name? unknown: what holds for a word that neither document nor corpus tells of."""
        if w not in self._names:
            lower = any(True for _ in self.places(w[0].lower() + w[1:]))
            t = self.text
            here = not lower and any(k > 1 and t[k - 1] == " " and (t[k - 2].isalpha() or t[k - 2] == "," and k > 2 and t[k - 3].isalpha()) for k in self.places(w))
            self._names[w] = False if lower else True if here or w in self.model.names else False if w in self.model.starters else None
        known = self._names[w]
        return unknown if known is None else known

    def abbreviation(self, w: str, goes_on: bool = False) -> bool:
        """Is a word before a full stop an abbreviation? goes_on: at this place the sentence seems to go on.

        The document tells by the word's other places, the corpus where it is silent or divided.
        """
        if "." in w:
            return True
        known = self._abbr.get((w, goes_on))
        if known is None:
            if self._on is None:
                self._on = self._counted()
            on, corpus = max(0, self._on.get(w, 0) - goes_on), w in self.model.abbreviations
            known = False
            if on > 0 or corpus:  # else neither document nor corpus speaks for it
                t, n = self.text, len(w)
                plain = sum(1 for k in self.places(w) if t[k + n : k + n + 1] != ".")
                known = on > plain if on != plain else corpus
            self._abbr[w, goes_on] = known
        return known

    def _counted(self) -> Counter:
        """Words before full stops after which the sentence plainly goes on."""
        t, on = self.text, Counter()
        for m in _GOES_ON.finditer(t):
            after, e = m.group(1), m.start()
            if len(after) == 1 or after[1].islower() or after[1].isdigit():
                k = e
                while k and (t[k - 1].isalnum() or t[k - 1] == "_"):
                    k -= 1
                w = t[k:e]
                if not (len(after) == 2 and after[1].isdigit() and w.lower() == w.upper()):
                    on[w] += 1
        return on


def spans(text: str, model: Model) -> list[tuple[int, int]]:
    """[start, end) of each sentence unit of a text, without blanks at either end."""
    out: list[tuple[int, int]] = []
    doc = _Doc(text, model)
    doc.thai = not text.isascii() and bool(_THAI.search(text))
    at = 0
    for m in _BREAK.finditer(text):
        _paragraph(text, at, m.start(), doc, out)
        at = m.end()
    _paragraph(text, at, len(text), doc, out)
    return out


def _paragraph(text: str, a: int, b: int, doc: _Doc, out: list[tuple[int, int]]) -> None:
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    if a == b:
        return
    p = text[a:b]
    doc.back = _Back(p)
    cuts = _cuts(p, doc)
    if doc.thai and _THAI.search(p):
        cuts = _thai(p, cuts)
    s = 0
    for e in cuts:
        while s < e and p[s].isspace():
            s += 1
        end = e
        while end > s and p[end - 1].isspace():
            end -= 1
        if end > s:
            out.append((a + s, a + end))
        s = e
    while s < len(p) and p[s].isspace():
        s += 1
    if s < len(p):
        out.append((a + s, b))


def _thai(p: str, cuts: list[int]) -> list[int]:
    """Thai sets no end marks: a blank beside Thai text ends the unit, unless it follows a list mark."""
    more = set(cuts)
    # Formulas, numbers and signs show no script: the letters beyond them do.
    begins: list[int] = []
    ends: list[int] = []
    for m in _MATH_OR_NOISE.finditer(p):
        if ends and ends[-1] == m.start():
            ends[-1] = m.end()
        else:
            begins.append(m.start())
            ends.append(m.end())
    at, last = 0, 0
    for m in _THAI_GAP.finditer(p):
        while at < len(cuts) and cuts[at] <= m.start():
            last = max(last, cuts[at])
            at += 1
        n = bisect_left(begins, m.start()) - 1
        k = begins[n] if n >= 0 and ends[n] >= m.start() else m.start()
        left = p[k - 1 : k] if k else ""
        n = bisect_right(begins, m.end()) - 1
        k = ends[n] if n >= 0 and ends[n] > m.end() else m.end()
        right = p[k : k + 1]
        nxt = p[m.end() : m.end() + 1]
        if nxt == "\n" or p[m.start() - 1 : m.start()] == "\n":
            continue  # a blank beside a line break belongs to it
        if not (left and _THAI.match(left) or right and _THAI.match(right) and _THAI.match(nxt)):
            continue
        if _LIST_MARK.fullmatch(p[max(p.rfind("\n", 0, m.start()) + 1, last) : m.end()].lstrip()[:8] or "x"):
            continue
        if nxt in "–—-" or p[m.start() - 1] in "–—-":
            continue
        more.add(m.start())
        last = m.start()
    return sorted(more)


def _cuts(p: str, doc: _Doc) -> list[int]:
    marks = list(_MARK.finditer(p))
    if not marks:
        return []
    n = len(p)
    quoted = [(m.start(), m.end()) for m in _QUOTED.finditer(p)]
    cuts: list[int] = []
    start, qi = 0, 0
    for m in marks:
        i, j = m.span()
        if i < start:
            continue
        while qi < len(quoted) and quoted[qi][1] <= i:
            qi += 1
        opened = None
        if qi < len(quoted) and quoted[qi][0] < i:
            qs, qe = quoted[qi]
            if p[j:qe].strip() != p[qe - 1]:
                continue  # within a quotation or bracket that goes on
            opened, j = qs, qe
            while j < n and p[j] in _CLOSERS and p[j] not in "“«":
                j += 1
        last = m.group()[-1]
        k = j
        while k < n and p[k].isspace():
            k += 1
        if k == n:
            cuts.append(n)
            break
        if _ends(p, i, j, k, last, m.group(), opened, start, doc):
            cuts.append(j)
            start = k
    return cuts


def _ends(p: str, i: int, j: int, k: int, last: str, mark: str, opened: int | None, start: int, doc: _Doc) -> bool:
    """Does the mark at i, which with closing quotes reaches to j and is followed by text at k, end the unit begun at start?"""
    nxt, blank = p[k], k > j
    if last in "。！？｡":
        if opened is None:
            return True
        if p[opened] in "(（[":
            return p[start:opened].strip() == ""
        if "぀" <= nxt <= "ゟ":  # a particle goes on after the quotation
            return False
        return p[start:opened].strip() != ""
    if last in "।॥":
        return opened is None or p[start:opened].strip() != ""
    if last in "؟۔":
        return blank and (opened is None or p[start:opened].strip() != "")
    if not blank:
        return mark in ".!?" and _blank_missing(p, i, k, last, start, doc)
    if opened is not None:
        if nxt.islower():
            return False
        whole = p[start:opened].strip() == ""
        if whole and p[opened] not in "([（" and not nxt.isupper() and nxt.isalpha():
            return False  # a script without case: "...?" asked the pupil
        if last == "." and p[opened] in "([" and not whole and doc.closed_by_abbreviation(p, i, opened):
            return False
        return True
    if last in "!?":
        return True
    if last == "…" or len(mark) > 1:
        return not (nxt.islower() or nxt in ",;:)")
    if i and _DEVANAGARI.match(p[i - 1]):
        return False
    if i - start < 8 and _LIST_NUMBER.fullmatch(p[start:i].strip()):
        return False  # the mark of a list item
    new_item = "\n" in p[j:k] and _LIST_MARK.match(p, k)
    if p[i - 1].isdigit() if i else False:
        if new_item:
            return True
        if nxt.islower():
            return False
        return not (nxt.isupper() and _ordinal(p, i, start))
    w = doc.back.word(i, start)
    if w == i:
        return True
    raw = p[w:i]
    word = raw if raw.isascii() else fold_visible(raw)
    if len(word) == 1:
        if word.isupper():
            if nxt.isdigit() and not new_item:
                return False
            e = w
            while e > start and p[e - 1].isspace():
                e -= 1
            initial = e == start or p[e - 1] == "." or e - start < 8 and bool(_LIST_MARK.fullmatch(p[start:e] + " "))
            return not (initial and nxt.isalpha())
        return "α" <= word <= "ω"
    if not doc.abbreviation(word, nxt.islower() or nxt.isdigit()):
        return True
    if nxt.islower() or nxt.isdigit() and not new_item or nxt in "([$\\<>=≤≥":
        return False
    if not nxt.isupper():
        return bool(new_item) or nxt in "\"“„«¿¡"
    v = _NEXT_WORD.match(p, k).group()
    v = v if v.isascii() else fold_visible(v)
    if len(v) == 1:
        return not p[k + 1 : k + 2] == "."
    return not doc.name(v, "." not in word)


def _ordinal(p: str, i: int, start: int) -> bool:
    """Is the number that ends at i an ordinal, as in "am 3. Mai"?"""
    k = i
    while k > start and p[k - 1].isdigit():
        k -= 1
    e = k
    while e > start and p[e - 1].isspace():
        e -= 1
    b = e
    while b > start and p[b - 1].isalpha():
        b -= 1
    return i - k <= 3 and e < k and p[b:e].lower() in _BEFORE_ORDINAL


def _blank_missing(p: str, i: int, k: int, last: str, start: int, doc: _Doc) -> bool:
    """Does the mark at i end a sentence although the next, at k, follows at once? Then that begins with a capitalised word."""
    if i == 0:
        return False
    before, nxt = p[i - 1], p[k]
    if _ARABIC.match(nxt):
        return bool(_ARABIC.match(before)) and i > 1 and bool(_ARABIC.match(p[i - 2]))
    after = p[k + 1 : k + 3]
    if not nxt.isupper() or not (after[:1].islower() or after[:1].isspace() and after[1:].islower()):
        return False
    if last in "!?" or before.isdigit() or before in "$)]" or "α" <= before <= "ω":
        return True
    w = doc.back.word(i, start)
    if i - w == 1 and before.isupper():
        return not p[start:w].rstrip().endswith(".") and p[start:w].strip() != ""
    return i - w > 1 and not doc.abbreviation(p[w:i])


def sentence_units(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """(doc_id, unit_no, start_char, end_char, unit) of every sentence unit, in order.

    Positions count code points of the stored text. Null, empty and blank texts have no unit; documents are independent,
    so repeated keys and rows give repeated units. Without a model the corpus is counted first.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or corpus_model(docs, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value if isinstance(shared.value, Model) else filed_model(shared.value)
        for b in batches:
            at, no, starts, ends, units = [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for k, (s, e) in enumerate(spans(t, m)):
                    at.append(i)
                    no.append(k)
                    starts.append(s)
                    ends.append(e)
                    units.append(t[s:e])
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, y) for x, y in zip((no, starts, ends, units), kinds))], names=["doc_id", "unit_no", "start_char", "end_char", "unit"])

    src = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text")).where("text is not null")
    return src.mapInArrow(run, "doc_id bigint, unit_no int, start_char int, end_char int, unit string")
