"""Problem 6: evaluation texts inside the training text.

Each training shard (a run of documents inside one task) is indexed once: its words become numbers of the vocabulary of
the test phrases, runs of such words are sorted into a suffix array, and an FM-index with a wavelet tree answers rank
queries. All phrases of twelve words are then searched backwards at once; occurrences are located from sampled suffix
positions and merged into spans per document and item.

A match of twelve words has only words of the test vocabulary, so words outside it end a run, and runs shorter than a
phrase hold no match: they are left out of the index without loss.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.forms import fold_visible, ignorable

#: Words after which a shard is indexed and searched, so that a task holds one shard at a time.
SHARD_WORDS = 4_000_000
#: Test items that are searched for at once in a shard's index.
ITEMS_AT_ONCE = 20_000
#: One of so many suffix positions is kept.
SAMPLE = 8

_CUT = re.compile(r"(?<=[^\W\d_])[-‐¬­]­?[^\S\n]*\n\s*(?=[^\W\d_])")
_NOTE = re.compile(r"\[\d{1,3}\]|\(\d{1,3}\)(?=[A-Za-z])|[¹²³⁰-⁹]+|[*†‡§]+")
_IN_NUMBER = re.compile(r"(?<=\d)[.,'’   ](?=\d)")
_WORD = re.compile(r"[^\W_]+(?:\x00+[^\W_]+)*")


def _blank(m: re.Match) -> str:
    return "\0" * len(m.group())


def _marked(text: str) -> str:
    """Text with line-end cuts and marks inside numbers replaced by NUL, notes by blanks; lengths stay."""
    if "\n" in text:
        text = _CUT.sub(_blank, text)
    text = _NOTE.sub(lambda m: " " * len(m.group()), text)
    return _IN_NUMBER.sub(_blank, text)


def words(text: str) -> list[str]:
    """Words of a text apart from case, punctuation, layout, words cut at line ends, note marks and disguised characters."""
    t = _marked(text if text.isascii() else fold_visible(text.replace("­\n", "-\n"))).lower()
    found = _WORD.findall(t)
    return [w.replace("\0", "") for w in found] if "\0" in t else found


def word_spans(text: str) -> list[tuple[int, int]]:
    """Where each of words(text) stands in the stored text."""
    chars, at = [], []
    src = text if text.isascii() else text.replace("­\n", "-\n")
    k = 0
    while k < len(src):
        j = k + 1
        while j < len(src) and not src[j].isascii() and (ignorable(src[j]) or unicodedata.combining(src[j])):
            j += 1  # accents and invisible characters belong to the character before them
        f = fold_visible(src[k:j])
        chars.append(f)
        at.extend([(k, j)] * len(f))
        k = j
    folded = _marked("".join(chars))
    return [(at[m.start()][0], at[m.end() - 1][1]) for m in _WORD.finditer(folded)]


class Bits:
    """Bits in words of 64 with the number of ones before each word: a rank is one lookup and one count of bits."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        packed = np.packbits(bits.astype(np.uint8), bitorder="little")
        self.words = np.frombuffer(packed.tobytes() + bytes(-len(packed) % 8 + 8), dtype=np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))[:-1].astype(np.int32)

    def rank(self, pos: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        w, rest = pos >> 6, (pos & 63).astype(np.uint64)
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << rest) - np.uint64(1)))

    def get(self, pos: np.ndarray) -> np.ndarray:
        return (self.words[pos >> 6] >> (pos & 63).astype(np.uint64)) & np.uint64(1)


class WaveletTree:
    """Rank over a sequence of numbers below 2**levels: bits of the value, highest first, stably sorted at each level."""

    def __init__(self, seq: np.ndarray, levels: int):
        self.levels, self.bits, self.zeros = levels, [], []
        for k in range(levels - 1, -1, -1):
            bit = (seq >> k) & 1
            self.bits.append(Bits(bit))
            self.zeros.append(len(seq) - int(bit.sum()))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, symbol: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position; both arrays have one entry a query."""
        lo = np.zeros_like(pos)
        for k in range(self.levels):
            bit = (symbol >> (self.levels - 1 - k)) & 1
            a, b = self.bits[k].rank(lo), self.bits[k].rank(pos)
            lo = np.where(bit == 1, self.zeros[k] + a, lo - a)
            pos = np.where(bit == 1, self.zeros[k] + b, pos - b)
        return pos - lo

    def get(self, pos: np.ndarray) -> np.ndarray:
        """The number at each position."""
        out = np.zeros_like(pos)
        for k in range(self.levels):
            bit, ones = self.bits[k].get(pos).astype(np.int64), self.bits[k].rank(pos)
            out = 2 * out + bit
            pos = np.where(bit == 1, self.zeros[k] + ones, pos - ones)
        return out


class FmIndex:
    """FM-index of a sequence of word numbers, in which 0 ends a run. Only the wavelet tree and the sampled positions are kept."""

    def __init__(self, seq: np.ndarray, sigma: int, sample: int = SAMPLE):
        self.n = len(seq)
        order = _suffixes(seq)
        last = seq[order - 1]
        self.tree = WaveletTree(last, max(1, int(sigma).bit_length()))
        self.less = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=sigma + 1))))
        keep = (order % sample == 0) | (last == 0)  # where a run begins the walk stops as well
        self.kept, self.sampled = Bits(keep), order[keep].astype(np.int32)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of suffixes that begin with each row of phrases, found backwards for all rows at once."""
        lo = np.zeros(len(phrases), dtype=np.int64)
        hi = np.full(len(phrases), self.n, dtype=np.int64)
        left = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            s = phrases[left, k].astype(np.int64)
            a, b = self.less[s] + self.tree.rank(s, lo[left]), self.less[s] + self.tree.rank(s, hi[left])
            lo[left], hi[left] = a, np.maximum(a, b)
            left = left[b > a]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes: steps back through the text until a sampled one is met."""
        rows, steps, out = rows.copy(), 0, np.full(len(rows), -1, dtype=np.int64)
        left = np.arange(len(rows))
        while len(left):
            at = rows[left]
            here = self.kept.get(at) == 1
            out[left[here]] = self.sampled[self.kept.rank(at[here])] + steps
            left, at = left[~here], at[~here]
            s = self.tree.get(at)
            rows[left] = self.less[s] + self.tree.rank(s, at)
            steps += 1
        return out


def _suffixes(seq: np.ndarray) -> np.ndarray:
    """Suffix array by doubling; every 0 counts as an end of its own, in order of position."""
    n = len(seq)
    ends = np.flatnonzero(seq == 0)
    rank = seq.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    k = 1
    while True:
        second = np.full(n, 0, dtype=np.int64)
        second[: n - k] = rank[k:] + 1 if k < n else 0
        pair = rank * (n + len(ends) + int(seq.max(initial=0)) + 2) + second
        order = np.argsort(pair, kind="stable")
        new = np.empty(n, dtype=np.int64)
        new[order] = np.concatenate(([0], np.cumsum(np.diff(pair[order]) != 0)))
        if new[order[-1]] == n - 1:
            return order
        rank, k = new, 2 * k


class Phrases:
    """All phrases of `size` words of a block of items, as numbers of a vocabulary."""

    def __init__(self, items: list[tuple[int, str]], size: int, ids: dict[str, int]):
        rows, owners = [np.zeros((0, size), dtype=np.int32)], [np.zeros(0, dtype=np.int64)]
        for item, text in items:
            w = np.array([ids[x] for x in words(text)], dtype=np.int32)
            if len(w) >= size:
                rows.append(np.lib.stride_tricks.sliding_window_view(w, size))
                owners.append(np.full(len(w) - size + 1, item, dtype=np.int64))
        every = np.concatenate(rows)
        # Rows as single values of bytes: equal phrases of several items become one.
        _, first, which = np.unique(every.view(f"V{4 * size}").ravel(), return_index=True, return_inverse=True)
        self.size, self.rows = size, every[first]
        self.owners = np.concatenate(owners)[np.argsort(which, kind="stable")]
        self.begin = np.concatenate(([0], np.cumsum(np.bincount(which, minlength=len(first)))))

    def items(self, p: int) -> set[int]:
        """The items that have a phrase."""
        return set(self.owners[self.begin[p] : self.begin[p + 1]].tolist())


class _Shard:
    """Runs of vocabulary words of some documents."""

    def __init__(self, ids: dict[str, int], size: int):
        self.ids, self.size, self.n = ids, size, 0
        # One entry a run: its document, its first word and where it begins.
        self.seq, self.doc, self.word, self.begin = array("i", [0]), array("q"), array("i"), array("q")

    def add(self, doc: int, text: str) -> bool:
        """Whether the document has a run that may hold a phrase."""
        ids, size = self.ids, self.size
        numbers = [ids.get(w, 0) for w in words(text)]
        self.n += len(numbers)
        if len(numbers) < size:
            return False
        a = np.array(numbers + [0], dtype=np.int32)
        ends = np.flatnonzero(a == 0)
        begin = np.concatenate(([0], ends[:-1] + 1))
        long = ends - begin >= size
        for b, e in zip(begin[long].tolist(), ends[long].tolist()):
            self.doc.append(doc)
            self.word.append(b)
            self.begin.append(len(self.seq))
            self.seq.frombytes(a[b : e + 1].tobytes())
        return bool(long.any())

    def index(self) -> FmIndex | None:
        return FmIndex(np.frombuffer(self.seq, dtype=np.int32), len(self.ids)) if len(self.begin) else None

    def hits(self, fm: FmIndex, phrases: Phrases) -> Iterator[tuple[int, int, int, int]]:
        """(doc, item, first word, end word) of each merged span."""
        if not len(phrases.rows):
            return
        lo, hi = fm.search(phrases.rows)
        found = np.flatnonzero(hi > lo)
        counts = (hi - lo)[found]
        rows = np.repeat(lo[found], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        at = fm.locate(rows)
        run = np.searchsorted(np.frombuffer(self.begin, dtype=np.int64), at, side="right") - 1
        docs = np.frombuffer(self.doc, dtype=np.int64)[run]
        firsts = np.frombuffer(self.word, dtype=np.int32)[run] + at - np.frombuffer(self.begin, dtype=np.int64)[run]
        spans: dict[tuple[int, int], list[int]] = {}
        for p, doc, word in zip(np.repeat(found, counts).tolist(), docs.tolist(), firsts.tolist()):
            for item in phrases.items(p):
                spans.setdefault((doc, item), []).append(word)
        for (doc, item), starts in spans.items():
            starts = sorted(set(starts))
            b = e = starts[0]
            for s in starts[1:]:
                if s > e + self.size:
                    yield doc, item, b, e + self.size
                    b = s
                e = s
            yield doc, item, b, e + self.size


def _blocks(items: DataFrame, key: str, text: str, at_once: int) -> tuple[dict[str, int], list[Broadcast]]:
    """(numbers of the items' words, the items in broadcast blocks): the driver holds the vocabulary and one block at a time."""
    sc = items.sparkSession.sparkContext
    ids: dict[str, int] = {}
    blocks, block = [], []
    for r in items.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(key, text).toLocalIterator():
        block.append((r[0], r[1]))
        for w in words(r[1]):
            ids.setdefault(w, len(ids) + 1)
        if len(block) == at_once:
            blocks.append(sc.broadcast(block))
            block = []
    return ids, [*blocks, sc.broadcast(block)] if block else blocks


def leaked(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", size: int = 12, at_once: int = ITEMS_AT_ONCE, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, item_id, first_word, end_word, start_char, end_char): spans of at least `size` words of an item in a document.

    The spans are what to remove; positions count code points of the stored text. Null texts and keys match nothing, an
    item of fewer words than `size` neither. The corpus is read once; each shard is indexed once and searched for the test
    items, a stated set, block by block, of which a task holds one at a time beside the index and the vocabulary.
    """
    schema = "doc_id bigint, item_id bigint, first_word int, end_word int, start_char int, end_char int"
    src = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text")).where("key is not null and text is not null")
    ids, blocks = _blocks(items, item_key, item_text, at_once)
    vocabulary = docs.sparkSession.sparkContext.broadcast(ids)
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
    names = ["doc_id", "item_id", "first_word", "end_word", "start_char", "end_char"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = vocabulary.value
        only = Phrases(blocks[0].value, size, ids) if len(blocks) == 1 else None

        def found(shard: _Shard, kept: dict[int, tuple[int, str]]) -> Iterator[pa.RecordBatch]:
            fm = shard.index()
            where: dict[int, list[tuple[int, int]]] = {}
            for block in blocks if fm else ():
                rows = []
                for n, item, b, e in shard.hits(fm, only or Phrases(block.value, size, ids)):
                    doc, t = kept[n]
                    if n not in where:
                        where[n] = word_spans(t)
                    rows.append((doc, item, b, e, where[n][b][0], where[n][e - 1][1]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        shard, kept, n = _Shard(ids, size), {}, 0
        for b in batches:
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if shard.add(n, t):
                    kept[n] = (doc, t)
                n += 1
                if shard.n >= shard_words:
                    yield from found(shard, kept)
                    shard, kept = _Shard(ids, size), {}
        yield from found(shard, kept)

    return src.mapInArrow(run, schema)
