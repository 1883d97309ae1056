"""Interfaces of the models a deployment plugs in, with deterministic stand-ins that need no network.

Each is a function of pandas series wrapped as an Arrow function; a model is loaded once per Python worker.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts whose words are held at once.
TEXTS_AT_ONCE = 4_000


def loaded_once(load: Callable[[], Callable[[pd.Series], pd.Series]], kind: str):
    """An iterator function that calls load() once in each task and applies its result to every batch."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for b in batches:
            yield model(b)

    return F.pandas_udf(run, kind)


def hashed_embedder(dim: int = 64) -> Callable[[], Callable[[pd.Series], pd.Series]]:
    """Stand-in embedder: each word adds or takes one from a place, both told by its MD5; of unit length, or zero without words."""

    def load():
        class Places(dict):
            """Where a word adds one, or dim further where it takes one."""

            def __missing__(self, w: str) -> int:
                h = hashlib.md5(w.encode("utf-8", "surrogatepass")).hexdigest()
                at = self[w] = int(h[:4], 16) % dim + (0 if h[4] >= "8" else dim)
                return at

        places, width = Places({"": 2 * dim}), 2 * dim + 1  # blanks at an edge leave an empty word

        def embed(texts: pd.Series) -> pd.Series:
            out = []
            for low in range(0, len(texts), TEXTS_AT_ONCE):
                if len(places) > 500_000:
                    places.clear()
                    places[""] = 2 * dim
                lists = pc.utf8_split_whitespace(pa.array([(t or "").lower() for t in texts.iloc[low : low + TEXTS_AT_ONCE]], pa.large_string()))
                words = lists.flatten().dictionary_encode()
                place = np.fromiter(map(places.__getitem__, words.dictionary.to_pylist()), np.int64, len(words.dictionary))
                doc = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
                n = np.bincount(doc * width + place[words.indices.to_numpy()], minlength=len(lists) * width).reshape(-1, width)
                v = (n[:, :dim] - n[:, dim : 2 * dim]).astype(float)
                size = np.sqrt((v * v).sum(axis=1))
                out.extend(v / np.where(size > 0, size, 1)[:, None])
            return pd.Series(out)

        return embed

    return load


def embedding(text: Column, load=None) -> Column:
    return loaded_once(load or hashed_embedder(), "array<double>")(text)


def retried(call: Callable[[str], str], tries: int = 5, first: float = 2.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str | None]:
    """call with exponential pauses after failures; None when all tries fail."""

    def run(x: str) -> str | None:
        for n in range(tries):
            try:
                return call(x)
            except Exception:
                if n + 1 < tries:
                    sleep(min(first * 2**n, most))
        return None

    return run


def remote(call: Callable[[str], str], tries: int = 5, first: float = 2.0):
    """A column function of a remote text model: one call a row, with retries; null when it fails."""

    def load():
        one = retried(call, tries, first)
        return lambda texts: texts.map(lambda t: None if t is None else one(t))

    return loaded_once(load, "string")


def extractive_answer(query: Column, context: Column) -> Column:
    """Stand-in generator: the beginning of the context as the answer."""
    return F.when(F.coalesce(F.trim(context), F.lit("")) == "", F.lit("No relevant information was found.")).otherwise(F.concat(F.lit("According to the sources:\n"), F.substring(context, 1, 500)))


def in_scope(query: Column, vocabulary: list[str]) -> Column:
    """Stand-in scope check: the query holds a word of the field; without a vocabulary all is in scope."""
    low = F.lower(F.coalesce(query, F.lit("")))
    hit = F.lit(not vocabulary)
    for w in vocabulary:
        hit = hit | F.contains(low, F.lit(w))
    return hit
