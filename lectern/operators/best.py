"""The best rows of many queries at once, kept in a task while rows pass by."""

from __future__ import annotations

import numpy as np

#: Queries that are compared with a batch of rows at once.
QUERIES_AT_ONCE = 4_096
#: Values (queries times rows) that a task holds at once: 16 MB.
CELLS = 2_000_000
#: Values closer than this may agree in the nine digits by which rows are ordered.
SLACK = 1e-9


def rows_at_once(n_queries: int) -> int:
    return max(16, CELLS // max(1, n_queries))


def _ranked(q: np.ndarray, key: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by query, value and key, and the place of each in its query."""
    by = np.unique(key, return_inverse=True)[1] if key.dtype == object else key
    order = np.lexsort((by, np.round(d, 9), q))
    sorted_q = q[order]
    starts = np.flatnonzero(np.concatenate((np.full(min(1, len(q)), True), sorted_q[1:] != sorted_q[:-1])))
    return order, np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))


class Best:
    """The k rows of least value of each query seen so far, as flat arrays; values that agree in nine digits go by key."""

    def __init__(self, k: int, n_queries: int):
        self.k, self.edge = k, np.full(n_queries, np.inf)
        self.most = max(200_000, 2 * k * n_queries)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, which: np.ndarray, keys: np.ndarray, d: np.ndarray, below: float = np.inf) -> None:
        """d: values of the queries `which` for the rows `keys`; those not under `below` are no candidates. Queries come once in which."""
        k = self.k
        top = np.minimum(self.edge[which] + SLACK, np.nextafter(below, -np.inf) if below < np.inf else np.finfo(float).max)
        if d.shape[1] > k:
            unset = np.flatnonzero(np.isinf(self.edge[which]))
            unset = unset[(d[unset] <= top[unset, None]).sum(axis=1) > k] if len(unset) else unset
            if len(unset):
                top[unset] = np.minimum(top[unset], np.partition(d[unset], k - 1, axis=1)[:, k - 1] + SLACK)
        at = np.flatnonzero(d <= top[:, None])  # with all ties at the edge
        if not len(at):
            return
        i, j = np.divmod(at, d.shape[1])
        self.parts.append((which[i], keys[j], d.ravel()[at]))
        self.waiting += len(at)
        if self.waiting > self.most or np.isinf(self.edge[which]).any() and self.waiting > k * len(which):
            self.settle()

    def add_some(self, which: np.ndarray, keys: np.ndarray, d: np.ndarray) -> None:
        """d: the value of the query and the row at each place; a query and a row come together once."""
        at = np.flatnonzero(d <= self.edge[which] + SLACK)
        if len(at):
            self.parts.append((which[at], keys[at], d[at]))
            self.waiting += len(at)
            if self.waiting > self.most:
                self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(queries, keys, values) of what is kept."""
        if not self.parts:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        q, key, d = (np.concatenate(x) for x in zip(*self.parts))
        order, place = _ranked(q, key, d)
        last = order[place == self.k - 1]
        self.edge[q[last]] = d[last]
        kept = order[place < self.k]
        self.parts = [(q[kept], key[kept], d[kept])]
        self.waiting = 0
        return self.parts[0]


def merged(k: int, some: tuple[np.ndarray, np.ndarray, np.ndarray], more: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query of two lists (queries, keys, values); of a key in both, the first list has the value."""
    q, key, d = (np.concatenate(x) for x in zip(some, more))
    again = np.concatenate((np.zeros(len(some[0]), np.int8), np.ones(len(more[0]), np.int8)))
    by = np.unique(key, return_inverse=True)[1]
    order = np.lexsort((again, by, q))
    once = np.concatenate((np.full(min(1, len(q)), True), (q[order][1:] != q[order][:-1]) | (by[order][1:] != by[order][:-1])))
    q, key, d = q[order][once], key[order][once], d[order][once]
    order, place = _ranked(q, key, d)
    kept = order[place < k]
    return q[kept], key[kept], d[kept]
