"""The best k of each query, kept while batches pass by; runs inside Arrow batches on the executors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Scores (8 bytes each) that a task holds at once: queries times rows of a batch.
CELLS = 4_000_000


class Best:
    """Greatest score first, by six decimal places as rankings go; ties by key. What has a score of -inf never enters."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.keys: list[np.ndarray] = [np.zeros(0, np.int64)] * n_queries
        self.scores: list[np.ndarray] = [np.zeros(0)] * n_queries
        #: The last of each query once it has k: what ranks below can't enter.
        self.worst, self.worst_key = np.full(n_queries, -np.inf), np.zeros(n_queries, np.int64)

    def add(self, keys: np.ndarray, scores: np.ndarray, rows: np.ndarray | None = None) -> None:
        """scores: a row for each query (or for each of those in rows), a column for each key."""
        if not len(keys) or not len(scores) or self.k <= 0:
            return
        by = np.round(scores, 6)
        worst = self.worst if rows is None else self.worst[rows]
        top = by.max(1)
        for i in np.flatnonzero((top >= worst) & (top > -np.inf)):
            q = i if rows is None else rows[i]
            own = by[i]
            least = max(worst[i], np.partition(own, len(keys) - self.k)[len(keys) - self.k] if len(keys) > self.k else -np.inf)
            at = np.flatnonzero((own >= least) & (own > -np.inf))
            k, s = np.concatenate([self.keys[q], keys[at]]), np.concatenate([self.scores[q], scores[i, at]])
            if len(k) >= self.k:
                best = np.lexsort((k, -np.round(s, 6)))[: self.k]
                k, s = k[best], s[best]
                self.worst[q], self.worst_key[q] = np.round(s[-1], 6), k[-1]
            self.keys[q], self.scores[q] = k, s

    def start(self, floor: np.ndarray) -> None:
        """Each query is known to have k scores of at least its floor, so lower ones never enter."""
        self.worst, self.worst_key = np.maximum(self.worst, floor), np.full(len(floor), np.iinfo(np.int64).max)

    def closed(self, bound: np.ndarray, least_key: np.ndarray | int) -> np.ndarray:
        """Queries that nothing enters whose score is at most the bound; nor at it, if its key is least_key or greater."""
        most = np.round(bound + 1e-9 * (1 + np.abs(bound)), 6)  # a margin above the rounding error of sums
        return (most < self.worst) | ((most == self.worst) & (least_key > self.worst_key))

    def batch(self, ids: np.ndarray, names: tuple[str, str, str]) -> pa.RecordBatch:
        """Rows (query, key, score); ids are the queries'."""
        at = np.repeat(np.arange(len(ids)), [len(k) for k in self.keys])
        return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(np.concatenate([np.zeros(0, np.int64), *self.keys])), pa.array(np.concatenate([np.zeros(0), *self.scores]))], list(names))
