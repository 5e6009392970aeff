"""Quality rules: gradient-boosted trees over document statistics.

Trees are fitted in numpy on a bounded sample of labelled rows and flattened into node arrays, so a batch of documents
walks all trees level by level without a loop over rows. Symbols, repeated lines, repeated words and exclamation marks
are constrained to never raise the score.

Null and empty texts have no words and fail. Without any labelled row the trees keep every text that passes the fixed
rules. Repeated rows give repeated rows, an empty table none; columns other than id and text are ignored (keep_good keeps
them), whatever their names. Texts of any length are counted whole; ties at the threshold are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexiflume.llm.textstats import COUNTS, RATIOS, labelled, stats
from lexiflume.llm.words import WordHash

#: -1: more of it never raises the score.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "bang_share": -1}
#: Texts below this probability of quality 1 are rejected.
KEEP_AT = 0.3
FOLDS = 5
#: Texts that a task holds as strings at once.
AT_ONCE = 500


@dataclass
class Trees:
    """Flattened trees: row t holds the nodes of tree t; children of node i are 2i + 1 and 2i + 2."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    start: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.cut[t, node])
            total += self.value[t, node]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, signs: np.ndarray, n_trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, l2: float = 2.0) -> Trees:
    """Newton boosting of the logistic loss on binned features. A split whose leaves break a sign is not taken, and
    bounds between the two sides are handed down, so whole trees are monotone."""
    n, m = x.shape
    mean = (y.sum() + 1) / (n + 2)
    start, nodes = float(np.log(mean / (1 - mean))), 2 ** (depth + 1) - 1
    feature, cut, value = np.zeros((n_trees, nodes), np.int64), np.full((n_trees, nodes), np.inf), np.zeros((n_trees, nodes))
    if not n or y.min() == y.max():
        return Trees(feature[:0], cut[:0], value[:0], start if n else 0.0, depth)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    margin = np.full(n, start)
    for t in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        at, low, high = np.zeros(n, np.int64), np.full(nodes, -np.inf), np.full(nodes, np.inf)
        for level in range(depth):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.nonzero(at == node)[0]
                best, gain0 = None, (g[rows].sum() ** 2) / (h[rows].sum() + l2)
                for f in range(m if len(rows) >= 20 else 0):
                    gl = np.cumsum(np.bincount(binned[rows, f], g[rows], len(edges[f]) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[rows, f], h[rows], len(edges[f]) + 1))[:-1]
                    if not len(gl):
                        continue
                    gr, hr = g[rows].sum() - gl, h[rows].sum() - hl
                    vl, vr = np.clip(gl / (hl + l2), low[node], high[node]), np.clip(gr / (hr + l2), low[node], high[node])
                    gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - gain0
                    gain[(hl < 1) | (hr < 1) | (signs[f] * (vr - vl) < 0)] = -np.inf
                    b = int(np.argmax(gain))
                    if gain[b] > 1e-3 and (best is None or gain[b] > best[0]):
                        best = (gain[b], f, b, vl[b], vr[b])
                left, right = 2 * node + 1, 2 * node + 2
                low[[left, right]], high[[left, right]] = low[node], high[node]
                if best is None:
                    at[rows] = left
                    continue
                _, f, b, vl, vr = best
                feature[t, node], cut[t, node] = f, edges[f][b]
                at[rows] = np.where(binned[rows, f] > b, right, left)
                if signs[f]:
                    middle = (vl + vr) / 2
                    (low if signs[f] < 0 else high)[left] = middle
                    (high if signs[f] < 0 else low)[right] = middle
        leaf = np.bincount(at, g, nodes) / (np.bincount(at, h, nodes) + l2)
        value[t] = rate * np.clip(leaf, low, high)
        margin += value[t][at]
    return Trees(feature, cut, value, start, depth)


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most AT_ONCE, so that strings and kept rows of a large batch are never all there twice."""
    for b in batches:
        for at in range(0, b.num_rows, AT_ONCE):
            yield b.slice(at, AT_ONCE)


def learn(documents: DataFrame, labels: DataFrame, **options) -> Trees:
    def measure(batches):
        memo = WordHash()
        for b in _few(batches):
            rows = [stats(t, memo)[1] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([list(map(float, r)) for r in rows], pa.list_(pa.float64())), b.column("y")], ["x", "y"])

    got = labelled(documents, labels, "quality", FOLDS).mapInArrow(measure, "x array<double>, y int").toPandas()
    x = np.array(got["x"].tolist(), float).reshape(-1, len(RATIOS))
    order = np.lexsort([*x.T, got["y"].to_numpy()])  # the sample's order never matters
    return fit_trees(x[order], got["y"].to_numpy(float)[order], np.array([MONOTONE.get(r, 0) for r in RATIOS]), **options)


_OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def _judge(trees: Trees, texts: list[str | None], memo: WordHash) -> list[pa.Array]:
    rows = [stats(t, memo)[:2] for t in texts]
    counts = np.array([r[0] for r in rows], np.int64).reshape(-1, len(COUNTS))
    score = trees.score(np.array([r[1] for r in rows], float).reshape(-1, len(RATIOS)))
    failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
    return [*(pa.array(c) for c in counts.T), pa.array(failed), pa.array(~failed & (score >= KEEP_AT)), pa.array(score)]


def quality_rules(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept and the trees' score."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    trees = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def judge(batches):
        memo = WordHash()
        for b in _few(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *_judge(trees.value, b.column("text").to_pylist(), memo)], ["doc_id", *COUNTS, "base_failed", "kept", "score"])

    return docs.mapInArrow(judge, "doc_id long, " + _OUT)


def keep_good(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that quality_rules keeps, with all their columns."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    trees = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))
    at = documents.columns.index(text_col)

    def judge(batches):
        memo = WordHash()
        for b in _few(batches):
            yield b.filter(_judge(trees.value, b.column(at).to_pylist(), memo)[-2])

    return documents.mapInArrow(judge, documents.schema)
