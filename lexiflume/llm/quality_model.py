"""Quality classifier: a factorisation machine over hashed words, structure statistics and the text's length.

score = sigmoid(b + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]); the last term, by the
sum-of-squares identity, covers all pairs of features in time linear in their number. Fitted in numpy on a bounded
sample of labelled rows; every row is scored.

Labels, lang, source and doc_id are no inputs of a score. Null and empty texts are scored from their (zero)
statistics, texts of any length whole. Without labelled rows every score is 0.5. Repeated rows give repeated rows, an empty table
none; other columns are ignored, whatever their names. Scores do not depend on how rows are partitioned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexiflume.llm.textstats import RATIOS, labelled, stats
from lexiflume.llm.words import WordHash

BUCKETS, RANK, FOLDS, PREDICT_AT = 1 << 13, 6, 5, 0.3
#: Bits of a word's hash that give its bucket.
_SHIFT = np.uint64(64 - 13)


def features(texts: list[str | None], memo: WordHash) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (indices, values, lengths) of hashed words with unit norm, and the dense statistics."""
    indices, values, lengths, dense = [], [], [], []
    for t in texts:
        _, ratios, hashes = stats(t, memo)
        at, n = np.unique((hashes >> _SHIFT).astype(np.int32), return_counts=True)
        v = (1 + np.log(n)).astype(np.float32)
        indices.append(at)
        values.append(v / max(1e-6, float(np.sqrt((v * v).sum()))))
        lengths.append(len(at))
        dense.append(ratios)
    join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    return join(indices, np.int64), join(values, np.float32), np.array(lengths, np.int64), np.array(dense, np.float32).reshape(-1, len(RATIOS))


@dataclass
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def rows(self, dense: np.ndarray) -> np.ndarray:
        """Statistics on a common scale; beyond four deviations they count as four."""
        return np.clip((dense - self.mean) / self.scale, -4, 4).astype(np.float32) / 2

    def sums(self, x):
        """Linear part, and the sums of the identity, for each row."""
        indices, values, lengths, dense = x
        rows = np.repeat(np.arange(len(lengths)), lengths)
        total = lambda a: np.bincount(rows, a, len(lengths))
        d, w, v = self.rows(dense), self.w[BUCKETS:], self.v[BUCKETS:]
        linear = self.bias + total(self.w[indices] * values) + d @ w
        vx = self.v[indices] * values[:, None]
        first = np.stack([total(vx[:, f]) for f in range(RANK)], 1) + d @ v
        second = np.stack([total(vx[:, f] ** 2) for f in range(RANK)], 1) + (d * d) @ (v * v)
        return rows, d, vx, linear, first, second

    def score(self, x) -> np.ndarray:
        *_, linear, first, second = self.sums(x)
        return 1 / (1 + np.exp(-(linear + 0.5 * (first**2 - second).sum(1))))


def fit(x, y: np.ndarray, epochs: int = 12, batch: int = 256, rate: float = 0.1, l2: float = 1e-5, seed: int = 7) -> Machine:
    """AdaGrad on the logistic loss; the seed fixes every draw."""
    r = np.random.default_rng(seed)
    indices, values, lengths, dense = x
    size = BUCKETS + len(RATIOS)
    m = Machine(0.0, np.zeros(size, np.float32), (0.01 * r.standard_normal((size, RANK))).astype(np.float32), np.zeros(len(RATIOS)), np.ones(len(RATIOS)))
    if not len(y):
        m.v[:] = 0
        return m
    m.mean, m.scale = dense.mean(0), dense.std(0) + 1e-6
    ends = np.cumsum(lengths)
    gw, gv, gb = np.full(size, 1e-6, np.float32), np.full((size, RANK), 1e-6, np.float32), 1e-6
    for _ in range(epochs):
        order = r.permutation(len(y))
        for i in range(0, len(y), batch):
            pick = order[i : i + batch]
            n = lengths[pick]
            flat = np.concatenate([np.arange(ends[p] - lengths[p], ends[p]) for p in pick])
            part = (indices[flat], values[flat], n, dense[pick])
            rows, d, vx, linear, first, second = m.sums(part)
            off = ((1 / (1 + np.exp(-(linear + 0.5 * (first**2 - second).sum(1))))) - y[pick]) / len(pick)
            xv, e = part[1], off[rows]
            used, back = np.unique(part[0], return_inverse=True)
            dw = np.bincount(back, e * xv, len(used))
            dv = np.stack([np.bincount(back, e * xv * (first[rows, f] - vx[:, f]), len(used)) for f in range(RANK)], 1)
            dd = np.arange(BUCKETS, size)
            dv_d = (d * off[:, None]).T @ first - ((d * d) * off[:, None]).sum(0)[:, None] * m.v[dd]
            for at, a, b in ((used, dw, dv), (dd, d.T @ off, dv_d)):
                a, b = a + l2 * m.w[at], b + l2 * m.v[at]
                gw[at] += a * a
                gv[at] += b * b
                m.w[at] -= rate * a / np.sqrt(gw[at])
                m.v[at] -= 0.3 * rate * b / np.sqrt(gv[at])
            gb += off.sum() ** 2
            m.bias -= rate * off.sum() / np.sqrt(gb)
    return m


def learn(documents: DataFrame, labels: DataFrame) -> Machine:
    def measure(batches):
        memo = WordHash()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                indices, values, lengths, dense = features(part.column("text").to_pylist(), memo)
                cuts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(cuts, pa.array(indices.astype(np.int32))), pa.ListArray.from_arrays(cuts, pa.array(values)), pa.array(dense.tolist(), pa.list_(pa.float32())), part.column("y"), part.column("key")],
                    ["i", "v", "d", "y", "key"],
                )

    sample = labelled(documents, labels, "quality", FOLDS).withColumn("key", F.xxhash64("text", "y"))
    got = sample.mapInArrow(measure, "i array<int>, v array<float>, d array<float>, y int, key long").toArrow()
    # Sorted by their hashes and contents: the order in which rows arrive never matters.
    got = got.take(np.lexsort([*np.array(got.column("d").to_pylist(), np.float32).reshape(-1, len(RATIOS)).T, got.column("key").to_numpy()]))
    y = got.column("y").to_numpy().astype(float)
    dense = np.array(got.column("d").to_pylist(), np.float32).reshape(-1, len(RATIOS))
    flat = lambda c, kind: np.concatenate([np.zeros(0, kind), *(x.flatten().to_numpy() for x in got.column(c).chunks)]).astype(kind)
    lengths = np.array([len(x) for c in got.column("i").chunks for x in c], np.int64)
    return fit((flat("i", np.int64), flat("v", np.float32), lengths, dense), y)


def quality_scores(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out (never learnt from), score from 0 to 1, predicted."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    machine = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def judge(batches):
        memo = WordHash()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(machine.value.score(features(b.column("text").to_pylist(), memo)))], ["doc_id", "score"])

    scored = docs.mapInArrow(judge, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
