"""Language-model scoring: a log-bilinear model trained with noise-contrastive estimation in numpy.

The model predicts a token from the tokens before it in two steps: its group among SIDE groups, then its class among the
SIDE classes of that group; SIDE grows with the fourth root of the vocabulary, so there are as many classes as a multiple of its square
root. A word's group comes from its last two letters. In each group most classes are one frequent word's own; the
words left share the others by their last three letters. A context's predicted vector is m1 * r(c1) + m2 * r(c2) + m3 * (sum of r(c)
over the WIDE tokens before) with diagonal m and a vector r for each class; a group or class scores its dot product with that vector plus a
bias. Training never normalises: noise-contrastive estimation tells true next groups and classes from draws of their
frequencies. When scoring, batched matrix products over all groups, and over all classes of the token's group, give the normalisers, so
probabilities add up to 1. A word of a shared class has the class's probability times its smoothed share of the class's count.

All training texts are trained on, equal ones once. They are dealt by hash into ROUNDS slices and into parts of about PART tokens;
a part is trained on in the order of hashes, and a round ends with the average of its parts' parameters, summed as whole numbers. So
the model does not depend on how rows are partitioned, and a lost task repeats itself exactly. Counts cover all training rows,
repeated ones as often as they occur. Words are identified by 64-bit hashes.

Null and empty texts are one end token; texts of any length count whole. Rows with a null doc_id are training rows (their crc32 is not 0).
An empty table gives no rows; columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lexiflume.llm.scratch import Scratch
from lexiflume.llm.words import SLICE, mix, tailed_words

DIM, WIDE = 16, 16
ROUNDS, PART, RATE = 3, 1_000_000, 0.25
#: Tokens whose scores are computed at once.
AT_ONCE = 1024
#: True tokens stand against NOISE draws each; draws are shared by a batch, or by its tokens of one group.
NOISE, SHARED, BATCH = 8, 4, 16_384
#: Counts of the most frequent words that every task holds (16 bytes each); other words' counts come by a shuffle.
FREQUENT = 100_000
#: Tasks among which a round's parts are dealt at most.
TASKS = 20_000
#: Hashes of texts by which a task leaves out texts it has passed on already; later ones meet after the shuffle.
SEEN = 200_000
ALPHA, FOLDS = 0.1, 10
#: Models that one task adds up, on each of two levels; parameters are summed as multiples of 1 / UNIT.
FAN, UNIT = 256, 1 << 24
#: The end token's key among the words' hashes.
END_KEY = -1


@dataclass
class Lookup:
    """Sorted keys with values; other keys give the default."""

    keys: np.ndarray
    values: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, values: np.ndarray) -> Lookup:
        order = np.argsort(keys)
        return Lookup(keys[order], values[order])

    def __call__(self, keys: np.ndarray, default: int) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), default)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], default)


@dataclass
class Classes:
    """Class = group * side + place; the last places of a group are shared."""

    side: int
    own: Lookup

    @property
    def shared(self) -> int:
        return max(1, self.side // 4)

    def group(self, tails: np.ndarray) -> np.ndarray:
        return (mix((tails & 0xFFFF).astype(np.uint64)) % np.uint64(self.side)).astype(np.int64)

    def unowned(self, tails: np.ndarray) -> np.ndarray:
        """Classes of words without one of their own."""
        place = self.side - self.shared + (mix(tails.astype(np.uint64) + np.uint64(1 << 40)) % np.uint64(self.shared)).astype(np.int64)
        return self.group(tails) * self.side + place

    def __call__(self, keys: np.ndarray, tails: np.ndarray) -> np.ndarray:
        own = self.own(keys, -1)
        left = own < 0
        own[left] = self.unowned(tails[left])
        return own

    @staticmethod
    def new(n_types: int, keys: np.ndarray, tails: np.ndarray) -> Classes:
        """keys and tails of the most frequent tokens, most frequent first."""
        made = Classes(max(16, int(np.ceil(2 * n_types**0.25))), Lookup(np.zeros(0, np.int64), np.zeros(0, np.int64)))
        group = made.group(tails)
        order = np.argsort(group, kind="stable")
        rank = np.arange(len(order)) - np.searchsorted(group[order], group[order])
        kept = order[rank < made.side - made.shared]
        made.own = Lookup.of(keys[kept], group[kept] * made.side + rank[rank < made.side - made.shared])
        return made


@dataclass
class Bilinear:
    source: np.ndarray  # classes x DIM
    mixing: np.ndarray  # 3 x DIM: the token before, the one before that, the sum of WIDE
    top: np.ndarray  # side x DIM
    top_bias: np.ndarray
    member: np.ndarray  # classes x DIM
    member_bias: np.ndarray

    @staticmethod
    def new(mass: np.ndarray, side: int, seed: int = 11) -> Bilinear:
        """mass: smoothed counts of the classes."""
        r = np.random.default_rng(seed)
        draw = lambda n: (0.1 * r.standard_normal((n, DIM))).astype(np.float32)
        groups = mass.reshape(side, side).sum(1)
        mixing = np.ones((3, DIM), np.float32) / np.array([[2], [4], [WIDE]], np.float32)
        return Bilinear(draw(len(mass)), mixing, draw(side), np.log(groups / mass.sum()).astype(np.float32), draw(len(mass)), np.log(mass / np.repeat(groups, side)).astype(np.float32))

    def parts(self):
        return self.source, self.mixing, self.top, self.top_bias, self.member, self.member_bias

    def pack(self) -> np.ndarray:
        return np.concatenate([np.rint(p.ravel().astype(np.float64) * UNIT).astype(np.int64) for p in self.parts()])

    def like(self, total: np.ndarray, n: int) -> Bilinear:
        cuts = np.cumsum([p.size for p in self.parts()])[:-1]
        return Bilinear(*((x / (n * UNIT)).reshape(p.shape).astype(np.float32) for x, p in zip(np.split(total, cuts), self.parts(), strict=True)))

    def predicted(self, c: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Predicted vector of each token's context, and the three vectors (before mixing) that make it."""
        r = self.source[c]
        at = np.arange(len(c))
        seen = np.zeros((3, len(c), DIM), np.float32)
        for j in (1, 2):
            seen[j - 1, j:] = r[:-j]
            seen[j - 1, at - j < begin] = 0
        seen[2] = _window_sums(r, begin)
        q = seen[0] * self.mixing[0]
        for j in (1, 2):
            q += seen[j] * self.mixing[j]
        return q, seen

    def log_probabilities(self, c: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Natural log of each token's class given its context."""
        side = len(self.top)
        r, at = self.source[c], np.arange(len(c))
        q = np.ones((len(c), DIM + 1), np.float32)  # the last place takes the bias
        q[:, :DIM] = _window_sums(r, begin) * self.mixing[2]
        for j in (1, 2):
            more = r[:-j] * self.mixing[j - 1]
            more[(at - j < begin)[j:]] = 0
            q[j:, :DIM] += more
        top, member = (np.concatenate([v, b[:, None]], 1) for v, b in ((self.top, self.top_bias), (self.member, self.member_bias)))
        group = c // side
        # No score is beyond this, so most often sums of powers need no shift.
        far = float(np.sqrt((q * q).sum(1).max(initial=0) * max((v * v).sum(1).max() for v in (top, member))))
        order = _by_class(group)
        q, c, group = q[order], c[order], group[order]
        found = np.empty(len(c), np.float32)
        for a in range(0, len(c), AT_ONCE):  # scores stay within a processor's cache
            rows = slice(a, a + AT_ONCE)
            found[rows] = _log_softmax(q[rows] @ top.T, group[rows], far > 60)
        cuts = np.searchsorted(group, np.arange(side + 1))
        for g in np.flatnonzero(np.diff(cuts)):
            rows, here = slice(cuts[g], cuts[g + 1]), slice(g * side, (g + 1) * side)
            found[rows] += _log_softmax(q[rows] @ member[here].T, c[rows] - g * side, far > 60)
        out = np.empty_like(found)
        out[order] = found
        return out


def _window_sums(r: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of the WIDE rows before each row, from its text's begin on. Running sums are whole numbers modulo 2^32, so they depend
    neither on what came before the text nor on its length."""
    sums = np.zeros((len(r) + 1, DIM), np.int32)
    np.cumsum(np.rint(r * np.float32(65536)).astype(np.int32), axis=0, dtype=np.int32, out=sums[1:])
    at = np.arange(len(r))
    return (sums[:-1] - sums[np.maximum(begin, at - WIDE)]).astype(np.float32) / np.float32(65536)


def _by_class(c: np.ndarray) -> np.ndarray:
    """Order by small whole numbers; 16 bits sort in time linear in their number."""
    return np.argsort(c.astype(np.uint16) if len(c) and c.max() < 1 << 16 else c, kind="stable")


def _log_softmax(scores: np.ndarray, at: np.ndarray, shift: bool) -> np.ndarray:
    if shift:
        scores -= scores.max(1, keepdims=True)
    got = scores[np.arange(len(at)), at]
    return got - np.log(np.exp(scores, out=scores) @ np.ones(scores.shape[1], np.float32))


def _sums(rows: np.ndarray, grads: np.ndarray, n: int) -> np.ndarray:
    """Sums of gradients by sorted row numbers."""
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    out = np.zeros((n, *grads.shape[1:]), np.float32)
    out[rows[first]] = np.add.reduceat(grads, first, axis=0)
    return out


def _share(mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of masses its number plus the running shares, flat and ascending, and the logs of NOISE times the shares."""
    share = mass / mass.sum(1, keepdims=True)
    upto = np.minimum(np.cumsum(share, 1), 1)
    upto[:, -1] = 1
    return (np.arange(len(mass))[:, None] + upto).ravel(), np.log(NOISE * share + 1e-12).astype(np.float32).ravel()


def _contrasts(q, vectors, true, cuts, share, r, weight):
    """Noise-contrastive gradients for rows q whose true outcomes are ``true`` (sorted) among the vectors, for q and for the vectors; the last place of both is the bias.
    Rows from cuts[g] to cuts[g + 1] have their draws among the vectors of the g-th of as many equal parts. What concerns true outcomes is done for all rows at
    once, the draws part by part within a processor's cache."""
    upto, log_noise = share
    parts = len(cuts) - 1
    u = r.random((parts, NOISE * SHARED))
    u.sort(1)
    size = len(vectors) // parts
    draws = np.searchsorted(upto, (np.arange(parts)[:, None] + u).ravel(), "right").reshape(parts, -1)
    draws = np.minimum(draws, np.arange(1, parts + 1)[:, None] * size - 1)  # the sum of a part and a share may be rounded up
    shifted = vectors.copy()
    shifted[:, -1] -= log_noise
    drawn = shifted[draws]
    mine = shifted[true]
    d_yes = np.einsum("ij,ij->i", q, mine)
    d_yes = weight / (1 + np.exp(d_yes, out=d_yes))
    mine *= d_yes[:, None]
    d_drawn = np.zeros_like(drawn)
    for g in np.flatnonzero(np.diff(cuts)):
        minus = -drawn[g].T
        for a in range(cuts[g], cuts[g + 1], AT_ONCE):
            rows = slice(a, min(a + AT_ONCE, cuts[g + 1]))
            no = q[rows] @ minus
            np.exp(no, out=no)
            no += 1
            np.divide(-weight / SHARED, no, out=no)
            mine[rows] += no @ drawn[g]
            d_drawn[g] += no.T @ q[rows]
    d_vectors = _sums(true, d_yes[:, None] * q, len(vectors))
    d_vectors += _sums(draws.ravel(), d_drawn.reshape(-1, q.shape[1]), len(vectors))
    return mine, d_vectors


def _contrast(q, vectors, bias, true, share, r, weight):
    """_contrasts with one part, of running shares, and biases of their own: gradients for q, vectors and bias."""
    q, vectors = np.concatenate([q, np.ones_like(q[:, :1])], 1), np.concatenate([vectors, bias[:, None]], 1)
    dq, d_vectors = _contrasts(q, vectors, true, np.array([0, len(q)]), _share(np.diff(share, prepend=0)[None]), r, weight)
    return dq[:, :-1], d_vectors[:, :-1], d_vectors[:, -1]


def train(model: Bilinear, texts: list[np.ndarray], mass: np.ndarray, rate: float, seed: int) -> Bilinear:
    """One pass of noise-contrastive estimation over texts (classes of their tokens), a batch of neighbouring texts at a time."""
    r, side = np.random.default_rng(seed), len(model.top)
    groups = mass.reshape(side, side)
    top_share, member_share = _share(groups.sum(1)[None]), _share(groups)
    model = Bilinear(*(p.copy() for p in model.parts()))
    # Vectors with their biases in the last place.
    top, member = (np.concatenate([v, b[:, None]], 1) for v, b in ((model.top, model.top_bias), (model.member, model.member_bias)))
    learnt = (model.source, model.mixing, top, member)
    # AdaGrad; biases start at the frequencies and move slowly.
    slow = np.append(np.ones(DIM), 0.1).astype(np.float32)
    seen, speeds = [np.full(p.shape, 1e-6, np.float32) for p in learnt], (np.float32(1), np.float32(0.1), slow, slow)
    tokens = np.concatenate(texts).astype(np.int64)
    starts = np.repeat(np.cumsum([0, *(len(t) for t in texts[:-1])]), [len(t) for t in texts])
    for a in range(0, len(tokens), BATCH):
        c = tokens[a : a + BATCH]
        begin = np.maximum(starts[a : a + BATCH] - a, 0)
        q, parts = model.predicted(c, begin)
        order = _by_class(c)
        qs, cs = np.ones((len(c), DIM + 1), np.float32), c[order]
        qs[:, :DIM] = q[order]
        gs = cs // side
        weight = np.float32(1 / len(c))
        dq, d_top = _contrasts(qs, top, gs, np.array([0, len(c)]), top_share, r, weight)
        more, d_member = _contrasts(qs, member, cs, np.searchsorted(gs, np.arange(side + 1)), member_share, r, weight)
        back = np.empty_like(q)
        back[order] = (dq + more)[:, :DIM]
        d_mixing = np.einsum("kij,ij->kj", parts, back)
        # What each token's own vector gets from the tokens after it.
        at = np.arange(len(c))
        end = np.searchsorted(begin, begin, "right")
        sums = np.zeros((len(c) + 1, DIM))
        np.cumsum(back, axis=0, dtype=np.float64, out=sums[1:])
        own = ((sums[np.minimum(at + WIDE + 1, end)] - sums[at + 1]) * model.mixing[2]).astype(np.float32)
        for j in (1, 2):
            after = back[j:] * model.mixing[j - 1]
            after[(at + j >= end)[:-j]] = 0
            own[:-j] += after
        d_source = _sums(cs, own[order], len(model.source))
        for part, total, grad, speed in zip(learnt, seen, (d_source, d_mixing, d_top, d_member), speeds, strict=True):
            total += grad * grad
            part += np.float32(rate) * speed * grad / np.sqrt(total)
    model.top, model.top_bias, model.member, model.member_bias = top[:, :DIM], top[:, DIM], member[:, :DIM], member[:, DIM]
    return model


def _tokens(batches, size: int = SLICE):
    """(batch of rows, keys of all their tokens with their ends, lengths, tails), in slices of about size bytes of text."""
    for whole in batches:
        for at, hashes, counts, tails in tailed_words(whole.column("text"), size):
            keys = hashes.view(np.int64)
            keys = np.where(keys == END_KEY, END_KEY - 1, keys)
            ends = np.cumsum(counts)
            yield whole.slice(at, len(counts)), np.insert(keys, ends, END_KEY), counts + 1, np.insert(tails, ends, 0)


def _begins(lengths: np.ndarray) -> np.ndarray:
    """The place of each token's text's first token."""
    return np.repeat(np.cumsum(lengths) - lengths, lengths)


def _trains(batch: pa.RecordBatch) -> np.ndarray:
    return ~batch.column("held_out").to_numpy(zero_copy_only=False)


def token_counts(docs: DataFrame) -> DataFrame:
    """key, tail, n over the training rows."""

    def count(batches):
        held, n = [], 0

        def summed():
            keys, tails, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(keys)
            keys = keys[order]
            first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
            return keys[first], tails[order[first]], np.add.reduceat(counts[order], first) if len(first) else counts

        for batch, keys, lengths, tails in _tokens(batches):
            some = np.repeat(_trains(batch), lengths)
            keys, tails = keys[some], tails[some]
            order = np.argsort(keys)
            keys = keys[order]
            first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
            held.append((keys[first], tails[order[first]], np.diff(np.append(first, len(keys)))))
            n += len(first)
            if n > 3_000_000:
                held = [summed()]
                n = len(held[0][0])
                if n > 2_000_000:  # a task's memory stays bounded; the shuffle adds the parts up
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["key", "tail", "n"])
                    held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed()], ["key", "tail", "n"])

    return docs.mapInArrow(count, "key long, tail long, n long").groupBy("key").agg(F.max("tail").alias("tail"), F.sum("n").alias("n"))


def class_mass(counts: DataFrame, classes: Classes) -> np.ndarray:
    """Smoothed counts of the classes; each has room for one unknown token."""
    sent = counts.sparkSession.sparkContext.broadcast(classes)

    def add(batches):
        total = np.zeros((classes.side**2, 2), np.int64)
        for b in batches:
            c = sent.value(b.column("key").to_numpy(), b.column("tail").to_numpy())
            total[:, 0] += np.bincount(c, b.column("n").to_numpy(), len(total)).astype(np.int64)
            total[:, 1] += np.bincount(c, minlength=len(total))
        some = np.flatnonzero(total[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some, 0]), pa.array(total[some, 1])], ["c", "n", "types"])

    mass = np.full(classes.side**2, ALPHA)
    for x in counts.mapInArrow(add, "c long, n long, types long").groupBy("c").agg(F.sum("n").alias("n"), F.sum("types").alias("types")).collect():  # a row for each class
        mass[x.c] += x.n + ALPHA * x.types
    return mass


def learn(docs: DataFrame, classes: Classes, mass: np.ndarray, n_tokens: int, scratch: Scratch) -> Bilinear:
    spark, kind = docs.sparkSession, "<u2" if classes.side**2 <= 1 << 16 else "<u4"
    parts = max(1, round(n_tokens / ROUNDS / PART))
    sent = spark.sparkContext.broadcast(classes)

    def encode(batches):
        seen: set[int] = set()
        for batch, keys, lengths, tails in _tokens(batches):
            codes = sent.value(keys, tails).astype(kind)
            ends, out = np.cumsum(lengths).tolist(), []
            for used, n, end in zip(_trains(batch).tolist(), lengths.tolist(), ends, strict=True):
                if used:
                    raw = codes[end - n : end].tobytes()
                    h = xxhash.xxh3_64_intdigest(raw)
                    if h not in seen:
                        out.append((h, raw))
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(h)
            yield pa.RecordBatch.from_arrays([pa.array([h % ROUNDS for h, _ in out], pa.int32()), pa.array([h // ROUNDS % parts for h, _ in out], pa.int64()), pa.array([h - 2**63 for h, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], ["round", "part", "h", "codes"])

    texts = scratch.keep("texts", docs.mapInArrow(encode, "round int, part long, h long, codes binary"))
    model = Bilinear.new(mass, classes.side)
    for i in range(ROUNDS):
        model = _round(texts.where(F.col("round") == i), model, mass, RATE / (1 + i), i, kind, parts)
    scratch.drop("texts")
    return model


def _round(texts: DataFrame, model: Bilinear, mass: np.ndarray, rate: float, seed: int, kind: str, parts: int) -> Bilinear:
    """The average of the models trained on each part."""
    sent = texts.sparkSession.sparkContext.broadcast((model, mass))

    def fit(batches):
        model, mass = sent.value
        total, n, part, last, held = 0, 0, None, None, []

        def trained():
            return train(model, held, mass, rate, 1000 * seed + part % 1000).pack()

        for b in batches:
            for p, h, codes in zip(b.column("part").to_pylist(), b.column("h").to_pylist(), b.column("codes").to_pylist(), strict=True):
                if p != part and held:
                    total, n, held = total + trained(), n + 1, []
                if h != last:  # equal texts of several tasks
                    held.append(np.frombuffer(codes, kind))
                part, last = p, h
        if held:
            total, n = total + trained(), n + 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() // FAN], pa.int64()), pa.array([n], pa.int64()), pa.array([total.tobytes()])], ["meet", "n", "model"])

    def add(batches):
        sums: dict[int, list] = {}
        for b in batches:
            for meet, n, m in zip(*(b.column(c).to_pylist() for c in ("meet", "n", "model")), strict=True):
                old = sums.setdefault(meet, [0, 0])
                old[0], old[1] = old[0] + n, old[1] + np.frombuffer(m, np.int64)
        for meet, (n, m) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([meet], pa.int64()), pa.array([n], pa.int64()), pa.array([m.tobytes()])], ["meet", "n", "model"])

    schema = "meet long, n long, model binary"
    # A task for each part: by hash some would get several, and the optimizer would join parts, small in bytes, into few tasks.
    tasks = min(parts, TASKS)
    found = texts.repartitionById(tasks, (F.col("part") % tasks).cast("int")).sortWithinPartitions("part", "h").select("part", "h", "codes").mapInArrow(fit, schema)
    found = found.repartition("meet").mapInArrow(add, schema).withColumn("meet", F.lit(0).cast("long"))
    one = found.repartition("meet").mapInArrow(add, schema).collect()  # one row
    return model.like(np.frombuffer(one[0].model, np.int64), one[0].n) if one else model


def lm_scores(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_token."""
    spark = documents.sparkSession
    scratch = scratch or Scratch(spark)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False)))
    counts = scratch.keep("counts", token_counts(docs))
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("n"), "key").limit(FREQUENT).toArrow()  # a fixed number of rows
    keys, tails, ns = (top.column(c).to_numpy() for c in ("key", "tail", "n"))
    frequent, classes = Lookup.of(keys, np.arange(len(keys))), Classes.new(v, keys, tails)
    known_class = classes(keys, tails)
    mass = class_mass(counts, classes)
    model = learn(docs, classes, mass, n, scratch)
    sent = spark.sparkContext.broadcast((model, classes, frequent, np.append(ns, 0), np.append(known_class, 0), np.log10(mass)))
    base_mass = n + ALPHA * (v + 1)

    def score(batches):
        model, classes, frequent, ns, known_class, log_mass = sent.value
        log_count = np.log10(ns + ALPHA)
        wanted = ("doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare", "tf")
        for batch, keys, lengths, tails in _tokens(batches):
            rows, total = np.repeat(np.arange(len(lengths)), lengths), lambda x: np.bincount(rows, x, len(lengths))  # noqa: E731, B023
            at = frequent(keys, -1)
            known, c = at >= 0, known_class[at]
            c[~known] = classes.unowned(tails[~known])
            log_p = model.log_probabilities(c, _begins(lengths)).astype(np.float64) / np.log(10) - log_mass[c]
            # Of words in a class of their own the count's smoothing is shared with the unknown one.
            own = np.where(known, log_count[at], 0.0)
            base = np.where(known, own - np.log10(base_mass), 0.0)
            # Words not among the frequent ones: their counts come by a join, once for each row and word.
            away = np.nonzero(~known)[0]
            by = np.lexsort([keys[away], rows[away]])
            r, k = rows[away][by], keys[away][by]
            first = np.nonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (k[1:] != k[:-1])]))[0] if len(r) else np.zeros(0, np.int64)
            tf = np.diff(np.concatenate([first, [len(r)]])) if len(r) else np.zeros(0, np.int64)
            cuts = np.searchsorted(r[first], np.arange(len(lengths) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("held_out"), pa.array(lengths), pa.array(total(known).astype(np.int64)), pa.array(total(base)), pa.array(total(log_p + own)),
                    pa.ListArray.from_arrays(cuts, pa.array(k[first])), pa.ListArray.from_arrays(cuts, pa.array(tf)),
                ],
                list(wanted),
            )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<long>, tf array<long>"
    rows = scratch.keep("rows", docs.mapInArrow(score, schema).withColumn("row", F.monotonically_increasing_id()))
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "tf")).alias("x")).select("row", F.col("x.rare").alias("key"), F.col("x.tf").alias("tf"))
    met = rare.join(counts.select("key", "n"), "key", "left").withColumn("c", F.coalesce("n", F.lit(0)))
    log = F.log10(F.col("c") + ALPHA)
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("k"), F.sum(F.col("tf") * (log - np.log10(base_mass))).alias("b"), F.sum(F.col("tf") * log).alias("s"))
    out = rows.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score").join(sums, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    score_ = F.col("score") + zero("s")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("k")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + zero("b")).alias("base_score"), score_.alias("score"), (-score_ / F.col("n_tokens") / F.log10(F.lit(2.0))).alias("bits_per_token"))
