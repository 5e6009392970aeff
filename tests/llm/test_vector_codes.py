import hashlib
import math
import random

import numpy as np
import pytest

from lexiflume.llm import lookup, vector_codes
from lexiflume.llm.vector_codes import compress, limit, nearest


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """In plain Python: rows (vec_id, vector, label) to (vec_id, label, code, error, label_error), and the codebooks' digest."""
    kept = [(i, [math.floor(scale * x) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = max(1, -(-max(len(v) for _, v, _ in kept) // parts)) * parts
    most = limit(dims)
    kept = [(i, [max(-most, min(most, x)) for x in v] + [0] * (dims - len(v)), g) for i, v, g in kept]
    d = dims // parts
    cut = lambda v, p: v[p * d : (p + 1) * d]
    first = {}
    for i, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        first.setdefault(i, v)
    books = [[cut(v, p) for v in list(first.values())[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = [[] for _ in books[p]]
            for _, v, _ in kept:
                members[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(m) for c in zip(*m, strict=True)] if m else old for m, old in zip(members, books[p], strict=True)]
    out, sums = [], {}
    for i, v, g in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, g, "".join(f"{e:02x}" for _, e in found), sum(x for x, _ in found)))
        sums[g] = sums.get(g, 0) + out[-1][3]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((*r, sums[r[1]]) for r in out), key=str), digest


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, v string").repartition(4)
    got = compress(df, **kw).collect()
    return sorted(((x.vec_id, x.label, x.code, x.error, x.label_error) for x in got), key=str), {x.codebooks_sha256 for x in got}


def single(rows):
    """As 32-bit floats, which the table holds."""
    return [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v], g) for i, v, g in rows]


def corpus(seed, n, dims):
    r = random.Random(seed)
    centres = [[r.gauss(0, 0.2) for _ in range(dims)] for _ in range(12)]
    return [(i, [x + r.gauss(0, 0.05) for x in r.choice(centres)], r.choice([0, 1, 2, None])) for i in range(n)]


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lookup, "HEAVY", 3)  # one label is heavy, others are not
    rows = corpus(1, 150, 32)
    odd = [[float("nan")] * 32, [float("inf")] + [0.0] * 31, [None] + [0.0] * 31, None]
    rows += [(1000 + i, v, 1) for i, v in enumerate(odd)]
    rows += [(3, rows[3][1], 0), (3, rows[4][1], 0), (None, rows[5][1], None), (900, rows[6][1], 2)] + [(2000 + i, rows[7][1], 5) for i in range(90)]
    rows = single(rows)
    want, digest = brute(rows)
    assert run(spark, rows) == (want, {digest})


@pytest.mark.parametrize(("dims", "parts", "entries"), [(20, 4, 3), (9, 2, 16), (3, 8, 4)])
def test_other_shapes(spark, dims, parts, entries):
    rows = single([*corpus(2, 40, dims), (77, [1.5], 1), (78, [], None), (79, [1e30, -1e30], 2)])
    want, digest = brute(rows, parts, entries, 3)
    assert run(spark, rows, parts=parts, entries=entries, rounds=3) == (want, {digest})


def test_few_rows_and_none(spark):
    rows = single(corpus(5, 3, 8))
    want, digest = brute(rows)
    assert run(spark, rows) == (want, {digest})
    assert run(spark, [(1, None, 0)])[0] == []
    assert run(spark, [(1, None, 0)][:0])[0] == []


def test_bounds_lose_no_nearest_entry():
    """Integer vectors with many ties, at the limit and all equal, against all distances; and the bounds do drop entries."""
    r = np.random.default_rng(4)
    for d, top in ((8, 3), (8, 1000), (6, 50), (7, 50), (1, 9), (16, limit(128))):
        book = r.integers(-top, top + 1, (16, d))
        x = np.vstack([r.integers(-top, top + 1, (300, d)), book, book[:4] + 1, np.full((2, d), top), np.zeros((1, d), np.int64)])
        every = ((x[:, None, :] - book) ** 2).sum(2)
        at, distance, looked = nearest(x, book)
        assert (at == every.argmin(1)).all() and (distance == every.min(1)).all()
        assert looked[-1] <= looked[0]
    equal = np.ones((5, 8), np.int64)
    assert nearest(equal, np.ones((4, 8), np.int64))[0].tolist() == [0] * 5
    book = r.integers(-500, 500, (16, 8))
    x = book[r.integers(0, 16, 2000)] + r.integers(-60, 60, (2000, 8))
    assert nearest(x, book)[2][-1] < 0.2 * nearest(x, book)[2][0]
