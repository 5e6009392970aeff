import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lexiflume.llm import language_model as L


def corpus(n=400):
    r = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    follow = {w: r.sample(words, 3) for w in words}  # each word has few followers
    rows = []
    for i in range(n):
        w = [r.choice(words)]
        for _ in range(r.randint(0, 60)):
            w.append(r.choice(follow.get(w[-1], words)) if r.random() < 0.9 else f"rare{r.randint(0, 500)}")
        rows.append((i, " ".join(w).upper() if i % 3 else "\n".join(w)))
    return rows + [(5, rows[5][1]), (None, "w1 w2 w3"), (9001, None), (9002, " \t")]


def test_base_matches_brute_force_and_model_beats_it(spark, monkeypatch):
    monkeypatch.setattr(L, "FREQUENT", 100)  # so that counts come both ways
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string").repartition(3)
    got = L.lm_scores(df).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    tokens = [(t or "").encode().lower().split() + [None] for _, t in rows]
    c = Counter(w for (i, _), ws in zip(rows, tokens, strict=True) if not held(i) for w in ws)
    n = sum(c.values())
    want = sorted((str(i), held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (len(c) + 1))) for w in ws), 6)) for (i, _), ws in zip(rows, tokens, strict=True))
    assert sorted((str(x.doc_id), x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got) == want
    out = [x for x in got if x.held_out]
    assert out and sum(x.score for x in out) > sum(x.base_score for x in out)


def small(side=16, n=3000):
    r = np.random.default_rng(1)
    mass = r.dirichlet(np.ones(side * side)) * 1000
    texts = [r.integers(0, side * side, r.integers(1, 60)) for _ in range(n // 30)]
    return L.train(L.Bilinear.new(mass, side), texts, mass, 0.3, 1)


def test_probabilities_of_a_context_sum_to_one():
    m = small()
    for before in ([], [5], [5, 200, 7, 7, 91] * 6):
        total = sum(math.exp(m.log_probabilities(np.array([*before, c]), np.zeros(len(before) + 1, np.int64))[-1]) for c in range(256))
        assert total == pytest.approx(1, abs=1e-4)


def test_contexts_stay_within_a_text():
    m, texts = small(), [[5, 6, 7], [8], [9, 10, 11, 12] * 9]
    lengths = np.array([len(t) for t in texts])
    together = m.log_probabilities(np.concatenate(texts), L._begins(lengths))
    alone = np.concatenate([m.log_probabilities(np.array(t), np.zeros(len(t), np.int64)) for t in texts])
    assert together == pytest.approx(alone, abs=1e-4)


def test_gradients_are_those_of_the_contrastive_loss():
    r = np.random.default_rng(3)
    q, v, bias = r.normal(size=(6, 4)), r.normal(size=(5, 4)), r.normal(size=5)
    true, share = np.sort(r.integers(0, 5, 6)), np.cumsum(r.dirichlet(np.ones(5)))

    def loss(q, v, bias):
        draws = np.sort(np.searchsorted(share, np.random.default_rng(8).random(L.NOISE * L.SHARED) * share[-1], "right").clip(0, 4))
        noise = np.log(L.NOISE * np.diff(share, prepend=0) / share[-1] + 1e-12)
        yes = (q * v[true]).sum(1) + bias[true] - noise[true]
        no = q @ v[draws].T + bias[draws] - noise[draws]
        return -np.log1p(np.exp(-yes)).sum() - np.log1p(np.exp(no)).sum() / L.SHARED

    found = L._contrast(q, v, bias, true, share, np.random.default_rng(8), 1.0)
    for x, grad in zip((q, v, bias), found, strict=True):
        for at in np.ndindex(x.shape):
            old, ends = x[at], []
            for step in (1e-5, -1e-5):
                x[at] = old + step
                ends.append(loss(q, v, bias))
            x[at] = old
            assert (ends[0] - ends[1]) / 2e-5 == pytest.approx(grad[at], abs=1e-3)


def test_gradients_of_all_groups_at_once(monkeypatch):
    r = np.random.default_rng(4)
    side, n = 5, 60
    q, v, bias, mass = r.normal(size=(n, 4)), r.normal(size=(side * side, 4)), r.normal(size=side * side), r.dirichlet(np.ones(side * side))
    true = np.sort(r.choice([0, 1, 2, 7, 8, 20, 24], n))  # two groups have no rows
    cuts = np.searchsorted(true // side, np.arange(side + 1))
    monkeypatch.setattr(L, "AT_ONCE", 7)
    dq, d = L._contrasts(np.append(q, np.ones((n, 1)), 1), np.append(v, bias[:, None], 1), true, cuts, L._share(mass.reshape(side, side)), np.random.default_rng(8), 1.0)
    draws = np.random.default_rng(8).random((side, L.NOISE * L.SHARED))

    class Fixed:
        def random(self, shape):
            return draws[g].reshape(shape)

    for g in range(side):
        rows, here = slice(cuts[g], cuts[g + 1]), slice(g * side, (g + 1) * side)
        if cuts[g] < cuts[g + 1]:
            one = L._contrast(q[rows], v[here], bias[here], true[rows] - g * side, np.cumsum(mass[here]), Fixed(), 1.0)
            for found, want in zip((dq[rows, :4], d[here, :4], d[here, 4]), one, strict=True):
                assert found == pytest.approx(want, abs=1e-5)
        else:
            assert not d[here].any()


def test_a_batch_takes_few_steps_whatever_the_groups(monkeypatch):
    calls, sums = [], L._sums
    monkeypatch.setattr(L, "_sums", lambda *a: calls.append(1) or sums(*a))
    small()  # one batch
    assert len(calls) <= 5


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(L, "PART", 500)  # several parts a round
    rows = corpus(300)
    got = [{(x.doc_id, x.n_tokens): x.score for x in L.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(n)).collect()} for n in (2, 5)]
    assert got[0].keys() == got[1].keys()
    assert all(x == pytest.approx(got[1][k], rel=1e-5) for k, x in got[0].items())


def test_empty_table(spark):
    assert L.lm_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
