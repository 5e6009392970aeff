import random

import pytest

from lexiflume.llm.jaccard_join import jaccard_components


def brute(rows, k, percent):
    """Components over all pairs, in plain Python."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), (min(ids) if ids else None) if sets[i] else doc))
    return sorted(out, key=str)


def corpus(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    base = [[r.choice(words) for _ in range(r.randint(3, 60))] for _ in range(8)]
    passage = [r.choice(words) for _ in range(30)]
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            w[r.randrange(len(w))] = r.choice(words)
        if r.random() < 0.3:
            w += passage
        if r.random() < 0.2:
            w = [r.choice(words) for _ in range(r.randint(1, 50))]
        rows.append((i, r.choice([" ", "\n", "  \t"]).join(w).title() if r.random() < 0.5 else " ".join(w)))
    return rows


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 4, 85), (2, 5, 80), (3, 2, 60)])
def test_matches_brute_force(spark, seed, k, percent):
    rows = corpus(seed, 250)
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "one two"), (1004, "ONE  two"), (3, rows[3][1]), (None, rows[5][1]), (None, "alone with nobody at all here")]
    df = spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], "doc_id long, text string, node string, n int").repartition(5)
    got = sorted(map(tuple, jaccard_components(df, k, percent).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == brute(rows, k, percent)


def test_blocks_of_large_buckets(spark, monkeypatch):
    from lexiflume.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    rows = corpus(9, 200)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, jaccard_components(df, 3, 70).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == brute(rows, 3, 70)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_components(df).count() == 0


def test_bitmaps_never_pass_the_true_difference():
    import numpy as np

    from lexiflume.llm import jaccard_join as j

    r = np.random.default_rng(5)
    for n, changed in ((50, 3), (1500, 40), (5000, 300), (5000, 5000), (2100, 900)):
        a = np.unique(r.integers(0, 2**63, n, np.uint64))
        b = np.unique(np.concatenate([a[changed:], r.integers(0, 2**63, changed // 2, np.uint64)]))
        true = len(np.setxor1d(a, b))
        (x, wx), (y, wy) = j._bitmaps(a), j._bitmaps(b)
        assert len(x) == len(y) == j.BITS // 8
        assert j._apart(x, y) <= true
        assert j._apart(x, y) <= j._apart(wx or x, wy or y) <= true


@pytest.mark.parametrize(("block", "differing"), [(1024, 1 << 20), (4, 1 << 20), (1024, 40)])
def test_links_are_whole(spark, monkeypatch, block, differing):
    from lexiflume.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "LINKED", block)
    monkeypatch.setattr(jaccard_join, "DIFFERING", differing)
    rows = corpus(4, 150)
    rows += [(500, rows[7][1]), (7, rows[7][1].upper()), (None, rows[9][1]), (501, None), (502, "")]
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append(frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset())
    linked = lambda a, b: bool(a and b) and 100 * len(a & b) >= 70 * len(a | b)
    want = sorted(((doc, sum(linked(sets[i], s) for j, s in enumerate(sets) if j != i)) for i, (doc, _) in enumerate(rows)), key=str)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard_components(df, 3, 70, links=True).collect()
    assert sorted(((x.doc_id, x.n_links) for x in got), key=str) == want
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=str) == brute(rows, 3, 70)
    assert max(n for _, n in want) > 10


def test_templates_with_many_variants(spark):
    r = random.Random(3)
    body = [f"t{i}" for i in range(140)]
    rows = []
    for i in range(600):
        w = list(body)
        for slot in range(7):
            w[10 + 18 * slot] = f"s{slot}v{r.randrange(4)}"
        rows.append((i, " ".join(w)))
    sets = [frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) for w in (t.split() for _, t in rows)]
    got = {x.doc_id: x for x in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 90, links=True).collect()}
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got.values()), key=str) == brute(rows, 4, 90)
    for i in range(0, 600, 40):
        assert got[i].n_links == sum(100 * len(sets[i] & s) >= 90 * len(sets[i] | s) for s in sets) - 1


def test_very_long_text(spark):
    words = [f"w{i}" for i in range(200_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-9_000])), (3, " ".join(words[:50_000]))]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, links=True).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id, x.n_links) for x in got) == [(1, 199_997, 1, 1), (2, 190_997, 1, 1), (3, 49_997, 3, 0)]
