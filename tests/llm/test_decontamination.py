import random

import numpy as np

from lexiflume.llm import decontamination as d


def cut(text, k):
    w = (text or "").encode().lower().split()
    return w, [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]


def brute(docs, items):
    """Best window of each item over all windows, by the greater of weighted and unweighted similarity."""
    bags = []
    for item, text in items:
        w = (text or "").encode().lower().split()
        k = min(5, len(w))
        bags.append((item, len(w), k, cut(text, k)[1] if w else []))
    df = {}
    for *_, grams in bags:
        for g in set(grams):
            df[g] = df.get(g, 0) + 1
    out = []
    for doc, text in docs:
        for item, n, k, grams in bags:
            if not grams:
                continue
            words, mine = cut(text, k)
            best = None
            for start in range(len(words) - n + 1):
                window = mine[start : start + len(grams)]
                low = high = some = every = 0
                for g in set(window) | set(grams):
                    a, b = window.count(g), grams.count(g)
                    weight = 1 / df[g] if g in grams else 1
                    low, high = low + weight * min(a, b), high + weight * max(a, b)
                    some, every = some + min(a, b), every + max(a, b)
                s = max(low / high, some / every)
                if s >= 0.8 - 1e-12 and (best is None or s > best[0] + 1e-12):
                    best = (s, start)
            if best:
                out.append((doc, item, round(best[0], 9), best[1], n))
    return sorted(out, key=str)


def cases(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice([3, 5, 12, 30, 30, 60])))) for i in range(12)]
    items += [(50, items[3][1]), (51, None), (52, " "), (None, "null item id with words here"), (53, items[4][1] + " " + items[5][1])]
    docs = []
    for i in range(80):
        w = [r.choice(words) for _ in range(r.randint(0, 120))]
        for _ in range(r.choice([0, 0, 1, 2])):
            p = (r.choice(items)[1] or "").upper().split()
            if p and r.random() < 0.4:
                p[r.randrange(len(p))] = "changed"
            at = r.randint(0, len(w))
            w[at:at] = p
        docs.append((i, " \n".join(w)))
    return docs + [(5, docs[5][1]), (None, docs[6][1]), (900, None), (901, "")], items


def test_matches_brute_force(spark):
    missed = 0
    for seed in (1, 2):
        docs, items = cases(seed)
        a = spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id long, text string, similarity double").repartition(3)
        b = spark.createDataFrame(items, "item_id long, text string")
        got = sorted(((x.doc_id, x.item_id, round(x.similarity, 9), x.start_word, x.n_words) for x in d.contaminations(a, b).collect()), key=str)
        want = brute(docs, items)
        assert set(got) <= set(want)
        missed += len(want) - len(got)
        assert {x[:2] for x in want if x[2] >= 0.9} == {x[:2] for x in got if x[2] >= 0.9}
        clean = sorted((x.doc_id, x.text) for x in d.drop_contaminated(a, b).where("doc_id is not null").collect())
        dirty = {x[0] for x in got}
        assert clean == sorted((i, t or None if t is None else t) for i, t in docs if i is not None and i not in dirty)
    assert missed <= 2  # a window at the threshold can lie beyond the radius


def test_multi_index_misses_nothing_within_radius():
    r = np.random.default_rng(3)
    prints = r.integers(0, 2**63, 20, np.uint64)
    windows = np.concatenate([r.integers(0, 2**63, 300, np.uint64), *[prints ^ np.bitwise_or.reduce(np.uint64(1) << r.choice(64, n, False).astype(np.uint64)) for n in range(1, 22)]])
    got = set(zip(*map(np.ndarray.tolist, d.Index([{"print": p} for p in prints]).within(windows)), strict=True))
    assert got == {(w, i) for w in range(len(windows)) for i in range(20) if int(windows[w] ^ prints[i]).bit_count() <= d.RADIUS}


def test_several_blocks_and_empty_tables(spark, monkeypatch):
    docs, items = cases(4)
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(tuple, d.contaminations(a, b).collect()), key=str)
    monkeypatch.setattr(d, "ITEM_WORDS", 60)
    assert sorted(map(tuple, d.contaminations(a, b).collect()), key=str) == want
    assert d.contaminations(a.limit(0), b).count() == 0
    assert d.contaminations(a, b.limit(0)).count() == 0
    assert d.drop_contaminated(a, b.limit(0)).count() == len(docs)


def test_documents_shorter_than_the_item(spark):
    words = [f"w{i}" for i in range(59)]
    docs = [(1, " ".join(words[:-1])), (2, " ".join(words[2:])), (3, " ".join(words[:20])), (4, " ".join([*words[:30], "x", *words[31:50]])), (5, "w0 w1 w2"), (6, " ".join(words[:-1]) + " " + " ".join(f"z{i}" for i in range(9)))]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(words)), (8, "w0 w1 w2 w3")], "item_id long, text string")
    got = sorted((x.doc_id, x.item_id, round(x.similarity, 9), x.start_word, x.n_words) for x in d.contaminations(a, b).collect())
    want = [(1, 7, round(54 / 55, 9), 0, 58), (2, 7, round(53 / 55, 9), 0, 57), (6, 7, round(54 / 56, 9), 0, 59)]
    assert [x for x in got if x[1] == 7] == want
    assert [x[:2] for x in got if x[1] == 8] == [(1, 8), (3, 8), (4, 8), (6, 8)]
    assert sorted(x.doc_id for x in d.drop_contaminated(a, b.where("item_id = 7")).collect()) == [3, 4, 5]


def test_repeated_items_hide_no_finds(spark):
    words = [f"w{i}" for i in range(59)]
    docs = [(1, " ".join([*words[:30], "changed", *words[31:]])), (2, " ".join([*words[:27], *[f"y{i}" for i in range(5)], *words[32:]]))]
    a = spark.createDataFrame(docs, "doc_id long, text string")
    for copies in (1, 2, 5):
        items = [(i, " ".join(words).upper() if i % 2 else "  ".join(words)) for i in range(copies)]
        b = spark.createDataFrame(items, "item_id long, text string")
        got = sorted((x.doc_id, x.item_id, round(x.similarity, 9)) for x in d.contaminations(a, b).collect())
        assert got == [(1, i, round(50 / 60, 9)) for i in range(copies)]
        assert [x.doc_id for x in d.drop_contaminated(a, b).collect()] == [2]


def test_items_on_one_template_hide_no_near_finds(spark):
    """45 of 60 words are the template's; one of these is changed in the copies."""
    template = [f"t{i}" for i in range(45)]
    for n in (1, 2, 5, 20):
        items = [[*template[:20], *[f"i{j}x{k}" for k in range(15)], *template[20:]] for j in range(n)]
        docs = [(j, " ".join(["before", *items[j][:50], "changed", *items[j][51:], "after"])) for j in range(n)] + [(100, " ".join(template)), (101, " ".join([*template[:20], *[f"other{k}" for k in range(15)], *template[20:]]))]
        a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(j, " ".join(w)) for j, w in enumerate(items)], "item_id long, text string")
        got = sorted((x.doc_id, x.item_id, round(x.similarity, 9)) for x in d.contaminations(a, b).collect())
        assert got == [(j, j, round(51 / 61, 9)) for j in range(n)]
        assert sorted(x.doc_id for x in d.drop_contaminated(a, b).collect()) == [100, 101]


def test_near_values_of_items_or_of_windows_find_the_same():
    r = np.random.default_rng(5)
    prints = r.integers(0, 2**63, 300, np.uint64)
    windows = np.concatenate([r.integers(0, 2**63, 200, np.uint64), *[prints[:40] ^ np.bitwise_or.reduce(np.uint64(1) << r.choice(64, n, False).astype(np.uint64)) for n in range(12, 18)]])
    items = [{"print": p} for p in prints]
    one, two = d.Index(items).within(windows), d.Index(items, False).within(windows)
    assert all((x == y).all() for x, y in zip(one, two, strict=True)) and len(one[0]) > 100


def test_many_short_items_keep_the_index_small(monkeypatch):
    import pickle

    r = np.random.default_rng(6)
    rows = [{"item_id": i, "row": i, "k": 5, "n_shingles": n, "keys": np.sort(r.integers(0, 2**63, n, np.uint64)), "counts": np.ones(n, np.int64), "weights": np.ones(n), "print": np.uint64(r.integers(0, 2**63))} for i, n in enumerate(r.integers(1, 21, 50_000).tolist())]
    for i in (5, 77):
        rows[i]["print"] = np.uint64(d.simhash(rows[i]["keys"]))
    block = d.Block(rows)
    assert len(pickle.dumps(block)) < 200_000_000
    grams = np.concatenate([r.integers(0, 2**63, 30, np.uint64), rows[5]["keys"], rows[77]["keys"]])
    assert {x[0] for x in block.search(5, grams, 0.8)} == {5, 77}


def test_long_texts_go_in_stretches(spark, monkeypatch):
    docs, items = cases(6)
    whole = (77, " ".join(t or "" for _, t in docs))
    a, b = spark.createDataFrame([whole], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(tuple, d.contaminations(a, b).collect()), key=str)
    monkeypatch.setattr(d, "STRETCH", 7)
    assert sorted(map(tuple, d.contaminations(a, b).collect()), key=str) == want and len(want) > 8


def test_recall_at_the_threshold():
    """Of items with words changed to a similarity of 0.8 or more, nearly all lie within the radius."""
    r = np.random.default_rng(7)
    found = total = 0
    for n in (20, 40, 80, 160):
        for _ in range(120):
            item = np.unique(r.integers(0, 2**63, n, np.uint64))
            window = item.copy()
            change = r.integers(1, max(2, int(0.111 * n) + 1))  # s = (n - c) / (n + c) from 0.8 up
            window[:change] = r.integers(0, 2**63, change, np.uint64)
            total += 1
            found += int(np.uint64(d.simhash(item)) ^ np.uint64(d.simhash(window))).bit_count() <= d.RADIUS
    assert found / total >= 0.97
