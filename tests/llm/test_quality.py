import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from lexiflume.llm import quality_model, quality_rules
from lexiflume.llm.textstats import RATIOS, stats
from lexiflume.llm.words import WordHash

SF = "/root/testdata/sf0.01"


def plain(text):
    text = text or ""
    words, word = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_counts_match_brute_force():
    r = random.Random(1)
    texts = [None, "", " \n", "a b c a b c", "é é\x0bé  |x|\nsame\nsame\n \nsame ", "a a a a", "a b <#> \x1c x"]
    texts += ["".join(r.choice(["ab ", "c ", "é", "\n", "# ", "ab c ", "line\n"]) for _ in range(r.randint(0, 60))) for _ in range(300)]
    memo = WordHash()
    for t in texts:
        assert stats(t, memo)[0] == plain(t)


def held_out(rows, folds=5):
    labels = {x["doc_id"]: x["quality"] for x in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    return [(x, labels[x.doc_id]) for x in rows if x.doc_id in labels and zlib.crc32(str(x.doc_id).encode()) % folds == 0]


def test_rules_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality_rules.quality_rules(docs, labels).collect()
    assert len(rows) == docs.count()
    fair = [(x, q) for x, q in held_out(rows) if not x.base_failed]
    assert np.mean([x.kept == (q == 1) for x, q in fair]) > 0.95
    assert all(not x.kept for x in rows if x.base_failed)
    assert all(x.base_failed == (x.n_words < 50 or 100 * x.n_repeat_words > 50 * x.n_words) for x in rows)
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(x.doc_id for x in rows if x.kept)


def test_scores_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality_model.quality_scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in rows)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in rows)
    assert np.mean([x.predicted == q for x, q in held_out(rows)]) > 0.95


@pytest.mark.parametrize("f", [quality_rules.quality_rules, quality_model.quality_scores])
def test_odd_rows(spark, f):
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (None, "x " * 60, "s"), (3, "a b", "s"), (3, "a b", "s")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    nulls = spark.createDataFrame([(1, None), (None, 1), (2, 0), (3, 1), (3, 1)], "doc_id long, quality int")
    assert f(docs, none).count() == f(docs, nulls).count() == 5
    assert f(docs.limit(0), nulls).count() == 0


def test_trees_are_monotone_and_flat_scores_match_a_walk():
    r = np.random.default_rng(3)
    x = r.random((3000, 3))
    y = (r.random(3000) < 1 / (1 + np.exp(4 * x[:, 0] - 3 * np.sin(6 * x[:, 1])))).astype(float)
    trees = quality_rules.fit_trees(x, y, np.array([-1, 0, 0]), n_trees=30)
    probe = np.repeat(r.random((50, 3)), 40, 0)
    probe[:, 0] = np.tile(np.linspace(0, 1, 40), 50)
    assert (np.diff(trees.score(probe).reshape(50, 40), axis=1) <= 1e-12).all()

    def walk(row):
        total = trees.start
        for t in range(len(trees.feature)):
            node = 0
            for _ in range(trees.depth):
                node = 2 * node + 1 + int(row[trees.feature[t, node]] > trees.cut[t, node])
            total += trees.value[t, node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(trees.score(x[:50]), [walk(v) for v in x[:50]])


def test_pairwise_term_matches_all_pairs():
    r = np.random.default_rng(1)
    m = quality_model.Machine(0.3, r.normal(size=quality_model.BUCKETS + len(RATIOS)).astype(np.float32), r.normal(size=(quality_model.BUCKETS + len(RATIOS), quality_model.RANK)).astype(np.float32), np.zeros(len(RATIOS)), np.ones(len(RATIOS)))
    x = quality_model.features(["a b c b a d", "", "one TWO one"], WordHash())
    indices, values, lengths, dense = x
    at, want = 0, []
    for n, d in zip(lengths, m.rows(dense), strict=True):
        ids = [*indices[at : at + n], *range(quality_model.BUCKETS, quality_model.BUCKETS + len(RATIOS))]
        v = [*values[at : at + n], *d]
        s = m.bias + sum(m.w[i] * a for i, a in zip(ids, v, strict=True))
        s += sum(m.v[ids[i]] @ m.v[ids[j]] * v[i] * v[j] for i in range(len(v)) for j in range(i))
        want.append(1 / (1 + np.exp(-s)))
        at += n
    assert np.allclose(m.score(x), want, rtol=1e-3, atol=1e-6)


def test_scores_do_not_depend_on_partitions(spark):
    import random

    from lexiflume.llm import quality_model

    r = random.Random(12)
    docs = [(i, " ".join(r.choice(("good", "fine", "prose") if i % 2 else ("spam", "buy", "now!!!")) + str(r.randint(0, 9)) for _ in range(r.randint(5, 60)))) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    one, two = ({x.doc_id: x.score for x in quality_model.quality_scores(df.repartition(n), labels.repartition(n)).collect()} for n in (2, 5))
    assert one == two and len(one) == 200


def test_batches_of_texts_are_small():
    import pyarrow as pa

    from lexiflume.llm import quality_rules

    batch = pa.RecordBatch.from_pydict({"text": [str(i) for i in range(1203)]})
    parts = list(quality_rules._few([batch, batch.slice(0, 0)]))
    assert max(p.num_rows for p in parts) <= 500
    assert [t for p in parts for t in p.column("text").to_pylist()] == batch.column("text").to_pylist()
