import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexiflume.operators import chunking, correction, evaluation, fusion, graph, vectors
from lexiflume.operators.bm25 import Bm25Index
from lexiflume.plans import retrieval
from lexiflume.sources import store
from lexiflume.streaming import incremental


def plain_bm25(docs, query, k1=1.5, b=0.75):
    words = {i: t.split() for i, t in docs}
    n, avgdl = len(docs), sum(map(len, words.values())) / len(docs)
    df = Counter(w for ws in words.values() for w in set(ws))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: 0.25 * mean if x < 0 else x for w, x in raw.items()}
    return {i: sum(idf[w] * ws.count(w) * (k1 + 1) / (ws.count(w) + k1 * (1 - b + b * len(ws) / avgdl)) for w in query.split() if w in ws) for i, ws in words.items()}


def test_bm25_against_the_formula(spark):
    r = random.Random(1)
    docs = [(i, " ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 12)))) for i in range(30)]
    queries = [(1, "a b a"), (2, "h zz"), (3, "zz"), (4, "")]
    index = Bm25Index.build(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {}
    for x in index.search(spark.createDataFrame(queries, "query_id long, query string"), 10).collect():
        got.setdefault(x.query_id, []).append((x.bm25_rank, x.doc_id, round(x.score, 6)))
    for q, text in queries:
        want = sorted(plain_bm25(docs, text).items(), key=lambda p: (-round(p[1], 6), p[0]))[:10]
        assert sorted(got[q]) == [(i + 1, d, round(s, 6)) for i, (d, s) in enumerate(want)]


def test_nearest_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    r = random.Random(2)
    rows = [(i, [r.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)]) for i in range(40)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = vectors.nearest(e.where("vec_id < 8").select(F.col("vec_id").alias("query_id"), "embedding"), e, 5).collect()

    def cos(a, b):
        n = math.hypot(*a) * math.hypot(*b)
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / n, 6) + 0.0 if n else 0.0

    for q, v in rows[:8]:
        want = sorted(((-cos(v, w), i) for i, w in rows))[:5]
        assert [(x.vec_id) for x in sorted(got, key=lambda x: x.rank) if x.query_id == q] == [i for _, i in want]


def test_filter_relaxes_per_query(spark):
    df = spark.createDataFrame([(1, 10, True), (1, 11, False), (2, 10, False), (2, 12, False)], "query_id long, doc_id long, ok boolean")
    assert sorted(map(tuple, fusion.relaxed(df, F.col("ok")).select("query_id", "doc_id", "filter_relaxed").collect())) == [(1, 10, False), (2, 10, True), (2, 12, True)]


def test_context_cuts_the_block_that_goes_over(spark):
    df = spark.createDataFrame([(1, 1, "a" * 6), (1, 2, "b" * 6), (1, 3, "c" * 6)], "query_id long, position int, block string")
    assert fusion.context(df, 13, "..").first().context == "aaaaaa\n\nbbb.."
    assert fusion.context(df, 10, "..").first().context == "aaaaaa"  # the marker alone would not say anything
    assert fusion.context(df, 14, "..").first().context == "aaaaaa\n\nbbbbbb"
    assert len(fusion.context(df.withColumn("block", F.repeat("block", F.lit(9))), 60).first().context) == 54
    assert fusion.context(df.withColumn("block", F.repeat("block", F.lit(9))), 80).first().context == "a" * 54 + "\n\n" + "b" * 11 + fusion.CUT


def test_crag_branches(spark):
    hits = spark.createDataFrame([(1, "a", 1, 0.9), (1, "b", 2, 0.5), (2, "a", 1, 0.5), (2, "b", 2, 0.1), (3, "a", 1, 0.1)], "query_id long, chunk_id string, rank int, p double")
    outside = spark.createDataFrame([(q, f"x{i}", i) for q in (1, 2, 3) for i in (1, 2, 3, 4)], "query_id long, chunk_id string, rank int")
    got = sorted((x.query_id, x.chunk_id) for x in correction.crag(hits, outside).collect())
    assert got == [(1, "a"), (1, "b"), (2, "a"), (2, "x1"), (2, "x2"), (2, "x3"), (3, "x1"), (3, "x2"), (3, "x3")]


def test_markdown_headers(spark):
    text = "intro\n# S\n## C1\n### M1\n#### A1\none\ntwo\n## C2\n#### A2\nthree"
    got = {(x.source, x.chapter, x.section, x.article, x.content) for x in chunking.header_split(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert got == {(None, None, None, None, "intro"), ("S", "C1", "M1", "A1", "one\ntwo"), ("S", "C2", None, "A2", "three")}


def test_packing_and_clauses(spark):
    df = spark.createDataFrame([(0, i, n) for i, n in enumerate([50, 60, 900, 10, 2000, 5])], "g int, i int, n int")
    assert [x.batch for x in chunking.pack_batches(df, "g", "i", "n", 1000).orderBy("i").collect()] == [0, 0, 1, 2, 3, 4]
    t = spark.createDataFrame([("head\n[clause] 1 aa\n[clause] 2 bb\n[clause] 3 cc",)], "t string")
    assert t.select(chunking.clause_pack("t", 20).alias("c")).first().c == ["head\n[clause] 1 aa", "[clause] 2 bb", "[clause] 3 cc"]
    with pytest.raises(ValueError):
        chunking.chunker("none")


def test_classification_and_patch(spark):
    rows = spark.createDataFrame([(1, 1)] * 3 + [(0, 1)] + [(1, 0)] * 2 + [(0, 0)] * 4, "truth int, predicted int")
    got = evaluation.classification(rows).first()
    assert (got.accuracy, got.precision, got.recall, got.f1) == (0.7, 0.75, 0.6, 0.6667)
    assert evaluation.classification(rows.limit(0)).first().f1 == 0.0
    base = spark.createDataFrame([(1, 0.1, "a"), (2, None, "b")], "query_id long, s double, t string")
    new = spark.createDataFrame([(2, 0.5)], "query_id long, s double")
    assert sorted(map(tuple, evaluation.patch(base, new, ["s"]).collect())) == [(1, 0.1, "a"), (2, 0.5, "b")]


def test_upsert_and_labels(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("b", 4), ("c", 5)], "k string, v int")
    assert sorted(map(tuple, graph.upsert(old, new, "k", "v").collect())) == [("a", 1), ("b", 4), ("c", 5)]
    edges = spark.createDataFrame([("a", "b", 5), ("b", "c", 5), ("x", "y", 1)], "source string, target string, weight int")
    assert {x.name: x.degree for x in graph.degrees(edges).collect()} == {"a": 1, "b": 2, "c": 1, "x": 1, "y": 1}


def test_stream_of_upserts_equals_the_batch(spark, tmp_path):
    rows = [(i % 7, i, float(i)) for i in range(60)]
    for part in range(4):
        spark.createDataFrame(rows[part::4], "id long, seq long, v double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = []
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema("id long, seq long, v double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        incremental.run_upserts(spark, stream, f"file://{tmp_path}/out", "id", "seq", lambda df, n: seen.append(df.count()))
    want = incremental.latest(spark.createDataFrame(rows, "id long, seq long, v double"), "id", "seq")
    assert sorted(map(tuple, incremental.current(spark, f"file://{tmp_path}/out").collect())) == sorted(map(tuple, want.collect()))
    assert seen == [7] * 4  # every batch changed all seven


def test_strategies_and_methods():
    with pytest.raises(ValueError):
        retrieval.strategy("none")
    assert retrieval.checked_methods("rag_fusion", ["hyde"], ["crag"]) == ([], [])
    with pytest.raises(ValueError):
        retrieval.checked_methods(None, ["nope"], [])


def test_catalog_and_vector_store(spark, tmp_path):
    c = store.Catalog()
    c.register("vector", spark.range(3))
    assert c.get("qdrant").count() == 3
    with pytest.raises(ValueError):
        c.get("other")
    v = store.VectorStore(spark, f"file://{tmp_path}/v")
    assert not v.is_available()
    with pytest.raises(FileNotFoundError):
        v.load()
    v.save(spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>"))
    assert sorted(x.embedding for x in v.load().collect()) == [[0.0, 0.0], [0.6, 0.8]]


def test_spans_of_running_sums(spark, monkeypatch):
    r = random.Random(3)
    tokens = [(doc, pos, [r.gauss(0, 1) for _ in range(3)]) for doc, n in ((1, 9000), (2, 5), (3, 1)) for pos in range(n) if pos % 7]
    spans = [(1, f"s{i}", a, a + n) for i, (a, n) in enumerate([(0, 10), (5, 10), (4090, 20), (0, 9000), (8000, 5000), (7, 1), (3, 0), (20, -4)])] + [(2, "s0", 1, 3), (3, "s0", 0, 9), (4, "s0", 0, 5), (2, "again", 1, 3)]
    t = spark.createDataFrame(tokens, "doc_id long, pos int, embedding array<double>").repartition(5)
    s = spark.createDataFrame(spans, "doc_id long, span string, start int, end int")
    for most in (None, 4100):
        want = {}
        for doc, name, a, z in spans:
            z = z if most is None else min(z, most - 1)
            inside = [v for d, p, v in tokens if d == doc and a <= p < z]
            if inside:
                mean = [sum(c) / len(inside) for c in zip(*inside, strict=True)]
                want[doc, name] = [round(x / math.hypot(*mean), 6) + 0.0 for x in mean]
        got = {(x.doc_id, x.span): [round(c, 6) + 0.0 for c in x.embedding] for x in vectors.pooled_spans(t, s, most).collect()}
        assert got == want


def test_passages_in_one_pass(spark):
    from lexiflume.operators.passages import containing

    docs = [(1, "the cat sat on the mat"), (2, "a cat sat."), (3, None), (4, ""), (5, "x" * 50_000 + "needle" + "é" * 9)]
    asked = [(1, "cat sat"), (2, "cat sat"), (3, "t"), (4, "needleé"), (5, "dog"), (6, None), (7, ""), (8, "the cat sat on the mat!")]
    q, d = spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = sorted((i, j) for i, p in asked for j, t in docs if p is not None and t is not None and p in t)
    for block in (1_000_000, 8):
        assert sorted((x.query_id, x.doc_id) for x in containing(q, d, block).collect()) == want


def test_longest_common_subsequence_by_bits():
    from lexiflume.functions.metrics import lcs_length

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    r = random.Random(2)
    for _ in range(60):
        a, b = ([r.choice("abcde"[: r.randint(1, 5)]) for _ in range(r.randint(0, 200))] for _ in range(2))
        assert lcs_length(a, b) == plain(a, b)
    a, b = ([str(r.randint(0, 500)) for _ in range(20_000)] for _ in range(2))
    import time

    began = time.time()
    assert 0 < lcs_length(a, b) < 20_000
    assert time.time() - began < 2


def test_sessions_match_by_their_critical_settings(spark):
    import json

    from lexiflume.sources.reports import CRITICAL, resumable

    base = {k: k for k in CRITICAL} | {"preprocessing": ["b", "a"], "skip_ragas": False, "limit": 5}
    sessions = [
        ("other", 9, "x", base | {"top_k": 9}, 3), ("lists", 5, "x", base | {"preprocessing": ["a", "b"], "noise": 1}, 3), ("newer", 6, "y", base, 2), ("empty", 8, "z", base, 0),
        ("skips", 7, "s", base | {"skip_ragas": True, "ragas_service": "one"}, 1), ("null", 4, "n", base | {"seed": None}, 1),
    ]
    runs = [("a", "none", base), ("b", "x", base), ("c", "y", base | {"skip_ragas": True, "ragas_service": "two"}), ("d", "n", base | {"seed": ""}), ("e", "n", base | {"seed": 1})]
    s = spark.createDataFrame([(n, w, g, json.dumps(c), d) for n, w, g, c, d in sessions], "session string, written int, signature string, config string, n_done int")
    w = spark.createDataFrame([(n, g, json.dumps(c)) for n, g, c in runs], "run string, signature string, config string")
    assert dict(map(tuple, resumable(s, w).collect())) == {"a": "newer", "b": "newer", "c": "skips", "d": "null"}
    assert dict(map(tuple, resumable(s.where("session <> 'other'"), w).collect()))["b"] == "lists"
