"""Filters, bounds and pivots: the same rows as plain Python over all pairs, with slices passed over."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiflume.config import EngineConfig
from lexiflume.operators import vectors
from lexiflume.operators.bm25 import Bm25Index, tags
from lexiflume.operators.topk import Best
from lexiflume.operators.vectors import VectorIndex
from lexiflume.plans import retrieval
from lexiflume.plans.retrieval import Retriever
from lexiflume.providers import Providers
from tests.core.test_operators import plain_bm25

DOCS = "doc_id long, text string, article_no int, clause_nos array<int>"


def corpus(seed, n):
    r = random.Random(seed)
    words = [f"w{int(30 * r.random() ** 3)}" for _ in range(4000)]
    return [(i, " ".join(r.choice(words) for _ in range(int(60 * r.random() ** 3))), r.choice([None, 1, 2, 3]), r.sample([1, 2, 3], r.randint(0, 2))) for i in range(n)]


def best(docs, query, k, article=None, clauses=(), relax=True):
    """(doc_id, score, relaxed) in order."""
    scores = plain_bm25([(i, t) for i, t, _, _ in docs], query)
    allowed = [i for i, _, a, c in docs if (article is None or a == article) and all(x in c for x in clauses)]
    filtered = article is not None or clauses
    relaxed = bool(filtered and not allowed and relax)
    rows = sorted(((i, round(scores[i], 6)) for i in (range(len(docs)) if relaxed else allowed)), key=lambda p: (-p[1], p[0]))[:k]
    return [(i, s, relaxed) for i, s in rows]


@pytest.mark.parametrize("docs_a_slice", [7, 1024])
def test_filtered_search_against_all_pairs(spark, docs_a_slice):
    docs = corpus(3, 150)
    asked = [(1, "w0 w1 w0", 1, []), (2, "w5 w25", 2, [1]), (3, "nothing", 3, [2, 3]), (4, "w2", None, []), (5, "w3 w4", None, [1, 2, 3]), (6, "", 9, []), (7, "w1", 1, [1, 2])]
    index = Bm25Index.build(spark.createDataFrame(docs, DOCS).repartition(3), fields={"article_no": "article_no", "clause_nos": "clause_nos"}, slice_docs=docs_a_slice)
    queries = spark.createDataFrame(asked, "query_id long, query string, a int, c array<int>").withColumn("tags", tags(article_no=(F.col("a"), False), clause_nos=(F.col("c"), True)))
    for relax in (True, False):
        got = {}
        for x in index.search(queries, 12, relax).orderBy("query_id", "bm25_rank").collect():
            got.setdefault(x.query_id, []).append((x.doc_id, round(x.score, 6), x.filter_relaxed))
        for q, text, a, c in asked:
            assert got.get(q, []) == best(docs, text, 12, a, c, relax), (q, relax)


def test_bounds_pass_slices_over(spark):
    """A corpus in which one topic's documents are short and alike: a question about them leaves most slices alone, with the same rows."""
    r = random.Random(5)
    docs = [(i, " ".join(["topic"] * 3 + [f"t{r.randint(0, 3)}"])) for i in range(30)]
    docs += [(i, " ".join(f"x{r.randint(0, 40)}" for _ in range(40)) + (" topic" if r.random() < 0.1 else "")) for i in range(30, 1200)]
    index = Bm25Index.build(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), slice_docs=20)
    queries = spark.createDataFrame([(1, "topic t1"), (2, "topic t2 t2")], "query_id long, query string")
    got = {}
    for x in index.search(queries, 10).orderBy("query_id", "bm25_rank").collect():
        got.setdefault(x.query_id, []).append((x.doc_id, round(x.score, 6)))
    for q, text in ((1, "topic t1"), (2, "topic t2 t2")):
        scores = plain_bm25(docs, text)
        assert got[q] == sorted(((i, round(s, 6)) for i, s in scores.items()), key=lambda p: (-p[1], p[0]))[:10]
    seen = index.scanned(queries, 10).first()
    assert seen.pairs == 2 * seen.slices and seen.untouched > 0.8 * seen.slices and seen.scored < 0.2 * seen.pairs


def test_best_keeps_what_plain_sorting_keeps():
    r = np.random.default_rng(1)
    for _ in range(40):
        k, n = int(r.integers(1, 6)), int(r.integers(1, 40))
        keys, scores = r.permutation(100)[:n].astype(np.int64), r.choice([-np.inf, 0.0, 0.5, 0.25, 1e-9], (3, n))
        best = Best(3, k)
        for at in range(0, n, 7):
            best.add(keys[at : at + 7], scores[:, at : at + 7])
        for q in range(3):
            want = sorted((-round(s, 6), i) for s, i in zip(scores[q], keys, strict=True) if s > -np.inf)[:k]
            assert sorted(zip(-np.round(best.scores[q], 6), best.keys[q], strict=True)) == want
            if len(want) == k:
                assert best.closed(np.full(3, -want[-1][0]), want[-1][1] + 1)[q]
                assert not best.closed(np.full(3, -want[-1][0]), want[-1][1] - 1)[q]


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_pivots_give_the_full_scan(spark, metric):
    r = random.Random(7)
    centres = [[r.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(i, [x + r.gauss(0, 0.02) for x in r.choice(centres)], r.sample([1, 2], r.randint(0, 2))) for i in range(900)]
    rows += [(1000 + i, rows[5][1], [1]) for i in range(200)] + [(2000, [0.0] * 8, [1]), (2001, [0.0] * 8, []), (2002, None, [1]), (2003, [1.0, 2.0], [2])]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<double>, tags array<long>").repartition(4)
    index = VectorIndex.build(corpus, metric, 16)
    plain = spark.createDataFrame([(i, rows[i * 40][1]) for i in range(12)] + [(50, [0.0] * 8), (51, [2.0, 1.0]), (52, [r.gauss(0, 1) for _ in range(8)])], "query_id long, embedding array<double>")
    want = sorted(map(tuple, vectors.nearest(plain, corpus, 7, metric).collect()))
    assert sorted(map(tuple, index.search(plain, 7).collect())) == want and len(want) == 14 * 7 + 1
    tagged = plain.withColumn("tags", F.expr("case query_id % 3 when 0 then array(1L) when 1 then array(1L, 2L) else array(3L) end"))
    for relax in (True, False):
        want = sorted(map(tuple, vectors.nearest(tagged, corpus, 7, metric, relax).collect()))
        assert sorted(map(tuple, index.search(tagged, 7, relax).collect())) == want
        assert any(x[-1] for x in want) == relax
    seen = index.scanned(plain.where("query_id < 12"), 7).first()
    assert seen.scored < 0.3 * seen.pairs


def small(spark, **options):
    docs = [(i, f"rule {i} about {'land' if i % 2 else 'water'} and permits. " + "It is the law that permits are needed for it. " * (i % 4), i % 5 + 1, [i % 3 + 1], [2]) for i in range(30)]
    chunks = spark.createDataFrame(docs, "doc_id long, content string, article_no int, clause_nos array<int>, ref_article_nos array<int>")
    chunks = chunks.selectExpr("*", "cast(doc_id as string) as chunk_id", "'src' as source", "null as chapter", "cast(null as int) as chapter_no", "cast(null as int) as section_no")
    index = options.pop("index", None) or Bm25Index.build(chunks.withColumn("text", F.col("content")), fields={f: f for f in ("article_no", "chapter_no", "section_no", "clause_nos")})
    embeddings = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(40)], "vec_id long, embedding array<double>")
    return Retriever(index, chunks, embeddings, **options)


QUERIES = [(1, "permits about land, Điều 3"), (2, "article 99: water"), (3, "?!"), (4, None), (5, "khoản 2 điều 4 law")]


def asked(spark):
    return spark.createDataFrame(QUERIES, "query_id long, query string")


def test_retriever_filters_relaxes_and_leaves_wordless_queries_empty(spark):
    got = {x.query_id: x for x in small(spark).retrieve(asked(spark)).collect()}
    assert [(q, got[q].filter_applied, got[q].filter_relaxed) for q in sorted(got)] == [(1, True, False), (2, False, True), (3, False, False), (4, False, False), (5, True, False)]
    assert all(int(c) % 5 == 2 for c in got[1].selected.split(",")) and len(got[2].selected.split(",")) == 5
    assert got[3].selected == got[4].selected == got[3].context == "" and got[3].prompt.startswith("<context>\n\n</context>")
    assert "Điểm RRF: 0.0" in got[1].context and "Nguồn truy xuất: reference" in got[1].context and "Số điều được viện dẫn: 2" in got[1].context


def test_dense_search_stands_in_where_bm25_finds_nothing(spark):
    nothing = Bm25Index.build(spark.createDataFrame([], DOCS))
    r = small(spark, index=nothing)
    found = r.candidates(r.understood(asked(spark)))
    got = {}
    for x in found.orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append(x.doc_id)
    assert got[1] == [i for i in sorted(range(30), key=lambda i: (-round(math.cos(i - 1), 6), i)) if i % 5 == 2]
    assert all(i % 5 == 3 and i % 3 == 1 for i in got[5]) and got[5]  # clauses count here
    assert 2 not in got
    strict = small(spark, config=EngineConfig(relax_filter=False))
    assert strict.candidates(strict.understood(asked(spark))).where("query_id = 2").count() == 0


def test_strategies_and_steps_share_one_interface(spark):
    for name in retrieval.STRATEGIES:
        found = small(spark, advanced=name).retrieve(asked(spark).where("query_id in (1, 3)")).collect()
        assert {x.query_id: x.selected != "" for x in found} == {1: True, 3: False}, name
    outside = lambda q: q.select("query_id", F.lit("web").alias("chunk_id"), F.lit("what the web says of it all").alias("content"), F.lit(1).alias("rank"))
    none = Providers(entail=lambda q, t: F.lit(0.1), external=outside)
    found = {x.query_id: x for x in small(spark, providers=none, post=("crag",)).retrieve(asked(spark)).collect()}
    assert found[1].selected == "web" and "what the web says" in found[1].context and "Nguồn truy xuất: external" in found[1].context
    sure = Providers(entail=lambda q, t: F.when(F.contains(t, F.lit("land")), 0.9).otherwise(0.2), external=outside)
    found = {x.query_id: x for x in small(spark, providers=sure, post=("crag", "prompt_compression")).retrieve(asked(spark)).collect()}
    assert "web" not in found[1].selected and "the law that" not in found[1].context and "land" in found[1].context
    moved = Providers(embed=lambda t: t.select("id", F.array(F.lit(0.0), F.lit(1.0)).alias("embedding")))
    r = small(spark, providers=moved, pre=("hyde",))
    rows = r.candidates(r.understood(asked(spark))).where("query_id = 1").collect()
    assert all(x.dense_score == round(math.sin(x.doc_id), 4) for x in rows)
    with pytest.raises(ValueError):
        small(spark, post=("crag", "filter_rerank"))


def test_hard_ones_beyond_the_choices_and_rescued_ones(spark):
    from lexiflume.operators import correction

    rows = [(1, f"c{i}", i, 0.5 if i < 7 else 0.9) for i in range(1, 8)] + [(2, f"d{i}", i, i / 100) for i in range(1, 7)]
    hits = spark.createDataFrame(rows, "query_id long, chunk_id string, rank int, score double")
    marked = correction.screened(hits)
    assert sorted((x.chunk_id, x.place) for x in marked.where("query_id = 2").collect()) == [("d3", 3), ("d4", 2), ("d5", 1), ("d6", 0)]
    out = correction.merged(marked.withColumn("choice", F.expr("case when place = 1 then 0 end")), 100).where("query_id = 1").orderBy("final_rank").collect()
    assert [(x.chunk_id, x.final_score) for x in out] == [("c2", 0.95), ("c7", 0.9), ("c1", 0.2), ("c3", 0.2), ("c4", 0.2), ("c5", 0.15), ("c6", 0.15)]


def test_semantic_chunks_tile_the_text(spark):
    from lexiflume.functions.text import tokens
    from lexiflume.operators import chunking

    texts = [(1, "cats purr. cats sleep! cats purr.\n\ndogs bark; dogs run. dogs bark? 3.14 is pi"), (2, "one sentence only"), (3, None), (4, ""), (5, "...\n!? x")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    embed = lambda t: t.where("text like '%s %'").select("id", F.when(F.col("text").like("cats%"), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("embedding"))
    rows = chunking.semantic_chunks(docs, embed, 0.8).orderBy("doc_id", "chunk").collect()
    words = {x.doc_id: x.w for x in docs.select("doc_id", tokens("text").alias("w")).collect()}
    for doc, text in texts:
        mine = [x for x in rows if x.doc_id == doc]
        assert "".join(text[x.start : x.end] for x in mine) == (text or "")
        assert [w for x in mine for w in words[doc][x.token_start : x.token_end]] == words[doc]
    assert [texts[0][1][x.start : x.end] for x in rows if x.doc_id == 1] == ["cats purr. cats sleep! cats purr.\n\n", "dogs bark; dogs run. dogs bark? 3.14 is pi"]


def test_catalog_asks_ingests_and_reports(spark, tmp_path):
    from lexiflume.sources import store

    c = store.Catalog()
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string").coalesce(1).write.parquet(f"{tmp_path}/t")
    c.open(spark, "vector", f"file://{tmp_path}/t")
    c.open(spark, "graph", f"file://{tmp_path}/none")
    assert sorted(map(tuple, c.status(spark).collect())) == [("graph", False, 0, 0), ("vector", True, 1, 2)]
    c.searches["vector"] = lambda q, k: q.crossJoin(c.get("vector")).limit(k)
    c.ingest("qdrant", spark.createDataFrame([(2, "new"), (3, "c")], "id long, v string"), "id")
    assert dict(map(tuple, c.get("dense").collect())) == {1: "a", 2: "new", 3: "c"}
    assert c.query("dense", spark.range(1), 2).count() == 2
    with pytest.raises(ValueError):
        c.query("graph", spark.range(1), 2)


def test_densities_subsets_and_request_bodies(spark):
    import json

    from lexiflume.operators import evaluation
    from lexiflume.sources import store

    values = [1.0, 2.0, 2.0, 7.5, None]
    got = evaluation.kernel_density(spark.createDataFrame([(v,) for v in values], "v double"), "v", 5).orderBy("x").collect()
    v = [x for x in values if x is not None]
    h = np.std(v, ddof=1) * len(v) ** -0.2
    for i, row in enumerate(got):
        x = 1 + i * 6.5 / 4
        assert math.isclose(row.x, x) and math.isclose(row.density, sum(math.exp(-(((x - y) / h) ** 2) / 2) for y in v) / (len(v) * h * math.sqrt(2 * math.pi)))
    assert evaluation.kernel_density(spark.createDataFrame([(1.0,), (1.0,)], "v double"), "v").count() == 0
    run = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1), (3, 9, 1)], "query_id long, doc_id long, rank int")
    qrels = spark.createDataFrame([(1, 11), (2, 10), (3, 8)], "query_id long, doc_id long")
    subsets = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "query_id long, subset string")
    scores = {x.subset: (x.n, x.main_score) for x in evaluation.main_scores(run, qrels, subsets).collect()}
    first = round((1 / math.log2(3) + 1) / 2, 4)
    assert scores == {"a": (2, first), "b": (1, 0.0), "all": (3, round(first / 2 + 1e-9, 4))}
    bodies = store.upsert_batches(spark.range(250).coalesce(1), 100).collect()
    assert sorted(b.n for b in bodies) == [50, 100, 100] and sorted(p["id"] for b in bodies for p in json.loads(b.body)) == list(range(250))
