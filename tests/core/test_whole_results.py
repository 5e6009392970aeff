"""Queries that give their whole results, and prompts that keep their lines."""

import glob
import os
from dataclasses import replace

import pytest
from pyspark.errors import AnalysisException

from lexiflume.config import DEFAULTS
from lexiflume.operators import generation
from lexiflume.operators.bm25 import Bm25Index, tags
from lexiflume.plans.embedding_queries import v11
from lexiflume.plans.retrieval_queries import w01
from lexiflume.operators.fusion import CUT
from lexiflume.plans.retrieval import Retriever
from lexiflume.sources.store import Catalog
from lexiflume.sources.tables import chunks, questions, table
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_choices_for_a_question_of_two_lines(spark):
    rows = spark.createDataFrame([("what is\nA rule", ["0", "what is A rule", "1"])], "query string, passages array<string>")
    assert generation.multi_choice(rows).first().choices == [1]


def test_w01_ranks_every_english_document(spark):
    english = table(spark, SF, "documents").where("lang = 'en'").count()
    assert english > 100 or w01(spark, SF).groupBy("query_id").count().where(f"count <> {english}").isEmpty()
    n = table(spark, SF, "benchmark").count()
    assert w01(spark, SF).count() == n * english


def test_scores_of_all_documents_with_tags(spark):
    docs = spark.createDataFrame([(i, f"w{i % 3} x{i}", i % 2) for i in range(300)], "doc_id long, text string, kind int")
    index = Bm25Index.build(docs, fields={"kind": "kind"}, slice_docs=40)
    asked = spark.createDataFrame([(7, "w1 x4"), (8, "nothing")], "query_id long, query string").withColumn("tags", tags(kind=(F.lit(1), False)))
    every = {(r.query_id, r.doc_id): r.score for r in index.scores(asked, every=True).collect()}
    assert set(every) == {(q, d) for q in (7, 8) for d in range(1, 300, 2)}
    assert all((s > 0) == (q == 7 and d % 3 == 1) for (q, d), s in every.items())
    assert {(r.query_id, r.doc_id) for r in index.scores(asked).collect()} == {(7, d) for d in range(1, 300, 2) if d % 3 == 1}


def test_v11_gives_each_term(spark):
    assert sorted(v11(spark, SF).columns) == ["doc_id", "term", "weight"]


def test_a_block_cut_in_its_heading_counts(spark):
    q = questions(spark, SF).orderBy("query_id").limit(1)
    of = lambda **c: Retriever(Bm25Index.build(table(spark, SF, "documents")), chunks(spark, SF), table(spark, SF, "embeddings"), config=replace(DEFAULTS, **c)).retrieve(q).first()
    first = of(max_context_chars=10**7).context.split("\n\n[Đoạn 2]\n")[0]
    few = of(max_context_chars=len(first) + 2 + 4 + len(CUT))
    assert few.context == f"{first}\n\n[Đoạ{CUT}" and few.n_blocks == 2


@pytest.mark.parametrize("break_it", [lambda path: [os.remove(f) for f in glob.glob(f"{path}/*.parquet")], lambda path: [open(f, "w").write("no table") for f in glob.glob(f"{path}/*.parquet")]])
def test_a_store_that_cannot_be_read_is_an_error(spark, tmp_path, break_it):
    c = Catalog()
    for name in ("vector", "graph"):
        spark.range(3).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        c.open(spark, name, f"file://{tmp_path}/{name}.parquet")
    c.open(spark, "other", f"file://{tmp_path}/other.parquet")
    assert sorted(map(tuple, c.status(spark).collect())) == [("graph", True, 1, 3), ("other", False, 0, 0), ("vector", True, 1, 3)]
    break_it(f"{tmp_path}/graph.parquet")
    with pytest.raises(RuntimeError, match="graph"):
        c.status(spark)


def test_a_store_without_a_plan_is_not_left_out(spark):
    class Gone:
        def inputFiles(self):  # noqa: N802
            raise AnalysisException("gone")

    c = Catalog()
    c.register("vector", Gone())
    with pytest.raises(RuntimeError, match="vector"):
        c.status(spark)
