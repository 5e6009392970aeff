"""The evaluation job: answers with time-outs and error rows, and runs that go on, are judged and end in a report."""

import json
import time

import pytest

from lexiflume.operators.bm25 import Bm25Index
from lexiflume.plans import evaluation_queries
from lexiflume.plans.evaluation import ANSWER_METRICS, JUDGED, METRICS, Bm25Retriever, EvalJob
from lexiflume.sources.reports import ReportWriter, read_report
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def job(spark):
    docs = spark.createDataFrame([(i, f"w{i} common word", i % 3, [1]) for i in range(12)], "doc_id long, text string, article_no int, clause_nos array<int>")

    def call(prompt):
        if "fail" in prompt:
            raise ValueError("broken")
        if "slow" in prompt:
            time.sleep(20)
        return "w1 common word"

    made = Bm25Retriever(Bm25Index.build(docs), docs.withColumnRenamed("text", "content"))
    rows = [(1, "w1 common", 1, "a", "w1 common word"), (2, "w2 slow", 2, "b", "w2 common word"), (3, "w4 fail", 1, "a", "x"), (4, "w5", 2, None, None)]
    q = spark.createDataFrame([(i, t, a, [], k, x) for i, t, a, k, x in rows], "query_id long, query string, gt_article int, gt_clauses array<int>, question_type string, truth string")
    return EvalJob(made, call, timeout=4.0), q


def test_time_outs_and_errors_are_rows(job):
    rows = {r.query_id: r for r in job[0].cases(job[1]).collect()}
    assert {k: (r.failed, r.late) for k, r in rows.items()} == {1: (False, False), 2: (True, True), 3: (True, False), 4: (False, False)}
    assert rows[1].f1 == rows[1].em == rows[1].rouge_l == 1.0 and rows[1].contexts[0] == "w1 common word"
    assert "Timeout" in rows[2].answer and all(rows[2][m] == 0 for m in METRICS + ANSWER_METRICS)
    assert "broken" in rows[3].answer and rows[3].hit == 1.0 and rows[3].f1 == 0


def test_a_run_goes_on_is_judged_and_reported(spark, job, tmp_path):
    run, q = job
    report = lambda: ReportWriter(spark, f"file://{tmp_path}", "s", "1", 4, METRICS + ANSWER_METRICS + JUDGED, tuple(JUDGED))
    run.answer(q.where("query_id = 1"), report())
    before = report().cases.read().select("query_id", "latency_ms").collect()
    cases = run.full(q, report())
    assert sorted(r.query_id for r in cases.collect()) == [1, 2, 3, 4]
    assert cases.where("query_id = 1").select("query_id", "latency_ms").collect() == before
    assert cases.where(" or ".join(f"{m} is null" for m in JUDGED)).isEmpty() and cases.where("query_id = 1").first().faithfulness == 1.0
    rows = read_report(spark, report().paths[1]).collect()
    assert json.loads(next(r.body for r in rows if r.kind == "metadata"))["status"] == "completed"
    assert sum(r.kind == "case" for r in rows) == 4


@pytest.mark.parametrize("name, steps", [("e16", ["cases"]), ("e17", ["answer", "cases", "full"])])
def test_queries_run_the_job(spark, monkeypatch, name, steps):
    called = set()
    for step in ("cases", "answer", "full"):
        own = getattr(EvalJob, step, None)
        monkeypatch.setattr(EvalJob, step, lambda *a, own=own, step=step, **k: called.add(step) or own(*a, **k), raising=False)
    got = getattr(evaluation_queries, name, evaluation_queries.a03)(spark, SF)
    assert sorted(called) == steps
    want = evaluation_queries.a03(spark, SF)
    assert got.columns == want.columns and got.collect() == want.collect()
