"""Some of the registered queries against their SQL on the smallest tables, and the whole job end to end."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lexiflume.operators.bm25 import Bm25Index
from lexiflume.plans.evaluation import EvalJob, formatted
from lexiflume.plans.retrieval import Retriever
from lexiflume.sources.tables import chunks, questions, table

SF = "/root/testdata/sf0.001"
SOME = ["K01", "R01", "R05", "V03", "E07", "A02", "C01", "C08", "X05", "X16", "J04", "F04", "R11", "G05", "U01", "S02", "E10", "K04", "V12"]


def same(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    return x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(map(same, r)) for r in df.select(cols).collect()), key=str)
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted((tuple(same(r[i]) for i in at) for r in rel.fetchall()), key=str)


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_evaluation_resumes(spark):
    r = Retriever(Bm25Index.build(table(spark, SF, "documents")), chunks(spark, SF), table(spark, SF, "embeddings"))
    job, q = EvalJob(r), questions(spark, SF)
    whole = job.run(q)
    half = whole.where("query_id % 2 = 0")
    assert sorted(map(str, job.run(q, half).collect())) == sorted(map(str, whole.collect()))
    assert "n=40" in formatted(job.summary(whole)[0])
    assert job.config(spark).first().rrf_k == 60
