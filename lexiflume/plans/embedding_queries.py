"""Registered queries of embedders and of the ordering by several scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiflume.functions.text import rewritten
from lexiflume.operators import bm25, embedding, fusion, vectors
from lexiflume.plans.indexed import index
from lexiflume.registered import query
from lexiflume.sources.tables import questions, table


def _cells(source: str, key: str, prefix: str = "''") -> str:
    return f"""(select id, cast(('0x' || substr(md5(w), 1, 4))::int % 64 as int) as dim, cast(sum(case when ('0x' || substr(md5(w), 5, 4))::int % 2 = 0 then 1 else -1 end) as bigint) as value
    from (select {key} as id, unnest(regexp_extract_all(lower({prefix} || text), '[\\p{{L}}\\p{{N}}_]+')) as w from {source}) group by all)"""


def _texts(spark, d, name, key):
    return table(spark, d, name).select(F.col(key).alias("id"), "text")


@query("V10", f"select * from {_cells('documents', 'doc_id')}")
def v10(spark, d):
    return embedding.hashed_cells(_texts(spark, d, "documents", "doc_id"))


@query("V13", "select * from " + _cells("benchmark", "item_id", "'query: '"))
def v13(spark, d):
    return embedding.hashed_cells(_texts(spark, d, "benchmark", "item_id"), "query: ")


@query("V12", f"""with q as {_cells('benchmark', 'item_id')}, c as {_cells('documents', 'doc_id')},
qn as (select id, sqrt(sum(value * value)::double) as n from q group by 1), cn as (select id, sqrt(sum(value * value)::double) as n from c group by 1),
s as (select q.id as query_id, c.id as vec_id, sum(q.value * c.value)::double as d from q join c using (dim) group by all),
r as (select query_id, vec_id, round(d / qn.n / cn.n, 6) as score from s join qn on qn.id = query_id join cn on cn.id = vec_id where qn.n > 0 and cn.n > 0),
k as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from r) select query_id, vec_id, round(score, 3) as score from k where rank <= 5""")
def v12(spark, d):
    q = embedding.hashed_vectors(_texts(spark, d, "benchmark", "item_id")).withColumnRenamed("id", "query_id")
    c = embedding.hashed_vectors(_texts(spark, d, "documents", "doc_id")).withColumnRenamed("id", "vec_id")
    return vectors.nearest(q, c, 5).select("query_id", "vec_id", F.round("score", 3).alias("score"))


@query("V11", f"with {bm25.SQL} select doc_id, term, round(idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)), 4) as weight from postings join terms using (term) join lengths using (doc_id), corpus")
def v11(spark, d):
    return embedding.sparse_weights(index(spark, d)).select("doc_id", "term", F.round("weight", 4).alias("weight"))


@query("V02", "select a.vec_id, round(list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), 4) + 0.0 as score from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def v02(spark, d):
    e = table(spark, d, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", (F.round(vectors.cosine("embedding", "other"), 4) + 0.0).alias("score"))


@query("K04", f"""with {bm25.RANKED}, h as (select query_id, doc_id, bm25_rank as rank, case when doc_id % 3 = 0 then null else doc_id % 5 / 5.0::double end as rerank_score, case when doc_id % 4 = 0 then null else doc_id % 7 / 7.0::double end as dense_score from hits where bm25_rank <= 20),
o as (select *, row_number() over (partition by query_id order by rerank_score desc nulls last, dense_score desc nulls last, rank) as final_rank from h) select query_id, doc_id, final_rank from o where final_rank <= 5""")
def k04(spark, d):
    hits = index(spark, d).search(questions(spark, d), 20)
    scored = hits.select("query_id", "doc_id", F.col("bm25_rank").alias("rank"), F.expr("case when doc_id % 3 = 0 then null else doc_id % 5 / 5.0D end").alias("rerank_score"), F.expr("case when doc_id % 4 = 0 then null else doc_id % 7 / 7.0D end").alias("dense_score"))
    return fusion.rerank(scored).select("query_id", "doc_id", F.col("final_rank").cast("long").alias("final_rank"))


@query("R10", "select item_id, case when item_id % 2 = 0 then 'rewritten ' || item_id else text end as query from benchmark")
def r10(spark, d):
    answer = F.expr("case when item_id % 2 = 0 then concat('\"rewritten ', item_id, '\"') end")
    return table(spark, d, "benchmark").select("item_id", rewritten(answer, "text").alias("query"))
