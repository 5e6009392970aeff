"""Registered queries of sources and sinks: each writes, reads again and shows what came back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiflume.operators.bm25 import RANKED, SQL, Bm25Index
from lexiflume.operators.vectors import nearest
from lexiflume.plans.indexed import index
from lexiflume.registered import query
from lexiflume.sources import store
from lexiflume.sources.tables import CHUNKS, chunks, questions, table

for _name in ("S02", "S03"):

    @query(_name, f"with {CHUNKS} select chunk_id, md5(content) as digest, article_no, array_to_string(clause_nos, ',') as clauses from chunks")
    def s02(spark, d):
        path = store.scratch_path(spark, "chunks")
        store.save_chunks(chunks(spark, d).select("chunk_id", "content", "source", "article", "article_no", "clause_nos"), path)
        back = store.load_chunks(spark, path)
        return back.select("chunk_id", F.md5("content").alias("digest"), "article_no", F.array_join(F.col("clause_nos").cast("array<string>"), ",").alias("clauses"))


for _name in ("S04", "S05"):

    @query(_name, "select vec_id, round(cast(embedding[1] as double) / sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))), 4) as first from embeddings")
    def s04(spark, d):
        vectors = store.VectorStore(spark, store.scratch_path(spark, "vectors"))
        vectors.save(table(spark, d, "embeddings").select("vec_id", "embedding"))
        return vectors.load().select("vec_id", F.round(F.col("embedding")[0], 4).alias("first"))


for _name in ("S06", "S07"):

    @query(_name, f"with {RANKED} select query_id, doc_id from hits where bm25_rank <= 10")
    def s06(spark, d):
        path = store.scratch_path(spark, "bm25")
        Bm25Index.build(table(spark, d, "documents")).save(path)
        return Bm25Index.load(spark, path).search(questions(spark, d), 10).select("query_id", "doc_id")


@query("S08", f"with {SQL} select 'vector' as store, count(*) as postings, cast(sum(tf) as bigint) as tokens from postings union all select 'benchmark', count(*), cast(sum(tf) as bigint) from (select item_id, term, count(*) as tf from (select item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) as term from benchmark) group by all)")
def s08(spark, d):
    out = None
    for name, docs in (("vector", table(spark, d, "documents")), ("benchmark", table(spark, d, "benchmark").withColumnRenamed("item_id", "doc_id"))):
        row = Bm25Index.build(docs).postings.agg(F.count("*").alias("postings"), F.sum("tf").alias("tokens")).select(F.lit(name).alias("store"), "postings", "tokens")
        out = row if out is None else out.unionByName(row)
    return out


@query("S10", "select vec_id, cast(len(embedding) as bigint) as dim from embeddings")
def s10(spark, d):
    missing = store.vectors_or_empty(spark, store.scratch_path(spark, "nothing")).select("vec_id", F.size("embedding").cast("long").alias("dim"))
    return store.vectors_or_empty(spark, f"{d}/embeddings.parquet").select("vec_id", F.size("embedding").cast("long").alias("dim")).unionByName(missing)


@query("S13", "select user_id, count(*) as n from events group by user_id having count(*) > 1")
def s13(spark, d):
    return store.assert_unique(table(spark, d, "events"), "user_id")


@query("S14", "with recursive r as (select n_nationkey as k, 0 as depth from nation where n_nationkey = 3 union all select k + 1, depth + 1 from r where depth < 5) select r.k as nation, depth, n_name from r join nation on n_nationkey = k")
def s14(spark, d):
    text = "with recursive r as (select n_nationkey as k, 0 as depth from {nation} where n_nationkey = :start union all select k + 1, depth + 1 from r where depth < :depth) select r.k as nation, depth, n_name from r join {nation} on n_nationkey = k"
    return store.raw_query(spark, text, {"start": 3, "depth": 5}, nation=table(spark, d, "nation"))


@query("S17", "with n as (select q.vec_id as query_id, c.vec_id, round(list_cosine_similarity(cast(q.embedding as double[]), cast(c.embedding as double[])), 6) as score from embeddings q cross join embeddings c where q.vec_id % 50 = 0), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from n) select query_id, vec_id from r where rank <= 20")
def s17(spark, d):
    e = table(spark, d, "embeddings")
    return nearest(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e, 20).select("query_id", "vec_id")


@query("S18", f"with {CHUNKS}, n as (select chunk_id, article_no, row_number() over (partition by article_no order by doc_id) as n from chunks) select chunk_id, article_no from n where n <= 20")
def s18(spark, d):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("article_no").orderBy("doc_id"))
    return chunks(spark, d).withColumn("n", n).where("n <= 20").select("chunk_id", "article_no")


@query("S24", f"with {RANKED} select query_id, 'mcp_law_' || bm25_rank as id, bm25_rank as rank, md5(text) as digest from hits join documents using (doc_id) where bm25_rank <= 3")
def s24(spark, d):
    def search(queries, corpus):
        hits = index(spark, d).search(queries, 3).join(corpus.select("doc_id", "text"), "doc_id")
        return hits.select("query_id", F.lit("").alias("id"), F.col("text").alias("content"), (-F.col("bm25_rank")).alias("score"))

    found = store.external_search(questions(spark, d), table(spark, d, "documents"), search)
    return found.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.md5("content").alias("digest"))


@query("S26", "select b.item_id as query_id, d.doc_id, 1 as rel from benchmark b join documents d on contains(d.text, b.text)")
def s26(spark, d):
    from lexiflume.operators.passages import containing

    return containing(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), table(spark, d, "documents"))


@query("S28", f"""with {RANKED}, v as (select q.vec_id as query_id, c.vec_id as id, row_number() over (partition by q.vec_id order by round(list_cosine_similarity(cast(q.embedding as double[]), cast(c.embedding as double[])), 6) desc, c.vec_id) as rank from embeddings q join benchmark on item_id = q.vec_id cross join embeddings c)
select 'dense' as asked, query_id, id, rank from v where rank <= 3 union all select 'chunks', query_id, doc_id, bm25_rank from hits where bm25_rank <= 3""")
def s28(spark, d):
    """Stores by their aliases, each asked in its own way, after an ingest that replaces what is there by itself."""
    c, docs = store.Catalog(), index(spark, d)
    embeddings = table(spark, d, "embeddings").select("vec_id", "embedding")
    c.register("vector", embeddings, lambda q, k: nearest(q.join(c.get("vector"), F.col("query_id") == F.col("vec_id")).select("query_id", "embedding"), c.get("vector"), k).select("query_id", F.col("vec_id").alias("id"), "rank"))
    c.register("chunks", table(spark, d, "documents"), lambda q, k: docs.search(q, k).select("query_id", F.col("doc_id").alias("id"), F.col("bm25_rank").alias("rank")))
    c.ingest("qdrant", embeddings.where("vec_id < 10"), "vec_id")
    rows = [c.query(name, questions(spark, d), 3).select(F.lit(name).alias("asked"), "query_id", "id", F.col("rank").cast("long").alias("rank")) for name in ("dense", "chunks")]
    return rows[0].unionByName(rows[1])


@query("A17", "select 'vector' as store, true as available, 1::bigint as files, count(*) as n from embeddings union all select 'graph', true, 1, count(*) from nation union all select 'chunks', true, 1, count(*) from documents union all select 'contriever', false, 0, 0")
def a17(spark, d):
    c = store.Catalog()
    for name, file in (("vector", "embeddings"), ("graph", "nation"), ("chunks", "documents"), ("contriever", "contriever")):
        c.open(spark, name, f"{d}/{file}.parquet")
    return c.status(spark)
