"""Registered queries of search, fusion, reranking, correction and context."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from lexiflume.functions import text as X
from lexiflume.operators import bm25, correction, embedding, fusion, graph, vectors
from lexiflume.operators.bm25 import tags
from lexiflume.plans import retrieval
from lexiflume.plans.indexed import index
from lexiflume.providers import Providers
from lexiflume.registered import query
from lexiflume.sources.store import kept
from lexiflume.sources.tables import ASKED, CHUNKS, QUESTIONS, asked, chunks, questions, table


def _hits(spark, d, k=100):
    return index(spark, d).search(questions(spark, d), k)


@query("A01", f"with {bm25.SQL} select term, count(*) as df, cast(sum(tf) as bigint) as tf from postings group by term")
def a01(spark, d):
    return index(spark, d).postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query("A01_corpus", f"with {bm25.SQL} select n, round(avgdl, 4) as avgdl from corpus")
def a01c(spark, d):
    return index(spark, d).corpus.select("n", F.round("avgdl", 4).alias("avgdl"))


@query("A02", f"with {bm25.SQL} select term, df, round(idf, 6) as idf from terms")
def a02(spark, d):
    return index(spark, d).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query("B01", f"with {bm25.SCORES} select query_id, doc_id, round(score, 4) as score from scored")
def b01(spark, d):
    return index(spark, d).scores(questions(spark, d)).select("query_id", "doc_id", F.round("score", 4).alias("score"))


@query("K01", f"with {bm25.RANKED} select query_id, doc_id, bm25_rank, round(score, 4) as score from hits")
def k01(spark, d):
    return _hits(spark, d).select("query_id", "doc_id", F.col("bm25_rank").cast("long").alias("bm25_rank"), F.round("score", 4).alias("score"))


@query("B02", f"with {bm25.RANKED} select query_id, count(*) as n, round(max(score), 4) as best, min_by(doc_id, bm25_rank) as top_doc from hits group by query_id")
def b02(spark, d):
    return _hits(spark, d).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.max("score"), 4).alias("best"), F.min_by("doc_id", "bm25_rank").alias("top_doc"))


@query("W01", f"""with {bm25.SCORES}, e as (select b.item_id as query_id, d.doc_id, coalesce(s.score, 0) as score from benchmark b cross join documents d left join scored s on s.query_id = b.item_id and s.doc_id = d.doc_id where lang = 'en'),
r as (select *, row_number() over (partition by query_id order by round(score, 6) desc, doc_id) as rank from e) select query_id, doc_id, rank from r""")
def w01(spark, d):
    english = questions(spark, d).withColumn("tags", tags(lang=(F.lit("en"), False)))
    rounded = index(spark, d).scores(english, every=True).select("query_id", "doc_id", F.round("score", 6).alias("score"))  # once a row, not for each comparison of a sort
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return rounded.select("query_id", "doc_id", F.row_number().over(by).cast("long").alias("rank"))


_FILTERED = f"""with {bm25.SCORES}, {CHUNKS}, {QUESTIONS}, m as (select q.query_id, c.doc_id, coalesce(score, 0) as score, article_no = gt_article and list_has_all(clause_nos, gt_clauses) as ok
    from questions q cross join chunks c left join scored s on s.query_id = q.query_id and s.doc_id = c.doc_id), flagged as (select *, bool_or(ok) over (partition by query_id) as any_ok from m)"""


def _with_truth(spark, d):
    """Questions that ask for their true article and all of their true clauses."""
    return questions(spark, d).withColumn("tags", tags(article_no=(F.col("gt_article"), False), clause_nos=(F.col("gt_clauses"), True)))


@query("F03", f"{_FILTERED}, r as (select *, row_number() over (partition by query_id order by round(score, 6) desc, doc_id) as rank from flagged where ok) select query_id, doc_id, rank from r where rank <= 100")
def f03(spark, d):
    return index(spark, d).search(_with_truth(spark, d), relax=False).select("query_id", "doc_id", F.col("bm25_rank").cast("long").alias("rank"))


@query("F04", f"{_FILTERED}, r as (select *, row_number() over (partition by query_id order by round(score, 6) desc, doc_id) as rank from flagged where ok or not any_ok) select query_id, doc_id, rank, not any_ok as filter_relaxed from r where rank <= 100")
def f04(spark, d):
    return index(spark, d).search(_with_truth(spark, d)).select("query_id", "doc_id", F.col("bm25_rank").cast("long").alias("rank"), "filter_relaxed")


_UNIT = "list_transform(embedding, lambda x: cast(x as double))"
_COS = "case when n1 > 0 and n2 > 0 then d / (n1 * n2) else 0 end"


@query("V01", f"select vec_id, round(sqrt(list_sum(list_transform({_UNIT}, lambda x: x * x))), 4) as norm, cast(len(embedding) as bigint) as dim from embeddings")
def v01(spark, d):
    e = table(spark, d, "embeddings").withColumn("u", vectors.unit("embedding"))
    return e.select("vec_id", F.round(vectors.norm("embedding"), 4).alias("norm"), F.size("u").cast("long").alias("dim"))


_NEAR = """n as (select q.vec_id as query_id, c.vec_id, round(list_cosine_similarity(cast(q.embedding as double[]), cast(c.embedding as double[])), 6) as score
    from embeddings q cross join embeddings c where q.vec_id % 50 = 0),
near as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from n)"""


def _vector_queries(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _near(spark, d, k=20):
    return vectors.VectorIndex.stored(spark, f"{d}/embeddings.parquet").search(_vector_queries(spark, d), k)


@query("V03", f"with {_NEAR} select query_id, vec_id, rank, round(score, 4) as score from near where rank <= 20")
def v03(spark, d):
    return _near(spark, d).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


@query("K02", f"with {_NEAR} select query_id, vec_id from near where rank <= 5")
def k02(spark, d):
    return _near(spark, d, 5).select("query_id", "vec_id")


@query("F02", f"with n0 as (select q.vec_id as query_id, c.vec_id, round(list_cosine_similarity(cast(q.embedding as double[]), cast(c.embedding as double[])), 6) as score from embeddings q cross join embeddings c where q.vec_id % 50 = 0 and c.label = 1), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from n0) select query_id, vec_id, rank from r where rank <= 20")
def f02(spark, d):
    return vectors.nearest(_vector_queries(spark, d), table(spark, d, "embeddings").where("label = 1"), 20).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"))


@query("V05", """with n as (select q.vec_id as query_id, c.vec_id, round(greatest(0, 1 - list_sum(list_transform(list_zip(cast(q.embedding as double[]), cast(c.embedding as double[])), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) as score from embeddings q cross join embeddings c where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from n) select query_id, vec_id, round(score, 4) as score from r where rank <= 20""")
def v05(spark, d):
    return vectors.nearest(_vector_queries(spark, d), table(spark, d, "embeddings"), 20, metric="l2").select("query_id", "vec_id", F.round("score", 4).alias("score"))


@query("V09", "select q.vec_id as query_id, count(*) as n, round(avg(list_cosine_similarity(cast(q.embedding as double[]), cast(c.embedding as double[]))), 4) as mean from embeddings q cross join embeddings c where q.vec_id % 50 = 0 group by 1")
def v09(spark, d):
    return vectors.similarity_stats(_vector_queries(spark, d), table(spark, d, "embeddings")).select("query_id", "n", F.round(F.col("total") / F.col("n"), 4).alias("mean"))


@query("K12", f"with {_NEAR} select query_id, max(rank) as n, round(min(score), 4) as last from near where rank <= 100 group by query_id")
def k12(spark, d):
    return _near(spark, d, 100).groupBy("query_id").agg(F.max("rank").cast("long").alias("n"), F.round(F.min("score"), 4).alias("last"))


@query("R16", """with e as (select q.item_id as query_id, c.vec_id as id, round(greatest(0, 1 - list_sum(list_transform(list_zip(cast(v.embedding as double[]), cast(c.embedding as double[])), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) as score from benchmark q join embeddings v on v.vec_id = q.item_id cross join embeddings c where q.item_id % 4 > 0),
r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from e), n as (select query_id, id, round(score, 4) as score, rank from r join documents on doc_id = id where rank <= 5),
h as (select doc_id as id, row_number() over (order by doc_id) as rank from documents) select * from n union all select item_id, id, 0.8, rank from benchmark cross join h where rank <= 5 and item_id not in (select query_id from n)""")
def r16(spark, d):
    """Each fourth question has no vector, so it takes the first units."""
    own = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    asked = questions(spark, d).select("query_id").join(own, "query_id", "left").withColumn("embedding", F.expr("case when query_id % 4 > 0 then embedding end"))
    units = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return graph.graph_chunks(asked, table(spark, d, "embeddings"), units).select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


for _name in ("V07",):

    @query(_name, """with s as (select e.label as doc_id, e.vec_id % 3 as span, i, avg(cast(e.embedding[i] as double)) as x from embeddings e, generate_series(1, 64) g(i) group by all)
select doc_id, cast(span as int) as span, cast(i as int) as i, round(x / sqrt(sum(x * x) over (partition by doc_id, span)), 4) as x from s""")
    def v07(spark, d):
        by = Window.partitionBy("label").orderBy(F.col("vec_id") % 3, "vec_id")
        tokens = table(spark, d, "embeddings").select(F.col("label").alias("doc_id"), F.row_number().over(by).alias("pos"), (F.col("vec_id") % 3).cast("int").alias("span"), "embedding")
        spans = tokens.groupBy("doc_id", "span").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))
        pooled = vectors.pooled_spans(tokens.drop("span"), spans)
        return pooled.select("doc_id", "span", F.posexplode("embedding").alias("i", "x")).select("doc_id", "span", (F.col("i") + 1).alias("i"), F.round("x", 4).alias("x"))


_BASE = f"{bm25.RANKED}, {CHUNKS}, {QUESTIONS}"
# Questions whose texts filter; those without words take no part.
_ASKED = f"""{bm25.SQL}, {CHUNKS}, {ASKED}, {bm25.scores_sql("asked_questions", "query_id", "query")},
pairs as (select q.query_id, c.doc_id, coalesce(s.score, 0) as score, coalesce(f_article, f_chapter, f_section) is not null as filtered,
    coalesce(f_article is null or article_no = f_article, false) and coalesce(f_chapter is null or chapter_no = f_chapter, false) and coalesce(f_section is null or section_no = f_section, false) as ok
    from asked_questions q cross join chunks c left join scored s on s.query_id = q.query_id and s.doc_id = c.doc_id where has_words),
flagged as (select *, bool_or(ok) over (partition by query_id) as any_ok from pairs),
hits as (select * from (select query_id, doc_id, score, filtered and not any_ok as filter_relaxed, row_number() over (partition by query_id order by round(score, 6) desc, doc_id) as bm25_rank from flagged where ok or not any_ok) where bm25_rank <= 100),
questions as (select query_id, query from asked_questions)"""


def _dense_sql(base: str) -> str:
    return f"""{base},
dense as (select h.query_id, h.doc_id, h.bm25_rank, h.score as bm25_score, round(coalesce(round(list_cosine_similarity(cast(q.embedding as double[]), cast(e.embedding as double[])), 4), 0.5), 4) + 0.0 as dense_score
    from hits h left join embeddings q on q.vec_id = h.query_id left join embeddings e on e.vec_id = h.doc_id),
ranked as (select *, row_number() over (partition by query_id order by dense_score desc, bm25_rank) as dense_rank from dense),
fused as (select *, 1.0::double / (60 + bm25_rank) + 1.0::double / (60 + dense_rank) as rrf from ranked),
top20 as (select * from (select *, row_number() over (partition by query_id order by round(rrf, 10) desc, bm25_rank) as rank from fused) where rank <= 20)"""


_DENSE = _dense_sql(_BASE)


@query("J01", f"with {_DENSE} select query_id, doc_id, dense_score from dense")
def j01(spark, d):
    hits = kept(_hits(spark, d))
    scored = retrieval.dense_scores(hits, table(spark, d, "embeddings"))
    return hits.join(scored, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.round(F.coalesce("dense_score", F.lit(0.5)), 4).alias("dense_score"))


def _hybrid(spark, d):
    hits = kept(_hits(spark, d))
    return fusion.hybrid(hits, retrieval.dense_scores(hits, table(spark, d, "embeddings")))


@query("R01", f"with {_dense_sql(_ASKED)} select t.query_id, t.doc_id, bm25_rank, dense_rank, rank, round(rrf, 6) as rrf, filter_relaxed from top20 t join (select distinct query_id, filter_relaxed from hits) using (query_id)")
def r01(spark, d):
    r = _retriever(spark, d)
    found = r.candidates(r.understood(asked(spark, d)))
    return found.select("query_id", "doc_id", *[F.col(c).cast("long").alias(c) for c in ("bm25_rank", "dense_rank", "rank")], F.round("rrf", 6).alias("rrf"), "filter_relaxed")


@query("W02", f"with {_DENSE} select query_id, doc_id, dense_rank from top20 where dense_rank <= 10")
def w02(spark, d):
    return _hybrid(spark, d).where("dense_rank <= 10").select("query_id", "doc_id", F.col("dense_rank").cast("long").alias("dense_rank"))


@query("K03", f"with {_DENSE} select query_id, max(rank) as n, min_by(doc_id, rank) as first_doc from top20 group by query_id")
def k03(spark, d):
    return _hybrid(spark, d).groupBy("query_id").agg(F.max("rank").cast("long").alias("n"), F.min_by("doc_id", "rank").alias("first_doc"))


_CELL = "(select id, cast(('0x' || substr(md5(w), 1, 4))::int % 64 as int) as dim, cast(sum(case when ('0x' || substr(md5(w), 5, 4))::int % 2 = 0 then 1 else -1 end) as bigint) as value from (select {1} as id, unnest(regexp_extract_all(lower({2}), '[\\p{{L}}\\p{{N}}_]+')) as w from {0}) group by all)"


@query("R09", f"""with {_BASE}, hv as {_CELL.format("questions", "query_id", "'The answer to this: ' || query")}, dv as {_CELL.format("documents", "doc_id", "text")},
hn as (select id, sqrt(sum(value * value)::double) as n from hv group by 1), dn as (select id, sqrt(sum(value * value)::double) as n from dv group by 1),
dots as (select h.query_id, h.doc_id, sum(hv.value * dv.value)::double as dot from hits h join hv on hv.id = h.query_id join dv on dv.id = h.doc_id and dv.dim = hv.dim group by all),
ds as (select h.query_id, h.doc_id, h.bm25_rank, case when dn.id is null then 0.5 when hn.n * dn.n > 0 then round(coalesce(dot, 0) / (hn.n * dn.n), 4) + 0.0 else 0.0 end as dense_score from hits h left join dots using (query_id, doc_id) left join hn on hn.id = h.query_id left join dn on dn.id = h.doc_id),
rk as (select *, row_number() over (partition by query_id order by dense_score desc, bm25_rank) as dense_rank from ds),
fu as (select *, row_number() over (partition by query_id order by round(1.0::double / (60 + bm25_rank) + 1.0::double / (60 + dense_rank), 10) desc, bm25_rank) as rank from rk)
select query_id, doc_id, dense_score, rank from fu where rank <= 20""")
def r09(spark, d):
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    r = _retriever(spark, d, embeddings=kept(embedding.hashed_vectors(texts).withColumnRenamed("id", "vec_id")), pre=("hyde",))
    found = r.candidates(r.understood(questions(spark, d)))
    return found.select("query_id", "doc_id", "dense_score", F.col("rank").cast("long").alias("rank"))


# Token overlap F1 of a query and a content, as in the lexical reranker.
_TOKS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
_OVERLAP = "coalesce(list_sum(list_transform(list_distinct({0}), lambda t: least(len(list_filter({0}, lambda x: x = t)), len(list_filter({1}, lambda x: x = t))))), 0)"


def f1_sql(a: str, b: str) -> str:
    o = _OVERLAP.format(a, b)
    return f"case when {o} > 0 then 2 * ({o} / len({a})::double) * ({o} / len({b})::double) / ({o} / len({a})::double + {o} / len({b})::double) else 0.0 end"


def _reranked_sql(base: str) -> str:
    return f"""{_dense_sql(base)},
toks as (select t.*, {_TOKS.format("q.query")} as qt, {_TOKS.format("c.content")} as ct from top20 t join questions q using (query_id) join chunks c using (doc_id)),
rr as (select query_id, doc_id, rank, bm25_score, dense_score, rrf, round({f1_sql("qt", "ct")}, 4) as rerank_score from toks),
selected as (select * from (select *, row_number() over (partition by query_id order by rerank_score desc nulls last, dense_score desc nulls last, rank) as final_rank from rr) where final_rank <= 5)"""


_RERANKED = _reranked_sql(_BASE)


def _retriever(spark, d, **options):
    embeddings = options.pop("embeddings", None)
    return retrieval.Retriever(index(spark, d), chunks(spark, d), table(spark, d, "embeddings") if embeddings is None else embeddings, **options)


@query("R02", f"with {_RERANKED} select query_id, doc_id, final_rank, rerank_score from selected")
def r02(spark, d):
    return _retriever(spark, d).select(questions(spark, d)).select("query_id", "doc_id", F.col("final_rank").cast("long").alias("final_rank"), "rerank_score")


@query("J13", f"with {_DENSE} select t.query_id, t.doc_id, md5(q.query || '|' || d.text) as pair from top20 t join questions q using (query_id) join documents d using (doc_id)")
def j13(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return _hybrid(spark, d).join(questions(spark, d), "query_id").join(docs, "doc_id").select("query_id", "doc_id", F.md5(F.concat_ws("|", "query", "text")).alias("pair"))


def _expanded_sql(base: str) -> str:
    return f"""{_reranked_sql(base)},
sel as (select s.query_id, s.final_rank as rank, bm25_score, dense_score, rrf, rerank_score, c.chunk_id, c.ref_article_nos from selected s join chunks c using (doc_id)),
cited as (select query_id, rank, pos, ref_article_nos[pos] as article_no from sel, unnest(generate_series(1, len(ref_article_nos))) g(pos)),
ordered as (select query_id, article_no, min(rank * 1000 + pos) as first from cited group by all),
numbered as (select * from (select chunk_id, article_no, row_number() over (partition by article_no order by doc_id) as n from chunks) where n <= 20),
expanded as (select o.query_id, n.chunk_id, n.article_no, row_number() over (partition by o.query_id order by first, n.article_no, n.n) as position
    from ordered o join numbered n using (article_no) where not exists (select 1 from sel s where s.query_id = o.query_id and s.chunk_id = n.chunk_id))"""


_EXPANDED = _expanded_sql(_BASE)


def _expanded(spark, d):
    chosen = _retriever(spark, d).select(questions(spark, d)).select("query_id", F.col("final_rank").alias("rank"), "chunk_id", "ref_article_nos")
    return fusion.expand_references(chosen, chunks(spark, d))


for _name in ("J04", "R03"):

    @query(_name, f"with {_EXPANDED} select query_id, chunk_id, article_no, position from expanded")
    def j04(spark, d):
        return _expanded(spark, d).select("query_id", "chunk_id", "article_no", F.col("position").cast("long").alias("position"))


LINES = """'Nguồn: ' || nullif(source, ''), 'Chương: ' || nullif(chapter, ''), 'Mục: ' || nullif(section, ''), 'Điều: ' || nullif(article, ''), 'Số điều: ' || article_no, 'Số chương: ' || chapter_no, 'Số mục: ' || section_no,
    case when len(clause_nos) > 0 then 'Số khoản: [' || array_to_string(clause_nos, ', ') || ']' end, case when len(ref_article_nos) > 0 then 'Số điều viện dẫn: [' || array_to_string(ref_article_nos, ', ') || ']' end,
    'Điểm BM25: ' || printf('%.4f', round(bm25_score, 4)), 'Điểm truy xuất dense: ' || printf('%.4f', round(dense_score, 4)), 'Điểm RRF: ' || printf('%.6f', round(rrf, 6)), 'Điểm xếp hạng lại: ' || printf('%.4f', round(rerank_score, 4)),
    'Nguồn truy xuất: ' || origin, 'Số điều được viện dẫn: ' || referenced_article_no, 'Nội dung:', coalesce(content, '')"""


def _context_sql(base: str) -> str:
    return f"""{_expanded_sql(base)},
together as (select query_id, chunk_id, rank as position, bm25_score, dense_score, rrf, rerank_score, 'reranked' as origin, null::int as referenced_article_no from sel
    union all select query_id, chunk_id, position + 1000, null, null, null, null, 'reference', article_no from expanded),
numb as (select * exclude (position), row_number() over (partition by query_id order by position) as position from together),
blocks as (select n.query_id, n.position, concat_ws(chr(10), '[Đoạn ' || position || ']', {LINES}) as block from numb n join chunks c using (chunk_id)),
runs as (select *, sum(length(block) + 2) over (partition by query_id order by position) - 2 as ends from blocks),
cut as (select query_id, position, case when ends <= 12000 then block else rtrim(substr(block, 1, cast(12000 - 13 - (ends - length(block)) as int)), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) || chr(10) || '[đã rút gọn]' end as txt
    from runs where ends <= 12000 or ends - length(block) < 12000 - 13),
ctx as (select query_id, string_agg(txt, chr(10) || chr(10) order by position) as context, count(*) as n_blocks from cut group by query_id)"""


_CONTEXT = _context_sql(_BASE)


@query("R04", f"with {_CONTEXT} select query_id, md5(context) as digest, cast(length(context) as bigint) as n_chars from ctx")
def r04(spark, d):
    return _retriever(spark, d).retrieve(questions(spark, d)).select("query_id", F.md5("context").alias("digest"), F.length("context").cast("long").alias("n_chars"))


@query("W05", f"with {_CONTEXT} select query_id, n_blocks, length(context) <= 12000 as fits from ctx")
def w05(spark, d):
    found = _retriever(spark, d).retrieve(questions(spark, d)).where("context <> ''")
    return found.select("query_id", "n_blocks", (F.length("context") <= 12000).alias("fits"))


@query("R05", f"""with {_context_sql(_ASKED)}, s1 as (select query_id, string_agg(chunk_id, ',' order by rank) as selected from sel group by 1), e1 as (select query_id, string_agg(chunk_id, ',' order by position) as expanded from expanded group by 1),
fl as (select distinct query_id, filter_relaxed from hits)
select q.query_id, coalesce(f_article, f_chapter, f_section) is not null and has_words and not coalesce(filter_relaxed, false) as filter_applied, coalesce(filter_relaxed, false) as filter_relaxed, coalesce(selected, '') as selected, coalesce(expanded, '') as expanded, md5(coalesce(context, '')) as digest
from asked_questions q left join s1 using (query_id) left join e1 using (query_id) left join ctx using (query_id) left join fl using (query_id)""")
def r05(spark, d):
    return _retriever(spark, d).retrieve(asked(spark, d)).select("query_id", "filter_applied", "filter_relaxed", "selected", "expanded", F.md5("context").alias("digest"))


@query("P06", f"with {_CONTEXT} select q.query_id, md5('<context>' || chr(10) || coalesce(context, '') || chr(10) || '</context>' || chr(10) || chr(10) || '<question>' || chr(10) || query || chr(10) || '</question>') as prompt from questions q left join ctx using (query_id)")
def p06(spark, d):
    return _retriever(spark, d).retrieve(questions(spark, d)).select("query_id", F.md5("prompt").alias("prompt"))


_FRAMES = "[query, 'what is ' || query, 'explain ' || query, 'rules about ' || query, 'examples of ' || query]"
_FUSION = f"""{bm25.SQL}, {QUESTIONS},
v as (select query_id, i - 1 as variant, {_FRAMES}[i] as q from questions, generate_series(1, 5) g(i)),
va as (select query_id, variant, term, count(*) as qtf from (select query_id, variant, unnest({_TOKS.format("q")}) as term from v) group by all),
vs as (select query_id, variant, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) as score from va join terms using (term) join postings using (term) join lengths using (doc_id), corpus group by all),
ve as (select v.query_id, v.variant, d.doc_id, coalesce(score, 0) as score from v cross join documents d left join vs on vs.query_id = v.query_id and vs.variant = v.variant and vs.doc_id = d.doc_id),
vr as (select *, row_number() over (partition by query_id, variant order by round(score, 6) desc, doc_id) - 1 as rank0 from ve),
fu as (select query_id, doc_id, sum(case when variant = 0 then 3.0::double else 1.0::double end / (rank0 + 60)) as score, min(variant * 1000 + rank0) as seen from vr where rank0 < 20 group by all),
fr as (select *, row_number() over (partition by query_id order by round(score, 10) desc, seen, doc_id) as rank from fu)"""

for _name in ("R06", "A11"):

    @query(_name, f"with {_FUSION} select query_id, doc_id, rank, round(score, 6) as score from fr")
    def r06(spark, d):
        return retrieval.fused_variants(index(spark, d), questions(spark, d)).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("K05", f"with {_FUSION} select query_id, doc_id from fr where rank <= 5")
def k05(spark, d):
    return retrieval.fused_variants(index(spark, d), questions(spark, d), top_k=5).select("query_id", "doc_id")


@query("R07", f"with {QUESTIONS} select query_id, unnest({_FRAMES}[2:]) as variant from questions")
def r07(spark, d):
    return questions(spark, d).select("query_id", F.explode(retrieval.DEFAULT.expand(F.col("query"))).alias("variant"))


# Scores that stand in for a model's: arithmetic of the ids.
_P = "cast((doc_id * 37 + query_id * 11) % 100 as double) / 100"


def _screen_sql(base: str, high: str = "0.7", low: str = "0.2") -> str:
    """h (query_id, doc_id, rank, score) to f, with kind, place and choice from a table c (query_id, place, choice)."""
    return f"""{base},
k as (select *, case when score >= {high} then 'keep' when score <= {low} then 'drop' else 'hard' end as kind0 from h),
l as (select *, count(*) filter (kind0 <> 'drop') over (partition by query_id) as lft, row_number() over (partition by query_id order by score desc, rank) as best from k),
r as (select *, case when lft = 0 and best <= 4 then 'hard' else kind0 end as kind from l),
p as (select *, case when kind = 'hard' then row_number() over (partition by query_id, kind order by case when lft = 0 then best else rank end, rank) - 1 end as place from r where kind <> 'drop')"""


_MERGE = """f as (select p.*, choice, round(case when kind = 'keep' then score when p.place >= 4 then score * 0.3 when choice is not null then 0.95 - 0.10 * choice else greatest(0.10, score * 0.4) end, 4)::double as final_score from p left join c on c.query_id = p.query_id and c.place = p.place),
o as (select *, row_number() over (partition by query_id order by final_score desc, kind desc, rank) as final_rank from f)"""
_GIVEN = f"{bm25.RANKED}, h as (select query_id, doc_id, bm25_rank as rank, {_P} as score from hits where bm25_rank <= 20)"
_FR = f"{_screen_sql(_GIVEN)}, c as (select query_id, place, place // 2 as choice from p where place % 2 = 0 and place < 4), {_MERGE}"


def _screened(spark, d, **options):
    h = _hits(spark, d).where("bm25_rank <= 20")
    h = h.select("query_id", F.col("doc_id").alias("chunk_id"), F.col("bm25_rank").alias("rank"), F.expr(_P).alias("score"))
    return correction.screened(h, **options).withColumn("choice", F.expr("case when place % 2 = 0 and place < 4 then place div 2 end"))


# The strategy: nearest chunks, judged by the share of the question's tokens that they have; what is undecided is chosen by token overlap.
_SHARE = "round(len(list_filter(list_distinct({0}), lambda t: list_contains({1}, t)))::double / len(list_distinct({0})), 4)"
_STRATEGY = f"""{_BASE}, near as (select * from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from (select q.vec_id as query_id, c.vec_id, round(list_cosine_similarity(cast(q.embedding as double[]), cast(c.embedding as double[])), 6) + 0.0 as score
    from embeddings q join questions on query_id = q.vec_id cross join embeddings c join documents on doc_id = c.vec_id)) where rank <= 20),
nt as (select n.query_id, n.vec_id as doc_id, rank, {_TOKS.format("q.query")} as qt, {_TOKS.format("c.content")} as ct, {_TOKS.format("substr(c.content, 1, 1200)")} as pt from near n join questions q using (query_id) join chunks c on c.doc_id = n.vec_id),
h as (select *, {_SHARE.format("qt", "ct")} as share, case when share > 0 then share else 0.5 end as score from nt)"""
_STRATEGY = f"""{_screen_sql(_STRATEGY)}, g as (select query_id, place, round({f1_sql("qt", "pt")}, 4) as s from p where place < 4), c as (select query_id, place, row_number() over (partition by query_id order by s desc, place) - 1 as choice from g where s > 0), {_MERGE}"""


@query("R08", f"with {_STRATEGY} select query_id, doc_id, kind, final_rank, final_score from o where final_rank <= 5")
def r08(spark, d):
    found = _retriever(spark, d, advanced="filter_rerank").select(questions(spark, d))
    return found.select("query_id", "doc_id", "kind", F.col("final_rank").cast("long").alias("final_rank"), "final_score")


@query("W04", f"with {_FR} select query_id, doc_id, final_score from o where kind = 'hard'")
def w04(spark, d):
    return correction.merged(_screened(spark, d), top_k=1000).where("kind = 'hard'").select("query_id", F.col("chunk_id").alias("doc_id"), "final_score")


@query("K06", f"with {_FR} select query_id, doc_id from o where final_rank <= 3")
def k06(spark, d):
    return correction.merged(_screened(spark, d), top_k=3).select("query_id", F.col("chunk_id").alias("doc_id"))


@query("K07", f"with {bm25.RANKED}, h as (select query_id, doc_id, bm25_rank as rank, {_P} as score from hits where bm25_rank <= 20), b as (select *, row_number() over (partition by query_id order by score desc, rank) as best from h) select query_id, doc_id, score, best - 1 as place from b where best <= 4")
def k07(spark, d):
    return _screened(spark, d, tau_high=2.0, tau_low=1.5).select("query_id", F.col("chunk_id").alias("doc_id"), "score", F.col("place").cast("long").alias("place"))


@query("F07", f"with {bm25.RANKED} select query_id, doc_id, case when {_P} >= 0.7 then 'keep' when {_P} <= 0.2 then 'drop' else 'hard' end as kind from hits")
def f07(spark, d):
    return _hits(spark, d).select("query_id", "doc_id", correction.trichotomy(F.expr(_P), 0.7, 0.2, ("keep", "drop", "hard")).alias("kind"))


# Corrective retrieval: entailment by the share of the question's tokens; the external source answers with hits 21 to 23 of the index.
_CRAG = f"""{_RERANKED},
jt as (select s.query_id, s.doc_id, final_rank as rank, {_TOKS.format("q.query")} as qt, {_TOKS.format("c.content")} as ct from selected s join questions q using (query_id) join chunks c using (doc_id)),
lv as (select *, {_SHARE.format("qt", "ct")} as p, case when p >= 0.75 then 2 when p <= 0.35 then 0 else 1 end as level from jt),
ac as (select *, max(level) over (partition by query_id) as action from lv),
uni as (select query_id, doc_id, rank, action, 'reranked' as origin from ac where action > 0 and level > 0
    union all select x.query_id, x.doc_id, 1000 + x.bm25_rank - 20, a.action, 'external' from hits x join (select distinct query_id, action from ac) a on a.query_id = x.query_id where a.action < 2 and x.bm25_rank between 21 and 23),
cr as (select *, row_number() over (partition by query_id order by rank) as final_rank from uni)"""


def _outside(spark, d):
    def search(queries):
        hits = index(spark, d).search(queries, 23).where("bm25_rank > 20").join(table(spark, d, "documents"), "doc_id")
        return hits.select("query_id", F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("content"), (F.col("bm25_rank") - 20).alias("rank"))

    return Providers(external=search)


def _corrected(spark, d):
    return _retriever(spark, d, providers=_outside(spark, d), post=("crag",)).select(questions(spark, d))


@query("R11", f"with {_CRAG} select query_id, doc_id, final_rank, ['incorrect', 'ambiguous', 'correct'][action + 1] as action, origin from cr")
def r11(spark, d):
    return _corrected(spark, d).select("query_id", F.col("chunk_id").cast("long").alias("doc_id"), F.col("final_rank").cast("long").alias("final_rank"), "action", "origin")


@query("U03", f"with {_CRAG} select query_id, count(*) filter (origin = 'reranked') as n_internal, count(*) filter (origin = 'external') as n_external from cr group by 1")
def u03(spark, d):
    n = lambda origin, name: F.count(F.when(F.col("origin") == origin, 1)).alias(name)
    return _corrected(spark, d).groupBy("query_id").agg(n("reranked", "n_internal"), n("external", "n_external"))


@query("A14", f"with {_CRAG} select query_id, ['incorrect', 'ambiguous', 'correct'][max(level) + 1] as action from lv group by query_id")
def a14(spark, d):
    rows = _retriever(spark, d).select(questions(spark, d)).select("query_id", "chunk_id", F.col("final_rank").alias("rank"), F.round(retrieval.DEFAULT.entail(F.col("query"), F.col("content")), 4).alias("p"))
    nothing = spark.createDataFrame([], "query_id long, chunk_id string, rank int")
    acted = correction.crag(rows, nothing).groupBy("query_id").agg(F.first("action").alias("action"))
    return rows.select("query_id").distinct().join(acted, "query_id", "left").select("query_id", F.coalesce("action", F.lit("incorrect")).alias("action"))


_STRIPS = r"""st0 as (select doc_id, text, list_filter(list_transform(string_split(regexp_replace(text, '([.!?;\n])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: length(s) >= 20) as l from documents),
st as (select doc_id, case when len(l) > 0 then l else [text] end as l from st0),
strips as (select doc_id, i - 1 as pos, l[i] as strip, cast((doc_id * 13 + i * 29) % 100 as double) / 100 as score from st, unnest(generate_series(1, len(l))) g(i))"""


def _strips(spark, d):
    s = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.posexplode(X.strips("text")).alias("pos", "strip"))
    return s.withColumn("score", F.expr("cast((id * 13 + (pos + 1) * 29) % 100 as double) / 100"))


@query("X15", f"with {_STRIPS} select doc_id, count(*) as n, md5(string_agg(strip, '|' order by pos)) as digest from strips group by doc_id")
def x15(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(X.strips("text")).cast("long").alias("n"), F.md5(F.array_join(X.strips("text"), "|")).alias("digest"))


@query("R12", f"with {_STRIPS}, a as (select *, max(score >= 0.35) over (partition by doc_id) as some_good, row_number() over (partition by doc_id order by score desc, pos) as rn, count(*) over (partition by doc_id) as num_strips from strips) select doc_id, num_strips, count(*) as num_kept, md5(string_agg(strip, ' ' order by pos)) as refined from a where case when some_good then score >= 0.35 else rn = 1 end group by doc_id, num_strips")
def r12(spark, d):
    return correction.refine(_strips(spark, d)).select(F.col("id").alias("doc_id"), "num_strips", "num_kept", F.md5("refined").alias("refined"))


for _name in ("R13", "K08"):

    @query(_name, f"with {_STRIPS}, a as (select *, max(score >= 0.35) over (partition by doc_id) as some_good, row_number() over (partition by doc_id order by score desc, pos) as rn from strips) select doc_id, cast(pos as int) as pos from a where rn <= 3 and case when some_good then score >= 0.35 else rn = 1 end")
    def k08(spark, d):
        return correction.keep_strips(_strips(spark, d), top_n=3).select(F.col("id").alias("doc_id"), "pos")


_SENTENCES = r"""cs0 as (select s.query_id, final_rank, c.content, string_split(regexp_replace(content, '([.!?;\n])\s+', '\1' || chr(1), 'g'), chr(1)) as raw from selected s join chunks c using (doc_id)),
cs1 as (select *, list_filter(list_transform(raw, lambda s: trim(s, ' ')), lambda s: length(s) >= 20) as l0 from cs0),
cs2 as (select query_id, final_rank, case when len(l0) > 0 then l0 else [content] end as l from cs1),
cs3 as (select query_id, final_rank, i - 1 as pos, l[i] as strip from cs2, unnest(generate_series(1, len(l))) g(i))"""


@query("R14", f"""with {_RERANKED}, {_SENTENCES}, t as (select c.*, {_TOKS.format("q.query")} as qt, {_TOKS.format("strip")} as st, row_number() over (partition by c.query_id order by final_rank, pos) - 1 as place from cs3 c join questions q using (query_id)),
sc as (select query_id, place, strip, len(st)::bigint as n, {_SHARE.format("qt", "st")} as score from t),
a as (select *, sum(n) over (partition by query_id order by score desc, place) as used, row_number() over (partition by query_id order by score desc, place) as rn from sc)
select query_id, md5(string_agg(strip, ' ' order by place) filter (used <= 500 or rn = 1)) as digest, cast(sum(n) as bigint) as origin_tokens, cast(sum(case when used <= 500 or rn = 1 then n else 0 end) as bigint) as compressed_tokens, round(1 - sum(case when used <= 500 or rn = 1 then n else 0 end) / nullif(sum(n), 0), 4) as saving_ratio from a group by query_id""")
def r14(spark, d):
    found = _retriever(spark, d, post=("prompt_compression",)).select(questions(spark, d)).where("final_rank = 1")
    return found.select("query_id", F.md5("compressed").alias("digest"), "origin_tokens", "compressed_tokens", "saving_ratio")


@query("R15", f"with {_DENSE}, t as (select t.query_id, t.doc_id, list_distinct({_TOKS.format('q.query')}) as qt, {_TOKS.format('d.text')} as dt from top20 t join questions q using (query_id) join documents d using (doc_id)), p as (select query_id, doc_id, round(len(list_filter(qt, lambda x: list_contains(dt, x)))::double / len(qt), 4) as p from t) select query_id, doc_id, case when p >= 0.5 then 'entailment' else 'other' end as label, greatest(p, 1 - p) as confidence from p")
def r15(spark, d):
    from lexiflume.providers import nli

    pairs = _hybrid(spark, d).join(questions(spark, d), "query_id").join(table(spark, d, "documents"), "doc_id")
    return pairs.select("query_id", "doc_id", nli(F.col("query"), F.col("text")).alias("n")).select("query_id", "doc_id", "n.label", "n.confidence")
