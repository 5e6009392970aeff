"""Registered queries of projections, filters, joins, aggregates and set operations."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from lexiflume.operators import evaluation, graph
from lexiflume.plans import retrieval
from lexiflume.plans.retrieval_queries import LINES
from lexiflume.registered import query
from lexiflume.sources.tables import CHUNKS, chunks, table

_TAG = "case when {0} is not null and cast({0} as varchar) <> '' then '[{0}: ' || {0} || ']' end"
_TAGS = ", ".join(_TAG.format(c) for c in ("source", "chapter", "section", "article"))
_VALUES = ", ".join(f"nullif({c}, '')" for c in ("source", "chapter", "section", "article"))


@query("P01", f"with {CHUNKS} select doc_id, md5(concat_ws(' ', {_TAGS}) || chr(10) || content) as digest from chunks")
def p01(spark, d):
    return chunks(spark, d).select("doc_id", F.md5(retrieval.enriched("source", "chapter", "section", "article")).alias("digest"))


@query("P02", f"with {CHUNKS} select doc_id, md5(concat_ws(' ', {_VALUES}, content)) as digest from chunks")
def p02(spark, d):
    return chunks(spark, d).select("doc_id", F.md5(retrieval.index_text("source", "chapter", "section", "article")).alias("digest"))


@query("P03", f"with {CHUNKS} select doc_id, md5(concat_ws(' ', {_VALUES}, lower(article), content)) as digest from chunks")
def p03(spark, d):
    c = chunks(spark, d).withColumn("normalized", F.lower("article"))
    return c.select("doc_id", F.md5(retrieval.index_text("source", "chapter", "section", "article", "normalized")).alias("digest"))


@query("P04", "select doc_id, md5(coalesce(case when doc_id % 2 = 0 then text end, lang)) as content, coalesce(case when doc_id % 3 = 0 then n_chars / 10.0::double end, cast(n_chars as double)) as dense_score from documents")
def p04(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", F.md5(F.coalesce(F.expr("case when doc_id % 2 = 0 then text end"), "lang")).alias("content"), F.expr("coalesce(case when doc_id % 3 = 0 then n_chars / 10.0D end, cast(n_chars as double))").alias("dense_score"))


#: Scores and origins of some of the chunks, by name.
_SCORED = {
    "bm25_score": "case when doc_id % 3 > 0 then length(content) / cast(7 as double) end",
    "dense_score": "case when doc_id % 4 > 0 then doc_id / cast(9 as double) end",
    "rrf": "case when doc_id % 5 > 0 then 1 / (doc_id + cast(60 as double)) end",
    "rerank_score": "case when doc_id % 2 > 0 then length(article) / cast(13 as double) end",
    "origin": "case when doc_id % 2 = 0 then 'reference' else 'reranked' end",
    "referenced_article_no": "case when doc_id % 2 = 0 then article_no end",
}
_WITH_SCORES = [f"{e} as {n}" for n, e in _SCORED.items()]


@query("P05", f"with {CHUNKS}, s as (select *, {', '.join(_WITH_SCORES)} from chunks) select doc_id, md5(concat_ws(chr(10), '[Đoạn ' || (doc_id + 1) || ']', {LINES})) as digest from s")
def p05(spark, d):
    s = chunks(spark, d).selectExpr("*", *_WITH_SCORES)
    return s.select("doc_id", F.md5(retrieval.context_block(F.col("doc_id") + 1, s)).alias("digest"))


@query("P07", f"with {CHUNKS} select chunk_id, article_no, chapter_no, source, md5(content) as content from chunks")
def p07(spark, d):
    return chunks(spark, d).select("chunk_id", "article_no", "chapter_no", "source", F.md5("content").alias("content"))


@query("P08", "select doc_id, lang, source, n_chars from documents")
def p08(spark, d):
    return table(spark, d, "documents").drop("text")


@query("P09", f"with {CHUNKS} select doc_id, coalesce(case when doc_id % 3 = 0 then article_no end, case when doc_id % 3 = 1 then chapter_no end, cast(regexp_extract(article, '([0-9]+)', 1) as int)) as law_id from chunks")
def p09(spark, d):
    return chunks(spark, d).select("doc_id", F.coalesce(F.expr("case when doc_id % 3 = 0 then article_no end"), F.expr("case when doc_id % 3 = 1 then chapter_no end"), F.regexp_extract("article", "([0-9]+)", 1).cast("int")).alias("law_id"))


@query("P10", "select doc_id, coalesce(nullif(case when doc_id % 2 = 0 then '' else lang end, ''), nullif(source, 'src0'), 'mcp_law_' || doc_id) as id from documents")
def p10(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.nullif(F.expr("case when doc_id % 2 = 0 then '' else lang end"), F.lit("")), F.nullif(F.col("source"), F.lit("src0")), F.concat(F.lit("mcp_law_"), F.col("doc_id").cast("string"))).alias("id"))


@query("F01", f"with {CHUNKS} select doc_id from chunks where article_no = 7 and (null is null or chapter_no = null)")
def f01(spark, d):
    wanted = {"article_no": 7, "chapter_no": None}
    out = chunks(spark, d)
    for c, v in wanted.items():
        out = out.where(F.lit(v).isNull() | (F.col(c) == F.lit(v)))
    return out.select("doc_id")


@query("F05", "select event_id, event_type from events where event_type in ('signup', 'error')")
def f05(spark, d):
    return table(spark, d, "events").where(F.col("event_type").isin("signup", "error")).select("event_id", "event_type")


@query("F06", "select item_id from benchmark where contains(lower(text), 'the') or contains(lower(cast(item_id as varchar)), 'the')")
def f06(spark, d):
    return table(spark, d, "benchmark").where(F.lower("text").contains("the") | F.lower(F.col("item_id").cast("string")).contains("the")).select("item_id")


_JUDGED = "j as (select event_id, user_id, event_type, case when event_id % 7 = 0 then null when event_id % 11 = 0 then 'nan'::double else value end as a, case when event_id % 5 = 0 then null else value / 2 end as b from events)"


def judged(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", F.expr("case when event_id % 7 = 0 then null when event_id % 11 = 0 then double('nan') else value end").alias("a"), F.expr("case when event_id % 5 = 0 then null else value / 2 end").alias("b"))


@query("F08", f"with {_JUDGED} select event_id from j where a is not null and not isnan(a) and b is not null and not isnan(b)")
def f08(spark, d):
    from lexiflume.functions.metrics import valid_scores

    return judged(spark, d).where(valid_scores("a", "b")).select("event_id")


@query("F09", f"with {_JUDGED} select event_id, case when isnan(a) then null else a end as a from j")
def f09(spark, d):
    return judged(spark, d).select("event_id", F.nanvl("a", F.lit(None).cast("double")).alias("a"))


@query("F10", "select label, count(*) as n from embeddings where len(embedding) = 64 group by label")
def f10(spark, d):
    return table(spark, d, "embeddings").where(F.size("embedding") == 64).groupBy("label").agg(F.count("*").alias("n"))


for _name in ("F11",):

    @query(_name, "select event_id, cast(user_id as int) as user_id from events where user_id is not null and event_type is not null")
    def f11(spark, d):
        return table(spark, d, "events").dropna(subset=["user_id", "event_type"]).select("event_id", F.col("user_id").cast("int").alias("user_id"))


@query("J02", "select c.event_id, coalesce(round(n.n_nationkey / 100.0::double, 4), 0.5) as score from events c left join nation n on n.n_nationkey = cast(replace('graph_' || c.user_id, 'graph_', '') as bigint)")
def j02(spark, d):
    hits = table(spark, d, "events").select("event_id", F.concat(F.lit("graph_"), F.col("user_id").cast("string")).alias("id"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.round(F.col("n_nationkey") / 100.0, 4).alias("score"))
    return hits.join(n, F.regexp_replace("id", "^graph_", "") == n.key, "left").select("event_id", F.coalesce("score", F.lit(0.5)).alias("score"))


@query("J03", "select v.vec_id, d.lang from embeddings v join documents d on d.doc_id = v.vec_id")
def j03(spark, d):
    return table(spark, d, "embeddings").join(table(spark, d, "documents"), F.col("vec_id") == F.col("doc_id")).select("vec_id", "lang")


for _name in ("J05",):

    @query(_name, "select doc_id from documents where doc_id not in (select doc_id from labels)")
    def j05(spark, d):
        return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("J06", "select d.doc_id, case when e.vec_id is null then 0.0 else round(cast(e.embedding[1] as double), 4) end as first from documents d left join embeddings e on e.vec_id = d.doc_id")
def j06(spark, d):
    docs, e = table(spark, d, "documents").select("doc_id"), table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("v"))
    missing = docs.join(e, "doc_id", "left_anti").withColumn("v", F.array_repeat(F.lit(0.0), 64))
    return docs.join(e, "doc_id").unionByName(missing).select("doc_id", F.round(F.col("v")[0], 4).alias("first"))


@query("J08", "select distinct 'e' || (doc_id % 9) as name, vec_id as unit_id from documents join embeddings on vec_id = doc_id")
def j08(spark, d):
    entities = table(spark, d, "documents").groupBy(F.concat(F.lit("e"), (F.col("doc_id") % 9).cast("string")).alias("name")).agg(F.collect_list("doc_id").alias("unit_ids"))
    return graph.mentions(entities, table(spark, d, "embeddings").select(F.col("vec_id").alias("unit_id")))


for _name in ("J10", "A07"):

    @query(_name, "select r_name, count(n_nationkey) as nations, coalesce(sum(s.n), 0)::bigint as suppliers, coalesce(round(sum(s.n) / count(n_nationkey), 2), 0.0) as ratio from region left join nation on n_regionkey = r_regionkey left join (select s_nationkey, count(*) as n from supplier group by 1) s on s_nationkey = n_nationkey group by r_name")
    def j10(spark, d):
        s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
        n = table(spark, d, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left")
        out = table(spark, d, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"), "left").groupBy("r_name")
        got = out.agg(F.count("n_nationkey").alias("nations"), F.sum("n").alias("suppliers"), F.round(F.sum("n") / F.count("n_nationkey"), 2).alias("ratio"))
        return got.fillna(0, ["suppliers"]).fillna(0.0, ["ratio"])


@query("J11", "select q.vec_id as query_id, count(*) as n, round(max(list_cosine_similarity(cast(q.embedding as double[]), cast(c.embedding as double[]))), 4) as best from embeddings q cross join embeddings c where q.vec_id % 50 = 0 and c.vec_id <> q.vec_id group by 1")
def j11(spark, d):
    from lexiflume.operators.vectors import similarity_stats

    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return similarity_stats(q, e, others_only=True).select("query_id", "n", F.round("best", 4).alias("best"))


for _name in ("J12",):

    @query(_name, "select doc_id, coalesce(l.quality, -1) as quality from documents d left join labels l using (doc_id) union all select -1, 5")
    def j12(spark, d):
        old = table(spark, d, "documents").select("doc_id", F.lit(-1).alias("quality"))
        new = table(spark, d, "labels").select("doc_id", "quality", F.lit(1).alias("v"))
        more = spark.createDataFrame([(-1, 4, 1), (-1, 5, 2)], "doc_id long, quality int, v int")
        return graph.upsert(old, new.unionByName(more), "doc_id", "v").select("doc_id", "quality")


@query("J14", "with q as (select item_id from benchmark order by item_id limit 20), r as (select item_id, doc_id from benchmark join documents on doc_id % 40 = item_id) select count(*) as n, count(distinct r.doc_id) as docs, count(distinct item_id) as queries from r join q using (item_id)")
def j14(spark, d):
    qids = table(spark, d, "benchmark").select("item_id").orderBy("item_id").limit(20)  # the operator's own first n queries
    qrels = table(spark, d, "benchmark").select("item_id").join(table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 40).alias("item_id")), "item_id")
    kept = qrels.join(qids, "item_id", "left_semi")
    return kept.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"), F.countDistinct("item_id").alias("queries"))


@query("A08", "select min(n_chars) as least, max(n_chars) as most, round(avg(n_chars), 4) as mean, min(doc_id) filter (n_chars = (select max(n_chars) from documents)) as longest from documents")
def a08(spark, d):
    t = table(spark, d, "documents")
    return t.agg(F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.round(F.avg("n_chars"), 4).alias("mean"), F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("longest"))


_K = "with t as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') as l from documents)"


@query("A09", f"{_K} select (select round(avg(len(list_distinct(l))::double / len(l)), 4) from t where len(l) > 0) as mean_ttr, (select round(count(distinct w)::double / count(*), 4) from (select unnest(l) as w from t)) as corpus_ttr")
def a09(spark, d):
    from lexiflume.functions.text import tokens

    t = table(spark, d, "documents").select(tokens("text").alias("l"))
    mean = t.where(F.size("l") > 0).agg(F.round(F.avg(F.size(F.array_distinct("l")) / F.size("l")), 4).alias("mean_ttr"))
    words = t.select(F.explode("l").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return mean.crossJoin(words.agg(F.round(F.count("*") / F.sum("n"), 4).alias("corpus_ttr")))  # one row each


@query("A10", "select doc_id % 7 as query_id, regexp_replace(doc_id % 13 || '~' || doc_id, '~[^~]*$', '') as doc, max(n_chars) as score from documents group by 1, 2")
def a10(spark, d):
    t = table(spark, d, "documents").select((F.col("doc_id") % 7).alias("query_id"), F.concat_ws("~", (F.col("doc_id") % 13).cast("string"), F.col("doc_id").cast("string")).alias("chunk"), "n_chars")
    return t.groupBy("query_id", F.regexp_replace("chunk", "~[^~]*$", "").alias("doc")).agg(F.max("n_chars").alias("score"))


for _name in ("A12", "G08"):

    @query(_name, "select 'lang' as kind, lang as name, count(*) as n from documents group by lang union all select 'event', event_type, count(*) from events group by event_type")
    def a12(spark, d):
        a = table(spark, d, "documents").groupBy(F.lit("lang").alias("kind"), F.col("lang").alias("name")).agg(F.count("*").alias("n"))
        return a.unionByName(table(spark, d, "events").groupBy(F.lit("event").alias("kind"), F.col("event_type").alias("name")).agg(F.count("*").alias("n")))


@query("A15", "select least(greatest(cast(floor(n_chars / 500.0) as bigint) + 1, 0), 21) as bucket, count(*) as n from documents group by 1")
def a15(spark, d):
    return table(spark, d, "documents").groupBy(F.expr("width_bucket(n_chars, 0, 10000, 20)").alias("bucket")).agg(F.count("*").alias("n"))


@query("A15_kde", """with c as (select n_chars::double as v, count(*) as n from documents where n_chars is not null group by 1), w as (select count(n_chars) as total, stddev_samp(n_chars::double) as sd, min(n_chars)::double as low, max(n_chars)::double as high from documents),
g as (select *, unnest(range(20)) as i, sd * pow(total::double, -0.2) as h from w where sd > 0), x as (select *, low + i * (high - low) / 19 as x from g)
select round(x, 4) as x, round(sum(n * exp(-pow((x - v) / h, 2) / 2)) / any_value(total * h) / sqrt(2 * pi()), 9) as density from x, c group by x""")
def a15_kde(spark, d):
    return evaluation.kernel_density(table(spark, d, "documents"), "n_chars").select(F.round("x", 4).alias("x"), F.round("density", 9).alias("density"))


@query("A16", "select doc_id, 'quality' as metric, quality as value from labels union all select doc_id, 'toxic', toxic from labels")
def a16(spark, d):
    return table(spark, d, "labels").unpivot("doc_id", ["quality", "toxic"], "metric", "value")


@query("K09", "select doc_id from documents order by md5(doc_id || ':42'), doc_id limit 50")
def k09(spark, d):
    from lexiflume.sources.store import sample_order

    t = table(spark, d, "documents").select("doc_id")
    return t.orderBy(sample_order("doc_id", 42), "doc_id").limit(50)  # the sampling operator


@query("K10", "select user_id, min(event_id) as first, count(*) as n from (select *, row_number() over (partition by user_id order by event_id) as rn from events) where rn <= 3 group by user_id")
def k10(spark, d):
    g = table(spark, d, "events").withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).where("rn <= 3")
    return g.groupBy("user_id").agg(F.min("event_id").alias("first"), F.count("*").alias("n"))


@query("K11", "select event_id from events order by ts desc, event_id limit 20")
def k11(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), "event_id").limit(20).select("event_id")


@query("U01", "select user_id as id, min(event_id) as pos from events where user_id is not null group by user_id union all select null, event_id from events where user_id is null")
def u01(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("pos"))
    both = e.where("pos % 2 = 0").unionByName(e.where("pos % 2 = 1"))
    first = F.row_number().over(Window.partitionBy("id").orderBy("pos"))
    return both.withColumn("n", first).where("n = 1 or id is null").drop("n")


@query("U02", f"with {CHUNKS} select doc_id, array_to_string(clause_nos, ',') as clauses from chunks")
def u02(spark, d):
    c = chunks(spark, d)
    return c.select("doc_id", F.array_join(F.transform(F.array_distinct(F.concat("clause_nos", "clause_nos")), lambda x: x.cast("string")), ",").alias("clauses"))


@query("U05", f"with {CHUNKS} select doc_id, list_has_any(clause_nos, [1, 3]) as both from chunks")
def u05(spark, d):
    return chunks(spark, d).select("doc_id", F.arrays_overlap("clause_nos", F.array(F.lit(1), F.lit(3))).alias("both"))


@query("U06", "select doc_id, case when lang = 'en' then 'en|src' else lang || '|en|src' end as variants from documents")
def u06(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(F.slice(F.array_distinct(F.array("lang", F.lit("en"), F.lit("src"), "lang")), 1, 4), "|").alias("variants"))
