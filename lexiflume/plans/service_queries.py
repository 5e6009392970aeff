"""Registered queries of ingest, graph import, reports, generation, routing and the service facade."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Window, functions as F

from lexiflume.functions import text as X
from lexiflume.operators import bm25, generation, vectors
from lexiflume.plans.indexed import index
from lexiflume.plans import retrieval
from lexiflume.plans.function_queries import _C01, _markdown
from lexiflume.plans.relation_queries import _JUDGED, judged
from lexiflume.providers import DEFAULT, Providers, coverage
from lexiflume.registered import query
from lexiflume.service import NliService, Service, checked
from lexiflume.sources import markdown, store
from lexiflume.sources.graph_store import GraphStore, read_inputs
from lexiflume.sources.reports import ReportWriter, read_report
from lexiflume.sources.tables import CHUNKS, QUESTIONS, chunks, questions, table
from lexiflume.streaming import incremental


@query("S01", f"with c as ({_C01}) select digest, article, count(*) as n from c group by all")
def s01(spark, d):
    files = store.scratch_path(spark, "markdown")
    # Files of some documents each: every document starts with a header of the first level.
    _markdown(spark, d).select(F.pmod("doc_id", F.lit(64)).alias("file"), "text").repartition("file").write.partitionBy("file").text(files)
    got = markdown.chunk_and_save(spark, files, store.scratch_path(spark, "chunks"), literal=True)
    return got.groupBy(F.md5("content").alias("digest"), "article").agg(F.count("*").alias("n"))


def _graph_inputs(spark, d) -> str:
    """The four tables of a graph over documents and nations, as Parquet files."""
    folder = store.scratch_path(spark, "graph-in")
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("n_tokens")).select(F.col("doc_id").alias("id"), "n_tokens").write.parquet(f"{folder}/text_units.parquet")
    units = F.expr("array(cast(n_nationkey as string), cast(n_nationkey + 25 as string), '-7')")
    nation.select(F.col("n_nationkey").alias("id"), F.concat(F.lit(" "), "n_name").alias("title"), units.alias("text_unit_ids")).write.parquet(f"{folder}/entities.parquet")
    pairs = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    pairs.select(F.col("n_nationkey").alias("id"), F.concat("r_name", F.lit(" region")).alias("source"), F.col("n_name").alias("target"), F.col("n_nationkey").cast("double").alias("weight")).write.parquet(f"{folder}/relationships.parquet")
    region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("title")).write.parquet(f"{folder}/community_reports.parquet")
    return folder


@query("S09", "select 'text_units' as name, count(*) as n, cast(sum(doc_id) as bigint) as keys from documents union all select 'entities', count(*), cast(sum(n_nationkey) as bigint) from nation union all select 'relationships', count(*), cast(sum(n_nationkey) as bigint) from nation union all select 'community_reports', count(*), cast(sum(r_regionkey) as bigint) from region")
def s09(spark, d):
    out = None
    for name, rows in read_inputs(spark, _graph_inputs(spark, d)).items():
        row = rows.agg(F.count("*").alias("n"), F.sum("id").cast("long").alias("keys")).select(F.lit(name).alias("name"), "n", "keys")
        out = row if out is None else out.unionByName(row)
    return out


def _graph(spark, d) -> GraphStore:
    """Imported, then some entities and edges imported again with other values."""
    graph = GraphStore(spark, store.scratch_path(spark, "graph"))
    graph.import_all(_graph_inputs(spark, d), clear_first=True)
    again = table(spark, d, "nation").where("n_nationkey < 5")
    graph.entities(again.select((F.col("n_nationkey") + 100).alias("id"), F.col("n_name").alias("title"), F.array(F.lit("1")).alias("text_unit_ids")))
    graph.relationships(again.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("source"), F.lit("ELSEWHERE").alias("target"), F.lit(-1.0).alias("weight")))
    return graph


_GRAPH = """ent as (select n_name as name, cast(case when n_nationkey < 5 then n_nationkey + 100 else n_nationkey end as varchar) as id from nation union all select r_name || ' region', null from region union all select 'ELSEWHERE', null),
men as (select distinct n_name as name, cast(u as varchar) as unit from (select n_name, unnest([n_nationkey, n_nationkey + 25]) as u from nation union all select n_name, 1 from nation where n_nationkey < 5) where u in (select doc_id from documents)),
rel as (select n_nationkey as id, case when n_nationkey < 5 then n_name else r_name || ' region' end as source, case when n_nationkey < 5 then 'ELSEWHERE' else n_name end as target, case when n_nationkey < 5 then -1 else n_nationkey end as weight from nation join region on n_regionkey = r_regionkey)"""


@query("S11", f"with {_GRAPH} select 'Entity' as kind, name as a, coalesce(id, '') as b from ent union all select 'MENTIONS', name, unit from men union all select 'RELATED_TO', source, target || cast(cast(weight as int) as varchar) from rel union all select 'CommunityReport', r_name, cast(r_regionkey as varchar) from region")
def s11(spark, d):
    g = _graph(spark, d)
    rows = lambda name, a, b: g.table(name).select(F.lit(name).alias("kind"), F.expr(a).alias("a"), F.expr(b).alias("b"))
    out = rows("Entity", "name", "coalesce(cast(id as string), '')").unionByName(rows("MENTIONS", "name", "unit_id"))
    return out.unionByName(rows("RELATED_TO", "source", "concat(target, cast(cast(weight as int) as string))")).unionByName(rows("CommunityReport", "title", "id"))


@query("S12", f"with {_GRAPH} select 'TextUnit' as name, count(*) as n from documents union all select 'Entity', count(*) from ent union all select 'MENTIONS', count(*) from men union all select 'RELATED_TO', count(*) from rel union all select 'CommunityReport', count(*) from region")
def s12(spark, d):
    return _graph(spark, d).counts()


@query("S15", f"""with {CHUNKS} select 'dense' as field, 'vector' as kind, 'cosine' as setting, cast(max(len(embedding)) as int) as size, count(*) as n from embeddings where embedding is not null
union all select 'sparse', 'vector', 'idf', null, count(*) from chunks union all select 'article_no', 'payload', 'integer', null, count(article_no) from chunks union all select 'chapter_no', 'payload', 'integer', null, count(chapter_no) from chunks
union all select 'section_no', 'payload', 'integer', null, count(section_no) from chunks union all select 'clause_nos', 'payload', 'integer', null, count(*) filter (len(clause_nos) > 0) from chunks""")
def s15(spark, d):
    return store.collection(chunks(spark, d), table(spark, d, "embeddings"))


@query("S16", "select doc_id, md5(text) as content, cast(doc_id % 50 + 1 as int) as article_no, true as fits from documents")
def s16(spark, d):
    path = store.scratch_path(spark, "points")
    store.upsert_batches(chunks(spark, d).select("doc_id", "content", "article_no")).write.parquet(path)
    point = F.explode(F.from_json("body", "array<struct<doc_id:bigint,content:string,article_no:int>>")).alias("p")
    sent = spark.read.parquet(path).select((F.col("n") <= 100).alias("fits"), point)
    return sent.select("p.doc_id", F.md5("p.content").alias("content"), "p.article_no", "fits")


_CASES = "case1 as (select event_id as id, a, b from j), case2 as (select id, a, case when id % 3 = 0 then coalesce(b, 0) + 1 else b end as b from case1 where id % 2 = 0 or id % 3 = 0)"
_MEANS = "count(*) as n, coalesce(round(avg(case when isnan(a) then null else a end), 4), 0.0) as avg_a, coalesce(round(avg(b), 4), 0.0) as avg_b"


def _report(spark, d, stamp="20260101_000000"):
    rows = judged(spark, d).select(F.col("event_id").alias("id"), "a", "b", F.lit("x").alias("retrieved_payloads"))
    report = ReportWriter(spark, store.scratch_path(spark, "reports"), "bm25_rr", stamp, 10, ["a", "b"])
    report.init()
    steps = [report.summary().select(F.lit(0).alias("step"), "n", "avg_a", "avg_b")]
    for i, batch in enumerate((rows.where("id % 2 = 0"), rows.where("id % 3 = 0").withColumn("b", F.coalesce("b", F.lit(0.0)) + 1)), 1):
        report.append(batch.withColumn("at", F.lit(i)), "at")
        steps.append(store.kept(report.summary().select(F.lit(i).alias("step"), "n", "avg_a", "avg_b")))
    return report, steps


@query("S20", f"with {_JUDGED}, {_CASES}, m as (select {_MEANS} from case2), f as (select * from (values ('eval_report_20260101_000000.json'), ('eval_latest_bm25_rr.json')) t(file)) select file, 'completed' as status, n as completed, avg_a, avg_b, n as cases, 0::bigint as payloads from f, m")
def s20(spark, d):
    out = None
    for path in _report(spark, d)[0].finalize():
        rows = read_report(spark, path)
        one = lambda kind, field: F.max(F.when(F.col("kind") == kind, F.get_json_object("body", f"$.{field}")))
        row = rows.agg(
            one("metadata", "status").alias("status"), one("summary", "completed_count").cast("long").alias("completed"), one("summary", "avg_a").cast("double").alias("avg_a"), one("summary", "avg_b").cast("double").alias("avg_b"),
            F.count(F.when(F.col("kind") == "case", 1)).alias("cases"), F.count(F.get_json_object("body", "$.retrieved_payloads")).alias("payloads"),
        ).select(F.lit(path.rsplit("/", 1)[1]).alias("file"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query("S21", f"with {_JUDGED}, {_CASES} select 0 as step, 0::bigint as n, 0.0::double as avg_a, 0.0::double as avg_b union all select 1, {_MEANS} from case1 where id % 2 = 0 union all select 2, {_MEANS} from case2")
def s21(spark, d):
    a, b, c = _report(spark, d)[1]
    return a.unionByName(b).unionByName(c)


@query("T01", f"with {_JUDGED}, {_CASES} select id, case when isnan(a) then null else a end as a, b from case2")
def t01(spark, d):
    rows = judged(spark, d).select(F.col("event_id").alias("id"), F.nanvl("a", F.lit(None).cast("double")).alias("a"), "b")
    folder = store.scratch_path(spark, "stream")
    for i, batch in enumerate((rows.where("id % 2 = 0"), rows.where("id % 3 = 0").withColumn("b", F.coalesce("b", F.lit(0.0)) + 1)), 1):
        batch.withColumn("at", F.lit(i)).repartition(2).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema("id long, a double, b double, at int").parquet(f"{folder}/in")
        incremental.run_upserts(spark, source, f"{folder}/out", "id", "at")
    return incremental.current(spark, f"{folder}/out").select("id", "a", "b")


@query("S27", "select 'csv' as split, event_id, cast(user_id as int) as label, event_type as kind from events where user_id is not null and event_type is not null and event_id % 6 <> 0 union all select 'parquet', event_id, cast(user_id as int), event_type from events where user_id is not null and event_type is not null")
def s27(spark, d):
    rows = table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("label"), F.col("event_type").alias("kind"))
    folder = store.scratch_path(spark, "nli")
    # Two fields are missing in some lines of the CSV file.
    gaps = rows.select("event_id", F.when(F.col("event_id") % 6 != 0, F.col("label")).alias("label"), F.when(F.col("event_id") % 12 != 0, F.col("kind")).alias("kind"))
    gaps.write.option("header", True).csv(f"{folder}/train")
    rows.write.parquet(f"{folder}/test")
    out = None
    for split, got in (("csv", spark.read.option("header", True).schema("event_id long, label string, kind string").csv(f"{folder}/train")), ("parquet", spark.read.parquet(f"{folder}/test"))):
        got = got.dropna(subset=["label", "kind"]).select(F.lit(split).alias("split"), "event_id", F.col("label").cast("int").alias("label"), "kind")
        out = got if out is None else out.unionByName(got)
    return out


_NEAR = """n as (select q.vec_id as query_id, c.vec_id, round(list_cosine_similarity(cast(q.embedding as double[]), cast(c.embedding as double[])), 6) as score from embeddings q cross join embeddings c where q.vec_id % 50 = 0),
near as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from n)"""


@query("V04", f"with {_NEAR} select route, want, query_id, vec_id from near, (values ('local', 'there'), ('remote', 'missing'), ('remote', 'unwanted')) r(route, want) where rank <= 3")
def v04(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    here, gone = (store.VectorStore(spark, store.scratch_path(spark, "vectors")) for _ in range(2))
    here.save(e)
    remote = lambda q, k: vectors.nearest(q, e, k)
    out = None
    for want, local, prefer in (("there", here, True), ("missing", gone, True), ("unwanted", here, False)):
        got = store.routed_search(local, remote, asked, 3, prefer).select("route", F.lit(want).alias("want"), "query_id", "vec_id")
        out = got if out is None else out.unionByName(got)
    return out


@query("V06", """with t as (select label, vec_id, vec_id % 4 <> 0 as used, embedding, row_number() over (partition by label order by vec_id) as pos from embeddings),
c as (select label, i, avg(cast(embedding[i] as double)) as x from t, generate_series(1, 64) g(i) where used group by all),
f as (select label, i, case when used then cast(embedding[i] as double) else 0.0 end as x from t, generate_series(1, 64) g(i) where pos = 1)
select 'average' as how, label, cast(i as int) as i, round(x, 4) + 0.0 as x from c union all select 'unit', label, cast(i as int), round(x / sqrt(sum(x * x) over (partition by label)), 4) + 0.0 from c union all select 'cls', label, cast(i as int), round(x, 4) + 0.0 from f""")
def v06(spark, d):
    t = table(spark, d, "embeddings").select(F.col("label").alias("doc_id"), F.col("vec_id").alias("pos"), F.when(F.col("vec_id") % 4 != 0, 1).otherwise(0).alias("mask"), "embedding")
    out = None
    for name, how, normalise in (("average", "average", False), ("unit", "average", True), ("cls", "cls", False)):
        got = vectors.pooled(t, how, normalise).select(F.lit(name).alias("how"), F.col("doc_id").alias("label"), F.posexplode("embedding").alias("i", "x")).select("how", "label", (F.col("i") + 1).alias("i"), (F.round("x", 4) + 0.0).alias("x"))
        out = got if out is None else out.unionByName(got)
    return out


@query("R20", f"""with recursive {CHUNKS}, o as (select source, doc_id, len(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]+')) as n, row_number() over (partition by source order by doc_id) as i from chunks),
r as (select source, i, doc_id, n, n + 2 as total, 0 as batch from o where i = 1 union all
    select r.source, o.i, o.doc_id, o.n, case when r.total + o.n + 2 > 8092 then o.n + 2 else r.total + o.n + 2 end, case when r.total + o.n + 2 > 8092 then r.batch + 1 else r.batch end from r join o on o.source = r.source and o.i = r.i + 1),
s as (select source, batch, doc_id, n, sum(n) over (partition by source, batch order by doc_id) - n as start from r where true),
v as (select *, n / 2.0 + 1 as x, start + (n - 1) / 2.0 + 1 as y from s where n > 0)
select cast(doc_id as varchar) as chunk_id, cast(start as bigint) as start, cast(start + n as bigint) as "end", round(x / sqrt(x * x + y * y), 3) as first from v""")
def r20(spark, d):
    """Token p of a batch has the vector (half its chunk's length + 1, p + 1), so a chunk's mean is known."""
    t = chunks(spark, d).select("chunk_id", "source", "doc_id", F.size(X.tokens("content")).cast("long").alias("n_tokens"))

    def embed(part, first, last):
        sizes, pos = part.column("n_tokens").to_numpy(), np.arange(first, last)
        return np.stack([sizes[np.searchsorted(np.cumsum(sizes), pos, "right")] / 2 + 1, pos + 1.0], 1)

    found = vectors.late_ingest(t, rows=embed)
    return found.select("chunk_id", "start", "end", F.round(F.col("embedding")[0], 3).alias("first"))


@query("R17", "with t as (select doc_id, replace(text, 'e', '3') as a from documents) select doc_id, md5(case when length(a) % 2 = 0 then a else substr(a, 1, 60) end) as digest, case when length(a) % 2 = 0 then 'clip: even' else '' end as errors from t")
def r17(spark, d):
    def clip(t):
        if len(t) % 2 == 0:
            raise ValueError("even")
        return t[:60]

    steps = [("base", str.upper), ("swap", lambda t: t.replace("e", "3")), ("clip", clip)]
    got = generation.chained(table(spark, d, "documents").select("doc_id", "text"), "text", steps)
    return got.select("doc_id", F.md5("text").alias("digest"), F.array_join("errors", ",").alias("errors"))


_CHECKS = (("advanced", "rag_fusion", ["hyde"], ["crag"]), ("plain", None, ["hyde"], ["prompt_compression"]), ("unknown", None, ["nope"], []), ("two fixed", None, [], ["crag", "filter_rerank"]), ("no strategy", "none", [], []))


@query("R18", f"with {QUESTIONS}, n as (select count(*) as n from questions) select name, outcome, case when answers then n else 0 end as answered from n cross join (values ('advanced', '', true), ('plain', 'hyde prompt_compression', true), ('unknown', 'ValueError', false), ('two fixed', 'ValueError', false), ('no strategy', 'ValueError', false)) t(name, outcome, answers)")
def r18(spark, d):
    """Which of some configurations are valid, which steps they come to, and how many questions a retriever with them answers."""
    out = None
    for name, advanced, pre, post in _CHECKS:
        try:
            r = retrieval.Retriever(index(spark, d), chunks(spark, d), table(spark, d, "embeddings"), advanced=advanced, pre=pre, post=post)
            outcome, rows = " ".join((*r.pre, *r.post)), r.select(questions(spark, d))
        except ValueError:
            outcome, rows = "ValueError", questions(spark, d).limit(0)
        row = rows.agg(F.countDistinct("query_id").alias("answered")).select(F.lit(name).alias("name"), F.lit(outcome).alias("outcome"), "answered")
        out = row if out is None else out.unionByName(row)
    return out


@query("R19", f"with {QUESTIONS} select s.name, count(*) as queries, 'ValueError' as unknown from questions cross join (values ('filter_rerank'), ('rag_fusion')) s(name) where query_id in (select vec_id from embeddings) and exists (select 1 from embeddings join documents on doc_id = vec_id) group by 1")
def r19(spark, d):
    """Each strategy by its name answers the questions that have a vector."""
    try:
        unknown = str(retrieval.strategy("none"))
    except ValueError:
        unknown = "ValueError"
    asked = questions(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id")), "query_id")
    out = None
    for name in sorted(retrieval.STRATEGIES):
        r = retrieval.Retriever(index(spark, d), chunks(spark, d), table(spark, d, "embeddings"), advanced=name)
        row = r.select(asked).agg(F.countDistinct("query_id").alias("queries")).select(F.lit(name).alias("name"), "queries", F.lit(unknown).alias("unknown"))
        out = row if out is None else out.unionByName(row)
    return out


@query("R25", f"with {QUESTIONS}, n as (select count(*) as n from questions) select kind, name, n as answered from n cross join (values ('pre', 'base'), ('pre', 'hyde'), ('post', 'base'), ('post', 'crag'), ('post', 'filter_rerank'), ('post', 'prompt_compression')) t(kind, name)")
def r25(spark, d):
    """Every step that can be found by name, applied to the questions or to what is chosen for them."""
    r = retrieval.Retriever(index(spark, d), chunks(spark, d), table(spark, d, "embeddings"), providers=Providers(entail=lambda q, t: F.lit(0.9)))
    asked = r.understood(questions(spark, d))
    chosen = store.kept(r.chosen(asked))
    steps = [("pre", n, f(r, asked)) for n, f in sorted(retrieval.PREPROCESS.items())] + [("post", n, f(r, asked, chosen)) for n, f in sorted(retrieval.POSTPROCESS.items())]
    rows = [df.agg(F.countDistinct("query_id").alias("answered")).select(F.lit(kind).alias("kind"), F.lit(name).alias("name"), "answered") for kind, name, df in steps]
    return functools.reduce(lambda a, b: a.unionByName(b), rows)


@query("R21", f"with {QUESTIONS} select query_id, length(query) % 3 + 1 as attempts, list_sum([2.0, 4.0][1 : length(query) % 3]) as waited from questions where length(query) % 3 > 0 union all select query_id, 1, 0.0 from questions where length(query) % 3 = 0")
def r21(spark, d):
    def run(text):
        calls, waits = [], []

        def call(prompt):
            calls.append(prompt)
            if len(calls) <= len(prompt) % 3:
                raise TimeoutError("busy")
            return "ok"

        generation.with_retry(call, 3, sleep=waits.append)(text)
        return f"{len(calls)} {sum(waits)}"

    got = questions(spark, d).select("query_id", F.split(generation.attempted("query", run)["value"], " ").alias("v"))
    return got.select("query_id", F.col("v")[0].cast("long").alias("attempts"), F.col("v")[1].cast("double").alias("waited"))


_PROMPTS = f"{QUESTIONS}, p as (select query_id, '<context>' || chr(10) || coalesce(question_type, 'none') || chr(10) || '</context>' || chr(10) || chr(10) || '<question>' || chr(10) || query || chr(10) || '</question>' as prompt, coalesce(question_type, 'none') as context from questions)"


@query("R22", f"with {_PROMPTS} select query_id, case when length(prompt) % 5 = 0 then '[Lỗi sinh câu trả lời: busy]' else context end as answer, length(prompt) % 5 = 0 as failed, true as timed from p")
def r22(spark, d):
    def call(prompt):
        if len(prompt) % 5 == 0:
            raise TimeoutError("busy")
        return generation.first_sentence(prompt)

    asked = questions(spark, d).select("query_id", retrieval.prompt(F.coalesce("question_type", F.lit("none")), F.col("query")).alias("prompt"))
    return generation.answers(asked, call).select("query_id", "answer", "failed", (F.col("latency_ms") >= 0).alias("timed"))


@query("R23", f"with {QUESTIONS} select query_id, case when query_id % 4 = 0 then '' else '1' end as choices from questions")
def r23(spark, d):
    """The second passage holds the question itself, the others none of its words; every fourth question's model never answers."""
    rows = questions(spark, d).select("query_id", F.concat(F.when(F.col("query_id") % 4 == 0, F.lit("!fail ")).otherwise(F.lit("")), "query").alias("query"), F.array(F.lit("0"), "query", F.lit("1")).alias("passages"))

    def call(prompt):
        if "!fail" in prompt:
            raise TimeoutError("busy")
        return generation.overlap_choice(prompt)

    got = generation.multi_choice(rows, call, sleep=lambda s: None)
    return got.select("query_id", F.array_join(F.col("choices").cast("array<string>"), ",").alias("choices"))


@query("R24", "with w as (select item_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) as l from benchmark) select 'up' as probe, item_id, 0.25 as score from w union all select 'down', item_id, case when len(l) > 0 then 1.0 else 0.0 end from w union all select 'broken', item_id, case when len(l) > 0 then 1.0 else 0.0 end from w")
def r24(spark, d):
    def broken():
        raise ConnectionError

    out = None
    for name, probe in (("up", lambda: True), ("down", lambda: False), ("broken", broken)):
        judge = checked(Providers(entail=lambda q, t: F.lit(0.25), available=probe)).entail
        got = table(spark, d, "benchmark").select(F.lit(name).alias("probe"), "item_id", judge(F.col("text"), F.col("text")).cast("double").alias("score"))
        out = got if out is None else out.unionByName(got)
    return out


def _service(spark, d) -> Service:
    r = retrieval.Retriever(index(spark, d), chunks(spark, d), table(spark, d, "embeddings"))
    return Service(r, store.scratch_path(spark, "reports"))


@query("D01", f"""with {QUESTIONS}, n as (select count(*) as n from questions) select 'health' as call, 'index' as k, 'true' as v union all select 'health', 'reports', 'true' union all select 'health', 'providers', 'true'
union all select 'info', coalesce(question_type, 'unknown'), cast(count(*) as varchar) from questions group by 2
union all select 'query', cast(query_id as varchar), 'false' from questions
union all select 'latest', 'completed', cast(n as varchar) from n""")
def d01(spark, d):
    s, q = _service(spark, d), questions(spark, d)
    row = lambda df, call, k, v: df.select(F.lit(call).alias("call"), F.expr(k).alias("k"), F.expr(v).alias("v"))
    s.eval_run(q, "bm25", "20260101_000000")
    latest = s.eval_latest(spark, "bm25").groupBy().agg(F.max(F.when(F.col("kind") == "metadata", F.get_json_object("body", "$.status"))).alias("status"), F.count(F.when(F.col("kind") == "case", 1)).alias("n"))
    out = row(s.health(spark), "health", "component", "cast(ok as string)").unionByName(row(s.eval_info(q), "info", "question_type", "cast(n as string)"))
    return out.unionByName(row(s.query(q), "query", "cast(query_id as string)", "cast(failed as string)")).unionByName(row(latest, "latest", "status", "cast(n as string)"))


@query("D02", """with p as (select d.doc_id, case when l.quality = 1 then 1 else 0 end as truth, case when d.doc_id % 3 = 0 then 1.0 else 0.0 end as share from documents d join labels l using (doc_id))
select sum((truth = 1 and share = 1)::int)::bigint as tp, sum((truth = 0 and share = 1)::int)::bigint as fp, sum((truth = 1 and share = 0)::int)::bigint as fn, sum((truth = 0 and share = 0)::int)::bigint as tn from p""")
def d02(spark, d):
    pairs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.when(F.col("doc_id") % 3 == 0, F.lit("yes")).otherwise(F.lit("no")).alias("question"), F.lit("yes indeed").alias("context"), (F.col("quality") == 1).cast("int").alias("label"))
    return NliService().evaluate(pairs).select("tp", "fp", "fn", "tn")
