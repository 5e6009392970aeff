"""Registered queries of evaluation: metrics per row, summaries, judge scores, incremental tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from lexiflume.functions import metrics as M, text as X
from lexiflume.operators import bm25, evaluation as E
from lexiflume.plans.evaluation import ANSWER_METRICS, JUDGED, METRICS, Bm25Retriever, EvalJob
from lexiflume.plans.indexed import index
from lexiflume.plans.relation_queries import _JUDGED, judged
from lexiflume.registered import query
from lexiflume.sources import store
from lexiflume.sources.reports import ReportWriter, fingerprint, resumable
from lexiflume.sources.tables import CHUNKS, QUESTIONS, chunks, questions, table
from lexiflume.streaming.incremental import latest

_REL = f"""{bm25.RANKED}, {CHUNKS}, {QUESTIONS},
judged as (select h.query_id, h.doc_id, h.bm25_rank as rank, cast(c.article_no = q.gt_article and (len(gt_clauses) = 0 or list_has_any(clause_nos, gt_clauses)) as int) as rel
    from hits h join chunks c using (doc_id) join questions q using (query_id))"""
_METRICS = f"""{_REL},
m0 as (select query_id, max(rel) as hit, coalesce(round(1.0::double / min(rank) filter (rel = 1), 4), 0) as mrr, round(avg(rel), 4) as "precision", sum(rel) as n_rel, sum(rel / log2(rank + 1)) as dcg from judged group by query_id),
m as (select query_id, hit, mrr, "precision", round(case when n_rel > 0 then dcg / (select sum(1 / log2(i + 1)) from generate_series(1, 1000) g(i) where i <= n_rel) else 0 end, 4) as ndcg from m0)"""


def _judged(spark, d):
    hits = index(spark, d).search(questions(spark, d))
    pairs = hits.join(chunks(spark, d).select("doc_id", "article_no", "clause_nos"), "doc_id").join(questions(spark, d), "query_id")
    return pairs.select("query_id", "doc_id", F.col("bm25_rank").alias("rank"), E.relevant().cast("int").alias("rel"), "question_type")


for _name in ("J07", "E02"):

    @query(_name, f"with {_REL} select query_id, doc_id, rel from judged")
    def j07(spark, d):
        return _judged(spark, d).select("query_id", "doc_id", "rel")


for _name, _col in (("E03", "hit"), ("E04", "mrr"), ("W03", "mrr"), ("E06", "precision"), ("E07", "ndcg")):

    @query(_name, f'with {_METRICS} select query_id, "{_col}" as value from m')
    def e03(spark, d, _col=_col):
        return E.retrieval_metrics(_judged(spark, d)).select("query_id", F.col(_col).alias("value"))


@query("E05", f"with {_REL}, t as (select query_id, gt_article, cast(unnest(case when len(gt_clauses) = 0 then [0] else gt_clauses || [99] end) as int) as clause from questions), x as (select t.query_id, t.clause, bool_or(c.article_no = t.gt_article and (t.clause = 0 or list_contains(c.clause_nos, t.clause))) as ok from t join hits h using (query_id) join chunks c using (doc_id) group by all) select query_id, round(avg(ok::int), 4) as recall from x group by query_id")
def e05(spark, d):
    truth = questions(spark, d).select("query_id", "gt_article", F.explode(F.when(F.size("gt_clauses") == 0, F.array(F.lit(0))).otherwise(F.array_append("gt_clauses", F.lit(99)))).alias("clause"))
    found = index(spark, d).search(questions(spark, d)).join(chunks(spark, d).select("doc_id", "article_no", "clause_nos"), "doc_id").select(F.col("query_id").alias("q"), "article_no", "clause_nos")
    on = (F.col("query_id") == F.col("q")) & (F.col("article_no") == F.col("gt_article")) & ((F.col("clause") == 0) | F.array_contains("clause_nos", F.col("clause")))
    return E.recall_of_items(truth, found, on)


@query("E01", f"with {QUESTIONS} select query_id, gt_article, cast(len(gt_clauses) as bigint) as n_clauses from questions")
def e01(spark, d):
    raw = questions(spark, d).select("query_id", F.to_json(F.array(F.struct(F.col("gt_article").alias("article_no"), F.col("gt_clauses").alias("clause_nos")), F.struct(F.lit(None).cast("int").alias("article_no"), F.col("gt_clauses").alias("clause_nos")))).alias("law_id"))
    laws = F.filter(F.from_json("law_id", "array<struct<article_no:int,clause_nos:array<int>>>"), lambda x: x["article_no"].isNotNull())
    return raw.select("query_id", F.explode(laws).alias("l")).select("query_id", F.col("l.article_no").alias("gt_article"), F.size("l.clause_nos").cast("long").alias("n_clauses"))


# Answers: a user turn against the assistant turn after it.
_N = r"list_filter(string_split(trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'), ' '), ' '), lambda x: x <> '')"
_OV = "coalesce(list_sum(list_transform(list_distinct(a), lambda t: least(len(list_filter(a, lambda x: x = t)), len(list_filter(b, lambda x: x = t))))), 0)"
_QA = f"""qa as (select conv_id, turn, {_N.format('text')} as a, {_N.format('answer')} as b, text, answer from (select *, lead(text) over (partition by conv_id order by turn) as answer from conversations) where answer is not null),
ov as (select *, {_OV} as o from qa)"""


def _answers(spark, d):
    c = table(spark, d, "conversations").withColumn("answer", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("answer is not null")
    return c.withColumn("a", X.eval_tokens("text")).withColumn("b", X.eval_tokens("answer"))


for _name in ("E08", "U04"):

    @query(_name, f"with {_QA} select conv_id, turn, cast(o as bigint) as overlap, round(case when o > 0 then 2 * (o::double / len(a)) * (o::double / len(b)) / (o::double / len(a) + o::double / len(b)) else 0 end, 4) as f1 from ov")
    def e08(spark, d):
        return _answers(spark, d).select("conv_id", "turn", M.overlap(F.col("a"), F.col("b")).cast("long").alias("overlap"), F.round(M.token_f1(F.col("a"), F.col("b")), 4).alias("f1"))


@query("E09", f"with {_QA} select conv_id, turn, cast(array_to_string(a, ' ') = array_to_string(b, ' ') as int)::double as em from qa")
def e09(spark, d):
    return _answers(spark, d).select("conv_id", "turn", M.exact_match("text", "answer").alias("em"))


@query("E10", f"with {_QA} select conv_id, turn, round(case when o > 0 then o::double / len(a) * case when len(a) < len(b) then exp(1 - len(b)::double / len(a)) else 1 end else 0 end, 4) as bleu1 from ov")
def e10(spark, d):
    return _answers(spark, d).select("conv_id", "turn", F.round(M.bleu1(F.col("a"), F.col("b")), 4).alias("bleu1"))


@query("E11", f"""with {_QA},
l as (select conv_id, turn, a, b, list_reduce(a, lambda r, x: list_transform(range(1, len(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(r[k], case when b[k] = x then (case when k > 1 then r[k - 1] else 0 end) + 1 else 0 end)))), list_transform(b, lambda y: 0::bigint)) as last from qa)
select conv_id, turn, round(case when coalesce(last[-1], 0) > 0 then 2 * last[-1]::double / (len(a) + len(b)) else 0 end, 4) as rouge_l from l""")
def e11(spark, d):
    return _answers(spark, d).select("conv_id", "turn", F.round(M.rouge_l("a", "b"), 4).alias("rouge_l"))


@query("E12", f"with {_QA} select conv_id, turn, round(case when o > 0 then 2 * (o::double / len(a)) * (o::double / len(b)) / (o::double / len(a) + o::double / len(b)) else 0 end, 4) as f1, cast(array_to_string(a, ' ') = array_to_string(b, ' ') as int)::double as em from ov")
def e12(spark, d):
    return _answers(spark, d).select("conv_id", "turn", F.round(M.token_f1(F.col("a"), F.col("b")), 4).alias("f1"), M.exact_match("text", "answer").alias("em"))


_W = "list_distinct(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+'))"
_SHARE = "round(case when len({0}) > 0 then len(list_filter({0}, lambda x: list_contains({1}, x)))::double / len({0}) else 0 end, 4)"


@query("E13", f"""with q as (select conv_id, turn, text, lead(text) over w as answer, lag(text) over w as before, lead(text, 2) over w as truth from conversations window w as (partition by conv_id order by turn)),
c as (select *, list_filter([before, text], lambda x: x is not null) as ctx, coalesce(truth, '') as t0 from q where answer is not null),
k as (select *, {_W.format("text")} as qw, {_W.format("answer")} as aw, {_W.format("t0")} as tw, {_W.format("array_to_string(ctx, ' ')")} as cw from c)
select conv_id, turn, {_SHARE.format("aw", "cw")} as faithfulness, {_SHARE.format("qw", "aw")} as answer_relevancy, {_SHARE.format("tw", "cw")} as context_recall,
    round(len(list_filter(ctx, lambda x: list_has_any({_W.format("x")}, tw)))::double / len(ctx), 4) as context_precision from k""")
def e13(spark, d):
    from lexiflume.operators.generation import judged_answers

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("question"), F.lead("text").over(w).alias("answer"), F.lag("text").over(w).alias("before"), F.coalesce(F.lead("text", 2).over(w), F.lit("")).alias("truth")).where("answer is not null")
    rows = c.withColumn("contexts", F.filter(F.array("before", "question"), lambda x: x.isNotNull()))
    return judged_answers(rows).select("conv_id", "turn", "faithfulness", "answer_relevancy", "context_precision", "context_recall")


def _rows(spark, d):
    return E.retrieval_metrics(_judged(spark, d)).join(questions(spark, d).select("query_id", "question_type"), "query_id")


_MACRO = f'with {_METRICS} select count(*) as n, round(sum(hit)::double / count(*) + 1e-9, 4) as avg_hit, round(sum(mrr) / count(*) + 1e-9, 4) as avg_mrr, round(sum("precision") / count(*) + 1e-9, 4) as avg_precision, round(sum(ndcg) / count(*) + 1e-9, 4) as avg_ndcg from m'


@query("A03", _MACRO)
def a03(spark, d):
    return E.macro_all(_rows(spark, d), ["hit", "mrr", "precision", "ndcg"])


def _job(spark, d) -> EvalJob:
    return EvalJob(Bm25Retriever(index(spark, d), chunks(spark, d)))


@query("E16", _MACRO)
def e16(spark, d):
    """Every question is searched for, answered within the time that it has, and measured; error rows count."""
    return E.macro_all(_job(spark, d).cases(questions(spark, d)), METRICS)


@query("E17", _MACRO)
def e17(spark, d):
    """A whole run that goes on with the report of one which ended after half of the questions; the summary is that of the report's cases."""
    q, job = questions(spark, d), _job(spark, d)
    begun = lambda: ReportWriter(spark, folder, "bm25", "20260101_000000", q.count(), [*METRICS, *ANSWER_METRICS, *JUDGED], tuple(JUDGED))
    folder = store.scratch_path(spark, "reports")
    job.answer(q.where("query_id % 2 = 0"), begun())
    return job.summary(job.full(q, begun()))[0]


@query("A04", f"with {_METRICS} select coalesce(question_type, 'unknown') as question_type, count(*) as n, round(sum(hit)::double / count(*) + 1e-9, 4) as avg_hit, round(sum(ndcg) / count(*) + 1e-9, 4) as avg_ndcg from m join questions using (query_id) group by 1")
def a04(spark, d):
    return E.per_type(_rows(spark, d), ["hit", "ndcg"])


@query("A05", f"with {_JUDGED} select count(*) as n, coalesce(round(avg(case when isnan(a) then null else a end), 4), 0.0) as avg_a, coalesce(round(avg(b), 4), 0.0) as avg_b from j")
def a05(spark, d):
    return E.macro_valid(judged(spark, d), ["a", "b"])


@query("A05_types", f"with {_JUDGED} select coalesce(nullif(event_type, ''), 'unknown') as question_type, count(*) as n, round(sum(coalesce(b, 0)) / count(*) + 1e-9, 4) as avg_b from j group by 1")
def a05t(spark, d):
    return E.per_type(judged(spark, d).withColumnRenamed("event_type", "question_type"), ["b"])


@query("A06", f"with {_JUDGED} select count(*) as n, round(avg(case when isnan(a) then null else a end), 4) as avg_a from j")
def a06(spark, d):
    return E.macro_valid(judged(spark, d), ["a"], ("a",))


for _name in ("A13", "E19"):

    @query(_name, """with c as (select sum((quality = 1 and n_chars > 1000)::int) as tp, sum((quality = 0 and n_chars > 1000)::int) as fp, sum((quality = 1 and n_chars <= 1000)::int) as fn, sum((quality = 0 and n_chars <= 1000)::int) as tn from labels join documents using (doc_id))
select tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, tn::bigint as tn, round((tp + tn)::double / (tp + fp + fn + tn), 4) as accuracy, round(tp::double / (tp + fp), 4) as "precision", round(tp::double / (tp + fn), 4) as recall, round(2.0::double * tp / (2 * tp + fp + fn), 4) as f1, round((2.0::double * tp / (2 * tp + fp + fn) + 2.0::double * tn / (2 * tn + fp + fn)) / 2, 4) as macro_f1 from c""")
    def a13(spark, d):
        rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select(F.col("quality").alias("truth"), (F.col("n_chars") > 1000).cast("int").alias("predicted"))
        return E.classification(rows)


_PER = f"""{_REL}, qr as (select query_id, doc_id from questions join chunks on article_no = gt_article where len(gt_clauses) = 0 or list_has_any(clause_nos, gt_clauses)),
tot as (select query_id, count(*) as n_rel from qr group by 1), j2 as (select *, sum(rel) over (partition by query_id order by rank) as so_far from judged),
ats as (select t.query_id, n_rel, k, rank, so_far, rel * (rank <= k)::int as x from tot t cross join (select unnest([1, 5, 10, 100]) as k) left join j2 using (query_id)),
per as (select query_id, n_rel, k, coalesce(sum(x / log2(rank + 1)), 0) as dcg, coalesce(sum(x * so_far / rank), 0) as ap, coalesce(sum(x), 0) as found, coalesce(1.0::double / min(rank) filter (x = 1), 0) as rr from ats group by all),
i as (select *, (select sum(1 / log2(g + 1)) from generate_series(1, 1000) s(g) where g <= least(n_rel, k)) as ideal from per)"""


@query("E20", f"""with {_PER}, sc as (select coalesce(question_type, 'unknown') as subset, count(distinct query_id) as n, round(avg(dcg / ideal), 4) as main_score from i join questions using (query_id) where k = 10 group by 1)
select * from sc union all select 'all', sum(n)::bigint, round(avg(main_score) + 1e-9, 4) from sc""")
def e20(spark, d):
    q = questions(spark, d)
    qrels = q.join(chunks(spark, d), F.col("article_no") == F.col("gt_article")).where(E.relevant()).select("query_id", "doc_id")
    run = index(spark, d).search(q).select("query_id", "doc_id", F.col("bm25_rank").alias("rank"))
    return E.main_scores(run, qrels, q.select("query_id", F.coalesce("question_type", F.lit("unknown")).alias("subset")))


for _name in ("E14",):

    @query(_name, f"""with {_REL}, qr as (select query_id, doc_id from questions join chunks on article_no = gt_article where len(gt_clauses) = 0 or list_has_any(clause_nos, gt_clauses)),
tot as (select query_id, count(*) as n_rel from qr group by 1), j2 as (select *, sum(rel) over (partition by query_id order by rank) as so_far from judged),
ats as (select t.query_id, n_rel, k, rank, so_far, rel * (rank <= k)::int as x from tot t cross join (select unnest([1, 5, 10, 100]) as k) left join j2 using (query_id)),
per as (select query_id, n_rel, k, coalesce(sum(x / log2(rank + 1)), 0) as dcg, coalesce(sum(x * so_far / rank), 0) as ap, coalesce(sum(x), 0) as found, coalesce(1.0::double / min(rank) filter (x = 1), 0) as rr from ats group by all),
i as (select *, (select sum(1 / log2(g + 1)) from generate_series(1, 1000) s(g) where g <= least(n_rel, k)) as ideal from per)
select k, round(avg(dcg / ideal), 4) as ndcg, round(avg(ap / n_rel), 4) as map, round(avg(found::double / n_rel), 4) as recall, round(avg(found::double / k), 4) as "precision", round(avg(rr), 4) as mrr from i group by k""")
    def e14(spark, d):
        qrels = questions(spark, d).join(chunks(spark, d), F.col("article_no") == F.col("gt_article")).where(E.relevant()).select("query_id", "doc_id")
        run = index(spark, d).search(questions(spark, d)).select("query_id", "doc_id", F.col("bm25_rank").alias("rank"))
        return E.ir_metrics(run, qrels, [1, 5, 10, 100])


# Reports and increments over the event log: user_id stands for a case, ts for the time of writing.
# Sessions: documents stand for them. Their configurations have the sixteen settings that count; lists in any order, nulls and empty texts alike.
_CONFIG = """to_json({{'eval_file': lang || '.json', 'retriever_mode': 'hybrid', 'advanced_method': case when {0} % 2 = 0 then '' end, 'preprocessing': case when {0} % 3 = 0 then ['b', 'a'] else ['a', 'b'] end, 'postprocessing': ['crag'], 'llm_service': 'x', 'llm_model': source,
    'sub_llm_service': null, 'sub_llm_model': '', 'ragas_service': 'judge' || ({0} % 4), 'skip_ragas': {0} % 8 < 6, 'limit': 10, 'random_sample': false, 'seed': 42, 'top_k': 5, 'collection_name': 'c', 'noise': {0}}})"""
_SPARK_CONFIG = """to_json(named_struct('eval_file', concat(lang, '.json'), 'retriever_mode', 'hybrid', 'advanced_method', case when {0} % 2 = 0 then '' end, 'preprocessing', case when {0} % 3 = 0 then array('b', 'a') else array('a', 'b') end, 'postprocessing', array('crag'), 'llm_service', 'x', 'llm_model', source,
    'sub_llm_service', cast(null as string), 'sub_llm_model', '', 'ragas_service', concat('judge', {0} % 4), 'skip_ragas', {0} % 8 < 6, 'limit', 10, 'random_sample', false, 'seed', 42, 'top_k', 5, 'collection_name', 'c', 'noise', {0}))"""


def _sessions(spark, d):
    return table(spark, d, "documents").selectExpr("doc_id as session", "n_chars as written", "concat(lang, '_', source) as signature", f"{_SPARK_CONFIG.format('doc_id')} as config", "cast(doc_id % 5 as bigint) as n_done")


@query("J15", "select lang, source, case when doc_id % 8 < 6 then '' else 'judge' || (doc_id % 4) end as judge, doc_id % 8 < 6 as skipped, count(*) as sessions from documents group by all")
def j15(spark, d):
    """Sessions of one critical configuration, counted by its fingerprint."""
    s = _sessions(spark, d).withColumn("print", fingerprint(F.parse_json("config")))
    same = s.groupBy("print").agg(F.count("*").alias("sessions"), F.min("session").alias("doc_id"))
    skipped = F.col("doc_id") % 8 < 6
    return same.join(table(spark, d, "documents"), "doc_id").select("lang", "source", F.when(skipped, "").otherwise(F.concat(F.lit("judge"), F.col("doc_id") % 4)).alias("judge"), skipped.alias("skipped"), "sessions")


@query("T02", f"""with s as (select doc_id as session, n_chars as written, lang || '_' || source as signature, lang || source || case when doc_id % 8 < 6 then '' else cast(doc_id % 4 as varchar) end || (doc_id % 8 < 6) as fp, doc_id % 5 as n_done from documents),
o as (select * from (select *, row_number() over (order by written desc, session) as age, row_number() over (partition by signature order by written desc, session desc) as own from s)),
r as (select doc_id as run, lang || '_' || source as asked, lang || source || case when doc_id % 8 < 6 then '' else cast(doc_id % 4 as varchar) end || (doc_id % 8 < 6) as fp from documents),
m as (select run, session, case when signature = asked and own = 1 then 0 else age end as age from r join o using (fp) where n_done > 0 and (age <= 20 or signature = asked and own = 1))
select run, min_by(session, age) as session from m group by run""")
def t02(spark, d):
    runs = table(spark, d, "documents").selectExpr("doc_id as run", "concat(lang, '_', source) as signature", f"{_SPARK_CONFIG.format('doc_id')} as config")
    return resumable(_sessions(spark, d), runs)


@query("S23", """with s as (select doc_id as session, n_chars as written, lang || '_' || source as signature from documents), w as (select distinct signature from s union all select 'none')
select w.signature, coalesce((select max_by(session, (written, -session)) from s where s.signature = w.signature), (select max_by(session, (written, -session)) from s)) as session from w""")
def s23(spark, d):
    """The newest report of each signature, or of all where it has none."""
    reports = _sessions(spark, d)
    asked = reports.select("signature").distinct().unionByName(spark.createDataFrame([("none",)], "signature string"))
    return store.latest_reports(reports, asked)


@query("S23_users", "select user_id, event_id, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1")
def s23_users(spark, d):
    rows = table(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    return latest(rows, "user_id", "at").select("user_id", "event_id", "value")


for _name in ("S22", "T03"):

    @query(_name, f"with {_JUDGED} select event_id, case when event_id % 3 = 0 and (a is null or isnan(a)) then 1.0 else case when isnan(a) then null else a end end as a from j")
    def s22(spark, d):
        rows = judged(spark, d).select(F.col("event_id").alias("query_id"), F.nanvl("a", F.lit(None).cast("double")).alias("a"), "b")
        batch = rows.where("query_id % 3 = 0 and a is null").select("query_id", F.lit(1.0).alias("a"))
        return E.patch(rows, batch, ["a"]).select(F.col("query_id").alias("event_id"), "a")


@query("T04", f"with {_JUDGED} select event_id, coalesce(case when isnan(a) then null else a end, case when event_id % 2 = 0 then value * 3 end) as a, coalesce(b, case when event_id % 2 = 0 then value end) as b from j join (select event_id, value from events) using (event_id)")
def t04(spark, d):
    rows = judged(spark, d).select(F.col("event_id").alias("query_id"), "a", "b")
    computed = table(spark, d, "events").where("event_id % 2 = 0").select(F.col("event_id").alias("query_id"), (F.col("value") * 3).alias("a"), F.col("value").alias("b"))
    return E.backfill(rows, computed, ["a", "b"]).withColumnRenamed("query_id", "event_id")


@query("S19", "select item_id, text from benchmark where item_id % 4 in (0, 2)")
def s19(spark, d):
    from lexiflume.sources.store import eval_cases

    # Files of a few cases each, half of them sets (data), half reports (detailed_results).
    case = F.collect_list(F.struct(F.col("query_id").alias("id"), F.col("query").alias("question"), "question_type"))
    files = questions(spark, d).groupBy(F.floor(F.col("query_id") / 16).alias("file")).agg(case.alias("cases"))
    raw = files.select(F.when(F.col("file") % 2 == 0, F.to_json(F.struct(F.col("cases").alias("data")))).otherwise(F.to_json(F.struct(F.col("cases").alias("detailed_results")))).alias("json"))
    return eval_cases(raw, ["factual", "definition"]).select(F.col("id").alias("item_id"), F.col("question").alias("text"))


@query("S29", "select conv_id, case when length(t) > 32 then substr(t, 1, 32) || '...' else t end as title, n from (select conv_id, min_by(text, turn) as t, count(*) as n from conversations group by conv_id)")
def s29(spark, d):
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("t"), F.count("*").alias("n"))
    return g.select("conv_id", F.when(F.length("t") > 32, F.concat(F.substring("t", 1, 32), F.lit("..."))).otherwise(F.col("t")).alias("title"), "n")
