"""The evaluation job: pending questions, retrieval, answers, metrics, judging, summaries and reports, as DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexiflume.config import DEFAULTS, EngineConfig
from lexiflume.functions import metrics as M, text as X
from lexiflume.operators import evaluation as E, generation
from lexiflume.operators.bm25 import Bm25Index
from lexiflume.plans.retrieval import Retriever, prompt
from lexiflume.sources.reports import ReportWriter
from lexiflume.sources.store import kept

METRICS = ["hit", "mrr", "precision", "ndcg"]
ANSWER_METRICS = ["f1", "em", "bleu1", "rouge_l"]
JUDGED = ["faithfulness", "answer_relevancy", "context_precision", "context_recall"]


@dataclass
class Bm25Retriever:
    """The best chunks by BM25 alone, in the shape of Retriever.select."""

    index: Bm25Index
    chunks: DataFrame
    config: EngineConfig = DEFAULTS

    def select(self, queries: DataFrame) -> DataFrame:
        hits = self.index.search(queries, self.config.bm25_candidates)
        return hits.select("query_id", "doc_id", F.col("bm25_rank").alias("final_rank")).join(self.chunks, "doc_id")


@dataclass
class EvalJob:
    """Runs questions (query_id, query, gt_article, gt_clauses, question_type, truth if there is one) through a retriever and a generator of answers (E16, E17). timeout: seconds
    that an answer may take."""

    retriever: Retriever | Bm25Retriever
    generate: Callable[[str], str] = generation.first_sentence
    timeout: float = 180.0

    def config(self, spark: SparkSession) -> DataFrame:
        """The configuration as one row."""
        return spark.createDataFrame([asdict(self.retriever.config)])

    def run(self, questions: DataFrame, done: DataFrame | None = None) -> DataFrame:
        """Metrics per question; with earlier results only for those that have none, joined by the earlier rows."""
        todo = questions if done is None else E.pending(questions, done)
        judged = self.retriever.select(todo).join(todo.drop("query"), "query_id").withColumn("rel", E.relevant().cast("int")).withColumn("rank", F.col("final_rank"))
        rows = E.retrieval_metrics(judged).join(questions.select("query_id", "question_type"), "query_id")
        return rows if done is None else done.select(rows.columns).unionByName(rows)

    def cases(self, questions: DataFrame) -> DataFrame:
        """A row for each question with its contexts (the chunks that the answer is made from), answer and metrics, kept (E16). Where the answer fails, its text is the error and the
        metrics are those of that text; one that takes too long is an error row, whose metrics are 0. A question that nothing is found for has metrics of 0."""
        own = questions if "truth" in questions.columns else questions.withColumn("truth", F.lit(""))
        own = own.withColumn("truth", F.coalesce("truth", F.lit("")))
        content = F.when(F.col("final_rank") <= DEFAULTS.rerank_limit, F.col("content")).alias("content")
        chosen = kept(self.retriever.select(questions).select("query_id", "final_rank", "article_no", "clause_nos", content))
        judged = chosen.drop("content").join(questions.select("query_id", "gt_article", "gt_clauses"), "query_id")
        found = E.retrieval_metrics(judged.withColumn("rel", E.relevant().cast("int")).withColumn("rank", F.col("final_rank")))
        texts = F.transform(F.array_sort(F.collect_list(F.struct("final_rank", "content"))), lambda x: x["content"])
        contexts = chosen.where("content is not null").groupBy("query_id").agg(texts.alias("contexts"))
        rows = own.select("query_id", F.col("query").alias("question"), "question_type", "truth").join(contexts, "query_id", "left").join(found, "query_id", "left")
        rows = rows.withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))
        asked = rows.withColumn("prompt", prompt(F.array_join("contexts", "\n\n"), F.coalesce("question", F.lit(""))))
        answered = kept(generation.answers(asked, generation.limited(self.generate, self.timeout)).drop("prompt"))
        lead = generation.ERROR_ANSWER.split("{}")[0] + generation.TOO_LONG
        late = F.col("failed") & F.col("answer").startswith(lead)
        a, t = X.eval_tokens("answer"), X.eval_tokens("truth")
        of_answer = {"f1": M.token_f1(a, t), "em": M.exact_match("answer", "truth"), "bleu1": M.bleu1(a, t), "rouge_l": M.rouge_l(a, t)}
        values = {m: F.when(late, 0.0).otherwise(F.coalesce(F.col(m).cast("double"), F.lit(0.0))) for m in METRICS}
        values |= {m: F.when(late, 0.0).otherwise(F.round(c, 4)) for m, c in of_answer.items()}
        out = answered.withColumns(values | {"late": late})
        return kept(out.select("query_id", "question", "question_type", "truth", "contexts", "answer", "failed", "late", "latency_ms", *METRICS, *ANSWER_METRICS, *[F.lit(None).cast("double").alias(m) for m in JUDGED]))

    def answer(self, questions: DataFrame, report: ReportWriter) -> None:
        """The first phase: cases of the questions that the report has none for (T02) go into it, batch by batch if called so."""
        done = report.cases.read()
        if done is None:
            report.init()
        todo = questions if done is None else E.pending(questions, done)
        report.append(self.cases(todo).withColumns({"id": F.col("query_id"), "at": F.lit(1)}), "at")

    def full(self, questions: DataFrame, report: ReportWriter, judge: bool = True) -> DataFrame:
        """The whole run (E17): goes on with what the report has, answers the other questions, judges the answers that have no judgement yet unless judge is off, and ends the
        report. Gives all of its cases; summary makes the basic metrics of them."""
        self.answer(questions, report)
        if judge:
            cases = report.cases.read()
            open_ = cases.where(" or ".join(f"{m} is null" for m in JUDGED)).drop(*JUDGED)
            report.append(kept(generation.judged_answers(open_).withColumn("at", F.lit(2)).select(cases.columns)), "at")
        report.finalize()
        return report.cases.read()

    def summary(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Overall means and means by question type."""
        return E.macro_all(rows, METRICS), E.per_type(rows, METRICS)


def formatted(summary: DataFrame) -> str:
    """A summary's few rows as lines of text."""
    rows = [r.asDict() for r in summary.collect()]
    return "\n".join("  ".join(f"{k}={v}" for k, v in r.items()) for r in rows)
