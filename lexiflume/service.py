"""Facade of the service calls, without HTTP: health, query, evaluation info, run and latest report; NLI predictions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexiflume.operators.generation import answers, first_sentence
from lexiflume.plans.evaluation import METRICS, EvalJob
from lexiflume.plans.retrieval import Retriever
from lexiflume.providers import DEFAULT, Providers, nli
from lexiflume.sources.reports import ReportWriter, read_report
from lexiflume.sources.store import exists


def checked(providers: Providers, default: Providers = DEFAULT) -> Providers:
    """The providers if their probe answers, else the default ones; a probe that fails counts as no."""
    try:
        return providers if providers.available() else default
    except Exception:
        return default


@dataclass
class Service:
    """Calls over one retriever."""

    retriever: Retriever
    folder: str
    generate: Callable[[str], str] = first_sentence

    def health(self, spark: SparkSession) -> DataFrame:
        """component, ok."""
        parts = [("index", self.retriever.index.corpus.limit(1).count() == 1), ("reports", exists(spark, self.folder)), ("providers", checked(self.retriever.providers) is self.retriever.providers)]
        return spark.createDataFrame(parts, "component string, ok boolean")

    def query(self, queries: DataFrame) -> DataFrame:
        """query_id, selected, answer, failed, latency_ms for all queries at once."""
        found = self.retriever.retrieve(queries)
        return answers(found.select("query_id", "selected", "prompt"), self.generate).drop("prompt")

    def eval_info(self, questions: DataFrame) -> DataFrame:
        """question_type, n of an evaluation set."""
        return questions.groupBy(F.coalesce("question_type", F.lit("unknown")).alias("question_type")).agg(F.count("*").alias("n"))

    def eval_run(self, questions: DataFrame, signature: str, stamp: str) -> tuple[str, str]:
        """Runs the questions and writes the report; the paths of its two files."""
        spark = questions.sparkSession
        report = ReportWriter(spark, self.folder, signature, stamp, questions.count(), METRICS)
        report.init()
        rows = EvalJob(self.retriever).run(questions)
        report.append(rows.withColumn("id", F.col("query_id")).withColumn("at", F.lit(1)), "at")
        return report.finalize()

    def eval_latest(self, spark: SparkSession, signature: str) -> DataFrame:
        """The newest report of the signature; FileNotFoundError if there is none."""
        path = f"{self.folder}/eval_latest_{signature}.json"
        if not exists(spark, path):
            raise FileNotFoundError(path)
        return read_report(spark, path)

    def config(self) -> dict:
        return asdict(self.retriever.config)


@dataclass
class NliService:
    """Predictions for question and context pairs."""

    judge: Callable[[Column, Column], Column] = nli

    def predict(self, pairs: DataFrame) -> DataFrame:
        """pairs (question, context, ...) with label, confidence, probabilities."""
        return pairs.withColumn("_p", self.judge(F.col("question"), F.col("context"))).select(*pairs.columns, "_p.*")

    def evaluate(self, pairs: DataFrame) -> DataFrame:
        """pairs (question, context, label 0/1): the classification metrics."""
        from lexiflume.operators.evaluation import classification

        found = self.predict(pairs.withColumnRenamed("label", "truth"))
        return classification(found.select("truth", (F.col("label") == "entailment").cast("int").alias("predicted")))
