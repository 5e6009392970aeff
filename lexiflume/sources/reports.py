"""Evaluation reports: cases upserted by id with a running summary, written under two names."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lexiflume.operators.evaluation import macro_valid
from lexiflume.sources.parts import PartTable, latest


class ReportWriter:
    """A report is JSON lines (kind, id, body): one metadata line, one summary line, a line for each case. Each write goes to
    eval_report_{stamp}.json and eval_latest_{signature}.json. While it is in progress these hold the first two lines only, and the cases lie in a table of
    their own, of which a batch touches its parts; the end writes all."""

    def __init__(self, spark: SparkSession, folder: str, signature: str, stamp: str, total: int, metrics: list[str], judge: tuple[str, ...] = (), configuration: dict | None = None):
        self.configuration = configuration or {}
        self.spark, self.folder, self.signature, self.stamp, self.total = spark, folder.rstrip("/"), signature, stamp, total
        self.metrics, self.judge = metrics, judge
        self.cases = PartTable(spark, f"{self.folder}/cases_{stamp}")

    @property
    def paths(self) -> tuple[str, str]:
        return f"{self.folder}/eval_report_{self.stamp}.json", f"{self.folder}/eval_latest_{self.signature}.json"

    def summary(self) -> DataFrame:
        """n and the mean of each metric over the cases so far; one row."""
        cases = self.cases.read()
        if cases is None:
            cases = self.spark.createDataFrame([], "id long, " + ", ".join(f"{m} double" for m in self.metrics))
        return macro_valid(cases, self.metrics, self.judge)

    def _write(self, status: str, with_cases: bool = False) -> None:
        done = self.summary().first().asDict()
        lines = [("metadata", None, json.dumps({"status": status, "pipeline_signature": self.signature, "total_questions": self.total, "completed_questions": done["n"], "report_filename": self.paths[0].rsplit("/", 1)[1], "latest_filename": self.paths[1].rsplit("/", 1)[1], "configuration": self.configuration}))]
        lines.append(("summary", None, json.dumps({"status": status, "completed_count": done.pop("n"), "total_count": self.total} | done)))
        rows = self.spark.createDataFrame(lines, "kind string, id string, body string").coalesce(1)
        cases = self.cases.read()
        if with_cases and cases is not None:
            rows = rows.unionByName(cases.select(F.lit("case").alias("kind"), F.col("id").cast("string").alias("id"), F.to_json(F.struct("*")).alias("body")))
        for path in self.paths:
            rows.write.mode("overwrite").json(path)

    def init(self) -> None:
        self._write("in_progress")

    def append(self, cases: DataFrame, order: str) -> None:
        """Cases (id, metrics, ...) replace those with their id; retrieved_payloads are not kept."""
        self.cases.upsert(cases.drop("retrieved_payloads"), "id", order)
        self._write("in_progress")

    def finalize(self) -> tuple[str, str]:
        self._write("completed", True)
        return self.paths


# Settings that two runs must share for one to go on where the other ended.
CRITICAL = (
    "eval_file", "retriever_mode", "advanced_method", "preprocessing", "postprocessing", "llm_service", "llm_model", "sub_llm_service", "sub_llm_model", "ragas_service",
    "skip_ragas", "limit", "random_sample", "seed", "top_k", "collection_name",
)


def fingerprint(config: Column) -> Column:
    """What the critical settings of a configuration (variant) say, as one text: lists by their sorted items, null as empty; the judge's service does not
    count where judging is skipped. Equal fingerprints are one session (J15). Two configurations of which one skips judging differ in that setting anyway."""
    text = lambda k: F.coalesce(F.try_variant_get(config, f"$.{k}", "string"), F.lit(""))
    items = lambda k: F.try_variant_get(config, f"$.{k}", "array<string>")
    value = lambda k: F.when(items(k).isNotNull(), F.concat(F.lit("["), F.array_join(F.array_sort(items(k)), "\u0001"), F.lit("]"))).otherwise(text(k))
    parts = [F.when(text("skip_ragas") == "true", F.lit("")).otherwise(value(k)) if k == "ragas_service" else value(k) for k in CRITICAL]
    return F.concat_ws("\u0002", *parts)


def resumable(sessions: DataFrame, wanted: DataFrame, most: int = 20) -> DataFrame:
    """sessions (session, written, signature, config, n_done) and wanted (run, signature, config; configs as JSON texts): for each run the session that it can go on with:
    of those with its fingerprint and some case done, the one with its signature, else the newest; only each signature's newest and the ``most`` newest sessions
    are looked at. Returns run, session (T02)."""
    by_age = Window.orderBy(F.desc("written"), "session")
    newest = sessions.orderBy(F.desc("written"), "session").limit(most).withColumn("age", F.row_number().over(by_age))  # at most so many rows
    own = latest(sessions.withColumn("_o", F.struct("written", "session")), "signature", "_o").drop("_o")
    made = lambda df: df.withColumn("print", fingerprint(F.parse_json("config")))
    runs = made(wanted).select("run", F.col("signature").alias("asked"), "print")
    of_signature = made(own).where("n_done > 0").withColumnRenamed("print", "p").join(runs, (F.col("asked") == F.col("signature")) & (F.col("print") == F.col("p"))).select("run", "session", F.lit(0).alias("age"))
    others = made(newest).where("n_done > 0").withColumnRenamed("print", "p").join(runs, F.col("print") == F.col("p")).select("run", "session", "age")
    return of_signature.unionByName(others).groupBy("run").agg(F.min_by("session", "age").alias("session"))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("kind string, id string, body string").json(path)
