"""From raw documents to packed training sequences: quality rules, near-duplicates, benchmark leaks, personal data, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexiflume.llm import decontamination, packing, pii, quality_rules
from lexiflume.llm.jaccard_join import jaccard_components
from lexiflume.llm.scratch import Scratch, unused

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs, _table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Of each group of documents linked by n-gram Jaccard similarity the one with the least doc_id stays
    (one without an id only if none has one); texts
    without words are in no group. Five-word shingles, similarity of 0.8 or more. Of rows that repeat whole, one stays."""
    found = jaccard_components(docs, k=5, percent=80, scratch=scratch)
    grouped = found.where("node is not null").groupBy("comp_node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("keep")).select("keep.doc_id", "keep.text_hash")
    alone = found.where("node is null").select("doc_id", "text_hash").distinct()
    keep = grouped.union(alone).toDF("keep_id", "keep_hash")
    name = unused("text_hash", docs.columns)
    hashed = docs.withColumn(name, F.xxhash64("text"))
    kept = hashed.join(keep, hashed["doc_id"].eqNullSafe(keep["keep_id"]) & (hashed[name] == keep["keep_hash"]), "left_semi")
    return kept.drop(name).dropDuplicates(["doc_id", "text"])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"), scratch=scratch)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Personal data becomes its kind in brackets; n_chars follows the text."""
    return pii.redact(docs, scratch=scratch).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), scratch=scratch)


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminate), ("PII", redact), ("best-fit packing", pack)]

#: Trained trees and tokenizers have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = _table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with Scratch(spark) as own:  # a stage's own tables go when its result is written
            docs = scratch.keep(f"stage-{i}", stage(spark, docs, sf_dir, own))
        if i:
            scratch.drop(f"stage-{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
