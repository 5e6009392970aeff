"""The stored index of the chunk view."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lexiflume.operators.bm25 import Bm25Index
from lexiflume.sources.tables import FIELDS, indexed


def index(spark: SparkSession, sf_dir: str) -> Bm25Index:
    return Bm25Index.stored(spark, f"{sf_dir}/documents.parquet", indexed, FIELDS)
