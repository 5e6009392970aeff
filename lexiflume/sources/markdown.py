"""Raw Markdown files as documents, chunked and persisted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexiflume.functions.text import chunk_id, clause_numbers
from lexiflume.operators.chunking import clause_pack, header_split
from lexiflume.sources.store import load_chunks, save_chunks


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file's path), text: one row for each file."""
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.regexp_replace("value", r"\n\z", "").alias("text"))


def chunked(docs: DataFrame, literal: bool = False) -> DataFrame:
    """Chunks of Markdown documents: by headers, then by clause lines up to the chunk size. literal: see header_split."""
    parts = header_split(docs, literal=literal).select("doc_id", "source", "chapter", "section", "article", F.explode(clause_pack("content")).alias("content"))
    number = F.regexp_extract("article", r"(\d+)", 1)
    return parts.select(chunk_id(F.coalesce("article", F.lit("no_article")), "content").alias("chunk_id"), "content", "source", "chapter", "section", "article", F.when(number != "", number.cast("int")).alias("article_no"), clause_numbers("content").alias("clause_nos"))


def chunk_and_save(spark: SparkSession, source: str, target: str, literal: bool = False) -> DataFrame:
    """Reads Markdown files, writes their chunks as JSON lines and returns them as read back. literal: see header_split."""
    save_chunks(chunked(read_markdown(spark, source), literal), target)
    return load_chunks(spark, target)
