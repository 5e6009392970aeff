"""Embedders in plain DataFrame operations: hashed token counts as dense vectors, BM25 weights as sparse ones."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from lexiflume.config import DEFAULTS
from lexiflume.functions.text import tokens
from lexiflume.operators.bm25 import Bm25Index

DIM = 64
#: Texts whose tokens a task adds up at once.
ROWS = 1000


def _md5_cells(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The cell and the sign that the MD5 of each word names."""
    digests = [hashlib.md5(w.encode()).digest() for w in words]
    return np.array([d[1] % DIM for d in digests], np.int64), np.array([1 - 2 * (d[3] % 2) for d in digests], np.int64)


def hashed_sums(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lists of tokens: for each list the sum of each cell, and how many tokens it has. Runs inside tasks; a word of a batch is hashed once."""
    counts = pc.list_value_length(tokens).fill_null(0).to_numpy()
    flat = tokens.flatten()
    flat = (pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat).dictionary_encode()
    dims, signs = _md5_cells(flat.dictionary.to_pylist())
    word = flat.indices.to_numpy()
    cell = np.repeat(np.arange(len(counts)), counts) * DIM + dims[word]
    size = len(counts) * DIM
    sums, seen = (np.bincount(cell, w, minlength=size).astype(np.int64).reshape(-1, DIM) for w in (signs[word], None))
    return sums, seen


def hashed_cells(texts: DataFrame, prefix: str = "") -> DataFrame:
    """texts (id, text): id, dim, value; each token adds +1 or -1 to the cell that its MD5 names. prefix is the
    instruction that a model would want before each text (V10, V13). Cells of a text are added up before they are shuffled."""

    def cells(batches):
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                few = b.slice(at, ROWS)
                sums, seen = hashed_sums(few.column("words"))
                row, dim = np.nonzero(seen)
                yield pa.RecordBatch.from_arrays([few.column("id").take(pa.array(row)), pa.array(dim.astype(np.int32)), pa.array(sums[row, dim])], ["id", "dim", "value"])

    words = texts.select("id", tokens(F.concat(F.lit(prefix), "text")).alias("words"))
    made = words.mapInArrow(cells, T.StructType([words.schema["id"], T.StructField("dim", T.IntegerType()), T.StructField("value", T.LongType())]))
    return made.groupBy("id", "dim").agg(F.sum("value").alias("value"))


def hashed_vectors(texts: DataFrame, prefix: str = "") -> DataFrame:
    """id, embedding of DIM doubles; texts without tokens have none."""
    cells = hashed_cells(texts, prefix).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("dim", F.col("value").cast("double")))).alias("m"))
    return cells.select("id", F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("embedding"))


def sparse_weights(index: Bm25Index, k1: float = DEFAULTS.k1, b: float = DEFAULTS.b) -> DataFrame:
    """doc_id, term, weight: what a term of a document adds to a BM25 score."""
    rows = index.postings.join(index.terms.select("term", "idf"), "term").join(index.documents.select("doc_id", "dl"), "doc_id").crossJoin(F.broadcast(index.corpus))  # one row
    norm = F.when(F.col("avgdl") > 0, F.col("dl") / F.col("avgdl")).otherwise(F.col("dl").cast("double"))
    return rows.select("doc_id", "term", (F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * norm))).alias("weight"))
