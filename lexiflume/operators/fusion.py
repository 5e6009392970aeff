"""Rank fusion, reranking, filters with relaxation, reference expansion, context assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexiflume.config import DEFAULTS


def reciprocal(rank: Column, k: int = DEFAULTS.rrf_k, missing: int = DEFAULTS.bm25_candidates) -> Column:
    """1 / (k + 1-based rank); a missing rank counts as ``missing``."""
    return 1.0 / (k + F.coalesce(rank, F.lit(missing)))


def hybrid(hits: DataFrame, dense: DataFrame, limit: int = DEFAULTS.dense_candidates) -> DataFrame:
    """hits (query_id, doc_id, bm25_rank) with dense scores (query_id, doc_id, dense_score; absent: 0.5): dense_rank among the
    hits (ties keep BM25 order), rrf and the best ``limit`` by it (R01)."""
    scored = hits.join(dense, ["query_id", "doc_id"], "left").withColumn("dense_score", F.round(F.coalesce("dense_score", F.lit(DEFAULTS.missing_score)), 4))
    by = Window.partitionBy("query_id")
    ranked = scored.withColumn("dense_rank", F.row_number().over(by.orderBy(F.desc("dense_score"), "bm25_rank")))
    fused = ranked.withColumn("rrf", reciprocal(F.col("bm25_rank")) + reciprocal(F.col("dense_rank")))
    return fused.withColumn("rank", F.row_number().over(by.orderBy(F.round("rrf", 10).desc(), "bm25_rank"))).where(F.col("rank") <= limit)


def rerank(hits: DataFrame, k: int = DEFAULTS.rerank_limit) -> DataFrame:
    """Sorted by rerank_score, then dense_score, nulls last, then the rank before; k <= 0 gives none."""
    by = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), F.desc_nulls_last("dense_score"), "rank")
    return hits.withColumn("final_rank", F.row_number().over(by)).where(F.col("final_rank") <= k)


def fuse_variants(hits: DataFrame, k: int = DEFAULTS.rrf_k, top_k: int | None = None) -> DataFrame:
    """hits (query_id, variant, weight, doc_id, rank0): weighted sum of 1 / (rank0 + k), first-seen order on ties."""
    first = F.min(F.struct("variant", "rank0")).alias("seen")
    fused = hits.groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") / (F.col("rank0") + k)).alias("score"), first)
    by = Window.partitionBy("query_id").orderBy(F.round("score", 10).desc(), "seen", "doc_id")
    out = fused.withColumn("rank", F.row_number().over(by)).drop("seen")
    return out if top_k is None else out.where(F.col("rank") <= top_k)


def matches_filter(article: str = "f_article", clauses: str = "f_clauses") -> Column:
    """Metadata filter (F01, F03): absent values are ignored, and each clause asked for must be there."""
    every = F.forall(F.coalesce(F.col(clauses), F.array().cast("array<int>")), lambda c: F.array_contains("clause_nos", c))
    return (F.col(article).isNull() | (F.col("article_no") == F.col(article))) & every


def relaxed(pairs: DataFrame, matched: Column) -> DataFrame:
    """Keeps the pairs that match; queries without any match keep all their pairs and are marked."""
    some = F.max(matched.cast("int")).over(Window.partitionBy("query_id"))
    out = pairs.withColumn("filter_relaxed", some == 0).withColumn("matched", matched)
    return out.where("matched or filter_relaxed").drop("matched")


def expand_references(selected: DataFrame, chunks: DataFrame, per_article: int = DEFAULTS.chunks_per_article) -> DataFrame:
    """selected (query_id, rank, chunk_id, ref_article_nos): chunks of the articles they cite, first-cited first, at most
    ``per_article`` of each, without those selected (J04). Returns query_id, chunk_id, article_no, position."""
    cited = selected.select("query_id", "rank", F.posexplode("ref_article_nos").alias("pos", "article_no"))
    order = cited.groupBy("query_id", "article_no").agg(F.min(F.struct("rank", "pos")).alias("first"))
    numbered = chunks.select("chunk_id", "article_no", F.row_number().over(Window.partitionBy("article_no").orderBy("doc_id")).alias("n")).where(F.col("n") <= per_article)
    found = order.join(numbered, "article_no").join(selected.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    by = Window.partitionBy("query_id").orderBy("first", "article_no", "n")
    return found.withColumn("position", F.row_number().over(by)).select("query_id", "chunk_id", "article_no", "position")


#: Fixed value: what follows a block that was cut.
CUT = "\n[đã rút gọn]"


def context(blocks: DataFrame, limit: int = DEFAULTS.max_context_chars, marker: str = CUT) -> DataFrame:
    """blocks (query_id, position, block) joined by blank lines up to ``limit`` characters, marker included; the first that goes over is
    cut, if the marker and more fit, and later ones are left out (W05, R04)."""
    upto = Window.partitionBy("query_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    run = blocks.withColumn("ends", F.sum(F.length("block") + 2).over(upto) - 2).withColumn("starts", F.col("ends") - F.length("block"))
    kept = run.where((F.col("ends") <= limit) | (F.col("starts") < limit - len(marker)))
    cut = F.rtrim(F.expr(f"substring(block, 1, cast({limit - len(marker)} - starts as int))"), F.lit(" \t\n\x0b\x0c\r"))
    text = F.when(F.col("ends") <= limit, F.col("block")).otherwise(F.concat(cut, F.lit(marker)))
    parts = kept.select("query_id", F.struct("position", text.alias("text")).alias("p"))
    return parts.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["text"]), "\n\n").alias("context"), F.count("*").alias("n_blocks"))
