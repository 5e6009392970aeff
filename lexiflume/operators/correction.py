"""Filter-then-rerank, corrective retrieval, knowledge refinement, compression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexiflume.config import DEFAULTS


def trichotomy(score: Column, high: float, low: float, names: tuple[str, str, str]) -> Column:
    """names: at least high, at most low, between."""
    return F.when(score >= high, names[0]).when(score <= low, names[1]).otherwise(names[2])


def choice_score(p_yes: Column, p_no: Column, floor: float = 0.25) -> Column:
    """Yes-probability among yes and no; 0.5 where the two cover too little."""
    both = p_yes + p_no
    return F.when(both < floor, F.lit(0.5)).otherwise(p_yes / both)


def screened(hits: DataFrame, tau_high: float = DEFAULTS.tau_high, tau_low: float = DEFAULTS.tau_low, n_rescued: int = DEFAULTS.choices) -> DataFrame:
    """hits (query_id, chunk_id, rank, score) with kind keep or hard, without those to drop; if all of a query's would go the best stay as hard ones
    (K07). place: of a hard one among its query's, from 0, in the order of the hits (of those rescued by score)."""
    kind = trichotomy(F.col("score"), tau_high, tau_low, ("keep", "drop", "hard"))
    per = Window.partitionBy("query_id")
    marked = hits.withColumn("kind", kind).withColumn("left", F.count(F.when(F.col("kind") != "drop", 1)).over(per))
    best = F.row_number().over(per.orderBy(F.desc("score"), "rank"))
    rescued = marked.withColumn("best", best).withColumn("kind", F.when((F.col("left") == 0) & (F.col("best") <= n_rescued), "hard").otherwise(F.col("kind"))).where("kind <> 'drop'")
    place = F.row_number().over(Window.partitionBy("query_id", "kind").orderBy(F.when(F.col("left") == 0, F.col("best")).otherwise(F.col("rank")), "rank")) - 1
    return rescued.withColumn("place", F.when(F.col("kind") == "hard", place)).drop("left", "best")


def merged(hits: DataFrame, top_k: int = DEFAULTS.rerank_limit, n_choices: int = DEFAULTS.choices) -> DataFrame:
    """Screened hits with choice (0-based place in the reranker's choice, null if not chosen) by final_score: those kept have their score, of the hard
    ones the first n_choices get 0.95 - 0.10 * choice, or max(0.10, 0.4 * score), the others 0.3 * score (W04, K06)."""
    chosen = F.when(F.col("choice").isNotNull(), 0.95 - 0.10 * F.col("choice")).otherwise(F.greatest(F.lit(0.10), F.col("score") * 0.4))
    hard = F.when(F.col("place") < n_choices, chosen).otherwise(F.col("score") * 0.3)
    final = hits.withColumn("final_score", F.round(F.when(F.col("kind") == "hard", hard).otherwise(F.col("score")), 4))
    by = Window.partitionBy("query_id").orderBy(F.desc("final_score"), F.desc("kind"), "rank")  # on ties those kept go first
    return final.withColumn("final_rank", F.row_number().over(by)).where(F.col("final_rank") <= top_k)


def filter_rerank(hits: DataFrame, top_k: int = DEFAULTS.rerank_limit, tau_high: float = DEFAULTS.tau_high, tau_low: float = DEFAULTS.tau_low) -> DataFrame:
    """Screens and merges hits that have their choice already."""
    return merged(screened(hits, tau_high, tau_low), top_k)


def crag(hits: DataFrame, external: DataFrame, upper: float = DEFAULTS.crag_upper, lower: float = DEFAULTS.crag_lower, k: int = DEFAULTS.crag_external) -> DataFrame:
    """hits (query_id, chunk_id, rank, p) and external hits (query_id, chunk_id, rank): action per query is its best label; correct
    and ambiguous keep what is not incorrect, ambiguous adds external hits, incorrect has these only (R11, A14)."""
    label = trichotomy(F.col("p"), upper, lower, ("correct", "incorrect", "ambiguous"))
    level = F.when(label == "correct", 2).when(label == "ambiguous", 1).otherwise(0)
    marked = hits.withColumn("label", label).withColumn("level", level).withColumn("action", F.max("level").over(Window.partitionBy("query_id")))
    inside = marked.where("action > 0 and level > 0").select("query_id", "chunk_id", "rank", "action", F.lit("internal").alias("origin"))
    asked = marked.groupBy("query_id").agg(F.max("action").alias("action")).where("action < 2")
    outside = external.where(F.col("rank") <= k).join(asked, "query_id").select("query_id", "chunk_id", "rank", "action", F.lit("external").alias("origin"))
    names = F.element_at(F.array(*map(F.lit, ("incorrect", "ambiguous", "correct"))), F.col("action") + 1)
    return inside.unionByName(outside).withColumn("action", names)


def keep_strips(strips: DataFrame, threshold: float = DEFAULTS.refine_threshold, top_n: int | None = None) -> DataFrame:
    """strips (id, pos, strip, score): those at the threshold, else the single best; with top_n only the best of them; in
    the order of the text (R12, K08)."""
    per = Window.partitionBy("id")
    ranked = strips.withColumn("good", F.col("score") >= threshold).withColumn("any", F.max(F.col("good").cast("int")).over(per)).withColumn("rn", F.row_number().over(per.orderBy(F.desc("score"), "pos")))
    keep = F.when(F.col("any") == 1, F.col("good")).otherwise(F.col("rn") == 1)
    return ranked.where(keep & (F.lit(True) if top_n is None else F.col("rn") <= top_n)).drop("good", "any", "rn")


def refine(strips: DataFrame, threshold: float = DEFAULTS.refine_threshold) -> DataFrame:
    """id, refined text, num_strips, num_kept; one strip or none stays unchanged."""
    counts = strips.groupBy("id").agg(F.count("*").alias("num_strips"))
    kept = keep_strips(strips, threshold)
    text = kept.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "strip"))), lambda s: s["strip"]), " ").alias("refined"), F.count("*").alias("num_kept"))
    return counts.join(text, "id")


def compress(sentences: DataFrame, target: int = DEFAULTS.compression_target) -> DataFrame:
    """sentences (query_id, pos, sentence, score, n_tokens): best first while the sum of tokens stays within the target (the best always), put
    back in order; with token counts and saving ratio (R14)."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "pos").rowsBetween(Window.unboundedPreceding, 0)
    kept = sentences.withColumn("used", F.sum("n_tokens").over(best)).withColumn("first", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "pos")) == 1).withColumn("in", (F.col("used") <= target) | F.col("first"))
    out = kept.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("in"), F.struct("pos", "sentence")))), lambda s: s["sentence"]), " ").alias("compressed"),
        F.sum("n_tokens").alias("origin_tokens"),
        F.sum(F.when(F.col("in"), F.col("n_tokens")).otherwise(0)).alias("compressed_tokens"),
    )
    return out.withColumn("saving_ratio", F.round(1 - F.col("compressed_tokens") / F.nullif(F.col("origin_tokens"), F.lit(0)), 4))
