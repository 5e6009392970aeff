"""Retrieval and answer evaluation: relevance, per-query metrics, summaries, resume and report tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F


def relevant(article: str = "article_no", clauses: str = "clause_nos") -> Column:
    """Same article and, if the truth names clauses, one in common."""
    return (F.col(article) == F.col("gt_article")) & ((F.size("gt_clauses") == 0) | F.arrays_overlap(clauses, "gt_clauses"))


def retrieval_metrics(judged: DataFrame) -> DataFrame:
    """judged (query_id, rank, rel 0/1): hit, mrr, precision over the returned, ndcg against the same list sorted."""
    rel = F.col("rel")
    n_rel = F.sum("rel")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(n_rel, F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return judged.groupBy("query_id").agg(
        F.max("rel").alias("hit"),
        F.round(F.coalesce(1 / F.min(F.when(rel == 1, F.col("rank"))), F.lit(0.0)), 4).alias("mrr"),
        F.round(F.avg("rel"), 4).alias("precision"),
        F.round(F.when(n_rel > 0, F.sum(rel / F.log2(F.col("rank") + 1.0)) / ideal).otherwise(0.0), 4).alias("ndcg"),
    )


def recall_of_items(truth: DataFrame, found: DataFrame, on: Column) -> DataFrame:
    """truth (query_id, gt_i, ...): share of a query's truth items that some found row matches."""
    matched = truth.join(found, on, "left_semi")
    return truth.groupBy("query_id").agg(F.count("*").alias("n")).join(matched.groupBy("query_id").agg(F.count("*").alias("m")), "query_id", "left").select("query_id", F.round(F.coalesce("m", F.lit(0)) / F.col("n"), 4).alias("recall"))


def _share(m: str) -> Column:
    """Mean with absent values as 0; ties of the rounding go up whatever order the sum took."""
    return F.round(F.sum(F.coalesce(F.col(m), F.lit(0.0))) / F.count("*") + 1e-9, 4)


def macro_all(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Means over all rows, of values rounded before (A03); an absent value counts as 0."""
    return rows.agg(F.count("*").alias("n"), *[_share(m).alias(f"avg_{m}") for m in metrics])


def macro_valid(rows: DataFrame, metrics: list[str], judge: tuple[str, ...] = ()) -> DataFrame:
    """Means over present values that are no NaN (A05, A06); none gives 0, or null for judge metrics."""
    mean = lambda m: F.round(F.avg(F.nanvl(F.col(m), F.lit(None).cast("double"))), 4)
    return rows.agg(F.count("*").alias("n"), *[(mean(m) if m in judge else F.coalesce(mean(m), F.lit(0.0))).alias(f"avg_{m}") for m in metrics])


def per_type(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Means by question type (A04); a missing or empty type is unknown."""
    kind = F.coalesce(F.nullif(F.col("question_type"), F.lit("")), F.lit("unknown")).alias("question_type")
    return rows.groupBy(kind).agg(F.count("*").alias("n"), *[_share(m).alias(f"avg_{m}") for m in metrics])


def classification(rows: DataFrame) -> DataFrame:
    """rows (truth, predicted 0/1): accuracy, precision, recall, f1 of class 1, macro f1; 0 where undefined."""
    n = lambda t, p: F.sum(F.when((F.col("truth") == t) & (F.col("predicted") == p), 1).otherwise(0))
    c = rows.agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.expr(f"{a} / nullif({b}, 0)"), F.lit(0.0))
    f1, f0 = ratio("2.0D * tp", "2 * tp + fp + fn"), ratio("2.0D * tn", "2 * tn + fp + fn")
    return c.select("tp", "fp", "fn", "tn", F.round(ratio("1.0D * (tp + tn)", "tp + fp + fn + tn"), 4).alias("accuracy"), F.round(ratio("1.0D * tp", "tp + fp"), 4).alias("precision"), F.round(ratio("1.0D * tp", "tp + fn"), 4).alias("recall"), F.round(f1, 4).alias("f1"), F.round((f1 + f0) / 2, 4).alias("macro_f1"))


def ir_metrics(run: DataFrame, qrels: DataFrame, ks: list[int], subsets: DataFrame | None = None) -> DataFrame:
    """run (query_id, doc_id, rank), qrels (query_id, doc_id): ndcg, map, recall, precision, mrr at each k (E14), mean over
    queries that have qrels; with subsets (query_id, subset) for each of these (E20)."""
    total = qrels.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    judged = run.join(qrels.withColumn("rel", F.lit(1)), ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    seen = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    judged = judged.withColumn("so_far", F.sum("rel").over(seen))
    at = total.select("query_id", "n_rel", F.explode(F.array(*map(F.lit, ks))).alias("k")).join(judged, "query_id", "left")
    inside = F.col("rel") * (F.col("rank") <= F.col("k")).cast("int")
    per = at.groupBy("query_id", "n_rel", "k").agg(
        F.coalesce(F.sum(inside / F.log2(F.col("rank") + 1.0)), F.lit(0.0)).alias("dcg"),
        F.coalesce(F.sum(inside * F.col("so_far") / F.col("rank")), F.lit(0.0)).alias("ap"),
        F.coalesce(F.sum(inside), F.lit(0)).alias("found"),
        F.coalesce(1 / F.min(F.when(inside == 1, F.col("rank"))), F.lit(0.0)).alias("rr"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_rel", "k").cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    mean = lambda c, name: F.round(F.avg(c), 4).alias(name)
    if subsets is not None:
        per = per.join(subsets, "query_id")
    return per.groupBy(*(["k"] if subsets is None else ["subset", "k"])).agg(mean(F.col("dcg") / ideal, "ndcg"), mean(F.col("ap") / F.col("n_rel"), "map"), mean(F.col("found") / F.col("n_rel"), "recall"), mean(F.col("found") / F.col("k"), "precision"), mean(F.col("rr"), "mrr"))


def main_scores(run: DataFrame, qrels: DataFrame, subsets: DataFrame, k: int = 10) -> DataFrame:
    """subset, n (queries with qrels), main_score: ndcg at k of each subset, and of all as the mean of the subsets' (E20)."""
    each = ir_metrics(run, qrels, [k], subsets).select("subset", F.col("ndcg").alias("main_score"))
    n = qrels.select("query_id").distinct().join(subsets, "query_id").groupBy("subset").agg(F.count("*").alias("n"))
    each = each.join(n, "subset").select("subset", "n", "main_score")
    return each.unionByName(each.agg(F.lit("all").alias("subset"), F.sum("n").alias("n"), F.round(F.avg("main_score") + 1e-9, 4).alias("main_score")))


def kernel_density(values: DataFrame, column: str, points: int = 20) -> DataFrame:
    """x, density of a Gaussian kernel estimate at evenly spaced points from the least to the greatest value, bandwidth by Scott's rule (A15). Equal values are added up
    first; no spread gives no rows."""
    counted = values.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    whole = values.select(F.col(column).cast("double").alias("v")).agg(F.count("v").alias("total"), F.stddev_samp("v").alias("sd"), F.min("v").alias("low"), F.max("v").alias("high"))  # one row
    grid = whole.where("sd > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"), (F.col("sd") * F.pow(F.col("total").cast("double"), F.lit(-0.2))).alias("h"))
    grid = grid.withColumn("x", F.col("low") + F.col("i") * (F.col("high") - F.col("low")) / (points - 1))
    bumps = counted.crossJoin(F.broadcast(grid))  # so many points
    return bumps.groupBy("i").agg(F.first("x").alias("x"), (F.sum(F.col("n") * F.exp(-F.pow((F.col("x") - F.col("v")) / F.col("h"), F.lit(2)) / 2)) / F.first(F.col("total") * F.col("h")) / F.lit((2 * math.pi) ** 0.5)).alias("density")).drop("i")


def pending(questions: DataFrame, done: DataFrame) -> DataFrame:
    """Questions without a result."""
    return questions.join(done.select("query_id"), "query_id", "left_anti")


def patch(rows: DataFrame, batch: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with the given columns replaced by the batch's where it has the id."""
    new = batch.select("query_id", *[F.col(c).alias(f"__{c}") for c in columns])
    out = rows.join(new.withColumn("__hit", F.lit(True)), "query_id", "left")
    return out.select("query_id", *[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns if c != "query_id"])


def backfill(rows: DataFrame, computed: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with the given columns filled from the computed ones where they are absent or NaN (T04); what is there stays."""
    new = computed.select("query_id", *[F.col(c).alias(f"_{c}") for c in columns])
    there = lambda c: F.nanvl(F.col(c), F.lit(None).cast("double"))
    out = rows.join(new, "query_id", "left")
    return out.select(*[F.coalesce(there(c), F.col(f"_{c}")).alias(c) if c in columns else F.col(c) for c in rows.columns])
