"""Evaluation of ranked results and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import rounded


def first_hit_rank(ranked: DataFrame, hit: Column) -> DataFrame:
    return ranked.groupBy("query_id").agg(F.min(F.when(hit, F.col("rank"))).alias("hit_rank"))


def recall_mrr(per_query: DataFrame, ks: tuple[int, ...] = (5, 20, 50, 100)) -> DataFrame:
    """Queries, hits and recall at each k, and mean reciprocal rank, from per-query hit ranks (null: no hit)."""
    n = F.count(F.lit(1))
    cols = [n.alias("n_queries")]
    for k in ks:
        cols += [F.count(F.when(F.col("hit_rank") <= k, 1)).alias(f"hits_at_{k}"), rounded(F.count(F.when(F.col("hit_rank") <= k, 1)) / n, 6).alias(f"recall_at_{k}")]
    return per_query.agg(*cols, rounded(F.coalesce(F.sum(1 / F.col("hit_rank")), F.lit(0.0)) / n, 6).alias("mrr"))


def failure_stages(per_query: DataFrame, top: int = 5) -> DataFrame:
    """Histogram of where a query's truth was lost: per_query(in_corpus, in_union, hit_rank)."""
    stage = F.when(~F.col("in_corpus"), "strict_chunk_absent").when(~F.col("in_union"), "not_in_union").when(F.col("hit_rank").isNull(), "lost_during_fusion").when(F.col("hit_rank") > top, f"lost_during_top{top}").otherwise("hit")
    return per_query.groupBy(stage.alias("stage")).agg(F.count(F.lit(1)).alias("n"))


def improvement(base: Column, new: Column) -> tuple[Column, Column]:
    """Absolute points and relative percent; the latter is null for a zero base."""
    return rounded((new - base) * 100, 4), rounded(F.try_divide((new - base) * 100, base), 4)


def nearest_rank_percentile(value: str, p: float) -> Column:
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")


def reason_histogram(rows: DataFrame, errors: str, status: str) -> DataFrame:
    """Counts of error codes; a row without one counts its status."""
    reasons = F.when(F.size(errors) > 0, F.col(errors)).otherwise(F.array(F.col(status)))
    return rows.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def release_gate(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """metrics(metric, value) against thresholds(metric, op, bound): a check per row; a missing metric fails."""
    both = thresholds.join(metrics, "metric", "left")
    ok = F.when(F.col("op") == ">=", F.col("value") >= F.col("bound")).when(F.col("op") == "<=", F.col("value") <= F.col("bound")).when(F.col("op") == "=", F.col("value") == F.col("bound"))
    return both.select("metric", "op", "bound", "value", F.coalesce(ok, F.lit(False)).alias("passed"))


def load_summary(events: DataFrame) -> DataFrame:
    """Per name and in total: requests, failures, failure percent, average, p95 and p99 of latency."""
    n, failed = F.count(F.lit(1)), F.count(F.when(F.col("failed"), 1))
    agg = (n.alias("requests"), failed.alias("failures"), rounded(failed * 100.0 / n, 4).alias("failure_percent"), rounded(F.avg("latency_ms"), 4).alias("average_ms"), nearest_rank_percentile("latency_ms", 0.95).alias("p95_ms"), nearest_rank_percentile("latency_ms", 0.99).alias("p99_ms"))
    return events.groupBy("name").agg(*agg).unionByName(events.agg(*agg).withColumn("name", F.lit("Aggregated")))


def fact_conflicts(facts: DataFrame, identity: list[str], value: list[str]) -> DataFrame:
    """Identities with more than one distinct value."""
    return facts.groupBy(*identity).agg(F.countDistinct(F.struct(*value)).alias("n_values")).where("n_values > 1")


def token_cost(runs: DataFrame, in_rate: str, out_rate: str) -> DataFrame:
    """Cost of token use per group of a million; null if any use is missing."""
    missing = F.count(F.when(F.col("input_tokens").isNull() | F.col("output_tokens").isNull(), 1))
    total = F.sum(F.col("input_tokens") * F.lit(in_rate).cast("decimal(10,4)") + F.col("output_tokens") * F.lit(out_rate).cast("decimal(10,4)"))
    return runs.groupBy("profile").agg(F.when(missing == 0, F.round(total.cast("double").cast("decimal(38,10)") / F.lit(1000000).cast("decimal(10,0)"), 8).cast("double")).alias("cost"), missing.alias("n_missing"))
