"""Scores of answers against truth, and reports over evaluation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import rounded


def share(hit: Column, of: Column | None = None, digits: int = 6) -> Column:
    """Share of rows with a hit among those in `of` (all); null without any."""
    base = F.count(F.when(of, 1)) if of is not None else F.count(F.lit(1))
    got = F.count(F.when(hit & of if of is not None else hit, 1))
    return rounded(F.try_divide(got.cast("double"), base.cast("double")), digits)


def case_align(candidates: DataFrame, generations: DataFrame, truths: DataFrame) -> DataFrame:
    """Cases that are not exactly once in each of the three tables."""
    parts = None
    for name, rows in (("candidates", candidates), ("generations", generations), ("truths", truths)):
        one = rows.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(name))
        parts = one if parts is None else parts.unionByName(one)
    n = lambda p: F.coalesce(F.sum(F.when(F.col("part") == p, F.col("n"))), F.lit(0)).alias(p)
    return parts.groupBy("case_id").agg(n("candidates"), n("generations"), n("truths")).where("candidates <> 1 or generations <> 1 or truths <> 1")


def answer_metrics(scored: DataFrame) -> DataFrame:
    """scored(profile, should_refuse, answered, correct, citations_valid, provider_error): coverage, precision, refusals, validity."""
    asked = ~F.col("should_refuse")
    return scored.groupBy("profile").agg(
        F.count(F.lit(1)).alias("n"), share(F.col("answered"), asked).alias("coverage"), share(F.col("correct") & asked, F.col("answered")).alias("strict_precision"), share(F.col("citations_valid"), F.col("answered")).alias("citation_validity"),
        share(F.col("should_refuse"), ~F.col("answered")).alias("refusal_precision"), share(~F.col("answered"), F.col("should_refuse")).alias("refusal_recall"), share(F.col("provider_error")).alias("provider_error_rate"),
    )


def subsequence(expected: Column, actual: Column) -> Column:
    """Whether expected occurs in actual in order, gaps allowed."""
    return F.aggregate(actual, F.lit(0), lambda i, x: F.when(F.coalesce(F.get(expected, i) == x, F.lit(False)), i + 1).otherwise(i)) == F.size(expected)


def miss_reasons(misses: DataFrame) -> DataFrame:
    """misses(case_id, report, page, metric, value: booleans found anywhere): what was missing."""
    names = ("report", "page", "metric", "value")
    why = F.array_compact(F.array(*[F.when(~F.col(n), f"{n}_missing") for n in names]))
    return misses.select("case_id", F.when(F.size(why) == 0, F.array(F.lit("not_in_same_context"))).otherwise(why).alias("reasons"))


def rag_eval(rows: DataFrame, category: str, checks: list[str]) -> DataFrame:
    """Mean of nullable booleans overall and by category; nulls are left out."""
    agg = [rounded(F.avg(F.col(c).cast("double")), 6).alias(c) for c in checks]
    return rows.groupBy(category).agg(*agg).unionByName(rows.agg(*agg).withColumn(category, F.lit("overall")))
