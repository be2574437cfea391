"""Reports over job tables and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STATUSES = ("queued", "running", "succeeded", "failed", "stale")


def job_health(jobs: DataFrame, now: Column) -> DataFrame:
    """What each job is at time now: claimable, waiting, leased, stale (its lease ran out) or exhausted."""
    spent = F.col("attempt_count") >= F.col("max_attempts")
    state = (
        F.when((F.col("status") == "running") & (F.col("lease_expires_at") < now), F.when(spent, "failed").otherwise("stale"))
        .when(F.col("status") == "running", "leased")
        .when((F.col("status") == "queued") & spent, "failed")
        .when((F.col("status") == "queued") & (F.col("available_at") <= now), "claimable")
        .when(F.col("status") == "queued", "waiting")
        .otherwise(F.col("status"))
    )
    return jobs.withColumn("health", state)


def retry_schedule(jobs: DataFrame, now: Column, base_s: int = 30, cap_s: int = 3600) -> DataFrame:
    """Seconds to the next attempt, doubling up to the cap; null when no attempt is left."""
    wait = F.least(F.lit(float(cap_s)), F.lit(float(base_s)) * F.pow(F.lit(2.0), F.col("attempt_count") - 1)).cast("long")
    return jobs.withColumn("wait_s", F.when(F.col("attempt_count") < F.col("max_attempts"), wait)).withColumn("next_at", F.timestamp_seconds(F.unix_timestamp(now) + F.col("wait_s")))


def job_counts(jobs: DataFrame) -> DataFrame:
    """Jobs of each document by status, zeros for statuses without one, and the total."""
    got = jobs.groupBy("document_id").pivot("status", list(STATUSES)).count().fillna(0, list(STATUSES))
    return got.withColumn("total", sum((F.col(s) for s in STATUSES), F.lit(0)))


def idempotent_enqueue(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New rows whose key has not been seen, one per key (the smallest id)."""
    w = Window.partitionBy("idempotency_key").orderBy("id")
    first = new.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return first.join(existing.select("idempotency_key").distinct(), "idempotency_key", "left_anti")


def backlog_order(jobs: DataFrame, now: Column) -> DataFrame:
    ready = jobs.where((F.col("status") == "queued") & (F.col("available_at") <= now))
    w = Window.partitionBy("job_type").orderBy(F.desc("priority"), "available_at", "created_at", "id")
    return ready.withColumn("position", F.row_number().over(w))


def key_difference(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys that are missing or unexpected."""
    e, a = expected.select(key).distinct(), actual.select(key).distinct()
    return e.join(a, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(a.join(e, key, "left_anti").withColumn("side", F.lit("unexpected")))


def artifact_audit(expected: DataFrame, artifacts: DataFrame) -> DataFrame:
    """expected(page_id, sha) against artifacts(page_id, sha, ok): completed, failed, stale, missing or unexpected."""
    a = artifacts.select(F.col("page_id").alias("a_id"), F.col("sha").alias("a_sha"), "ok")
    both = expected.join(a, F.col("page_id") == F.col("a_id"), "full_outer")
    state = F.when(F.col("page_id").isNull(), "unexpected").when(F.col("a_id").isNull(), "missing").when(F.col("sha") != F.col("a_sha"), "stale").when(F.col("ok"), "completed").otherwise("failed")
    return both.select(F.coalesce("page_id", "a_id").alias("page_id"), state.alias("state"))


def candidate_coverage(truth: DataFrame, pages: DataFrame) -> DataFrame:
    """truth(source, page) against pages(source, page, dropped): selected, dropped or missing."""
    got = truth.join(pages, ["source", "page"], "left")
    return got.select("source", "page", F.when(F.col("dropped").isNull(), "missing").when(F.col("dropped"), "dropped").otherwise("selected").alias("bucket"))
