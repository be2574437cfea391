"""Shared helpers: table access, the shared scratch folder, connected components."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


_OWN_SCRATCH: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that is unset (tests on one machine) a temporary folder is made; on a cluster it must be set.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = _OWN_SCRATCH.get(sc.applicationId)
        if base is None:
            base = _OWN_SCRATCH[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-millrace-")
    path = f"{base.rstrip('/')}/millrace-{sc.applicationId}"
    if path not in _MADE:
        _MADE.add(path)
        atexit.register(release, spark)
    return path


_MADE: set[str] = set()


def new_path(spark: SparkSession, label: str) -> str:
    return f"{scratch(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def release(spark: SparkSession) -> None:
    """Delete what this application stashed in the shared folder."""
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(scratch(spark))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may already be gone when the interpreter ends
        pass


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and no executor owns a part."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _rekeyed(df: DataFrame, key: str) -> DataFrame:
    """A join key that hides the aggregate's partitioning, so both join sides are
    exchanged and adaptive execution can split a hub's partition."""
    return df.withColumn("k", F.bitwise_not(F.col(key)))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every node that has an edge.

    edges(u long, v long) in any direction; loops and repeats are harmless. Alternating
    large-star and small-star steps; each is a grouped minimum (combined map-side)
    joined back to the edges, written to the shared folder. Returns (node, root),
    nodes that are their own root left out. Rounds grow with the logarithm of the
    component size, not with its diameter.
    """
    e = stash(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u points at u's smallest neighbour
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        mins = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = (
            _rekeyed(sym.where("v > u"), "u").drop("u")
            .join(_rekeyed(mins, "u").drop("u"), "k")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        e = stash(e, "large")
        # small star: u and its smaller neighbours point at the smallest of them
        mins = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = _rekeyed(e, "u").drop("u").join(_rekeyed(mins, "u").drop("u"), "k").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stash(moved.unionByName(mins.select("u", F.col("m").alias("v"))).distinct(), "small")
        now = e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.sum((F.xxhash64("u", "v") % 1000003)), F.lit(0))).first()
        if now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
    raise RuntimeError("components did not settle")
