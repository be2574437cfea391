"""A table of chunks on shared storage, kept by document and index version: replacing and deleting them rewrites only the partitions they lie in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import Refused

KEYS = ("doc_id", "index_version")
PARTS = ("index_version", "doc_bucket")


@dataclass(frozen=True)
class ChunkStore:
    """Parquet under path/rows, by index_version and a hash bucket of doc_id; path/staged holds what a change is about to write.

    A change is first written whole beside the table and then put in by dynamic partition overwrite. If the job dies between the two, running the
    same change again gives the same table: staged rows are those of whole partitions. One writer at a time.
    """

    spark: SparkSession
    path: str
    schema: str
    buckets: int = 64

    def read(self) -> DataFrame:
        """All rows, in the columns of the schema; an empty table before the first write."""
        full = f"{self.schema}, doc_bucket int"
        if not self._exists(f"{self.path}/rows"):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(full).parquet(f"{self.path}/rows").drop("doc_bucket").select(self.spark.createDataFrame([], self.schema).columns)

    def upsert(self, rows: DataFrame) -> None:
        """Replace all chunks of every (doc_id, index_version) that rows hold; others stay. Null keys are refused."""
        if not rows.where(F.col("doc_id").isNull() | F.col("index_version").isNull()).isEmpty():
            raise Refused("chunks without doc_id or index_version")
        new = self._placed(rows)
        self._change(new.select(*KEYS, "doc_bucket").distinct(), new)

    def delete(self, keys: DataFrame) -> None:
        """Drop the chunks of keys(doc_id) or keys(doc_id, index_version). Null keys match nothing."""
        on = [c for c in KEYS if c in keys.columns]
        if "doc_id" not in on:
            raise Refused("a delete names documents")
        gone = self._placed(self.read().select(*KEYS).distinct()).join(keys.select(*on).distinct(), on, "left_semi")
        self._change(gone, None)

    def _change(self, gone: DataFrame, new: DataFrame | None) -> None:
        hit = gone.select(*PARTS).distinct()
        old = self._placed(self.read())
        kept = old.join(hit, list(PARTS), "left_semi").join(gone.select(*KEYS).distinct(), list(KEYS), "left_anti")
        staged = f"{self.path}/staged"
        (kept if new is None else kept.unionByName(new)).write.mode("overwrite").parquet(f"{staged}/rows")
        hit.write.mode("overwrite").parquet(f"{staged}/parts")
        rows = self.spark.read.schema(old.schema).parquet(f"{staged}/rows")
        emptied = self.spark.read.schema(hit.schema).parquet(f"{staged}/parts").join(rows.select(*PARTS).distinct(), list(PARTS), "left_anti")
        empty = [(r.index_version, r.doc_bucket) for r in emptied.collect()]  # partitions, at most versions x buckets
        rows.repartition(*PARTS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTS).parquet(f"{self.path}/rows")
        for version, bucket in empty:
            self._remove(version, bucket)

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("doc_bucket", F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int"))

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        p, fs = self._fs(path)
        return fs.exists(p)

    def _remove(self, version: str, bucket: int) -> None:
        escaped = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(version)
        p, fs = self._fs(f"{self.path}/rows/index_version={escaped}/doc_bucket={bucket}")
        fs.delete(p, True)
