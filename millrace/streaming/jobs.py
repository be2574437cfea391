"""Stream jobs: messages routed as they come, and documents chunked into an index exactly once."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import chunks, routing


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one only where that is unset and Spark runs on one machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-millrace-")
    path = f"{base.rstrip('/')}/millrace-{label}-{uuid.uuid4().hex[:12]}"
    atexit.register(_release, spark, path)
    return path


def _release(spark: SparkSession, path: str) -> None:
    """Delete a folder of shared_folder when the program ends."""
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may already be gone
        pass


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream over a Parquet folder, or over one Parquet file by its name in its folder."""
    schema = spark.read.parquet(path).schema
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p)
    if status.isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())


def run_to_end(rows: DataFrame, folder: str) -> DataFrame:
    """Process all that is there, then stop; the checkpoint makes a restart go on where it ended. Returns what was written."""
    q = rows.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/rows")


def stream_route(messages: DataFrame, rules=routing.ROUTES) -> DataFrame:
    """messages(request_id, message) to audit rows; stateless, so late or repeated input needs no state."""
    return routing.audit_events(routing.route_messages(messages, rules))


def ingest(docs: DataFrame, folder: str, size: int = 400) -> DataFrame:
    """Chunk each document once, however often it comes, in this batch or a later one.

    State keeps the hash of every (doc_id, text) seen, so a repeated document is dropped and two texts of one doc_id both stay,
    each under its own index_version (the text's hash). The batch writer overwrites its own folder on a retry, so a restart adds nothing twice.
    """
    version = F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 16)
    once = docs.select("doc_id", "text", version.alias("index_version")).dropDuplicates(["doc_id", "index_version"])

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = chunks.chunk_text(batch, size, version="index_version")
        rows.write.mode("overwrite").parquet(f"{folder}/index/batch={batch_id}")

    q = once.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return docs.sparkSession.read.parquet(f"{folder}/index")
