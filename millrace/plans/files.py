"""File sources: the given tables are written to the shared folder in each source's format and read back through it."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.sources import io
from millrace.sources.facts import table
from millrace.streaming.jobs import shared_folder


def text_docs(s, d):
    """Texts as .txt files, one line of a file per line of text; how many lines there are of each length."""
    path = shared_folder(s, "texts")
    table(s, d, "documents").select(F.coalesce("text", F.lit("")).alias("text")).write.option("maxRecordsPerFile", 10_000).text(path)
    lines = io.read_text_docs(s, path).select(F.explode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n")).alias("line"))
    return lines.groupBy(F.length("line").cast("long").alias("n_chars")).agg(F.count(F.lit(1)).alias("n_lines"))


def _artifacts(s, d):
    """Pages as OCR artifacts; a page without html is a failed one that does not say why."""
    path, done = shared_folder(s, "artifacts"), F.col("html").isNotNull()
    one = F.array(F.struct(F.lit(0).alias("table_index"), F.col("html").alias("pred_html"), F.coalesce("url", F.lit("")).alias("ocr_text"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("table_content_sha256")))
    rows = table(s, d, "pages").select(
        F.lit("1").alias("schema_version"), F.when(done, "completed").otherwise("failed").alias("status"), F.coalesce("url", F.lit("")).alias("source"), F.sha2(F.coalesce("url", F.lit("")), 256).alias("pdf_sha256"),
        F.col("page_id").cast("int").alias("physical_page_number"), F.lit(1).alias("table_count"), F.when(done, one).alias("tables"),
    )
    rows.write.json(path)
    return io.read_ocr_artifacts(s, path)


def ocr_artifacts(s, d):
    return _artifacts(s, d).select(F.col("physical_page_number").cast("long").alias("page_number"), F.array_join("violations", ",").alias("violations"))


def ocr_tables(s, d):
    return io.explode_ocr_tables(_artifacts(s, d)).select(F.col("physical_page_number").cast("long").alias("page_number"), "source", F.col("table_index").cast("long").alias("table_index"), "digest")


def ground_truth(s, d):
    path = shared_folder(s, "truth")
    rows = table(s, d, "benchmark").where("item_id is not null and trim(text) <> ''")
    rows.select(F.concat(F.lit("report-"), (F.col("item_id") % 7)).alias("pdf"), F.col("text").alias("question"), F.lit("amount").alias("metric"), F.length("text").cast("string").alias("expected_value"), (F.col("item_id") + 1).alias("expected_page")).write.json(path)
    return io.read_ground_truth(s, path, lines=True)


def load_stats(s, d):
    path = shared_folder(s, "load")
    of = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)")
    got = table(s, d, "events").groupBy(F.col("event_type").alias("Name")).agg(F.count(F.lit(1)).alias("Request Count"), F.count(F.when(F.col("value") > 100, 1)).alias("Failure Count"), F.round(F.avg("value"), 3).alias("Average Response Time"), of(0.95).alias("95%"), of(0.99).alias("99%"))
    io.export_csv(got.coalesce(1), path)  # a handful of rows: one for each type of event
    return io.read_load_stats(s, path)


QUERIES = {"s07_read_text_docs": text_docs, "s09_read_ocr_artifacts": ocr_artifacts, "x33_explode_ocr_tables": ocr_tables, "s11_read_ground_truth": ground_truth, "s12_read_load_stats": load_stats}

SQL = {
    "s07_read_text_docs": "SELECT len(line)::BIGINT AS n_chars, count(*) AS n_lines FROM (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) GROUP BY 1",
    "s09_read_ocr_artifacts": "SELECT page_id AS page_number, array_to_string(list_filter([CASE WHEN trim(coalesce(url, '')) = '' THEN 'source_missing' END, CASE WHEN page_id IS NULL OR page_id < 1 THEN 'page_invalid' END, CASE WHEN html IS NULL THEN 'error_missing' END], lambda x: x IS NOT NULL), ',') AS violations FROM pages",
    "x33_explode_ocr_tables": "SELECT page_id AS page_number, url AS source, 0::BIGINT AS table_index, sha256(html || '|' || url) AS digest FROM pages WHERE html IS NOT NULL AND page_id >= 1 AND trim(coalesce(url, '')) <> ''",
    "s11_read_ground_truth": "SELECT 'report-' || item_id % 7 AS pdf, text AS question, 'amount' AS metric, len(text)::VARCHAR AS expected_value, item_id + 1 AS expected_page FROM benchmark WHERE item_id IS NOT NULL AND trim(text) <> ''",
    "s12_read_load_stats": "SELECT event_type AS name, count(*)::DOUBLE AS requests, (count(*) FILTER (value > 100))::DOUBLE AS failures, round(avg(value), 3) AS average_ms, quantile_disc(value, 0.95) AS p95_ms, quantile_disc(value, 0.99) AS p99_ms FROM events GROUP BY 1",
}
