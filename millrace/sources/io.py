"""Files in and out: text, JSON and CSV sources with their checks, exports, and copies between databases."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Encodings in the order they are tried; fields of query and truth files.
ENCODINGS = ("utf-8", "gbk", "gb2312", "latin-1")
QUERY_FIELDS = ("case_id", "question")
TRUTH_FIELDS = ("pdf", "question", "metric", "expected_value", "expected_page")
LOAD_COLUMNS = {"name": ("Name",), "requests": ("Request Count", "# requests"), "failures": ("Failure Count", "# failures"), "average_ms": ("Average Response Time",), "p95_ms": ("95%",), "p99_ms": ("99%",)}


class Refused(ValueError):
    """The input breaks its contract."""


def list_tables(spark: SparkSession, allowed: tuple[str, ...]) -> DataFrame:
    """Names of the catalog's tables and views that are allowed, sorted."""
    there = {t.name for t in spark.catalog.listTables()}
    return spark.createDataFrame([(n,) for n in sorted(there & set(allowed))], "table_name string")


def describe_schema(rows: DataFrame, name: str, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """One row per column: type, whether it may be null, whether it is a key. A business table must have shop_id."""
    if "shop_id" not in rows.columns:
        raise Refused(f"{name} has no shop_id")
    cols = [(name, f.name, f.dataType.simpleString(), f.nullable, f.name in keys) for f in rows.schema.fields]
    return rows.sparkSession.createDataFrame(cols, "table_name string, column_name string, type string, nullable boolean, is_key boolean")


def read_text_docs(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of .txt and .md files; the first encoding that fits is taken."""

    @F.pandas_udf("string")
    def decoded(content: pd.Series) -> pd.Series:
        def one(raw: bytes) -> str:
            for name in ENCODINGS:
                try:
                    return raw.decode(name)
                except UnicodeDecodeError:
                    continue
            return ""

        return content.map(one)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.where(F.lower("path").rlike(r"\.(txt|md)$")).select("path", decoded("content").alias("text"))


def read_query_set(spark: SparkSession, path: str) -> DataFrame:
    """case_id and question of a JSON-lines file; other fields (labels above all), blanks, broken lines and repeated ids are refused."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    rows = raw.select(F.from_json("value", "map<string,string>").alias("m"))
    wrong = rows.agg(
        F.count(F.when(F.col("m").isNull() | (F.size(F.array_except(F.map_keys("m"), F.array(*map(F.lit, QUERY_FIELDS)))) > 0), 1)).alias("fields"),
        F.count(F.when(F.exists(F.array(*[F.coalesce(F.trim(F.col("m")[f]), F.lit("")) for f in QUERY_FIELDS]), lambda x: x == ""), 1)).alias("blank"),
        (F.count(F.lit(1)) - F.countDistinct(F.col("m")["case_id"])).alias("repeated"),
    ).first()
    if wrong.fields or wrong.blank or wrong.repeated:
        raise Refused(f"query set: {wrong.fields} with other fields, {wrong.blank} blank, {wrong.repeated} repeated")
    return rows.select(*[F.col("m")[f].alias(f) for f in QUERY_FIELDS])


def read_ground_truth(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Cases of a JSON array, of an object with `cases`, or (lines) of JSON lines.

    Refused are a file without cases, blank or missing fields, pages that are no positive number, and repeated cases.
    """
    fields = ", ".join(f"{f} string" for f in TRUTH_FIELDS)
    raw = spark.read.schema(f"{fields}, cases array<struct<{fields.replace(' string', ': string')}>>").option("multiLine", not lines).json(path)
    own = F.struct(*TRUTH_FIELDS)
    rows = raw.select(F.explode(F.coalesce("cases", F.array(own))).alias("x")).select("x.*")
    page = F.expr("try_cast(expected_page AS bigint)")
    wrong = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.exists(F.array(*[F.coalesce(f, F.lit("")) for f in TRUTH_FIELDS]), lambda x: x == ""), 1)).alias("missing"),
        F.count(F.when(~F.coalesce(page > 0, F.lit(False)), 1)).alias("pages"), F.countDistinct(own).alias("different"),
    ).first()
    if not wrong.n or wrong.missing or wrong.pages or wrong.different < wrong.n:
        raise Refused(f"ground truth: {wrong.n} cases, {wrong.missing} with fields missing, {wrong.pages} with a bad page, {wrong.n - wrong.different} repeated")
    return rows.withColumn("expected_page", page)


def read_ocr_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Page artifacts with the rules each breaks, and a digest per table."""
    schema = "schema_version string, status string, source string, pdf_sha256 string, physical_page_number int, table_count int, tables array<struct<table_index:int,pred_html:string,ocr_text:string,table_content_sha256:string>>, error string"
    rows = spark.read.schema(schema).json(path)
    rules = F.array(
        F.when(F.col("schema_version").isNull(), "schema_missing"), F.when(~F.col("status").isin("completed", "failed") | F.col("status").isNull(), "status_unknown"), F.when(F.coalesce(F.trim("source"), F.lit("")) == "", "source_missing"),
        F.when(~F.coalesce(F.col("pdf_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "sha_invalid"), F.when(~F.coalesce(F.col("physical_page_number") >= 1, F.lit(False)), "page_invalid"),
        F.when((F.col("status") == "completed") & ~F.col("table_count").eqNullSafe(F.size("tables")), "table_count_differs"), F.when((F.col("status") == "failed") & F.col("error").isNull(), "error_missing"),
    )
    return rows.withColumn("violations", F.array_compact(rules))


def explode_ocr_tables(artifacts: DataFrame) -> DataFrame:
    good = artifacts.where((F.size("violations") == 0) & (F.col("status") == "completed"))
    t = good.select("source", "physical_page_number", F.explode("tables").alias("t"))
    return t.select("source", "physical_page_number", "t.table_index", "t.pred_html", "t.ocr_text", F.sha2(F.concat_ws("|", "t.pred_html", "t.ocr_text"), 256).alias("digest"))


def read_load_stats(spark: SparkSession, path: str) -> DataFrame:
    """Load-test statistics with columns under any of their known names; a byte-order mark does no harm."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    found = {}
    for name, options in LOAD_COLUMNS.items():
        hit = next((o for o in options if o in raw.columns), None)
        if hit is None:
            raise Refused(f"column for {name} is missing")
        found[name] = hit
    return raw.select(*[(F.col(f"`{c}`") if n == "name" else F.col(f"`{c}`").cast("double")).alias(n) for n, c in found.items()])


def export_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; the first column's name carries the byte-order mark that spreadsheets look for."""
    first, *rest = rows.columns
    rows.toDF("﻿" + first, *rest).write.mode("errorifexists").option("header", True).csv(path)


def export_report(rows: DataFrame, order: list[str], most: int = 20) -> DataFrame:
    """(line_number, line): a Markdown table of the first rows in a stated order and a note of how many there are."""
    cols = rows.columns
    text = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), F.lit(" |"))
    spark = rows.sparkSession
    head = spark.createDataFrame([(0, "| " + " | ".join(cols) + " |"), (1, "|" + " --- |" * len(cols))], "line_number int, line string")
    top = rows.orderBy(*order).limit(most)
    body = top.select((F.row_number().over(Window.orderBy(*order)) + 1).alias("line_number"), text.alias("line"))  # at most `most` rows
    note = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(most + 2).alias("line_number"), F.concat("n", F.lit(" rows")).alias("line"))
    return head.unionByName(body).unionByName(note)


def bulk_copy(tables: dict[str, DataFrame], existing: dict[str, DataFrame], replace: bool = False) -> dict[str, DataFrame]:
    """What to write in order, after the checks: no table is missing and no target holds rows unless it is replaced."""
    missing = sorted(set(tables) - set(existing))
    if missing:
        raise Refused(f"target lacks {missing}")
    filled = [n for n in tables if not replace and not existing[n].isEmpty()]
    if filled:
        raise Refused(f"target is not empty: {filled}")
    return tables


def write_jdbc(rows: DataFrame, url: str, table: str, replace: bool, batch: int = 500) -> None:
    rows.write.mode("overwrite" if replace else "append").option("batchsize", batch).option("truncate", True).jdbc(url, table)


def copy_database(spark: SparkSession, source: str, target: str, tables: dict[str, str], replace: bool = False, parts: int = 8, batch: int = 500) -> DataFrame:
    """Copy tables (name to its numeric key, parents before children) between two JDBC databases; (table_name, n) of what was written.

    Refused before anything is written: one database as both sides, a table that can't be read on either side, columns the target lacks, a target with rows unless it
    is replaced. Replacing empties children before parents. Each table is read in `parts` ranges of its key; rows whose key is null go with the first. A written table
    whose count differs is an error.
    """
    if source.split(";")[0].rstrip("/") == target.split(";")[0].rstrip("/"):
        raise Refused("source and target are one database")
    there = {}
    for name in tables:
        for url in (source, target):
            try:
                there[name, url] = spark.read.jdbc(url, name)
            except Exception as e:  # each driver has errors of its own
                raise Refused(f"{name} can't be read: {str(e)[:200]}") from e
        lacks = sorted({c.lower() for c in there[name, source].columns} - {c.lower() for c in there[name, target].columns})
        if lacks:
            raise Refused(f"target's {name} lacks {lacks}")
    bulk_copy({n: there[n, source] for n in tables}, {n: there[n, target] for n in tables}, replace)
    if replace:
        for name in reversed(list(tables)):
            write_jdbc(there[name, target].where("false"), target, name, True, batch)
    done = []
    for name, key in tables.items():
        ends = there[name, source].agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("n")).first()
        rows = there[name, source] if ends.low is None else spark.read.jdbc(source, name, column=key, lowerBound=int(ends.low), upperBound=int(ends.high) + 1, numPartitions=parts)
        write_jdbc(rows, target, name, False, batch)
        n = spark.read.jdbc(target, name).count()
        if n != ends.n:
            raise RuntimeError(f"{name}: {n} rows written of {ends.n}")
        done.append((name, n))
    return spark.createDataFrame(done, "table_name string, n long")
