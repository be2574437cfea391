"""Queries on typed values, contracts and evidence, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import verify
from millrace.sources.facts import table


def _facts(s, d):
    """Typed value texts made from order lines: four kinds and some that must be refused."""
    li = table(s, d, "lineitem")
    k, q = (F.col("l_orderkey") + F.col("l_linenumber")) % 8, F.col("l_quantity").cast("int").cast("string")
    text = F.when(k == 0, F.concat(F.lit("$"), q, F.lit(".50"))).when(k == 1, F.concat(q, F.lit(" days"))).when(k == 2, F.concat(q, F.lit("%"))).when(k == 3, q).when(k == 4, F.concat(q, F.lit("k USD"))).when(k == 5, F.concat(F.lit("("), q, F.lit(") USD"))).when(k == 6, F.concat(q, F.lit(" hours"))).otherwise(F.concat(F.lit("1,"), F.lpad(q, 3, "0"), F.lit(" USD 2 days")))
    kind = F.when(k.isin(1, 6), "delivery_duration").when(k == 2, "customs_duty_rate").when(k == 3, "inventory_quantity").otherwise("price")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("part"), text.alias("value_text"), kind.alias("fact_type"))


def extract_values(s, d):
    v = verify.typed_value(F.col("value_text"), F.col("fact_type"))
    rows = _facts(s, d).select("id", "value_text", v.alias("v"))
    return rows.select("id", "value_text", F.col("v.value").cast("double").alias("value"), F.col("v.canonical_value").cast("double").alias("canonical_value"), F.col("v.unit").alias("unit"), F.col("v.currency").alias("currency"))


def values_equal(s, d):
    v = verify.typed_value(F.col("value_text"), F.col("fact_type"))
    day = verify.typed_value(F.lit("2 days"), F.lit("delivery_duration"))
    return _facts(s, d).where(verify.values_equal(v, day)).groupBy("value_text").agg(F.count(F.lit(1)).alias("n"))


def fact_contract(s, d):
    li = table(s, d, "lineitem")
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 5
    kind = F.get(F.array(*map(F.lit, (*verify.FACT_TYPES, "other"))), k.cast("int"))
    rows = li.select(kind.alias("fact_type"), F.when(F.col("l_returnflag") == "R", "day").when(F.col("l_returnflag") == "A", "percent").alias("unit"), F.when(F.col("l_linestatus") == "F", "USD").alias("currency"))
    return verify.fact_contract(rows).groupBy("fact_type", "unit", "currency", F.array_join("violations", ",").alias("violations")).agg(F.count(F.lit(1)).alias("n"))


def truth_contract(s, d):
    docs = table(s, d, "documents")
    truth = docs.select(F.col("doc_id").alias("case_id"), F.col("source").alias("pdf"), F.lit("m").alias("metric"), F.when(F.col("doc_id") % 9 != 0, "1").alias("expected_value"), (F.col("doc_id") % 60).alias("expected_page"), (F.col("doc_id") % 4 == 0).alias("should_refuse"), F.when(F.col("doc_id") % 8 == 0, "why").alias("refusal_reason"))
    manifest = docs.where("source <> 'src3'").groupBy(F.col("source").alias("pdf")).agg(F.lit(50).alias("page_count"))
    return verify.truth_contract(truth, manifest).select("case_id", F.array_join("violations", ",").alias("violations")).where("violations <> ''")


def citation_subset(s, d):
    docs = table(s, d, "documents")
    answer = F.concat(F.lit("x [C"), (F.col("doc_id") % 5).cast("string"), F.lit("] y"), F.when(F.col("doc_id") % 3 == 0, "[C9]").otherwise(""))
    return docs.select("doc_id", verify.citation_subset(answer, F.array(F.lit("C1"), F.lit("C2"))).alias("ok"))


def strict_value_match(s, d):
    docs = table(s, d, "documents")
    return docs.where(verify.strict_value_match((F.col("doc_id") % 10).cast("string"), F.concat("text", F.lit(" 1,5 and 3.7 end 9")))).select("doc_id")


def coverage_category(s, d):
    """With every document as a case and as a chunk; chunks lie on even pages, up to two on one."""
    docs = table(s, d, "documents")
    cases = docs.select(F.col("doc_id").alias("case_id"), "source", F.col("doc_id").alias("page"), F.lit("license").alias("metric"), F.lit("2.0").alias("expected_value"))
    chunks = docs.select("source", (F.col("doc_id") - F.col("doc_id") % 2).alias("page"), F.col("text").alias("content"))
    return verify.coverage_category(cases, chunks).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def evidence_segments(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("citation_id"), F.lit("text").alias("content_type"), F.col("text").alias("content"))
    return verify.evidence_segments(docs).groupBy("citation_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("segment")).alias("n_chars"))


def hash_embedding(s, d):
    e = verify.hash_embedding(table(s, d, "benchmark").where("item_id is not null"), "item_id", "text")
    return e.select("item_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"), F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("n_features"))


QUERIES = {
    "x21_extract_values": extract_values, "x22_values_equal": values_equal, "v05_fact_contract": fact_contract, "v07_truth_contract": truth_contract, "v09_citation_subset": citation_subset, "x24_strict_value_match": strict_value_match, "j14_coverage_category": coverage_category, "x26_evidence_segments": evidence_segments, "x29_hash_embedding": hash_embedding,
}

_F = """f AS (SELECT l_orderkey * 10 + l_linenumber AS id, (l_orderkey + l_linenumber) % 8 AS k, l_quantity::INT AS q FROM lineitem),
g AS (SELECT id, k, q, CASE k WHEN 0 THEN '$' || q || '.50' WHEN 1 THEN q || ' days' WHEN 2 THEN q || '%' WHEN 3 THEN q::VARCHAR WHEN 4 THEN q || 'k USD' WHEN 5 THEN '(' || q || ') USD' WHEN 6 THEN q || ' hours' ELSE '1,' || lpad(q::VARCHAR, 3, '0') || ' USD 2 days' END AS value_text FROM f)"""
SQL = {
    "x21_extract_values": f"WITH {_F} SELECT id, value_text, CASE k WHEN 0 THEN q + 0.5 WHEN 1 THEN q WHEN 2 THEN q WHEN 3 THEN q WHEN 6 THEN q END::DOUBLE AS value, CASE k WHEN 0 THEN q + 0.5 WHEN 1 THEN q * 24 WHEN 2 THEN q WHEN 3 THEN q WHEN 6 THEN q END::DOUBLE AS canonical_value, CASE k WHEN 1 THEN 'day' WHEN 2 THEN 'percent' WHEN 6 THEN 'hour' END AS unit, CASE k WHEN 0 THEN 'USD' END AS currency FROM g",
    "x22_values_equal": f"WITH {_F} SELECT value_text, count(*) AS n FROM g WHERE (k = 1 AND q = 2) OR (k = 6 AND q = 48) GROUP BY 1",
    "v05_fact_contract": "WITH r AS (SELECT ['price','inventory_quantity','delivery_duration','customs_duty_rate','other'][((l_orderkey + l_linenumber) % 5)::INT + 1] AS fact_type, CASE l_returnflag WHEN 'R' THEN 'day' WHEN 'A' THEN 'percent' END AS unit, CASE l_linestatus WHEN 'F' THEN 'USD' END AS currency FROM lineitem) SELECT fact_type, unit, currency, CASE WHEN fact_type = 'other' THEN 'unknown_fact_type' WHEN fact_type = 'price' AND (currency IS NULL OR unit IS NOT NULL) THEN 'price_needs_currency_without_unit' WHEN fact_type = 'inventory_quantity' AND (currency IS NOT NULL OR unit IS NOT NULL) THEN 'quantity_without_currency_and_unit' WHEN fact_type = 'delivery_duration' AND (currency IS NOT NULL OR unit IS DISTINCT FROM 'day') THEN 'duration_needs_unit_without_currency' WHEN fact_type = 'customs_duty_rate' AND (currency IS NOT NULL OR unit IS DISTINCT FROM 'percent') THEN 'rate_needs_percent_without_currency' ELSE '' END AS violations, count(*) AS n FROM r GROUP BY 1, 2, 3, 4",
    "v07_truth_contract": "WITH v AS (SELECT doc_id AS case_id, array_to_string(list_filter([CASE WHEN source = 'src3' THEN 'unknown_source' END, CASE WHEN doc_id % 4 = 0 AND doc_id % 8 <> 0 THEN 'refusal_reason_missing' END, CASE WHEN doc_id % 4 <> 0 AND doc_id % 9 = 0 THEN 'empty_field' END, CASE WHEN doc_id % 4 <> 0 AND (source = 'src3' OR doc_id % 60 < 1 OR doc_id % 60 > 50) THEN 'page_out_of_range' END], lambda x: x IS NOT NULL), ',') AS violations FROM documents) SELECT * FROM v WHERE violations <> ''",
    "v09_citation_subset": "SELECT doc_id, doc_id % 5 IN (1, 2) AND doc_id % 3 <> 0 AS ok FROM documents",
    "x24_strict_value_match": r"SELECT doc_id FROM documents WHERE regexp_matches(regexp_replace(replace(lower(text || ' 1,5 and 3.7 end 9'), ',', ''), '\s+', ' ', 'g'), '(?:^|[^0-9.])' || (doc_id % 10) || '(?:$|[^0-9.])')",
    "j14_coverage_category": r"WITH h AS (SELECT source, doc_id - doc_id % 2 AS page, text IS NOT NULL AS found, contains(regexp_replace(lower(text), '[\s,]', '', 'g'), 'license') AS metric, regexp_matches(regexp_replace(replace(lower(text), ',', ''), '\s+', ' ', 'g'), '(?:^|[^0-9.])2[.]0(?:$|[^0-9.])') AS value FROM documents), c AS (SELECT d.doc_id, coalesce(bool_or(found), false) AS page, coalesce(bool_or(metric), false) AS metric, coalesce(bool_or(value), false) AS value, coalesce(bool_or(metric AND value), false) AS strict FROM documents d LEFT JOIN h ON h.source = d.source AND h.page = d.doc_id GROUP BY 1) SELECT CASE WHEN strict THEN 'strict_target_present' WHEN NOT page THEN 'no_target_page_table_chunk' WHEN metric AND value THEN 'metric_value_split_across_chunks' WHEN metric THEN 'metric_only' WHEN value THEN 'value_only' ELSE 'metric_and_value_missing' END AS category, count(*) AS n FROM c GROUP BY 1",
}
