"""Answers to catalog and order messages, verified facts, page routes, and scaled financial values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import top_by
from .verify import strict_value_match, typed_value, values_equal

# Scale words of amounts, in units.
SCALES = (("亿元", "100000000"), ("万元", "10000"), ("百万", "1000000"), ("亿", "100000000"), ("万", "10000"), ("千元", "1000"), ("元", "1"))


def catalog_answer_join(requests: DataFrame, products: DataFrame, most: int = 5) -> DataFrame:
    """requests(request_id, shop_id, category, max_price, power_w, in_stock_only) with the shop's cheapest fitting products.

    Absent filters let all pass. Products come in order of price, so the price only cuts their list off: the `most` cheapest of each shop
    and kind asked for (category, power and stock, each given or any) are found first, and requests meet these alone, by equal keys.
    """
    given = [F.col("category").isNotNull(), F.col("power_w").isNotNull(), F.coalesce("in_stock_only", F.lit(True))]
    kinds = requests.select(*[g.alias(n) for g, n in zip(given, ("__c", "__w", "__s"))]).distinct()  # 8 rows at most
    p = products.where("is_active").select(F.col("shop_id").alias("p_shop"), "id", "sku", "name", F.lower("category").alias("p_category"), "price", "stock", F.get_json_object("specifications", "$.power_w").cast("int").alias("watts"))
    fits = (~F.col("__c") | F.col("p_category").isNotNull()) & (~F.col("__w") | F.col("watts").isNotNull()) & (~F.col("__s") | (F.col("stock") > 0))
    p = p.join(F.broadcast(kinds), fits).withColumns({"p_category": F.when(F.col("__c"), F.col("p_category")), "p_watts": F.when(F.col("__w"), F.col("watts"))})
    # a price that is not known comes first, but not under a highest price
    first = top_by(p, ["p_shop", "p_category", "p_watts", "__s", F.col("price").isNull()], [F.col("price"), F.col("id")], most, "__n").drop("__n", "__c", "__w")
    same = (F.col("shop_id") == F.col("p_shop")) & F.lower("category").eqNullSafe(F.col("p_category")) & F.col("power_w").eqNullSafe(F.col("p_watts")) & (given[2] == F.col("__s"))
    rows = requests.join(first, same).where(F.col("max_price").isNull() | (F.col("price") <= F.col("max_price")))
    return top_by(rows, ["request_id"], [F.col("price"), F.col("id")], most, "position").drop("p_shop", "p_category", "p_watts", "__s")


def render_catalog(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """One reply per request: a line per product, or that there is none."""
    line = F.format_string("%d. %s (%s)", F.col("position"), F.col("name"), F.col("sku"))
    text = answers.groupBy("request_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", line.alias("line")))), lambda x: x["line"]), "\n").alias("reply"))
    return requests.select("request_id").join(text, "request_id", "left").withColumn("reply", F.coalesce("reply", F.lit("no product fits")))


def scaled_amount(text: Column) -> Column:
    """Amount of a text such as 1,234.5万元 in units; the first scale word that follows the number counts; brackets are negative."""
    number = F.regexp_extract(text, r"(\(?\s*[+-]?\d[\d,]*(?:\.\d+)?\s*\)?)", 1)
    value = F.regexp_replace(number, r"[(),\s]", "").try_cast("decimal(30,6)")
    value = F.when(number.startswith("("), -value).otherwise(value)
    rest = F.regexp_replace(text, r"(?s)^.*?\(?\s*[+-]?\d[\d,]*(?:\.\d+)?\s*\)?", "")
    scale = None
    for word, factor in SCALES:
        scale = F.when(rest.startswith(word), F.lit(factor).cast("decimal(10,0)")) if scale is None else scale.when(rest.startswith(word), F.lit(factor).cast("decimal(10,0)"))
    return F.when(number != "", value * scale.otherwise(F.lit("1").cast("decimal(10,0)")))


def rate_points(text: Column) -> Column:
    """Percentage points of a text in percent or basis points; 100 basis points are one."""
    value = F.regexp_extract(text, r"([+-]?\d+(?:\.\d+)?)", 1).try_cast("decimal(20,6)")
    return F.when(text.rlike(r"(?i)\d\s*(?:bp|bps|基点)"), value / F.lit("100").cast("decimal(3,0)")).when(text.rlike(r"\d\s*(?:%|％|个百分点|百分点)"), value).cast("double")


def row_strict_match(lines: DataFrame) -> DataFrame:
    """lines(case_id, content, metric, expected_value): cases whose metric and value stand in one Markdown row."""
    rows = lines.select("case_id", "metric", "expected_value", F.explode(F.split("content", "\n")).alias("line")).where(F.trim("line").startswith("|"))
    hit = F.lower("line").contains(F.lower("metric")) & strict_value_match(F.col("expected_value"), F.col("line"))
    return rows.groupBy("case_id").agg(F.bool_or(hit).alias("matched"))


def verify_facts(facts: DataFrame, segments: DataFrame) -> DataFrame:
    """facts(answer_id, fact_id, fact_type, value_text, sku, citation_ids) against segments(answer_id, citation_id, segment).

    A fact is supported if one segment of a citation it names holds its SKU and an equal typed value.
    Returns the facts with their errors: no known citation, or no support.
    """
    named = facts.select("answer_id", "fact_id", "fact_type", "value_text", "sku", F.explode_outer("citation_ids").alias("citation_id"))
    both = named.join(segments, ["answer_id", "citation_id"], "left")
    # digits of the SKU are no value
    plain = F.coalesce(F.call_function("regexp_replace", F.col("segment"), F.concat(F.lit(r"(?i)\Q"), F.col("sku"), F.lit(r"\E")), F.lit(" ")), F.col("segment"))
    same = values_equal(typed_value(F.col("value_text"), F.col("fact_type")), typed_value(plain, F.col("fact_type")))
    sku = F.col("sku").isNull() | F.upper("segment").contains(F.upper("sku"))
    got = both.groupBy("answer_id", "fact_id").agg(F.coalesce(F.bool_or(F.col("segment").isNotNull()), F.lit(False)).alias("known"), F.coalesce(F.bool_or(same & sku), F.lit(False)).alias("supported"))
    return got.select("answer_id", "fact_id", F.array_compact(F.array(F.when(~F.col("known"), "unknown_citation"), F.when(~F.col("supported"), "unsupported_fact"))).alias("errors"))


def page_route(capped: DataFrame, layers: DataFrame) -> DataFrame:
    """Pages chosen under the cap with the outcome of their table layer: layers(doc, page_number, ok).

    A page is tables where its layer worked, degraded where it failed or is missing, and text where none was asked for.
    """
    rows = capped.join(layers, ["doc", "page_number"], "left")
    return rows.withColumn("route", F.when(F.col("dropped_by_cap"), "dropped").when(F.col("ok"), "tables").otherwise("degraded"))


def stable_projection(rows: DataFrame, unstable: str = r"(?i)(_at|_path|_ms)$|^(runtime|timestamp|elapsed)") -> DataFrame:
    """rows without columns that change from run to run, and a hash of what is left, fields in sorted order."""
    import re

    kept = sorted(c for c in rows.columns if not re.search(unstable, c))
    return rows.select(*kept, F.sha2(F.to_json(F.struct(*kept), {"ignoreNullFields": "false"}), 256).alias("row_sha256"))
