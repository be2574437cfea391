"""Queries on catalog answers, verified facts and page routes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import answers, pages, routing, support
from millrace.sources import facts
from millrace.sources.facts import table

from .business import _PRODUCTS
from .retrieval import _PG, _features, _r


def _requests(s, d):
    c = table(s, d, "conversations").where("conv_id is not null")
    k = F.col("conv_id") * 1000 + F.col("turn")
    return c.select(k.alias("request_id"), (F.col("conv_id") % 25).cast("string").alias("shop_id"), F.lit(None).cast("string").alias("category"), (F.lit(900) + (k % 9) * 100).cast("decimal(12,2)").alias("max_price"), F.when(k % 4 == 0, (k % 50).cast("int")).alias("power_w"), F.lit(True).alias("in_stock_only"))


def catalog_answer_join(s, d):
    return support.catalog_answer_join(_requests(s, d), facts.products(s, d)).select("request_id", "sku", F.col("position").cast("long").alias("position"))


def render_answers(s, d):
    q = _requests(s, d)
    return support.render_catalog(q, support.catalog_answer_join(q, facts.products(s, d)))


def catalog_filters(s, d):
    p = table(s, d, "part")
    text = F.concat(F.when(F.col("p_partkey") % 3 == 0, "A CABLE ").when(F.col("p_partkey") % 3 == 1, "power bank ").otherwise("thing "), F.lit("under $"), F.col("p_size").cast("string"), F.lit(".50 and "), F.col("p_size").cast("string"), F.lit("w"))
    got = routing.catalog_filters(p.select("p_partkey", text.alias("message")))
    return got.select("p_partkey", "category", F.col("max_price").cast("double").alias("max_price"), "budget_currency", F.col("power_w").cast("long").alias("power_w"))


def address_cancel_flags(s, d):
    o = table(s, d, "orders")
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, "please ship to 12 Main Street").when(k == 1, "Cancel my order now").when(k == 2, "订单请保留，不要发票").otherwise("hello")
    return routing.flags(o.select("o_orderkey", text.alias("message"))).select("o_orderkey", "address_change", "explicit_cancel")


def advice_guard(s, d):
    from millrace.operators.verify import advice_guard as guard

    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, "这只股票明年会涨吗").when(k == 1, "应该买入吗").when(k == 2, "股价是多少").otherwise("营业收入")
    return table(s, d, "orders").select("o_orderkey", guard(text).alias("refuse"))


def financial_values(s, d):
    k, q = F.col("l_linenumber") % 4, F.col("l_quantity").cast("int").cast("string")
    text = F.when(k == 0, F.concat(q, F.lit("万元"))).when(k == 1, F.concat(F.lit("("), q, F.lit(".5)亿元"))).when(k == 2, F.concat(F.lit("1,"), F.lpad(q, 3, "0"), F.lit("元"))).otherwise(q)
    rate = F.when(k == 0, F.concat(q, F.lit("bp"))).when(k == 1, F.concat(q, F.lit("%"))).when(k == 2, F.concat(q, F.lit("个百分点"))).otherwise(q)
    li = table(s, d, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_partkey", text.alias("text"), support.scaled_amount(text).cast("double").alias("amount"), support.rate_points(rate).alias("points"))


def row_strict_match(s, d):
    docs = table(s, d, "documents")
    content = F.concat(F.lit("| metric | 2023 |\n| --- | --- |\n| Revenue | "), F.col("doc_id").cast("string"), F.lit(",000 |\n| Cost | 7 |"))
    metric = F.when(F.col("doc_id") % 2 == 0, "revenue").otherwise("cost")
    return support.row_strict_match(docs.select(F.col("doc_id").alias("case_id"), content.alias("content"), metric.alias("metric"), F.concat(F.col("doc_id").cast("string"), F.lit("000")).alias("expected_value")))


def verify_facts(s, d):
    p = table(s, d, "part")
    k = F.col("p_partkey")
    sku = F.concat(F.lit("SKU-"), k.cast("string"))
    f = p.select(k.alias("answer_id"), F.lit(1).cast("long").alias("fact_id"), F.lit("delivery_duration").alias("fact_type"), F.concat((k % 7 + 1).cast("string"), F.lit(" days")).alias("value_text"), sku.alias("sku"), F.when(k % 11 == 0, F.array(F.lit("C9"))).otherwise(F.array(F.lit("C1"))).alias("citation_ids"))
    seg = p.select(k.alias("answer_id"), F.lit("C1").alias("citation_id"), F.concat(F.lit("Delivery "), F.when(k % 5 == 0, (k % 7 + 2) * 24).otherwise((k % 7 + 1) * 24).cast("string"), F.lit(" hours for "), sku).alias("segment"))
    return support.verify_facts(f, seg).select("answer_id", F.array_join("errors", ",").alias("errors"))


def render_verified(s, d):
    p = facts.products(s, d)
    return p.select("id", F.concat_ws(" ", F.concat("sku", F.lit(":")), F.lit("stock"), F.col("stock").cast("string"), F.concat(F.lit("[C"), (F.col("id") % 3 + 1).cast("string"), F.lit("]"))).alias("sentence"))


def page_route(s, d):
    capped = pages.page_cap(pages.title_neighbors(pages.page_classify(_features(s, d))), 10)
    layers = capped.where("page_number % 3 <> 0").select("doc", "page_number", (F.col("page_number") % 2 == 0).alias("ok"))
    return support.page_route(capped, layers).groupBy("doc", "route").agg(F.count(F.lit(1)).alias("n"))


def rag_eval(s, d):
    docs = table(s, d, "documents")
    rows = docs.select("lang", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 2 == 0).alias("retrieval_hit"), (F.col("n_chars") > 1000).alias("keyword_match"))
    return answers.rag_eval(rows, "lang", ["retrieval_hit", "keyword_match"])


def metadata_budget(s, d):
    b = text.within_budget(F.col("text"), 100)
    return table(s, d, "documents").select("doc_id", b.alias("b")).select("doc_id", "b.text", "b.omitted", "b.chars", "b.bytes", "b.sha256")


def stable_projection(s, d):
    rows = table(s, d, "documents").select("doc_id", "lang", F.current_timestamp().alias("built_at"), F.lit("/x").alias("file_path"), F.lit(3).alias("elapsed_ms"))
    return support.stable_projection(rows)


QUERIES = {
    "p10_metadata_budget": metadata_budget, "p15_stable_projection": stable_projection,
    "r04_catalog_answer_join": catalog_answer_join, "r11_render_answers": render_answers, "r03_catalog_filters": catalog_filters, "r02_address_cancel_flags": address_cancel_flags, "r10_advice_guard": advice_guard, "x23_extract_financial_values": financial_values, "x25_row_strict_match": row_strict_match,
    "v04_verify_facts": verify_facts, "v08_render_verified": render_verified, "x18_page_route": page_route, "a33_rag_eval": rag_eval,
}

_REQ = _PRODUCTS + """, q AS (SELECT conv_id * 1000 + turn AS request_id, (conv_id % 25)::VARCHAR AS shop_id, 900 + ((conv_id * 1000 + turn) % 9) * 100 AS max_price, CASE WHEN (conv_id * 1000 + turn) % 4 = 0 THEN (conv_id * 1000 + turn) % 50 END AS power_w FROM conversations WHERE conv_id IS NOT NULL),
a AS (SELECT request_id, sku, name, row_number() OVER (PARTITION BY request_id ORDER BY price, id) AS position FROM q JOIN products p ON q.shop_id = p.shop_id AND is_active AND stock > 0 AND price <= max_price AND (power_w IS NULL OR power_w = p_size) QUALIFY position <= 5)"""
_LN = "k AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey, l_linenumber % 4 AS k, l_quantity::INT AS q FROM lineitem)"
SQL = {
    "p10_metadata_budget": "SELECT doc_id, CASE WHEN strlen(text) > 100 THEN substr(text, 1, list_max(list_filter(range(0, 101), lambda k: strlen(substr(text, 1, k)) <= 100))) ELSE text END AS text, strlen(text) > 100 AS omitted, CASE WHEN strlen(text) > 100 THEN len(text) END AS chars, CASE WHEN strlen(text) > 100 THEN strlen(text) END AS bytes, CASE WHEN strlen(text) > 100 THEN sha256(text) END AS sha256 FROM documents",
    "p15_stable_projection": """SELECT doc_id, lang, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '"}') AS row_sha256 FROM documents""",
    "r04_catalog_answer_join": f"WITH {_REQ} SELECT request_id, sku, position FROM a",
    "r11_render_answers": f"WITH {_REQ} SELECT q.request_id, coalesce(string_agg(position || '. ' || name || ' (' || sku || ')', chr(10) ORDER BY position), 'no product fits') AS reply FROM q LEFT JOIN a ON q.request_id = a.request_id GROUP BY 1",
    "r03_catalog_filters": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'cable' WHEN 1 THEN 'power_bank' END AS category, p_size + 0.5::DOUBLE AS max_price, 'USD' AS budget_currency, p_size::BIGINT AS power_w FROM part",
    "r02_address_cancel_flags": "SELECT o_orderkey, o_orderkey % 4 = 0 AS address_change, o_orderkey % 4 = 1 AS explicit_cancel FROM orders",
    "r10_advice_guard": "SELECT o_orderkey, o_orderkey % 4 IN (0, 1) AS refuse FROM orders",
    "x23_extract_financial_values": f"WITH {_LN} SELECT id, l_partkey, CASE k WHEN 0 THEN q || '万元' WHEN 1 THEN '(' || q || '.5)亿元' WHEN 2 THEN '1,' || lpad(q::VARCHAR, 3, '0') || '元' ELSE q::VARCHAR END AS text, CASE k WHEN 0 THEN q * 10000 WHEN 1 THEN -(q + 0.5) * 100000000 WHEN 2 THEN 1000 + q ELSE q END::DOUBLE AS amount, CASE k WHEN 0 THEN q / 100.0::DOUBLE WHEN 1 THEN q WHEN 2 THEN q END::DOUBLE AS points FROM k",
    "x25_row_strict_match": "SELECT doc_id AS case_id, doc_id % 2 = 0 AS matched FROM documents",
    "v04_verify_facts": "SELECT p_partkey AS answer_id, CASE WHEN p_partkey % 11 = 0 THEN 'unknown_citation,unsupported_fact' WHEN p_partkey % 5 = 0 THEN 'unsupported_fact' ELSE '' END AS errors FROM part",
    "v08_render_verified": f"WITH {_PRODUCTS} SELECT id, sku || ': stock ' || stock || ' [C' || (id % 3 + 1) || ']' AS sentence FROM products",
    "x18_page_route": f"WITH {_PG}, c AS (SELECT doc, page_number, row_number() OVER (PARTITION BY doc ORDER BY (NOT title)::INT, numeric_ratio DESC, page_number) > 10 AS dropped FROM nb WHERE near_title OR title OR numeric_page OR low_text) SELECT doc, CASE WHEN dropped THEN 'dropped' WHEN page_number % 3 <> 0 AND page_number % 2 = 0 THEN 'tables' ELSE 'degraded' END AS route, count(*) AS n FROM c GROUP BY 1, 2",
    "a33_rag_eval": f"WITH k AS (SELECT lang, CASE WHEN doc_id % 3 <> 0 THEN (doc_id % 2 = 0)::INT::DOUBLE END AS h, (n_chars > 1000)::INT::DOUBLE AS m FROM documents), b AS (SELECT * FROM k UNION ALL SELECT 'overall', h, m FROM k) SELECT lang, {_r('avg(h)', 6)} AS retrieval_hit, {_r('avg(m)', 6)} AS keyword_match FROM b GROUP BY 1",
}
