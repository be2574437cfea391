"""Queries on facts and orders, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import commerce, metrics, scope
from millrace.sources import facts

_MARKETS = """m AS (SELECT n_nationkey AS nk, CAST(n_nationkey AS VARCHAR) AS shop_id, r_name AS platform, n_name AS marketplace, 'UTC' AS timezone,
  ['USD','GBP','SGD','EUR','JPY'][n_regionkey + 1] AS currency FROM nation JOIN region ON n_regionkey = r_regionkey)"""
_SALES = _MARKETS + """, sales AS (SELECT l_orderkey * 10 + l_linenumber AS id, shop_id, platform, marketplace, timezone, currency, CAST(l_shipdate AS DATE) AS order_date, CAST(l_partkey AS VARCHAR) AS sku, p_name AS product_name,
  CAST(l_quantity AS INT) AS units_sold, CAST(l_extendedprice AS DECIMAL(18,2)) AS gross_sales,
  CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END AS refunds,
  CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(18,2)), 2) AS DECIMAL(18,2)) AS platform_fees,
  CAST(round(CAST(l_quantity AS DECIMAL(10,0)) * CAST(p_retailprice AS DECIMAL(14,2)) * CAST(0.25 AS DECIMAL(3,2)), 2) AS DECIMAL(18,2)) AS cogs
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN m ON s_nationkey = nk)"""
_ADS = _MARKETS + """, ev AS (SELECT CAST(ts AS DATE) AS report_date, CAST(user_id % 25 AS INT) AS k, count(*) FILTER (event_type = 'view') AS impressions, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'purchase') AS attributed_orders,
  coalesce(sum(CAST(value AS DECIMAL(18,2))) FILTER (event_type = 'click'), 0) AS ad_spend, coalesce(sum(CAST(value AS DECIMAL(18,2))) FILTER (event_type = 'purchase'), 0) AS attributed_sales,
  coalesce(sum(CAST(value AS DECIMAL(18,2))) FILTER (event_type = 'error'), 0) AS attributed_refunds FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL),
ads AS (SELECT m.*, ev.*, CAST(round(CAST(attributed_sales AS DECIMAL(18,2)) * CAST(0.10 AS DECIMAL(3,2)), 2) AS DECIMAL(18,2)) AS attributed_platform_fees, CAST(round(CAST(attributed_sales AS DECIMAL(18,2)) * CAST(0.40 AS DECIMAL(3,2)), 2) AS DECIMAL(18,2)) AS attributed_cogs FROM ev JOIN m ON k = nk)"""
_INVENTORY = _MARKETS + """, last AS (SELECT max(CAST(l_shipdate AS DATE)) AS last_day FROM lineitem),
sold AS (SELECT l_partkey, sum(CAST(l_quantity AS INT)) AS sold FROM lineitem, last WHERE CAST(l_shipdate AS DATE) > last_day - 30 GROUP BY 1),
inv AS (SELECT m.*, last_day AS snapshot_date, CAST(p_partkey AS VARCHAR) AS sku, p_name AS product_name, CASE WHEN p_size % 10 = 0 THEN NULL WHEN p_size % 10 = 1 THEN 0 ELSE p_size END AS on_hand_units,
  CASE WHEN p_size % 7 = 0 THEN 0.0::DOUBLE ELSE p_size * 1.5::DOUBLE END AS average_inventory_units_30d, coalesce(sold, 0) AS trailing_30d_units_sold
  FROM part LEFT JOIN sold ON p_partkey = l_partkey CROSS JOIN last JOIN m ON p_partkey % 25 = nk)"""
_PRICES = _MARKETS + """, brand AS (SELECT p_brand AS b, CAST(CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) / count(p_retailprice) AS DECIMAL(38,10)) AS avg_price FROM part GROUP BY 1),
prices AS (SELECT m.*, '1998-12-01T00:00:00+00:00' AS observed_at, CAST(p_partkey AS VARCHAR) AS sku, p_name AS product_name, CAST(p_retailprice AS DECIMAL(18,2)) AS own_price, p_brand AS competitor_name,
  CAST(CASE WHEN p_size % 11 = 0 THEN 0 ELSE round(avg_price, 2) END AS DECIMAL(18,2)) AS competitor_price FROM part JOIN brand ON p_brand = b JOIN m ON p_partkey % 25 = nk)"""
_PRODUCTS = """products AS (SELECT p_partkey AS id, CAST(p_partkey % 25 AS VARCHAR) AS shop_id, 'SKU-' || p_partkey AS sku, p_name AS name, lower(p_type) AS category, CAST(p_retailprice AS DECIMAL(12,2)) AS price, greatest(p_size - 5, 0) AS stock, p_size, p_brand, p_size <> 13 AS is_active,
  '{"power_w":' || p_size || ',"brand":"' || p_brand || '"}' AS specifications FROM part)"""
_ORDERS = """ord AS (SELECT o_orderkey AS id, CAST(c_nationkey AS VARCHAR) AS shop_id, 'VLT-' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS order_no, o_custkey AS user_id,
  CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'paid' ELSE 'processing' END AS status, CAST(o_totalprice AS DECIMAL(12,2)) AS total_amount, o_orderdate AS created_at FROM orders JOIN customer ON o_custkey = c_custkey)"""
_SHIPMENTS = """ship AS (SELECT l_orderkey AS order_id, CASE WHEN min(l_linestatus) = 'F' THEN 'delivered' ELSE 'in_transit' END AS shipment_status, CASE WHEN max(l_returnflag) = 'R' THEN 'damaged' ELSE 'none' END AS exception_type, max(l_shipdate) AS eta FROM lineitem WHERE l_orderkey % 7 <> 0 GROUP BY 1)"""


def _r(x: str, n: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,10)), {n}) AS DOUBLE)"


def _plain(df):
    """Dates as text, decimals as doubles and counts as longs: what both engines print alike."""
    out = []
    for c, kind in df.dtypes:
        x = F.col(c)
        out.append((x.cast("double") if kind.startswith("decimal") else x.cast("string") if kind == "date" else x.cast("long") if kind in ("int", "smallint", "tinyint") else F.date_format(x, "yyyy-MM-dd HH:mm:ss") if kind == "timestamp" else x).alias(c))
    return df.select(*out)


def _sales(s, d):
    return facts.sales_records(s, d)


def fact_scan(s, d):
    return _plain(_sales(s, d))


def contract_check(s, d):
    got = None
    made = {"sales_records": facts.sales_records(s, d), "ad_performance": facts.ad_performance(s, d), "inventory_snapshots": facts.inventory_snapshots(s, d), "competitor_prices": facts.competitor_prices(s, d)}
    for name, rows in made.items():
        missing = sorted(set(facts.CONTRACT[name]) - set(rows.columns))
        one = rows.agg(F.lit(name).alias("table_name"), F.lit(",".join(missing)).alias("missing_columns"), F.count(F.lit(1)).alias("n_rows")).withColumn("ok", (F.col("missing_columns") == "") & (F.col("n_rows") > 0))
        got = one if got is None else got.unionByName(one)
    return got


def preview(s, d):
    return _plain(scope.preview(_sales(s, d), "3", 100, ["id"]).select("id", "shop_id", "sku", "units_sold", "gross_sales"))


def shop_scope(s, d):
    return _plain(scope.shop_scope(_sales(s, d), "7").select("id", "marketplace", "currency", "sku", "gross_sales"))


def adhoc_join(s, d):
    tables = {"sales_records": facts.sales_records(s, d), "inventory_snapshots": facts.inventory_snapshots(s, d)}
    sql = "SELECT s.sku, sum(s.units_sold) AS units, max(i.on_hand_units) AS on_hand FROM sales_records s JOIN inventory_snapshots i ON s.sku = i.sku GROUP BY s.sku"
    return scope.read_only_sql(s, tables, "4", sql, 2**31 - 1).select("sku", F.col("units").cast("long").alias("units"), F.col("on_hand").cast("long").alias("on_hand"))


def adhoc_union(s, d):
    tables = {"sales_records": facts.sales_records(s, d), "competitor_prices": facts.competitor_prices(s, d)}
    return scope.read_only_sql(s, tables, "5", "SELECT sku FROM sales_records UNION SELECT sku FROM competitor_prices", 2**31 - 1)


def adhoc_money(s, d):
    """User SQL on a shop's money that stays within market and currency, through a common table expression, a renamed column and a rank."""
    sql = """WITH base AS (SELECT marketplace AS m, currency, sku, gross_sales - refunds AS net FROM sales_records),
    total AS (SELECT m, currency, sku, sum(net) AS net, count(*) AS n FROM base GROUP BY m, currency, sku)
    SELECT m AS marketplace, currency, sku, CAST(net AS DOUBLE) AS net, n, rank() OVER (PARTITION BY m, currency ORDER BY net DESC) AS position FROM total"""
    rows = facts.sales_records(s, d)
    return scope.read_only_sql(s, {"sales_records": rows}, "6", sql, 2**31 - 1).withColumn("position", F.col("position").cast("long"))


def money_by_market(s, d):
    net = F.sum("gross_sales").cast("double")
    return _sales(s, d).groupBy("marketplace", "currency").agg(net.alias("gross_sales"), F.count(F.lit(1)).alias("n"))


def ad_efficiency(s, d):
    return _plain(metrics.ad_efficiency(facts.ad_performance(s, d)))


def product_contribution(s, d):
    return _plain(metrics.product_contribution(_sales(s, d)))


def contribution_rank(s, d):
    return _plain(metrics.contribution_rank(metrics.product_contribution(_sales(s, d))))


def inventory_turnover(s, d):
    return _plain(metrics.inventory_turnover(facts.inventory_snapshots(s, d)))


def price_gap(s, d):
    return _plain(metrics.price_gap(facts.competitor_prices(s, d)))


def result_scope(s, d):
    return metrics.result_scope(_sales(s, d), ("order_date", "report_date"))


def trend_direction(s, d):
    return metrics.trend_direction(metrics.ad_efficiency(facts.ad_performance(s, d)), ["marketplace", "currency"], "report_date", "roas")


def inventory_summary(s, d):
    return metrics.inventory_summary(metrics.inventory_turnover(facts.inventory_snapshots(s, d)))


def top_n_others(s, d):
    c = metrics.product_contribution(_sales(s, d)).groupBy("marketplace", "currency", "sku").agg(F.sum("operating_contribution").alias("value"))
    return _plain(metrics.top_n_others(c, ["marketplace", "currency"], "sku", "value", other="other"))


def catalog_search(s, d):
    return _plain(commerce.catalog_search(facts.products(s, d), keyword="brand#1", max_price=1500).select("id", "shop_id", "sku", "price", "stock"))


def spec_filter(s, d):
    return _plain(commerce.spec_filter(facts.products(s, d).where("is_active"), "power_w", 20).select("shop_id", "sku", "position"))


def get_by_sku(s, d):
    return _plain(commerce.get_by_sku(facts.products(s, d), "10", "SKU-10").select("id", "sku", "name", "price"))


def owned_rows(s, d):
    return _plain(facts.orders(s, d).where((F.col("shop_id") == "3") & (F.col("user_id") % 5 == 0)).orderBy(F.desc("created_at"), F.desc("id")).select("id", "user_id", "created_at"))


def order_aggregate(s, d):
    got = commerce.order_aggregate(facts.orders(s, d), facts.order_items(s, d), facts.products(s, d))
    text = F.array_join(F.transform("items", lambda i: F.concat_ws(":", i["product_sku"], i["quantity"].cast("string"))), ",")
    return got.select("order_no", F.size("items").cast("long").alias("n_items"), text.alias("items"))


def order_shipment(s, d):
    return _plain(commerce.order_shipment(facts.orders(s, d), facts.shipments(s, d)).select("order_no", "status", "shipment_status", "exception_type"))


def order_status(s, d):
    return commerce.order_status(facts.orders(s, d), facts.shipments(s, d), F.lit("UTC")).select("order_no", "status", "shipment_status", "local_eta")


def orphans(s, d):
    """Over every order."""
    o = facts.table(s, d, "customer").select("c_custkey", "c_nationkey")
    return commerce.orphans(o, facts.table(s, d, "orders"), "c_custkey", "o_custkey").select("c_custkey")


def owner_mismatch(s, d):
    o = facts.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 50).alias("datasource_id"), F.lit("3").alias("shop_id"))
    users = facts.table(s, d, "customer").where("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("shop_id"))
    sources = facts.table(s, d, "supplier").where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("user_id"), F.col("s_nationkey").cast("string").alias("shop_id"))
    return commerce.owner_mismatch(o, users, sources).select("id", "user_id")


def backfill_owner(s, d):
    o = facts.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.when(F.col("o_orderkey") % 2 == 0, "known").alias("shop_id"))
    return commerce.backfill_owner(o, facts.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("shop_id")), "user_id").select("id", "shop_id")


def search_topk(s, d):
    return _plain(commerce.search_topk(commerce.catalog_search(facts.products(s, d)), 50).select("id", "sku", "price"))


def orders_recent(s, d):
    return _plain(commerce.recent(facts.orders(s, d), ["user_id"], 3).select("user_id", "id", "position"))


def recent_history(s, d):
    c = facts.table(s, d, "conversations").where("conv_id is not null")
    return _plain(commerce.ranked(c, ["conv_id"], [F.desc("turn")], 10).select("conv_id", "turn", "position"))


QUERIES = {
    "s01_fact_scan": fact_scan, "s04_contract_check": contract_check, "s05_preview": preview, "p01_shop_scope": shop_scope, "p04_money_policy": money_by_market, "p04_adhoc_money": adhoc_money, "j07_adhoc_join": adhoc_join, "u01_adhoc_union": adhoc_union,
    "a01_ad_efficiency": ad_efficiency, "a02_product_contribution": product_contribution, "w01_contribution_rank": contribution_rank, "a03_inventory_turnover": inventory_turnover, "a04_price_gap": price_gap, "a05_result_scope": result_scope,
    "a06_trend_direction": trend_direction, "a07_inventory_summary": inventory_summary, "a08_top_n_others": top_n_others, "p05_catalog_search": catalog_search, "p06_spec_filter": spec_filter, "p07_get_by_sku": get_by_sku, "p08_owned_rows": owned_rows,
    "j01_order_aggregate": order_aggregate, "j02_order_shipment": order_shipment, "j03_order_status": order_status, "j04_orphans": orphans, "j05_owner_mismatch": owner_mismatch, "j06_backfill_owner": backfill_owner,
    "t01_search_topk": search_topk, "t02_orders_recent": orders_recent, "w14_recent_history": recent_history,
}

_CONTRIB = _SALES + """, c AS (SELECT platform, marketplace, timezone, currency, sku, product_name, min(order_date) AS period_start, max(order_date) AS period_end, sum(units_sold) AS units_sold, sum(gross_sales - refunds - platform_fees - cogs) AS oc FROM sales GROUP BY ALL)"""
_TURN = _INVENTORY + f""", turn AS (SELECT *, CASE WHEN on_hand_units IS NULL THEN NULL WHEN on_hand_units = 0 THEN 1 ELSE 0 END AS is_stockout, CASE WHEN on_hand_units IS NULL THEN 1 ELSE 0 END AS is_inventory_unknown,
  CASE WHEN NOT (trailing_30d_units_sold = 0 OR average_inventory_units_30d = 0) THEN {_r('CAST(trailing_30d_units_sold AS DOUBLE) / average_inventory_units_30d', 4)} END AS rate,
  CASE WHEN NOT (trailing_30d_units_sold = 0 OR average_inventory_units_30d = 0) THEN {_r('30.0::DOUBLE * average_inventory_units_30d / CAST(trailing_30d_units_sold AS DOUBLE)', 2)} END AS days FROM inv)"""
_ROAS = _ADS + f""", eff AS (SELECT report_date, platform, marketplace, timezone, currency,
  {_r('CAST(sum(attributed_sales) AS DOUBLE) / nullif(CAST(sum(ad_spend) AS DOUBLE), 0)', 4)} AS roas,
  {_r('CAST(sum(attributed_sales) - sum(attributed_refunds) - sum(attributed_platform_fees) - sum(attributed_cogs) - sum(ad_spend) AS DOUBLE) / nullif(CAST(sum(ad_spend) AS DOUBLE), 0)', 4)} AS ad_roi FROM ads GROUP BY report_date, platform, marketplace, timezone, currency)"""

SQL = {
    "s01_fact_scan": f"WITH {_SALES} SELECT id, shop_id, platform, marketplace, timezone, currency, CAST(order_date AS VARCHAR) AS order_date, sku, product_name, units_sold::BIGINT AS units_sold, gross_sales::DOUBLE AS gross_sales, refunds::DOUBLE AS refunds, platform_fees::DOUBLE AS platform_fees, cogs::DOUBLE AS cogs FROM sales",
    "s04_contract_check": f"WITH {_SALES}, " + _ADS.split(", ev AS", 1)[1].join(["ev AS", ""]) + ", " + _INVENTORY.split(", last AS", 1)[1].join(["last AS", ""]) + ", " + _PRICES.split(", brand AS", 1)[1].join(["brand AS", ""])
    + " SELECT table_name, '' AS missing_columns, n_rows, n_rows > 0 AS ok FROM (SELECT 'sales_records' AS table_name, count(*) AS n_rows FROM sales UNION ALL SELECT 'ad_performance', count(*) FROM ads UNION ALL SELECT 'inventory_snapshots', count(*) FROM inv UNION ALL SELECT 'competitor_prices', count(*) FROM prices)",
    "s05_preview": f"WITH {_SALES} SELECT id, shop_id, sku, units_sold::BIGINT AS units_sold, gross_sales::DOUBLE AS gross_sales FROM sales WHERE shop_id = '3' ORDER BY id LIMIT 100",
    "p01_shop_scope": f"WITH {_SALES} SELECT id, marketplace, currency, sku, gross_sales::DOUBLE AS gross_sales FROM sales WHERE shop_id = '7'",
    "p04_money_policy": f"WITH {_SALES} SELECT marketplace, currency, sum(gross_sales)::DOUBLE AS gross_sales, count(*) AS n FROM sales GROUP BY ALL",
    "p04_adhoc_money": f"WITH {_SALES}, t AS (SELECT marketplace, currency, sku, sum(gross_sales - refunds) AS net, count(*) AS n FROM sales WHERE shop_id = '6' GROUP BY ALL) SELECT marketplace, currency, sku, net::DOUBLE AS net, n, rank() OVER (PARTITION BY marketplace, currency ORDER BY net DESC) AS position FROM t",
    "j07_adhoc_join": f"WITH {_SALES}, " + _INVENTORY.split(", last AS", 1)[1].join(["last AS", ""]) + " SELECT s.sku, sum(s.units_sold)::BIGINT AS units, max(i.on_hand_units)::BIGINT AS on_hand FROM sales s JOIN inv i ON s.sku = i.sku WHERE s.shop_id = '4' AND i.shop_id = '4' GROUP BY s.sku",
    "u01_adhoc_union": f"WITH {_SALES}, " + _PRICES.split(", brand AS", 1)[1].join(["brand AS", ""]) + " SELECT sku FROM sales WHERE shop_id = '5' UNION SELECT sku FROM prices WHERE shop_id = '5'",
    "a01_ad_efficiency": f"WITH {_ROAS} SELECT CAST(report_date AS VARCHAR) AS report_date, platform, marketplace, timezone, currency, roas, ad_roi FROM eff",
    "a02_product_contribution": f"WITH {_CONTRIB} SELECT platform, marketplace, timezone, currency, sku, product_name, CAST(period_start AS VARCHAR) AS period_start, CAST(period_end AS VARCHAR) AS period_end, units_sold::BIGINT AS units_sold, oc::DOUBLE AS operating_contribution FROM c",
    "w01_contribution_rank": f"WITH {_CONTRIB} SELECT platform, marketplace, timezone, currency, sku, product_name, CAST(period_start AS VARCHAR) AS period_start, CAST(period_end AS VARCHAR) AS period_end, units_sold::BIGINT AS units_sold, oc::DOUBLE AS operating_contribution, rank() OVER (PARTITION BY marketplace, currency ORDER BY oc DESC) AS contribution_rank FROM c",
    "a03_inventory_turnover": f"WITH {_TURN} SELECT CAST(snapshot_date AS VARCHAR) AS snapshot_date, platform, marketplace, timezone, currency, sku, product_name, on_hand_units::BIGINT AS on_hand_units, is_stockout::BIGINT AS is_stockout, is_inventory_unknown::BIGINT AS is_inventory_unknown, rate AS inventory_turnover_rate_30d, days AS inventory_turnover_days FROM turn",
    "a04_price_gap": f"WITH {_PRICES} SELECT observed_at, platform, marketplace, timezone, currency, sku, product_name, competitor_name, own_price::DOUBLE AS own_price, competitor_price::DOUBLE AS competitor_price, (own_price - competitor_price)::DOUBLE AS price_gap, {_r('CAST(own_price - competitor_price AS DOUBLE) / nullif(CAST(competitor_price AS DOUBLE), 0)', 4)} AS price_gap_rate FROM prices",
    "a05_result_scope": f"WITH {_SALES} SELECT array_to_string(list_sort(list(DISTINCT marketplace)), ',') AS marketplaces, array_to_string(list_sort(list(DISTINCT currency)), ',') AS currencies, array_to_string(list_sort(list(DISTINCT timezone)), ',') AS timezones, CAST(min(order_date) AS VARCHAR) AS first_time, CAST(max(order_date) AS VARCHAR) AS last_time FROM sales",
    "a06_trend_direction": f"WITH {_ROAS}, e AS (SELECT marketplace, currency, min_by(roas, report_date) AS first_value, max_by(roas, report_date) AS last_value FROM eff WHERE roas IS NOT NULL GROUP BY ALL) SELECT *, CASE WHEN last_value > first_value THEN 'up' WHEN last_value < first_value THEN 'down' ELSE 'flat' END AS direction FROM e",
    "a07_inventory_summary": f"WITH {_TURN}, r AS (SELECT *, row_number() OVER (PARTITION BY marketplace, currency ORDER BY days NULLS LAST, sku) AS rn FROM turn) SELECT marketplace, currency, max(CASE WHEN rn = 1 AND days IS NOT NULL THEN sku END) AS fastest_sku, min(days) AS fastest_days, count(*) FILTER (on_hand_units = 0) AS stockouts, count(*) FILTER (on_hand_units IS NULL) AS unknown_stock FROM r GROUP BY 1, 2",
    "a08_top_n_others": f"WITH {_CONTRIB}, v AS (SELECT marketplace, currency, sku, sum(oc) AS value FROM c GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY marketplace, currency ORDER BY value DESC NULLS LAST, sku) AS rn, count(*) OVER (PARTITION BY marketplace, currency) AS n FROM v) SELECT marketplace, currency, CASE WHEN n > 30 AND rn >= 30 THEN 'other' ELSE sku END AS sku, CASE WHEN n > 30 AND rn >= 30 THEN 30 ELSE rn END::BIGINT AS position, sum(value)::DOUBLE AS value FROM k GROUP BY 1, 2, 3, 4",
    "p05_catalog_search": f"WITH {_PRODUCTS} SELECT id, shop_id, sku, price::DOUBLE AS price, stock::BIGINT AS stock FROM products WHERE is_active AND stock > 0 AND price <= 1500 AND (contains(lower(name), 'brand#1') OR contains(lower(sku), 'brand#1') OR contains(lower(specifications), 'brand#1'))",
    "p06_spec_filter": f"WITH {_PRODUCTS}, k AS (SELECT *, row_number() OVER (PARTITION BY shop_id ORDER BY price, id) AS position FROM products WHERE is_active) SELECT shop_id, sku, position FROM k WHERE position <= 50 AND p_size = 20",
    "p07_get_by_sku": f"WITH {_PRODUCTS} SELECT id, sku, name, price::DOUBLE AS price FROM products WHERE shop_id = '10' AND sku = 'SKU-10' AND is_active",
    "p08_owned_rows": f"WITH {_ORDERS} SELECT id, user_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM ord WHERE shop_id = '3' AND user_id % 5 = 0",
    "j01_order_aggregate": f"WITH {_ORDERS} SELECT order_no, count(*) AS n_items, string_agg('SKU-' || l_partkey || ':' || CAST(l_quantity AS INT), ',' ORDER BY l_orderkey * 10 + l_linenumber, 'SKU-' || l_partkey, p_name, CAST(l_quantity AS INT)) AS items FROM ord JOIN lineitem ON id = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY order_no",
    "j02_order_shipment": f"WITH {_ORDERS}, {_SHIPMENTS} SELECT order_no, status, shipment_status, exception_type FROM ord JOIN ship ON id = order_id",
    "j03_order_status": f"WITH {_ORDERS}, {_SHIPMENTS} SELECT order_no, status, shipment_status, strftime(eta, '%Y-%m-%d %H:%M:%S') AS local_eta FROM ord LEFT JOIN ship ON id = order_id",
    "j04_orphans": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "j05_owner_mismatch": "SELECT o_orderkey AS id, o_custkey AS user_id FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 9 <> 0 LEFT JOIN supplier ON s_suppkey = o_orderkey % 50 AND s_suppkey % 4 <> 0 WHERE c_custkey IS NULL OR s_suppkey IS NULL OR c_nationkey <> 3 OR s_suppkey <> o_custkey OR s_nationkey <> 3",
    "j06_backfill_owner": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'known' ELSE CAST(c_nationkey AS VARCHAR) END AS shop_id FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
    "t01_search_topk": f"WITH {_PRODUCTS} SELECT id, sku, price::DOUBLE AS price FROM products WHERE is_active AND stock > 0 ORDER BY price, id LIMIT 50",
    "t02_orders_recent": f"WITH {_ORDERS} SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS position FROM ord QUALIFY position <= 3",
    "w14_recent_history": "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS position FROM conversations WHERE conv_id IS NOT NULL QUALIFY position <= 10",
}
