"""Catalog search, order and shipment lookups, ownership audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def catalog_search(products: DataFrame, shop_id: str | None = None, keyword: str | None = None, category: str | None = None, max_price=None, in_stock_only: bool = True) -> DataFrame:
    """Active products; keyword is looked for in name, sku and specifications whatever the case."""
    rows = products.where(F.col("is_active"))
    if shop_id is not None:
        rows = rows.where(F.col("shop_id") == shop_id)
    if keyword:
        text = keyword.lower()
        rows = rows.where(F.lower("name").contains(text) | F.lower("sku").contains(text) | F.lower("specifications").contains(text))
    if category:
        rows = rows.where(F.lower("category") == category.lower())
    if max_price is not None:
        rows = rows.where(F.col("price") <= F.lit(max_price).cast("decimal(12,2)"))
    return rows.where(F.col("stock") > 0) if in_stock_only else rows


def ranked(rows: DataFrame, keys: list[str], order: list[Column], most: int, name: str = "position") -> DataFrame:
    """The first `most` rows of each key, numbered."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(w)).where(F.col(name) <= most)


def spec_filter(rows: DataFrame, attribute: str, value: int, pre_cut: int = 50) -> DataFrame:
    """Per shop the first pre_cut rows by price and id, then those whose JSON attribute equals value."""
    cut = ranked(rows, ["shop_id"], [F.col("price"), F.col("id")], pre_cut)
    return cut.where(F.get_json_object("specifications", f"$.{attribute}").cast("int") == value)


def get_by_sku(products: DataFrame, shop_id: str, sku: str) -> DataFrame:
    return products.where((F.col("shop_id") == shop_id) & (F.col("sku") == sku) & F.col("is_active"))


def search_topk(rows: DataFrame, limit: int) -> DataFrame:
    return rows.orderBy("price", "id").limit(max(1, min(limit, 50)))


def order_aggregate(orders: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """Orders with their items nested in item order, and product name and sku on each."""
    p = products.select(F.col("id").alias("pid"), F.col("sku").alias("product_sku"), F.col("name").alias("product_name"))
    lines = items.join(p, items["product_id"] == p["pid"]).groupBy("order_id").agg(F.sort_array(F.collect_list(F.struct("id", "product_sku", "product_name", "quantity", "unit_price"))).alias("items"))
    return orders.join(lines, orders["id"] == lines["order_id"]).drop("order_id")


def order_shipment(orders: DataFrame, shipments: DataFrame) -> DataFrame:
    s = shipments.select("order_id", F.col("status").alias("shipment_status"), "exception_type", "estimated_delivery_at")
    return orders.join(s, orders["id"] == s["order_id"]).drop("order_id")


def order_status(orders: DataFrame, shipments: DataFrame, zone: Column) -> DataFrame:
    """Orders with their shipment, if any; the expected delivery in the user's zone."""
    s = shipments.select("order_id", F.col("status").alias("shipment_status"), "exception_type", "estimated_delivery_at")
    out = orders.join(s, orders["id"] == s["order_id"], "left").drop("order_id")
    return out.withColumn("local_eta", F.date_format(F.from_utc_timestamp("estimated_delivery_at", zone), "yyyy-MM-dd HH:mm:ss"))


def orphans(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    p = parents.select(F.col(parent_key).alias("__k"))
    return rows.join(p, rows[key] == p["__k"], "left_anti")


def owner_mismatch(rows: DataFrame, users: DataFrame, sources: DataFrame) -> DataFrame:
    """rows(user_id, datasource_id, shop_id) whose user or data source is missing or belongs elsewhere."""
    u = users.select(F.col("id").alias("u_id"), F.col("shop_id").alias("u_shop"))
    d = sources.select(F.col("id").alias("d_id"), F.col("user_id").alias("d_user"), F.col("shop_id").alias("d_shop"))
    both = rows.join(u, rows["user_id"] == u["u_id"], "left").join(d, rows["datasource_id"] == d["d_id"], "left")
    wrong = F.col("u_id").isNull() | F.col("d_id").isNull() | ~F.col("u_shop").eqNullSafe(F.col("shop_id")) | ~F.col("d_user").eqNullSafe(F.col("user_id")) | ~F.col("d_shop").eqNullSafe(F.col("shop_id"))
    return both.where(wrong).drop("u_id", "u_shop", "d_id", "d_user", "d_shop")


def backfill_owner(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """shop_id from the parent where the row has none."""
    p = parents.select(F.col("id").alias("__k"), F.col("shop_id").alias("__shop"))
    return rows.join(p, rows[key] == p["__k"], "left").withColumn("shop_id", F.coalesce("shop_id", "__shop")).drop("__k", "__shop")


def recent(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    return ranked(rows, keys, [F.desc("created_at"), F.desc("id")], max(1, min(most, 100)))
