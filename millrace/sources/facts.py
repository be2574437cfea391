"""The four fact tables and the commerce tables, read by declared shape or projected from order data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = "decimal(18,2)"
SCOPE = ("shop_id", "platform", "marketplace", "timezone", "currency")
#: The columns each business table must have.
CONTRACT = {
    "sales_records": (*SCOPE, "order_date", "sku", "product_name", "units_sold", "gross_sales", "refunds", "platform_fees", "cogs"),
    "ad_performance": (*SCOPE, "report_date", "campaign_name", "sku", "impressions", "clicks", "ad_spend", "attributed_sales", "attributed_orders", "attributed_refunds", "attributed_platform_fees", "attributed_cogs"),
    "inventory_snapshots": (*SCOPE, "snapshot_date", "sku", "product_name", "on_hand_units", "average_inventory_units_30d", "inbound_units", "trailing_30d_units_sold", "unit_cost"),
    "competitor_prices": (*SCOPE, "observed_at", "sku", "product_name", "own_price", "competitor_name", "competitor_price"),
}
CURRENCIES = ("USD", "GBP", "SGD", "EUR", "JPY")
_TYPES = {"order_date": "date", "report_date": "date", "snapshot_date": "date", "observed_at": "string", "units_sold": "int", "impressions": "bigint", "clicks": "bigint", "attributed_orders": "bigint", "on_hand_units": "int", "inbound_units": "int", "trailing_30d_units_sold": "bigint", "average_inventory_units_30d": "double"}
_MONEY = {"gross_sales", "refunds", "platform_fees", "cogs", "ad_spend", "attributed_sales", "attributed_refunds", "attributed_platform_fees", "attributed_cogs", "unit_cost", "own_price", "competitor_price"}


def fact_schema(name: str) -> T.StructType:
    """Declared schema of a fact table; money is DECIMAL(18,2) and on_hand_units may be null."""
    cols = [f"{c} {MONEY if c in _MONEY else _TYPES.get(c, 'string')}" for c in CONTRACT[name]]
    return T.StructType.fromDDL(", ".join(["id bigint", *cols]))


def fact_scan(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(fact_schema(name)).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shop dimension: one row per nation, 25 rows."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    currency = F.get(F.array(*map(F.lit, CURRENCIES)), F.col("n_regionkey"))
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
        F.col("n_nationkey").alias("nk"), F.col("n_nationkey").cast("string").alias("shop_id"), F.col("r_name").alias("platform"), F.col("n_name").alias("marketplace"), F.lit("UTC").alias("timezone"), currency.alias("currency")
    )


def sales_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, part, supp = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    gross, units = F.col("l_extendedprice").cast(MONEY), F.col("l_quantity").cast("int")
    rows = li.join(part, li["l_partkey"] == part["p_partkey"]).join(supp, li["l_suppkey"] == supp["s_suppkey"]).join(_markets(spark, sf_dir), F.col("s_nationkey") == F.col("nk"))
    return rows.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), *SCOPE, F.col("l_shipdate").cast("date").alias("order_date"), F.col("l_partkey").cast("string").alias("sku"), F.col("p_name").alias("product_name"),
        units.alias("units_sold"), gross.alias("gross_sales"), F.when(F.col("l_returnflag") == "R", gross).otherwise(F.lit(0).cast(MONEY)).alias("refunds"),
        F.round(gross * F.col("l_tax").cast(MONEY), 2).cast(MONEY).alias("platform_fees"),
        F.round(units.cast("decimal(10,0)") * F.col("p_retailprice").cast(MONEY) * F.lit("0.25").cast("decimal(3,2)"), 2).cast(MONEY).alias("cogs"),
    )


def ad_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    money = F.col("value").cast(MONEY)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("event_type") == kind, money)), F.lit(0)).cast(MONEY)
    n = lambda kind: F.count(F.when(F.col("event_type") == kind, 1))
    rows = ev.where(F.col("user_id").isNotNull() & F.col("ts").isNotNull()).groupBy(F.col("ts").cast("date").alias("report_date"), (F.col("user_id") % 25).cast("int").alias("k")).agg(
        n("view").alias("impressions"), n("click").alias("clicks"), n("purchase").alias("attributed_orders"), of("click").alias("ad_spend"), of("purchase").alias("attributed_sales"), of("error").alias("attributed_refunds")
    )
    share = lambda x: F.round(F.col("attributed_sales") * F.lit(x).cast("decimal(3,2)"), 2).cast(MONEY)
    return rows.join(_markets(spark, sf_dir), F.col("k") == F.col("nk")).select(
        *SCOPE, "report_date", F.concat(F.lit("campaign-"), F.col("shop_id")).alias("campaign_name"), F.lit("all").alias("sku"), "impressions", "clicks", "ad_spend", "attributed_sales", "attributed_orders", "attributed_refunds",
        share("0.10").alias("attributed_platform_fees"), share("0.40").alias("attributed_cogs"),
    )


def inventory_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", F.col("l_shipdate").cast("date").alias("d"))
    last = li.agg(F.max("d").alias("last_day"))  # one row
    sold = li.join(F.broadcast(last)).where(F.col("d") > F.date_sub("last_day", 30)).groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast("int")).alias("sold"))
    size = F.col("p_size")
    rows = part.join(sold, part["p_partkey"] == sold["l_partkey"], "left").join(F.broadcast(last)).withColumn("k", (F.col("p_partkey") % 25).cast("int")).join(_markets(spark, sf_dir), F.col("k") == F.col("nk"))
    return rows.select(
        F.col("p_partkey").alias("id"), *SCOPE, F.col("last_day").alias("snapshot_date"), F.col("p_partkey").cast("string").alias("sku"), F.col("p_name").alias("product_name"),
        F.when(size % 10 == 0, None).when(size % 10 == 1, 0).otherwise(size).cast("int").alias("on_hand_units"), F.when(size % 7 == 0, 0.0).otherwise(size * 1.5).alias("average_inventory_units_30d"),
        (size % 4).alias("inbound_units"), F.coalesce("sold", F.lit(0)).alias("trailing_30d_units_sold"), F.col("p_retailprice").cast(MONEY).alias("unit_cost"),
    )


def competitor_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("own_price", F.col("p_retailprice").cast(MONEY))
    brand = part.groupBy(F.col("p_brand").alias("b")).agg((F.sum("own_price").cast("double") / F.count("own_price")).cast("decimal(38,10)").alias("avg_price"))
    rows = part.join(brand, part["p_brand"] == brand["b"]).withColumn("k", (F.col("p_partkey") % 25).cast("int")).join(_markets(spark, sf_dir), F.col("k") == F.col("nk"))
    price = F.when(F.col("p_size") % 11 == 0, F.lit(0)).otherwise(F.round("avg_price", 2)).cast(MONEY)
    return rows.select(*SCOPE, F.lit("1998-12-01T00:00:00+00:00").alias("observed_at"), F.col("p_partkey").cast("string").alias("sku"), F.col("p_name").alias("product_name"), "own_price", F.col("p_brand").alias("competitor_name"), price.alias("competitor_price"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("id"), (F.col("p_partkey") % 25).cast("string").alias("shop_id"), F.concat(F.lit("SKU-"), F.col("p_partkey")).alias("sku"), F.col("p_name").alias("name"), F.lower("p_type").alias("category"),
        F.col("p_retailprice").cast("decimal(12,2)").alias("price"), F.greatest(F.col("p_size") - 5, F.lit(0)).alias("stock"),
        F.to_json(F.struct(F.col("p_size").alias("power_w"), F.col("p_brand").alias("brand"))).alias("specifications"), (F.col("p_size") != 13).alias("is_active"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    status = F.when(F.col("o_orderstatus") == "F", "delivered").when(F.col("o_orderstatus") == "O", "paid").otherwise("processing")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.col("o_orderkey").alias("id"), F.col("c_nationkey").cast("string").alias("shop_id"), F.concat(F.lit("VLT-"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("order_no"), F.col("o_custkey").alias("user_id"),
        status.alias("status"), F.col("o_totalprice").cast("decimal(12,2)").alias("total_amount"), F.col("o_orderdate").alias("created_at"),
    )


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("int").alias("quantity"), F.col("l_extendedprice").cast("decimal(12,2)").alias("unit_price"))


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with a shipped line; every seventh order has none."""
    li = table(spark, sf_dir, "lineitem").where(F.col("l_orderkey") % 7 != 0)
    return li.groupBy(F.col("l_orderkey").alias("order_id")).agg(
        F.when(F.min("l_linestatus") == "F", "delivered").otherwise("in_transit").alias("status"), F.when(F.max("l_returnflag") == "R", "damaged").otherwise("none").alias("exception_type"), F.max("l_shipdate").alias("estimated_delivery_at")
    )
