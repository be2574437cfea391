"""Business metrics. Money never crosses (marketplace, currency); ratios with a zero base are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rounded(x: Column, digits: int) -> Column:
    """Half-up rounding of the decimal form, as a double."""
    return F.round(x.cast("decimal(38,10)"), digits).cast("double")


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def ad_efficiency(ads: DataFrame) -> DataFrame:
    """Return on ad spend and advertising ROI by day, platform, market and currency."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    cost = s("ad_spend")
    net = s("attributed_sales") - s("attributed_refunds") - s("attributed_platform_fees") - s("attributed_cogs") - cost
    return ads.groupBy("report_date", "platform", "marketplace", "timezone", "currency").agg(rounded(ratio(s("attributed_sales"), cost), 4).alias("roas"), rounded(ratio(net, cost), 4).alias("ad_roi"))


def product_contribution(sales: DataFrame) -> DataFrame:
    keys = ("platform", "marketplace", "timezone", "currency", "sku", "product_name")
    net = F.col("gross_sales") - F.col("refunds") - F.col("platform_fees") - F.col("cogs")
    return sales.groupBy(*keys).agg(F.min("order_date").alias("period_start"), F.max("order_date").alias("period_end"), F.sum("units_sold").alias("units_sold"), F.sum(net).alias("operating_contribution"))


def contribution_rank(contribution: DataFrame) -> DataFrame:
    w = Window.partitionBy("marketplace", "currency").orderBy(F.desc("operating_contribution"))
    return contribution.withColumn("contribution_rank", F.rank().over(w))


def inventory_turnover(inventory: DataFrame) -> DataFrame:
    sold, avg, on_hand = F.col("trailing_30d_units_sold"), F.col("average_inventory_units_30d"), F.col("on_hand_units")
    idle = (sold == 0) | (avg == 0)
    return inventory.select(
        "snapshot_date", "platform", "marketplace", "timezone", "currency", "sku", "product_name", "on_hand_units",
        F.when(on_hand.isNull(), None).when(on_hand == 0, 1).otherwise(0).alias("is_stockout"), F.when(on_hand.isNull(), 1).otherwise(0).alias("is_inventory_unknown"),
        F.when(~idle, rounded(ratio(sold, avg), 4)).alias("inventory_turnover_rate_30d"), F.when(~idle, rounded(ratio(30.0 * avg, sold), 2)).alias("inventory_turnover_days"),
    )


def price_gap(prices: DataFrame) -> DataFrame:
    gap = F.col("own_price") - F.col("competitor_price")
    return prices.select("observed_at", "platform", "marketplace", "timezone", "currency", "sku", "product_name", "competitor_name", "own_price", "competitor_price", gap.alias("price_gap"), rounded(ratio(gap, F.col("competitor_price")), 4).alias("price_gap_rate"))


def result_scope(rows: DataFrame, time_columns: tuple[str, ...]) -> DataFrame:
    """Distinct markets, currencies and zones of a result, blanks left out, and its first and last time."""
    there = [c for c in time_columns if c in rows.columns]
    names = lambda c: F.array_join(F.sort_array(F.collect_set(F.when(F.trim(c) != "", F.col(c)))), ",")
    low, high = (f(*[g(F.col(c).cast("string")) for c in there]) if len(there) > 1 else g(F.col(there[0]).cast("string")) for f, g in ((F.least, F.min), (F.greatest, F.max)))
    return rows.agg(names("marketplace").alias("marketplaces"), names("currency").alias("currencies"), names("timezone").alias("timezones"), low.alias("first_time"), high.alias("last_time"))


def trend_direction(series: DataFrame, keys: list[str], time: str, metric: str) -> DataFrame:
    """First and last metric of each series and whether it rose, fell or stayed; missing values are left out."""
    ends = series.where(F.col(metric).isNotNull()).groupBy(*keys).agg(F.min_by(metric, time).alias("first_value"), F.max_by(metric, time).alias("last_value"))
    return ends.withColumn("direction", F.when(F.col("last_value") > F.col("first_value"), "up").when(F.col("last_value") < F.col("first_value"), "down").otherwise("flat"))


def inventory_summary(turnover: DataFrame) -> DataFrame:
    """Per market: the fastest product, and how many are out of stock or unknown."""
    days = F.col("inventory_turnover_days")
    return turnover.groupBy("marketplace", "currency").agg(
        F.min_by("sku", F.when(days.isNotNull(), F.struct(days, F.col("sku")))).alias("fastest_sku"), F.min(days).alias("fastest_days"),
        F.count(F.when(F.col("on_hand_units") == 0, 1)).alias("stockouts"), F.count(F.when(F.col("on_hand_units").isNull(), 1)).alias("unknown_stock"),
    )


def top_n_others(rows: DataFrame, keys: list[str], label: str, value: str, most: int = 30, other: str = "其他") -> DataFrame:
    """Within each key the most - 1 largest values and the rest as one row, where there are more than `most`. Null values rank last and count 0."""
    w = Window.partitionBy(*keys)
    ranked = rows.withColumn("__rn", F.row_number().over(w.orderBy(F.desc_nulls_last(value), label))).withColumn("__n", F.count(F.lit(1)).over(w))
    rest = (F.col("__n") > most) & (F.col("__rn") >= most)
    return ranked.groupBy(*keys, F.when(rest, F.lit(other)).otherwise(F.col(label)).alias(label), F.when(rest, most).otherwise(F.col("__rn")).alias("position")).agg(F.coalesce(F.sum(value), F.lit(0)).alias(value))
