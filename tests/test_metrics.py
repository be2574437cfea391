from decimal import Decimal

from millrace.operators import metrics


def test_zero_spend_has_no_ratio(spark):
    rows = [("d1", "p", "US", "UTC", "USD", Decimal("10.00"), Decimal("0.00"), Decimal("0.00"), Decimal("0.00"), Decimal("0.00")), ("d2", "p", "US", "UTC", "USD", Decimal("10.00"), Decimal("4.00"), Decimal("1.00"), Decimal("1.00"), Decimal("2.00"))]
    names = "report_date string, platform string, marketplace string, timezone string, currency string, attributed_sales decimal(18,2), ad_spend decimal(18,2), attributed_refunds decimal(18,2), attributed_platform_fees decimal(18,2), attributed_cogs decimal(18,2)"
    got = {r.report_date: r for r in metrics.ad_efficiency(spark.createDataFrame(rows, names)).collect()}
    assert got["d1"].roas is None and got["d1"].ad_roi is None
    assert (got["d2"].roas, got["d2"].ad_roi) == (2.5, 0.5)


def test_unknown_stock_is_not_stockout(spark):
    names = "snapshot_date string, platform string, marketplace string, timezone string, currency string, sku string, product_name string, on_hand_units int, average_inventory_units_30d double, trailing_30d_units_sold long"
    rows = [("d", "p", "US", "UTC", "USD", sku, "n", hand, avg, sold) for sku, hand, avg, sold in (("a", None, 10.0, 5), ("b", 0, 10.0, 20), ("c", 9, 0.0, 5), ("d", 9, 10.0, 0))]
    got = {r.sku: r for r in metrics.inventory_turnover(spark.createDataFrame(rows, names)).collect()}
    assert (got["a"].is_stockout, got["a"].is_inventory_unknown) == (None, 1)
    assert (got["b"].is_stockout, got["b"].inventory_turnover_rate_30d, got["b"].inventory_turnover_days) == (1, 2.0, 15.0)
    assert got["c"].inventory_turnover_days is None and got["d"].inventory_turnover_rate_30d is None


def test_others_only_beyond_the_most(spark):
    rows = [("k", f"s{i}", float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, sku string, v double")
    assert metrics.top_n_others(df, ["k"], "sku", "v", most=5).count() == 5
    got = {r.sku: r.v for r in metrics.top_n_others(df, ["k"], "sku", "v", most=3, other="rest").collect()}
    assert got == {"s4": 4.0, "s3": 3.0, "rest": 3.0}
