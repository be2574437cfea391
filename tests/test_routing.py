import pytest
from pyspark.sql import functions as F

from millrace.operators import jobs, pages, retrieval, routing

CASES = [
    ("", "unsupported"), ("我想把订单寄到 北京路 12 号", "aftersales_handling"), ("please cancel my order", "aftersales_handling"), ("VLT-2024-0001 取消", "aftersales_handling"), ("今天的股票怎么样", "unsupported"),
    ("my charger arrived broken", "aftersales_handling"), ("where is my package", "logistics_tracking"), ("订单状态", "order_query"), ("recommend a power bank", "product_inquiry"), ("hello there", "unsupported"),
]


def test_routes(spark):
    rows = spark.createDataFrame(CASES, "message string, want string")
    assert [(r.message, r.want) for r in routing.route_messages(rows).collect() if r.route != r.want] == []


def test_keeping_an_order_is_no_cancellation(spark):
    rows = spark.createDataFrame([("不要显示订单号，但是订单请保留，不要取消订单",), ("取消订单",)], "message string")
    got = {r.message: r.explicit_cancel for r in routing.flags(rows).collect()}
    assert list(got.values()) == [False, True]


@pytest.mark.parametrize("message,want", [
    ("power bank under $30 in stock", ("power_bank", 30.0, "USD", None, None)), ("充电器 200元以内 65W", ("charger", 200.0, None, 65, None)), ("cable 1,299.50 eur or less", ("cable", 1299.5, "EUR", None, None)), ("compare VC-CHG-0001", (None, None, None, None, "VC-CHG-0001")),
])
def test_catalog_filters(spark, message, want):
    r = routing.catalog_filters(spark.createDataFrame([(message,)], "message string")).first()
    assert (r.category, r.max_price and float(r.max_price), r.budget_currency, r.power_w, r.sku) == want


def test_policy(spark):
    rows = spark.createDataFrame([(1, "damaged", "refund", "delivered"), (2, "address_change", "change_address", "delivered"), (3, "address_change", "change_address", "paid"), (4, "lost", "investigate", "delivered"), (5, "other", "refund", "cancelled")], "id long, issue_type string, requested_action string, order_status string")
    got = {r.id: r for r in routing.aftersales_policy(rows, *routing.rule_tables(spark)).collect()}
    assert [got[i].proposed_action for i in range(1, 6)] == ["refund_review", "manual_resolution_review", "address_change_review", "carrier_investigation", "manual_resolution_review"]
    assert [got[i].eligible_for_review for i in range(1, 6)] == [True, False, True, True, False] and len(got[1].required_evidence) == 2


def test_terms_of_chinese_text(spark):
    from millrace.functions import text

    r = spark.createDataFrame([("价格表 A1 x 库存",)], "t string").select(text.terms(F.col("t")).alias("x")).first().x
    assert set(r) == {"a1", "价格表", "价格", "格表", "库存"}


def test_rrf_does_not_depend_on_channel_order(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, chunk_id long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, chunk_id long, rank int")
    w = {"a": 0.6, "b": 0.4}
    one = {r.chunk_id: round(r.rrf, 12) for r in retrieval.weighted_rrf({"a": a, "b": b}, w).collect()}
    two = {r.chunk_id: round(r.rrf, 12) for r in retrieval.weighted_rrf({"b": b, "a": a}, w).collect()}
    assert one == two == {10: round(0.6 / 61, 12), 11: round(0.6 / 62 + 0.4 / 61, 12), 12: round(0.4 / 62, 12)}


def test_title_neighbours_stay_in_the_document(spark):
    rows = spark.createDataFrame([("a", i, "Price List" if i == 1 else "x" * 30) for i in range(1, 7)] + [("b", i, "y" * 30) for i in range(1, 4)], "doc string, page_number int, text string")
    f = pages.title_neighbors(pages.page_classify(pages.page_features(rows, ("Price List",), (), ())))
    assert {(r.doc, r.page_number) for r in f.where("near_title").collect()} == {("a", i) for i in range(1, 5)}


def test_retry_waits_double_up_to_the_cap(spark):
    rows = spark.createDataFrame([(i, i, 10) for i in range(1, 11)], "id long, attempt_count int, max_attempts int")
    got = {r.id: r.wait_s for r in jobs.retry_schedule(rows, F.lit("2024-01-01").cast("timestamp"), 30, 3600).collect()}
    assert (got[1], got[2], got[9], got[10]) == (30, 60, 3600, None)
