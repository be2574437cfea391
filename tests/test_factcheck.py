"""Answers against question, facts and evidence; scores against the truth."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import factcheck, intent, scoring, verify
from millrace.plans import registry

LEDGER = "answer_id long, citation_id string, source string, content_type string, content string"
ASKED = "2026-07-15 Amazon美国市场SKU-A100轻量旅行背包价格是多少？"
GOOD = "2026-07-15 Amazon美国市场轻量旅行背包 SKU-A100 的价格为USD 79.90。"


def fact(kind="price", **more):
    f = dict.fromkeys(factcheck.FACT_FIELDS) | {"fact_type": kind, "value_text": "79.90", "currency": "USD", "sku": "SKU-A100", "product": "轻量旅行背包", "platform": "Amazon", "market": "美国", "date": "2026-07-15", "citation_ids": ["C1"]}
    return f | more


def bare(kind="price", **more):
    return fact(kind, **({"product": None, "platform": None, "market": None, "date": None} | more))


def frames(spark, cases):
    """cases: (question, answer text, facts, contexts as texts or (type, text))."""
    rows = spark.createDataFrame([(i, q, t, json.dumps(f, ensure_ascii=False) if f is not None else None) for i, (q, t, f, _) in enumerate(cases)], "answer_id long, question string, answer_text string, j string")
    ledger = [(i, f"C{k + 1}", "catalog-2026.pdf", *(("text", c) if isinstance(c, str) else c)) for i, case in enumerate(cases) for k, c in enumerate(case[3])]
    return rows.select("answer_id", "question", "answer_text", F.from_json("j", factcheck.FACTS).alias("facts"), F.lit("x").alias("segment")), spark.createDataFrame(ledger, LEDGER)


def checked(spark, cases):
    got = {r.answer_id: r for r in factcheck.verify_answers(*frames(spark, cases)).collect()}
    return [got[i] for i in range(len(cases))]


def test_errors_of_every_kind_in_their_order(spark):
    q, ok = "SKU-A100价格是多少？", "SKU-A100价格为USD 79.90。"
    see = "结果见引用 [C1]。"
    table = ("table", "| SKU | 商品 | 价格 |\n| SKU-A100 | 轻量旅行背包 | USD 79.90 |")
    two = ("table", "| SKU | 价格 | 原价 |\n| SKU-A100 | USD 79.90 | USD 89.90 |")
    cases = [
        (ASKED, "SKU-A100价格为USD 79.90 [C1]。", [fact()], [GOOD], []),
        (ASKED, see, [fact(citation_ids=[])], [GOOD], ["answer_fact_citation_mismatch", "fact_1:missing_citation"]),
        (ASKED, see, [fact(citation_ids=["C99"])], [GOOD], ["answer_fact_citation_mismatch", "fact_1:unknown_citation:C99"]),
        (ASKED, see, [fact(value_text="89.90")], [GOOD], ["fact_1:evidence_mismatch_or_cross_fragment"]),
        (ASKED, see, [fact(currency="CNY")], [GOOD], ["fact_1:evidence_mismatch_or_cross_fragment"]),
        (ASKED, see, [fact(sku="SKU-B200")], [GOOD], ["fact_1:question_sku_mismatch", "fact_1:evidence_mismatch_or_cross_fragment"]),
        (ASKED, see, [fact(product="其他商品")], [GOOD], ["fact_1:question_product_mismatch", "fact_1:evidence_mismatch_or_cross_fragment"]),
        (ASKED, see, [fact(platform="京东")], [GOOD], ["fact_1:question_platform_mismatch", "fact_1:evidence_mismatch_or_cross_fragment"]),
        (ASKED, see, [fact(market="中国")], [GOOD], ["fact_1:question_market_mismatch", "fact_1:evidence_mismatch_or_cross_fragment"]),
        (ASKED, see, [fact(market="usa")], [GOOD], []),
        (ASKED, see, [fact(date="2026-07-16")], [GOOD], ["fact_1:question_date_mismatch", "fact_1:evidence_mismatch_or_cross_fragment"]),
        (q, "价格为USD 79.90 [C1][C2]。", [bare(citation_ids=["C1", "C2"])], [ok, "SKU-A100库存数量为42。"], ["fact_1:unsupported_citation:C2"]),
        (q, "价格为USD 79.90 [C99]。", [bare()], [ok], ["answer_unknown_citation:C99", "answer_fact_citation_mismatch"]),
        (q, "价格为USD 79.90，折扣10% [C1]。", [bare()], [ok], ["answer_contains_uncited_numeric_value"]),
        (q, "价格为USD 79.90。", [bare()], [ok], ["answer_missing_citation", "answer_fact_citation_mismatch"]),
        (q, "不清楚", [], [ok], ["missing_ecommerce_facts"]),
        (q, None, None, [], ["missing_ecommerce_facts"]),
        (q, see, [bare(), bare(value_text="80")], [ok], ["conflicting_ecommerce_facts", "fact_2:evidence_mismatch_or_cross_fragment"]),
        (q, see, [bare()], ["SKU-A100价格如下。\nUSD 79.90。"], ["fact_1:evidence_mismatch_or_cross_fragment"]),
        (q, see, [bare()], [table], []), (q, see, [bare()], [two], ["fact_1:evidence_mismatch_or_cross_fragment"]),
        (q, see, [bare(currency=None)], [ok], ["invalid_structured_output"]),
        ("SKU-A100库存数量有多少？", see, [bare()], [ok], ["fact_1:question_fact_type_mismatch"]),
        ("请把SKU-A100美元价格换算成人民币", see, [bare()], [ok], ["unsupported_complex_formula"]), ("SKU-A100重量是多少？", see, [bare()], [ok], ["unsupported_fact_type"]), ("SKU-A100价格和库存分别是多少？", see, [bare()], [ok], ["unsupported_multi_fact"]), (None, see, [bare()], [ok], ["unsupported_fact_type"]),
        ("SKU-A100库存数量有多少？", "结果为42 [c1]。", [bare("inventory_quantity", value_text="42", currency=None)], ["SKU-A100库存数量为42。"], []),
        ("SKU-A100配送时长多久？", "结果为3 [C1]。", [bare("delivery_duration", value_text="3", unit="business_day", currency=None)], ["SKU-A100配送时长为3 business days。"], []),
        ("SKU-A100配送时长多久？", "结果为2 [C1]。", [bare("delivery_duration", value_text="2", unit="day", currency=None)], ["SKU-A100配送时长为48 hours。"], []),
        ("SKU-A100关税税率是多少？", "结果为12 [C1]。", [bare("customs_duty_rate", value_text="12", unit="percent", currency=None)], ["SKU-A100关税税率为12%。"], []),
    ]
    got = checked(spark, [c[:4] for c in cases])
    for case, r in zip(cases, got):
        assert (r.errors, r.passed) == (case[4], not case[4]), case
    assert got[0].verified_citation_ids == ["C1"] and got[11].verified_citation_ids == []


def test_repeated_answers_are_one_and_no_answers_none(spark):
    answers, ledger = frames(spark, [("SKU-A100价格是多少？", "USD 79.90 [C1]", [bare()], ["SKU-A100价格为USD 79.90。"])])
    assert [r.errors for r in factcheck.verify_answers(answers.unionByName(answers), ledger).collect()] == [[]]
    assert factcheck.verify_answers(answers.where("false"), ledger).count() == 0
    assert [r.errors for r in factcheck.verify_answers(answers, ledger.where("false")).collect()] == [["answer_unknown_citation:C1", "fact_1:unknown_citation:C1"]]


def test_declared_units_and_all_values(spark):
    rows = [("79.90", "price", None, "usd", (79.9, None, "USD", "price")), ("USD 5", "price", None, "CNY", None), ("5", "price", None, "EUR", None), ("3", "delivery_duration", "days", None, (72.0, "day", None, "delivery_duration")), ("3 hours", "delivery_duration", "day", None, None),
            ("12", "customs_duty_rate", "percent", None, (12.0, "percent", None, "customs_duty_rate")), ("12", "inventory_quantity", "boxes", None, None), ("3 days", None, None, None, (3.0, "day", None, "delivery_duration")), ("12%", None, None, None, (12.0, "percent", None, "customs_duty_rate")), ("7", None, None, None, (7.0, None, None, "inventory_quantity")), ("7.5", None, None, None, None), ("$7.5", None, None, None, (7.5, None, "USD", "price"))]
    df = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(rows)], "i int, t string, k string, u string, c string")
    got = {r.i: r.v for r in df.select("i", verify.typed_value(F.col("t"), F.col("k"), F.col("u"), F.col("c")).alias("v")).collect()}
    assert [v and (float(v.canonical_value), v.unit, v.currency, v.kind) for v in (got[i] for i in range(len(rows)))] == [r[4] for r in rows]
    texts = spark.createDataFrame([(1, "库存 12" + " " * 30 + "另有 40" + " " * 30 + "价 $5"), (2, None), (3, "none")], "i int, t string")
    found = {r.i: [float(v.value) for v in r.v] for r in texts.select("i", verify.all_values(F.col("t"), F.lit("inventory_quantity")).alias("v")).collect()}
    assert found == {1: [12.0, 40.0], 2: [], 3: []}


def test_financial_values(spark):
    rows = [("100", "万元", (1000000.0, "元", "amount")), ("(1,234.5)亿元", None, (-123450000000.0, "元", "amount")), ("25bp", None, (0.25, "percentage_point", "percentage_point")), ("3 百分点", None, (3.0, "percentage_point", "percentage_point")), ("4%", None, (4.0, "percent", "percent")), ("7", None, (7.0, None, "number")), ("none", "元", None), ("５万元", "", (50000.0, "元", "amount"))]
    df = spark.createDataFrame([(i, t, u) for i, (t, u, _) in enumerate(rows)], "i int, t string, u string")
    got = {r.i: r.v for r in df.select("i", scoring.financial_value(F.col("t"), F.col("u")).alias("v")).collect()}
    assert [v and (float(v.canonical_value), v.unit, v.kind) for v in (got[i] for i in range(len(rows)))] == [r[2] for r in rows]


OUTPUTS = "case_id long, question string, status string, answer_text string, j string, given_errors array<string>, given_status string"


def scored(spark, cases, profile):
    """cases: (question, status, text, facts, truth, contexts)."""
    out = spark.createDataFrame([(i, q, s, t, json.dumps(f, ensure_ascii=False), ["unknown_citation:C7"] if s == "odd" else None, None) for i, (q, s, t, f, *_) in enumerate(cases)], OUTPUTS).withColumn("facts", F.from_json("j", factcheck.FACTS))
    truth = spark.createDataFrame([(i, c[4].get("should_refuse", False), *[c[4].get(f) for f in scoring.TRUTH_FIELDS]) for i, c in enumerate(cases)], "case_id long, should_refuse boolean," + ",".join(f"{f} string" for f in scoring.TRUTH_FIELDS))
    ledger = spark.createDataFrame([(i, f"C{k + 1}", "甲公司.pdf", "text", x) for i, c in enumerate(cases) for k, x in enumerate(c[5])], LEDGER.replace("answer_id", "case_id"))
    got = {r.case_id: r for r in scoring.score_answers(out, truth, ledger, profile).collect()}
    return [got[i] for i in range(len(cases))]


def money(**more):
    return dict.fromkeys(factcheck.FACT_FIELDS) | {"value_text": "100", "unit": "万元", "year": "2024", "company": "甲公司", "metric": "营业收入", "scope": "合并", "citation_ids": ["C1"]} | more


MONEY = {"metric": "营业收入", "expected_value": "100", "expected_unit": "万元", "expected_year": "2024", "expected_company": "甲公司", "expected_scope": "合并"}
SHOP = {"fact_type": "price", "expected_value": "79.9", "expected_currency": "USD", "expected_date": "2026-07-15", "expected_product": "轻量旅行背包", "expected_sku": "SKU-A100"}


def test_verified_scores(spark):
    text, ctx = "甲公司2024年合并营业收入为100万元 [C1]", ["甲公司 2024 年合并营业收入 1,000,000元"]
    cases = [
        (None, "accepted", text, [money()], MONEY, ctx), (None, "accepted", text, [money(value_text="1", unit="百万元")], MONEY, ctx), (None, "accepted", text, [money(value_text="100.1")], MONEY, ["甲公司2024年合并净利润100元"]),
        (None, "accepted", "x", [money()], MONEY, ctx), (None, "refused", "", [], MONEY | {"should_refuse": True}, []), (None, "accepted", text, [money()], MONEY | {"should_refuse": True}, ctx),
        (ASKED, "accepted", "价格为USD 79.90 [C1]。", [fact()], SHOP, [GOOD]), (ASKED, "accepted", "价格为USD 79.90 [C99]。", [fact(citation_ids=["C99"])], SHOP, [GOOD]), (ASKED, "accepted", "价格为USD 79.90 [C1]。", [fact(sku="sku-a101")], SHOP, [GOOD]),
    ]
    r = scored(spark, cases, "verified")
    assert [(x.strict_correct, x.citation_valid) for x in r] == [(True, True), (False, True), (False, False), (True, False), (True, None), (False, True), (True, True), (True, False), (False, False)]
    assert r[1].numeric_correct and not r[1].unit_correct and r[2].unsupported_numeric_accepted and r[2].verification_errors == ["evidence_mismatch"]
    assert r[3].verification_errors == ["answer_missing_citation", "answer_fact_citation_mismatch", "evidence_mismatch"]
    assert r[7].unknown_citation_accepted and not r[8].scope_correct and r[6].verification_status == "passed"


def test_legacy_scores_read_the_text(spark):
    good = "甲公司 2024年 合并 营业收入为 1,00 万元"
    cases = [(None, "accepted", good, [], MONEY, []), (None, "accepted", good.replace("1,00", "1100"), [], MONEY, []), (None, "odd", good, [], MONEY | {"expected_unit": "元"}, []), (None, "refused", "", [], MONEY | {"should_refuse": True}, []), (None, "accepted", good, [], MONEY | {"expected_scope": None}, [])]
    r = scored(spark, cases, "legacy")
    assert [x.strict_correct for x in r] == [True, False, False, True, False]
    assert [x.numeric_correct for x in r] == [True, False, True, False, True] and not r[2].unit_correct and r[0].citation_valid is None and r[2].verification_errors == ["unknown_citation:C7"]
    with pytest.raises(ValueError):
        scored(spark, cases, "other")


def test_prices_that_look_like_dates_are_supported(spark):
    cases = [("2005-09-21 SKU-A100价格是多少？", f"价格为{p} [C1]。", [bare(value_text=p, date="2005-09-21")], [f"2005-09-21 SKU-A100 的价格为USD {p}。"]) for p in ("2011.71", "2011.05", "2099.00")]
    assert [(r.errors, r.verified_citation_ids) for r in checked(spark, cases)] == [([], ["C1"])] * 3


def test_the_intent_is_worked_out_once(spark):
    """an answer's intent was worked out in every branch, to see whether its question can be answered. 平台商品 is an alias that only intents look for."""
    plan = registry.queries()["v04_verify_answers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("平台商品" in x for x in plan) == 1


def test_preflight_without_the_intent(spark):
    asked = ["SKU-1X 价格是多少", " 库存周转 ", "price and delivery", "加权价格", "电压", "ＰＲＩＣＥ", "", None, "库存费 库存数量", "关税税率和关税率"]
    rows = spark.createDataFrame([(q,) for q in asked], "q string")
    got = rows.select("q", intent.shop_preflight(F.col("q")).alias("a"), intent.question_preflight(F.col("q"), intent.shop_intent(F.col("q"))).alias("b")).collect()
    assert [(r.q, r.a) for r in got] == [(r.q, r.b) for r in got] and {r.a for r in got} > {None, "unsupported_multi_fact"}
