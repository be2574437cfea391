"""What questions ask for, and ranks by it, on small cases."""

from pyspark.sql import functions as F

from millrace.operators import intent, ranking


def test_shop_questions(spark):
    cases = [
        ("请问美国京东 SKU-899X 在 2008-1-3 的价格是多少？", dict(skus=["SKU-899X"], dates=["2008-01-03"], platforms=["京东"], markets=["美国"], product_terms=[], fact_types=["price"], answer_type="price"), None),
        ("库存周转是多少", dict(fact_types=[], product_terms=["库存周转"], answer_type="unsupported"), "unsupported_fact_type"),
        ("price and delivery of SKU: AB-12", dict(skus=["SKU: AB-12"], fact_types=["delivery_duration", "price"], product_terms=["price", "and", "of"]), "unsupported_multi_fact"),
        ("customs duty rate ＵＳＡ 红色手机 的 2024年5月3日", dict(markets=["美国"], dates=["2024-05-03"], product_terms=["红色手机"], fact_types=["customs_duty_rate"], table_types=["customs_policy"]), None),
        ("SKU-2045 stock", dict(skus=["SKU-2045"], dates=["2045"], fact_types=["inventory_quantity"]), None), ("加权价格", dict(fact_types=["price"]), "unsupported_complex_formula"),
        (None, dict(skus=[], fact_types=[], table_fact=False), "unsupported_fact_type"), ("", dict(product_terms=[]), "unsupported_fact_type"),
    ]
    rows = spark.createDataFrame([(i, q) for i, (q, _, _) in enumerate(cases)], "i int, q string").withColumn("x", intent.shop_intent(F.col("q")))
    for r in rows.withColumn("why", intent.question_preflight(F.col("q"), F.col("x"))).collect():
        _, want, why = cases[r.i]
        assert {k: r.x[k] for k in want} == want and r.why == why, r.q


def test_financial_questions(spark):
    cases = [
        ("格力电器2023年合并利润表的归属于母公司股东的净利润是多少？", dict(company_terms=["格力电器"], years=["2023"], metric_families=["归母净利润"], statement_types=["利润表"], scopes=["合并"], answer_type="amount")),
        ("甲乙科技股份有限公司2022年度母公司口径净利润", dict(company_terms=["甲乙科技"], metric_families=["净利润"], scopes=["母公司"])), ("美的集团毛利率", dict(company_terms=["美的集团"], scopes=[], answer_type="ratio", statement_types=["毛利率表"])),
        ("比亚迪集团净利润和归属于母公司股东的净利润", dict(scopes=["集团"], metric_families=["归母净利润", "净利润"])), (None, dict(company_terms=[], metric_families=[], table_fact=False)),
    ]
    rows = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(cases)], "i int, q string").withColumn("x", intent.financial_intent(F.col("q")))
    for r in rows.collect():
        assert {k: r.x[k] for k in cases[r.i][1]} == cases[r.i][1], r.q


_ROWS = "query_id long, candidate_id string, rrf double, best_rank int, question string, content string, source string, content_type string, page_number int, table_id string, chunk_index int, provenance_id string, semantic_text string"


def test_third_rank_by_hand(spark):
    q = "格力电器2023年合并口径营业收入"
    full = "合并利润表\n营业收入 2023 1,234.5"
    rows = [(1, "a", 0.02, 1, q, full, "格力电器年报", "table", 1, "t1", 0, None, ""), (1, "b", 0.04, 1, q, "非经常性损益\n营业收入 2023", "美的集团", "text", 2, None, 0, None, None), (1, "c", 0.01, 2, q, full, "格力电器年报", "table", 1, "t1", 1, None, ""), (1, "d", 0.0, 3, q, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, _ROWS).withColumn("intent", intent.financial_intent(F.col("question")))
    got = {r.candidate_id: r for r in ranking.rank_financial_v3(df).collect()}
    # c is the same table as a, further down
    assert set(got) == {"a", "b", "d"} and [got[x]["rank"] for x in "abd"] == [1, 2, 3]
    a, b = got["a"], got["b"]
    assert (a.metric_row_score, a.exact_statement_score, a.scope_score, a.source_filter_score, a.financial_noise_score) == (1, 1, 1, 1, 0)
    assert (b.metric_row_score, b.year_score, b.source_filter_score, b.financial_noise_score) == (0, 1, 0, 1)
    assert abs(a.score - (0.4 * 0.5 + 0.6 * a.query_lexical_score + 1.2 + 0.3 + 1.0 + 0.2 + 0.1 + 0.3 + 0.3)) < 1e-6
    assert abs(b.score - (0.4 + 0.6 * b.query_lexical_score + 0.3 - 0.5)) < 1e-6 and got["d"].score == 0


def test_a_code_is_no_year(spark):
    """SKU-2045X was taken for the year 2045 as well, so every line of that part had the date asked for."""
    cases = [
        ("京东 SKU-2045X 2006 价格是多少", ["2006"]), ("sku 编号：2045x 价格", []), ("SKU: 2045_1 价格", []), ("SKU-2045 stock", ["2045"]), ("SKU-2045X 在 2008-01-03 的价格", ["2008-01-03"]), ("2026Q1 SKU-12X", ["2026"]), ("SKU-7 2026-07-15T10", ["2026-07-15"]),
    ]
    rows = spark.createDataFrame(cases, "q string, want array<string>").withColumn("x", intent.shop_intent(F.col("q"))).collect()
    assert [(r.q, r.x.dates) for r in rows] == [(r.q, r.want) for r in rows]
    row = ("京东 SKU-2045X 2006 价格是多少", "SKU-2045X 价格 5 2008-01-03", "Amazon.pdf", "text", "")
    df = spark.createDataFrame([row], "question string, content string, source string, content_type string, semantic_text string").withColumn("intent", intent.shop_intent(F.col("question")))
    assert ranking.shop_features(df).first().date_score == 0.0
