import pytest
from pyspark.sql import functions as F

from millrace.operators import answers, support, verify
from millrace.sources import io


def test_typed_values(spark):
    cases = [
        ("¥1,299.00", "price", (1299.0, None, "CNY")), ("HK$ 88", "price", (88.0, None, "HKD")), ("3 天", "delivery_duration", (72.0, "day", None)), ("5 个工作日", "delivery_duration", (5.0, "business_day", None)), ("13 %", "customs_duty_rate", (13.0, "percent", None)),
        ("120", "inventory_quantity", (120.0, None, None)), ("1.5", "inventory_quantity", None), ("12万元", "price", None), ("(5) USD", "price", None), ("12", "price", None), ("5 USD 3 days", "price", None), ("none", "price", None),
    ]
    rows = spark.createDataFrame([(i, t, k) for i, (t, k, _) in enumerate(cases)], "i int, t string, k string")
    got = {r.i: r.v for r in rows.select("i", verify.typed_value(F.col("t"), F.col("k")).alias("v")).collect()}
    for i, (t, k, want) in enumerate(cases):
        v = got[i]
        assert (v and (float(v.canonical_value), v.unit, v.currency)) == want, (t, k)


def test_strict_value_needs_number_bounds(spark):
    rows = spark.createDataFrame([("12.5", "it is 12.5 here"), ("12.5", "112.5"), ("12.5", "12.57"), ("1,200", "about 1200 units"), ("abc", "A B C"), ("", "x")], "e string, c string")
    assert [r.m for r in rows.select(verify.strict_value_match(F.col("e"), F.col("c")).alias("m")).collect()] == [True, False, False, True, True, False]


def test_segments_of_tables_and_sentences(spark):
    rows = spark.createDataFrame([("C1", "table", "| SKU | price |\n| --- | --- |\n| A | 5 |\n| B | |"), ("C2", "text", "One is 1.5. Two！Three\n\nFour"), ("C3", "table", "Market: UK\n| SKU | price |\n| A | 5 | 6 |"), ("C4", "table", "a | b")], "citation_id string, content_type string, content string")
    got = sorted((r.citation_id, r.segment_index, r.segment) for r in verify.evidence_segments(rows).collect())
    assert got == [("C1", 0, "SKU=A | price=5"), ("C1", 1, "SKU=B"), ("C2", 0, "One is 1.5. Two！"), ("C2", 1, "Three"), ("C2", 2, "Four"), ("C3", 0, "Market: UK | SKU=A | price=5"), ("C4", 0, "a | b")]


def test_hash_embedding_is_a_unit_vector(spark):
    rows = spark.createDataFrame([(1, "价格 sku_1"), (2, ""), (3, None)], "id long, t string")
    got = {r.id: r.embedding for r in verify.hash_embedding(rows, "id", "t", 64).collect()}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-9 and set(got[2]) == set(got[3]) == {0.0} and len(got[1]) == 64


def test_facts_need_support_in_one_segment(spark):
    facts = spark.createDataFrame([(1, 1, "price", "5 USD", "A-1", ["C1"]), (1, 2, "price", "6 USD", "A-1", ["C1"]), (1, 3, "price", "5 USD", "B-2", ["C1", "C2"]), (1, 4, "price", "5 USD", None, ["C7"])], "answer_id long, fact_id long, fact_type string, value_text string, sku string, citation_ids array<string>")
    segments = spark.createDataFrame([(1, "C1", "a-1 costs $5"), (1, "C2", "B-2 costs 7 USD")], "answer_id long, citation_id string, segment string")
    got = {r.fact_id: r.errors for r in support.verify_facts(facts, segments).collect()}
    assert got == {1: [], 2: ["unsupported_fact"], 3: ["unsupported_fact"], 4: ["unknown_citation", "unsupported_fact"]}


def test_subsequence(spark):
    rows = spark.createDataFrame([(["a", "b"], ["a", "x", "b"], True), (["a", "b"], ["b", "a"], False), ([], ["a"], True), (["a"], [], False)], "e array<string>, a array<string>, want boolean")
    assert all(r.got == r.want for r in rows.select("want", answers.subsequence(F.col("e"), F.col("a")).alias("got")).collect())


def test_query_set_refuses_labels(spark, tmp_path):
    good, bad = tmp_path / "g.jsonl", tmp_path / "b.jsonl"
    good.write_text('{"case_id": "1", "question": "q"}\n\n{"case_id": "2", "question": "r"}\n')
    bad.write_text('{"case_id": "1", "question": "q", "expected_value": "7"}\n')
    assert io.read_query_set(spark, str(good)).count() == 2
    with pytest.raises(io.Refused):
        io.read_query_set(spark, str(bad)).collect()


def test_text_in_other_encodings(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("价格".encode("gbk"))
    (tmp_path / "b.md").write_bytes("é".encode())
    (tmp_path / "c.bin").write_bytes(b"x")
    assert sorted(r.text for r in io.read_text_docs(spark, str(tmp_path)).collect()) == ["é", "价格"]


def test_load_stats_find_their_columns(spark, tmp_path):
    f = tmp_path / "s.csv"
    f.write_text("﻿Name,Request Count,Failure Count,Average Response Time,95%,99%\nrag,44,0,9347.2,20000,30000\n", encoding="utf-8")
    r = io.read_load_stats(spark, str(f)).first()
    assert (r.name, r.requests, r.p95_ms) == ("rag", 44.0, 20000.0)


def test_full_width_values(spark):
    rows = spark.createDataFrame([("１２０ 美元", "price", "总价１，２００．５０元", "1,200.50"), ("（３）％", "customs_duty_rate", "税率１２％", "12%"), ("3％", "customs_duty_rate", "112", "12")], "v string, k string, content string, want string")
    got = rows.select(verify.typed_value(F.col("v"), F.col("k")).alias("x"), verify.strict_value_match(F.col("want"), F.col("content")).alias("hit")).collect()
    assert (float(got[0].x.value), got[0].x.currency, got[1].x, float(got[2].x.value)) == (120.0, "USD", None, 3.0)
    assert [r.hit for r in got] == [True, True, False]


def test_lines_of_pages(spark):
    from millrace.operators import pages

    rows = spark.createDataFrame([("d", 1, "a\r\n\t\r\nb\n \n"), ("d", 2, None)], "doc string, page_number int, text string")
    assert [r.line_count for r in pages.page_features(rows, ("x",), ("y",), ("z",)).orderBy("page_number").collect()] == [2, 0]


def test_periods_of_pages(spark):
    from millrace.operators import pages

    rows = spark.createDataFrame([("d", 1, "effective DATE: 3 May"), ("d", 2, "截至2024年"), ("d", 3, " \n"), ("d", 4, None)], "doc string, page_number int, text string")
    got = pages.page_features(rows, (), (), ()).orderBy("page_number").collect()
    assert [(r.period_hits, r.empty_text) for r in got] == [(["Date", "Effective"], False), (["截至"], False), ([], True), ([], True)]
