"""Evidence checks, table context and table chunks on small cases."""

import random
from decimal import Decimal

from pyspark.sql import functions as F

from millrace.operators import chunks, evidence, intent


def test_names_in_segments(spark):
    seg = "SKU-12X 价格 $5 in Hong Kong 2008-05-01"
    cases = [
        (None, None, None, None, None, True), ("sku-12x", None, None, "香港", "2008年5月1日", True), ("SKU-12", None, None, None, None, False), (None, None, "京东", "HK", None, True), (None, "手机", None, None, None, False),
        (None, None, None, None, "2008", False), (None, None, None, "美国", None, False), ("", "", "", "", "", True), (None, None, None, None, "soon", False),
    ]
    rows = spark.createDataFrame([(*c, seg, "京东.pdf") for c in cases], "sku string, product string, platform string, market string, date string, want boolean, segment string, source string")
    assert all(r.matched == r.want for r in evidence.identity_match(rows).collect())
    assert evidence.identity_match(rows.limit(1).withColumn("segment", F.lit(None).cast("string"))).first().matched


def test_one_value_binds(spark):
    q = [(1, "SKU-12X 价格是多少"), (2, "SKU-12X 价格是多少"), (3, "电压是多少"), (4, "SKU-12X 价格是多少"), (5, None)]
    seg = [(1, None, "SKU-12X 价格 $5"), (2, "a", "SKU-12X 价格 $5 或 $6"), (3, "a", "电压 5"), (4, "a", None), (4, "a", "SKU-13X 价格 $5")]
    got = evidence.evidence_preflight(spark.createDataFrame(q, "question_id long, question string"), spark.createDataFrame(seg, "question_id long, source string, segment string"))
    assert {r.question_id: r.reason for r in got.collect()} == {1: None, 2: "no_fact_binding", 3: "unsupported_fact_type", 4: "no_fact_binding", 5: "unsupported_fact_type"}


def test_bindings_prefix_and_anchor(spark):
    row = spark.createDataFrame([(["SKU", "note", "价格 (￥)", "配送 (天)"],), ([],), (None,)], "h array<string>").select(evidence.column_bindings(F.col("h")).alias("b"))
    fields = {"table_title": F.lit("T"), "platform": F.lit(""), "market": F.lit(None).cast("string")}
    got = row.select("b", evidence.evidence_prefix(F.lit("s"), F.lit(3), F.lit("t1"), fields, F.col("b")).alias("p")).collect()
    assert [(b.column_index, b.fact_type, b.identity, b.context.currency, b.context.duration_unit) for b in got[0].b] == [(0, "", "sku", "", ""), (2, "price", "", "CNY", ""), (3, "delivery_duration", "", "", "day")]
    assert got[0].p == "[TableEvidence | source=s | page=3 | table=t1]\nTable: T\nColumns: c0=sku; c2=price/CNY; c3=delivery_duration/day" and got[1].p.endswith("Table: T")
    blocks = [("d", 1, 1.0, 1, "text", " 京东 价格 "), ("d", 1, 2.0, 2, "text", "plain"), ("d", 1, 3.0, 3, "TABLE", "x"), ("d", 1, 4.0, 4, "text", None), ("d", 1, None, 5, "table", "y"), ("d", 2, 1.0, 1, "table", "z")]
    rows = evidence.table_anchor(spark.createDataFrame(blocks, "doc string, page int, top double, place int, label string, content string")).collect()
    assert {(r.page, r.place): r.anchor for r in rows} == {(1, 3): "京东 价格", (1, 5): None, (2, 1): None}


def test_table_chunks_against_row_by_row_packing(spark):
    rng = random.Random(3)
    head, soft, hard = "| a |\n| - |", 60, 90
    tables = [(str(k), [f"| {'x' * rng.choice((1, 5, 12, 40, 150))}{i} |" for i in range(rng.randint(0, 12))]) for k in range(60)]
    rows = [(k, f"lead{k}\n\n{head}\n" + "\n".join(r), "\n".join([head, *r])) for k, r in tables] + [("none", None, None), ("blank", " ", ""), ("flat", "y" * 200, "no header"), ("wide", "z" * 95 + "\n\n", head)]
    df = spark.createDataFrame(rows, "table_id string, content string, table_markdown string")
    for overlap in (0, 1):
        got: dict = {}
        for r in sorted(chunks.chunk_tables(df, soft, hard, overlap).collect(), key=lambda r: (r.table_id, r.chunk_index)):
            got.setdefault(r.table_id, []).append(r.chunk)
        for k, data in tables:
            base, want, open_ = f"lead{k}\n\n{head}", [], []
            fits = lambda rs, most: len("\n".join([base, *rs])) <= most  # noqa: B023, E731
            for row in data:
                if not fits([row], hard):
                    want, open_, room = want + ([open_] if open_ else []), [], hard - len(base) - 1
                    want += [[row[i : i + room]] for i in range(0, len(row), room)]
                    continue
                if open_ and not fits([*open_, row], soft):
                    want.append(open_)
                    open_ = open_[-1:] if overlap and fits([open_[-1], row], hard) else []
                open_ = [*open_, row]
            want += [open_] if open_ or not data else []
            assert got[k] == ["\n".join([base, *w]).strip() for w in want], (overlap, k)
            assert all(len(c) <= hard for c in got[k])
        assert got["flat"] == ["y" * 90, "y" * 90, "y" * 20] and "none" not in got and "blank" not in got and got["wide"] == ["z" * 90, "z" * 5]


def test_values_keep_their_zeros(spark):
    rows = spark.createDataFrame([("库存数量为70。", "inventory_quantity"), ("价格 $100 或 $20", "price")], "t string, k string")
    assert [[float(v.value) for v in r.v] for r in rows.select(evidence.values_in(F.col("t"), F.col("k")).alias("v")).collect()] == [[70.0], [100.0, 20.0]]


def test_amounts_are_no_dates(spark):
    """F1 to F3: USD 2011.71 was taken for the year 2011, so its segment held no value."""
    cases = [
        ("2005-09-21 SKU-1263X 的价格为USD 2011.71。", "price", ["2011.71"], ["2005-09-21"]), ("价格为USD 2011.711", "price", ["2011.711"], []), ("价格为USD 2005.12", "price", ["2005.12"], []), ("价格为USD 2011.00", "price", ["2011"], []), ("价格 $2011", "price", ["2011"], []),
        ("价格2011元", "price", ["2011"], []), ("配送时长为2011.5 days", "delivery_duration", ["2011.5"], []), ("关税税率为2011.5%", "customs_duty_rate", ["2011.5"], []),
        ("2026.07 USD 79.90", "price", ["79.90"], ["2026-07"]), ("2026年7月价格$5", "price", ["5"], ["2026-07"]), ("2026元旦价格 $5", "price", ["5"], ["2026"]), ("USD 2026-07-15 price $5", "price", ["5"], ["2026-07-15"]), ("2026.7.15 库存为3", "inventory_quantity", ["3"], ["2026-07-15"]), ("2026 库存为3", "inventory_quantity", ["3"], ["2026"]), ("$ 2026年价格 $5", "price", ["5"], ["2026"]),
    ]
    rows = spark.createDataFrame([(t, k) for t, k, _, _ in cases], "t string, k string").select("t", evidence.values_in(F.col("t"), F.col("k")).alias("v"), intent.dates(F.col("t")).alias("d")).collect()
    for (t, _, values, dates), r in zip(cases, rows):
        assert ([Decimal(v.value) for v in r.v], r.d) == (list(map(Decimal, values)), dates), t
