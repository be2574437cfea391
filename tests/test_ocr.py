from pyspark.sql import functions as F

from millrace.operators import htmltables, ocr


def rows(spark, outputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(outputs)], "page_number long, json string")
    return df.select(F.lit(7).alias("doc_id"), F.lit("a.pdf").alias("source"), "page_number", F.when(F.col("page_number") % 2 == 0, "L2").otherwise("L3").alias("layer"), F.try_parse_json("json").alias("output"), F.lit(None).cast("array<string>").alias("candidate_reasons"), F.lit(None).cast("string").alias("fallback_from"), F.lit("why").alias("fallback_reason"), F.lit(None).cast("boolean").alias("second_tried"), F.lit("x").alias("content"))


def test_every_shape_becomes_rows(spark):
    outputs = [
        '"| a | b |"', '{"pred_html":"<table><tr><th>h</th></tr><tr><td>1</td></tr></table>","ocr_text":"h 1"}', '["one", ["two", ["three"]], {"tables": ["four", {"content": "five"}]}, 5, true, null]',
        '{"tables": [{"content": "No  extractable CELLS"}, {"content": "kept", "metadata": {"provenance_id": "p1"}}]}', '{"content_type": "text", "content": "prose"}', '{"content_type": "text", "ocr_text": "a table after all"}',
        '{"table_html": "<b>no table</b>", "content": " some \\n text "}', '{"tables": "not a list", "content": "whole"}', None, "7", '""', "[]", '{"metadata": {"table_conversion": "placeholder"}, "content": "gone"}', '{"content": "[Table | source=x] ready"}',
    ]
    got = {}
    for r in ocr.normalize_tables(rows(spark, outputs)).orderBy("page_number", "table_index").collect():
        got.setdefault(r.page_number, []).append(r)
    body = {p: [r.content.removeprefix(f"[Table | source=a.pdf | page={p}]\n\n") for r in rs] for p, rs in got.items()}
    assert body == {0: ["| a | b |"], 1: ["| h |\n| --- |\n| 1 |"], 2: ["one", "two", "three", "four", "five"], 3: ["kept"], 5: ["a table after all"], 6: ["some text"], 7: ["whole"], 13: ["[Table | source=x] ready"]}
    assert [(r.table_id, r.provenance_id, r.upstream_provenance_id, r.route_path) for r in got[3]] == [("doc_7:page_3:table_1", "doc_7:page_3:l3:table_2", "p1", "L1->L3")]
    assert got[0][0].route_path == "L1->L2" and got[0][0].candidate_reasons == [] and got[0][0].fallback_reason == "why"


def test_repeated_pages_and_no_pages(spark):
    two = rows(spark, ['["a", "b"]']).unionByName(rows(spark, ['["a", "b"]']))
    assert sorted((r.table_index, r.content[-1]) for r in ocr.normalize_tables(two).collect()) == [(1, "a"), (1, "a"), (2, "b"), (2, "b")]
    assert ocr.normalize_tables(two.where("false")).count() == 0


def test_tables_beyond_the_grid_become_text(spark):
    wide = "<table><tr>" + "<td>x</td>" * 250 + "</tr></table>"
    long = "<table>" + "<tr><td>y</td></tr>" * 10_050 + "</table>"
    cells = {r.page_id: (r.row, r.col, len(r.text)) for r in htmltables.extract_tables(spark.createDataFrame([(1, wide), (2, long)], "page_id long, html string")).collect()}
    assert cells == {1: (0, 0, 499), 2: (0, 0, 20_099)}
    assert htmltables.first_markdown(wide) is None and htmltables.first_markdown("<table></table>") is None
    assert htmltables.first_markdown("<table><tr><td>a|b</td></tr><tr><td>c</td><td>d</td></tr></table>") == "| a\\|b |  |\n| --- | --- |\n| c | d |"
