from pyspark.sql import functions as F

from millrace.operators import chunks, htmltables
from millrace.streaming import jobs


def test_chunks_cover_the_text(spark):
    texts = [None, "", " \n ", "short text", "para one\n\n" + "word " * 200 + "\n\nend", "x" * 1000, "一二三。" * 150, "a b " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in chunks.chunk_text(df).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r.chunk)
    assert set(got) == {3, 4, 5, 6, 7} and got[3] == ["short text"]
    for i, parts in got.items():
        assert all(0 < len(p) <= 400 and p == p.strip() for p in parts)
        plain = lambda x: "".join(x.split()).replace("。", "")
        assert plain("".join(parts)) == plain(texts[i])
    over = {(r.doc_id, r.chunk_index): r.chunk for r in chunks.chunk_overlap(chunks.chunk_text(df)).collect()}
    assert all(over[i, k] == (parts[k - 1][-80:] if k else "") + parts[k] for i, parts in got.items() for k in range(len(parts)))


def test_contract_finds_gaps_and_counts(spark):
    rows = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 2), (3, 0)], "doc_id long, chunk_index int")
    declared = spark.createDataFrame([(1, 2), (2, 2), (3, 2), (4, 1)], "doc_id long, n_chunks long")
    got = {r.doc_id: r.violations for r in chunks.chunk_contract(rows, declared).collect()}
    assert got == {2: ["index_gap"], 3: ["count_differs"], 4: ["count_differs"]}


def test_spans_fill_the_grid(spark):
    html = "<p>x</p><table><tr><th colspan=2>A &amp; B</th><th rowspan='2'>C</th></tr><tr><td>1<br>2</td><td>a|b</td></tr></table><table></table>"
    cells = htmltables.extract_tables(spark.createDataFrame([(1, html), (2, None), (3, "<li>no table</li>")], "page_id long, html string"))
    got = {(r.row, r.col): (r.text, r.is_header, r.is_merged) for r in cells.collect()}
    assert got == {(0, 0): ("A & B", True, False), (0, 1): ("A & B", True, True), (0, 2): ("C", True, False), (1, 2): ("C", True, True), (1, 0): ("1 2", False, False), (1, 1): ("a\\|b", False, False)}
    q = htmltables.table_quality(cells).first()
    assert (q.n_rows, q.n_cols, q.score, q.grade) == (2, 3, 0.95, "good")
    assert htmltables.markdown(cells).first().markdown == "| A & B | A & B | C |\n| --- | --- | --- |\n| 1 2 | a\\|b | C |"


def test_stream_ingests_each_document_once(spark, tmp_path):
    src, out = str(tmp_path / "docs"), str(tmp_path / "out")
    make = lambda ids: spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    make([1, 2, 2]).coalesce(1).write.parquet(src)
    assert jobs.ingest(jobs.file_stream(spark, src), out).count() == 2
    make([3, 2]).write.mode("append").parquet(src)  # 2 comes again in a later batch
    spark.createDataFrame([(1, "another text")], "doc_id long, text string").write.mode("append").parquet(src)
    got = jobs.ingest(jobs.file_stream(spark, src), out)
    assert sorted((r.doc_id, r.chunk) for r in got.collect()) == [(1, "another text"), (1, "text 1"), (2, "text 2"), (3, "text 3")] and got.select("index_version").distinct().count() == 4


def test_stream_routes_like_the_batch(spark, tmp_path):
    src = str(tmp_path / "messages")
    rows = spark.createDataFrame([(1, "where is my package"), (2, "recommend a cable")], "request_id long, message string")
    rows.write.parquet(src)
    got = jobs.run_to_end(jobs.stream_route(jobs.file_stream(spark, src)), str(tmp_path / "out"))
    want = jobs.stream_route(rows)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.where(F.col("result_summary").contains("logistics_tracking")).count() == 1
