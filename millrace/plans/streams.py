"""Queries on chunks, HTML tables and streams, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import chunks, htmltables, ocr
from millrace.sources.facts import table
from millrace.streaming import jobs

from .operations import _ROUTED, RULES


def chunk_text(s, d):
    c = chunks.chunk_text(table(s, d, "documents"))
    return c.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.length("chunk").cast("long").alias("n_chars"), F.sha2("chunk", 256).alias("sha256"))


def chunk_overlap(s, d):
    c = chunks.chunk_overlap(chunks.chunk_text(table(s, d, "documents")))
    return c.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.length("chunk").cast("long").alias("n_chars"))


def chunk_contract(s, d):
    c = chunks.chunk_text(table(s, d, "documents"))
    return chunks.chunk_contract(c.where("doc_id % 10 <> 0 or chunk_index <> 1"), c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))).select("doc_id", F.array_join("violations", ",").alias("violations"))


def _html(s, d):
    """The order lines of each part as an HTML table with a wide heading and, for every other line, a cell over two columns; a part's lines are its own, so the group is small."""
    li = table(s, d, "lineitem")
    cell = lambda c, span="": F.concat(F.lit(f"<td{span}>"), c, F.lit("</td>"))
    head, wide = cell(F.concat_ws("/", F.lpad(F.col("l_orderkey").cast("string"), 9, "0"), "l_linenumber", F.lpad(F.col("l_suppkey").cast("string"), 7, "0"), F.lpad(F.col("l_quantity").cast("int").cast("string"), 3, "0"), F.date_format("l_shipdate", "yyyyMMdd"))), cell(F.concat_ws(" &amp; ", "l_suppkey", "l_returnflag"), " colspan='2'")
    row = F.concat(F.lit("<tr>"), head, F.when(F.col("l_returnflag") == "R", wide).otherwise(F.concat(cell(F.col("l_suppkey").cast("string")), cell(F.when(F.col("l_linestatus") == "F", "").otherwise(F.col("l_returnflag"))))), F.lit("</tr>"))
    rows = li.groupBy("l_partkey").agg(F.array_join(F.sort_array(F.collect_list(row)), "").alias("rows"))
    return rows.select(F.col("l_partkey").alias("page_id"), F.concat(F.lit("<p>x</p><TABLE><tr><th>order</th><th>mode</th><th>flag</th></tr>"), F.col("rows"), F.lit("</TABLE>")).alias("html"))


def extract_tables(s, d):
    got = htmltables.extract_tables(_html(s, d))
    return got.select("page_id", *[F.col(c).cast("long").alias(c) for c in ("table_index", "row", "col")], "text", "is_header", "is_merged")


def table_quality(s, d):
    got = htmltables.table_quality(htmltables.extract_tables(_html(s, d)))
    return got.select("page_id", F.col("n_rows").cast("long").alias("n_rows"), F.col("n_cols").cast("long").alias("n_cols"), F.round("fill", 9).alias("fill"), "score", "grade")


def _outputs(s, d):
    """What parsers said of a page, an order to a page: a text, an object, lists and objects with lists, some of it no table or none that could be read."""
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", F.concat(F.lit("clerk "), F.col("o_custkey").cast("string")).alias("o_clerk"), "o_orderpriority", "o_orderstatus", "o_orderdate")
    q = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    pipe = F.concat(F.lit("| "), F.col("o_clerk"), F.lit(" | "), day, F.lit(" |"))
    html = F.concat(F.lit("<table><tr><th>clerk</th><th>day</th></tr><tr><td>"), F.col("o_clerk"), F.lit("</td><td>"), day, F.lit("</td></tr></table>"))
    bare = F.concat(F.lit("Clerk  "), F.col("o_orderpriority"))
    made = F.concat(F.lit('{"pred_html":'), q(html), F.lit(',"ocr_text":'), q(bare), F.lit(',"provenance_id":"up-'), F.col("o_custkey").cast("string"), F.lit('"}'))
    broken = F.concat(F.lit('{"table_html":"<p>none</p>","content":'), q(bare), F.lit("}"))
    given = F.concat(F.lit('{"metadata":{"content_type":"table","table_markdown":'), q(pipe), F.lit("}}"))
    words = F.concat(F.lit('{"metadata":{"content_type":"text"},"content":'), q(bare), F.lit("}"))
    held = F.concat(F.lit('{"content":'), q(pipe), F.lit(',"table_conversion":'), q(F.when(F.col("o_orderstatus") == "F", "Placeholder").otherwise("full")), F.lit("}"))
    lost = q(F.concat(F.lit("[Table on page "), F.col("o_custkey").cast("string"), F.lit("]")))
    shapes = [q(pipe), made, F.concat_ws(",", F.lit('{"tables":[' + "7"), broken, lost, F.concat(held, F.lit("]}"))), F.concat(F.lit("["), F.concat_ws(",", words, given, lost, F.concat(F.lit("["), made, F.lit("]"))), F.lit("]")), words, F.lit("3.5")]
    json = F.get(F.array(*shapes), F.pmod(F.col("o_custkey") + F.length("o_orderpriority"), F.lit(len(shapes))).cast("int"))
    return o.select(F.col("o_custkey").alias("doc_id"), F.col("o_clerk").alias("source"), F.col("o_orderkey").alias("page_number"), F.when(F.col("o_orderstatus") == "O", "L2").otherwise("L3").alias("layer"), json.alias("json"), F.when(F.col("o_orderstatus") == "P", "L2").alias("fallback_from"), F.when(F.col("o_orderstatus") == "P", "timeout").alias("fallback_reason"), (F.col("o_orderstatus") == "P").alias("second_tried"), F.array(F.lower("o_orderpriority")).alias("candidate_reasons"))


def normalize_tables(s, d):
    got = ocr.normalize_tables(_outputs(s, d).withColumn("output", F.parse_json("json")))
    return got.withColumn("table_index", F.col("table_index").cast("long")).withColumn("candidate_reasons", F.array_join("candidate_reasons", ","))


def stream_route(s, d):
    c = jobs.file_stream(s, f"{d}/conversations.parquet").where("conv_id is not null and text is not null")
    rows = jobs.stream_route(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), F.col("text").alias("message")), RULES)
    return jobs.run_to_end(rows, jobs.shared_folder(s, "route"))


def stream_ingest(s, d):
    got = jobs.ingest(jobs.file_stream(s, f"{d}/documents.parquet").select("doc_id", "text"), jobs.shared_folder(s, "ingest"))
    return got.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))


def chunk_tables(s, d):
    """The order lines of each part as a Markdown table; a part's lines are its own, so the group is small."""
    li = table(s, d, "lineitem")
    row = F.concat(F.lit("| "), F.concat_ws(" | ", F.lpad(F.col("l_orderkey").cast("string"), 9, "0"), "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd"), "l_quantity", "l_returnflag"), F.lit(" |"))
    rows = li.groupBy("l_partkey").agg(F.array_join(F.sort_array(F.collect_list(row)), "\n").alias("rows"))
    markdown = F.concat(F.lit("| order | line | shipped | quantity | flag |\n| --- | --- | --- | --- | --- |\n"), F.col("rows"))
    lead = F.concat(F.lit("[TableEvidence | part="), F.col("l_partkey").cast("string"), F.lit("]"))
    return chunks.chunk_tables(rows.select(F.col("l_partkey").alias("table_id"), F.concat(lead, F.lit("\n\n"), markdown).alias("content"), markdown.alias("table_markdown")), overlap=1)


QUERIES = {
    "x13_chunk_tables": chunk_tables, "x12_chunk_text": chunk_text, "w13_chunk_overlap": chunk_overlap, "a34_chunk_contract": chunk_contract, "x32_normalize_tables": normalize_tables, "x14_extract_tables": extract_tables, "x15_table_quality": table_quality, "st1_stream_ingest": stream_ingest, "st2_stream_route": stream_route}
_CELLS = """l AS (SELECT l_partkey AS page_id, row_number() OVER (PARTITION BY l_partkey ORDER BY concat_ws('/', lpad(l_orderkey::VARCHAR, 9, '0'), l_linenumber, lpad(l_suppkey::VARCHAR, 7, '0'), lpad(l_quantity::INT::VARCHAR, 3, '0'), strftime(l_shipdate, '%Y%m%d'))) AS row, concat_ws('/', lpad(l_orderkey::VARCHAR, 9, '0'), l_linenumber, lpad(l_suppkey::VARCHAR, 7, '0'), lpad(l_quantity::INT::VARCHAR, 3, '0'), strftime(l_shipdate, '%Y%m%d')) AS a, CASE WHEN l_returnflag = 'R' THEN l_suppkey || ' & ' || l_returnflag ELSE l_suppkey::VARCHAR END AS b,
  CASE WHEN l_returnflag = 'R' THEN l_suppkey || ' & ' || l_returnflag WHEN l_linestatus = 'F' THEN '' ELSE l_returnflag END AS c, l_returnflag = 'R' AS merged FROM lineitem),
cells AS (SELECT page_id, 0 AS row, unnest([0, 1, 2]) AS col, unnest(['order', 'mode', 'flag']) AS text, true AS is_header, false AS is_merged FROM l GROUP BY 1 UNION ALL SELECT page_id, row, 0, a, false, false FROM l UNION ALL SELECT page_id, row, 1, b, false, false FROM l UNION ALL SELECT page_id, row, 2, c, false, merged FROM l)"""
_OUTPUTS = """o AS (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS day, 'Clerk  ' || o_orderpriority AS bare, 'clerk ' || o_custkey AS o_clerk FROM orders),
f AS (SELECT *, '| ' || o_clerk || ' | ' || day || ' |' AS pipe, '{"pred_html":"<table><tr><th>clerk</th><th>day</th></tr><tr><td>' || o_clerk || '</td><td>' || day || '</td></tr></table>","ocr_text":"' || bare || '","provenance_id":"up-' || o_custkey || '"}' AS made,
  '{"metadata":{"content_type":"text"},"content":"' || bare || '"}' AS words, '"[Table on page ' || o_custkey || ']"' AS lost FROM o),
j AS (SELECT o_custkey AS doc_id, o_clerk AS source, o_orderkey AS page_number, CASE WHEN o_orderstatus = 'O' THEN 'L2' ELSE 'L3' END AS layer, o_orderstatus = 'P' AS second, lower(o_orderpriority) AS candidate_reasons,
  ['"' || pipe || '"', made, '{"tables":[7,{"table_html":"<p>none</p>","content":"' || bare || '"},' || lost || ',{"content":"' || pipe || '","table_conversion":"' || CASE WHEN o_orderstatus = 'F' THEN 'Placeholder' ELSE 'full' END || '"}]}',
   '[' || words || ',{"metadata":{"content_type":"table","table_markdown":"' || pipe || '"}},' || lost || ',[' || made || ']]', words, '3.5'][(o_custkey + len(o_orderpriority)) % 6 + 1]::JSON AS j FROM f),
i0 AS (SELECT *, CASE WHEN json_type(j) = 'ARRAY' THEN j->'$[*]' WHEN json_type(j->'$.tables') = 'ARRAY' THEN j->'$.tables[*]' ELSE [j] END AS items FROM j),
i1 AS (SELECT * EXCLUDE (items, j), flatten(list_transform(items, lambda x: CASE WHEN json_type(x) = 'ARRAY' THEN x->'$[*]' ELSE [x] END)) AS items FROM i0),
i2 AS (SELECT * EXCLUDE (items), unnest(items) AS x, generate_subscripts(items, 1) AS pos FROM i1),
i3 AS (SELECT *, json_type(x) AS kind, coalesce(x->>'$.pred_html', x->>'$.table_html', '') AS html, coalesce(x->>'$.metadata.table_markdown', '') AS given, CASE WHEN json_type(x) = 'VARCHAR' THEN x->>'$' ELSE coalesce(x->>'$.ocr_text', x->>'$.content', '') END AS plain FROM i2
  WHERE json_type(x) = 'VARCHAR' OR (json_type(x) = 'OBJECT' AND (coalesce(x->>'$.metadata.content_type', 'table') = 'table' OR json_exists(x, '$.pred_html')))),
i4 AS (SELECT *, row_number() OVER (PARTITION BY page_number ORDER BY pos) AS raw, CASE WHEN given <> '' THEN given WHEN contains(html, '<table') THEN regexp_replace(regexp_replace(replace(html, '<table><tr><th>clerk</th><th>day</th></tr><tr><td>', '| clerk | day |' || chr(10) || '| --- | --- |' || chr(10) || '| '), '</td><td>', ' | '), '</td>.*', ' |') WHEN html <> '' THEN regexp_replace(plain, '\\s+', ' ', 'g') ELSE '' END AS markdown FROM i3),
i5 AS (SELECT *, CASE WHEN markdown <> '' THEN markdown ELSE plain END AS content FROM i4)"""
SQL = {
    "x14_extract_tables": f"WITH {_CELLS} SELECT page_id, 0::BIGINT AS table_index, row::BIGINT AS row, col::BIGINT AS col, text, is_header, is_merged FROM cells",
    "x15_table_quality": f"WITH {_CELLS}, q AS (SELECT page_id, max(row)::BIGINT + 1 AS n_rows, max(col)::BIGINT + 1 AS n_cols, count(*) FILTER (text <> '') / count(*)::DOUBLE AS fill, bool_or(is_merged) AS merged FROM cells GROUP BY 1), s AS (SELECT *, CAST(round(CAST(0.35::DOUBLE + 0.25::DOUBLE + 0.25::DOUBLE + fill * 0.15::DOUBLE - CASE WHEN merged THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END AS DECIMAL(38,10)), 4) AS DOUBLE) AS score FROM q) SELECT page_id, n_rows, n_cols, round(fill, 9) AS fill, score, CASE WHEN fill = 0 THEN 'empty' WHEN score >= 0.8 THEN 'good' WHEN score >= 0.6 THEN 'usable' ELSE 'degraded' END AS grade FROM s",
    "x32_normalize_tables": f"""WITH {_OUTPUTS}, k AS (SELECT *, row_number() OVER (PARTITION BY page_number ORDER BY raw) AS table_index FROM i5 WHERE content <> '' AND lower(coalesce(x->>'$.table_conversion', '')) <> 'placeholder' AND NOT contains(lower(content), '[table on page'))
SELECT doc_id, source, page_number, layer AS parser_layer, table_index, 'doc_' || doc_id || ':page_' || page_number || ':table_' || table_index AS table_id, 'doc_' || doc_id || ':page_' || page_number || ':' || lower(layer) || ':table_' || raw AS provenance_id, coalesce(x->>'$.provenance_id', '') AS upstream_provenance_id,
  CASE WHEN layer = 'L2' THEN 'L1->L2' WHEN second THEN 'L1->L2->L3' ELSE 'L1->L3' END AS route_path, CASE WHEN second THEN 'L2' ELSE '' END AS fallback_from, CASE WHEN second THEN 'timeout' ELSE '' END AS fallback_reason, candidate_reasons,
  '[Table | source=' || source || ' | page=' || page_number || ']' || chr(10) || chr(10) || content AS content, markdown AS table_markdown, html AS table_html FROM k""",
    "st2_stream_route": f"""WITH {_ROUTED} SELECT request_id, 'chat' AS action, '{{"message_length":' || len(message) || '}}' AS input_summary, '{{"route":"' || route || '","confidence":' || confidence || '}}' AS result_summary FROM r"""}
