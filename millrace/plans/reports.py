"""Queries on files, answers, index versions and evidence, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators import answers, evaluate, routing
from millrace.operators.metrics import rounded
from millrace.sources import facts, io
from millrace.sources.facts import table
from millrace.streaming.jobs import shared_folder

from .retrieval import _FUSED, _HITS, _chunks, _fused, _hits, _per_query, _r


def read_query_set(s, d):
    path = shared_folder(s, "queries")
    table(s, d, "benchmark").select(F.col("item_id").cast("string").alias("case_id"), F.col("text").alias("question")).write.json(path)
    return io.read_query_set(s, path)


def export_csv(s, d):
    path = shared_folder(s, "csv")
    io.export_csv(table(s, d, "customer").select("c_custkey", "c_name", "c_nationkey"), path)
    back = s.read.option("header", True).csv(path)
    return back.toDF(*[c.lstrip("﻿") for c in back.columns]).select(F.col("c_custkey").cast("long"), "c_name", F.col("c_nationkey").cast("long"))


def export_report(s, d):
    return io.export_report(table(s, d, "supplier").select("s_suppkey", "s_name"), ["s_suppkey"]).withColumn("line_number", F.col("line_number").cast("long"))


def row_cap(s, d):
    from millrace.operators.scope import row_cap as cap

    return cap(table(s, d, "orders").orderBy("o_orderkey").select("o_orderkey"), 5000, 1000)


def index_delete(s, d):
    rows = table(s, d, "documents").select("doc_id", (F.col("doc_id") % 3).alias("version"))
    return rows.join(rows.where("doc_id % 6 = 1"), ["doc_id", "version"], "left_anti").groupBy("version").agg(F.count(F.lit(1)).alias("n"))


def legacy_backfill(s, d):
    v = F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("v"), F.col("doc_id") % 4))
    return table(s, d, "documents").select(F.coalesce(v, F.lit("legacy")).alias("index_version")).groupBy("index_version").agg(F.count(F.lit(1)).alias("n"))


def query_expansion(s, d):
    alias = F.array(F.col("text"), F.concat("text", F.lit(" amount")), F.concat("text", F.lit(" ratio")))
    return table(s, d, "benchmark").select("item_id", F.posexplode(alias).alias("variant", "query")).withColumn("variant", F.col("variant").cast("long"))


def owned_conversation(s, d):
    c = table(s, d, "conversations").where("conv_id is not null").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns")).withColumn("owner", F.col("conv_id") % 7)
    kb = table(s, d, "customer").select(F.col("c_custkey").alias("kb_id"), (F.col("c_custkey") % 5).alias("kb_owner"))
    return c.join(kb, (F.col("conv_id") == F.col("kb_id")) & (F.col("owner") == F.col("kb_owner"))).select("conv_id", "n_turns")


def parent_page_join(s, d):
    hits = _fused(s, d).join(_chunks(s, d).select("chunk_id", "source"), "chunk_id")
    rr = F.sort_array(F.collect_list(1 / F.col("rank")), False)
    return hits.groupBy("query_id", "source").agg(F.count(F.lit(1)).alias("n_children"), F.min("rank").alias("best_rank"), rr.alias("rr")).select("query_id", "source", "n_children", "best_rank", rounded(F.aggregate(F.slice("rr", 1, 3), F.lit(0.0), lambda a, x: a + x), 6).alias("top3"))


def v2_topk(s, d):
    rows = _fused(s, d).join(_chunks(s, d).select("chunk_id", "source", "lang"), "chunk_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "best_rank", "source", "lang", "chunk_id")
    return rows.select("query_id", "chunk_id", F.row_number().over(w).alias("position")).where("position <= 5")


def audit_recent(s, d):
    c = table(s, d, "conversations").where("conv_id is not null and text is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), "role", F.to_json(F.struct(F.length("text").alias("message_length"))).alias("input_summary"))
    w = Window.partitionBy("role").orderBy(F.desc("request_id"))
    top = c.withColumn("n", F.row_number().over(w)).where("n <= 20")
    return top.select("role", "request_id", F.from_json("input_summary", "message_length long")["message_length"].alias("message_length"))


def channel_rank(s, d):
    f = _fused(s, d)
    return f.groupBy("channels").agg(F.count(F.lit(1)).alias("n"), F.min("best_rank").alias("best_rank"))


def miss_reasons(s, d):
    h = _per_query(s, d).where("hit_rank is null")
    q = F.col("query_id")
    return answers.miss_reasons(h.select(q.alias("case_id"), (q % 2 == 0).alias("report"), (q % 3 != 0).alias("page"), (q % 5 != 0).alias("metric"), (q % 7 != 0).alias("value"))).select("case_id", F.array_join("reasons", ",").alias("reasons"))


def answer_metrics(s, d):
    q = table(s, d, "orders")
    k = F.col("o_orderkey")
    scored = q.select(F.col("o_orderpriority").alias("profile"), (k % 3 == 0).alias("should_refuse"), (k % 4 != 0).alias("answered"), (k % 5 != 0).alias("correct"), (k % 7 != 0).alias("citations_valid"), (k % 11 == 0).alias("provider_error"))
    return answers.answer_metrics(scored)


def retrieval_recall(s, d):
    hit = F.col("hit") & (F.col("rank") <= 5)
    return _hits(s, d).groupBy("query_id").agg(F.bool_or(hit).alias("found")).agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(F.col("found").cast("double")), 6).alias("recall"))


def improvement(s, d):
    m = evaluate.recall_mrr(_per_query(s, d))
    points, percent = evaluate.improvement(F.lit(0.25), F.col("recall_at_5"))
    return m.select(points.alias("points"), percent.alias("percent"))


def case_align(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("case_id"))
    return answers.case_align(docs.where("case_id % 11 <> 0"), docs.where("case_id % 13 <> 0"), docs.unionByName(docs.where("case_id % 17 = 0")))


def agent_eval(s, d):
    k = F.col("conv_id")
    c = table(s, d, "conversations").where("conv_id is not null").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"))
    ok = answers.subsequence(F.array(F.lit("user"), F.lit("user")), F.col("roles"))
    rows = c.select((k % 3).cast("string").alias("category"), ok.alias("tools"), F.when(k % 4 != 0, k % 5 != 0).alias("scope"))
    return answers.rag_eval(rows, "category", ["tools", "scope"])


def routed_counts(s, d):
    layer = F.when(F.col("n_chars") < 300, "L3").when(F.col("n_chars") < 2000, "L1").otherwise("L2")
    return table(s, d, "documents").select("source", layer.alias("layer")).groupBy("source").pivot("layer", ["L1", "L2", "L3"]).count().fillna(0)


def report_counts(s, d):
    return table(s, d, "documents").groupBy("source").agg(F.countDistinct("lang").alias("n_tables"), F.count(F.lit(1)).alias("n_chunks"))


def active_targets(s, d):
    docs = table(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 9 != 0, F.concat(F.lit("v"), F.col("doc_id") % 2)).alias("active_index_version"), (F.col("doc_id") % 3 == 0).alias("ready"))
    return docs.where("ready").agg(F.count(F.lit(1)).alias("targets"), F.count(F.when(F.coalesce("active_index_version", F.lit("")) == "", 1)).alias("blank"))


def table_index(s, d):
    w = Window.partitionBy("source").orderBy("lang", "doc_id")
    return table(s, d, "documents").select("source", "doc_id", (F.row_number().over(w) - 1).cast("long").alias("chunk_index"))


def nearest_context(s, d):
    """The nearest text block before and after each table block (every fifth document) of a source, cut to 200 characters."""
    # what comes after is what comes before in the other order: a frame that shrinks from row to row would be read anew for each
    w = lambda order: Window.partitionBy("source").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = table(s, d, "documents").select("source", "doc_id", F.when(F.col("doc_id") % 5 != 0, F.substring("text", 1, 200)).alias("t"))
    rows = rows.withColumn("before", F.last("t", True).over(w(F.col("doc_id")))).withColumn("after", F.last("t", True).over(w(F.desc("doc_id"))))
    return rows.where("doc_id % 5 = 0").select("doc_id", F.sha2("before", 256).alias("before"), F.sha2("after", 256).alias("after"))


def table_continuation(s, d):
    """Blocks without an own title inherit it along a chain of equal headers: islands between breaks."""
    w = Window.partitionBy("source").orderBy("doc_id")
    rows = table(s, d, "documents").select("source", "doc_id", "lang", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("t"), F.col("doc_id"))).alias("title"))
    rows = rows.withColumn("fresh", (~F.lag("lang").over(w).eqNullSafe(F.col("lang")) | F.col("title").isNotNull()).cast("int")).withColumn("island", F.sum("fresh").over(w))
    return rows.select("source", "doc_id", F.first("title").over(Window.partitionBy("source", "island").orderBy("doc_id")).alias("title"))


def format_evidence(s, d):
    rows = _fused(s, d).where("rank <= 3").join(_chunks(s, d).select("chunk_id", "source"), "chunk_id")
    block = F.format_string("[C%d] source: %s, chunk %d", "rank", "source", "chunk_id")
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]), "\n").alias("evidence"))


def text_clean_match(s, d):
    squeeze = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    return table(s, d, "documents").where(F.forall(F.array(F.lit("licensed under"), F.lit("license")), lambda k: squeeze(F.col("text")).contains(squeeze(k)))).select("doc_id")


def local_eta(s, d):
    ship = facts.shipments(s, d)
    return ship.select("order_id", F.date_format(F.from_utc_timestamp("estimated_delivery_at", F.when(F.col("order_id") % 2 == 0, "UTC").otherwise("Asia/Shanghai")), "yyyy-MM-dd HH:mm:ss").alias("local_eta"))


def order_no(s, d):
    text = F.concat(F.lit("please check vlt-"), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("-12")).otherwise(F.lit("-2024 now")))
    return table(s, d, "orders").select("o_orderkey", routing.order_no(text).alias("order_no"))


def pending_pages(s, d):
    routed = table(s, d, "pages").where("page_id % 2 = 0").select("page_id")
    done = table(s, d, "pages").where("page_id % 3 = 0").select("page_id")
    return routed.join(done, "page_id", "left_anti")


def publish_version(s, d):
    docs = table(s, d, "documents").select("doc_id", (F.col("doc_id") % 3).alias("active"))
    asked = table(s, d, "documents").select(F.col("doc_id").alias("a_id"), (F.col("doc_id") % 2).alias("expected"), (F.col("doc_id") % 2 + 10).alias("new"))
    both = docs.join(asked, F.col("doc_id") == F.col("a_id"), "left")
    return both.select("doc_id", F.when(F.col("active") == F.col("expected"), F.col("new")).otherwise(F.col("active")).alias("active"))


def run_audit(s, d):
    c = table(s, d, "conversations").where("text is not null")
    return c.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), evaluate.nearest_rank_percentile("length(text)", 0.5).alias("p50"))


def active_builds(s, d):
    o = table(s, d, "orders")
    result = F.to_json(F.struct(F.concat(F.lit("v"), F.col("o_custkey") % 4).alias("pending_index_version")))
    jobs = o.select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "queued").when(F.col("o_orderkey") % 4 == 1, "running").otherwise("done").alias("status"), result.alias("result"))
    return jobs.where(F.col("status").isin("queued", "running", "stale")).select(F.get_json_object("result", "$.pending_index_version").alias("version")).groupBy("version").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "s10_read_query_set": read_query_set, "s13_export_csv": export_csv, "s14_export_report": export_report, "p03_row_cap": row_cap, "s18_index_delete": index_delete, "s19_legacy_version_backfill": legacy_backfill, "p16_query_expansion": query_expansion, "j08_owned_conversation": owned_conversation,
    "j15_parent_page_join": parent_page_join, "t05_v2_topk": v2_topk, "t03_audit_recent": audit_recent, "w03_best_channel_rank": channel_rank, "a12_miss_reasons": miss_reasons, "a14_answer_metrics": answer_metrics, "a18_retrieval_recall": retrieval_recall, "a19_improvement": improvement, "j16_three_way_case_align": case_align,
    "a24_agent_eval": agent_eval, "a28_routed_corpus_counts": routed_counts, "a29_chunk_report_counts": report_counts, "a32_kb_active_targets": active_targets, "w16_table_index": table_index, "w10_nearest_context": nearest_context, "w12_table_continuation": table_continuation, "x31_format_evidence": format_evidence,
    "x30_text_clean_match": text_clean_match, "r08_local_eta": local_eta, "r05_order_no_extract": order_no, "o04_pending_pages": pending_pages, "o05_publish_version": publish_version, "o06_run_audit": run_audit, "o07_active_builds": active_builds,
}

_share = lambda hit, of="true": f"CAST(round(CAST((count(*) FILTER (({hit}) AND ({of})))::DOUBLE / nullif(count(*) FILTER ({of}), 0) AS DECIMAL(38,10)), 6) AS DOUBLE)"
SQL = {
    "s10_read_query_set": "SELECT item_id::VARCHAR AS case_id, text AS question FROM benchmark",
    "s13_export_csv": "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey FROM customer",
    "s14_export_report": "WITH k AS (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS rn FROM supplier) SELECT 0::BIGINT AS line_number, '| s_suppkey | s_name |' AS line UNION ALL SELECT 1, '| --- | --- |' UNION ALL SELECT rn + 1, '| ' || s_suppkey || ' | ' || s_name || ' |' FROM k WHERE rn <= 20 UNION ALL SELECT 22, count(*) || ' rows' FROM k",
    "p03_row_cap": "SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 1000",
    "s18_index_delete": "SELECT doc_id % 3 AS version, count(*) AS n FROM documents WHERE doc_id % 6 <> 1 GROUP BY 1",
    "s19_legacy_version_backfill": "SELECT CASE WHEN doc_id % 4 = 0 THEN 'legacy' ELSE 'v' || doc_id % 4 END AS index_version, count(*) AS n FROM documents GROUP BY 1",
    "p16_query_expansion": "SELECT item_id, 0::BIGINT AS variant, text AS query FROM benchmark UNION ALL SELECT item_id, 1, text || ' amount' FROM benchmark UNION ALL SELECT item_id, 2, text || ' ratio' FROM benchmark",
    "j08_owned_conversation": "SELECT conv_id, count(*) AS n_turns FROM conversations JOIN customer ON conv_id = c_custkey WHERE conv_id % 7 = c_custkey % 5 GROUP BY 1",
    "j15_parent_page_join": f"WITH {_FUSED}, h AS (SELECT fused.*, source, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS k FROM fused JOIN documents ON chunk_id = doc_id WHERE rank <= 100) SELECT query_id, source, count(*) AS n_children, min(rank) AS best_rank, {_r('sum(CASE WHEN k <= 3 THEN 1.0::DOUBLE / rank END)', 6)} AS top3 FROM h GROUP BY 1, 2",
    "t05_v2_topk": f"WITH {_FUSED} SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, best_rank, source, lang, chunk_id) AS position FROM fused JOIN documents ON chunk_id = doc_id WHERE rank <= 100 QUALIFY position <= 5",
    "t03_audit_recent": "SELECT role, conv_id * 1000 + turn AS request_id, len(text)::BIGINT AS message_length FROM conversations WHERE conv_id IS NOT NULL AND text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY role ORDER BY conv_id * 1000 + turn DESC) <= 20",
    "w03_best_channel_rank": f"WITH {_FUSED} SELECT channels, count(*) AS n, min(best_rank) AS best_rank FROM fused WHERE rank <= 100 GROUP BY 1",
    "a12_miss_reasons": f"WITH {_HITS}, w AS (SELECT query_id AS case_id, array_to_string(list_filter([CASE WHEN query_id % 2 <> 0 THEN 'report_missing' END, CASE WHEN query_id % 3 = 0 THEN 'page_missing' END, CASE WHEN query_id % 5 = 0 THEN 'metric_missing' END, CASE WHEN query_id % 7 = 0 THEN 'value_missing' END], lambda x: x IS NOT NULL), ',') AS reasons FROM pq WHERE hit_rank IS NULL) SELECT case_id, CASE WHEN reasons = '' THEN 'not_in_same_context' ELSE reasons END AS reasons FROM w",
    "a14_answer_metrics": f"WITH k AS (SELECT o_orderpriority AS profile, o_orderkey % 3 = 0 AS refuse, o_orderkey % 4 <> 0 AS answered, o_orderkey % 5 <> 0 AS correct, o_orderkey % 7 <> 0 AS cit, o_orderkey % 11 = 0 AS err FROM orders) SELECT profile, count(*) AS n, {_share('answered', 'NOT refuse')} AS coverage, {_share('correct AND NOT refuse', 'answered')} AS strict_precision, {_share('cit', 'answered')} AS citation_validity, {_share('refuse', 'NOT answered')} AS refusal_precision, {_share('NOT answered', 'refuse')} AS refusal_recall, {_share('err')} AS provider_error_rate FROM k GROUP BY 1",
    "a18_retrieval_recall": f"WITH {_HITS}, q AS (SELECT query_id, bool_or(hit AND rank <= 5) AS found FROM hits GROUP BY 1) SELECT count(*) AS n, {_r('avg(found::INT::DOUBLE)', 6)} AS recall FROM q",
    "a19_improvement": f"WITH {_HITS}, m AS (SELECT {_r('(count(*) FILTER (hit_rank <= 5))::DOUBLE / count(*)', 6)} AS r FROM pq) SELECT {_r('(r - 0.25::DOUBLE) * 100', 4)} AS points, {_r('(r - 0.25::DOUBLE) * 100 / 0.25::DOUBLE', 4)} AS percent FROM m",
    "j16_three_way_case_align": "WITH k AS (SELECT doc_id AS case_id, (doc_id % 11 <> 0)::INT::BIGINT AS candidates, (doc_id % 13 <> 0)::INT::BIGINT AS generations, 1 + (doc_id % 17 = 0)::INT::BIGINT AS truths FROM documents) SELECT * FROM k WHERE candidates <> 1 OR generations <> 1 OR truths <> 1",
    "a24_agent_eval": f"WITH k AS (SELECT conv_id, (conv_id % 3)::VARCHAR AS category, (count(*) FILTER (role = 'user') >= 2)::INT::DOUBLE AS tools, CASE WHEN conv_id % 4 <> 0 THEN (conv_id % 5 <> 0)::INT::DOUBLE END AS scope FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1), b AS (SELECT category, tools, scope FROM k UNION ALL SELECT 'overall', tools, scope FROM k) SELECT category, {_r('avg(tools)', 6)} AS tools, {_r('avg(scope)', 6)} AS scope FROM b GROUP BY 1",
    "a28_routed_corpus_counts": "SELECT source, count(*) FILTER (n_chars >= 300 AND n_chars < 2000) AS L1, count(*) FILTER (n_chars >= 2000) AS L2, count(*) FILTER (n_chars < 300) AS L3 FROM documents GROUP BY 1",
    "a29_chunk_report_counts": "SELECT source, count(DISTINCT lang) AS n_tables, count(*) AS n_chunks FROM documents GROUP BY 1",
    "a32_kb_active_targets": "SELECT count(*) AS targets, count(*) FILTER (doc_id % 9 = 0) AS blank FROM documents WHERE doc_id % 3 = 0",
    "w16_table_index": "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY lang, doc_id) - 1 AS chunk_index FROM documents",
    "w10_nearest_context": "WITH k AS (SELECT doc_id, sha256(last_value(CASE WHEN doc_id % 5 <> 0 THEN substr(text, 1, 200) END IGNORE NULLS) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS before, sha256(first_value(CASE WHEN doc_id % 5 <> 0 THEN substr(text, 1, 200) END IGNORE NULLS) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS after FROM documents) SELECT * FROM k WHERE doc_id % 5 = 0",
    "w12_table_continuation": "WITH a AS (SELECT source, doc_id, lang, CASE WHEN doc_id % 4 = 0 THEN 't' || doc_id END AS title, lag(lang) OVER (PARTITION BY source ORDER BY doc_id) IS DISTINCT FROM lang OR doc_id % 4 = 0 AS fresh FROM documents), b AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY source ORDER BY doc_id) AS island FROM a) SELECT source, doc_id, first_value(title) OVER (PARTITION BY source, island ORDER BY doc_id) AS title FROM b",
    "x31_format_evidence": f"WITH {_FUSED} SELECT query_id, string_agg('[C' || rank || '] source: ' || source || ', chunk ' || chunk_id, chr(10) ORDER BY rank) AS evidence FROM fused JOIN documents ON chunk_id = doc_id WHERE rank <= 3 GROUP BY 1",
    "x30_text_clean_match": r"SELECT doc_id FROM documents WHERE contains(regexp_replace(lower(text), '\s+', '', 'g'), 'licensedunder')",
    "r08_local_eta": "SELECT l_orderkey AS order_id, strftime(max(l_shipdate) + CASE WHEN l_orderkey % 2 = 0 THEN INTERVAL 0 HOUR ELSE INTERVAL 8 HOUR END, '%Y-%m-%d %H:%M:%S') AS local_eta FROM lineitem WHERE l_orderkey % 7 <> 0 GROUP BY l_orderkey",
    "r05_order_no_extract": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN 'VLT-' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') || '-2024' END AS order_no FROM orders",
    "o04_pending_pages": "SELECT page_id FROM pages WHERE page_id % 2 = 0 AND page_id % 3 <> 0",
    "o05_publish_version": "SELECT doc_id, CASE WHEN doc_id % 3 = doc_id % 2 THEN doc_id % 2 + 10 ELSE doc_id % 3 END AS active FROM documents",
    "o06_run_audit": "SELECT role, count(*) AS n, sum(len(text))::BIGINT AS chars, quantile_disc(len(text), 0.5)::DOUBLE AS p50 FROM conversations WHERE text IS NOT NULL GROUP BY 1",
    "o07_active_builds": "SELECT 'v' || o_custkey % 4 AS version, count(*) AS n FROM orders WHERE o_orderkey % 4 IN (0, 1) GROUP BY 1",
}
