"""Queries on messages, jobs and versions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import jobs, routing
from millrace.sources.facts import table

NOW = "1998-01-01 00:00:00"
#: Words that occur in the invented messages, in the place of the stock keywords.
RULES = (("order_query", 0.85, ("onst", "éau")), ("logistics_tracking", 0.88, ("thre", "lich")), ("product_inquiry", 0.85, ("ing",)))
ISSUES = (("damaged", ("onst",)), ("lost", ("thre",)), ("return_request", ("ing",)))
ACTIONS = (("refund", ("the ",)), ("return", ("en ",)))


def _messages(s, d):
    c = table(s, d, "conversations").where("conv_id is not null and text is not null")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), "role", F.col("text").alias("message"))


def _jobs(s, d):
    o = table(s, d, "orders")
    k = F.col("o_orderkey")
    status = F.when(k % 4 == 0, "queued").when(k % 4 == 1, "running").when(k % 4 == 2, "succeeded").otherwise("failed")
    return o.select(
        k.alias("id"), (k % 100).alias("document_id"), F.col("o_orderpriority").alias("job_type"), status.alias("status"), (k % 3).alias("priority"), (k % 6).cast("int").alias("attempt_count"), F.lit(5).alias("max_attempts"),
        F.col("o_orderdate").alias("available_at"), F.col("o_orderdate").alias("lease_expires_at"), F.col("o_orderdate").alias("created_at"), F.concat(F.lit("k"), F.col("o_custkey")).alias("idempotency_key"),
    )


def _now():
    return F.lit(NOW).cast("timestamp")


def route_messages(s, d):
    return routing.route_messages(_messages(s, d), RULES).select("request_id", "route", "confidence")


def aftersales(s, d):
    return routing.aftersales_classify(_messages(s, d), ISSUES, ACTIONS).select("request_id", "issue_type", "requested_action")


def aftersales_policy(s, d):
    rows = routing.aftersales_classify(_messages(s, d), ISSUES, ACTIONS).withColumn("order_status", F.get(F.array(*map(F.lit, ("paid", "cancelled", "delivered"))), (F.col("request_id") % 3).cast("int")))
    got = routing.aftersales_policy(rows.select("request_id", "issue_type", "requested_action", "order_status"), *routing.rule_tables(s))
    return got.select("request_id", "proposed_action", "eligible_for_review", F.size("required_evidence").cast("long").alias("n_evidence"), "policy_code")


def audit_events(s, d):
    return routing.audit_events(routing.route_messages(_messages(s, d), RULES))


def route_eval(s, d):
    got = routing.route_messages(_messages(s, d), RULES)
    want = F.when(F.col("role") == "user", "order_query").otherwise("unsupported")
    return got.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("route") == want, 1)).alias("n_right"))


def job_health(s, d):
    return jobs.job_health(_jobs(s, d), _now()).groupBy("job_type", "health").agg(F.count(F.lit(1)).alias("n"))


def retry_schedule(s, d):
    return jobs.retry_schedule(_jobs(s, d).where("status = 'failed'"), _now()).select("id", "wait_s", F.date_format("next_at", "yyyy-MM-dd HH:mm:ss").alias("next_at"))


def job_counts(s, d):
    return jobs.job_counts(_jobs(s, d))


def idempotent_enqueue(s, d):
    """Over every job: those with id % 3 = 0 are there, all others come in."""
    j = _jobs(s, d)
    return jobs.idempotent_enqueue(j.where("id % 3 = 0"), j.where("id % 3 <> 0")).select("id", "idempotency_key")


def backlog(s, d):
    return jobs.backlog_order(_jobs(s, d), _now()).select("job_type", "id", F.col("position").cast("long").alias("position"))


def version_counts(s, d):
    return table(s, d, "documents").groupBy("source", (F.col("doc_id") % 3).alias("version")).agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("doc_id").alias("n_docs"))


def key_difference(s, d):
    docs = table(s, d, "documents")
    return jobs.key_difference(docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 7 <> 0"), "doc_id")


def artifact_audit(s, d):
    p = table(s, d, "pages").select("page_id", F.sha2(F.coalesce("html", F.lit("")), 256).alias("sha"))
    a = p.where("page_id % 5 <> 0").select(F.when(F.col("page_id") % 11 == 0, F.col("page_id") + 1000000000).otherwise(F.col("page_id")).alias("page_id"), F.when(F.col("page_id") % 7 == 0, "old").otherwise(F.col("sha")).alias("sha"), (F.col("page_id") % 3 != 0).alias("ok"))
    return jobs.artifact_audit(p, a)


def coverage(s, d):
    docs = table(s, d, "documents")
    return jobs.candidate_coverage(docs.select("source", F.col("doc_id").alias("page")), docs.where("doc_id % 3 <> 0").select("source", F.col("doc_id").alias("page"), (F.col("doc_id") % 3 == 1).alias("dropped"))).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def corpus_append(s, d):
    docs = table(s, d, "documents").select("doc_id", "source")
    both = docs.where("doc_id % 2 = 0").withColumn("layer", F.lit("L1")).unionByName(docs.where("doc_id % 2 = 1").withColumn("layer", F.lit("tables")))
    return both.groupBy("source", "layer").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "r01_route_messages": route_messages, "r06_aftersales_classify": aftersales, "j18_decision_table_join": aftersales_policy, "r09_audit_events": audit_events, "a23_route_eval": route_eval, "o01_job_health": job_health, "o02_retry_schedule": retry_schedule, "a21_job_counts": job_counts,
    "o03_idempotent_enqueue": idempotent_enqueue, "w17_job_backlog_order": backlog, "a22_version_counts": version_counts, "u03_key_difference": key_difference, "j10_artifact_audit": artifact_audit, "j09_candidate_coverage": coverage, "u04_corpus_append": corpus_append,
}

_MSG = "m AS (SELECT conv_id * 1000 + turn AS request_id, role, text AS message, lower(text) AS low FROM conversations WHERE conv_id IS NOT NULL AND text IS NOT NULL)"
_any = lambda words: "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"
_ROUTED = _MSG + ", r AS (SELECT *, CASE WHEN trim(low) = '' THEN 'unsupported' " + " ".join(f"WHEN {_any(w)} THEN '{n}'" for n, _, w in RULES) + " ELSE 'unsupported' END AS route, CASE WHEN trim(low) = '' THEN 1.0 " + " ".join(f"WHEN {_any(w)} THEN {c}" for _, c, w in RULES) + " ELSE 0.7 END::DOUBLE AS confidence FROM m)"
_case = lambda rules, other: "CASE " + " ".join(f"WHEN {_any(w)} THEN '{n}'" for n, w in rules) + f" ELSE '{other}' END"
_CLASSED = _MSG + f", c AS (SELECT *, {_case(ISSUES, 'other')} AS issue_type, {_case(ACTIONS, 'investigate')} AS requested_action, ['paid','cancelled','delivered'][(request_id % 3)::INT + 1] AS order_status FROM m)"
_JOBS = "j AS (SELECT o_orderkey AS id, o_orderkey % 100 AS document_id, o_orderpriority AS job_type, CASE o_orderkey % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'succeeded' ELSE 'failed' END AS status, o_orderkey % 3 AS priority, (o_orderkey % 6)::INT AS attempt_count, 5 AS max_attempts, o_orderdate AS due, 'k' || o_custkey AS idempotency_key FROM orders)"

SQL = {
    "r01_route_messages": f"WITH {_ROUTED} SELECT request_id, route, confidence FROM r",
    "r06_aftersales_classify": f"WITH {_CLASSED} SELECT request_id, issue_type, requested_action FROM c",
    "j18_decision_table_join": f"WITH {_CLASSED} SELECT request_id, CASE WHEN order_status = 'cancelled' THEN 'manual_resolution_review' WHEN requested_action IN ('refund', 'return') THEN requested_action || '_review' WHEN issue_type = 'lost' THEN 'carrier_investigation' ELSE 'manual_resolution_review' END AS proposed_action, order_status <> 'cancelled' AS eligible_for_review, CASE issue_type WHEN 'damaged' THEN 2 WHEN 'return_request' THEN 1 ELSE 0 END::BIGINT AS n_evidence, 'V1-' || upper(issue_type) AS policy_code FROM c",
    "r09_audit_events": f"""WITH {_ROUTED} SELECT request_id, 'chat' AS action, '{{"message_length":' || len(message) || '}}' AS input_summary, '{{"route":"' || route || '","confidence":' || confidence || '}}' AS result_summary FROM r""",
    "a23_route_eval": f"WITH {_ROUTED} SELECT role, count(*) AS n, count(*) FILTER (route = CASE WHEN role = 'user' THEN 'order_query' ELSE 'unsupported' END) AS n_right FROM r GROUP BY 1",
    "o01_job_health": f"WITH {_JOBS} SELECT job_type, CASE WHEN status = 'running' AND due < TIMESTAMP '{NOW}' THEN CASE WHEN attempt_count >= 5 THEN 'failed' ELSE 'stale' END WHEN status = 'running' THEN 'leased' WHEN status = 'queued' AND attempt_count >= 5 THEN 'failed' WHEN status = 'queued' AND due <= TIMESTAMP '{NOW}' THEN 'claimable' WHEN status = 'queued' THEN 'waiting' ELSE status END AS health, count(*) AS n FROM j GROUP BY 1, 2",
    "o02_retry_schedule": f"WITH {_JOBS}, w AS (SELECT id, CASE WHEN attempt_count < 5 THEN floor(least(3600.0, 30.0 * pow(2.0, attempt_count - 1)))::BIGINT END AS wait_s FROM j WHERE status = 'failed') SELECT id, wait_s, strftime(TIMESTAMP '{NOW}' + to_seconds(wait_s), '%Y-%m-%d %H:%M:%S') AS next_at FROM w",
    "a21_job_counts": f"WITH {_JOBS} SELECT document_id, " + ", ".join(f"count(*) FILTER (status = '{x}') AS {x}" for x in jobs.STATUSES) + ", count(*) AS total FROM j GROUP BY 1",
    "o03_idempotent_enqueue": f"WITH {_JOBS} SELECT min(id) AS id, idempotency_key FROM j WHERE id % 3 <> 0 AND idempotency_key NOT IN (SELECT idempotency_key FROM j WHERE id % 3 = 0) GROUP BY 2",
    "w17_job_backlog_order": f"WITH {_JOBS} SELECT job_type, id, row_number() OVER (PARTITION BY job_type ORDER BY priority DESC, due, id) AS position FROM j WHERE status = 'queued' AND due <= TIMESTAMP '{NOW}'",
    "a22_version_counts": "SELECT source, doc_id % 3 AS version, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs FROM documents GROUP BY 1, 2",
    "u03_key_difference": "SELECT DISTINCT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'unexpected' ELSE 'missing' END AS side FROM documents WHERE (doc_id % 5 = 0) <> (doc_id % 7 = 0)",
    "j10_artifact_audit": "WITH a AS (SELECT CASE WHEN page_id % 11 = 0 THEN page_id + 1000000000 ELSE page_id END AS a_id, page_id % 7 = 0 AS old, page_id % 3 <> 0 AS ok FROM pages WHERE page_id % 5 <> 0) SELECT coalesce(page_id, a_id) AS page_id, CASE WHEN page_id IS NULL THEN 'unexpected' WHEN a_id IS NULL THEN 'missing' WHEN old THEN 'stale' WHEN ok THEN 'completed' ELSE 'failed' END AS state FROM pages FULL JOIN a ON page_id = a_id",
    "j09_candidate_coverage": "SELECT CASE doc_id % 3 WHEN 0 THEN 'missing' WHEN 1 THEN 'dropped' ELSE 'selected' END AS bucket, count(*) AS n FROM documents GROUP BY 1",
    "u04_corpus_append": "SELECT source, CASE WHEN doc_id % 2 = 0 THEN 'L1' ELSE 'tables' END AS layer, count(*) AS n FROM documents GROUP BY 1, 2",
}
