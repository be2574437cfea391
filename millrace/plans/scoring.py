"""Queries on answers that are checked and scored from their texts, with their SQL.

Questions, answers, facts and evidence are written from orders; the SQL takes its verdicts from the same texts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import answers, factcheck, scoring
from millrace.sources.facts import table

PHRASES = ("价格", "库存数量", "配送时长", "关税税率", "电压")
KINDS = ("price", "inventory_quantity", "delivery_duration", "customs_duty_rate", "price")


def _of(words):
    return F.get(F.array(*map(F.lit, words)), F.col("pri") - 1)


def _orders(s, d):
    o = table(s, d, "orders")
    pri = F.substring("o_orderpriority", 1, 1).cast("int")
    total, c = F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.col("o_custkey")
    rows = o.select(F.col("o_orderkey").alias("id"), pri.alias("pri"), c.alias("c"), "o_orderstatus", F.concat(F.lit("SKU-"), c.cast("string"), F.lit("X")).alias("sku"), F.date_format(F.add_months("o_orderdate", 120), "yyyy-MM-dd").alias("day"), total.alias("total"))
    num = F.when(F.col("pri").isin(1, 5), F.col("total")).when(F.col("pri") == 2, (F.col("c") % 90 + 1).cast("string")).when(F.col("pri") == 3, (F.col("c") % 9 + 1).cast("string")).otherwise(F.concat((F.col("c") % 30).cast("string"), F.lit(".5")))
    rows = rows.withColumns({"num": num, "phrase": _of(PHRASES), "kind": _of(KINDS)})
    told = F.when(F.col("kind") == "price", F.concat(F.lit("USD "), "num")).when(F.col("pri") == 3, F.concat("num", F.lit(" days"))).when(F.col("pri") == 4, F.concat("num", F.lit("%"))).otherwise(F.col("num"))
    return rows.withColumn("told", told).withColumn("question", F.concat("sku", F.lit(" 在 "), "day", F.lit(" 的"), "phrase", F.lit("是多少？")))


def _facts(value):
    one = {"fact_type": F.col("kind"), "value_text": value, "unit": F.when(F.col("pri") == 3, "day").when(F.col("pri") == 4, "percent"), "currency": F.when(F.col("kind") == "price", "USD"), "sku": F.col("sku"), "date": F.when(F.col("c") % 5 != 0, F.col("day")).otherwise("2031-01-01")}
    cited = F.when(F.col("o_orderstatus") == "O", F.array(F.lit("C1"), F.lit("C2"))).otherwise(F.array(F.lit("C1")))
    return F.struct(*[one.get(f, F.lit(None)).cast("string").alias(f) for f in factcheck.FACT_FIELDS], cited.alias("citation_ids"))


def _answers(s, d):
    wrong = F.when(F.col("c") % 7 == 0, F.concat("num", F.lit("1")))
    text = F.concat("phrase", F.lit("为"), F.coalesce(wrong, "num"), F.when(F.col("o_orderstatus") == "O", "[C1] 与 [c2]").when(F.col("o_orderstatus") == "P", "，另有 8 件 [C1][C9]").otherwise(" [C1]"), F.lit("。"))
    first, second = _facts(F.coalesce(wrong, F.col("num"))), _facts(F.col("num"))
    facts = F.when(F.col("c") % 11 == 0, F.array().cast(factcheck.FACTS)).when(F.col("o_orderstatus") == "P", F.array(first, second)).otherwise(F.array(first))
    return _orders(s, d).select("id", "question", text.alias("answer_text"), facts.alias("facts"), "pri", "c")


def _ledger(s, d):
    o = _orders(s, d)
    whole = F.concat("day", F.lit(" "), "sku", F.lit(" 的"), "phrase", F.lit("为"), "told")
    one = F.concat(whole, F.lit("。"))
    two = F.when(F.col("c") % 2 == 0, F.concat(F.lit("SKU-1X 的库存数量为3；"), whole)).otherwise(F.concat("phrase", F.lit("为"), "told"))
    row = lambda n, c: o.select("id", F.lit(n).alias("citation_id"), F.concat("sku", F.lit(".pdf")).alias("source"), F.lit("text").alias("content_type"), c.alias("content"))
    return row("C1", one).unionByName(row("C2", two))


def verify_answers(s, d):
    got = factcheck.verify_answers(_answers(s, d).withColumnRenamed("id", "answer_id"), _ledger(s, d).withColumnRenamed("id", "answer_id"))
    return got.select("answer_id", "passed", F.array_join("errors", "|").alias("errors"), F.array_join("verified_citation_ids", ",").alias("verified"))


def _scores(s, d, profile):
    a = _answers(s, d)
    status = F.when((F.col("pri") == 5) & (F.col("c") % 2 == 0), "refused").otherwise("accepted")
    outputs = a.select(F.col("id").alias("case_id"), "question", status.alias("status"), "answer_text", "facts", F.lit(None).cast("array<string>").alias("given_errors"), F.lit(None).cast("string").alias("given_status"))
    t = {"fact_type": F.col("kind"), "expected_value": F.col("num"), "expected_unit": F.when(F.col("pri") == 3, "day").when(F.col("pri") == 4, "percent"), "expected_currency": F.when(F.col("kind") == "price", "USD"), "expected_date": F.col("day"), "expected_sku": F.concat("sku", F.when(F.col("c") % 13 == 0, "1").otherwise("")), "metric": F.col("phrase")}
    truths = _orders(s, d).select(F.col("id").alias("case_id"), (F.col("pri") == 5).alias("should_refuse"), *[t.get(f, F.lit(None)).cast("string").alias(f) for f in scoring.TRUTH_FIELDS])
    return scoring.score_answers(outputs, truths, _ledger(s, d).withColumnRenamed("id", "case_id"), profile)


def score_answers(s, d):
    got = _scores(s, d, "verified").select(F.lit("verified").alias("profile"), "*").unionByName(_scores(s, d, "legacy").select(F.lit("legacy").alias("profile"), "*"))
    return got.select("profile", "case_id", "accepted", "refused", "strict_correct", *[f"{f}_correct" for f in scoring.FIELDS], "citation_valid", "unknown_citation_accepted", "unsupported_numeric_accepted", "schema_error")


def answer_scores(s, d):
    """The report of scored answers, from the scores of their texts."""
    got = _scores(s, d, "verified")
    rows = got.select(F.lit("verified").alias("profile"), "should_refuse", F.col("accepted").alias("answered"), F.col("strict_correct").alias("correct"), F.coalesce("citation_valid", F.lit(False)).alias("citations_valid"), F.lit(False).alias("provider_error"))
    return answers.answer_metrics(rows)


QUERIES = {"v04_verify_answers": verify_answers, "v06_score_answers": score_answers, "a14_answer_scores": answer_scores}

_A = """o AS (SELECT o_orderkey AS id, o_orderpriority[1]::INT AS pri, o_custkey AS c, o_orderstatus AS st, 'SKU-' || o_custkey || 'X' AS sku, strftime(o_orderdate + INTERVAL 120 MONTH, '%Y-%m-%d') AS day, CAST(o_totalprice AS DECIMAL(18,2))::VARCHAR AS total FROM orders),
p AS (SELECT *, ['价格', '库存数量', '配送时长', '关税税率', '电压'][pri] AS phrase, ['price', 'inventory_quantity', 'delivery_duration', 'customs_duty_rate', 'price'][pri] AS kind, CASE WHEN pri IN (1, 5) THEN total WHEN pri = 2 THEN (c % 90 + 1)::VARCHAR WHEN pri = 3 THEN (c % 9 + 1)::VARCHAR ELSE (c % 30) || '.5' END AS num FROM o),
t AS (SELECT *, CASE WHEN kind = 'price' THEN 'USD ' || num WHEN pri = 3 THEN num || ' days' WHEN pri = 4 THEN num || '%' ELSE num END AS told, CASE WHEN c % 7 = 0 THEN num || '1' ELSE num END AS said FROM p),
a AS (SELECT *, sku || ' 在 ' || day || ' 的' || phrase || '是多少？' AS question, phrase || '为' || said || CASE st WHEN 'O' THEN '[C1] 与 [c2]' WHEN 'P' THEN '，另有 8 件 [C1][C9]' ELSE ' [C1]' END || '。' AS answer_text, CASE WHEN c % 5 <> 0 THEN day ELSE '2031-01-01' END AS fday,
  CASE WHEN c % 11 = 0 THEN [] WHEN st = 'P' THEN [said, num] ELSE [said] END AS vals, CASE WHEN st = 'O' THEN ['C1', 'C2'] ELSE ['C1'] END AS cids FROM t),
l AS (SELECT id, 'C1' AS cid, day || ' ' || sku || ' 的' || phrase || '为' || told || '。' AS content FROM t UNION ALL SELECT id, 'C2', CASE WHEN c % 2 = 0 THEN 'SKU-1X 的库存数量为3；' || day || ' ' || sku || ' 的' || phrase || '为' || told ELSE phrase || '为' || told END FROM t),
seg AS (SELECT id, cid, unnest(list_filter(string_split(regexp_replace(content, '([。；])', chr(10), 'g'), chr(10)), lambda x: x <> '')) AS seg FROM l),
f AS (SELECT id, unnest(vals) AS val, generate_subscripts(vals, 1) AS idx, kind, sku, fday, cids, phrase, question FROM a WHERE NOT contains(question, '电压')),
sup AS (SELECT DISTINCT f.id, f.idx, s.cid FROM f JOIN seg s ON f.id = s.id AND list_contains(f.cids, s.cid) WHERE contains(s.seg, f.phrase) AND regexp_extract(s.seg, 'SKU-[0-9]+X') = f.sku AND regexp_extract(s.seg, '20[0-9]{2}-[0-9]{2}-[0-9]{2}') = f.fday
  AND TRY_CAST(regexp_extract(s.seg, '为(?:USD )?([0-9.]+)', 1) AS DECIMAL(24,6)) = TRY_CAST(f.val AS DECIMAL(24,6))),
sl AS (SELECT id, idx, list_sort(list(cid)) AS supporting FROM sup GROUP BY 1, 2),
fe AS (SELECT f.id, f.idx, f.cids, coalesce(supporting, []) AS supporting, list_filter([CASE WHEN regexp_extract(question, '20[0-9]{2}-[0-9]{2}-[0-9]{2}') <> fday THEN 'question_date_mismatch' END,
  CASE WHEN len(coalesce(supporting, [])) = 0 THEN 'evidence_mismatch_or_cross_fragment' WHEN len(supporting) < len(cids) THEN 'unsupported_citation:' || array_to_string(list_filter(cids, lambda x: NOT list_contains(supporting, x)), ',') END], lambda x: x IS NOT NULL) AS errs FROM f LEFT JOIN sl ON f.id = sl.id AND f.idx = sl.idx),
fa AS (SELECT id, flatten(list(list_transform(errs, lambda e: 'fact_' || idx || ':' || e) ORDER BY idx)) AS errs, bool_or(len(supporting) = len(cids)) AS any_full, any_value(cids) AS cids FROM fe GROUP BY 1),
c AS (SELECT a.*, list_distinct(list_transform(regexp_extract_all(upper(answer_text), '\\[(C[0-9]+)\\]', 1), lambda x: x)) AS named, fa.errs, coalesce(fa.any_full, false) AS any_full FROM a LEFT JOIN fa ON a.id = fa.id),
e AS (SELECT *, CASE WHEN len(vals) = 0 THEN [] ELSE cids END AS stated, list_transform(regexp_extract_all(regexp_replace(answer_text, '\\[[Cc][0-9]+\\]', '', 'g'), '[0-9]+(?:[.][0-9]+)?'), lambda x: x) AS nums,
  list_concat(vals, regexp_extract_all(CASE WHEN len(vals) = 0 THEN '' ELSE fday || ' ' || sku END, '[0-9]+')) AS allowed FROM c),
v AS (SELECT *, CASE WHEN contains(question, '电压') THEN ['unsupported_fact_type'] ELSE list_concat(list_filter([
  CASE WHEN list_contains(named, 'C9') THEN 'answer_unknown_citation:C9' END, CASE WHEN list_sort(named) <> list_sort(stated) THEN 'answer_fact_citation_mismatch' END, CASE WHEN len(vals) = 0 THEN 'missing_ecommerce_facts' END,
  CASE WHEN len(list_filter(nums, lambda n: NOT list_contains(allowed, n))) > 0 THEN 'answer_contains_uncited_numeric_value' END, CASE WHEN len(list_distinct(list_transform(vals, lambda x: TRY_CAST(x AS DECIMAL(24,6))))) > 1 THEN 'conflicting_ecommerce_facts' END], lambda x: x IS NOT NULL), coalesce(errs, [])) END AS errors FROM e),
s AS (SELECT *, NOT (pri = 5 AND c % 2 = 0) AS accepted, len(vals) > 0 AND TRY_CAST(vals[1] AS DECIMAL(24,6)) = TRY_CAST(num AS DECIMAL(24,6)) AS num_ok, len(vals) > 0 AND fday = day AS day_ok, len(vals) > 0 AND c % 13 <> 0 AS sku_ok FROM v)"""
_STRICT = "CASE WHEN pri = 5 THEN NOT accepted ELSE false END"
SQL = {
    "v04_verify_answers": f"WITH {_A} SELECT id AS answer_id, len(errors) = 0 AS passed, array_to_string(errors, '|') AS errors, CASE WHEN any_full AND NOT contains(question, '电压') THEN array_to_string(cids, ',') ELSE '' END AS verified FROM v",
    "v06_score_answers": f"""WITH {_A}, x AS (SELECT *, squash FROM (SELECT *, lower(regexp_replace(answer_text, '[ ,，]', '', 'g')) AS squash FROM s))
SELECT 'verified' AS profile, id AS case_id, accepted, NOT accepted AS refused, {_STRICT} AS strict_correct, num_ok AS numeric_correct, num_ok AS unit_correct, day_ok AS period_correct, false AS company_correct, len(vals) > 0 AS metric_correct, sku_ok AS scope_correct, CASE WHEN accepted THEN len(errors) = 0 END AS citation_valid,
  accepted AND contains(array_to_string(errors, '|'), 'unknown_citation') AS unknown_citation_accepted, accepted AND regexp_matches(array_to_string(errors, '|'), 'uncited_numeric|evidence_mismatch|unsupported_citation') AS unsupported_numeric_accepted, false AS schema_error FROM s
UNION ALL SELECT 'legacy', id, accepted, NOT accepted, {_STRICT}, regexp_matches(squash, '(?:^|[^0-9.])' || replace(num, '.', '[.]') || '(?:$|[^0-9.])'), false, false, false, contains(squash, phrase), false, NULL, false, false, false FROM x""",
    "a14_answer_scores": f"""WITH {_A}, k AS (SELECT pri = 5 AS refuse, accepted AS answered, {_STRICT} AS correct, accepted AND len(errors) = 0 AS cit FROM s), r AS (SELECT count(*) AS n, count(*) FILTER (NOT refuse) AS asked, count(*) FILTER (answered) AS answered, count(*) FILTER (answered AND NOT refuse) AS both_, count(*) FILTER (answered AND correct AND NOT refuse) AS right_, count(*) FILTER (answered AND cit) AS cit, count(*) FILTER (NOT answered AND refuse) AS refused, count(*) FILTER (NOT answered) AS silent, count(*) FILTER (refuse) AS should_ FROM k)
SELECT 'verified' AS profile, n, CAST(round(CAST(both_::DOUBLE / asked AS DECIMAL(38,10)), 6) AS DOUBLE) AS coverage, CAST(round(CAST(right_::DOUBLE / answered AS DECIMAL(38,10)), 6) AS DOUBLE) AS strict_precision, CAST(round(CAST(cit::DOUBLE / answered AS DECIMAL(38,10)), 6) AS DOUBLE) AS citation_validity, CAST(round(CAST(refused::DOUBLE / silent AS DECIMAL(38,10)), 6) AS DOUBLE) AS refusal_precision, CAST(round(CAST(refused::DOUBLE / should_ AS DECIMAL(38,10)), 6) AS DOUBLE) AS refusal_recall, 0.0::DOUBLE AS provider_error_rate FROM r""",
}
