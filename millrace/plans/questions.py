"""Queries on what questions ask for and the ranks that follow from it, with their SQL.

Questions are written from order and part columns, candidates from order lines; the SQL finds its answers in the same texts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import evidence, intent, parents, ranking, retrieval
from millrace.sources.facts import table

from .retrieval import _r

MARKET, PLATFORM = ("美国", "UK", "新加坡", "欧盟"), ("京东", "Amazon", "Lazada")
PHRASES = ("价格", "库存数量", "配送时长", "关税税率", "price and delivery", "库存周转", "毛利", "stock quantity", "电压", "加权价格")
FIRMS = ("格力电器", "招商银行", "甲乙科技股份有限公司", "比亚迪集团", "美的集团")
SCOPE, STATEMENT = ("合并", "母公司口径", ""), ("利润表", "资产负债表", "")
METRIC = ("营业收入", "归属于母公司股东的净利润", "净利润", "资产总计", "毛利率", "经营活动产生的现金流量净额")
LABELS, HEADS = ("价格", "库存", "配送时长"), ("合并利润表", "资产负债表", "非经常性损益", "分行业")


def _one(words, by):
    return F.get(F.array(*map(F.lit, words)), (by % len(words)).cast("int"))


def _shop(s, d):
    o = table(s, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    day = F.date_format(F.add_months(F.col("o_orderdate"), 120), "yyyy-MM-dd")
    q = F.concat(F.lit("请问 "), _one(MARKET, k), F.lit(" "), _one(PLATFORM, c), F.lit(" SKU-"), c.cast("string"), F.lit("X 在 "), day, F.lit(" 的 "), F.col("o_orderpriority"), F.lit(" "), _one(PHRASES, k), F.lit("是多少？"))
    return o.select(k.alias("id"), q.alias("question"))


def _financial(s, d):
    o = table(s, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    q = F.concat(_one(FIRMS, c), (F.year("o_orderdate") + 10).cast("string"), F.lit("年"), _one(SCOPE, k), _one(STATEMENT, k), F.lit("的"), _one(METRIC, k + c), F.lit("是多少？"))
    return o.select(k.alias("id"), q.alias("question"))


def _joined(*names):
    return [F.array_join(f"x.{n}", ",").alias(n) for n in names]


def intent_extract(s, d):
    rows = _shop(s, d).select("id", intent.shop_intent(F.col("question")).alias("x"))
    return rows.select("id", *_joined("skus", "dates", "platforms", "markets", "product_terms", "table_types", "fact_types"), "x.answer_type", "x.table_fact")


def financial_intent(s, d):
    rows = _financial(s, d).select("id", intent.financial_intent(F.col("question")).alias("x"))
    return rows.select("id", *_joined("company_terms", "years", "metric_families", "statement_types", "scopes"), "x.answer_type", "x.table_fact")


def question_preflight(s, d):
    return _shop(s, d).select("id", intent.question_preflight(F.col("question"), intent.shop_intent(F.col("question"))).alias("reason"))


def _id():
    return F.concat_ws(":", "l_orderkey", "l_linenumber", "l_suppkey", F.col("l_quantity").cast("int"), F.date_format("l_shipdate", "yyyyMMdd"))


def _fused(s, d):
    """Order lines as candidates of a question on their part: tables and texts, by price and by quantity."""
    li = table(s, d, "lineitem").select(F.col("l_partkey").alias("query_id"), _id().alias("chunk_id"), "l_linestatus", "l_extendedprice", "l_quantity")
    of = lambda t, by: retrieval.top_by(li.where(F.col("l_linestatus") == t), ["query_id"], [F.desc(by), F.col("chunk_id")], 20)
    channels = {"table_lexical": of("F", "l_extendedprice"), "table_dense": of("F", "l_quantity"), "text_lexical": of("O", "l_extendedprice"), "text_dense": of("O", "l_quantity")}
    return retrieval.weighted_rrf(channels, ranking.CHANNEL_WEIGHTS).select("query_id", F.col("chunk_id").alias("candidate_id"), F.round("rrf", 9).alias("rrf"), "best_rank")


def _candidates(s, d, content, source, question, parse):
    li = table(s, d, "lineitem")
    is_table = F.col("l_linestatus") == "F"
    rows = li.select(
        F.col("l_partkey").alias("query_id"), _id().alias("candidate_id"), content.alias("content"), source.alias("source"), F.when(is_table, "table").otherwise("text").alias("content_type"), F.col("l_linenumber").cast("int").alias("page_number"),
        F.when(is_table, F.concat(F.lit("t"), F.col("l_suppkey").cast("string"))).alias("table_id"), F.col("l_linenumber").cast("int").alias("chunk_index"), F.lit(None).cast("string").alias("provenance_id"), F.lit("").alias("semantic_text"),
    )
    p = table(s, d, "part").select(F.col("p_partkey").alias("query_id"), question.alias("question")).withColumn("intent", parse(F.col("question")))
    return _fused(s, d).join(rows, ["query_id", "candidate_id"]).join(p, "query_id")


def _day():
    return F.date_format(F.add_months(F.col("l_shipdate"), 120), "yyyy-MM-dd")


def _lines_shop(s, d):
    k, n = F.col("p_partkey"), F.col("l_linenumber")
    question = F.concat(_one(PLATFORM, k), F.lit(" SKU-"), k.cast("string"), F.lit("X 2006 "), _one(LABELS, k), F.lit("是多少"))
    content = F.concat(F.lit("SKU-"), F.col("l_partkey").cast("string"), F.lit("X "), _one(LABELS, n), F.lit(" "), F.col("l_quantity").cast("int").cast("string"), F.lit(" "), _day())
    return _candidates(s, d, content, F.concat(_one(PLATFORM, F.col("l_suppkey")), F.lit(".pdf")), question, intent.shop_intent)


def _lines_financial(s, d):
    k, n = F.col("p_partkey"), F.col("l_linenumber")
    question = F.concat(_one(FIRMS, k), F.lit("2006年"), _one(SCOPE, k), F.lit("的"), _one(METRIC, k), F.lit("是多少"))
    content = F.concat(_one(HEADS, n), F.lit("\n"), _one(METRIC, F.col("l_suppkey")), F.lit(" "), F.year(F.add_months("l_shipdate", 120)).cast("string"), F.when(F.col("l_quantity") > 20, F.concat(F.lit(" "), F.col("l_quantity").cast("int").cast("string"), F.lit(".5"))).otherwise(""))
    return _candidates(s, d, content, F.concat(_one(FIRMS, F.col("l_suppkey")), F.lit("年报.pdf")), question, intent.financial_intent)


def _out(rows):
    return rows.select("query_id", "candidate_id", "score", F.col("rank").cast("long").alias("rank"))


def rank_v2(s, d):
    return _out(ranking.rank_v2(_lines_shop(s, d)))


def rank_financial_v2(s, d):
    return _out(ranking.rank_financial_v2(_lines_financial(s, d)))


def rank_financial_v3(s, d):
    return _out(ranking.rank_financial_v3(_lines_financial(s, d)))


def _parent_parts(s, d):
    """Order lines as chunks found for their part, on pages of their supplier's report."""
    li, n = table(s, d, "lineitem"), F.col("l_linenumber")
    source = F.concat(_one(FIRMS, F.col("l_suppkey")), F.col("l_suppkey").cast("string"), F.lit("年报.pdf"))
    rows = li.select(F.col("l_partkey").alias("query_id"), _id().alias("chunk_id"), source.alias("source"), n.cast("long").alias("page_number"), "l_extendedprice", "l_quantity", (F.col("l_suppkey") + n).alias("by"))
    of = lambda name, by: retrieval.top_by(rows, ["query_id"], [F.desc(by), F.col("chunk_id")], 100).select("query_id", "source", "page_number", F.lit(name).alias("channel"), "rank")
    found = of("dense", "l_quantity").unionByName(of("lexical", "l_extendedprice"))
    content = F.concat(_one(HEADS, F.col("page_number")), F.lit("\n"), _one(METRIC, F.col("by")), F.when(F.col("by") % 2 == 0, " 2006 合并 ").otherwise(" 2005 母公司 "), F.col("by").cast("string"))
    pages = rows.select("source", "page_number", content.alias("content")).distinct()
    k = F.col("p_partkey")
    question = F.concat(_one(FIRMS, k), F.lit("2006年"), _one(SCOPE, k), F.lit("的"), _one(METRIC, k), F.lit("是多少"))
    return found, pages, table(s, d, "part").select(k.alias("query_id"), question.alias("question"))


def rank_parent_page(s, d):
    return parents.rank_parent_pages(*_parent_parts(s, d)).withColumn("rank", F.col("rank").cast("long"))


VALUES, ANCHORS = ("$12.5", "3 天", "13%", "40"), ("京东 价格表", "plain words", "配送 3 days", "2008年5月 USD", "table of 12", "香港", "")
FACT_WORDS = ("价格", "配送时长", "关税税率", "库存")


def _evidence(s, d):
    """Segments of order lines on the part that a question asks for."""
    li, n = table(s, d, "lineitem"), F.col("l_linenumber")
    text = F.concat(F.lit("SKU-"), F.col("l_partkey").cast("string"), F.when(n % 3 == 0, "Y ").otherwise("X "), _one(FACT_WORDS, F.col("l_suppkey")), F.lit(" "), _one(VALUES, n), F.lit(" "), _one(("usa", "UK", "美国"), F.col("l_suppkey") + n), F.lit(" "), _day())
    return li.select(F.col("l_partkey").alias("question_id"), F.concat(_one(PLATFORM, F.col("l_suppkey")), F.lit(".pdf")).alias("source"), text.alias("segment"))


def evidence_preflight(s, d):
    k = F.col("p_partkey")
    question = F.concat(_one(("美国", "英国"), k), F.lit(" "), _one(PLATFORM, k), F.lit(" SKU-"), k.cast("string"), F.lit("X "), _one((*FACT_WORDS, "电压"), k), F.lit("是多少"))
    return evidence.evidence_preflight(table(s, d, "part").select(k.alias("question_id"), question.alias("question")), _evidence(s, d))


def identity_match(s, d):
    """Facts of each part against the segments of its order lines, with how many match."""
    k = F.col("question_id")
    sku = F.concat(F.lit("SKU-"), k.cast("string"), F.lit("X"))
    facts = _evidence(s, d).select("*", F.when(k % 5 != 0, sku).alias("sku"), F.lit(None).cast("string").alias("product"), _one(PLATFORM, k).alias("platform"), _one(("US", "united kingdom"), k).alias("market"), F.lit("").alias("date"))
    return evidence.identity_match(facts).groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("matched"), 1)).alias("n_matched"))


def _headers():
    return F.array(F.lit("SKU"), F.concat(F.lit("商品 "), F.col("p_name")), F.concat(_one(FACT_WORDS, F.col("p_size")), F.lit(" ("), _one(("USD", "天", "2008-05", ""), F.col("p_partkey")), F.lit(")")), F.col("p_brand"))


def _bindings(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), evidence.column_bindings(_headers()).alias("bindings"))


def column_bindings(s, d):
    b = _bindings(s, d).select("id", F.explode("bindings").alias("b"))
    return b.select("id", F.col("b.column_index").cast("long").alias("column_index"), "b.header_text", "b.fact_type", "b.identity", "b.context.table_type", "b.context.effective_date", "b.context.currency", "b.context.duration_unit")


def evidence_prefix(s, d):
    rows = _bindings(s, d)
    text = evidence.evidence_prefix(F.lit("a.pdf"), F.col("id"), F.concat(F.lit("t"), F.col("id").cast("string")), {"platform": _one((*PLATFORM, ""), F.col("id"))}, F.col("bindings"))
    return rows.select("id", text.alias("prefix"))


def table_anchor(s, d):
    li = table(s, d, "lineitem")
    blocks = li.select(F.col("l_orderkey").alias("doc"), F.lit(1).alias("page"), F.col("l_linenumber").cast("long").alias("top"), F.concat_ws(":", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd"), F.col("l_quantity").cast("int")).alias("place"), F.when(F.col("l_returnflag") == "R", "Table").otherwise("text").alias("label"), _one(ANCHORS, F.col("l_suppkey")).alias("content"))
    return evidence.table_anchor(blocks).select("doc", "top", "place", "anchor")


QUERIES = {
    "v02_evidence_preflight": evidence_preflight, "v03_identity_match": identity_match, "x19_column_bindings": column_bindings, "x20_evidence_prefix": evidence_prefix, "w11_table_anchor": table_anchor,
    "x10_intent_extract": intent_extract, "x11_financial_intent": financial_intent, "v01_question_preflight": question_preflight, "x06_rank_v2": rank_v2, "x07_rank_financial_v2": rank_financial_v2, "x08_rank_financial_v3": rank_financial_v3, "x09_rank_parent_page": rank_parent_page,
}


def _pick(words, by):
    return f"{list(words)}[({by}) % {len(words)} + 1]"


def _any(text, words):
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _list(named: dict[str, str]):
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in named.items()) + "], lambda x: x IS NOT NULL), ',')"


def _market(alias):
    return f"regexp_matches(text, '(?i)(?:^|[^A-Za-z]){alias}(?:$|[^A-Za-z])')" if alias.isascii() else f"contains(text, '{alias}')"


def _kinds(names, low="lower(text)"):
    """Kinds by their longest alias, then its place: no two kinds of these dictionaries share characters once longer names are cut out."""
    values = ", ".join(f"('{k}', '{a.lower()}')" for k, v in names.items() for a in v)
    return f"""m AS (SELECT id, kind, len(alias) AS n, strpos({low}, alias) AS pos FROM q, (VALUES {values}) t(kind, alias) WHERE contains({low}, alias)),
mm AS (SELECT id, kind, n, pos FROM m QUALIFY row_number() OVER (PARTITION BY id, kind ORDER BY n DESC, pos) = 1), k AS (SELECT id, list(kind ORDER BY n DESC, pos, kind) AS kinds FROM mm GROUP BY 1)"""


def _without(text, words, flags=""):
    for w in words:
        text = f"regexp_replace({text}, '{w}', ' ', 'g{flags}')"
    return text


_SHOPQ = f"""q AS (SELECT o_orderkey AS id, '请问 ' || {_pick(MARKET, 'o_orderkey')} || ' ' || {_pick(PLATFORM, 'o_custkey')} || ' SKU-' || o_custkey || 'X 在 ' || strftime(o_orderdate + INTERVAL 10 YEAR, '%Y-%m-%d') || ' 的 ' || o_orderpriority || ' ' || {_pick(PHRASES, 'o_orderkey')} || '是多少？' AS text FROM orders)"""
_FACTS = _SHOPQ + ", " + _kinds(intent.FACTS).replace("WHERE contains", f"WHERE NOT (alias IN ('库存', 'inventory') AND {_any('lower(text)', intent.NOT_INVENTORY)}) AND contains")
_LEFT = _without("text", ["SKU-[0-9]+X"])
_CASES = "CASE kinds[1] " + " ".join(f"WHEN '{k}' THEN {_without(_LEFT, sorted(v, key=len, reverse=True))}" for k, v in intent.FACTS.items()) + f" ELSE {_LEFT} END"
_TERMS = _without(_without(_without(_CASES, ["20[0-9][0-9]-[0-9]{2}-[0-9]{2}"]), [*intent.PLATFORMS, *[a for v in intent.MARKETS.values() for a in v]], "i"), [intent.PUNCTUATION])
_CLEAN = f"list_transform(string_split_regex({_TERMS}, '\\s+'), lambda x: regexp_replace(trim(regexp_replace(x, '{intent.NOISE}', '', 'g')), '(?:的|商品|产品|这款|该款)$', ''))"

_FINQ = f"""q AS (SELECT o_orderkey AS id, {_pick(FIRMS, 'o_custkey')} || (year(o_orderdate) + 10) || '年' || {_pick(SCOPE, 'o_orderkey')} || {_pick(STATEMENT, 'o_orderkey')} || '的' || {_pick(METRIC, 'o_orderkey + o_custkey')} || '是多少？' AS text FROM orders)"""
# the one metric inside another: a profit that is the parent's is no plain profit
_FINM = _kinds(intent.METRICS, "text").replace("WHERE contains", "WHERE NOT (kind = '净利润' AND contains(text, '股东的净利润')) AND contains")
_NOCO = _without("text", [*intent.COMPANIES, "归属于母公司股东的净利润"])

_RRF = """li AS (SELECT l_partkey AS query_id, l_orderkey || ':' || l_linenumber || ':' || l_suppkey || ':' || l_quantity::INT || ':' || strftime(l_shipdate, '%Y%m%d') AS id, l_partkey, l_suppkey, l_linenumber, l_linestatus, l_quantity, l_shipdate, l_extendedprice FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, l_linestatus ORDER BY l_extendedprice DESC, id) AS a, row_number() OVER (PARTITION BY query_id, l_linestatus ORDER BY l_quantity DESC, id) AS b FROM li),
f AS (SELECT *, round((CASE WHEN a <= 20 THEN (CASE l_linestatus WHEN 'F' THEN 1.25::DOUBLE ELSE 0.75::DOUBLE END) / (60 + a) ELSE 0 END) + (CASE WHEN b <= 20 THEN (CASE l_linestatus WHEN 'F' THEN 1.0::DOUBLE ELSE 0.75::DOUBLE END) / (60 + b) ELSE 0 END), 9) AS rrf, least(a, b) AS best FROM r WHERE (a <= 20 OR b <= 20) AND l_linestatus IN ('F', 'O'))"""


def _rank_sql(fields, parts, own):
    score = " + ".join(f"{w}::DOUBLE * ({x})::INT" if not x.startswith("~") else f"{w}::DOUBLE * {x[1:]}" for w, x in parts)
    r8 = _r("rrf", 8)
    return f"""WITH {_RRF}, g AS (SELECT f.*, coalesce(rrf / max(rrf) OVER (PARTITION BY query_id), 0) AS norm, l_linestatus = 'F' AS is_table, CASE WHEN l_linestatus = 'F' THEN 't' || l_suppkey END AS table_id, {fields} FROM f JOIN part ON query_id = p_partkey),
h AS (SELECT query_id, id AS candidate_id, {_r(f'{own}::DOUBLE * norm + {score}', 8)} AS score, {r8} AS r8, best, source, l_linenumber, coalesce(table_id, '') AS tid, CASE WHEN is_table THEN table_id ELSE source || '|' || l_linenumber END AS place FROM g),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, place ORDER BY score DESC, r8 DESC, best, source, l_linenumber, tid, candidate_id) AS n FROM h)
SELECT query_id, candidate_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r8 DESC, best, source, l_linenumber, tid, candidate_id) AS rank FROM o WHERE n = 1 QUALIFY rank <= 5"""


_SHIP = "strftime(l_shipdate + INTERVAL 10 YEAR, '%Y-%m-%d')"
_SHOPF = f"{_pick(PLATFORM, 'l_suppkey')} || '.pdf' AS source, {_pick(PLATFORM, 'p_partkey')} AS asked, {_pick(LABELS, 'p_partkey')} AS label, 'SKU-' || l_partkey || 'X ' || {_pick(LABELS, 'l_linenumber')} || ' ' || l_quantity::INT || ' ' || {_SHIP} AS content"
_FINF = f"{_pick(FIRMS, 'l_suppkey')} || '年报.pdf' AS source, regexp_replace({_pick(FIRMS, 'p_partkey')}, '股份有限公司$|(?:亚迪)集团$', CASE WHEN {_pick(FIRMS, 'p_partkey')} = '比亚迪集团' THEN '亚迪' ELSE '' END) AS firm, {_pick(METRIC, 'p_partkey')} AS metric, {_pick(SCOPE, 'p_partkey')} AS scope, {_pick(FIRMS, 'p_partkey')} = '比亚迪集团' AS grouped, {_pick(HEADS, 'l_linenumber')} AS head, {_pick(METRIC, 'l_suppkey')} || ' ' || (year(l_shipdate) + 10) || CASE WHEN l_quantity > 20 THEN ' ' || l_quantity::INT || '.5' ELSE '' END AS line"
_ROW = "l_quantity > 20 AND (contains(line, metric) OR (metric = '资产总计' AND contains(line, '资产合计')))"
_SCOPED = "(starts_with(scope, '合并') AND contains(head, '合并')) OR (starts_with(scope, '母公司') AND contains(line, '母公司')) OR (grouped AND contains(line, '集团'))"

_EV = f"""e AS (SELECT l_partkey AS id, {_pick(PLATFORM, 'l_suppkey')} || '.pdf' AS source, 'SKU-' || l_partkey || CASE WHEN l_linenumber % 3 = 0 THEN 'Y ' ELSE 'X ' END || {_pick(FACT_WORDS, 'l_suppkey')} || ' ' || {_pick(VALUES, 'l_linenumber')} || ' ' || {_pick(('usa', 'UK', '美国'), 'l_suppkey + l_linenumber')} || ' ' || {_SHIP} AS text FROM lineitem)"""
_US, _UK = "regexp_matches(lower(text), 'usa|美国')", "regexp_matches(lower(text), '(?:^|[^a-z])uk(?:$|[^a-z])')"
_HEADS = f"""h AS (SELECT p_partkey AS id, unnest([0, 1, 2, 3]) AS column_index, unnest(['SKU', '商品 ' || p_name, {_pick(FACT_WORDS, 'p_size')} || ' (' || {_pick(('USD', '天', '2008-05', ''), 'p_partkey')} || ')', p_brand]) AS header_text FROM part),
b AS (SELECT *, CASE WHEN contains(header_text, '价格') THEN 'price' WHEN contains(header_text, '库存') THEN 'inventory_quantity' WHEN contains(header_text, '配送') THEN 'delivery_duration' WHEN contains(header_text, '关税') THEN 'customs_duty_rate' ELSE '' END AS fact_type, CASE WHEN header_text = 'SKU' THEN 'sku' WHEN contains(header_text, '商品') THEN 'product' ELSE '' END AS identity,
regexp_extract(header_text, '2008-05') AS effective_date, regexp_extract(header_text, 'USD') AS currency, CASE regexp_extract(header_text, '天|时') WHEN '天' THEN 'day' WHEN '时' THEN 'hour' ELSE '' END AS duration_unit FROM h)"""

SQL = {
    "v02_evidence_preflight": f"""WITH {_EV}, q AS (SELECT p_partkey AS question_id, {_pick(('美国', '英国'), 'p_partkey')} AS market, {_pick(PLATFORM, 'p_partkey')} AS platform, {_pick((*FACT_WORDS, '电压'), 'p_partkey')} AS word FROM part),
ok AS (SELECT DISTINCT question_id FROM q JOIN e ON id = question_id WHERE contains(text, word) AND contains(text, 'SKU-' || id || 'X ') AND contains(lower(text || ' ' || source), lower(platform)) AND CASE market WHEN '美国' THEN {_US} ELSE {_UK} END AND CASE word WHEN '价格' THEN contains(text, '$') WHEN '配送时长' THEN contains(text, '天') WHEN '关税税率' THEN contains(text, '%') ELSE contains(text, ' 40 ') END)
SELECT question_id, CASE WHEN word = '电压' THEN 'unsupported_fact_type' WHEN ok.question_id IS NULL THEN 'no_fact_binding' END AS reason FROM q LEFT JOIN ok USING (question_id)""",
    "v03_identity_match": f"WITH {_EV} SELECT id AS question_id, count(*) AS n, count(*) FILTER ((id % 5 = 0 OR contains(text, 'SKU-' || id || 'X ')) AND contains(lower(source), lower({_pick(PLATFORM, 'id')})) AND CASE WHEN id % 2 = 0 THEN {_US} ELSE {_UK} END) AS n_matched FROM e GROUP BY 1",
    "x19_column_bindings": f"WITH {_HEADS} SELECT id, column_index::BIGINT AS column_index, header_text, fact_type, identity, fact_type AS table_type, effective_date, currency, duration_unit FROM b WHERE concat(fact_type, identity, effective_date, currency, duration_unit) <> ''",
    "x20_evidence_prefix": f"""WITH {_HEADS} SELECT id, '[TableEvidence | source=a.pdf | page=' || id || ' | table=t' || id || ']' || CASE WHEN {_pick((*PLATFORM, ''), 'id')} <> '' THEN chr(10) || 'Platform: ' || {_pick((*PLATFORM, ''), 'id')} ELSE '' END || chr(10) || 'Columns: ' || string_agg('c' || column_index || '=' || CASE WHEN concat(identity, fact_type, currency, duration_unit) = '' THEN header_text ELSE array_to_string(list_filter([identity, fact_type, currency, duration_unit], lambda x: x <> ''), '/') END, '; ' ORDER BY column_index) AS prefix FROM b WHERE concat(fact_type, identity, effective_date, currency, duration_unit) <> '' GROUP BY id""",
    "w11_table_anchor": f"""WITH t AS (SELECT l_orderkey AS doc, l_linenumber::BIGINT AS top, l_partkey || ':' || l_suppkey || ':' || strftime(l_shipdate, '%Y%m%d') || ':' || l_quantity::INT AS place, l_returnflag = 'R' AS tab, {_pick(ANCHORS, 'l_suppkey')} AS content FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY top, place) AS i FROM t)
SELECT doc, top, place, (SELECT arg_max(content, i) FROM n b WHERE b.doc = a.doc AND b.i < a.i AND NOT b.tab AND regexp_matches(content, '价格|配送|USD|香港') AND b.i > coalesce((SELECT max(i) FROM n c WHERE c.doc = a.doc AND c.i < a.i AND c.tab), 0)) AS anchor FROM n a WHERE tab""",
    "x10_intent_extract": f"""WITH {_FACTS} SELECT q.id, upper(regexp_extract(text, 'SKU-[A-Z0-9]+')) AS skus, regexp_extract(text, '20[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}') AS dates, {_list({p: f"contains(lower(text), '{p.lower()}')" for p in intent.PLATFORMS})} AS platforms,
{_list({m: '(' + ' OR '.join(map(_market, v)) + ')' for m, v in intent.MARKETS.items()})} AS markets, array_to_string(list_filter({_CLEAN}, lambda x: len(x) BETWEEN 2 AND 64)[1:3], ',') AS product_terms, {_list({k: _any('lower(text)', [a.lower() for a in v]) for k, v in intent.TABLES.items()})} AS table_types,
coalesce(array_to_string(kinds, ','), '') AS fact_types, CASE WHEN len(kinds) = 1 THEN kinds[1] ELSE 'unsupported' END AS answer_type, true AS table_fact FROM q LEFT JOIN k ON q.id = k.id""",
    "x11_financial_intent": f"""WITH {_FINQ}, {_FINM} SELECT q.id, {_list({c: f"contains(text, '{c}')" for c in intent.COMPANIES})} || CASE WHEN contains(text, '甲乙科技') THEN '甲乙科技' ELSE '' END AS company_terms, regexp_extract(text, '20[0-9][0-9]') AS years, coalesce(array_to_string(kinds, ','), '') AS metric_families,
{_list({n: _any('text', v) for n, v in intent.STATEMENTS.items()})} AS statement_types, array_to_string(list_filter([CASE WHEN contains({_NOCO}, '合并') THEN '合并' END, CASE WHEN contains({_NOCO}, '母公司口径') THEN '母公司' END, CASE WHEN contains(text, '比亚迪集团') THEN '集团' END], lambda x: x IS NOT NULL), ',') AS scopes,
CASE WHEN contains(text, '毛利率') THEN 'ratio' ELSE 'amount' END AS answer_type, true AS table_fact FROM q LEFT JOIN k ON q.id = k.id""",
    "v01_question_preflight": f"WITH {_FACTS} SELECT q.id, CASE WHEN {_any('lower(text)', intent.UNSUPPORTED_SPECS)} THEN 'unsupported_fact_type' WHEN {_any('text', intent.FORMULAS)} THEN 'unsupported_complex_formula' WHEN kinds IS NULL THEN 'unsupported_fact_type' WHEN len(kinds) > 1 THEN 'unsupported_multi_fact' END AS reason FROM q LEFT JOIN k ON q.id = k.id",
    "x06_rank_v2": _rank_sql(_SHOPF, [(0.20, "contains(content, label)"), (0.10, "contains(content, 'SKU-' || l_partkey || 'X')"), (0.05, "false"), (0.05, "contains(lower(source), lower(asked))"), (0.05, "contains(content, '2006')"), (0.05, "is_table")], 0.50),
    "x07_rank_financial_v2": _rank_sql(_FINF, [(0.20, _ROW), (0.10, _SCOPED), (0.05, "contains(line, '2006')"), (0.05, "contains(source, firm)"), (0.05, "is_table")], 0.55),
}


def _terms(text):
    """Distinct terms of a text in SQL, and their length together."""
    run = "regexp_extract_all({t}, '[一-鿿]+')"
    grams = " || ".join(f"flatten(list_transform({run}, lambda r: list_transform(range(1, len(r) - {n - 2}), lambda i: r[i:i + {n - 1}])))" for n in (2, 3, 4))
    return f"list_distinct(list_filter(regexp_extract_all({{t}}, '[a-z0-9_.%-]+'), lambda x: len(x) >= 2) || list_filter({run}, lambda r: len(r) BETWEEN 2 AND 8) || {grams})".format(t=f"lower({text})")


_FAMILY = {"归母净利润": "归属于母公司股东的净利润", "净利润": "净利润", "营业收入": "营业收入", "资产合计": "资产总计", "毛利率": "毛利率", "经营现金流": "经营活动产生的现金流量净额"}
_STATED = {f: s for families, s in ranking.EXPECTED for f in families}
_HAS = lambda text, words: "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"
_FIRM = {"格力电器": "格力电器", "招商银行": "招商银行", "甲乙科技": "甲乙科技股份有限公司", "比亚迪": "比亚迪集团", "美的集团": "美的集团"}
SQL["x09_rank_parent_page"] = f"""
WITH li AS (SELECT l_partkey AS query_id, concat_ws(':', l_orderkey, l_linenumber, l_suppkey, l_quantity::INT, strftime(l_shipdate, '%Y%m%d')) AS chunk_id, {_pick(FIRMS, 'l_suppkey')} || l_suppkey || '年报.pdf' AS source, l_linenumber::BIGINT AS page_number, l_extendedprice, l_quantity, l_suppkey + l_linenumber AS by_ FROM lineitem),
f AS (SELECT query_id, source, page_number, 'dense' AS channel, row_number() OVER (PARTITION BY query_id ORDER BY l_quantity DESC, chunk_id) AS rank FROM li UNION ALL SELECT query_id, source, page_number, 'lexical', row_number() OVER (PARTITION BY query_id ORDER BY l_extendedprice DESC, chunk_id) FROM li),
e AS (SELECT query_id, source, page_number, 1.0::DOUBLE / (60 + min(rank)) AS best_child_rr, list_sum(list_transform(list_sort(list(rank))[1:3], lambda r: 1.0::DOUBLE / (60 + r))) AS top3_child_rr, count(*)::DOUBLE AS child_evidence_count, coalesce(1.0::DOUBLE / (60 + min(rank) FILTER (channel = 'dense')), 0) AS best_dense_rr, coalesce(1.0::DOUBLE / (60 + min(rank) FILTER (channel = 'lexical')), 0) AS best_lexical_rr FROM f WHERE rank <= 100 GROUP BY 1, 2, 3),
pg AS (SELECT DISTINCT source, page_number, {_pick(HEADS, 'page_number')} || chr(10) || {_pick(METRIC, 'by_')} || CASE WHEN by_ % 2 = 0 THEN ' 2006 合并 ' ELSE ' 2005 母公司 ' END || by_ AS content FROM li),
q0 AS (SELECT p_partkey AS query_id, {_pick(FIRMS, 'p_partkey')} || '2006年' || {_pick(SCOPE, 'p_partkey')} || '的' || {_pick(METRIC, 'p_partkey')} || '是多少' AS question FROM part),
q AS (SELECT *, {_terms('question')} AS qt, CASE {" ".join(f"WHEN contains(question, '{w}') THEN '{f}'" for f, w in _FAMILY.items())} END AS family, CASE {" ".join(f"WHEN contains(question, '{w}') THEN '{f}'" for f, w in _FIRM.items())} END AS firm FROM q0),
pt AS (SELECT *, {_terms('content')} AS ct FROM pg),
x AS (SELECT e.*, CAST(round(CAST(coalesce(list_sum(list_transform(list_intersect(qt, ct), lambda t: len(t))), 0)::DOUBLE / list_sum(list_transform(qt, lambda t: len(t))) AS DECIMAL(38,10)), 4) AS DOUBLE) AS parent_lexical_score,
  (CASE family {" ".join(f"WHEN '{k}' THEN {_HAS('content', v)}" for k, v in intent.METRICS.items())} END)::INT::DOUBLE AS metric_alias_score, (CASE family {" ".join(f"WHEN '{k}' THEN {_HAS('content', v)}" for k, v in _STATED.items())} END)::INT::DOUBLE AS statement_score, (CASE family {" ".join(f"WHEN '{k}' THEN contains(content, '{v[0]}')" for k, v in _STATED.items())} END)::INT::DOUBLE AS exact_statement_score,
  (NOT contains(question, '合并') AND NOT contains(question, '母公司口径') AND NOT contains(question, '比亚迪集团') OR contains(question, '合并') AND contains(content, '合并') OR contains(question, '母公司口径') AND contains(content, '母公司') OR contains(question, '比亚迪集团') AND contains(content, '集团'))::INT::DOUBLE AS scope_score, contains(content, '2006')::INT::DOUBLE AS year_score, {_HAS('content', ranking.NOISE)}::INT::DOUBLE AS noise_score, contains(e.source, firm)::INT::DOUBLE AS company_source_score
  FROM e JOIN pt USING (source, page_number) JOIN q USING (query_id)),
s AS (SELECT *, {_r(" + ".join(f"{w}::DOUBLE * {f}" for f, w in parents.WEIGHTS.items()), 8)} AS parent_score FROM x)
SELECT query_id, source, page_number, {", ".join(f"{_r(f, 8)} AS {f}" for f in parents.WEIGHTS)}, parent_score, row_number() OVER (PARTITION BY query_id ORDER BY parent_score DESC, source, page_number) AS rank FROM s QUALIFY rank <= 5"""
