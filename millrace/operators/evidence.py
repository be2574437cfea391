"""Whether the evidence at hand can answer a question, and the context that tables take from their page and header."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.text import let

from . import intent as asked
from .verify import half_width, typed_value

# Names of one market, tokens that may be values, kinds of tables, and the labels of evidence.
MARKET_GROUPS = (("香港", "中国香港", "hk", "hong kong"), ("美国", "us", "usa", "united states"), ("英国", "uk", "united kingdom"), ("欧盟", "eu", "european union"), ("新加坡", "sg", "singapore"), ("中国", "中国大陆", "cn", "china"))
VALUE_TOKEN = r"(?i)(?<![A-Za-z0-9_.])(?:HK\$|CNY|RMB|USD|HKD|人民币|美元|港币|元|[￥¥$])?\s*[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?\s*(?:HK\$|CNY|RMB|USD|HKD|人民币|美元|港币|元|business\s+days?|hours?|days?|个?工作日|小时|天|日|时|%|％|[kK]|千|万|百万|亿)?(?![A-Za-z0-9_.])"
TABLE_KINDS = {"price": ("价格", "售价", "价目", "price"), "inventory_quantity": ("库存", "现货", "inventory", "stock"), "delivery_duration": ("配送", "交付", "物流时效", "delivery"), "customs_duty_rate": ("关税", "进口税率", "customs", "duty")}
MARKETS = ("中国", "中国大陆", "美国", "英国", "欧盟", "中国香港", "香港", "日本", "新加坡")
CURRENCY = r"(?i)(CNY|RMB|USD|HKD|人民币|美元|港币|[￥¥$])"
DURATION = r"(?i)(business\s+days?|hours?|days?|工作日|小时|天|日|时)"
LABELS = (("Table", "table_title"), ("Platform", "platform"), ("Market", "market"), ("Date", "effective_date"), ("Currency", "currency"), ("Unit", "duration_unit"))
CONTEXT = ("table_type", "platform", "market", "effective_date", "currency", "duration_unit")


def market_present(market: Column, where: Column) -> Column:
    """One of the market's names stands in lower-case text; Latin names between other characters than letters."""
    low = F.lower(half_width(market))

    def named(m: Column) -> Column:
        group = F.array(m)
        for names in MARKET_GROUPS:
            group = F.when(m.isin(*names), F.array(*map(F.lit, names))).otherwise(group)
        word = lambda a: F.call_function("rlike", where, F.concat(F.lit(r"(?<![A-Za-z])\Q"), a, F.lit(r"\E(?![A-Za-z])")))
        return F.exists(group, lambda a: F.when(a.rlike("[A-Za-z]"), word(a)).otherwise(where.contains(a)))

    return let(low, named)


def code_present(code: Column, low: Column) -> Column:
    return F.call_function("rlike", low, F.concat(F.lit(r"(?<![A-Za-z0-9._-])\Q"), F.lower(half_width(code)), F.lit(r"\E(?![A-Za-z0-9._-])")))


def dates_present(date: Column, found: Column) -> Column:
    """All dates of a text are among those found; a text without a date is never there."""
    return let(asked.dates(half_width(date)), lambda want: (F.size(want) > 0) & (F.size(F.array_except(want, found)) == 0))


def _name_present(name: Column, low: Column, source: Column) -> Column:
    return let(F.lower(half_width(name)), lambda n: low.contains(n) | F.lower(source).contains(n))


def identity_match(rows: DataFrame) -> DataFrame:
    """rows(sku, product, platform, market, date, segment, source) with `matched`: each name that is given stands in the segment, product, platform and market also in the source. Null or empty names ask for nothing."""
    segment, source = half_width(F.coalesce(F.col("segment"), F.lit(""))), F.coalesce(F.col("source"), F.lit(""))
    low = F.lower(segment)
    absent = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    tests = [
        absent("sku") | code_present(F.col("sku"), low), absent("product") | _name_present(F.col("product"), low, source), absent("platform") | _name_present(F.col("platform"), low, source),
        absent("market") | market_present(F.col("market"), F.lower(F.concat_ws(" ", segment, source))), absent("date") | dates_present(F.col("date"), asked.dates(segment)),
    ]
    return rows.withColumn("matched", reduce(lambda a, b: a & b, tests))


def values_in(segment: Column, fact_type: Column) -> Column:
    """Typed values of a segment; digits of codes and dates are none, amounts that look like dates (USD 2011.05) are."""
    plain = F.regexp_replace(F.regexp_replace(segment, asked.SKU, " "), asked.DATE, " ")
    tokens = F.transform(F.regexp_extract_all(plain, F.lit(VALUE_TOKEN), F.lit(0)), lambda x: F.trim(x))  # F.trim alone would take the index for what to trim
    return let(fact_type, lambda t: F.filter(F.transform(tokens, lambda x: typed_value(x, t)), lambda v: v.isNotNull()))


def fact_named(fact_type: Column, low: Column) -> Column:
    named = reduce(lambda rest, kv: F.when(fact_type == kv[0], asked.contains_any(low, kv[1])).otherwise(rest), asked.FACTS.items(), F.lit(False))
    return named & ~((fact_type == "inventory_quantity") & asked.contains_any(low, asked.NOT_INVENTORY))


def evidence_preflight(questions: DataFrame, segments: DataFrame) -> DataFrame:
    """questions(question_id, question) against segments(question_id, source, segment): (question_id, reason), null where some segment may answer.

    That segment names the fact and everything the question names, and holds one value of its type. Questions that
    their own text rules out never meet the segments.
    """
    q = questions.select("question_id", "question", asked.shop_intent(F.col("question")).alias("intent")).withColumn("reason", asked.question_preflight(F.col("question"), F.col("intent")))
    open_ = q.where("reason is null").select("question_id", "intent", F.get("intent.fact_types", F.lit(0)).alias("fact_type"))
    seg = segments.select("question_id", F.coalesce("source", F.lit("")).alias("source"), half_width(F.coalesce("segment", F.lit(""))).alias("segment")).withColumn("low", F.lower("segment")).withColumn("found", asked.dates(F.col("segment")))
    i, low, source = F.col("intent"), F.col("low"), F.col("source")
    names = F.concat(i["product_terms"], i["platforms"])
    where = F.lower(F.concat_ws(" ", "segment", source))
    fits = F.forall(names, lambda n: _name_present(n, low, source)) & F.forall(i["markets"], lambda m: market_present(m, where)) & F.forall(i["skus"], lambda x: code_present(x, low)) & F.forall(i["dates"], lambda x: dates_present(x, F.col("found")))
    ok = fact_named(F.col("fact_type"), low) & fits & (F.size(values_in(F.col("segment"), F.col("fact_type"))) == 1)
    bound = open_.join(seg, "question_id").where(ok).select("question_id").distinct().withColumn("bound", F.lit(True))
    return q.join(bound, "question_id", "left").select("question_id", F.coalesce("reason", F.when(F.col("bound").isNull(), "no_fact_binding")).alias("reason"))


def _first(text: Column, words, name=lambda w: w) -> Column:
    return F.coalesce(*[F.when(text.contains(w), F.lit(name(w))) for w in words], F.lit(""))


def context(text: Column) -> Column:
    """struct(table_type, platform, market, effective_date, currency, duration_unit) named first in a text; empty where none is."""

    def of(c: Column) -> Column:
        low = F.lower(c)
        kind = F.coalesce(*[F.when(asked.contains_any(low, names), F.lit(k)) for k, names in TABLE_KINDS.items()], F.lit(""))
        money, unit = F.regexp_extract(c, CURRENCY, 1), F.lower(F.regexp_extract(c, DURATION, 1))
        code = F.when(money.isin("RMB", "人民币", "￥", "¥"), "CNY").when(money.isin("美元", "$"), "USD").when(money == "港币", "HKD").otherwise(F.upper(money))
        length = F.when(unit == "", "").when(unit == "工作日", "business_day").when(unit.isin("hour", "hours", "小时", "时"), "hour").otherwise("day")
        values = (kind, F.coalesce(*[F.when(low.contains(p.lower()), F.lit(p)) for p in asked.PLATFORMS], F.lit("")), _first(c, MARKETS), F.coalesce(F.get(asked.dates(c), F.lit(0)), F.lit("")), code, length)
        return F.struct(*[v.alias(n) for n, v in zip(CONTEXT, values)])

    return let(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""), of)


def any_context(c: Column) -> Column:
    return F.concat(*[c[n] for n in CONTEXT]) != ""


def column_bindings(headers: Column) -> Column:
    """Headers of a table that tell something: struct(column_index, header_text, fact_type, identity, context)."""

    def one(h: Column, i: Column) -> Column:
        low = F.lower(h)
        kind = F.coalesce(*[F.when(asked.contains_any(low, names), F.lit(k)) for k, names in TABLE_KINDS.items()], F.lit(""))
        identity = F.when(low.contains("sku"), "sku").when(asked.contains_any(low, ("商品", "产品", "product")), "product").otherwise("")
        return F.struct(i.alias("column_index"), h.alias("header_text"), kind.alias("fact_type"), identity.alias("identity"), context(h).alias("context"))

    return F.filter(F.transform(headers, one), lambda b: (b["fact_type"] != "") | (b["identity"] != "") | any_context(b["context"]))


def evidence_prefix(source: Column, page: Column, table_id: Column, fields: dict[str, Column], bindings: Column) -> Column:
    """Lines that tell a table's place, its context and what its columns hold; empty ones are left out."""
    head = F.concat(F.lit("[TableEvidence | source="), source, F.lit(" | page="), page.cast("string"), F.lit(" | table="), table_id, F.lit("]"))
    lines = [F.when(F.coalesce(fields[f], F.lit("")) != "", F.concat(F.lit(f"{label}: "), fields[f])) for label, f in LABELS if f in fields]

    def told(b: Column) -> Column:
        parts = F.filter(F.array(b["identity"], b["fact_type"], b["context"]["currency"], b["context"]["duration_unit"]), lambda x: x != "")
        return F.concat(F.lit("c"), b["column_index"].cast("string"), F.lit("="), F.when(F.size(parts) > 0, F.array_join(parts, "/")).otherwise(b["header_text"]))

    columns = F.when(F.size(bindings) > 0, F.concat(F.lit("Columns: "), F.array_join(F.transform(bindings, told), "; ")))
    return F.concat_ws("\n", head, *lines, columns)


def table_anchor(blocks: DataFrame) -> DataFrame:
    """blocks(doc, page, top, place, label, content): tables with the last block before them that tells something, back to the table before.

    Blocks lie in the order of `top`, nulls last, then `place`. A page is the unit of work.
    """
    is_table, order = F.lower("label") == "table", [F.col("top").asc_nulls_last(), F.col("place")]
    before = Window.partitionBy("doc", "page").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = blocks.withColumn("__table", F.coalesce(is_table, F.lit(False))).withColumn("__segment", F.coalesce(F.sum(F.col("__table").cast("int")).over(before), F.lit(0)))
    rows = rows.withColumn("__told", F.when(~F.col("__table") & any_context(context(F.col("content"))), F.trim("content")))
    within = Window.partitionBy("doc", "page", "__segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("anchor", F.last("__told", True).over(within)).where("__table").drop("__table", "__segment", "__told")
