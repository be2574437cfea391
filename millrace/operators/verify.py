"""Typed values in text, fact and truth contracts, evidence segments and strict matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import let

# Patterns and names that results depend on.
NUMBER = r"(\(\s*[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?\s*\)|[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?)"
CURRENCY = r"(?i)(HK\$|CNY|RMB|USD|HKD|人民币|美元|港币|元|[￥¥$])"
CURRENCY_CODES = {"CNY": "CNY", "RMB": "CNY", "人民币": "CNY", "元": "CNY", "￥": "CNY", "¥": "CNY", "USD": "USD", "美元": "USD", "$": "USD", "HKD": "HKD", "港币": "HKD", "HK$": "HKD"}
DURATION = r"(?i)(business\s+days?|hours?|days?|个?工作日|小时|天|日|时)"
DURATION_UNITS = {"小时": "hour", "时": "hour", "hour": "hour", "hours": "hour", "天": "day", "日": "day", "day": "day", "days": "day", "工作日": "business_day", "business day": "business_day", "business days": "business_day"}
SCALE = r"(?<=\d)\s*(?:[kK]|千|万|百万|亿)(?![\w])"
FACT_TYPES = ("price", "inventory_quantity", "delivery_duration", "customs_duty_rate")
TRADING = ("买入", "卖出", "投资建议", "推荐", "持有")
MARKET = ("股价", "股票", "目标价")
PREAMBLE = ("Table:", "Platform:", "Market:", "Date:", "Currency:", "Unit:", "Columns:")
FORECAST = ("预测", "涨到", "跌到", "会涨", "会跌", "明年", "未来")


# Full-width forms and the characters they stand for.
FULL_WIDTH = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000\u00a0"
HALF_WIDTH = "".join(map(chr, range(0x21, 0x7F))) + "  "


def half_width(text: Column) -> Column:
    """Full-width letters, digits and signs as plain ones, and wide blanks as blanks."""
    return F.translate(text, FULL_WIDTH, HALF_WIDTH)


def _names(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _embedded(text: Column, pattern: str, names: dict[str, str], fold) -> Column:
    hit = F.regexp_extract(text, pattern, 1)
    return F.when(hit != "", F.element_at(_names(names), fold(hit)))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def typed_value(text: Column, fact_type: Column, unit: Column | None = None, currency: Column | None = None) -> Column:
    """struct(value, canonical_value, unit, currency, kind) of the first number of a text, or null.

    Scale words, a missing or a foreign unit or currency, and negative numbers are refused; a
    number in brackets is negative. A unit or currency declared beside the text must be known and must not differ from the text's own.
    Days count 24 hours in the canonical value. Without a fact type the value itself tells its kind, and days stay days.
    """
    text = half_width(text)
    number = F.regexp_extract(text, NUMBER, 1)
    bracket = number.startswith("(")
    plain = F.regexp_replace(number, r"[(),\s]", "").try_cast("decimal(38,10)")
    value = F.when(bracket, -F.abs(plain)).otherwise(plain)
    rest = F.regexp_replace(text, r"(?s)^.*?" + NUMBER, "")
    squeeze = lambda x: F.regexp_replace(F.lower(F.regexp_replace(x, r"\s+", " ")), "^个", "")
    own_currency, own_unit = _embedded(text, CURRENCY, CURRENCY_CODES, F.upper), _embedded(rest, DURATION, DURATION_UNITS, squeeze)
    percent, agree = text.rlike("[%％]"), F.lit(True)
    if currency is not None:
        told = F.element_at(_names(CURRENCY_CODES), F.upper(strip(half_width(currency))))
        agree = agree & (currency.isNull() | F.coalesce(told == F.coalesce(own_currency, told), F.lit(False)))
        own_currency = F.coalesce(told, own_currency)
    if unit is not None:
        share = F.coalesce(strip(half_width(unit)).isin("%", "percent"), F.lit(False))
        told = F.element_at(_names(DURATION_UNITS | {"business_day": "business_day"}), squeeze(strip(half_width(unit))))
        agree = agree & (unit.isNull() | share | F.coalesce(told == F.coalesce(own_unit, told), F.lit(False)))
        own_unit, percent = F.coalesce(told, own_unit), percent | share
    money, time, whole = own_currency.isNotNull(), own_unit.isNotNull(), value == F.floor(value)
    seen = F.when(money & ~time & ~percent, "price").when(percent & ~money & ~time, "customs_duty_rate").when(time & ~money, "delivery_duration").when(whole & ~money, "inventory_quantity")
    ok = (
        F.when(fact_type == "price", money & ~time & ~percent).when(fact_type == "inventory_quantity", whole & ~money & ~time & ~percent).when(fact_type == "delivery_duration", time & ~money & ~percent)
        .when(fact_type == "customs_duty_rate", percent & ~money & ~time).when(fact_type.isNull(), seen.isNotNull())
    )
    kind = F.coalesce(fact_type, seen)
    canonical = F.when((fact_type == "delivery_duration") & (own_unit == "day"), (value * 24).cast("decimal(38,10)")).otherwise(value)
    out = F.struct(value.alias("value"), canonical.alias("canonical_value"), F.when(kind == "customs_duty_rate", "percent").otherwise(own_unit).alias("unit"), own_currency.alias("currency"), kind.alias("kind"))
    return F.when((number != "") & ~text.rlike(SCALE) & (value >= 0) & agree & F.coalesce(ok, F.lit(False)), out)


def all_values(text: Column, fact_type: Column) -> Column:
    """Typed values of every number of a text, each read with 16 characters before it and 24 behind it, so its neighbours may rule it out."""
    whole = strip(half_width(F.coalesce(text, F.lit(""))))

    def read(x: Column) -> Column:
        # places of the numbers: what stands before each, added up
        parts = F.split(x["text"], NUMBER)
        hits = F.regexp_extract_all(x["text"], F.lit(NUMBER), F.lit(1))
        starts = F.transform(hits, lambda h, i: F.aggregate(F.slice(parts, 1, i + 1), F.lit(0), lambda n, p: n + F.length(p)) + F.aggregate(F.slice(hits, 1, i), F.lit(0), lambda n, p: n + F.length(p)))
        near = F.zip_with(starts, hits, lambda s, h: F.substr(x["text"], F.greatest(s - 16, F.lit(0)) + 1, s - F.greatest(s - 16, F.lit(0)) + F.length(h) + 24))
        return F.filter(F.transform(near, lambda w: typed_value(w, x["kind"])), lambda v: v.isNotNull())

    return let(F.struct(whole.alias("text"), fact_type.alias("kind")), read)


def values_equal(a: Column, b: Column) -> Column:
    """Equal kind, canonical value and currency, and equal units, hours and days counting as one scale."""
    scale = lambda u: F.when(u.isin("hour", "day"), "hour").otherwise(u)
    return a.isNotNull() & b.isNotNull() & (a["kind"] == b["kind"]) & (a["canonical_value"] == b["canonical_value"]) & a["currency"].eqNullSafe(b["currency"]) & scale(a["unit"]).eqNullSafe(scale(b["unit"]))


def fact_violations(t: Column, unit: Column, cur: Column) -> Column:
    """Rules that a fact's type, unit and currency break."""
    return F.array_compact(
        F.array(
            F.when(~t.isin(*FACT_TYPES) | t.isNull(), "unknown_fact_type"),
            F.when((t == "price") & (cur.isNull() | unit.isNotNull()), "price_needs_currency_without_unit"),
            F.when((t == "inventory_quantity") & (cur.isNotNull() | unit.isNotNull()), "quantity_without_currency_and_unit"),
            F.when((t == "delivery_duration") & (cur.isNotNull() | ~F.coalesce(unit.isin("hour", "day", "business_day"), F.lit(False))), "duration_needs_unit_without_currency"),
            F.when((t == "customs_duty_rate") & (cur.isNotNull() | ~unit.eqNullSafe("percent")), "rate_needs_percent_without_currency"),
        )
    )


def fact_contract(facts: DataFrame) -> DataFrame:
    """facts(fact_type, unit, currency, ...) with the rules each row breaks."""
    return facts.withColumn("violations", fact_violations(F.col("fact_type"), F.col("unit"), F.col("currency")))


def truth_contract(truth: DataFrame, manifest: DataFrame) -> DataFrame:
    """truth(case_id, pdf, metric, expected_value, expected_page, should_refuse, refusal_reason) with the rules each case breaks."""
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    ids = truth.groupBy("case_id").agg(F.count(F.lit(1)).alias("__n"))
    rows = truth.join(ids, "case_id", "left").join(manifest.select(F.col("pdf"), F.col("page_count").alias("__pages")), "pdf", "left")
    asked = ~F.col("should_refuse")
    rules = F.array(
        F.when(blank("case_id") | (F.col("__n") > 1), "case_id_not_unique"), F.when(F.col("__pages").isNull(), "unknown_source"),
        F.when(F.col("should_refuse") & blank("refusal_reason"), "refusal_reason_missing"), F.when(asked & (blank("metric") | blank("expected_value")), "empty_field"),
        F.when(asked & ~F.coalesce(F.col("expected_page").between(1, F.col("__pages")), F.lit(False)), "page_out_of_range"),
    )
    return rows.withColumn("violations", F.array_compact(rules)).drop("__n", "__pages")


def citation_subset(answer: Column, known: Column) -> Column:
    """The answer names at least one citation and only known ones."""
    named = F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[(C\d+)\]"), F.lit(1)))
    return (F.size(named) > 0) & (F.size(F.array_except(named, known)) == 0)


def strict_value_match(expected: Column, content: Column) -> Column:
    """A number must stand between characters that are neither digit nor dot, commas apart; other values must be contained, blanks apart."""
    fold = lambda x: F.lower(half_width(x))
    want, text = fold(expected), fold(content)
    number = F.regexp_replace(want, r"[\s,]", "")
    pattern = F.concat(F.lit(r"(?<![\d.])\Q"), number, F.lit(r"\E(?![\d.])"))
    squeeze = lambda x: F.regexp_replace(x, r"[\s,]", "")
    numeric = F.call_function("rlike", F.regexp_replace(F.replace(text, F.lit(","), F.lit("")), r"\s+", " "), pattern)
    return F.when(F.trim(want) == "", F.lit(False)).when(want.rlike(r"\d"), numeric).otherwise(squeeze(text).contains(squeeze(want)))


def coverage_category(cases: DataFrame, chunks: DataFrame) -> DataFrame:
    """cases(case_id, source, page, metric, expected_value) against chunks(source, page, content): where metric and value are found."""
    squeeze = lambda c: F.regexp_replace(F.lower(c), r"[\s,]", "")
    both = cases.join(chunks, ["source", "page"], "left")
    metric, value = squeeze(F.col("content")).contains(squeeze(F.col("metric"))), strict_value_match(F.col("expected_value"), F.col("content"))
    got = both.groupBy("case_id").agg(*[F.coalesce(F.bool_or(x), F.lit(False)).alias(n) for n, x in (("page", F.col("content").isNotNull()), ("metric", metric), ("value", value), ("strict", metric & value))])
    name = F.when(F.col("strict"), "strict_target_present").when(~F.col("page"), "no_target_page_table_chunk").when(F.col("metric") & F.col("value"), "metric_value_split_across_chunks").when(F.col("metric"), "metric_only").when(F.col("value"), "value_only").otherwise("metric_and_value_missing")
    return got.select("case_id", name.alias("category"))


def evidence_segments(ledger: DataFrame) -> DataFrame:
    """ledger(citation_id, content_type, content) to one row per sentence, or per table row as header=value pairs behind the table's own labels.

    Sentences end with full stops of Chinese, with exclamation and question marks, semicolons and line ends; a plain dot may stand in a number and ends none.
    """
    lines = F.filter(F.transform(F.split("content", "\r\n|[\r\n]"), strip), lambda x: x != "")
    cells = F.filter(F.transform(F.filter(lines, lambda x: x.startswith("|") & x.endswith("|") & (F.length(x) > 1)), lambda x: F.transform(F.split(F.substr(x, F.lit(2), F.length(x) - 2), r"\|"), strip)), lambda c: (F.size(c) >= 2) & F.exists(c, lambda v: ~v.rlike("^[-:]*$")))
    told = F.filter(lines, lambda x: x.rlike("^(?:" + "|".join(PREAMBLE) + ")"))
    rows = ledger.select("citation_id", "content", F.when((F.col("content_type") == "table") & F.col("content").contains("|"), cells).alias("__cells"), told.alias("__told"))
    pairs = lambda head, row: F.filter(F.zip_with(head, row, lambda h, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(h, F.lit("="), v))), lambda p: p.isNotNull())
    filled = F.filter(F.transform(F.slice(F.col("__cells"), F.lit(2), F.greatest(F.size("__cells"), F.lit(1))), lambda r: pairs(F.element_at(F.col("__cells"), 1), r)), lambda p: F.size(p) > 0)
    from_rows = F.transform(filled, lambda p: F.array_join(F.concat(F.col("__told"), p), " | "))
    sentences = F.filter(F.transform(F.split("content", r"(?<=[。！？!?；;])\s*|\n+"), strip), lambda x: x != "")
    rows = rows.withColumn("__rows", F.when(F.size("__cells") >= 2, from_rows))
    return rows.select("citation_id", F.posexplode(F.when(F.size("__rows") > 0, F.col("__rows")).otherwise(sentences)).alias("segment_index", "segment"))


def advice_guard(question: Column) -> Column:
    has = lambda words: question.rlike("|".join(words))
    return has(TRADING) | (has(MARKET) & has(FORECAST))


def hash_embedding(rows: DataFrame, key: str, content: str, dimension: int = 768) -> DataFrame:
    """(key, embedding): signed hashing of ASCII tokens and CJK 1- to 4-grams, of unit length; all zeros for a text with no feature."""
    low = F.regexp_replace(F.lower(F.coalesce(F.col(content), F.lit(""))), r"\s+", "")
    cjk = F.regexp_replace(low, r"[^一-鿿]", "")

    def grams(n: int) -> Column:
        return F.when(F.length(cjk) >= n, F.transform(F.sequence(F.lit(1), F.length(cjk) - (n - 1)), lambda i: F.substr(cjk, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    features = F.concat(F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), F.lit(0)), grams(1), grams(2), grams(3), grams(4))
    f = rows.select(key, F.explode(features).alias("f")).withColumn("h", F.md5("f"))
    bucket = (F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % dimension).cast("int")
    sign = F.when(F.conv(F.substring("h", 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    sums = f.groupBy(key, bucket.alias("b")).agg(F.sum(sign).alias("v")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("b", "v"))).alias("m"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    filled = rows.select(key).join(sums, key, "left")
    value = lambda i: F.coalesce(F.try_divide(F.try_element_at("m", i), F.col("norm")), F.lit(0.0))
    return filled.select(key, F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), value).alias("embedding"))
