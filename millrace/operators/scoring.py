"""Answers scored field by field against the truth, and what their check makes of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import let

from . import factcheck
from .verify import half_width, strip, typed_value, values_equal

# Units of amounts and what they stand for, currencies, and the values that evidence may hold.
SCALES = {"元": "1", "千元": "1000", "万元": "10000", "百万元": "1000000", "亿元": "100000000"}
UNITS = r"(?i)(百分点|百万元|千元|万元|亿元|bp|bps|%|元)"
CURRENCY = r"(?i)(CNY|RMB|USD|HKD|人民币|美元|港币)"
CURRENCY_CODES = {"CNY": "CNY", "RMB": "CNY", "人民币": "CNY", "USD": "USD", "美元": "USD", "HKD": "HKD", "港币": "HKD"}
NUMBER = r"(\(\s*[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?\s*\)|[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?)"
EVIDENCE_VALUE = r"(?i)(?<![\d.])(?:\(\s*)?[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:\s*\))?\s*(?:百分点|百万元|千元|万元|亿元|bp|bps|%|元)"
TRUTH_FIELDS = ("fact_type", "expected_value", "expected_unit", "expected_currency", "expected_date", "expected_product", "expected_sku", "expected_platform", "expected_market", "expected_year", "expected_company", "metric", "expected_scope")
FIELDS = ("numeric", "unit", "period", "company", "metric", "scope")


def _in_map(names: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), key)


def financial_value(text: Column, unit: Column | None = None) -> Column:
    """struct(value, canonical_value, unit, currency, kind) of the first number of a text, or null without one.

    A unit given, else the one behind the number, makes it percentage points (100 basis points are one), a percentage or an
    amount in yuan; without any it is a plain number. A number in brackets is negative. Decimals are exact.
    """
    given = F.lit(None).cast("string") if unit is None else F.when(strip(half_width(unit)) != "", strip(half_width(unit)))

    def of(x: Column) -> Column:
        text, number = x["text"], F.regexp_extract(x["text"], NUMBER, 1)
        plain = F.regexp_replace(number, r"[(),\s]", "").try_cast("decimal(38,10)")
        value = F.when(number.startswith("("), -F.abs(plain)).otherwise(plain)
        seen = F.regexp_extract(F.regexp_replace(text, r"(?s)^.*?" + NUMBER, ""), UNITS, 1)
        unit = F.coalesce(x["unit"], F.when(seen != "", seen))
        code = _in_map(CURRENCY_CODES, F.upper(F.regexp_extract(text, CURRENCY, 1)))
        points, scale = F.lower(unit).isin("bp", "bps"), _in_map(SCALES, unit).cast("decimal(12,0)")
        exact = lambda c: c.cast("decimal(38,10)")
        part = lambda canonical, u, currency, kind: F.struct(value.alias("value"), exact(canonical).alias("canonical_value"), F.lit(u).cast("string").alias("unit"), currency.alias("currency"), F.lit(kind).alias("kind"))
        none = F.lit(None).cast("string")
        return (
            F.when(plain.isNull(), None).when(points, part(value / F.lit("100").cast("decimal(3,0)"), "percentage_point", none, "percentage_point")).when(unit == "百分点", part(value, "percentage_point", none, "percentage_point"))
            .when(unit == "%", part(value, "percent", none, "percent")).when(scale.isNotNull(), part(value * scale, "元", code, "amount")).otherwise(part(value, None, code, "number"))
        )

    return let(F.struct(strip(half_width(F.coalesce(text, F.lit("")))).alias("text"), given.alias("unit")), of)


def financially_equal(a: Column, b: Column) -> Column:
    """Same kind, unit, currency and canonical value; a missing value equals none."""
    return F.coalesce((a["kind"] == b["kind"]) & a["unit"].eqNullSafe(b["unit"]) & a["currency"].eqNullSafe(b["currency"]) & (a["canonical_value"] == b["canonical_value"]), F.lit(False))


def squeezed(x: Column) -> Column:
    """Without blanks and commas, in lower case."""
    return F.lower(F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), r"[\s,，]", ""))


def _given(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit("")) != ""


def field_match(actual: Column, expected: Column) -> Column:
    return _given(expected) & (squeezed(expected) == squeezed(actual))


def text_match(text: Column, expected: Column, numeric: bool = False) -> Column:
    """A text names what is expected: a number between characters that are neither digit nor dot, yuan without a scale before it, other words anywhere."""
    where, want = squeezed(text), squeezed(expected)
    if numeric:
        hit = F.call_function("rlike", where, F.concat(F.lit(r"(?<![\d.])\Q"), want, F.lit(r"\E(?![\d.])")))
    else:
        hit = F.when(want == "元", where.rlike("(?<!千|万|百|亿)元")).otherwise(where.contains(want))
    return _given(expected) & hit


def _shop_fields(fact: Column, t) -> dict[str, Column]:
    value = let(F.struct(typed_value(fact["value_text"], fact["fact_type"], fact["unit"], fact["currency"]).alias("a"), typed_value(t("expected_value"), t("fact_type"), t("expected_unit"), t("expected_currency")).alias("b")), lambda x: F.coalesce(values_equal(x["a"], x["b"]), F.lit(False)))
    scope = reduce(lambda a, n: a & (~_given(t(f"expected_{n}")) | field_match(fact[n], t(f"expected_{n}"))), ("sku", "platform", "market"), F.lit(True))
    return {"numeric": value, "unit": value, "period": field_match(fact["date"], t("expected_date")), "company": field_match(fact["product"], t("expected_product")), "metric": field_match(fact["fact_type"], t("fact_type")), "scope": scope}


def _financial_fields(fact: Column, t) -> dict[str, Column]:
    both = F.struct(financial_value(fact["value_text"], fact["unit"]).alias("a"), financial_value(t("expected_value"), t("expected_unit")).alias("b"))
    numeric = _given(t("expected_value")) & _given(t("expected_unit")) & let(both, lambda x: financially_equal(x["a"], x["b"]))
    return {"numeric": numeric, "unit": field_match(fact["unit"], t("expected_unit")), "period": field_match(fact["year"], t("expected_year")), "company": field_match(fact["company"], t("expected_company")), "metric": field_match(fact["metric"], t("metric")), "scope": field_match(fact["scope"], t("expected_scope"))}


def _legacy_fields(text: Column, t) -> dict[str, Column]:
    return {"numeric": text_match(text, t("expected_value"), True), "unit": text_match(text, t("expected_unit")), "period": text_match(text, t("expected_year")), "company": text_match(text, t("expected_company")), "metric": text_match(text, t("metric")), "scope": text_match(text, t("expected_scope"))}


def _financial_check(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """(case_id, errors) of financial answers: citations, and a cited context that names the identity and holds the expected value."""
    said, first = factcheck.citations(F.col("answer_text")), F.get("facts", F.lit(0))
    stated = F.array_distinct(F.transform(F.coalesce(first["citation_ids"], F.array().cast("array<string>")), F.upper))
    cited = rows.select("case_id", "truth", said.alias("said"), stated.alias("stated"))
    t = lambda n: F.col("truth")[n]
    hits = cited.withColumn("citation_id", F.explode(F.array_intersect("said", "stated"))).join(ledger.select("case_id", "citation_id", "content"), ["case_id", "citation_id"])
    want = financial_value(t("expected_value"), t("expected_unit"))
    held = F.transform(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(EVIDENCE_VALUE), F.lit(0)), lambda x: financial_value(x))
    named = reduce(lambda a, n: a & (~_given(t(n)) | squeezed(F.col("content")).contains(squeezed(t(n)))), ("expected_company", "expected_year", "metric", "expected_scope"), F.lit(True))
    value = let(F.struct(held.alias("held"), want.alias("want")), lambda x: F.exists(x["held"], lambda v: financially_equal(v, x["want"])))
    good = hits.where(named & value).select("case_id").distinct().withColumn("supported", F.lit(True))
    known = ledger.groupBy("case_id").agg(F.collect_set("citation_id").alias("known"))
    got = cited.join(known, "case_id", "left").join(good, "case_id", "left")
    errors = [*factcheck.known_and_equal(F.col("said"), F.col("stated"), F.coalesce("known", F.array().cast("array<string>"))), F.when(F.col("supported").isNull(), "evidence_mismatch")]
    return got.select("case_id", F.array_compact(F.array(*errors)).alias("errors"))


def score_answers(outputs: DataFrame, truths: DataFrame, ledger: DataFrame, profile: str) -> DataFrame:
    """outputs(case_id, question, status, answer_text, facts, given_errors, given_status) against truths(case_id, should_refuse, fact_type, expected_…, metric).

    `verified` compares the first fact with the truth by exact decimals, units and periods, as a shop fact where the truth has a fact_type
    and as a financial one elsewhere, and checks the answer again on ledger(case_id, citation_id, source, content_type, content);
    `legacy` looks for what is expected in the text and takes the errors the run gave. One row for each case on both sides, which are
    aligned one to one; a case that is not accepted is neither valid nor invalid. strict_correct means refused where it should be,
    else accepted with all fields right. A null text or fact list is empty; a null truth field is never matched.
    """
    if profile not in ("legacy", "verified"):
        raise ValueError(f"profile {profile}")
    truth = truths.select("case_id", F.coalesce("should_refuse", F.lit(False)).alias("should_refuse"), F.struct(*[F.col(f).cast("string").alias(f) for f in TRUTH_FIELDS]).alias("truth"))
    facts = F.coalesce(F.col("facts").cast(factcheck.FACTS), F.array().cast(factcheck.FACTS))
    rows = outputs.select("case_id", "question", "status", F.coalesce("answer_text", F.lit("")).alias("answer_text"), facts.alias("facts"), "given_errors", "given_status").join(truth, "case_id")
    fact, t = F.get("facts", F.lit(0)), lambda n: F.col("truth")[n]
    if profile == "legacy":
        fields = _legacy_fields(F.col("answer_text"), t)
        checked = rows.withColumn("verification_errors", F.coalesce("given_errors", F.array().cast("array<string>"))).withColumn("verification_status", F.col("given_status"))
    else:
        shop, money = _shop_fields(fact, t), _financial_fields(fact, t)
        is_shop = _given(t("fact_type"))
        fields = {f: F.when(is_shop, shop[f]).otherwise(money[f]) for f in FIELDS}
        answers = rows.where(is_shop).select(F.col("case_id").alias("answer_id"), "question", "answer_text", "facts")
        of_shop = factcheck.verify_answers(answers, ledger.withColumnRenamed("case_id", "answer_id")).select(F.col("answer_id").alias("case_id"), "errors")
        errors = of_shop.unionByName(_financial_check(rows.where(~is_shop), ledger)).withColumnRenamed("errors", "verification_errors")
        checked = rows.join(errors, "case_id").withColumn("verification_status", F.when(F.size("verification_errors") == 0, "passed").otherwise("failed"))
    checked = checked.withColumns({f"{f}_correct": F.coalesce(c, F.lit(False)) for f, c in fields.items()})
    accepted, refused, found = F.col("status").eqNullSafe("accepted"), F.col("status").eqNullSafe("refused"), F.col("verification_errors")
    strict = F.when(F.col("should_refuse"), refused).otherwise(reduce(lambda a, f: a & F.col(f"{f}_correct"), FIELDS, accepted))
    valid = F.when(accepted, F.size(found) == 0) if profile == "verified" else F.lit(None).cast("boolean")
    return checked.select(
        "case_id", accepted.alias("accepted"), refused.alias("refused"), "should_refuse", strict.alias("strict_correct"), *[f"{f}_correct" for f in FIELDS], valid.alias("citation_valid"),
        (accepted & factcheck.any_of(found, "unknown_citation")).alias("unknown_citation_accepted"), (accepted & factcheck.any_of(found, "uncited_numeric", "evidence_mismatch", "unsupported_citation")).alias("unsupported_numeric_accepted"),
        factcheck.any_of(found, "invalid_structured_output").alias("schema_error"), "verification_status", "verification_errors",
    )
