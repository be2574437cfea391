"""Answers held against their question, their own facts and the evidence they cite."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import let

from . import evidence
from . import intent as asked
from .verify import evidence_segments, fact_violations, half_width, strip, typed_value, values_equal

#: Citations and numbers in answers.
CITATION, CITATION_MARK = r"(?i)\[(C\d+)\]", r"(?i)\[?C\d+\]?"
ANSWER_NUMBER = r"(?<![A-Za-z\d])(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"

#: What an answer states: one struct per fact. year, company, metric and scope are those of financial facts.
FACT_FIELDS = ("fact_type", "value_text", "unit", "currency", "sku", "product", "platform", "market", "date", "year", "company", "metric", "scope")
FACTS = "array<struct<" + ",".join(f"{f}:string" for f in FACT_FIELDS) + ",citation_ids:array<string>>>"


def citations(text: Column) -> Column:
    """Distinct citation ids of a text in their order, upper-cased."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CITATION), F.lit(1)), F.upper))


def _numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ANSWER_NUMBER), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("")))


def _listed(label: str, ids: Column) -> Column:
    return F.concat(F.lit(label), F.array_join(ids, ","))


def extra_numbers(answer_text: Column, facts: Column) -> Column:
    """The answer holds a number that is neither the first of a fact's value nor part of its SKU or date."""
    said = _numbers(F.regexp_replace(strip(half_width(F.coalesce(answer_text, F.lit("")))), CITATION_MARK, ""))
    of = lambda f: F.concat(F.slice(_numbers(half_width(f["value_text"])), 1, 1), _numbers(f["sku"]), _numbers(f["date"]))
    return F.size(F.array_except(said, F.flatten(F.transform(facts, of)))) > 0


def _value(f: Column) -> Column:
    return typed_value(f["value_text"], f["fact_type"], f["unit"], f["currency"])


def conflicting(facts: Column) -> Column:
    """Two facts of one identity state different values. Values that can't be read conflict with none."""
    fold = lambda x: F.lower(strip(half_width(F.coalesce(x, F.lit("")))))
    name = lambda f: F.to_json(F.struct(f["fact_type"].alias("t"), fold(f["sku"]).alias("s"), fold(f["product"]).alias("p"), fold(f["platform"]).alias("l"), fold(f["market"]).alias("m"), F.array_sort(asked.dates(half_width(F.coalesce(f["date"], F.lit(""))))).alias("d")))
    pairs = F.filter(F.transform(facts, lambda f: F.struct(name(f).alias("who"), _value(f).alias("v"))), lambda x: x["v"].isNotNull())
    values = lambda p: F.transform(p, lambda x: F.struct(x["who"], x["v"]["canonical_value"], x["v"]["unit"], x["v"]["currency"]))
    return let(pairs, lambda p: F.size(F.array_distinct(values(p))) > F.size(F.array_distinct(F.transform(p, lambda x: x["who"]))))


def _agrees(wanted: Column, has: Column, there) -> Column:
    """One of what is wanted stands in what the fact has, and the other way round."""
    return F.exists(wanted, lambda t: there(t, has) & there(has, t))


def question_errors(intent: Column, fact: Column, value: Column) -> Column:
    """What the fact says otherwise than the question asks, in a fixed order."""
    low = lambda x: F.lower(F.coalesce(x, F.lit("")))
    both = {
        "sku": ("skus", lambda a, b: evidence.code_present(a, low(b))), "product": ("product_terms", lambda a, b: low(b).contains(F.lower(half_width(a)))), "platform": ("platforms", lambda a, b: low(b).contains(F.lower(half_width(a)))),
        "market": ("markets", lambda a, b: evidence.market_present(a, low(b))), "date": ("dates", lambda a, b: evidence.dates_present(a, asked.dates(half_width(b)))),
    }
    out = [F.when((F.size(intent["fact_types"]) > 0) & ~F.array_contains(intent["fact_types"], F.coalesce(fact["fact_type"], F.lit(""))), "question_fact_type_mismatch")]
    for name, (wanted, there) in both.items():
        has = F.coalesce(fact[name], F.lit(""))
        met = (has != "") & _agrees(intent[wanted], has, there)
        out.append(F.when((F.size(intent[wanted]) > 0) & ~F.coalesce(met, F.lit(False)), f"question_{name}_mismatch"))
    return F.array_compact(F.array(*out, F.when(value.isNull(), "question_unit_mismatch")))


def _supported(facts: DataFrame, ledger: DataFrame) -> DataFrame:
    """(answer_id, fact_index, citation_id) of the facts that one segment of the citation states: it names the fact and all its identity, and holds one value of its type, an equal one."""
    segments = evidence_segments(ledger.withColumn("content", half_width(F.coalesce("content", F.lit("")))).withColumn("citation_id", F.struct("answer_id", "citation_id", F.coalesce("source", F.lit("")).alias("source"))))
    segments = segments.select("citation_id.answer_id", "citation_id.citation_id", "citation_id.source", "segment")
    cited = facts.where("value is not null").select("answer_id", "fact_index", "fact.*", "value").withColumn("citation_id", F.explode("citation_ids"))
    named = cited.join(segments, ["answer_id", "citation_id"]).where(evidence.fact_named(F.col("fact_type"), F.lower("segment")))
    matched = evidence.identity_match(named).where("matched")
    held = evidence.values_in(F.col("segment"), F.col("fact_type"))
    ok = let(F.struct(held.alias("held"), F.col("value").alias("value")), lambda x: (F.size(x["held"]) == 1) & values_equal(F.get(x["held"], F.lit(0)), x["value"]))
    return matched.where(ok).select("answer_id", "fact_index", "citation_id").distinct()


def verify_answers(answers: DataFrame, ledger: DataFrame) -> DataFrame:
    """answers(answer_id, question, answer_text, facts) against ledger(answer_id, citation_id, source, content_type, content).

    Returns (answer_id, passed, errors, verified_citation_ids): errors are distinct and in a fixed order. A question that can't be
    answered from one fact, or a fact that breaks its contract, ends the check with that error alone. Then come the
    answer's citations (unknown, missing, other than its facts'), missing facts, numbers of no fact and facts in conflict; then each
    fact's citations, its match with the question, and its support: one segment of each cited source must state it alone.
    Null facts are none, a null text is empty, and a null question asks for nothing. answer_id names an answer; repeated rows of one are
    checked as one. Facts and segments meet on (answer_id, citation_id); an answer's facts are few, so nothing large is gathered.
    """
    base = answers.dropDuplicates(["answer_id"]).select("answer_id", "question", F.coalesce("answer_text", F.lit("")).alias("answer_text"), F.coalesce(F.col("facts").cast(FACTS), F.array().cast(FACTS)).alias("facts"))
    # the whole intent is worked out where facts are held against it, once; what decides whether there is a need to costs far less
    base = base.withColumn("intent", asked.shop_intent(F.col("question"))).withColumn("reason", asked.shop_preflight(F.col("question")))
    invalid = F.exists("facts", lambda f: F.size(fact_violations(f["fact_type"], f["unit"], f["currency"])) > 0)
    base = base.withColumn("reason", F.coalesce("reason", F.when(invalid, "invalid_structured_output")))
    known = ledger.groupBy("answer_id").agg(F.collect_set("citation_id").alias("known"))
    base = base.join(known, "answer_id", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    open_ = base.where("reason is null")

    facts = open_.select("answer_id", "intent", "known", F.posexplode("facts").alias("fact_index", "fact")).withColumn("value", _value(F.col("fact")))
    support = _supported(facts, ledger).groupBy("answer_id", "fact_index").agg(F.collect_set("citation_id").alias("supporting"))
    rows = facts.join(support, ["answer_id", "fact_index"], "left").withColumn("supporting", F.coalesce("supporting", F.array().cast("array<string>")))
    ids = F.coalesce("fact.citation_ids", F.array().cast("array<string>"))
    unknown, unmet = F.array_except(ids, F.col("known")), F.array_except(ids, F.col("supporting"))
    found = F.filter(ids, lambda c: F.array_contains("supporting", c))
    support_error = F.when(F.size(found) == 0, "evidence_mismatch_or_cross_fragment").when(F.size(unmet) > 0, _listed("unsupported_citation:", unmet))
    checked = F.concat(question_errors(F.col("intent"), F.col("fact"), F.col("value")), F.array_compact(F.array(support_error)))
    errors = F.when(F.size(ids) == 0, F.array(F.lit("missing_citation"))).when(F.size(unknown) > 0, F.array(_listed("unknown_citation:", unknown))).otherwise(checked)
    verified = F.when((F.size(ids) > 0) & (F.size(unknown) == 0) & (F.size(unmet) == 0), ids).otherwise(F.array().cast("array<string>"))
    number = (F.col("fact_index") + 1).cast("string")
    one = F.struct("fact_index", F.transform(errors, lambda e: F.concat(F.lit("fact_"), number, F.lit(":"), e)).alias("errors"), verified.alias("verified"))
    per_answer = rows.groupBy("answer_id").agg(F.array_sort(F.collect_list(one)).alias("parts"))

    said, stated = citations(F.col("answer_text")), F.array_distinct(F.flatten(F.transform("facts", lambda f: F.coalesce(f["citation_ids"], F.array().cast("array<string>")))))
    none = F.size("facts") == 0
    differ = (F.size(F.array_except(said, stated)) > 0) | (F.size(F.array_except(stated, said)) > 0)
    of_answer = F.array(
        F.when(F.size(F.array_except(said, F.col("known"))) > 0, _listed("answer_unknown_citation:", F.array_except(said, F.col("known")))), F.when(~none & (F.size(said) == 0), "answer_missing_citation"), F.when(differ, "answer_fact_citation_mismatch"),
        F.when(none, "missing_ecommerce_facts"), F.when(extra_numbers(F.col("answer_text"), F.col("facts")), "answer_contains_uncited_numeric_value"), F.when(conflicting(F.col("facts")), "conflicting_ecommerce_facts"),
    )
    flat = lambda field: F.coalesce(F.flatten(F.transform("parts", lambda p: p[field])), F.array().cast("array<string>"))
    got = base.join(per_answer, "answer_id", "left")
    errors = F.when(F.col("reason").isNotNull(), F.array("reason")).otherwise(F.array_distinct(F.concat(F.array_compact(of_answer), flat("errors"))))
    out = got.select("answer_id", errors.alias("errors"), F.array_distinct(flat("verified")).alias("verified_citation_ids"))
    return out.select("answer_id", (F.size("errors") == 0).alias("passed"), "errors", "verified_citation_ids")


def known_and_equal(said: Column, stated: Column, known: Column) -> list[Column]:
    """Errors of the citations of a financial answer, nulls where there are none."""
    both = F.array_union(said, stated)
    unknown = F.array_sort(F.array_except(both, known))
    differ = (F.size(F.array_except(said, stated)) > 0) | (F.size(F.array_except(stated, said)) > 0)
    return [F.when(F.size(unknown) > 0, _listed("unknown_citation:", unknown)), F.when(F.size(said) == 0, "answer_missing_citation"), F.when(differ, "answer_fact_citation_mismatch")]


def any_of(errors: Column, *marks: str) -> Column:
    return F.exists(errors, lambda e: reduce(lambda a, b: a | b, [e.contains(m) for m in marks]))
