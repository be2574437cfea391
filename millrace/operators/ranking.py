"""Ranks of fused candidates by what their question asks for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import text as words

from . import intent as asked
from .metrics import rounded
from .retrieval import top_by
from .verify import half_width

# Channel weights, the number pattern, expected statements and headings of no use.
CHANNEL_WEIGHTS = {"table_lexical": 1.25, "table_dense": 1.0, "text_lexical": 0.75, "text_dense": 0.75}
NUMBER = r"(?<![\d.])[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?%?(?![\d.])"
EXPECTED = (
    (("营业收入", "净利润", "归母净利润"), ("合并利润表", "利润表")), (("资产合计", "负债合计"), ("合并资产负债表", "资产负债表")),
    (("经营现金流",), ("合并现金流量表", "现金流量表")), (("毛利率",), ("毛利率", "分行业", "分产品")),
)
NOISE = ("主要会计数据和财务指标", "季度主要财务指标", "非经常性损益", "前十名股东")


def _in(needles: Column, *texts: Column) -> Column:
    return words.let(F.concat_ws("\0", *texts), lambda t: F.exists(needles, lambda x: t.contains(x)))


def _aliases(names: dict[str, tuple[str, ...]], kind: Column) -> Column:
    """Aliases of a kind; none where the kind is null."""
    none = F.array().cast("array<string>")
    return reduce(lambda rest, kv: F.when(kind == kv[0], F.array(*map(F.lit, kv[1]))).otherwise(rest), names.items(), none)


def _flag(x: Column) -> Column:
    return F.coalesce(x, F.lit(False)).cast("double")


def lexical_overlap(question: Column, content: Column) -> Column:
    """Length of the question's terms that the content has over that of all its terms, 4 digits."""
    return words.let(words.terms(question), lambda q: overlap_of(q, content))


def overlap_of(terms: Column, content: Column) -> Column:
    """As lexical_overlap, of a question's terms."""
    size = lambda t: F.aggregate(t, F.lit(0), lambda n, x: n + F.length(x))
    return F.when(F.size(terms) == 0, F.lit(0.0)).otherwise(rounded(size(F.array_intersect(terms, words.terms(content))) / size(terms), 4))


def shop_features(rows: DataFrame) -> DataFrame:
    """rows(intent, content, source, content_type, semantic_text) with the six features of a shop answer, each 0 or 1. Nulls are empty texts."""
    content, source, known = (F.coalesce(F.col(c), F.lit("")) for c in ("content", "source", "semantic_text"))
    i, who = F.col("intent"), F.lower(F.concat_ws(" ", known, content, source))
    low = F.lower(half_width(content))
    facts = _aliases(asked.FACTS, F.get(i["fact_types"], F.lit(0)))
    lower = lambda a: F.transform(a, F.lower)
    return rows.withColumns(
        {
            "fact_row_score": _flag(_in(facts, low) & low.rlike(NUMBER)), "sku_score": _flag(_in(lower(i["skus"]), who)), "product_score": _flag(_in(lower(i["product_terms"]), who)),
            "platform_market_score": _flag(_in(lower(F.concat(i["platforms"], i["markets"])), who)), "date_score": _flag(_in(i["dates"], who)), "content_type_score": _flag(i["table_fact"] & (F.col("content_type") == "table")),
        }
    )


def financial_features(rows: DataFrame) -> DataFrame:
    """rows(intent, content, source, content_type, semantic_text) with the features of a financial answer, each 0 or 1. A metric's row holds a number that is no year."""
    content, source, known = (F.coalesce(F.col(c), F.lit("")) for c in ("content", "source", "semantic_text"))
    i = F.col("intent")
    names = _aliases(asked.METRICS, F.get(i["metric_families"], F.lit(0)))
    number = lambda line: F.exists(F.regexp_extract_all(line, F.lit(NUMBER), F.lit(0)), lambda x: ~x.rlike(r"^\d{4}%*$"))
    row = words.let(names, lambda n: F.exists(F.split(half_width(content), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda line: _in(n, line) & number(line)))
    return rows.withColumns(
        {
            "metric_row_score": _flag(row), "statement_scope_score": _flag(_in(F.concat(i["statement_types"], i["scopes"]), known, content)), "year_score": _flag(_in(i["years"], known, content)),
            "company_source_score": _flag(_in(i["company_terms"], source)), "content_type_score": _flag(i["table_fact"] & (F.col("content_type") == "table")),
        }
    )


def expected_statements(i: Column) -> Column:
    """Statements that the question's metric belongs to, the most exact one first; those it names where its metric tells none."""
    terms = i["statement_types"]
    for families, statements in reversed(EXPECTED):
        terms = F.when(F.arrays_overlap(i["metric_families"], F.array(*map(F.lit, families))), F.array(*map(F.lit, statements))).otherwise(terms)
    return terms


def metric_names(i: Column) -> Column:
    """Names of the question's first metric."""
    return _aliases(asked.METRICS, F.get(i["metric_families"], F.lit(0)))


def named_in(needles: Column, text: Column) -> Column:
    """One of the needles stands in the text."""
    return _in(needles, text)


def semantic_text(trusted: Column, *fields: str) -> Column:
    """Table context as text where its digest holds, else nothing."""
    return F.when(trusted, F.concat_ws(" ", *[F.coalesce(F.col(f), F.lit("")) for f in fields])).otherwise("")


def _ranked(rows: DataFrame, parts: list[tuple[float, Column]], rrf_weight: float, k: int) -> DataFrame:
    """Score, order and the best k per question after one row a table or text place is kept.

    Order: score, fused score, best channel rank, source, page, table, place, candidate; the last is unique, so ties are decided.
    A question's candidates are its channels' top rows, so its window is small.
    """
    top = F.max("rrf").over(Window.partitionBy("query_id"))
    score = reduce(lambda a, p: a + p[0] * p[1], parts, rrf_weight * F.col("normalized_rrf"))
    scored = rows.withColumn("normalized_rrf", F.coalesce(F.try_divide(F.col("rrf"), top), F.lit(0.0))).withColumn("score", rounded(score, 8)).withColumn("rrf", rounded(F.col("rrf"), 8)).withColumn("normalized_rrf", rounded(F.col("normalized_rrf"), 8))
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    order = [F.desc("score"), F.desc("rrf"), F.col("best_rank"), blank("source"), F.coalesce("page_number", F.lit(0)), blank("table_id"), F.coalesce("chunk_index", F.lit(0)), F.col("candidate_id")]
    place = F.to_json(F.struct("provenance_id", "source", "page_number", "chunk_index"), {"ignoreNullFields": "false"})
    keyed = scored.withColumn("__place", F.when(blank("table_id") != "", F.concat(F.lit("t"), blank("table_id"))).otherwise(place))
    first = top_by(keyed, ["query_id", "__place"], order, 1, "__n").drop("__n", "__place")
    return top_by(first, ["query_id"], order, k)


def rank_v2(rows: DataFrame, k: int = 5) -> DataFrame:
    """rows(query_id, candidate_id, rrf, best_rank, intent, ...) as shop answers."""
    c = F.col
    parts = [(0.20, c("fact_row_score")), (0.10, c("sku_score")), (0.05, c("product_score")), (0.05, c("platform_market_score")), (0.05, c("date_score")), (0.05, c("content_type_score"))]
    return _ranked(shop_features(rows), parts, 0.50, k)


def rank_financial_v2(rows: DataFrame, k: int = 5) -> DataFrame:
    c = F.col
    parts = [(0.20, c("metric_row_score")), (0.10, c("statement_scope_score")), (0.05, c("year_score")), (0.05, c("company_source_score")), (0.05, c("content_type_score"))]
    return _ranked(financial_features(rows), parts, 0.55, k)


def rank_financial_v3(rows: DataFrame, k: int = 5) -> DataFrame:
    """As v2 with the question's words, the statement its metric belongs to, and headings that tell of no statement. Needs `question`."""
    content, source, i = F.coalesce(F.col("content"), F.lit("")), F.coalesce(F.col("source"), F.lit("")), F.col("intent")
    terms = expected_statements(i)
    more = {
        "query_lexical_score": lexical_overlap(F.col("question"), content), "source_filter_score": _flag((F.size(i["company_terms"]) == 0) | _in(i["company_terms"], source)),
        "expected_statement_score": _flag(_in(terms, content)), "exact_statement_score": _flag(content.contains(F.get(terms, F.lit(0)))),
        "scope_score": _flag((F.size(i["scopes"]) == 0) | _in(i["scopes"], content)), "financial_noise_score": _flag(asked.contains_any(content, NOISE)),
    }
    weights = {"query_lexical_score": 0.60, "source_filter_score": 1.20, "year_score": 0.30, "metric_row_score": 1.00, "expected_statement_score": 0.20, "exact_statement_score": 0.10, "scope_score": 0.30, "content_type_score": 0.30, "financial_noise_score": -0.50}
    return _ranked(financial_features(rows).withColumns(more), [(w, F.col(n)) for n, w in weights.items()], 0.40, k)
