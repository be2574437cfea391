"""Pages ranked by the chunks of them that were found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import terms as terms_of

from . import intent as asked
from .metrics import rounded
from .ranking import NOISE, expected_statements, metric_names, named_in, overlap_of
from .retrieval import top_by

# Weights of the features of a page.
WEIGHTS = {
    "best_child_rr": 0.70, "top3_child_rr": 0.07, "parent_lexical_score": 0.90, "metric_alias_score": 0.70, "statement_score": 0.40, "exact_statement_score": 0.10, "scope_score": 0.03, "year_score": 0.60,
    "noise_score": -0.60, "child_evidence_count": 0.06, "company_source_score": 2.00, "best_dense_rr": 0.50, "best_lexical_rr": 0.50,
}


def parent_evidence(found: DataFrame, k: int = 60, most_rank: int = 100) -> DataFrame:
    """found(query_id, source, page_number, channel, rank) to one row per query and page: the best and the three best reciprocal ranks, how many, and the best of the dense and lexical channels.

    Only ranks up to most_rank count, as channels are no longer than that, which bounds what a page gathers.
    """
    rr = lambda rank: F.lit(1.0) / (k + rank)
    of = lambda name: F.coalesce(rr(F.min(F.when(F.col("channel") == name, F.col("rank")))), F.lit(0.0))
    first = F.slice(F.array_sort(F.collect_list("rank")), 1, 3)
    got = found.where(F.col("rank").between(1, most_rank)).groupBy("query_id", "source", "page_number").agg(
        rr(F.min("rank")).alias("best_child_rr"), first.alias("__first"), F.count(F.lit(1)).cast("double").alias("child_evidence_count"), of("dense").alias("best_dense_rr"), of("lexical").alias("best_lexical_rr")
    )
    return got.withColumn("top3_child_rr", F.aggregate("__first", F.lit(0.0), lambda s, r: s + rr(r))).drop("__first")


def rank_parent_pages(found: DataFrame, pages: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """The k best pages of each query with their 13 features, parent_score and rank.

    found(query_id, source, page_number, channel, rank) are the chunks of the channels, pages(source, page_number, content) the whole pages,
    questions(query_id, question) financial questions. A page without text, or without a row, scores by its ranks and source alone;
    repeated page rows count once. Order: score, source, page, which are unique.
    """
    q = questions.select("query_id", terms_of(F.col("question")).alias("q_terms"), asked.financial_intent(F.col("question")).alias("intent"))  # once a question, not once a page found
    text = pages.groupBy("source", "page_number").agg(F.min("content").alias("content"))
    rows = parent_evidence(found).join(text, ["source", "page_number"], "left").join(q, "query_id")
    content, source, i = F.coalesce("content", F.lit("")), F.coalesce("source", F.lit("")), F.col("intent")
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    terms = expected_statements(i)
    rows = rows.withColumns(
        {
            "parent_lexical_score": overlap_of(F.col("q_terms"), content), "metric_alias_score": flag(named_in(metric_names(i), content)), "statement_score": flag(named_in(terms, content)), "exact_statement_score": flag(content.contains(F.get(terms, F.lit(0)))),
            "scope_score": flag((F.size(i["scopes"]) == 0) | named_in(i["scopes"], content)), "year_score": flag(named_in(i["years"], content)), "noise_score": flag(asked.contains_any(content, NOISE)), "company_source_score": flag((F.size(i["company_terms"]) == 0) | named_in(i["company_terms"], source)),
        }
    )
    scored = rows.withColumn("parent_score", rounded(reduce(lambda a, f: a + WEIGHTS[f] * F.col(f), WEIGHTS, F.lit(0.0)), 8)).withColumns({f: rounded(F.col(f), 8) for f in WEIGHTS})
    return top_by(scored, ["query_id"], [F.desc("parent_score"), F.col("source"), F.col("page_number")], k).select("query_id", "source", "page_number", *WEIGHTS, "parent_score", "rank")
