import re

from millrace.operators import parents
from millrace.plans import registry


def test_pages_by_their_chunks(spark):
    found = spark.createDataFrame([(1, "格力电器.pdf", 3, "dense", 1), (1, "格力电器.pdf", 3, "lexical", 4), (1, "格力电器.pdf", 3, "lexical", 2), (1, "格力电器.pdf", 3, "dense", 9), (1, "其他.pdf", 1, "lexical", 1), (1, None, 2, "dense", 2), (1, "格力电器.pdf", 3, "dense", 101), (2, "x", 1, "dense", 1)], "query_id long, source string, page_number long, channel string, rank int")
    pages = spark.createDataFrame([("格力电器.pdf", 3, "合并利润表 营业收入 2006 100"), ("格力电器.pdf", 3, "合并利润表 营业收入 2006 100"), ("其他.pdf", 1, None)], "source string, page_number long, content string")
    q = spark.createDataFrame([(1, "格力电器2006年合并的营业收入是多少"), (2, None)], "query_id long, question string")
    got = {(r.query_id, r.source): r for r in parents.rank_parent_pages(found, pages, q).collect()}
    best = got[1, "格力电器.pdf"]
    rr = [1 / 61, 1 / 62, 1 / 64]
    assert best["rank"] == 1 and best.child_evidence_count == 4 and abs(best.top3_child_rr - sum(rr)) < 1e-8 and abs(best.best_lexical_rr - 1 / 62) < 1e-8
    flags = ("metric_alias_score", "statement_score", "exact_statement_score", "scope_score", "year_score", "company_source_score")
    assert [best[f] for f in flags] == [1.0] * 6 and best.noise_score == 0
    assert [got[1, "其他.pdf"][f] for f in flags] == [0.0] * 6 and got[1, None].company_source_score == 0
    assert got[2, "x"].company_source_score == got[2, "x"].scope_score == 1.0 and got[2, "x"].parent_lexical_score == 0
    assert parents.rank_parent_pages(found.where("false"), pages, q).count() == 0


def test_terms_of_a_question_are_worked_out_once(spark):
    """they were worked out for every page found. One reading of CJK runs is left above the joins, that of the pages, in its few copies."""
    plan = registry.queries()["x09_rank_parent_page"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    first = next(i for i, x in enumerate(plan) if re.search(r"Join (Inner|LeftOuter)", x))
    assert not any("regexp_extract_all(lower(coalesce(question" in x for x in plan[:first])
