"""Best chunks by shared terms against scoring all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.operators import lexical, retrieval
from millrace.operators.metrics import rounded
from millrace.plans import registry
from millrace.streaming.jobs import shared_folder

Q, C = "query_id long, content string", "chunk_id long, content string"


def all_pairs(q, c, k, measure):
    pairs = retrieval.lexical_join(q, c)
    if measure is lexical.LEXICAL:
        scored = pairs.withColumn("score", F.col("lexical_score"))
    else:
        size = retrieval.term_index(c, "chunk_id", "content").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"))
        scored = pairs.join(size, "chunk_id").withColumn("score", rounded(F.col("n_matched") / F.col("n"), 6))
    return rows(retrieval.top_by(scored, ["query_id"], [F.desc("score"), F.col("chunk_id")], k))


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "chunk_id", "score").collect())


def found(spark, q, c, k, measure, spread=4):
    return rows(lexical.search(q, lexical.build(c, shared_folder(spark, "lexical")), k, measure, spread))


@pytest.mark.parametrize("measure", [lexical.LEXICAL, lexical.OVERLAP], ids=["lexical", "overlap"])
@pytest.mark.parametrize("k,spread", [(1, 1), (5, 4), (40, 1)])
def test_equal_to_all_pairs(spark, measure, k, spread):
    rnd = random.Random(k)
    words = [f"w{i}" * (1 + i % 3) for i in range(60)]
    pick = lambda n: " ".join(words[min(59, int(rnd.expovariate(0.12)))] for _ in range(n))
    c = spark.createDataFrame([(i, pick(rnd.choice([1, 3, 10, 80]))) for i in range(500)], C).repartition(3)
    q = spark.createDataFrame([(i, pick(rnd.choice([1, 2, 6, 20]))) for i in range(40)], Q)
    assert found(spark, q, c, k, measure, spread) == all_pairs(q, c, k, measure)


@pytest.mark.parametrize("measure", [lexical.LEXICAL, lexical.OVERLAP], ids=["lexical", "overlap"])
def test_copies_nulls_and_unknown_terms(spark, measure):
    c = spark.createDataFrame([(i, "same words here") for i in range(300)] + [(900, None), (901, ""), (902, "here alone"), (903, "中文字符")], C)
    q = spark.createDataFrame([(1, "same words here"), (2, "absent"), (3, None), (4, ""), (5, "here"), (6, "文字")], Q)
    got = found(spark, q, c, 7, measure)
    assert got == all_pairs(q, c, 7, measure)
    assert {r[0] for r in got} == {1, 5, 6} and [r[2] for r in got if r[0] == 1] == list(range(7))


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], C), spark.createDataFrame([(1, "a word")], Q)
    assert found(spark, one, none, 3, lexical.LEXICAL) == []
    assert found(spark, one.where("false"), spark.createDataFrame([(1, "a word")], C), 3, lexical.OVERLAP) == []


def test_frequent_terms_are_not_looked_up(spark):
    """A query of a rare term and one that all chunks have looks at the rare term's chunks alone, once the floor is known."""
    c = spark.createDataFrame([(i, "common rarest" if i % 100 == 0 else "common") for i in range(2000)], C)
    q = spark.createDataFrame([(1, "common rarest")], Q)
    index = lexical.build(c, shared_folder(spark, "lexical"))
    assert [r[2] for r in rows(lexical.search(q, index, 5))] == [0, 100, 200, 300, 400]
    assert [r.term for r in lexical.lookups(*lexical.sides(q, index, lexical.LEXICAL), 5, lexical.LEXICAL, 4).collect()] == ["rarest"]


@pytest.mark.parametrize("lot", [4096, 7])
def test_best_of_two_measures_in_one_pass(spark, lot):
    rnd = random.Random(lot)
    words = [f"w{i}" * (1 + i % 3) for i in range(60)] + ["中文字符", "红色"]
    pick = lambda n: " ".join(words[min(61, int(rnd.expovariate(0.1)))] for _ in range(n))
    texts = [pick(rnd.choice([1, 3, 10, 80])) for _ in range(400)] + ["same words here"] * 300 + [None, "", "w1"]
    c = spark.createDataFrame([(7 * i % 1009, t) for i, t in enumerate(texts)], C).repartition(3)
    q = spark.createDataFrame([(i, pick(rnd.choice([1, 2, 6, 20]))) for i in range(40)] + [(50, "same words here"), (51, "absent"), (52, None), (53, "")], Q)
    got = lexical.best(q, c, shared_folder(spark, "best"), {"a": (lexical.LEXICAL, 6), "b": (lexical.OVERLAP, 41)}, lot)
    assert rows(got["a"]) == all_pairs(q, c, 6, lexical.LEXICAL) and rows(got["b"]) == all_pairs(q, c, 41, lexical.OVERLAP)
    none = lexical.best(q.where("false"), c, shared_folder(spark, "best"), {"a": (lexical.LEXICAL, 6)})["a"]
    assert none.count() == 0 and lexical.best(q, c.where("false"), shared_folder(spark, "best"), {"a": (lexical.LEXICAL, 6)})["a"].count() == 0


@pytest.mark.parametrize("name", ["a09_weighted_rrf", "a11_failure_stages", "t06_channel_topk_dense", "w06_citation_ledger"])
def test_the_driver_plans_few_steps(spark, name):
    """F5 to F12 and F14 to F24: plans of some 90 exchanges took the driver's memory."""
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") <= 6 and plan.count("Aggregate") <= 12


def test_contents_are_hashed_before_they_are_dealt(spark):
    """whole texts went through two windows for their hashes."""
    plan = registry.queries()["w06_citation_ledger"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    below = plan[max(i for i, x in enumerate(plan) if re.match(r"\W*Window.*__i#", x)) + 1]
    assert not re.search(r"[\[ ]content#\d+[,\]]", below), below
