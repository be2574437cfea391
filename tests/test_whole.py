"""Queries whose work follows their whole tables."""

from millrace.plans import registry

SF = "/root/testdata/sf0.001"


def ids(spark, name, *cols, sf=SF):
    return {tuple(r) for r in registry.queries()[name](spark, sf).select(*cols).collect()}


def test_sql_is_text():
    import __spark_entry__

    assert all(isinstance(x, str) for x in __spark_entry__.oracle_sql().values())


def test_fingerprint_gathers_no_arrays(spark):
    plan = registry.queries()["a26_corpus_fingerprint"](spark, SF)._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def test_customers_with_any_order_are_no_orphans(spark):
    placed = {r[0] for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_custkey").collect()}
    assert not {c for (c,) in ids(spark, "j04_orphans", "c_custkey")} & placed


def test_query_set_grows_with_the_vectors(spark):
    every = {r[0] for r in spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id is not null and embedding is not null").select("vec_id").collect()}
    assert {q for (q,) in ids(spark, "j12_dense_knn", "query_id")} == {v for v in every if v % 50 == 0}


def test_every_case_pair_and_job_is_read(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert sum(r["n"] for r in registry.queries()["j14_coverage_category"](spark, SF).collect()) == n
    assert ids(spark, "x03_numeric_score", "query_id", "chunk_id") == ids(spark, "j11_lexical_join", "query_id", "chunk_id")
    assert any(i % 3 == 2 for (i,) in ids(spark, "o03_idempotent_enqueue", "id", sf="/root/testdata/sf0.01"))


def test_context_is_found_without_shrinking_frames(spark):
    """the frame behind each row was read anew for every row."""
    plan = registry.queries()["w10_nearest_context"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedfollowing" not in plan.lower() and plan.count("Window [") >= 2
