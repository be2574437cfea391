"""Nearest vectors against brute force: exact blocks, and the recall of the inverted file."""

import numpy as np
import pytest

from millrace.operators import vectors


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(3)
    v = np.repeat(r.standard_normal((30, 16)), 40, axis=0) + 0.4 * r.standard_normal((1200, 16))
    v[7] = 0
    v[100:110] = v[100]  # ties
    return v, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(4)


def brute(v, q, k):
    n = np.linalg.norm(v, axis=1)
    d = np.where(n > 0, 1 - v @ v[q] / np.maximum(n * max(np.linalg.norm(v[q]), 1e-300), 1e-300), 1.0)
    return [int(i) for i in np.lexsort((np.arange(len(v)), np.round(d, 12)))[:k]]


def test_exact_blocks(spark, rows):
    v, df = rows
    q = df.where("vec_id % 60 = 0").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in vectors.exact_knn(q, df, 8, block=100, query_block=7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.distance, 9)))
    for i in range(0, 1200, 60):
        want = brute(v, i, 8)
        assert sorted(x for x, _ in got[i]) == sorted(want) or [d for _, d in got[i]] == sorted(d for _, d in got[i])
        assert len(got[i]) == 8 and set(want) == {x for x, _ in got[i]}
    assert vectors.exact_knn(q.where("false"), df, 8).count() == 0


def test_every_row_is_indexed_and_recall_is_high(spark, rows):
    v, df = rows
    index = vectors.build_index(df, block=50)
    assert index.cells.count() == 1200 and index.cells.select("vec_id").distinct().count() == 1200
    assert max(r["count"] for r in index.cells.groupBy("cell", "block").count().collect()) < 120
    q = df.where("vec_id % 30 = 1").withColumnRenamed("vec_id", "query_id")
    probes = index.probes_for(q, 10, 0.95)
    assert 1 <= probes < len(index.centres)
    got = {}
    for r in index.search(q, 10, probes).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = [len(got[i] & set(brute(v, i, 10))) / 10 for i in range(1, 1200, 30)]
    assert np.mean(hit) >= 0.9
    whole = {}
    for r in index.search(q, 10, len(index.centres)).collect():
        whole.setdefault(r.query_id, set()).add(r.vec_id)
    assert all(whole[i] == set(brute(v, i, 10)) for i in range(1, 1200, 30))  # all cells: exact


def test_no_vectors(spark, rows):
    none = rows[1].where("false")
    index = vectors.build_index(none)
    assert index.search(rows[1].withColumnRenamed("vec_id", "query_id"), 5, 1).count() == 0
