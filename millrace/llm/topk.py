"""Exact top-k inner product search, score at a time over impact-ordered postings.

Vectors become integers, floor(scale * x). Candidates are dealt into blocks; a block's index
has, for each dimension, its rows ordered by value, cut into segments of equal value. For a
query every segment has one impact (query value times segment value, less the dimension's
smallest, so impacts are never negative). Segments are taken by descending impact; after
each slab the rows' partial scores are lower bounds, and partial score plus, for each dimension not seen yet, the last impact (or the dimension's
largest, where that is less) is an upper bound. The rows that look best so far are scored
exactly: the k-th of them is a score to beat. Processing stops only when few rows can
still beat it; those are scored again exactly. Candidate blocks meet a few query blocks in a
task of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stash


#: Over any sum of impacts; SEEN times the number of dimensions stays exact in a double.
SEEN = float(1 << 40)


class Block:
    """Impact-ordered postings of a block of integer vectors."""

    def __init__(self, v: np.ndarray):
        self.whole, self.v, (n, dims) = v.astype(np.int64), v.astype(float), v.shape
        order = np.argsort(v, axis=0, kind="stable")
        by_dim = np.take_along_axis(v, order, 0).T.ravel()
        self.rows = np.ascontiguousarray(order.T).ravel()
        new = np.ones(n * dims, bool)
        new[1:] = by_dim[1:] != by_dim[:-1]
        new[::n] = True
        self.start = np.flatnonzero(new)
        self.size = np.diff(np.append(self.start, n * dims))
        self.value, self.dim = by_dim[self.start].astype(np.int64), self.start // n
        self.first = np.searchsorted(self.dim, np.arange(dims))
        self.last = np.append(self.first[1:], len(self.dim)) - 1

    def search(self, q: np.ndarray, k: int) -> np.ndarray:
        """Rows that may be among the k best for q, ties included: all that can't be ruled out."""
        n, dims = self.v.shape
        if n <= 4 * k or int(np.abs(q).max(initial=0)) * int(np.abs(self.value).max(initial=0)) * 2 * dims >= SEEN or dims >= 1 << 12:
            return np.arange(n)
        impact = (q[self.dim] * self.value).astype(float)
        impact -= np.minimum(impact[self.first], impact[self.last])[self.dim]
        order = np.argsort(-impact)
        done = np.cumsum(self.size[order])
        most = np.maximum(impact[self.first], impact[self.last])
        least_sum = np.minimum(q * self.value[self.first], q * self.value[self.last]).sum()
        acc, had, to_beat, q = np.zeros(n), np.zeros(dims, np.int64), -np.inf, q.astype(float)
        for share in (0.45, 0.6, 0.72, 0.85):
            to = int(np.searchsorted(done, share * done[-1]))
            if to >= len(order):
                break
            rest = impact[order[to]]
            # a dimension's segments above the bound lie at one end of its row order
            upto = np.add.reduceat((impact > rest).astype(np.int64), self.first)
            segs, rows = [], []
            for d in np.flatnonzero(upto > had).tolist():
                lo, hi = (self.last[d] - upto[d] + 1, self.last[d] - had[d] + 1) if q[d] > 0 else (self.first[d] + had[d], self.first[d] + upto[d])
                segs.append(np.arange(lo, hi))
                rows.append(self.rows[self.start[lo] : self.start[hi - 1] + self.size[hi - 1]])
            had = upto
            if segs:  # dimensions seen are counted in the same sum, far above any score
                seg = np.concatenate(segs)
                acc += np.bincount(np.concatenate(rows), np.repeat(impact[seg] + SEEN, self.size[seg]), n)
            seen = np.floor(acc / SEEN)
            none = upto == 0  # of these dimensions no row has been seen
            least, open_ = acc - seen * SEEN, rest * (dims - none.sum() - seen) + most[none].sum()
            likely = np.argpartition(least + open_ / 2, n - 2 * k)[n - 2 * k :]
            to_beat = max(to_beat, np.partition(self.v[likely] @ q, k)[k] - least_sum)
            may = np.flatnonzero(least + open_ >= to_beat)
            if len(may) <= max(4 * k, n // 8):
                return may
        return np.arange(n)

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact scores: in doubles where no sum can leave their whole numbers, else in longs."""
        if int(np.abs(q).max(initial=0)) * int(np.abs(self.value).max(initial=0)) * self.v.shape[1] < 1 << 53:
            return (self.v[rows] @ q.astype(float)).astype(np.int64)
        return self.whole[rows] @ q


def _packed(pdf: pd.DataFrame) -> dict:
    v = np.array(pdf["v"].tolist(), np.int64)
    return {"ids": pdf["vec_id"].to_numpy(np.int64).tobytes(), "uids": pdf["uid"].to_numpy(np.int64).tobytes(), "mat": v.astype(np.min_scalar_type(-int(np.abs(v).max(initial=0)) - 1)).tobytes(), "n": len(v)}


def _unpack(ids: bytes, uids: bytes, mat: bytes, n: int):
    size = len(mat) // n
    return np.frombuffer(ids, np.int64), np.frombuffer(uids, np.int64), mat, n, size


def integer_vectors(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, uid (a number of the row) and v; rows null, or with null or non-finite components, or without vec_id, are left out."""
    e = F.col("embedding")
    inf = F.lit(float("inf"))
    ok = F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (x != inf) & (x != -inf))
    return vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("uid"), F.transform(e, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))


def top_k(vectors: DataFrame, k: int = 20, query_every: int = 20, scale: int = 64, block: int = 8192, query_block: int = 512, per_task: int = 4) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for rows whose vec_id is divisible by query_every.

    Ties go to the smaller vec_id. Repeated rows are rows of their own (as queries and as
    candidates). Vectors of unlike length are compared as if the shorter went on with zeros.
    """
    rows = stash(integer_vectors(vectors, scale), "vectors")
    n, dims = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("v"))))
    blocks, parts = max(1, -(-n // block)), max(1, -(-n // (query_every * query_block)))

    def packing(name):
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["vec_id", "uid"])
            return pd.DataFrame([{name: key[0]} | {f"{name}_{c}": x for c, x in _packed(pdf).items()}])

        return run

    def deal(df, name, count):
        return df.withColumn(name, F.pmod(F.xxhash64("uid"), F.lit(count))).groupBy(name).applyInPandas(packing(name), f"{name} long, {name}_ids binary, {name}_uids binary, {name}_mat binary, {name}_n long")

    lanes = -(-parts // per_task)
    candidates = deal(rows, "c", blocks)
    queries = deal(rows.where(F.col("vec_id") % query_every == 0), "q", parts).withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).withColumn("lane", (F.col("q") % lanes).cast("int"))

    def matrix(mat: bytes, n: int) -> np.ndarray:
        kind = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}[len(mat) // (n * dims)]
        return np.frombuffer(mat, kind).reshape(n, dims)

    def run(batches):
        kept = None
        for pdf in batches:
            for r in pdf.itertuples():
                if kept is None or kept[0] != r.c:
                    kept = (r.c, Block(matrix(r.c_mat, r.c_n)), np.frombuffer(r.c_ids, np.int64), np.frombuffer(r.c_uids, np.int64))
                _, index, ids, uids = kept
                found = []
                for qid, quid, q in zip(np.frombuffer(r.q_ids, np.int64).tolist(), np.frombuffer(r.q_uids, np.int64).tolist(), matrix(r.q_mat, r.q_n).astype(np.int64)):
                    may = index.search(q, k + 1)
                    may = may[uids[may] != quid]
                    score = index.scores(may, q)
                    best = np.lexsort((uids[may], ids[may], -score))[:k]
                    found.append((np.full(len(best), quid), np.full(len(best), qid), ids[may][best], uids[may][best], score[best]))
                yield pd.DataFrame(dict(zip(("quid", "query_id", "vec_id", "uid", "score"), map(np.concatenate, zip(*found)))))

    # a block and a few query blocks to a task: explicit counts of partitions are not merged again
    tasks = blocks * lanes
    pairs = queries.repartition(tasks, "c", "lane").join(candidates.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).repartition(tasks, "c", "lane"), ["c", "lane"])
    found = pairs.mapInPandas(run, "quid long, query_id long, vec_id long, uid long, score long")
    w = Window.partitionBy("quid").orderBy(F.desc("score"), "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return top_k(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
