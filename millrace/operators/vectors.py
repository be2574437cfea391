"""Nearest vectors by cosine distance: exact over all pairs of blocks, or over an inverted file of cells.

Vectors and queries are packed into matrices by the executors and meet in an equi-join of blocks, so neither the
driver nor a broadcast holds any. The inverted file's centres are fitted on a bounded sample; every row is indexed, and how
many cells a query must visit is measured against exact answers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieval import top_by

_PAIRS = "query_id long, vec_id long, distance double"


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _packed(rows: DataFrame, keys: list[str], id_column: str, prefix: str) -> DataFrame:
    """One row per key: ids and vectors of a block as binaries, {prefix}_ids and {prefix}_mat."""
    out = [*keys, f"{prefix}_ids", f"{prefix}_mat"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, pdf[id_column].to_numpy(np.int64).tobytes(), np.array(pdf["embedding"].tolist(), float).tobytes()]], columns=out)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select(*keys, F.col(id_column).cast("long").alias(id_column), "embedding").groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{prefix}_ids binary", f"{prefix}_mat binary"]))


def _best(q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of queries, ids and distances of the k nearest of a block; ties to the smaller id, a zero vector counts 1.0."""
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    dist = np.where((norm > 0).T, 1 - _unit(q) @ (v / np.maximum(norm, 1e-300)).T, 1.0)
    who, found, far = [], [], []
    for i, d in enumerate(dist):
        near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
        near = near[np.lexsort((ids[near], d[near]))[:k]]
        who.append(np.full(len(near), i))
        found.append(ids[near])
        far.append(d[near])
    return np.concatenate(who), np.concatenate(found), np.concatenate(far)


def _joined(queries: DataFrame, candidates: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k nearest of every query over all pairs of blocks with equal keys."""

    def run(batches):
        for pdf in batches:
            for qi, qm, ci, cm in pdf[["q_ids", "q_mat", "c_ids", "c_mat"]].itertuples(index=False):
                qid, ids = np.frombuffer(qi, np.int64), np.frombuffer(ci, np.int64)
                who, found, far = _best(np.frombuffer(qm).reshape(len(qid), -1), ids, np.frombuffer(cm).reshape(len(ids), -1), k)
                yield pd.DataFrame({"query_id": qid[who], "vec_id": found, "distance": far})

    pairs = queries.join(candidates, keys).select("q_ids", "q_mat", "c_ids", "c_mat")
    return top_by(pairs.mapInPandas(run, _PAIRS), ["query_id"], [F.col("distance"), F.col("vec_id")], k)


def exact_knn(queries: DataFrame, vectors: DataFrame, k: int, block: int = 8192, query_block: int = 512) -> DataFrame:
    """(query_id, vec_id, distance, rank): the k nearest of all vectors. Every block of vectors meets every block of queries, a pair to a row; each keeps k rows a query."""
    n, m = vectors.count(), queries.count()
    parts, lots = max(1, -(-n // block)), max(1, -(-m // query_block))
    deal = lambda rows, c, of, name: rows.withColumn(name, F.pmod(F.xxhash64(c), F.lit(of)))
    q = _packed(deal(queries, "query_id", lots, "__lot"), ["__lot"], "query_id", "q").withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return _joined(q, _packed(deal(vectors, "vec_id", parts, "__block"), ["__block"], "vec_id", "c"), ["__block"], k)


def fit_centres(vectors: DataFrame, cells: int, sample: int = 20_000, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centres of spherical k-means on at most `sample` rows, those of smallest hash, which come to the driver."""
    rows = vectors.select(F.xxhash64(F.lit(seed), "vec_id").alias("h"), "vec_id", "embedding").orderBy("h", "vec_id").limit(sample)
    got = rows.collect()
    if not got:
        return np.zeros((0, 0))
    x = _unit(np.array([r.embedding for r in got], float))
    centres = x[np.random.default_rng(seed).permutation(len(x))[: min(cells, len(x))]]
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        alive = np.bincount(own, minlength=len(centres)) > 0
        centres = np.where(alive[:, None], _unit(sums), centres)
    return centres


@dataclass
class Index:
    """cells(cell, block, vec_id, embedding): every vector with its cell; a cell's rows are dealt into blocks of a bounded size."""

    cells: DataFrame
    centres: np.ndarray
    blocks: DataFrame

    def search(self, queries: DataFrame, k: int, probes: int, query_block: int = 512) -> DataFrame:
        """(query_id, vec_id, distance, rank) among the vectors of the `probes` cells nearest to each query."""
        if not len(self.centres):
            return queries.sparkSession.createDataFrame([], f"{_PAIRS}, rank int")
        near = nearest_cells(queries, "query_id", self.centres, probes)
        near = near.withColumn("__lot", F.pmod(F.xxhash64("query_id"), F.ceil(F.lit(queries.count()) / query_block)))
        dealt = near.join(self.blocks, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        return _joined(_packed(dealt, ["cell", "block", "__lot"], "query_id", "q"), _packed(self.cells, ["cell", "block"], "vec_id", "c"), ["cell", "block"], k)

    def probes_for(self, queries: DataFrame, k: int, recall: float = 0.95, most: int = 64) -> int:
        """How many cells to visit for this recall, measured against exact answers for at most `most` queries of smallest hash."""
        some = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(most)
        true = exact_knn(some, self.cells, k).select("query_id", "vec_id").join(self.cells.select("vec_id", "cell"), "vec_id").select("query_id", "cell").collect()
        rank: dict[tuple[int, int], int] = {}
        for r in some.select("query_id", "embedding").collect():
            for at, cell in enumerate(np.argsort(-(self.centres @ np.array(r.embedding, float)), kind="stable").tolist()):
                rank[r.query_id, cell] = at + 1
        needed = sorted(rank[r.query_id, r.cell] for r in true)
        return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)] if needed else 1


def nearest_cells(rows: DataFrame, id_column: str, centres: np.ndarray, probes: int) -> DataFrame:
    """Each row once for each of its `probes` nearest cells, with `cell`; ties to the smaller cell."""

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            score = _unit(np.array(pdf["embedding"].tolist(), float)) @ centres.T
            at = np.argsort(-score, axis=1, kind="stable")[:, :probes]
            yield pdf.loc[pdf.index.repeat(at.shape[1])].assign(cell=at.ravel().astype(np.int32))

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select(id_column, "embedding").mapInPandas(run, f"{id_column} {kinds[id_column]}, embedding {kinds['embedding']}, cell int")


def build_index(vectors: DataFrame, cells: int | None = None, sample: int = 20_000, block: int = 8192) -> Index:
    """An inverted file over vectors(vec_id, embedding), which hold no null or non-finite entry and have one length.

    cells: the square root of the number of rows where it is not given, at most 4,096. Equal vectors may fill a cell; its blocks keep tasks small all the same.
    """
    n = vectors.count()
    centres = fit_centres(vectors, cells or max(1, min(4096, int(n**0.5))), sample)
    if not len(centres):
        empty = vectors.sparkSession.createDataFrame([], "cell int, blocks int")
        return Index(vectors.select("vec_id", "embedding", F.lit(0).alias("cell"), F.lit(0).alias("block")), centres, empty)
    placed = nearest_cells(vectors, "vec_id", centres, 1)
    blocks = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    return Index(placed.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int")).drop("blocks"), centres, blocks)  # at most 4,096 rows are broadcast
