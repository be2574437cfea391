"""Lexical and vector retrieval for batches of queries, rank fusion and context selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import text

from .metrics import rounded


def term_index(rows: DataFrame, key: str, content: str) -> DataFrame:
    """(key, term), one row per distinct term of each text."""
    # the outer form: a plain explode gets a filter on the size of the array, which would work out all terms twice
    return rows.select(key, F.explode_outer(text.terms(F.col(content))).alias("term")).where("term is not null")


def lexical_join(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, lexical_score, n_matched) of pairs with a common term.

    An equi-join on terms: cost follows matching terms, not all pairs; a frequent term's
    partition can be split by the adaptive skew join. score = length of matched query terms over
    length of all of them, 4 digits.
    """
    q = term_index(queries, "query_id", "content")
    total = q.groupBy("query_id").agg(F.sum(F.length("term")).alias("total"))
    hits = q.join(term_index(chunks, "chunk_id", "content"), "term").groupBy("query_id", "chunk_id").agg(F.sum(F.length("term")).alias("matched"), F.count(F.lit(1)).alias("n_matched"))
    return hits.join(total, "query_id").select("query_id", "chunk_id", rounded(F.col("matched") / F.col("total"), 4).alias("lexical_score"), "n_matched")


def numeric_score(query: Column, content: Column) -> Column:
    return shared_numbers(text.numbers(query), text.numbers(content))


def shared_numbers(q: Column, content: Column) -> Column:
    """The share of a query's numbers that a chunk's numbers hold, 4 digits; 0 for a query without numbers."""
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(rounded(F.size(F.array_intersect(q, content)) / F.size(q), 4))


def vector_score(distance: Column) -> Column:
    return F.coalesce(rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance.cast("double"))), 4), F.lit(0.0))


def hybrid_score(vector: Column, lexical: Column, numeric: Column, lexical_weight: float = 0.35, numeric_weight: float = 0.15) -> Column:
    """Weighted sum; weights are clamped so that they add up to 1."""
    lw = max(0.0, min(1.0, lexical_weight))
    nw = max(0.0, min(1.0 - lw, numeric_weight))
    return rounded((1.0 - lw - nw) * vector + lw * lexical + nw * numeric, 4)


def top_by(rows: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def vector_validate(rows: DataFrame, dimension: int) -> DataFrame:
    """Each vector's fault: null, empty, another dimension, not finite, or none."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.withColumn("fault", F.when(e.isNull(), "null").when(F.size(e) == 0, "empty").when(F.size(e) != dimension, "dimension").when(bad, "not finite").otherwise("none"))


def dense_knn(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, distance, rank): cosine distance of the k nearest vectors, a zero norm counts 1.0; ties to the smaller vec_id."""
    from .vectors import exact_knn

    return exact_knn(queries, vectors, k)


def weighted_rrf(channels: dict[str, DataFrame], weights: dict[str, float], k: int = 60) -> DataFrame:
    """Sum over channels of weight / (k + rank) per (query_id, chunk_id), the best rank, and the channels it came from."""
    rows = None
    for name, c in channels.items():
        part = c.select("query_id", "chunk_id", F.col("rank"), (F.lit(float(weights.get(name, 0.0))) / (k + F.col("rank"))).alias("part"), F.lit(name).alias("channel"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("rrf"), F.min("rank").alias("best_rank"), F.array_join(F.sort_array(F.collect_set("channel")), ",").alias("channels"))


def channel_union(dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """Candidates of dense(query_id, chunk_id, rank, vector_score) and lexical(query_id, chunk_id, rank, lexical_score), once each with the fields of both; a rank is null and a score 0 where a channel lacks it."""
    both = dense.withColumnRenamed("rank", "dense_rank").join(lexical.withColumnRenamed("rank", "lexical_rank"), ["query_id", "chunk_id"], "full_outer")
    return both.select("query_id", "chunk_id", "dense_rank", F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"), "lexical_rank", F.coalesce("lexical_score", F.lit(0.0)).alias("lexical_score"))


def collapse(rows: DataFrame, provenance: Column, k: int) -> DataFrame:
    """The first row of each provenance in rank order, then ranks anew up to k."""
    first = top_by(rows.withColumn("__p", provenance), ["query_id", "__p"], [F.col("rank")], 1, "__n").drop("__n", "__p")
    return top_by(first.withColumnRenamed("rank", "__old"), ["query_id"], [F.col("__old")], k).drop("__old")


def citation_ledger(rows: DataFrame, identity: Column) -> DataFrame:
    """Distinct identities of a query numbered C1, C2, ... in rank order, with the hash of their content."""
    hashed = rows.withColumn("__i", identity).withColumn("content_sha256", F.sha2("content", 256))  # so that contents no one asks for are not shuffled
    first = top_by(hashed, ["query_id", "__i"], [F.col("rank")], 1, "__n").drop("__n", "__i")
    w = Window.partitionBy("query_id").orderBy("rank")
    return first.withColumn("citation_id", F.concat(F.lit("C"), F.row_number().over(w)))


def context_budget(ledger: DataFrame, item_chars: int = 6000, total_chars: int = 24000) -> DataFrame:
    """Items cut to item_chars, taken in rank order while the running size stays in the budget; sizes only grow, so the first overflow ends it."""
    cut = ledger.withColumn("content", F.substring("content", 1, item_chars))
    size = F.length("content") + F.length(F.coalesce(F.col("source"), F.lit(""))) + F.length("citation_id") + 64
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumn("running_size", F.sum(size).over(w)).where(F.col("running_size") <= total_chars)


def active_versions(chunks: DataFrame, active: DataFrame) -> DataFrame:
    """Chunks whose (doc_id, index_version) pair is active."""
    return chunks.join(active.select("doc_id", "index_version").distinct(), ["doc_id", "index_version"], "left_semi")
