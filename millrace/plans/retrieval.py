"""Queries on documents, passages and vectors, with their SQL."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import text
from millrace.operators import evaluate, lexical, pages, retrieval, vectors
from millrace.operators.metrics import rounded
from millrace.sources.facts import table
from millrace.streaming.jobs import shared_folder

#: Words of the invented prose that stand in for titles, metrics, units and periods.
TITLES, METRICS, UNITS, PERIODS = ("whtion", "license"), ("the", "der", "que"), ("of", "und", "la"), ("ion", "les")


def _queries(s, d):
    return table(s, d, "benchmark").where("item_id is not null").select(F.col("item_id").alias("query_id"), F.col("text").alias("content"))


def _chunks(s, d):
    return table(s, d, "documents").where("doc_id is not null").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), "source", "lang")


def _pages(s, d):
    w = Window.partitionBy("source").orderBy("doc_id")
    return table(s, d, "documents").select(F.col("source").alias("doc"), F.row_number().over(w).alias("page_number"), "text")


def term_index(s, d):
    t = retrieval.term_index(_chunks(s, d), "chunk_id", "content")
    return t.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n_terms"), F.sum(F.length("term")).alias("n_chars"))


def lexical_join(s, d):
    return retrieval.lexical_join(_queries(s, d), _chunks(s, d))


def _pairs(s, d):
    """Scored pairs with the numbers of both texts, for the features that need them."""
    q = _queries(s, d).select("query_id", text.numbers(F.col("content")).alias("q_numbers"))
    return retrieval.lexical_join(_queries(s, d), _chunks(s, d)).join(q, "query_id").join(_chunks(s, d).select("chunk_id", text.numbers(F.col("content")).alias("numbers")), "chunk_id")


def _channels(s, d):
    return lexical.best(_queries(s, d), _chunks(s, d), shared_folder(s, "best"), {"lexical": (lexical.LEXICAL, 50), "overlap": (lexical.OVERLAP, 30)})


_TERMS = """qt AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9_.%-]+'), lambda t: len(t) >= 2)) AS term FROM benchmark WHERE item_id IS NOT NULL),
ct AS (SELECT DISTINCT doc_id AS chunk_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9_.%-]+'), lambda t: len(t) >= 2)) AS term FROM documents WHERE doc_id IS NOT NULL)"""


def _r(x, n):
    return f"CAST(round(CAST({x} AS DECIMAL(38,10)), {n}) AS DOUBLE)"


_PAIRS = _TERMS + f""", tot AS (SELECT query_id, sum(len(term)) AS total FROM qt GROUP BY 1),
pairs AS (SELECT query_id, chunk_id, {_r('sum(len(term))::DOUBLE / any_value(total)', 4)} AS lexical_score, count(*) AS n_matched FROM qt JOIN ct USING (term) JOIN tot USING (query_id) GROUP BY 1, 2)"""
_CHANNELS = _PAIRS + f""", lex AS (SELECT *, lexical_score AS score, row_number() OVER (PARTITION BY query_id ORDER BY lexical_score DESC, chunk_id) AS rank FROM pairs QUALIFY rank <= 50),
sz AS (SELECT chunk_id, count(*) AS n_terms FROM ct GROUP BY 1), ov0 AS (SELECT pairs.*, {_r('n_matched::DOUBLE / n_terms', 6)} AS score FROM pairs JOIN sz USING (chunk_id)),
ov AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ov0 QUALIFY rank <= 30)"""
_FUSED = _CHANNELS + """, ch AS (SELECT query_id, chunk_id, rank, 0.6::DOUBLE / (60 + rank) AS part, 'lexical' AS channel FROM lex UNION ALL SELECT query_id, chunk_id, rank, 0.4::DOUBLE / (60 + rank), 'overlap' FROM ov),
fused0 AS (SELECT query_id, chunk_id, round(sum(part), 9) AS rrf, min(rank) AS best_rank, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels FROM ch GROUP BY 1, 2),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, best_rank, chunk_id) AS rank FROM fused0)"""


def _fused(s, d):
    f = retrieval.weighted_rrf(_channels(s, d), {"lexical": 0.6, "overlap": 0.4}).withColumn("rrf", F.round("rrf", 9))
    return retrieval.top_by(f, ["query_id"], [F.desc("rrf"), F.col("best_rank"), F.col("chunk_id")], 100)


def numeric_score(s, d):
    """Over every pair, however few words it shares."""
    return _pairs(s, d).select("query_id", "chunk_id", retrieval.shared_numbers(F.col("q_numbers"), F.col("numbers")).alias("numeric_score"))


def channel_topk(s, d):
    c = _channels(s, d)
    return c["lexical"].select("query_id", "chunk_id", "score", "rank", F.lit("lexical").alias("channel")).unionByName(c["overlap"].select("query_id", "chunk_id", "score", "rank", F.lit("overlap").alias("channel")))


def weighted_rrf(s, d):
    return _fused(s, d).select("query_id", "chunk_id", "rrf", "best_rank", "channels")


def hybrid_topk(s, d):
    p = _pairs(s, d)
    n, v = retrieval.shared_numbers(F.col("q_numbers"), F.col("numbers")), F.lit(0.5)
    score = p.select("query_id", "chunk_id", "lexical_score", n.alias("numeric_score")).withColumn("relevance", retrieval.hybrid_score(v, F.col("lexical_score"), F.col("numeric_score"))).where("relevance >= 0.05")
    return retrieval.top_by(score, ["query_id"], [F.desc("relevance"), F.desc("numeric_score"), F.desc("lexical_score"), F.col("chunk_id")], 5).select("query_id", "chunk_id", "relevance", "rank")


def collapse_provenance(s, d):
    rows = _fused(s, d).join(_chunks(s, d).select("chunk_id", "source"), "chunk_id")
    return retrieval.collapse(rows, F.col("source"), 5).select("query_id", "chunk_id", "source", "rank")


def dedupe_contexts(s, d):
    rows = _fused(s, d).join(_chunks(s, d), "chunk_id")
    return retrieval.collapse(rows, F.substring("content", 1, 120), 100).select("query_id", "chunk_id", "rank")


def _ledger(s, d):
    rows = _fused(s, d).join(_chunks(s, d), "chunk_id")
    return retrieval.citation_ledger(rows, F.sha2("content", 256))


def citation_ledger(s, d):
    return _ledger(s, d).select("query_id", "chunk_id", "citation_id", "content_sha256")


def context_budget(s, d):
    return retrieval.context_budget(_ledger(s, d)).select("query_id", "citation_id", F.col("running_size").cast("long").alias("running_size"))


def dense_knn(s, d):
    """With a query set that grows with the table: every vector whose id is divisible by 50."""
    v = table(s, d, "embeddings").where("vec_id is not null and embedding is not null")
    got = retrieval.dense_knn(v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v, 10)
    return got.select("query_id", "vec_id", retrieval.vector_score(F.col("distance")).alias("vector_score"), "rank")


def _dense_and_lexical(s, d):
    """50 nearest by vector and 50 best by words of each question; a question's vector, and a chunk's, is the one of its id."""
    v = table(s, d, "embeddings").where("vec_id is not null and embedding is not null").select("vec_id", "embedding")
    q = _queries(s, d)
    near = retrieval.dense_knn(v.join(q, v.vec_id == q.query_id, "left_semi").withColumnRenamed("vec_id", "query_id"), v, 50)
    dense = near.select("query_id", F.col("vec_id").alias("chunk_id"), "rank", retrieval.vector_score(F.col("distance")).alias("vector_score"))
    words = lexical.best(q, _chunks(s, d), shared_folder(s, "best"), {"lexical": (lexical.LEXICAL, 50)})
    return dense, words["lexical"].withColumnRenamed("score", "lexical_score")


def channel_union(s, d):
    return retrieval.channel_union(*_dense_and_lexical(s, d))


def channel_topk_dense(s, d):
    dense, words = _dense_and_lexical(s, d)
    one = lambda rows, score, name: rows.select("query_id", "chunk_id", F.col(score).alias("score"), "rank", F.lit(name).alias("channel"))
    return one(dense, "vector_score", "dense").unionByName(one(words, "lexical_score", "lexical"))


def weighted_rrf_dense(s, d):
    dense, words = _dense_and_lexical(s, d)
    f = retrieval.weighted_rrf({"dense": dense, "lexical": words}, {"dense": 0.6, "lexical": 0.4}).withColumn("rrf", F.round("rrf", 9))
    return retrieval.top_by(f, ["query_id"], [F.desc("rrf"), F.col("best_rank"), F.col("chunk_id")], 100).select("query_id", "chunk_id", "rrf", "best_rank", "channels")


def ivf_knn(s, d):
    """The same queries through an inverted file that visits as many cells as a recall of 0.95 takes."""
    v = table(s, d, "embeddings").where("vec_id is not null and embedding is not null").select("vec_id", "embedding")
    q = v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    index = vectors.build_index(v)
    got = index.search(q, 10, index.probes_for(q, 10))
    return got.select("query_id", "vec_id", retrieval.vector_score(F.col("distance")).alias("vector_score"), "rank")


def vector_validate(s, d):
    return retrieval.vector_validate(table(s, d, "embeddings"), 64).groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


def active_version_filter(s, d):
    c = table(s, d, "documents").select("doc_id", F.concat(F.lit("v"), F.col("doc_id") % 3).alias("index_version"))
    active = c.where("doc_id % 2 = 0").select("doc_id", F.lit("v1").alias("index_version"))
    return retrieval.active_versions(c, active)


def content_split(s, d):
    kind = F.when(F.col("doc_id") % 5 == 0, "table").when(F.col("doc_id") % 5 == 1, None).otherwise("text")
    c = table(s, d, "documents").select("doc_id", kind.alias("content_type"))
    table_rows = c.where(F.col("content_type").eqNullSafe("table")).withColumn("channel", F.lit("table"))
    return table_rows.unionByName(c.where(~F.col("content_type").eqNullSafe("table")).withColumn("channel", F.lit("text"))).groupBy("channel").agg(F.count(F.lit(1)).alias("n"))


def _features(s, d):
    return pages.page_features(_pages(s, d), TITLES, METRICS, UNITS, PERIODS)


def page_features(s, d):
    j = lambda c: F.array_join(c, ",").alias(c)
    return _features(s, d).select("doc", "page_number", F.col("text_chars").cast("long").alias("text_chars"), F.col("digit_chars").cast("long").alias("digit_chars"), "numeric_ratio", F.col("line_count").cast("long").alias("line_count"), j("title_hits"), j("metric_hits"), j("unit_hits"), j("period_hits"), j("year_hits"), "empty_text", "low_text")


def page_classify(s, d):
    return pages.page_classify(_features(s, d)).select("doc", "page_number", F.array_join("reasons", ",").alias("reasons"))


def title_neighbors(s, d):
    return pages.title_neighbors(pages.page_classify(_features(s, d))).select("doc", "page_number", "near_title")


def page_cap(s, d):
    return pages.page_cap(pages.title_neighbors(pages.page_classify(_features(s, d))), 10).select("doc", "page_number", "position", "dropped_by_cap")


def page_inventory(s, d):
    return pages.page_inventory(_pages(s, d))


def candidate_id(s, d):
    c = table(s, d, "documents")
    return c.select("doc_id", text.candidate_id(source=F.col("source"), doc_id=F.col("doc_id"), chunk_index=F.lit(0), content_type=F.lit("text"), provenance_id=F.lit(None).cast("string"), content_sha256=F.sha2(F.coalesce("text", F.lit("")), 256)).alias("candidate_id"))


def version_ids(s, d):
    return table(s, d, "documents").select("doc_id", text.sha_key(F.lit("index"), F.col("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256)).alias("index_version"))


def serialize_context(s, d):
    return table(s, d, "documents").select("doc_id", "source", F.substring("text", 1, 2000).alias("content"), F.substring("text", 1, 300).alias("snippet"))


def embedding_cache_lookup(s, d):
    docs = table(s, d, "documents")
    texts = docs.where("text is not null").select(F.sha2("text", 256).alias("k")).distinct()
    cache = docs.where("doc_id % 3 = 0 and text is not null").select(F.sha2("text", 256).alias("k"), F.lit(True).alias("hit")).distinct()
    return texts.join(cache, "k", "left").agg(F.count(F.lit(1)).alias("texts"), F.count("hit").alias("hits"), F.count(F.when(F.col("hit").isNull(), 1)).alias("missing"))


def index_upsert(s, d):
    docs = table(s, d, "documents")
    old = docs.select("doc_id", F.lit("v1").alias("index_version"), F.col("n_chars").alias("size"))
    new = docs.where("doc_id % 4 = 0").select("doc_id", F.lit("v1").alias("index_version"), (F.col("n_chars") + 1).alias("size"))
    return old.join(new.select("doc_id", "index_version").distinct(), ["doc_id", "index_version"], "left_anti").unionByName(new).groupBy("index_version").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))


def layer_identity(s, d):
    a = table(s, d, "documents").select("doc_id", "source", "n_chars")
    b = a.withColumn("n_chars", F.when(F.col("doc_id") % 97 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return a.exceptAll(b).withColumn("side", F.lit("only_first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("only_second")))


def stale_versions(s, d):
    docs = table(s, d, "documents")
    indexed = docs.select("doc_id", F.concat(F.lit("v"), F.col("doc_id") % 5).alias("index_version"))
    known = docs.where("doc_id % 7 <> 0").select("doc_id")
    protected = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("v"), F.col("doc_id") % 5)).otherwise("v0").alias("index_version"))
    return indexed.join(known, "doc_id", "left_semi").join(protected, ["doc_id", "index_version"], "left_anti")


def corpus_fingerprint(s, d):
    row = table(s, d, "documents").select("source", "doc_id", F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "lang", F.coalesce("text", F.lit(""))), 256).alias("h"))

    # the hashes of a source go through one SHA-256 in order; only its state is held
    def run(batches):
        source, state = None, None
        for b in batches:
            for x, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if state is None or x != source:
                    if state is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([source], pa.string()), pa.array([state.hexdigest()])], ["source", "h"])
                    source, state = x, hashlib.sha256()
                state.update(h.encode())
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([source], pa.string()), pa.array([state.hexdigest()])], ["source", "h"])

    return row.repartition("source").sortWithinPartitions("source", "doc_id", "h").select("source", "h").mapInArrow(run, "source string, h string")


def strict_hits(s, d):
    return _hits(s, d).where("hit").select("query_id", "chunk_id", "rank")


def _hits(s, d):
    q = _queries(s, d).withColumnRenamed("content", "question")
    rows = _fused(s, d).join(_chunks(s, d).select("chunk_id", "content"), "chunk_id").join(q, "query_id")
    return rows.select("query_id", "chunk_id", "rank", F.lower("content").contains(F.lower("question")).alias("hit"))


def _per_query(s, d):
    q = _queries(s, d).select("query_id")
    return q.join(evaluate.first_hit_rank(_hits(s, d), F.col("hit")), "query_id", "left")


def first_hit_rank(s, d):
    return _per_query(s, d)


def recall_mrr(s, d):
    return evaluate.recall_mrr(_per_query(s, d))


def failure_stages(s, d):
    return evaluate.failure_stages(_per_query(s, d).withColumn("in_corpus", F.col("query_id") % 2 == 0).withColumn("in_union", F.col("query_id") % 3 != 0))


def subset_metrics(s, d):
    rows = _per_query(s, d).withColumn("subset", F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd"))
    both = rows.unionByName(rows.withColumn("subset", F.lit("overall")))
    return both.groupBy("subset").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("hit_rank") <= 5, 1)).alias("hits"), rounded(F.coalesce(F.sum(1 / F.col("hit_rank")), F.lit(0.0)) / F.count(F.lit(1)), 6).alias("mrr"))


def release_gate(s, d):
    m = evaluate.recall_mrr(_per_query(s, d)).select(F.explode(F.create_map(F.lit("recall_at_5"), "recall_at_5", F.lit("mrr"), "mrr")).alias("metric", "value"))
    t = s.createDataFrame([("recall_at_5", ">=", 0.3), ("mrr", ">=", 0.9), ("coverage", ">=", 0.5)], "metric string, op string, bound double")
    return evaluate.release_gate(m, t)


def percentile(s, d):
    return table(s, d, "documents").groupBy("lang").agg(evaluate.nearest_rank_percentile("n_chars", 0.5).alias("p50"), evaluate.nearest_rank_percentile("n_chars", 0.95).alias("p95"))


def reason_histogram(s, d):
    errors = F.array_compact(F.array(F.when(F.col("n_chars") < 200, "short"), F.when(F.col("n_chars") > 10000, "long")))
    return evaluate.reason_histogram(table(s, d, "documents").select(errors.alias("errors"), F.concat(F.lit("ok_"), "lang").alias("status")), "errors", "status")


def token_cost(s, d):
    runs = table(s, d, "conversations").select(F.col("role").alias("profile"), F.length("text").alias("input_tokens"), F.when((F.col("role") != "system") | (F.col("turn") > 0), F.col("turn")).alias("output_tokens"))
    return evaluate.token_cost(runs, "1.5", "2.25")


def load_summary(s, d):
    e = table(s, d, "events").where("value is not null")
    return evaluate.load_summary(e.select(F.col("event_type").alias("name"), F.round(F.col("value") * 10).cast("long").alias("latency_ms"), (F.col("event_type") == "error").alias("failed")))


def dataset_profile(s, d):
    return table(s, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_ids"))


def fact_conflicts(s, d):
    return evaluate.fact_conflicts(table(s, d, "lineitem"), ["l_partkey", "l_suppkey"], ["l_returnflag", "l_linestatus"])


QUERIES = {
    "x01_term_index": term_index, "j11_lexical_join": lexical_join, "x03_numeric_score": numeric_score, "t06_channel_topk": channel_topk, "a09_weighted_rrf": weighted_rrf, "t04_hybrid_topk": hybrid_topk, "w04_collapse_provenance": collapse_provenance,
    "w05_dedupe_contexts": dedupe_contexts, "w06_citation_ledger": citation_ledger, "w07_context_budget": context_budget, "j12_dense_knn": dense_knn, "j12_ivf_knn": ivf_knn, "u02_channel_union": channel_union, "t06_channel_topk_dense": channel_topk_dense, "a09_weighted_rrf_dense": weighted_rrf_dense, "p14_vector_validate": vector_validate, "p11_active_version_filter": active_version_filter, "p12_content_split": content_split,
    "x16_page_features": page_features, "x17_page_classify": page_classify, "w08_title_neighbors": title_neighbors, "w09_page_cap": page_cap, "a20_page_inventory": page_inventory, "x27_candidate_id": candidate_id, "x28_version_ids": version_ids, "p09_serialize_context": serialize_context,
    "s16_embedding_cache_lookup": embedding_cache_lookup, "s17_index_upsert": index_upsert, "j19_layer_identity": layer_identity, "j17_stale_versions": stale_versions, "a26_corpus_fingerprint": corpus_fingerprint, "j13_strict_hit_join": strict_hits, "w15_first_hit_rank": first_hit_rank,
    "a10_recall_mrr": recall_mrr, "a11_failure_stages": failure_stages, "a13_subset_metrics": subset_metrics, "a31_release_gate": release_gate, "a15_nearest_rank_percentile": percentile, "a16_reason_histogram": reason_histogram, "a17_token_cost": token_cost, "a25_load_summary": load_summary, "a27_dataset_profile": dataset_profile, "a30_fact_conflicts": fact_conflicts,
}

_NUMS = r"list_distinct(list_transform(regexp_extract_all({0}, '[-+]?[0-9][0-9,]*(?:\.[0-9]+)?%?'), lambda x: replace(x, ',', '')))"
_NSCORE = f"CASE WHEN len({_NUMS.format('q.text')}) = 0 THEN 0.0::DOUBLE ELSE {_r('len(list_intersect(' + _NUMS.format('q.text') + ', ' + _NUMS.format('c.text') + '))::DOUBLE / len(' + _NUMS.format('q.text') + ')', 4)} END"
_HITS = _FUSED + """, hits AS (SELECT query_id, chunk_id, rank, contains(lower(c.text), lower(q.text)) AS hit FROM fused JOIN documents c ON chunk_id = doc_id JOIN benchmark q ON query_id = item_id WHERE rank <= 100),
pq AS (SELECT item_id AS query_id, (SELECT min(rank) FROM hits WHERE hit AND hits.query_id = item_id) AS hit_rank FROM benchmark WHERE item_id IS NOT NULL)"""
_MRR = _r("coalesce(sum(1.0::DOUBLE / hit_rank), 0.0::DOUBLE) / count(*)", 6)
_PG = f"""pg AS (SELECT source AS doc, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_number, text, regexp_replace(text, '\\s+', '', 'g') AS c FROM documents),
f AS (SELECT *, len(c) AS text_chars, len(regexp_replace(c, '[^0-9]', '', 'g')) AS digit_chars, {_r("len(regexp_replace(c, '[^0-9]', '', 'g'))::DOUBLE / greatest(len(c), 1)", 6)} AS numeric_ratio, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS line_count,
  list_filter({list(TITLES)}, lambda t: contains(lower(text), t)) AS title_hits, list_filter({list(METRICS)}, lambda t: contains(lower(text), t)) AS metric_hits, list_filter({list(UNITS)}, lambda t: contains(lower(text), t)) AS unit_hits FROM pg),
k AS (SELECT *, len(title_hits) > 0 AS title, numeric_ratio >= 0.18 AND line_count >= 15 AND len(metric_hits) > 0 AND len(unit_hits) > 0 AS numeric_page, text_chars < 20 AS low_text FROM f),
nb AS (SELECT *, max(title::INT) OVER (PARTITION BY doc ORDER BY page_number RANGE BETWEEN 3 PRECEDING AND 1 FOLLOWING) = 1 AS near_title FROM k)"""

_DENSE = (
    "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL), x AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, 1 - list_cosine_similarity(q.v, e.v) AS distance FROM e q JOIN e ON q.vec_id IN (SELECT item_id FROM benchmark)), "
    f"dn AS (SELECT query_id, chunk_id, {_r('greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - distance))', 4)} AS vector_score, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM x QUALIFY rank <= 50)"
)

SQL = {
    "x01_term_index": f"WITH {_TERMS} SELECT chunk_id, count(*) AS n_terms, sum(len(term))::BIGINT AS n_chars FROM ct GROUP BY 1",
    "j11_lexical_join": f"WITH {_PAIRS} SELECT * FROM pairs",
    "x03_numeric_score": f"WITH {_PAIRS} SELECT query_id, chunk_id, {_NSCORE} AS numeric_score FROM pairs JOIN documents c ON chunk_id = doc_id JOIN benchmark q ON query_id = item_id",
    "t06_channel_topk": f"WITH {_CHANNELS} SELECT query_id, chunk_id, score, rank, 'lexical' AS channel FROM lex UNION ALL SELECT query_id, chunk_id, score, rank, 'overlap' FROM ov",
    "a09_weighted_rrf": f"WITH {_FUSED} SELECT query_id, chunk_id, rrf, best_rank, channels FROM fused WHERE rank <= 100",
    "t04_hybrid_topk": f"WITH {_PAIRS}, h AS (SELECT query_id, chunk_id, lexical_score, {_NSCORE} AS ns FROM pairs JOIN documents c ON chunk_id = doc_id JOIN benchmark q ON query_id = item_id), g AS (SELECT *, {_r('0.5::DOUBLE * 0.5 + 0.35::DOUBLE * lexical_score + 0.15::DOUBLE * ns', 4)} AS relevance FROM h) SELECT query_id, chunk_id, relevance, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, ns DESC, lexical_score DESC, chunk_id) AS rank FROM g WHERE relevance >= 0.05 QUALIFY rank <= 5",
    "w04_collapse_provenance": f"WITH {_FUSED}, p AS (SELECT fused.*, source FROM fused JOIN documents ON chunk_id = doc_id WHERE rank <= 100 QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY rank) = 1) SELECT query_id, chunk_id, source, row_number() OVER (PARTITION BY query_id ORDER BY p.rank) AS rank FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY p.rank) <= 5",
    "w05_dedupe_contexts": f"WITH {_FUSED}, p AS (SELECT fused.* FROM fused JOIN documents ON chunk_id = doc_id WHERE rank <= 100 QUALIFY row_number() OVER (PARTITION BY query_id, substr(text, 1, 120) ORDER BY rank) = 1) SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY p.rank) AS rank FROM p",
    "w06_citation_ledger": f"WITH {_FUSED}, p AS (SELECT fused.*, sha256(text) AS content_sha256 FROM fused JOIN documents ON chunk_id = doc_id WHERE rank <= 100 QUALIFY row_number() OVER (PARTITION BY query_id, sha256(text) ORDER BY rank) = 1) SELECT query_id, chunk_id, 'C' || row_number() OVER (PARTITION BY query_id ORDER BY rank) AS citation_id, content_sha256 FROM p",
    "w07_context_budget": f"WITH {_FUSED}, p AS (SELECT fused.*, source, substr(text, 1, 6000) AS content FROM fused JOIN documents ON chunk_id = doc_id WHERE rank <= 100 QUALIFY row_number() OVER (PARTITION BY query_id, sha256(text) ORDER BY rank) = 1), n AS (SELECT *, 'C' || row_number() OVER (PARTITION BY query_id ORDER BY rank) AS citation_id FROM p), z AS (SELECT query_id, citation_id, (sum(len(content) + len(source) + len(citation_id) + 64) OVER (PARTITION BY query_id ORDER BY rank))::BIGINT AS running_size FROM n) SELECT * FROM z WHERE running_size <= 24000",
    "j12_dense_knn": f"WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL), x AS (SELECT q.vec_id AS query_id, e.vec_id, 1 - list_cosine_similarity(q.v, e.v) AS distance FROM e q JOIN e ON q.vec_id % 50 = 0) SELECT query_id, vec_id, {_r('greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - distance))', 4)} AS vector_score, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM x QUALIFY rank <= 10",
    "u02_channel_union": f"WITH {_CHANNELS}, {_DENSE} SELECT query_id, chunk_id, dn.rank AS dense_rank, coalesce(vector_score, 0.0::DOUBLE) AS vector_score, lex.rank AS lexical_rank, coalesce(lex.lexical_score, 0.0::DOUBLE) AS lexical_score FROM dn FULL JOIN lex USING (query_id, chunk_id)",
    "t06_channel_topk_dense": f"WITH {_CHANNELS}, {_DENSE} SELECT query_id, chunk_id, vector_score AS score, rank, 'dense' AS channel FROM dn UNION ALL SELECT query_id, chunk_id, score, rank, 'lexical' FROM lex",
    "a09_weighted_rrf_dense": f"WITH {_CHANNELS}, {_DENSE}, ch AS (SELECT query_id, chunk_id, rank, 0.6::DOUBLE / (60 + rank) AS part, 'dense' AS channel FROM dn UNION ALL SELECT query_id, chunk_id, rank, 0.4::DOUBLE / (60 + rank), 'lexical' FROM lex), f AS (SELECT query_id, chunk_id, round(sum(part), 9) AS rrf, min(rank) AS best_rank, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels FROM ch GROUP BY 1, 2) SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, best_rank, chunk_id) <= 100",
    "p14_vector_validate": "SELECT CASE WHEN embedding IS NULL THEN 'null' WHEN len(embedding) = 0 THEN 'empty' WHEN len(embedding) <> 64 THEN 'dimension' WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0 THEN 'not finite' ELSE 'none' END AS fault, count(*) AS n FROM embeddings GROUP BY 1",
    "p11_active_version_filter": "SELECT doc_id, 'v' || doc_id % 3 AS index_version FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 = 1",
    "p12_content_split": "SELECT CASE WHEN doc_id % 5 = 0 THEN 'table' ELSE 'text' END AS channel, count(*) AS n FROM documents GROUP BY 1",
    "x16_page_features": f"WITH {_PG} SELECT doc, page_number, text_chars, digit_chars, numeric_ratio, line_count, array_to_string(title_hits, ',') AS title_hits, array_to_string(metric_hits, ',') AS metric_hits, array_to_string(unit_hits, ',') AS unit_hits, array_to_string(list_filter({list(PERIODS)}, lambda t: contains(lower(text), t)), ',') AS period_hits, text_chars = 0 AS empty_text, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(?:^|[^0-9])((?:19|20)[0-9][0-9])(?:$|[^0-9])', 1))), ',') AS year_hits, low_text FROM k",
    "x17_page_classify": f"WITH {_PG} SELECT doc, page_number, array_to_string(list_filter([CASE WHEN title THEN 'ecommerce_table_title' END, CASE WHEN numeric_page THEN 'numeric_ecommerce_page' END, CASE WHEN low_text THEN 'low_text' END], lambda x: x IS NOT NULL), ',') AS reasons FROM k",
    "w08_title_neighbors": f"WITH {_PG} SELECT doc, page_number, near_title FROM nb",
    "w09_page_cap": f"WITH {_PG} SELECT doc, page_number, row_number() OVER (PARTITION BY doc ORDER BY (NOT title)::INT, numeric_ratio DESC, page_number) AS position, position > 10 AS dropped_by_cap FROM nb WHERE near_title OR title OR numeric_page OR low_text",
    "a20_page_inventory": f"WITH {_PG} SELECT doc, count(*) AS pages, count(*) FILTER (len(c) = 0) AS empty_pages FROM pg GROUP BY 1 UNION ALL SELECT 'total', count(*), count(*) FILTER (len(c) = 0) FROM pg",
    "x27_candidate_id": """SELECT doc_id, sha256('{"chunk_index":0,"content_sha256":"' || sha256(coalesce(text, '')) || '","content_type":"text","doc_id":' || doc_id || ',"provenance_id":null,"source":"' || source || '"}') AS candidate_id FROM documents""",
    "x28_version_ids": "SELECT doc_id, sha256('index:' || doc_id || ':' || sha256(coalesce(text, ''))) AS index_version FROM documents",
    "p09_serialize_context": "SELECT doc_id, source, substr(text, 1, 2000) AS content, substr(text, 1, 300) AS snippet FROM documents",
    "s16_embedding_cache_lookup": "WITH t AS (SELECT DISTINCT sha256(text) AS k FROM documents WHERE text IS NOT NULL), c AS (SELECT DISTINCT sha256(text) AS k FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL) SELECT count(*) AS texts, count(c.k) AS hits, count(*) - count(c.k) AS missing FROM t LEFT JOIN c USING (k)",
    "s17_index_upsert": "SELECT 'v1' AS index_version, count(*) AS n, sum(CASE WHEN doc_id % 4 = 0 THEN n_chars + 1 ELSE n_chars END)::BIGINT AS size FROM documents",
    "j19_layer_identity": "SELECT doc_id, source, n_chars, 'only_first' AS side FROM documents WHERE doc_id % 97 = 0 UNION ALL SELECT doc_id, source, n_chars + 1, 'only_second' FROM documents WHERE doc_id % 97 = 0",
    "j17_stale_versions": "SELECT doc_id, 'v' || doc_id % 5 AS index_version FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 2 <> 0 AND doc_id % 5 <> 0",
    "a26_corpus_fingerprint": "SELECT source, sha256(string_agg(sha256(doc_id || '|' || lang || '|' || coalesce(text, '')), '' ORDER BY doc_id)) AS h FROM documents GROUP BY 1",
    "j13_strict_hit_join": f"WITH {_HITS} SELECT query_id, chunk_id, rank FROM hits WHERE hit",
    "w15_first_hit_rank": f"WITH {_HITS} SELECT query_id, hit_rank FROM pq",
    "a10_recall_mrr": f"WITH {_HITS} SELECT count(*) AS n_queries, " + ", ".join(f"count(*) FILTER (hit_rank <= {k}) AS hits_at_{k}, {_r(f'(count(*) FILTER (hit_rank <= {k}))::DOUBLE / count(*)', 6)} AS recall_at_{k}" for k in (5, 20, 50, 100)) + f", {_MRR} AS mrr FROM pq",
    "a11_failure_stages": f"WITH {_HITS} SELECT CASE WHEN query_id % 2 <> 0 THEN 'strict_chunk_absent' WHEN query_id % 3 = 0 THEN 'not_in_union' WHEN hit_rank IS NULL THEN 'lost_during_fusion' WHEN hit_rank > 5 THEN 'lost_during_top5' ELSE 'hit' END AS stage, count(*) AS n FROM pq GROUP BY 1",
    "a13_subset_metrics": f"WITH {_HITS}, b AS (SELECT *, CASE WHEN query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS subset FROM pq UNION ALL SELECT *, 'overall' FROM pq) SELECT subset, count(*) AS n, count(*) FILTER (hit_rank <= 5) AS hits, {_MRR} AS mrr FROM b GROUP BY 1",
    "a31_release_gate": f"WITH {_HITS}, m AS (SELECT {_r('(count(*) FILTER (hit_rank <= 5))::DOUBLE / count(*)', 6)} AS r5, {_MRR} AS mrr FROM pq) SELECT 'recall_at_5' AS metric, '>=' AS op, 0.3::DOUBLE AS bound, r5 AS value, r5 >= 0.3 AS passed FROM m UNION ALL SELECT 'mrr', '>=', 0.9, mrr, mrr >= 0.9 FROM m UNION ALL SELECT 'coverage', '>=', 0.5, NULL, false FROM m",
    "a15_nearest_rank_percentile": "SELECT lang, quantile_disc(n_chars, 0.5)::DOUBLE AS p50, quantile_disc(n_chars, 0.95)::DOUBLE AS p95 FROM documents GROUP BY 1",
    "a16_reason_histogram": "SELECT CASE WHEN n_chars < 200 THEN 'short' WHEN n_chars > 10000 THEN 'long' ELSE 'ok_' || lang END AS reason, count(*) AS n FROM documents GROUP BY 1",
    "a17_token_cost": "SELECT role AS profile, CASE WHEN count(*) FILTER (role = 'system' AND turn <= 0) = 0 THEN round(CAST(sum(len(text) * 1.5::DOUBLE + turn * 2.25::DOUBLE) AS DECIMAL(38,10)) * CAST(0.000001 AS DECIMAL(7,6)), 8)::DOUBLE END AS cost, count(*) FILTER (role = 'system' AND turn <= 0) AS n_missing FROM conversations GROUP BY 1",
    "a25_load_summary": f"WITH e AS (SELECT event_type AS name, round(value * 10)::BIGINT AS ms, event_type = 'error' AS failed FROM events WHERE value IS NOT NULL), b AS (SELECT * FROM e UNION ALL SELECT 'Aggregated', ms, failed FROM e) SELECT name, count(*) AS requests, count(*) FILTER (failed) AS failures, {_r('(count(*) FILTER (failed))::DOUBLE * 100.0 / count(*)', 4)} AS failure_percent, {_r('avg(ms)', 4)} AS average_ms, quantile_disc(ms, 0.95)::DOUBLE AS p95_ms, quantile_disc(ms, 0.99)::DOUBLE AS p99_ms FROM b GROUP BY 1",
    "a27_dataset_profile": "SELECT lang, source, count(*) AS n, count(DISTINCT doc_id) AS n_ids FROM documents GROUP BY 1, 2",
    "a30_fact_conflicts": "SELECT l_partkey, l_suppkey, count(DISTINCT l_returnflag || '|' || l_linestatus) AS n_values FROM lineitem GROUP BY 1, 2 HAVING n_values > 1",
}
