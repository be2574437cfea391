"""Queries that write chunks and read them back, take pages from injected extractors and vectors from injected embedders, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import providers
from millrace.sources.chunkstore import ChunkStore
from millrace.sources.facts import table
from millrace.streaming.jobs import shared_folder

_SCHEMA = "doc_id long, size long, index_version string"


def _store(s, d):
    """A store of all documents in two versions; a second write of the same rows changes nothing."""
    docs = table(s, d, "documents").where("doc_id is not null").select("doc_id", F.col("n_chars").alias("size"), F.col("lang").alias("index_version")).where("index_version is not null")
    store = ChunkStore(s, shared_folder(s, "chunks"), _SCHEMA, 8)
    store.upsert(docs)
    return store, docs


def upsert_written(s, d):
    store, docs = _store(s, d)
    new = docs.where("size < 1000").withColumn("size", F.col("size") + 1)
    store.upsert(new)
    store.upsert(new)
    return store.read()


def delete_written(s, d):
    store, docs = _store(s, d)
    store.delete(docs.where("size < 1000").select("doc_id", "index_version"))
    store.delete(docs.where("size > 5000").select("doc_id"))
    return store.read()


def _by_paragraph(content: bytes) -> list[str | Exception]:
    """Pages are cut at <p>; a page without text counts as broken, a file without <p> as unreadable."""
    parts = content.decode("utf-8").split("<p>")
    if len(parts) == 1:
        raise ValueError("no page")
    return [p if p.strip(" ") else ValueError("blank page") for p in parts]


def read_page_text(s, d):
    files = table(s, d, "pages").select("page_id", F.encode("html", "UTF-8").alias("content"))
    return providers.page_text(files, _by_paragraph, "page_id").select("page_id", F.col("page_number").cast("long").alias("page_number"), "text", "error")


def _counts(texts: list[str]) -> list[list[float]]:
    """Lengths and counts as vectors; faulty on purpose: one number is missing of short texts, and no text may hold the word license."""
    if any("license" in t for t in texts):
        raise ValueError("refused")
    return [[float(len(t)), float(t.count("e"))] if len(t) >= 200 else [float(len(t))] for t in texts]


def embed_checked(s, d):
    rows = table(s, d, "documents").select("doc_id", "text")
    return providers.embed(rows, _counts, 2, "doc_id").select("doc_id", F.get("embedding", F.lit(0)).alias("n_chars"), F.get("embedding", F.lit(1)).alias("n_e"), "error")


QUERIES = {"s17_upsert_written": upsert_written, "s18_delete_written": delete_written, "s08_read_page_text": read_page_text, "f13_embed_checked": embed_checked}

_DOCS = "d AS (SELECT doc_id, n_chars AS size, lang AS index_version FROM documents WHERE doc_id IS NOT NULL AND lang IS NOT NULL)"
SQL = {
    "s17_upsert_written": f"WITH {_DOCS}, n AS (SELECT doc_id, size + 1 AS size, index_version FROM d WHERE size < 1000) SELECT * FROM n UNION ALL SELECT * FROM d WHERE (doc_id, index_version) NOT IN (SELECT (doc_id, index_version) FROM n)",
    "s18_delete_written": f"WITH {_DOCS} SELECT * FROM d WHERE (doc_id, index_version) NOT IN (SELECT (doc_id, index_version) FROM d WHERE size < 1000) AND doc_id NOT IN (SELECT doc_id FROM d WHERE size > 5000)",
    "s08_read_page_text": """WITH p AS (SELECT page_id, html, string_split(html, '<p>') AS parts FROM pages), e AS (SELECT page_id, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS page_number FROM p WHERE len(parts) > 1)
SELECT page_id, page_number, CASE WHEN trim(part) = '' THEN '' ELSE part END AS text, CASE WHEN trim(part) = '' THEN 'ValueError: blank page' END AS error FROM e
UNION ALL SELECT page_id, 0, '', CASE WHEN html IS NULL THEN 'no content' ELSE 'ValueError: no page' END FROM p WHERE html IS NULL OR len(parts) = 1""",
    "f13_embed_checked": """SELECT doc_id, CASE WHEN len(text) >= 200 AND NOT contains(text, 'license') THEN len(text)::DOUBLE END AS n_chars, CASE WHEN len(text) >= 200 AND NOT contains(text, 'license') THEN (len(text) - len(replace(text, 'e', '')))::DOUBLE END AS n_e,
CASE WHEN text IS NULL THEN 'no text' WHEN contains(text, 'license') THEN 'ValueError: refused' WHEN len(text) < 200 THEN 'dimension 1, not 2' END AS error FROM documents""",
}
