"""Chunk stores, injected extractors and embedders."""

import pytest

from millrace.operators import providers
from millrace.sources.chunkstore import ChunkStore
from millrace.sources.io import Refused
from millrace.streaming.jobs import shared_folder

SCHEMA = "doc_id long, n int, index_version string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_replace_twice_delete_and_empty_partitions(spark):
    store = ChunkStore(spark, shared_folder(spark, "store"), SCHEMA, 4)
    make = lambda x: spark.createDataFrame(x, SCHEMA)
    assert rows(store.read()) == []
    store.upsert(make([(i, c, v) for i in range(6) for c in range(2) for v in ("a", "b/c d")]))
    for _ in range(2):  # fewer chunks than before: the stale ones go
        store.upsert(make([(1, 9, "a"), (77, 5, "a")]))
    got = rows(store.read())
    assert [r for r in got if r[0] in (1, 77)] == [(1, 0, "b/c d"), (1, 1, "b/c d"), (1, 9, "a"), (77, 5, "a")] and len(got) == 24
    store.delete(spark.createDataFrame([(1, "a"), (None, "a"), (500, "a")], "doc_id long, index_version string"))
    assert len(rows(store.read())) == 23
    for _ in range(2):
        store.delete(spark.createDataFrame([(i,) for i in range(6)], "doc_id long"))
        assert rows(store.read()) == [(77, 5, "a")]
    store.upsert(make([]))
    assert rows(store.read()) == [(77, 5, "a")]
    with pytest.raises(Refused):
        store.upsert(make([(None, 1, "a")]))
    with pytest.raises(Refused):
        store.delete(spark.createDataFrame([("a",)], "index_version string"))


def test_broken_pages_are_rows(spark, tmp_path):
    for name, content in (("a", b"one|!|three"), ("c", b"\xff")):
        (tmp_path / f"{name}.doc").write_bytes(content)

    def extract(raw):
        return [ValueError("torn") if t == "!" else t for t in raw.decode("utf-8").split("|")] if raw else []

    files = providers.read_binary(spark, str(tmp_path), "*.doc").unionByName(spark.createDataFrame([("b.doc", b""), ("n.doc", None)], "path string, content binary"))
    got = providers.page_text(files, extract)
    found = sorted((r.path[-5:], r.page_number, r.text, (r.error or "")[:10]) for r in got.collect())
    assert found == [("a.doc", 1, "one", ""), ("a.doc", 2, "", "ValueError"), ("a.doc", 3, "three", ""), ("b.doc", 0, "", "no pages"), ("c.doc", 0, "", "UnicodeDec"), ("n.doc", 0, "", "no content")]


def test_faulty_embedders_are_refused_by_row(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None), (3, "boom"), (4, ""), (5, "nan"), (6, "long"), (7, "word")], "id long, text string").coalesce(1)

    def provider(texts):
        if "boom" in texts:
            raise RuntimeError("down")
        special = {"nan": [float("nan"), 1.0], "long": [1.0, 2.0, 3.0], "word": ["x", "y"]}
        return [special.get(t, [float(len(t)), 1.0]) for t in texts]

    got = {r.id: (r.embedding, r.error) for r in providers.embed(docs, provider, 2, "id").collect()}
    assert got == {1: ([2.0, 1.0], None), 2: (None, "no text"), 3: (None, "RuntimeError: down"), 4: ([0.0, 1.0], None), 5: (None, "not finite"), 6: (None, "dimension 3, not 2"), 7: (None, "not numbers")}
    short = {r.id: r.error for r in providers.embed(docs.where("id in (1, 4)"), lambda texts: [[1.0, 2.0]] * (len(texts) + 1), 2, "id", batch=2).collect()}
    assert short == {1: "2 vectors for 1 texts", 4: "2 vectors for 1 texts"}
    assert providers.embed(docs.where("false"), provider, 2, "id").count() == 0
