"""The pipeline on a small table, stage by stage against brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from millrace.llm import langid, packing, quality, suffix

from .test_operators import fingerprint, groups_of, prose


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(21)
    base = [prose(r.randint(80, 200), r) for _ in range(25)]
    shared = prose(90, r)
    near = base[4].split()
    near[50] = "other"
    texts = [None, "", "123 456 789 " * 8, "few words", *base, base[0], base[0], " ".join(near), base[7] + " " + shared, shared + " " + base[9], "the same line again and again\n" * 30]
    rows = [(i, t, ("en", "de")[i % 2], "s", len(t or ""), "extra") for i, t in enumerate(texts)]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i not in (3, len(texts) - 1)), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def earlier_cut(texts, n=240):
    """Later copies of strings of n bytes cut, documents in order of id."""
    seen, out = set(), {}
    for i in sorted(texts):
        raw = texts[i].encode()
        marks = [hashlib.md5(raw[k : k + n]).digest() for k in range(len(raw) - n + 1)]
        out[i] = suffix._without(raw, suffix.merge_spans([(k, k + n) for k, h in enumerate(marks) if h in seen])).decode()
        seen.update(marks)
    return out


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    cols = docs.columns
    want = {r.doc_id: r.text for r in docs.collect()}
    model = langid.fit(docs)
    rules = None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "quality_rules":
            rules = quality.fit(docs, spark.read.parquet(f"{tables}/labels.parquet"))
        docs = corpus_pipeline.stash(stage(spark, docs, tables), name)
        assert docs.columns == cols
        if name == "language_id":
            want = {i: t for i, t in want.items() if t and any(c.isalpha() for c in t)}
            assert model["families"] == ["germanic"]
        elif name == "quality_rules":
            s = {i: quality.statistics(t.encode()) for i, t in want.items()}
            want = {i: t for i, t in want.items() if not quality.base_failed(s[i][0], s[i][4]) and quality.score_trees(rules, np.array([s[i][5]]))[0] >= rules["cut"]}
        elif name == "simhash_near_dedup":
            fp = {i: fingerprint(t) for i, t in want.items()}
            find = groups_of([(a, b) for a in fp for b in fp if bin(fp[a] ^ fp[b]).count("1") <= 3])
            want = {i: t for i, t in want.items() if find(i) == i}
        else:
            want = earlier_cut(want)
        assert {r.doc_id: r.text for r in docs.collect()} == want, name
        assert all(r.n_chars == len(r.text) for r in docs.collect())
    assert 10 < len(want) < 30


def test_a_passage_of_over_50_words_stays_once(spark):
    r = random.Random(4)
    passage = " ".join(r.choices(["the", "and", "for", "with", "house", "river", "of", "mountain"], k=55))
    texts = [None, "", passage, *[f"{prose(60, r)}\n{passage} {prose(40, r)}" for _ in range(6)], prose(200, r)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x.doc_id: x.text for x in corpus_pipeline.suffix_dedup(spark, df, "").collect()}
    assert [i for i, t in got.items() if passage[5:-5] in (t or "")] == [2]
    assert got[9] == texts[9] and len(got) == 10 and all(len(got[i]) > 300 for i in range(3, 9))


def test_run(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stash(stage(spark, docs, tables), "t")
    want = collections.Counter()
    for r in docs.collect():
        raw = np.append(packing.token_ids([r.text.encode()], packing.default_tokenizer())[0], 1).astype("<u4").tobytes()
        want.update((r.doc_id, k, zlib.crc32(raw[x : x + 16384])) for k, x in enumerate(range(0, len(raw), 16384)))
    got = corpus_pipeline.run(spark, tables).collect()
    assert collections.Counter((r.doc_id, r.piece, r.ids_crc32) for r in got) == want
    total = collections.defaultdict(int)
    for r in got:
        total[r.sequence_id] += r.length
    assert max(total.values()) <= 4096
