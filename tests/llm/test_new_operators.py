"""Whitening, SuperMinHash groups and fill-in-middle: brute force, round trips, nulls, long texts, repeats, clashing columns."""

import hashlib
import itertools
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.llm import fim, superminhash, whitening

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VOCAB = [f"w{i:x}" for i in range(400)]


def frame(spark, texts, first=0):
    """A documents table with columns that clash with the operators' own names."""
    rows = [(i + first, t, "en", "src", len(t or ""), i, "clash", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node long, key string, n int").repartition(3)


# ---- fill-in-middle ---------------------------------------------------------------------------


def fim_by_hand(doc_id, text):
    text = text or ""
    u = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return len(u), "plain", None, None, text
    return (len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else (len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def line_texts():
    r = random.Random(4)
    ends = ["", "\n", "\n\n", "\r\n", "é ", "<", "<S", "日本\n", "🙂"]
    some = ["".join(r.choice(["ab", "é", "日", "🙂", " ", "\n", "<P", "M>", "\r"]) for _ in range(r.randint(1, 120))) + r.choice(ends) for _ in range(120)]
    return [None, "", "\n", "\n\n\n", "one line", "a<P>b", "<M>\n", "x" * 5000, "é🙂\n" * 3000, "long " * 60000 + "\n" + "z\n" * 40, *some, some[0], some[0]]


@pytest.mark.parametrize("frame_bytes", [4, 61, 256 << 10])
def test_fill_in_middle_equals_slices(spark, frame_bytes):
    texts = line_texts() if frame_bytes > 4 else line_texts()[:7] + line_texts()[10:]
    stored = fim.store(frame(spark, texts), frame_bytes=frame_bytes)
    made = fim.transform(stored, frame_bytes=frame_bytes)
    got = {r.doc_id: r for r in fim.digests(made).collect()}
    out = {r.doc_id: r for r in fim.texts(made).collect()}
    assert len(got) == len(out) == len(texts)
    for i, t in enumerate(texts):
        n, form, prefix, middle, output = fim_by_hand(i, t)
        assert (got[i].n, got[i].form, got[i].prefix_chars, got[i].middle_chars) == (n, form, prefix, middle)
        assert out[i].text == output
        assert got[i].output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert got[i].restored_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_fill_in_middle_null_ids_repeats_and_empty(spark):
    docs = frame(spark, ["a\nb\nc\nd", "a\nb\nc\nd", None])
    odd = docs.withColumn("doc_id", F.when(F.col("text").isNull(), None).otherwise(F.lit(9)))
    got = fim.digests(fim.transform(fim.store(odd))).collect()
    assert len(got) == 3 and len({tuple(r) for r in got if r.doc_id == 9}) == 1
    assert [r.form for r in got if r.doc_id is None] == ["plain"]
    assert fim.digests(fim.transform(fim.store(docs.where("false")))).count() == 0


def test_rates(spark):
    docs = frame(spark, ["a\nb\nc"] * 300)
    forms = [r.form for r in fim.transform(fim.store(docs), rate=40, spm_rate=0).select("form").collect()]
    assert set(forms) == {"plain", "psm"} and 80 < forms.count("psm") < 160


def test_only_cut_frames_are_opened():
    raw = [f"line {i}\n".encode() * 10 for i in range(50)]
    import zstandard

    pack = zstandard.ZstdCompressor().compress
    text = fim.Frames(list(itertools.accumulate(map(len, raw))), [pack(x) for x in raw])
    opened = []
    keep = text._open
    text._open = lambda f: opened.append(f) or keep(f)
    units, chars = list(itertools.accumulate([10] * 50)), list(text.ends)
    assert fim.cut(units, chars, text, 500, 137) == (len(b"".join(raw)[: b"".join(raw).index(b"line 13\n") + 7 * 8]),) * 2
    assert len(opened) == 1


# ---- SuperMinHash -----------------------------------------------------------------------------


def shingles(text):
    w = WORDS.findall((text or "").translate(UPPER))
    return {" ".join(w)} if 0 < len(w) < 3 else {" ".join(w[i : i + 3]) for i in range(len(w) - 2)}


def groups_by_hand(ids, texts):
    s = [shingles(t) for t in texts]
    up = list(range(len(ids)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(ids)), 2):
        if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 85 * len(s[i] | s[j]):
            up[find(j)] = find(i)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s[i]), least.get(find(i)), d == least.get(find(i))) for i, d in enumerate(ids)]


def near_texts():
    r = random.Random(8)
    base = [" ".join(r.choices(VOCAB, k=r.randint(3, 160))) for _ in range(40)]
    out = [None, "", " \n\t", "one", "ONE", "one two", "two one", "a b c", "A  b\nC", "x " * 4000, "x " * 3990, *base]
    for b in base[:25]:  # copies that drift away step by step: chains of links
        w = b.split()
        for _ in range(6):
            w = list(w)
            for _ in range(max(1, len(w) // 50)):
                w[r.randrange(len(w))] = r.choice(VOCAB)
            out.append(" ".join(w))
    shared = " ".join(r.choices(VOCAB, k=60))
    out += [shared + " " + " ".join(r.choices(VOCAB, k=r.randint(5, 60))) for _ in range(30)]  # one passage, many neighbours below the bound
    out += [base[0], base[0], base[1].upper()]
    return out


def test_groups_equal_brute_force(spark):
    texts = near_texts()
    docs = frame(spark, texts)
    got = sorted(tuple(r) for r in superminhash.near_groups(docs).collect())
    assert got == sorted(groups_by_hand(list(range(len(texts))), texts))
    loose = sorted(tuple(r) for r in superminhash.near_groups(docs, percent=70, bands=64, rows=2).collect())
    assert len({r[2] for r in loose}) < len({r[2] for r in got})


def test_null_ids_link_and_repeats_stay(spark):
    r = random.Random(3)
    w = r.choices(VOCAB, k=100)
    chain = [" ".join(w), " ".join(w[4:]), " ".join(w[8:])]
    rows = [(1, chain[0]), (None, chain[1]), (3, chain[2]), (3, chain[2]), (None, None), (None, "alone in here now"), (7, chain[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, superminhash.near_groups(docs, percent=95).collect()))
    assert got == sorted(map(str, superminhash.near_groups(docs.repartition(5), percent=95).collect()))
    by = [tuple(r) for r in superminhash.near_groups(docs, percent=95).collect()]
    assert sorted(by, key=str) == sorted([(1, 98, 1, True), (None, 94, 1, False), (3, 90, 1, False), (3, 90, 1, False), (None, 0, None, True), (None, 2, None, True), (7, 98, 1, False)], key=str)
    assert superminhash.near_groups(docs.where("false")).count() == 0


def test_blocks_find_the_same_links(spark):
    texts = [t for t in near_texts() if t and len(t.split()) > 2]
    nodes = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    rows = nodes.select(F.lit(5).cast("long").alias("key"), "node", F.col("node").alias("grp"))

    def parts(found):
        up = {i: i for i in range(len(texts))}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for u, v in found:
            up[find(u)] = find(v)
        roots = [find(i) for i in range(len(texts))]
        return [roots.index(x) for x in roots]

    one = superminhash.bucket_links(rows, nodes, 3, 85).collect()
    many = superminhash.bucket_links(rows, nodes, 3, 85, block_bytes=4000).collect()
    want = {i: c for i, _, c, _ in groups_by_hand(list(range(len(texts))), texts)}
    assert parts(one) == parts(many) == [want[i] for i in range(len(texts))]


def test_signatures_estimate_similarity_and_permute():
    r = np.random.default_rng(1)
    for n in (1, 5, 40, 700):
        both, a, b = (np.sort(r.integers(0, 1 << 63, n).astype(np.uint64)) for _ in range(3))
        x, y = np.sort(np.concatenate((both, a[: n // 4]))), np.sort(np.concatenate((both, b[: n // 4])))
        sig = superminhash.signatures([x, y], 256)
        want = n / (n + 2 * (n // 4))
        assert abs((sig[0] == sig[1]).mean() - want) < 0.13
    one = superminhash.signatures([np.array([9], np.uint64)], 64)[0]
    assert sorted(one >> np.uint64(40)) == list(range(64))  # one element fills every place once, a step each
    assert (superminhash.signatures([np.empty(0, np.uint64)], 8) == superminhash.UNSET).all()


# ---- whitening --------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "c", 1.0) for i, v in rows], "vec_id long, embedding array<float>, component string, n double").repartition(3)


def test_whitening_equals_direct_solver(spark):
    r = np.random.default_rng(6)
    v = (r.standard_normal((400, 40)) * np.linspace(3, 0.2, 40)).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(5, v[5].tolist()), (None, v[6].tolist())]
    bad = [(900, None), (901, [float("nan")] * 40), (902, [float("inf"), *[0.0] * 39]), (903, [None, *[1.0] * 39])]
    got = whitening.whiten(vectors(spark, rows + bad)).toPandas()
    x = np.floor(64 * np.array([y for _, y in rows], np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:32], u[:, ::-1][:, :32]
    assert len(got) == n * 32 and set(got.n) == {n} and sorted(set(got.component)) == list(range(1, 33))
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9
    ids = [i for i, _ in rows]
    for k in range(32):
        part = got[got.component == k + 1]
        assert np.allclose(part.explained, e[k] / np.trace(c.T @ c / n), rtol=1e-10)
        want = c @ u[:, k] / np.sqrt(e[k])
        mine = part.set_index("vec_id").whitened
        sign = np.sign(mine.loc[11] * want[11])
        assert all(np.isclose(np.sort(np.atleast_1d(mine.loc[i])), np.sort(sign * want[[j for j, q in enumerate(ids) if q == i]]), atol=1e-8).all() for i in (0, 5, 77, 399))
    dev = {(i, int(((n * a - s) ** 2).sum())) for i, a in zip(ids, x) if i is not None}
    assert dev == {(int(i), int(d)) for i, d in zip(got.vec_id, got.deviation) if not pd.isna(i)}


def test_whitening_of_odd_tables(spark):
    flat = [(i, [1.0, 2.0, float(i)]) for i in range(6)]
    got = whitening.whiten(vectors(spark, flat)).collect()
    assert {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-12 and len(got) == 6  # two dimensions never vary
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # all equal
    assert whitening.whiten(vectors(spark, [(1, None)])).count() == 0
    assert whitening.whiten(vectors(spark, flat).where("false")).count() == 0
    short = whitening.whiten(vectors(spark, [(1, [1.0]), (2, [1.0, 3.0]), (3, [0.0, 1.0])])).collect()
    same = whitening.whiten(vectors(spark, [(1, [1.0, 0.0]), (2, [1.0, 3.0]), (3, [0.0, 1.0])])).collect()
    assert sorted((r.vec_id, r.component, r.deviation) for r in short) == sorted((r.vec_id, r.component, r.deviation) for r in same)
    with pytest.raises(ValueError):
        whitening.whiten(vectors(spark, flat), most_dims=2)
    big = whitening.whiten(vectors(spark, [(i, [1e15 * (i % 3), float(i)]) for i in range(9)])).collect()
    assert {r.deviation for r in big if r.component == 1 and r.vec_id % 3 != 1} == {None}  # too large for a long


@pytest.mark.parametrize("lam", [2.0 ** -np.arange(40), np.r_[[5.0] * 6, [3.0] * 10, [1.0] * 24], 1 + 1e-9 * np.arange(40), np.r_[10, 10 * (1 - 1e-12), np.linspace(1, 2, 38)], np.r_[np.arange(5) + 1.0, np.zeros(35)], np.array([3.0])])
def test_intervals_and_feast_find_all(lam):
    d = len(lam)
    q, _ = np.linalg.qr(np.random.default_rng(0).standard_normal((d, d)))
    v = (q * lam) @ q.T
    v = (v + v.T) / 2
    diag, off = whitening.tridiagonal(v)
    assert np.allclose(np.linalg.eigvalsh(np.diag(diag) + np.diag(off, 1) + np.diag(off, -1)), np.linalg.eigvalsh(v), atol=1e-12)
    k = min(32, int((lam > 1e-13 * lam.max()).sum()))
    parts = whitening.intervals(diag, off, k)
    assert all(a[0] == b[1] for a, b in itertools.pairwise(parts)) and sum(p[2] for p in parts) >= k
    found = [whitening.feast(v, *p) for p in parts]
    e = np.concatenate([f[0] for f in found])[:k]
    assert np.allclose(e, np.sort(lam)[::-1][:k], atol=1e-12 * lam.max(), rtol=1e-6)
    assert all(np.abs(v @ u - u * w).max() < 1e-11 * lam.max() for w, u in found)

