"""The ten operators on small tables: nulls, empty and repeated rows, ties, clashing columns, brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import langid, licenses, lm, packing, pieces, quality, simhash, suffix, topk, warc
from millrace.llm.common import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
rng = random.Random(5)
VOCAB = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(300)]


def prose(n, r):
    return " ".join(r.choices(VOCAB, k=n))


def sample_texts():
    r = random.Random(11)
    base = [prose(r.randint(40, 160), r) for _ in range(14)]
    near = base[0].split()
    near[20] = "changed"
    shared = prose(90, r)
    return [None, "", " \n\t ", "12 34 %%", "Été à Île ŝ", *base, base[1], base[1], " ".join(near), base[2] + "\n" + shared, shared + " " + base[3][:50], "x" * 900, "ab " * 400, prose(6000, r), "All rights reserved. CC BY-NC 4.0\nGNU General Public License, version 3"]


@pytest.fixture(scope="module")
def docs(spark):
    texts = sample_texts()
    rows = [(i, t, ("en", "de", "fr")[i % 3], "src", len(t or ""), i, "clash") for i, t in enumerate(texts)]
    rows.append(rows[6])  # a repeated row
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp long, k string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def texts_of(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def test_licenses(docs, empty):
    got = licenses.scan(docs).collect()
    assert len(got) == docs.count() and licenses.scan(empty).count() == 0
    last = max(got, key=lambda r: r.doc_id)
    assert last.base_labels == "cc-by,gpl,reserved" and last.labels == "cc-by,cc-by-nc,gpl,gpl-3.0,reserved"
    assert (last.n_base, last.first_word, last.last_word, last.score) == (3, 0, 9, 1.0)
    by = {r.doc_id: r for r in got}
    assert (by[0].n_words, by[0].n_base, by[0].first_word, by[0].labels, by[0].score) == (0, 0, None, "", 0.0)


def test_licenses_find_every_place(spark):
    r = random.Random(3)
    text = [" ".join(r.choices(["cc", "by", "all", "rights", "reserved", "general", "public", "license", "x"], k=60)) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
    phrases = [p.split() for _, p, _ in licenses.BASE]
    for x in licenses.scan(rows).collect():
        w = text[x.doc_id].split()
        at = [i for p in phrases for i in range(len(w)) if w[i : i + len(p)] == p]
        assert (x.n_base, x.first_word, x.last_word) == (len(at), min(at, default=None), max(at, default=None))


def test_licenses_take_a_long_text(spark):
    text = "all rights reserved " * 50000 + "cc by " * 20000  # over a megabyte, every word a licence word
    x = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == (190000, 70000, 0, 189998, "cc-by,reserved")


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.pack_documents(docs, items_per_partition=6).collect()
    assert packing.pack_documents(empty).count() == 0
    by, seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append((r.offset, r.length))
    for i, t in texts_of(docs).items():
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want = [(k, lo, len(ids[lo : lo + 4096]), zlib.crc32(ids[lo : lo + 4096].tobytes())) for k, lo in enumerate(range(0, len(ids), 4096))]
        assert sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in by[i]}) == want
    for parts in seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096


def test_packing_keeps_exact_special_token_case():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    for t in ("a <|endoftext|> b", "A <|ENDOFTEXT|> B.", "Wait... so,  x. É. y", "don't it's I'LL", "é z ,. a."):
        assert packing.token_ids([t.encode()], packing.default_tokenizer())[0].tolist() == tok.encode(t, add_special_tokens=False).ids


def test_lower_bound_certifies():
    r = np.random.default_rng(2)
    for _ in range(20):
        x = r.integers(1, 101, 60)
        bins, off = packing.best_fit_decreasing(x, 100)
        assert packing.lower_bound(x, 100) <= bins.max() + 1
        assert all(sum(x[bins == b]) <= 100 for b in range(bins.max() + 1))
    assert packing.lower_bound(np.full(10, 51), 100) == 10


def test_quality_counts(docs, empty, spark):
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(30)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = quality.apply_rules(docs, model).collect()
    assert len(got) == docs.count() and quality.apply_rules(empty, model).count() == 0
    for r in got:
        t = texts_of(docs)[r.doc_id] or ""
        w = WORDS.findall(t)
        c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(w) < 10 or 100 * len(hit) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert quality.keep_good(docs, model).columns == docs.columns
    none = quality.fit(docs, labels.where("false"))
    assert all(r.kept != r.base_failed for r in quality.apply_rules(docs, none).collect())


def test_trees_are_monotone():
    r = np.random.default_rng(1)
    x = r.random((3000, 3))
    y = (x[:, 0] + 0.3 * r.standard_normal(3000) < 0.5).astype(float)
    m = quality.fit_trees(x, y, np.array([-1, 0, 0]))
    p = quality.score_trees(m, np.column_stack([np.linspace(0, 1, 200), np.full(200, 0.4), np.full(200, 0.6)]))
    assert (np.diff(p) <= 1e-12).all() and p[0] > 0.8 > 0.2 > p[-1]


def fingerprint(t):
    w = WORDS.findall((t or "").translate(UPPER))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def groups_of(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return find


def test_simhash_groups(docs, empty):
    got = simhash.near_groups(docs).collect()
    assert len(got) == docs.count() and simhash.near_groups(empty).count() == 0
    fp = {i: fingerprint(t) for i, t in texts_of(docs).items()}
    find = groups_of([(a, b) for a in fp for b in fp if bin(fp[a] ^ fp[b]).count("1") <= 3])
    for r in got:
        assert (r.fp % (1 << 64), r.component_id) == (fp[r.doc_id], find(r.doc_id))
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({find(i) for i in fp})


def test_simhash_links_through_rows_without_id(spark):
    """Fingerprints 0, 7 and 63 in a chain, the middle one of a row without doc_id."""
    prints = spark.createDataFrame([(1, 0), (None, 7), (3, 63), (4, 1 << 40 | 1 << 41 | 1 << 50 | 1 << 60)], "doc_id long, fp long")
    keep = simhash.fingerprints
    simhash.fingerprints = lambda docs, *a: docs
    try:
        got = {r.fp: r.component_id for r in simhash.near_groups(prints).collect()}
    finally:
        simhash.fingerprints = keep
    assert got == {0: 1, 7: 1, 63: 1, 1 << 40 | 1 << 41 | 1 << 50 | 1 << 60: 4}


def test_simhash_keeps_texts_that_share_a_doc_id(spark):
    r = random.Random(8)
    a, b = prose(80, r), prose(80, r)
    df = spark.createDataFrame([(1, a), (1, b), (1, a), (2, a), (None, a)], "doc_id long, text string")
    assert collections.Counter(map(tuple, simhash.keep_first(df).collect())) == collections.Counter([(1, a), (1, b), (None, a)])


@pytest.mark.parametrize("limit", [2, 2048])
def test_pigeonhole_loses_no_link(spark, limit):
    r = random.Random(limit)
    centres = [r.getrandbits(64) for _ in range(40)]
    fps = {c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))) for c in centres for _ in range(8)} | {centres[0] ^ (1 << b) ^ (1 << d) for b in range(12) for d in range(12, 24)}
    rows = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(sorted(fps))]
    nodes = spark.createDataFrame(rows, "fp long, node long")
    got = {x.node: x.root for x in components(simhash.links(nodes, 3, limit)).collect()}
    f = sorted(fps)
    find = groups_of([(i, j) for i in range(len(f)) for j in range(i + 1, len(f)) if bin(f[i] ^ f[j]).count("1") <= 3])
    assert all(got.get(i, i) == find(i) for i in range(len(f)))


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 100), (200, 201), (201, 200)], "u long, v long")
    got = {r.node: r.root for r in components(e).collect()}
    assert got == {i: 1 for i in range(2, 61)} | {201: 200}


def test_lm(docs, empty):
    for vocab in (20, 10000):
        got = lm.score_texts(docs, max_vocabulary=vocab, tokens_per_shard=500).collect()
        texts = texts_of(docs)
        tok = {i: WORDS.findall((t or "").translate(UPPER)) + [None] for i, t in texts.items()}
        count = collections.Counter(w for r in got if r.train for w in tok[r.doc_id])
        n, v = sum(count.values()), len(count)
        assert len(got) == docs.count()
        for r in got:
            t = tok[r.doc_id]
            base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t)
            assert r.train == (zlib.crc32(str(r.doc_id).encode()) % 7 != 2)
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(count[w] > 0 for w in t), n) and abs(r.base_score - base) < 1e-6 * abs(base)
            assert r.score <= 0 and math.isfinite(r.score)
        assert sum(r.score for r in got if r.train) > sum(r.base_score for r in got if r.train)
    assert lm.score_texts(empty).count() == 0


def test_lm_scores_do_not_change_with_the_shards(docs):
    got = [sorted((r.doc_id, round(r.score, 6)) for r in lm.score_texts(docs, tokens_per_shard=n).collect()) for n in (500, 10**9)]
    assert got[0] == got[1]


def test_lm_scores_do_not_change_with_the_dictionary(docs):
    got = [sorted((r.doc_id, round(r.score, 6)) for r in lm.score_texts(docs, max_vocabulary=n).collect()) for n in (20, 10_000)]
    assert got[0] == got[1]


def test_lm_scores_are_those_of_interpolated_bigrams(docs):
    """score against absolute discounting over words by brute force, quantised as the trie's levels are."""
    texts, level = docs.select("doc_id", "text").collect(), lambda p: 10 ** (-lm.STEP * min(255, max(0, round(-math.log10(p) / lm.STEP))))
    tokens = [(r.doc_id, ["<s>", *WORDS.findall((r.text or "").translate(UPPER)), "</s>"]) for r in texts]
    train = [t for i, t in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    one, two = collections.Counter(w for t in train for w in t[1:]), collections.Counter(x for t in train for x in zip(t, t[1:]))
    total, kinds, n = collections.Counter(), collections.Counter(a for a, _ in two), sum(one.values())
    for (a, _), c in two.items():
        total[a] += c
    want = collections.Counter()
    for i, t in tokens:
        s = 0.0
        for a, b in zip(t, t[1:]):
            p = level(max(one[b], 1) / (n + 1)) * (level(0.75 * kinds[a] / total[a]) if total[a] else 1)
            s += math.log10(min(1, p + (level((two[a, b] - 0.75) / total[a]) if two[a, b] else 0)))
        want[i, round(s, 5)] += 1
    for n_tokens in (300, 10**9):
        assert collections.Counter((r.doc_id, round(r.score, 5)) for r in lm.score_texts(docs, tokens_per_shard=n_tokens).collect()) == want


def test_successor_pairs_go_in_one_row_a_bucket(docs, monkeypatch):
    """However many pairs a task sees, it sends a row for each bucket; sums are exact, also when it sends more than once."""
    r = np.random.default_rng(5)
    key, times = (r.integers(0, 40, 90_000).astype(np.uint64) << np.uint64(32)) | r.integers(0, 900, 90_000).astype(np.uint64), r.integers(1, 9, 90_000)
    packed = lm._packed_pairs(*lm._summed(key, times), 7)
    got = [lm._unpacked_pairs(x) for x in packed.column(1).to_pylist()]
    want = collections.Counter()
    for k, n in zip(key.tolist(), times.tolist()):
        want[k] += n
    assert packed.num_rows == 7 and len(np.concatenate([k for k, _ in got])) == len(want) and {a: b for k, n in got for a, b in zip(k.tolist(), n.tolist())} == want
    assert lm._packed_pairs(*lm._summed(key[:0], times[:0]), 7).num_rows == 0
    scores = []
    for held in (1 << 20, 50):
        monkeypatch.setattr(lm, "_HELD", held)
        scores.append(sorted((r.doc_id, round(r.score, 6)) for r in lm.score_texts(docs, tokens_per_shard=300, chunk_bytes=2000).collect()))
    assert scores[0] == scores[1]


def test_elias_fano_and_trie():
    r = np.random.default_rng(3)
    v = np.sort(r.choice(1 << 22, 150_000, replace=False).astype(np.uint64))
    e = lm.EliasFano(v)
    assert (e.range(0, len(v)) == v).all() and (e.range(70_001, 90_002) == v[70_001:90_002]).all() and len(e.high) + len(e.lows) < 3 * len(v)
    q = np.sort(r.integers(0, 1 << 22, 5000).astype(np.uint64))
    at = e.find(q)
    assert all((v[i] == x) if i >= 0 else x not in set(v.tolist()) for i, x in zip(at, q))
    ctx, suc = r.integers(0, 5, 4000).astype(np.uint32), r.integers(0, 40, 4000).astype(np.uint32)
    t = lm.Trie(ctx, suc, np.ones(4000), {})
    every = np.arange(40, dtype=np.uint32)
    for c in range(5):  # probabilities over the whole vocabulary add up to 1, but for quantising
        p = 10 ** t.log10(np.full(40, c, np.uint32), every, np.full(40, 1 / 40))
        assert abs(p.sum() - 1) < 0.05


def test_topk(spark):
    r = np.random.default_rng(4)
    rows = [(int(i), [float(np.float32(x)) for x in r.standard_normal(16) / 4], 0) for i in range(700)]
    rows += [(20, [0.1] * 16, 0), (21, [0.1] * 16, 0), (800, None, 0), (801, [float("nan")] * 16, 0), (802, [None] * 16, 0), (820, [5000.0] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    ok = [(i, n, np.floor(64 * np.float32(v).astype(float)).astype(np.int64)) for n, (i, v, _) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for i, n, q in ok:
        if i % 20 == 0:
            best = sorted((-int(q @ v), j, m) for j, m, v in ok if m != n)[:20]
            want += [(i, k, j, -s) for k, (s, j, _) in enumerate(best, 1)]
    assert sorted(map(tuple, topk.top_k(df, block=150, query_block=10).collect())) == sorted(want)
    assert topk.top_k(df.where("false")).count() == 0


def test_warc(spark):
    big = "<html>" + "é" * 900
    rows = [(1, "http://a", big), (2, "http://b\n", big), (3, None, big), (3, None, big), (4, "u", None), (5, "u", ""), (6, "u", "small"), (7, "u", "small"), (None, "u", big)] + [(i, f"http://x/{i}", f"<p>{i}</p>" * (i % 50)) for i in range(10, 60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha1", F.lit("clash"))
    from millrace.llm.common import new_path

    folder = new_path(spark, "t")
    back = warc.read_archives(warc.write_archives(df, folder, archive_bytes=20_000), folder).collect()
    want = collections.Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        rev = len(b) >= 1000 and h == big and i != 3
        want[(i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if rev else "response", 3 if rev else None)] += 1
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back) == want
    assert all(bytes(r.html) == ("" if r.page_id in (4, 5) else dict((i, h) for i, _, h in rows)[r.page_id]).encode() for r in back if r.html is not None)
    assert warc.read_archives(warc.write_archives(df.where("false")), folder).count() == 0


def test_warc_frames_stand_alone():
    import io
    import struct

    import zstandard

    out = io.BytesIO()
    out.close = lambda: None
    a = warc.Archive(out, 4096, 1 << 20, 3)
    recs = [warc.record(i, None, b"<p>hello %d</p>" % i * 30, "0" * 40, None, "1970-01-01T00:00:00Z") for i in range(40)]
    for r in recs:
        a.add(r)
    a.close()
    data = out.getvalue()
    magic, n = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D
    d = zstandard.ZstdCompressionDict(data[8 : 8 + n])
    rest, got = data[8 + n :], []
    while rest:
        o = zstandard.ZstdDecompressor(dict_data=d).decompressobj()
        got.append(o.decompress(rest))
        rest = o.unused_data
    assert got == recs and len(list(warc.read_records(data))) == 40


@pytest.mark.parametrize("limit", [2, 1000])
def test_suffix(docs, empty, limit):
    rows = docs.collect()
    want = collections.Counter((r.doc_id, *x) for r, x in zip(rows, suffix.brute_force([(r.text or "").encode() for r in rows])))
    got = suffix.removal(docs, segment_limit=limit).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert collections.Counter(map(tuple, got)) == want
    assert suffix.removal(empty).count() == 0


@pytest.mark.parametrize("letters", [1, 2, 4, 200])
def test_previous_factors(letters):
    """Lengths equal those of comparing every pair of windows; sources are earlier and share as much."""
    rng = np.random.default_rng(letters)
    for trial in range(60):
        n = int(rng.integers(20, 110))
        size = int(rng.integers(17, min(n, 60) + 1))
        text = rng.integers(0, letters, n).astype(np.uint8)
        if trial % 3 == 0:
            text[n // 2 :] = text[: n - n // 2]
        at = np.flatnonzero(rng.random(n - size + 1) < (1 if trial % 2 else 0.7))
        windows = [text[p : p + size].tobytes() for p in at]
        shared = [[next((k for k in range(size) if x[k] != y[k]), size) for y in windows[:i]] for i, x in enumerate(windows)]
        length, source = suffix.previous_factors(text, at, size)
        assert length.tolist() == [max(x, default=0) for x in shared]
        assert all(source[i] == -1 if not length[i] else shared[i][source[i]] == length[i] for i in range(len(at)))
        least = int(rng.integers(1, size + 1))
        cut, source = suffix.previous_factors(text, at, size, least)
        assert cut.tolist() == [x if x >= least else 0 for x in length.tolist()] and ((source >= 0) == (cut > 0)).all()
        earlier, later = suffix.factor_flags(text, at, size)
        assert earlier.tolist() == [x in windows[:i] for i, x in enumerate(windows)]
        assert later.tolist() == [x in windows[i + 1 :] for i, x in enumerate(windows)]


def test_suffix_of_two_lengths(docs, empty):
    rows = docs.collect()
    texts = [(r.text or "").encode() for r in rows]
    want = collections.Counter((r.doc_id, *x, *y[1:3]) for r, x, y in zip(rows, suffix.brute_force(texts), suffix.brute_force(texts, 240)))
    got = suffix.removal(docs, passage_len=240).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256), "n_passage_bytes", "n_passages").collect()
    assert collections.Counter(map(tuple, got)) == want
    assert suffix.removal(empty, passage_len=240).count() == 0


def test_suffix_keeps_the_first(spark):
    r = random.Random(9)
    shared = prose(120, r)
    texts = [shared, "début " + prose(30, r) + " é" + shared + "é fin", prose(100, r), None]
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    got = {x.doc_id: x for x in suffix.without_later_copies(df).collect()}
    assert got[0].text == shared and got[2].text == texts[2] and got[3].text is None
    assert shared[50:] not in got[1].text and got[1].text.startswith("début") and got[1].text.endswith("fin") and got[1].n_chars == len(got[1].text)


@pytest.mark.parametrize("limit", [2, 1000])
@pytest.mark.parametrize("repeated", [None, 1])
def test_suffix_keeps_the_first_of_repeated_rows(spark, repeated, limit):
    r = random.Random(13)
    shared = prose(120, r)
    twice, third = prose(60, r) + " " + shared + " " + prose(60, r), prose(50, r) + " " + shared + " " + prose(50, r)
    df = spark.createDataFrame([(repeated, twice), (repeated, twice), (7, third)], "doc_id long, text string")
    got = sorted((x.doc_id == 7, x.text) for x in suffix.without_later_copies(df, segment_limit=limit).collect())
    assert got[:2] == [(False, twice)] * 2 and shared[50:] not in got[2][1] and len(got[2][1]) > 400


def test_langid(docs, empty, spark):
    r = random.Random(1)
    words = {"en": ["the", "and", "with", "house"], "de": ["der", "und", "mit", "haus"], "fr": ["les", "et", "avec", "maison"]}
    rows = [(i, " ".join(r.choices(words[x], k=30)), x) for i in range(150) for x in [("en", "de", "fr")[i % 3]]]
    train = spark.createDataFrame([*rows, (900, None, "en"), (901, "the and", None), (None, "the with and", "en")], "doc_id long, text string, lang string")
    model = langid.fit(train)
    got = {x.doc_id: x for x in langid.identify(train, model).collect()}
    assert all(got[i].lang_pred == x for i, _, x in rows) and got[900].lang_pred == "und" and got[901].lang_pred == "en"
    assert all(0 <= x.score <= 1 for x in got.values())
    out = {x.doc_id: x.lang_pred for x in langid.identify(docs, model).collect()}
    assert [out[i] for i in range(4)] == ["und"] * 4 and out[4] != "und"
    assert langid.keep_identified(docs, model).columns == docs.columns
    assert langid.identify(docs, langid.fit(empty)).where("lang_pred <> 'und'").count() == 0


def test_pieces(docs, empty, spark):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    small = docs.where(F.length("text") < 1300).unionByName(spark.createDataFrame([(70, "a  b   c▁ 漢字\n\n y\tz"), (71, "     lead"), (72, None)], "doc_id long, text string"), allowMissingColumns=True)
    coded = pieces.encode(small, max_units=15)
    want = {r.doc_id: r.text for r in small.collect()}
    for r in coded.collect():
        assert list(r.ids) == p.encode(want[r.doc_id] or "")
    for r in pieces.decode(coded).collect():
        if r.doc_id != 70:
            assert r.text == (want[r.doc_id] or "")
    assert pieces.encode(empty).count() == 0


def test_pieces_are_decoded_in_the_worker_that_makes_them(spark):
    """op10 passed three Python workers a task at its end, whose memory added up."""
    df = spark.createDataFrame([(1, "Hello  wörld 🙂\nagain"), (2, None), (None, "x" * 70 + " a b"), (1, "Hello  wörld 🙂\nagain")], "doc_id long, text string")
    got = pieces.encode(df, after=pieces.decoder(), schema="doc_id long, ids array<int>, text string")
    assert sorted(map(str, got.collect())) == sorted(map(str, pieces.decode(pieces.encode(df)).collect())) and {(r.doc_id, r.text) for r in got.collect()} == {(i, t or "") for i, t in df.collect()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Exchange")[0].count("MapInArrow") == 1


def test_pieces_of_long_units(spark):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    r = random.Random(17)
    texts = ["".join(r.choices("abcdefghinoarst", k=70_000)), "x" * 40_000, "".join(r.choices("漢字中文的是不了人我在有她\u3007𠀀", k=33_000)), "short one " + "=" * 5000 + "\nend", "".join(r.choices("ABCabc0123456789+/", k=9000)) + " tail"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(list(x.ids) == p.encode(texts[x.doc_id]) for x in pieces.encode(df).collect())


def test_long_units_take_the_steps_of_the_folds(docs):
    small = docs.where(F.length("text") < 1300)
    want = sorted((r.doc_id, list(r.ids)) for r in pieces.encode(small, max_units=15).collect())
    assert want == sorted((r.doc_id, list(r.ids)) for r in pieces.encode(small, max_fold=2).collect())
    table = {"a": (1, -1.0), "b": (2, -1.0), "c": (3, -1.0), "ab": (4, -1.5), "bc": (5, -0.2)}
    assert [pieces._best_path(u, table, 2, -9.0) for u in ("abc", "ab", "zab")] == [["a", "bc"], ["ab"], ["z", "ab"]]


def test_edge_keys_of_long_units_are_longs(spark):
    words = spark.createDataFrame([("x" * 40_000,)], "unit string")
    table = spark.createDataFrame([("x", 1, -1.0)], "piece string, id int, score double")
    got = pieces._lattice(words, table, 1).select(F.size("edges").alias("n")).collect()
    assert got[0].n == 40_000


def test_units_of_bytes():
    r = random.Random(2)
    for _ in range(2000):
        texts = ["".join(r.choices(" \n▁aé漢", k=r.randint(0, 9))) for _ in range(r.randint(0, 4))]
        w = pieces.split_units([t.encode() for t in texts])
        named, at = pieces._named(w.terms).to_pylist(), 0
        for t, n in zip(texts, w.sizes.tolist()):
            assert [named[c] for c in w.codes[at : at + n]] == pieces.units(t)
            at += n


def test_parts_merge_as_their_unit():
    """op10 took every unit into the lattice whole, so a word with each mark behind it was a new one."""
    path = pieces.default_model()
    found, joins, r = pieces.vocabulary(path)["pieces"], pieces._Joins(pieces.merges(path)[1]), random.Random(5)
    words = ["".join(r.choices(["the", "tion", "Er", "é", "ßen", "ll", "$$$", "**", ",", "=", "漢", "字の", "🙂", "x", "9", "%"], k=r.randint(1, 6))) for _ in range(3000)]
    units = [pieces.BLANK * r.randint(0, 3) + w for w in words] + ["\n", pieces.BLANK * 9]
    p = pieces.split_parts(pa.array([u.replace(pieces.BLANK, " ").encode() for u in units], pa.binary()), joins)
    named, at = pieces._named(p.terms).to_pylist(), 0
    for u, n in zip(units, p.sizes.tolist()):
        parts = [named[c] for c in p.codes[at : at + n]]
        assert "".join(parts) == u and [x for q in parts for x in pieces._merged(q, found)] == pieces._merged(u, found)
        at += n
    assert len(named) < 0.8 * len(set(units))
    assert pieces.split_parts(pa.array([], pa.binary()), joins).sizes.tolist() == [] and pieces.split_parts(pa.array([b"a$", b"b"]), None).sizes.tolist() == [1, 1]


def test_one_pass_over_the_edges_is_the_fold(spark):
    path, r = pieces.default_model(), random.Random(6)
    found, late = pieces.vocabulary(path)["pieces"], pieces.merges(path)[0]
    units = sorted({pieces.BLANK * r.choice([0, 1, 1, 4]) + "".join(r.choices(["the", "er", "in", "a", "aaa", "Str", "é", "tion", "s"], k=r.randint(1, 5))) for _ in range(300)})
    lat = pieces._lattice(spark.createDataFrame([(u,) for u in units], "unit string").repartition(2), pieces.piece_table(spark, path), 16)
    both = lat.select("unit", "late", pieces._merge_fold(F.col("edges"), F.col("n")).alias("fold"), pieces._merge_pass(F.col("edges"), F.col("n")).alias("once")).collect()
    assert len(both) == len(units) and {x.late for x in both} == {True, False}
    for x in both:
        ends = np.cumsum([0, *map(len, pieces._merged(x.unit, found))])
        assert x.fold == sum(1 << int(e) for e in ends) and (x.late or x.once == x.fold)
        assert x.late == any(x.unit[a:b] in late for a in range(len(x.unit)) for b in range(a + 1, len(x.unit) + 1))


def test_viterbi_fold(spark):
    words = spark.createDataFrame([("abc",), ("ab",), ("zab",)], "unit string")
    table = spark.createDataFrame([("a", 1, -1.0), ("b", 2, -1.0), ("c", 3, -1.0), ("ab", 4, -1.5), ("bc", 5, -0.2)], "piece string, id int, score double")
    lat = pieces._lattice(words, table, 2)
    got = {r.unit: r.cuts for r in lat.withColumn("cuts", pieces._viterbi_fold(F.col("edges"), F.col("n"), 2, -9.0)).collect()}
    assert got == {"abc": 0b1011, "ab": 0b101, "zab": 0b1011}
