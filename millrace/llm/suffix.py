"""Repeated byte strings over a corpus, by longest previous factors on shared segments.

A string of min_len bytes that stands twice has the same smallest k-gram hash (its anchor) at
the same place both times. Windows of min_len bytes with one anchor form a run, about one per
140 bytes of text. Runs whose anchor occurs once hold nothing that repeats. Runs of equal
bytes fold into one segment with a count. Segments of anchors with several different
contents are gathered by anchor, and their windows put into suffix order by bytes, by prefix doubling cut at
min_len. Previous and next smaller positions in that order give each window's longest previous factor: one of
min_len is a later copy, and the window it names has one.

An anchor with more than `segment_limit` contents is not cut: its windows are halved by their
distance to the anchor, each half keyed by the bytes all its windows share, and halves of equal bytes
fold, until the groups are small.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, stash

_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.array([xxhash.xxh64_intdigest(bytes([b]), 99) for b in range(256)], np.uint64)
_POWERS: list[np.ndarray] = []
PIECE = 1 << 18  # windows handled at once; also bounds the positions packed beside a hash
_POS = np.uint64((1 << 20) - 1)


def _powers() -> list[np.ndarray]:
    if not _POWERS:
        n = PIECE + (1 << 14)
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            _POWERS.append(np.cumprod(np.array([1] + [base] * n, np.uint64), dtype=np.uint64))
    return _POWERS


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def anchor_runs(raw: bytes, min_len: int, gram: int):
    """(start, windows, anchor offset from start, anchor hash) of the runs of one text, start ascending."""
    up, down = _powers()
    for lo in range(0, len(raw) - min_len + 1, PIECE):
        part = raw[lo : lo + PIECE + min_len - 1]
        x = _TABLE[np.frombuffer(part, np.uint8)]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * up[: len(x)], dtype=np.uint64)))
        m, wide, windows = len(part) - gram + 1, min_len - gram + 1, len(part) - min_len + 1
        h = _mix((sums[gram:] - sums[:m]) * down[:m])
        key = np.concatenate(((h & ~_POS) | np.arange(m, dtype=np.uint64), np.full(-m % wide, np.uint64(_M64)))).reshape(-1, wide)
        ahead = np.minimum.accumulate(key, axis=1).ravel()
        behind = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(behind[:windows], ahead[wide - 1 : wide - 1 + windows]) & _POS).astype(np.int64)
        s = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        yield s + lo, np.diff(np.append(s, windows)), at[s] - s, h[at[s]]


def _pack_place(start, windows, offset):
    """start, windows and offset in one long; windows and offset are under 1024."""
    return (start << 20) | (windows << 10) | offset


def _start(p):
    return F.shiftright(p, 20)


def _windows(p):
    return F.shiftright(p, 10).bitwiseAND(1023)


def _offset(p):
    return p.bitwiseAND(1023)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def runs(docs: DataFrame, min_len: int, gram: int, within: DataFrame | None = None) -> DataFrame:
    """doc_id, th (hash of the text), a (anchor), c (content) and p (place) of every run; within: of windows in these spans only."""

    everywhere = within is None

    def places(batches):
        """(batch, row, text, from, to) of the stretches to look at."""
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for i, raw in enumerate(b.column(2).cast(pa.binary())):
                if everywhere:
                    yield b, i, raw.as_py(), 0, len(raw.as_py())
                else:
                    raw = unpack.decompress(raw.as_py())
                    for f, t in merge_spans([(x["f"], x["t"]) for x in b.column(3)[i].as_py()]):
                        yield b, i, raw, f, t

    def run(batches):
        for b, i, raw, f, t in places(batches):
            if t - f < min_len:
                continue
            for s, n, off, h in anchor_runs(raw[f:t], min_len, gram):
                s = s + f
                c = np.array([xxhash.xxh3_64_intdigest(raw[x : x + y + min_len - 1], z) for x, y, z in zip(s.tolist(), n.tolist(), off.tolist())], np.uint64)
                one = lambda k: pa.array([b.column(k)[i].as_py()] * len(s), pa.int64())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([one(0), one(1), pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(_pack_place(s, n, off))], ["doc_id", "th", "a", "c", "p"])

    def merged(batches):
        held, n = [], 0
        for b in run(batches):
            held.append(b)
            n += b.num_rows
            if n >= 50_000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    source = _texts(docs) if everywhere else _joined_texts(docs, within, "inner")
    return source.mapInArrow(merged, "doc_id long, th long, a long, c long, p long")


# ---- suffix order -----------------------------------------------------------------------


def _ranks(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    ordered = keys[order]
    out = np.empty(len(keys), np.uint64)
    out[order] = np.cumsum(np.concatenate(([False], ordered[1:] != ordered[:-1]))).astype(np.uint64)
    return out


def _ahead(r: np.ndarray, by: int) -> np.ndarray:
    """r moved `by` places to the front; past the end it goes on with zeros."""
    return np.concatenate((r[by:], np.zeros(min(by, len(r)), r.dtype)))


def suffix_order(text: np.ndarray, at: np.ndarray, min_len: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the windows of min_len bytes that start at `at` (ascending), by bytes and then by position, and
    the length of the prefix that each shares with the one before it in that order (0 for the first).

    Ranks of 8 bytes, read as big-endian numbers, are doubled while they fit into min_len; two that overlap give
    the order of windows, and going down through the levels gives the shared prefix.
    """
    word = text.astype(np.uint64)
    for by in (1, 2, 4):
        word = (word << np.uint64(8 * by)) | _ahead(word, by)
    levels, size = [_ranks(word)], 8
    while 2 * size <= min_len:
        levels.append(_ranks((levels[-1] << np.uint64(32)) | _ahead(levels[-1], size)))
        size *= 2
    key = (levels[-1][at] << np.uint64(32)) | levels[-1][at + (min_len - size)]
    order = np.argsort(key, kind="stable")
    equal = key[order[1:]] == key[order[:-1]]
    p, q, shared = at[order[:-1]], at[order[1:]], np.zeros(len(equal), np.int64)
    last = len(text) - 1
    for r in reversed(levels):
        shared += np.where(r[np.minimum(p + shared, last)] == r[np.minimum(q + shared, last)], size, 0)
        size //= 2
    for _ in range(7):  # within the 8 bytes that differ
        shared += text[np.minimum(p + shared, last)] == text[np.minimum(q + shared, last)]
    shared = np.where(equal, min_len, np.minimum(shared, min_len - 1))
    return order, np.concatenate((np.zeros(min(1, len(at)), np.int64), shared))


def _smaller_before(places: list[int], shared: list[int]) -> tuple[list[int], list[int]]:
    """For each place of a list the index of the nearest smaller one before it (-1: none), and the least of
    `shared` from there on, its own included (0: none)."""
    index, length, open_at = [], [], []
    for i, (p, low) in enumerate(zip(places, shared)):
        while open_at and places[open_at[-1]] > p:
            low = min(low, length[open_at.pop()])
        index.append(open_at[-1] if open_at else -1)
        length.append(low if open_at else 0)
        open_at.append(i)
    return index, length


def previous_factors(text: np.ndarray, at: np.ndarray, min_len: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """For the windows that start at `at` (ascending): the longest previous factor, at most min_len, and the index of a
    window that it starts at. Those under `least` are not wanted: 0 and -1.

    The window that starts earlier and shares most is the previous or the next smaller position in suffix order.
    Of equal windows the nearest earlier one is named, so each but the last of them is named once. Windows that
    share less than `least` with both neighbours have no such factor and are no source of one.
    """
    order, shared = suffix_order(text, at, min_len)
    shared = np.where(shared < least, 0, shared)
    inside = np.flatnonzero(np.maximum(shared, np.append(shared[1:], 0)[: len(shared)]))
    order, shared = order[inside], shared[inside]
    places = order.tolist()
    before, b_len = (np.array(x, np.int64) for x in _smaller_before(places, shared.tolist()))
    # from behind, the prefix shared with the one before is that of the place after
    after, a_len = (np.array(x, np.int64)[::-1] for x in _smaller_before(places[::-1], [0, *shared[:0:-1].tolist()]))
    after = np.where(after < 0, -1, len(places) - 1 - after)
    nearest, longest = np.where(b_len >= a_len, before, after), np.maximum(b_len, a_len)
    length, source = np.zeros(len(at), np.int64), np.full(len(at), -1)
    hit = longest > 0
    length[order[hit]] = longest[hit]
    source[order[hit]] = order[nearest[hit]]
    return length, source


def factor_flags(text: np.ndarray, at: np.ndarray, min_len: int) -> tuple[np.ndarray, np.ndarray]:
    """For the windows that start at `at` (ascending): has an earlier copy (a previous factor of min_len), has a later copy
    (it is named by such a factor)."""
    length, source = previous_factors(text, at, min_len, least=min_len)
    earlier, later = length >= min_len, np.zeros(len(at), bool)
    later[source[earlier]] = True
    return earlier, later


def flagged_spans(segments: list[bytes], min_len: int, first_only: bool):
    """(segment, from, to) of the bytes covered by windows that have another copy, or an earlier one."""
    sizes = np.array([len(s) for s in segments])
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    count = sizes - min_len + 1
    seg = np.repeat(np.arange(len(segments)), count)
    at = np.arange(count.sum()) - np.repeat(np.concatenate(([0], np.cumsum(count)[:-1])), count) + begin[seg]
    earlier, later = factor_flags(np.frombuffer(b"".join(segments), np.uint8), at, min_len)
    hit = np.flatnonzero(earlier if first_only else earlier | later)
    if not len(hit):
        return np.empty(0, int), np.empty(0, int), np.empty(0, int)
    p, g = at[hit], seg[hit]
    new = np.concatenate(([True], (g[1:] != g[:-1]) | (p[1:] > p[:-1] + min_len)))
    i = np.flatnonzero(new)
    j = np.append(i[1:], len(hit)) - 1
    return g[i], p[i] - begin[g[i]], p[j] + min_len - begin[g[i]]


_SEGMENT = "key long, a long, c long, doc_id long, th long, s long, lo0 int, lo int, g0 int, g1 int, seg binary"
_NAMES = [x.split()[0] for x in _SEGMENT.split(", ")]


def _segment_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.int32()] * 4 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], _NAMES)


def _segments(docs: DataFrame, reps: DataFrame, min_len: int, gram: int) -> DataFrame:
    """Bytes of the representative of each content: texts meet their own runs by document."""
    wanted = reps.groupBy("doc_id", "th").agg(F.collect_set(F.struct("a", "c", "p")).alias("runs"))

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            rows, n = [], 0
            for doc, th, z, todo in zip(*(b.column(i).to_pylist() for i in range(2)), b.column(2), b.column(3)):
                raw = unpack.decompress(z.as_py())
                for r in todo.as_py():
                    s, w, o = r["p"] >> 20, r["p"] >> 10 & 1023, r["p"] & 1023
                    rows.append((r["a"], r["a"], r["c"], doc, th, s, -o, -o, gram - min_len, 0, raw[s : s + w + min_len - 1]))
                    n += w + min_len
                if n > 4 << 20:
                    yield _segment_batch(rows)
                    rows, n = [], 0
            if rows:
                yield _segment_batch(rows)

    return _joined_texts(docs, wanted, "inner").mapInArrow(run, _SEGMENT)


def _joined_texts(docs: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Compressed texts joined to rows keyed by (doc_id, th)."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([pack.compress(x.as_py()) for x in b.column(2).cast(pa.binary())], pa.binary())], ["doc_id", "th", "z"])

    texts = _texts(docs).mapInArrow(run, "doc_id long, th long, z binary")
    r = right.withColumnsRenamed({"doc_id": "__d", "th": "__t"})
    return texts.join(r, (texts["th"] == r["__t"]) & texts["doc_id"].eqNullSafe(r["__d"]), how).drop("__d", "__t")


def _halved(hot: DataFrame, min_len: int) -> DataFrame:
    """Each segment as two, by the windows' distance to the anchor; keyed by the bytes all windows of a half share."""

    def run(batches):
        for b in batches:
            out = []
            for key, a, c, doc, th, s, lo0, lo, g0, g1, seg in zip(*(x.to_pylist() for x in b.columns)):
                hi, mid = lo + len(seg) - min_len, (g0 + g1) // 2
                for x, y in ((g0, mid), (mid + 1, g1)):
                    l2, h2 = max(lo, x), min(hi, y)
                    if l2 <= h2:
                        core = seg[y - lo : x + min_len - lo]
                        k = xxhash.xxh3_64_intdigest(core, (key & _M64) ^ (x & 1023) ^ ((y & 1023) << 10))
                        out.append((k - (1 << 64) if k >> 63 else k, a, c, doc, th, s, lo0, l2, x, y, seg[l2 - lo : h2 - lo + min_len]))
            if out:
                yield _segment_batch(out)

    return hot.mapInArrow(run, _SEGMENT)


def _segment_spans(segments: DataFrame, min_len: int, first_only: bool, chunk_bytes: int = 1 << 20) -> DataFrame:
    """(a, c, f, t) from suffix order; groups of one key stay together in a chunk."""

    def run(batches):
        def chunks():
            rows, n, key = [], 0, None
            for b in batches:
                for r in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 6, 7)), b.column(10)):
                    if r[0] != key and n >= chunk_bytes:
                        yield rows
                        rows, n = [], 0
                    key = r[0]
                    rows.append((*r[1:5], r[5].as_py()))
                    n += len(rows[-1][4])
            if rows:
                yield rows

        for rows in chunks():
            g, f, t = flagged_spans([r[4] for r in rows], min_len, first_only)
            if len(g):
                a, c, shift = (np.array([r[k] for r in rows], np.int64) for k in (0, 1, 2))
                shift = np.array([r[3] for r in rows], np.int64) - shift
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a[g], c[g], f + shift[g], t + shift[g])], ["a", "c", "f", "t"])

    dealt = segments.repartition(partitions(segments.sparkSession), "key").sortWithinPartitions("key", "doc_id", "th", "s")
    return dealt.mapInArrow(run, "a long, c long, f long, t long")


def _folded(halves: DataFrame) -> DataFrame:
    """Each half with n, how many of its group have the same bytes, and lead: it is the first of them."""
    place = F.struct("doc_id", "th", "s", "lo")
    keyed = halves.withColumn("h", F.xxhash64("seg"))
    groups = keyed.groupBy("key", "h").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    groups = groups.select(F.bitwise_not("key").alias("k"), F.col("h").alias("kh"), "n", "first")
    return keyed.withColumn("k", F.bitwise_not("key")).withColumnRenamed("h", "kh").join(groups, ["k", "kh"]).withColumn("lead", place.eqNullSafe(F.col("first"))).select(*_NAMES, "n", "lead")


def repeated_spans(docs: DataFrame, min_len: int = 400, gram: int = 120, first_only: bool = False, segment_limit: int = 1000, within: DataFrame | None = None) -> DataFrame:
    """(doc_id, th, spans): byte ranges, by document and hash of its text, that are covered by strings of
    min_len bytes found elsewhere too; first_only: found earlier, in the order of (doc_id, th, place).
    within: spans of the same kind for a shorter min_len, so that only they need be looked at.
    """
    if not 16 <= gram < min_len or min_len - gram >= 1000:
        raise ValueError("need 16 <= gram < min_len < gram + 1000")
    every = stash(runs(docs, min_len, gram, within), "runs")
    shared = every.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select(F.bitwise_not("a").alias("k"))
    cand = stash(every.withColumn("k", F.bitwise_not("a")).join(shared, "k", "left_semi").drop("k"), "shared")
    contents = stash(cand.groupBy("a", "c").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "p")).alias("first")), "contents")
    # anchors with several contents: their representatives go through suffix order
    mixed = contents.groupBy("a").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1" if first_only else "m > 1 and least = 1")
    reps = contents.join(mixed.select(F.bitwise_not("a").alias("k")), F.bitwise_not(contents["a"]) == F.col("k"), "left_semi").select("first.doc_id", "first.th", "a", "c", "first.p")
    segments = _segments(docs, reps, min_len, gram)
    if first_only:  # rows that repeat a doc_id and text are one document: each content has one segment, that is no copy of itself
        segments = segments.dropDuplicates(["a", "c"])
    level, found = stash(segments, "segments"), []
    while True:
        hot = level.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > segment_limit).select(F.bitwise_not("key").alias("k"))
        hot = stash(hot, "hot")
        if hot.isEmpty():
            found.append(_segment_spans(level, min_len, first_only))
            break
        keyed = level.withColumn("k", F.bitwise_not("key"))
        found.append(_segment_spans(keyed.join(hot, "k", "left_anti").drop("k"), min_len, first_only))
        # halves of equal bytes fold: all their windows repeat, and one of them goes on to meet the others
        halves = stash(_folded(_halved(keyed.join(hot, "k", "left_semi").drop("k"), min_len)), "halves")
        f = (F.col("lo") - F.col("lo0")).cast("long")
        found.append(halves.where("n > 1 and not lead" if first_only else "n > 1").select("a", "c", f.alias("f"), (f + F.octet_length("seg")).alias("t")))
        level = halves.where("lead and g0 < g1").select(*_NAMES)
    spans = found[0]
    for x in found[1:]:
        spans = spans.unionByName(x)
    spans = spans.groupBy("a", "c").agg(F.collect_list(F.struct("f", "t")).alias("part"))
    known = contents.join(spans, ["a", "c"], "left").select(F.bitwise_not("a").alias("k"), F.col("c").alias("kc"), "n", "first", "part")
    s = _start(F.col("p"))
    whole = F.array(F.struct(s.alias("f"), (s + _windows(F.col("p")) + (min_len - 1)).alias("t")))
    moved = F.transform(F.coalesce("part", F.array().cast("array<struct<f:bigint,t:bigint>>")), lambda x: F.struct((x["f"] + s).alias("f"), (x["t"] + s).alias("t")))
    lone = F.struct("doc_id", "th", "p").eqNullSafe(F.col("first")) if first_only else F.col("n") == 1
    at = cand.select("doc_id", "th", "p", F.bitwise_not("a").alias("k"), F.col("c").alias("kc")).join(known, ["k", "kc"])
    got = at.select("doc_id", "th", F.when(lone, moved).otherwise(whole).alias("spans")).where(F.size("spans") > 0)
    return got.groupBy("doc_id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for f, t in sorted(spans):
        if out and f <= out[-1][1]:
            out[-1][1] = max(out[-1][1], t)
        else:
            out.append([f, t])
    return [(f, t) for f, t in out]


def _without(raw: bytes, cut: list[tuple[int, int]]) -> bytes:
    edges = [0, *itertools.chain.from_iterable(cut), len(raw)]
    return b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))


def removal(docs: DataFrame, min_len: int = 400, gram: int = 120, passage_len: int | None = None, passage_gram: int = 80, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes that stay) and spans (merged) of every row.

    With passage_len (under min_len) also n_passage_bytes and n_passages: what strings of that many bytes that
    start elsewhere too would cover. They are found first, and min_len is looked for within them alone.
    Null texts are empty; texts under min_len bytes lose nothing. Rows that repeat a doc_id and
    text are judged alike: with first_only they count as one document, else as copies of each
    other. Other columns are not read.
    """
    shorter = passage_len is not None
    if shorter:
        found = stash(repeated_spans(docs, passage_len, passage_gram, **options), "passages")
        spans = repeated_spans(docs, min_len, gram, within=found, **options).withColumnsRenamed({"doc_id": "__i", "th": "__h"})
        spans = found.withColumnRenamed("spans", "short").join(spans, (F.col("th") == F.col("__h")) & F.col("doc_id").eqNullSafe(F.col("__i")), "left").select("doc_id", "th", "spans", "short")
    else:
        spans = repeated_spans(docs, min_len, gram, **options)
    names = ["doc_id", "th", "n_bytes", "n_removed", "n_spans", "kept", "spans"] + ["n_passage_bytes", "n_passages"] * shorter

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            sizes, cuts, kept = [], [], []
            for z, s in zip(b.column(2), b.column(3)):
                raw = unpack.decompress(z.as_py())
                cut = merge_spans([(x["f"], x["t"]) for x in s.as_py() or ()])
                sizes.append(len(raw))
                cuts.append(cut)
                kept.append(_without(raw, cut))
            total = lambda found: [pa.array([sum(t - f for f, t in c) for c in found], pa.int64()), pa.array([len(c) for c in found], pa.int64())]
            out = [b.column(0), b.column(1), pa.array(sizes, pa.int64()), *total(cuts), pa.array(kept, pa.binary()), pa.array([[{"f": f, "t": t} for f, t in c] for c in cuts], pa.list_(pa.struct([("f", pa.int64()), ("t", pa.int64())])))]
            if shorter:
                out += total([merge_spans([(x["f"], x["t"]) for x in s.as_py() or ()]) for s in b.column(4)])
            yield pa.RecordBatch.from_arrays(out, names)

    schema = "doc_id long, th long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<f:long,t:long>>" + ", n_passage_bytes long, n_passages long" * shorter
    return _joined_texts(docs, spans, "left").mapInArrow(run, schema)


def without_later_copies(docs: DataFrame, **options) -> DataFrame:
    """docs with the later copies of repeated strings cut out of text; n_chars (where there is one) follows.

    The first copy stays, in the order of doc_id. Cuts are moved inwards to whole characters.
    Documents stay even if little of them is left; all columns come back.
    """
    spans = repeated_spans(docs, first_only=True, **options).withColumnsRenamed({"doc_id": "__d", "th": "__t", "spans": "__spans"})
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumn("__h", F.xxhash64(text))
    joined = keyed.join(spans, (F.col("__h") == F.col("__t")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__d")), "left")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, parts: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(texts, parts):
            if s is None or t is None or not len(s):
                out.append(t)
                continue
            raw = t.encode()
            whole = []
            for f, e in merge_spans([(x["f"], x["t"]) for x in s]):
                while f < e and raw[f] & 0xC0 == 0x80:
                    f += 1
                while e > f and e < len(raw) and raw[e] & 0xC0 == 0x80:
                    e -= 1
                whole.append((f, e))
            out.append(_without(raw, whole).decode())
        return pd.Series(out, dtype=object)

    out = joined.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text").cast("string")).otherwise(cut(F.col("text").cast("string"), F.col("__spans"))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


#: Under the length of any passage of over 50 words, about 5 bytes each at least.
PASSAGE = {"min_len": 240, "gram": 80}


def query(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for strings of 400 bytes, and beside them what repeated passages of over 50 words cover, which may be shorter."""
    from .common import documents

    got = removal(documents(spark, sf_dir), passage_len=PASSAGE["min_len"], passage_gram=PASSAGE["gram"])
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage_bytes", "n_passages")


def brute_force(texts: list[bytes], min_len: int = 400) -> list[tuple[int, int, int, str]]:
    """What query() returns, by counting every string: for tests on small tables."""
    seen: dict[bytes, int] = {}
    digest = lambda x: hashlib.blake2b(x, digest_size=16).digest()
    marks = [[digest(t[i : i + min_len]) for i in range(len(t) - min_len + 1)] for t in texts]
    for m in marks:
        for h in m:
            seen[h] = seen.get(h, 0) + 1
    out = []
    for t, m in zip(texts, marks):
        cut = merge_spans([(i, i + min_len) for i, h in enumerate(m) if seen[h] > 1])
        out.append((len(t), sum(b - a for a, b in cut), len(cut), hashlib.sha256(_without(t, cut)).hexdigest()))
    return out
