"""SimHash near-duplicate groups by generalised pigeonhole search.

Fingerprints are 64 majority bits over the XXH64 of word shingles. Equal fingerprints
fold into one node first. The bits are grouped into correlated parts; a dynamic program
gives each part a threshold t (-1: the part is not probed) so that the thresholds add up
to max_bits - parts + 1, which proves that any two nodes within max_bits agree on some part
up to its t bits. The estimates come from all nodes: pairs equal on a part (from exact
value counts) times the odds of differing in up to t of its bits (from exact bit counts).
A probe key is the part's value with t bits masked out, so both sides of a link meet in
one bucket. A bucket over `bucket_limit` nodes is not cut: it is probed again on the bits it
does not share yet (four quarters, one of which must agree), until it is small or at most
2**18 different nodes are possible. Buckets give spanning forests, not all pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, partitions, stash

LEAST_FREE_BITS = 18


def fingerprint(raw: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Majority bits of the hashes of all word shingles, repeats included; 0 for no words."""
    words = raw.lower().split()
    if not words:
        return 0
    n = len(words) - shingle + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    total = np.zeros(64, np.int64)
    for lo in range(0, n, 65536):
        hi = min(n, lo + 65536)
        h = np.array([digest(joined[s:e], seed) for s, e in zip(starts[lo:hi].tolist(), ends[lo + shingle - 1 : hi + shingle - 1].tolist())], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long) of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(1).cast(pa.binary())
            fp = np.fromiter((fingerprint(x.as_py() or b"", shingle, seed) for x in raw), np.uint64, len(raw))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


# ---- parts and thresholds ---------------------------------------------------------------


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of nodes and the 64 x 64 counts of bits set together, summed on the executors."""

    def run(batches):
        n, m = 0, np.zeros((64, 64))
        for b in batches:
            fp = np.asarray(b.column(0)).view(np.uint8).reshape(-1, 8)
            for lo in range(0, len(fp), 65536):
                bits = np.unpackbits(fp[lo : lo + 65536], axis=1, bitorder="little").astype(np.float32)
                m += bits.T @ bits
            n += len(fp)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(4097), pa.int32()), pa.array([n, *m.ravel().astype(np.int64).tolist()])], ["i", "n"])

    got = dict(nodes.select("fp").mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n")).collect())
    return got.get(0, 0), np.array([got.get(i, 0) for i in range(1, 4097)], float).reshape(64, 64)


def correlated_parts(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m parts of near-equal width; each grows from its most correlated free pair."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    phi = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(phi, -1)
    free, parts = list(range(64)), []
    for k in range(m):
        width = (64 - sum(map(len, parts))) // (m - k)
        sub = phi[np.ix_(free, free)]
        i, j = np.unravel_index(np.argmax(sub), sub.shape)
        part = [free[i], free[j]] if i != j else free[:2]
        rest = [b for b in free if b not in part]
        while len(part) < width:
            best = max(rest, key=lambda b: (phi[b, part].sum(), -b))
            part.append(best)
            rest.remove(best)
        parts.append(sorted(part))
        free = rest
    return parts


def mask_of(bits) -> int:
    return sum(1 << int(b) for b in bits)


def value_pairs(nodes: DataFrame, masks: list[int]) -> list[float]:
    """For each mask, the number of ordered node pairs that agree on it: exact value counts, squared and summed."""

    def run(batches):
        for b in batches:
            fp = np.asarray(b.column(0)).view(np.uint64)
            for i, m in enumerate(masks):
                v, c = np.unique(fp & np.uint64(m), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, np.int32)), pa.array(v.view(np.int64)), pa.array(c)], ["i", "v", "n"])

    rows = nodes.select("fp").mapInArrow(run, "i int, v long, n long").groupBy("i", "v").agg(F.sum("n").alias("n")).groupBy("i").agg(F.sum(F.col("n").cast("double") * F.col("n"))).collect()
    got = dict(rows)
    return [got.get(i, 0.0) for i in range(len(masks))]


def allocate(n: int, p: np.ndarray, parts: list[list[int]], pairs: list[float], max_bits: int, key_cost: float = 40.0) -> tuple[float, list[int]]:
    """Thresholds per part by dynamic programming over (part, sum so far); cost in pair checks."""
    total = max_bits - len(parts) + 1
    q = p * p + (1 - p) * (1 - p)
    odds = (1 - q) / np.maximum(q, 1e-9)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part, same in zip(parts, pairs):
        sym = [1.0] + [0.0] * max_bits  # elementary symmetric sums of the odds
        for b in part:
            for t in range(max_bits, 0, -1):
                sym[t] += sym[t - 1] * odds[b]
        cost = {-1: 0.0} | {t: key_cost * n * math.comb(len(part), t) + same * sum(sym[: t + 1]) for t in range(max_bits + 1) if t <= len(part)}
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, x in cost.items():
                if s + t not in nxt or c + x < nxt[s + t][0]:
                    nxt[s + t] = (c + x, [*ts, t])
        best = nxt
    return best[total]


def probe_masks(parts: list[list[int]], thresholds: list[int]) -> list[tuple[int, int]]:
    """(key number, bits kept) of every probe: the part with each choice of t bits masked out."""
    out = []
    for part, t in zip(parts, thresholds):
        if t >= 0:
            out += [(len(out) + i, mask_of(set(part) - set(drop))) for i, drop in enumerate(itertools.combinations(part, t))]
    return out


# ---- buckets ----------------------------------------------------------------------------

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _key(number: np.ndarray | int, value: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(_mix(np.uint64(1) + np.asarray(number, np.uint64) * _MIX) ^ value)


def _forest(fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, first member of its group) of the links within one bucket, by breadth-first search."""
    left, a, b = np.arange(len(fp)), [], []
    while len(left) > 1:
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            near = np.bitwise_count(fp[left] ^ fp[queue.pop()]) <= max_bits
            if near.any():
                hit, left = left[near], left[~near]
                queue += hit.tolist()
                a.append(hit)
                b.append(np.full(len(hit), root))
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, int), np.empty(0, int))


def _groups(key, fp, free, node, max_bits: int, limit: int):
    """Edges of sorted, complete buckets, and the sub-probes of those over the limit."""
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(cut, len(key)))
    u, v, hot = [], [], []
    small = np.repeat(size, size) <= 32
    for s in range(1, int(size[size <= 32].max(initial=1))):
        i = np.flatnonzero((key[s:] == key[:-s]) & small[s:])
        i = i[np.bitwise_count(fp[i + s] ^ fp[i]) <= max_bits]
        u.append(node[i + s])
        v.append(node[i])
    for at, n in zip(cut[size > 32].tolist(), size[size > 32].tolist()):
        x = slice(at, at + n)
        bits = [b for b in range(64) if int(free[at]) >> b & 1]
        if n <= limit or len(bits) <= LEAST_FREE_BITS:
            i, j = _forest(fp[x], max_bits)
            u.append(node[x][i])
            v.append(node[x][j])
            continue
        for k in range(max_bits + 1):
            own = np.uint64(mask_of(bits[k :: max_bits + 1]))
            hot.append((_key(_mix(key[x] + np.uint64(k + 1)), fp[x] & own), fp[x], free[x] & ~own, node[x]))
    edges = (np.concatenate(u), np.concatenate(v)) if u else (np.empty(0, np.int64),) * 2
    return edges, [np.concatenate(c) for c in zip(*hot)] if hot else None


def bucket_edges(probes: DataFrame, max_bits: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """One probing level: (edges, probes of the next level)."""

    def run(batches):
        held = None
        for b in itertools.chain(batches, [None]):
            if b is not None:
                cols = [np.asarray(b.column(i)).view(t) for i, t in enumerate((np.uint64, np.uint64, np.uint64, np.int64))]
                held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
                if not len(held[0]) or held[0][0] == held[0][-1]:
                    continue
                end = int(np.flatnonzero(held[0] != held[0][-1])[-1]) + 1
            elif held is None:
                return
            else:
                end = len(held[0])
            whole, held = [c[:end] for c in held], [c[end:] for c in held]
            if not len(whole[0]):
                continue
            (u, v), hot = _groups(*whole, max_bits, limit)
            z = lambda n: pa.nulls(n, pa.int64())
            if len(u):
                yield pa.RecordBatch.from_arrays([z(len(u)), z(len(u)), pa.array(u), pa.array(v)], ["key", "fp", "a", "b"])
            if hot:
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in hot], ["key", "fp", "a", "b"])

    out = stash(probes.repartition(partitions(probes.sparkSession), "key").sortWithinPartitions("key").mapInArrow(run, "key long, fp long, a long, b long"), "links")
    return out.where("key is null").select(F.col("a").alias("u"), F.col("b").alias("v")), out.where("key is not null").select("key", "fp", F.col("a").alias("free"), F.col("b").alias("node"))


def links(nodes: DataFrame, max_bits: int = 3, bucket_limit: int = 2048) -> DataFrame:
    """Edges whose components equal those of all node pairs within max_bits. nodes(fp, node)."""
    n, both = bit_statistics(nodes)
    p = np.diag(both) / max(n, 1)
    plans = [correlated_parts(n, both, m) for m in range(2, max_bits + 2)]
    pairs = value_pairs(nodes, [mask_of(part) for parts in plans for part in parts])
    choice, at = [], 0
    for parts in plans:
        choice.append((*allocate(n, p, parts, pairs[at : at + len(parts)], max_bits), parts))
        at += len(parts)
    _, thresholds, parts = min(choice, key=lambda x: x[0])
    probes = probe_masks(parts, thresholds)
    every = (1 << 64) - 1

    def probe(batches):
        for b in batches:
            fp, node = np.asarray(b.column(0)).view(np.uint64), np.asarray(b.column(1))
            for k, m in probes:
                free = np.full(len(fp), np.uint64(every & ~m))
                yield pa.RecordBatch.from_arrays([pa.array(_key(k, fp & np.uint64(m)).view(np.int64)), pa.array(fp.view(np.int64)), pa.array(free.view(np.int64)), pa.array(node)], ["key", "fp", "free", "node"])

    level, found = nodes.select("fp", "node").mapInArrow(probe, "key long, fp long, free long, node long"), None
    while True:
        edges, hot = bucket_edges(level, max_bits, bucket_limit)
        found = edges if found is None else found.unionByName(edges)
        if hot.isEmpty():
            return found
        level = hot


def near_groups(docs: DataFrame, shingle: int = 3, seed: int = 42, max_bits: int = 3, bucket_limit: int = 2048) -> DataFrame:
    """(doc_id, fp, component_id) of every row.

    component_id is the smallest doc_id reachable over links of max_bits or fewer differing
    bits. Null and empty texts have fingerprint 0 and link like any other; repeated rows get
    the same class; rows without doc_id link through their fingerprint but never name a component, so
    component_id is null where no member has a doc_id. Other columns of the input are not read.
    An empty table gives an empty result.
    """
    prints = stash(fingerprints(docs, shingle, seed), "prints")
    nodes = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")).withColumn("node", F.col("fp")), "nodes")
    roots = components(links(nodes, max_bits, bucket_limit))
    named = stash(nodes.join(roots, "node", "left").select("fp", "first_id", F.coalesce("root", "node").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = named.join(least, "root").select(F.bitwise_not("fp").alias("k"), "component_id")
    return prints.withColumn("k", F.bitwise_not("fp")).join(classes, "k", "left").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows whose doc_id leads its near-duplicate group; of rows with one doc_id and text one stays.

    All columns of the input come back as they are. Rows with one doc_id but different texts all stay, since
    the group does not say which to drop. A row without doc_id is kept.
    """
    first = near_groups(docs, **options).where("doc_id = component_id").select(F.col("doc_id").alias("__keep")).distinct()
    named = docs.where("doc_id is not null")
    kept = named.join(first, F.col("doc_id") == F.col("__keep"), "left_semi").withColumn("__text", F.xxhash64("text")).dropDuplicates(["doc_id", "__text"]).drop("__text")
    return kept.unionByName(docs.where("doc_id is null"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    got = near_groups(documents(spark, sf_dir))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
