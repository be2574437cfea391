"""MinHash near-dedup with SuperMinHash signatures.

A document's set is its distinct word shingles, each a 64-bit hash mixed from its words' XXH64.
Step j of SuperMinHash gives each element a random place of a permutation of its own and the value
j + r; a component keeps the smallest value it gets. Steps stop once every component has a value
below the next step's, so long texts take two or three, not one per component, and the
components vary less than independent ones.

Equal sets fold into one node first. Signatures are cut into bands; nodes that agree on a band
share a bucket. With 32 bands of 4, a pair at similarity 0.85 shares no bucket with odds of 6e-11.
Every member is verified on the full sets against its bucket's first node; accepted links are
grouped by union-find (in each task, then over all). A bucket whose members then lie in one group has no more to
give. In the others, all members of different groups are compared on full sets: in one task
where their texts are small together, else block by block, so that no task holds a whole
bucket and none emits more than a spanning forest.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, documents, partitions, stash
from .simhash import _mix
from .words import chunks, split

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 40) - 1)
UNSET = np.uint64((1 << 64) - 1)


# ---- sets and signatures --------------------------------------------------------------------


def sets(texts: list[bytes], size: int = 3) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; the whole word sequence as one where it is shorter than a shingle."""
    got = split(texts)
    words = np.fromiter((xxhash.xxh64_intdigest(t.as_py()) for t in got.terms), np.uint64, len(got.terms))[got.codes]
    ends = np.cumsum(got.sizes)
    with np.errstate(over="ignore"):
        shingle = _mix(words[: max(0, len(words) - size + 1)] + _GOLD)
        for i in range(1, size):
            shingle = _mix(shingle * _GOLD + words[i : len(words) - size + 1 + i])
        out = []
        for n, end in zip(got.sizes.tolist(), ends.tolist()):
            if n >= size:
                s = np.sort(shingle[end - n : end - size + 1])
                out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
            elif n == 0:
                out.append(np.empty(0, np.uint64))
            else:
                h = np.uint64(n)
                for w in words[end - n : end]:
                    h = _mix(h * _GOLD + w)
                out.append(np.array([h], np.uint64))
    return out


def signatures(elements: list[np.ndarray], m: int = 128) -> np.ndarray:
    """SuperMinHash signatures, one row a set: step number in the high bits, 40 random bits below. UNSET for an empty set."""
    count = len(elements)
    sig = np.full(count * m, UNSET)
    sizes = np.fromiter(map(len, elements), np.int64, count)
    el = np.concatenate(elements) if count else np.empty(0, np.uint64)
    own = np.repeat(np.arange(count), sizes)
    places, moved = [], []  # the swaps of each element's permutation so far
    for j in range(m):
        if not len(el):
            break
        with np.errstate(over="ignore"):
            u = _mix(el + np.uint64(j + 1) * _GOLD)
        k = (j + ((u >> np.uint64(40)).astype(np.int64) * (m - j) >> 24)).astype(np.int16)

        def at(x):
            """What stands at place x of each permutation after the swaps of the earlier steps."""
            v = x.copy()
            for p, w in zip(places, moved):
                np.copyto(v, w, where=p == x)
            return v

        np.minimum.at(sig, own * m + at(k), (np.uint64(j) << np.uint64(40)) | (u & _LOW))
        moved.append(at(np.full(len(el), j, np.int16)))
        places.append(k)
        on = (sig.reshape(count, m).max(axis=1) >> np.uint64(40) > np.uint64(j))[own]
        if not on.all():
            el, own = el[on], own[on]
            places, moved = [p[on] for p in places], [w[on] for w in moved]
    return sig.reshape(count, m)


def band_keys(sig: np.ndarray, rows: int = 4) -> np.ndarray:
    """One 64-bit key for each band of `rows` components."""
    parts = sig.reshape(len(sig), -1, rows)
    with np.errstate(over="ignore"):
        h = np.arange(1, parts.shape[1] + 1, dtype=np.uint64)[None, :] * _GOLD
        for r in range(rows):
            h = _mix(h * _GOLD + parts[:, :, r])
    return h


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct hashes."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(b, a)
    both = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("th"), text.alias("text"))


def prints(docs: DataFrame, size: int = 3, bands: int = 32, rows: int = 4) -> DataFrame:
    """doc_id, th (digest of the text), digest (of the set, null if empty), n (set size) and bands of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in chunks(batches, 2, size=2 << 20, rows=1 << 11):
            found = sets(texts, size)
            keys = band_keys(signatures(found, bands * rows), rows).view(np.int64)
            n = np.fromiter(map(len, found), np.int64, len(found))
            digest = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in found], pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), digest, pa.array(n), lists], ["doc_id", "th", "digest", "n", "bands"])

    return _texts(docs).mapInArrow(run, "doc_id long, th binary, digest binary, n long, bands array<long>")


# ---- links ------------------------------------------------------------------------------------


class Forest:
    """Union-find over the links of one task: a link inside a group is not passed on."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def leader_links(pairs: DataFrame, texts: DataFrame, size: int, percent: int, per_task: int = 256) -> DataFrame:
    """Links (u, v) among pairs(leader, node), on full sets. A leader with many nodes is dealt over many groups."""
    spark = pairs.sparkSession
    many = pairs.groupBy("leader").agg(F.ceil(F.count("*") / per_task).cast("int").alias("salts"))
    dealt = pairs.join(many, "leader").withColumn("salt", F.pmod(F.xxhash64("node"), "salts").cast("int"))
    follow = dealt.join(texts, "node").select("leader", "salt", F.lit(1).alias("role"), "node", "text")
    lead = dealt.select("leader", "salt").distinct().join(texts.withColumnRenamed("node", "leader"), "leader").select("leader", "salt", F.lit(0).alias("role"), F.col("leader").alias("node"), "text")
    rows = lead.unionByName(follow).repartition(partitions(spark), "leader", "salt").sortWithinPartitions("leader", "salt", "role")

    def run(batches):
        now, mine, forest = None, None, Forest()
        for b, raw in chunks(batches, 4, size=4 << 20):
            found = []
            for leader, role, node, s in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), sets(raw, size)):
                if role == 0:
                    now, mine = leader, s
                elif leader == now and similar(mine, s, percent) and forest.join(leader, node):
                    found.append((node, leader))
            if found:
                yield _edges(found)

    return rows.mapInArrow(run, "u long, v long")


def links_between(nodes: list[int], groups: list[int], found: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between nodes of different groups, a spanning forest of them, through postings of the sets' elements."""
    forest, out = Forest(), []
    index = {x: i for i, x in enumerate(nodes)}
    first: dict[int, int] = {}
    for x, g in zip(nodes, groups):
        forest.join(index[first.setdefault(g, x)], index[x])
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    owner = np.repeat(np.arange(len(found)), sizes)
    values, codes = np.unique(np.concatenate(found), return_inverse=True)
    order = np.argsort(codes, kind="stable")
    post, starts = owner[order], np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=len(values)))))
    ends = np.concatenate(([0], np.cumsum(sizes)))
    held: dict[int, int] = {}
    for i in range(len(nodes)):
        held[forest.find(i)] = held.get(forest.find(i), 0) + 1
    most = max(held, key=held.get)  # nodes outside the largest group look for partners; all links between groups have such an end
    for i in [i for i in range(len(nodes)) if forest.find(i) != most]:
        mine = codes[ends[i] : ends[i + 1]]
        spans = starts[mine + 1] - starts[mine]
        at = np.repeat(starts[mine] - np.concatenate(([0], np.cumsum(spans)[:-1])), spans) + np.arange(spans.sum())
        both = np.bincount(post[at], minlength=len(nodes))
        for y in np.flatnonzero(100 * both >= percent * (sizes[i] + sizes - both)).tolist():
            if y != i and forest.join(i, y):
                out.append((nodes[i], nodes[y]))
    return out


def bucket_links(rows: DataFrame, texts: DataFrame, size: int, percent: int, block_bytes: int = 6 << 20) -> DataFrame:
    """Links between members of different groups of the same bucket. rows(key, node, grp).

    A bucket with more than block_bytes of text is dealt into blocks, and pairs of blocks are compared.
    """
    spark = rows.sparkSession
    sized = rows.join(texts.select("node", F.octet_length("text").alias("bytes")), "node")
    many = sized.groupBy("key").agg(F.ceil(F.sum("bytes") / block_bytes).cast("int").alias("blocks"))
    own = rows.join(many, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.greatest("blocks", F.lit(1))).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest("blocks", F.lit(1)) - 1)))
    dealt = dealt.select("node", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "grp")
    ready = dealt.join(texts, "node").select("key", "i", "j", "node", "grp", "text").repartition(partitions(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches):
        now, nodes, groups, raw = None, [], [], []

        def links():
            return links_between(nodes, groups, sets(raw, size), percent) if len(set(groups)) > 1 else []

        for b, texts in chunks(batches, 5):
            for *key, node, grp, text in zip(*(b.column(i).to_pylist() for i in range(5)), texts):
                if key != now:
                    if found := links():
                        yield _edges(found)
                    now, nodes, groups, raw = key, [], [], []
                nodes.append(node)
                groups.append(grp)
                raw.append(text)
        if found := links():
            yield _edges(found)

    return ready.mapInArrow(run, "u long, v long")


def near_groups(docs: DataFrame, size: int = 3, percent: int = 85, bands: int = 32, rows: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Rows link where percent * union <= 100 * intersection of their sets. component_id is the smallest
    doc_id reachable. Texts without words, or null, have an empty set and link with nothing: each is its own component.
    Repeated rows stay rows, with the same component. A null doc_id links through its text and is never a component_id,
    unless no member has a doc_id, where component_id is null; kept means that doc_id and component_id are the same, null or not.
    Ties do not matter, as the smallest id leads. Other columns are not read; an empty table gives an empty result.
    """
    got = stash(prints(docs, size, bands, rows), "prints")
    once = got.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "th")).alias("row"), F.first("bands").alias("bands"))
    nodes = stash(once.select(F.monotonically_increasing_id().alias("node"), "digest", "first_id", "row", "bands"), "nodes")

    banded = nodes.select("node", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("members")).where("members > 1")
    # both sides are exchanged, so adaptive execution can split a hot bucket
    member = banded.withColumn("k", F.bitwise_not("key")).join(shared.select(F.bitwise_not("key").alias("k"), "leader", "members"), "k")
    buckets = stash(member.select("key", "node", "leader", "members"), "buckets")

    wanted = buckets.select("node").distinct().join(nodes.select("node", F.col("row.doc_id").alias("id"), F.col("row.th").alias("th")), "node")
    found = _texts(docs).withColumnRenamed("th", "t").join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("t") == F.col("th")))
    texts = stash(found.groupBy("node").agg(F.first("text").alias("text")), "texts")

    pairs = stash(buckets.where("node <> leader").select("leader", "node").distinct(), "pairs")
    first = stash(leader_links(pairs, texts, size, percent), "links")
    grouped = buckets.where("members > 2").join(components(first), "node", "left").select("key", "node", F.coalesce("root", "node").alias("grp"))
    grouped = stash(grouped, "grouped")
    open_ = grouped.groupBy("key").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("lo <> hi")
    open_ = open_.groupBy("lo", "hi", "c", "x", "y").agg(F.min("key").alias("key")).select("key")  # buckets of the same members count once
    rest = stash(bucket_links(stash(grouped.join(open_, "key"), "open"), texts, size, percent), "links")

    roots = components(first.unionByName(rest))
    named = stash(nodes.join(roots, "node", "left").select("digest", "first_id", F.coalesce("root", "node").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = named.select("digest", "root").join(least, "root").select(F.col("digest").alias("d"), "component_id")
    out = got.select("doc_id", "digest", "n").join(classes, F.col("digest") == F.col("d"), "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))


@functools.cache
def sql() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
l AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), r AS (
  SELECT doc_id AS u, doc_id AS v FROM documents
  UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u
), c AS (SELECT u, min(v) AS component_id FROM r GROUP BY u)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN c ON s.doc_id = c.u
"""
