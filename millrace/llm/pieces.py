"""SentencePiece encoding and decoding as a relational lattice.

Texts fall into units no piece crosses (runs of blanks with what follows, up to the next blank
or line end). A unit's substrings of bounded length are exploded
and equi-joined to the piece table, the edges found are grouped by unit, and a fold over the
lattice with the SQL function aggregate picks the pieces. For a unigram model the fold is
Viterbi. The scores of a BPE model are merge ranks, on which Viterbi gives other pieces than
the model's; there the fold merges the adjacent pairs by the scores of their edges. A piece is
made of one pair only; where every piece ranks behind the two it is made of, one pass over the
edges by rank is the fold, and units with a piece that doesn't are merged step by step.
Under a BPE model units are cut once more, into parts: between two characters where no pair
meets that makes a piece, no merge can reach over. What follows holds for parts as for units.
Frequent units (at most `max_units`) are encoded once and reach the texts by broadcast. The others
are encoded per document: dealt by document first, so that edges and pieces are grouped where they are made
and only the units and the compressed texts are shuffled. The cuts of a unit are the bits of a long, so units
over `max_fold` characters (texts without blanks) take the same steps from a heap, where the
texts are put together.
"""

from __future__ import annotations

import heapq
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, stash
from .words import Words, chunks

BLANK = "▁"
UNIT = re.compile(f"{BLANK}+[^{BLANK}\\n]*|[^{BLANK}\\n]+|\\n")
WIDE = 1 << 32  # start * WIDE + end is a long
CHUNK = 2 << 20  # bytes of texts taken at once
MAX_FOLD = 60  # cuts of a unit are bits 0 to 60 of a long


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@cache
def vocabulary(path: str) -> dict:
    """pieces (piece -> id, score), ids of the 256 bytes, the unknown id, and the bytes of each id."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    plain, raw, byte_ids = {}, [], [p.unk_id()] * 256
    for i in range(p.vocab_size()):
        piece = p.id_to_piece(i)
        if p.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            raw.append(bytes([int(piece[3:5], 16)]))
        elif p.is_control(i) or p.is_unknown(i) or p.is_unused(i):
            raw.append(b"" if p.is_control(i) else " ⁇ ".encode())
        else:
            plain[piece] = (i, p.get_score(i))
            raw.append(piece.replace(BLANK, " ").encode())
    if any(BLANK in x.lstrip(BLANK) or "\n" in x and len(x) > 1 for x in plain):
        raise ValueError("pieces of this model cross units")
    return {"pieces": plain, "bytes": byte_ids, "unknown": p.unk_id(), "raw": raw, "longest": max(map(len, plain))}


def units(text: str) -> list[str]:
    """Units of a text, in order; an empty text has none."""
    return UNIT.findall(BLANK + text.replace(" ", BLANK)) if text else []


def _made_of(piece: str, pieces: dict) -> list[str]:
    """The symbols, two at most, that the merges of a BPE model leave of a piece before the last one; more if they never make it.

    Where a piece is made inside a text, the same merges have gone before it, so it is made of no other pair."""
    got = list(piece)
    while len(got) > 2:
        ranks = [(-pieces[x][1], a) for a in range(len(got) - 1) if (x := got[a] + got[a + 1]) in pieces]
        if not ranks:
            break
        a = min(ranks)[1]
        got[a : a + 2] = [got[a] + got[a + 1]]
    return got


@cache
def merges(path: str) -> tuple[set[str], set[str]]:
    """Of a BPE model the late pieces, which don't rank behind both symbols they are made of, and the pairs of characters that meet where a piece is made."""
    pieces = vocabulary(path)["pieces"]
    made = {p: m for p in pieces if len(m := _made_of(p, pieces)) == 2}
    late = {p for p, m in made.items() if any(len(x) > 1 and pieces[x][1] <= pieces[p][1] for x in m)}
    return late, {a[-1] + b[0] for a, b in made.values()}


class _Joins:
    """Pairs of characters between which a unit is not cut, by the classes of both; class 0 joins with none."""

    def __init__(self, pairs: set[str]):
        chars = sorted({c for p in pairs for c in p})
        self.classes, self.open = np.zeros(0x110000, np.uint16), np.zeros((len(chars) + 1,) * 2, bool)
        self.classes[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.classes[ord(" ")] = self.classes[ord(BLANK)]
        for a, b in pairs:
            self.open[self.classes[ord(a)], self.classes[ord(b)]] = True


def piece_table(spark: SparkSession, path: str, kind: str = "bpe") -> DataFrame:
    late = merges(path)[0] if kind == "bpe" else ()
    rows = [(piece, i, float(score), piece in late) for piece, (i, score) in vocabulary(path)["pieces"].items()]
    return spark.createDataFrame(rows, "piece string, id int, score double, late boolean")


def _lattice(words: DataFrame, table: DataFrame, longest: int) -> DataFrame:
    """words(unit, ...) with n (characters), edges: (rank, s, e, id, ends, inner), the best-scored first, then the leftmost,
    and late: whether one of them is a late piece. ends and inner are the cuts at the ends of an edge and between them, as bits.

    The pieces are few and broadcast, so units stay where they are: a partitioning of words by
    any of its columns holds through the grouping, and edges are not shuffled.
    """
    keys, n = words.columns, F.length("unit")
    table = table if "late" in table.columns else table.withColumn("late", F.lit(False))
    starts = words.select(*keys, n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("s"))
    spans = starts.select(*keys, "s", F.explode(F.sequence(F.col("s") + 1, F.least(F.col("s") + longest, "n"))).alias("e"))
    spans = spans.withColumn("piece", F.expr("substring(unit, s + 1, e - s)"))
    # one row of each unit stays even where no piece fits; collect_list leaves its null out
    hits = spans.join(F.broadcast(table), "piece", "left").where("id is not null or (s = 0 and e = 1)")
    edge = F.struct((-F.col("score")).alias("rank"), "s", "e", "id", (_bit(F.col("s")) + _bit(F.col("e"))).alias("ends"), (_bit(F.col("e")) - _bit(F.col("s") + 1)).alias("inner"))
    grouped = hits.select(*keys, "late", F.when(F.col("id").isNotNull(), edge).alias("x")).groupBy(*keys).agg(F.collect_list("x").alias("xs"), F.coalesce(F.bool_or("late"), F.lit(False)).alias("late"))
    return grouped.select(*keys, F.length("unit").alias("n"), F.sort_array("xs").alias("edges"), "late")


def _bit(i):
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def _is_pair(cuts, x):
    """An edge is a pair of neighbours if its ends are cuts and one cut lies between."""
    return (F.bit_count(cuts.bitwiseAND(x["inner"])) == 1) & (cuts.bitwiseAND(x["ends"]) == x["ends"])


def _merge_pass(edges, n):
    """Cuts that stay of a unit under a BPE model, as bits 0 to n, if none of its pieces is late: a merge opens only pairs that
    rank behind it, so merges come in the order of the edges, and each edge is looked at once."""
    return F.aggregate(edges, _bit(n + 1) - 1, lambda c, x: F.when(_is_pair(c, x), c - c.bitwiseAND(x["inner"])).otherwise(c))


def _merge_fold(edges, n):
    """The same for any pieces: n - 1 steps, each merging the best pair of neighbours, leftmost first."""

    def step(state, _):
        first = F.get(F.filter(state["x"], lambda x: _is_pair(state["c"], x)), F.lit(0))["inner"]
        return F.struct(state["c"].bitwiseAND(F.coalesce(F.bitwise_not(first), F.lit(-1).cast("long"))).alias("c"), state["x"].alias("x"))

    start = F.struct((_bit(n + 1) - 1).alias("c"), F.filter(edges, lambda x: x["inner"] != 0).alias("x"))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), start, step, lambda s: s["c"])


def _viterbi_fold(edges, n, longest: int, unknown_score: float):
    """Cuts of the best path under a unigram model, as bits; a character no piece covers costs unknown_score."""
    scores = F.map_from_arrays(F.transform(edges, lambda x: x["s"] * WIDE + x["e"]), F.transform(edges, lambda x: -x["rank"]))

    def step(state, e):
        s = F.sequence(F.greatest(e - longest, F.lit(0)), e - 1)
        cand = F.transform(s, lambda a: F.struct((F.get(state["best"], a) + F.coalesce(F.try_element_at(scores, a * WIDE + e), F.when(a == e - 1, F.lit(unknown_score)))).alias("score"), a.alias("a")))
        return F.transform(F.array(F.array_max(F.filter(cand, lambda x: x["score"].isNotNull()))), lambda p: F.struct(F.concat(state["best"], F.array(p["score"])).alias("best"), F.concat(state["back"], F.array(p["a"])).alias("back")))[0].cast(kind)

    kind = "struct<best:array<double>,back:array<int>>"
    start = F.struct(F.array(F.lit(0.0)).alias("best"), F.array(F.lit(0)).alias("back")).cast(kind)
    back = F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: s["back"])
    # back from the end, one cut a step; state: the last cut and the bits of all
    walk = lambda c, _: F.when(c["at"] == 0, c).otherwise(F.struct(F.get(back, c["at"]).alias("at"), c["c"].bitwiseOR(_bit(F.get(back, c["at"]))).alias("c")))
    return F.aggregate(F.sequence(F.lit(1), n), F.struct(n.alias("at"), _bit(n).alias("c")), walk, lambda c: c["c"])


def encode_units(words: DataFrame, path: str, kind: str = "bpe") -> DataFrame:
    """words(unit, ...) with ids (array<int>). Characters outside the vocabulary fall back to their bytes."""
    v = vocabulary(path)
    whole = _lattice(words, piece_table(words.sparkSession, path, kind), v["longest"])
    worst, given = _worst(v), (F.col("edges"), F.col("n"))
    cuts = F.when(F.col("late"), _merge_fold(*given)).otherwise(_merge_pass(*given)) if kind == "bpe" else _viterbi_fold(*given, v["longest"], worst)
    whole = whole.withColumn("cuts", cuts)
    # the edges between neighbouring cuts, by their place
    used = F.sort_array(F.transform(F.filter("edges", lambda x: F.col("cuts").bitwiseAND(x["ends"].bitwiseOR(x["inner"])) == x["ends"]), lambda x: F.struct(x["s"].alias("s"), x["id"].alias("id"))))
    byte_ids = F.array(*map(F.lit, v["bytes"]))

    def in_bytes(i):  # a character that is no piece
        hexed = F.hex(F.encode(F.substr("unit", i + 1, F.lit(1)), "UTF-8"))
        return F.transform(F.sequence(F.lit(0), F.shiftright(F.length(hexed), 1) - 1), lambda j: F.get(byte_ids, F.conv(F.substr(hexed, (j * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")))

    at = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.getbit("cuts", i) == 1)
    known = lambda i: F.get(F.filter("used", lambda x: x["s"] == i), F.lit(0))["id"]
    by_place = F.flatten(F.transform(at, lambda i: F.when(known(i).isNotNull(), F.array(known(i))).otherwise(in_bytes(i))))
    whole = whole.withColumn("used", used)
    return whole.select(*words.columns, F.when(F.size("used") == F.bit_count("cuts") - 1, F.transform("used", lambda x: x["id"])).otherwise(by_place).alias("ids"))


def _merged(unit: str, pieces: dict) -> list[str]:
    """Pieces of a unit under a BPE model: the merges of _merge_fold, with the pairs of neighbours in a heap."""
    n = len(unit)
    # a piece is known by its start; before and after are the neighbours' starts
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple] = []

    def pair(a):
        b = after[a]
        if b < n and (got := pieces.get(unit[a : end[b]])):
            heapq.heappush(heap, (-got[1], a, b, end[b]))

    for a in range(n - 1):
        pair(a)
    while heap:
        _, a, b, e = heapq.heappop(heap)
        # a gone piece has no end; a pair that has grown since has another
        if end[a] != b or after[a] != b or end[b] != e:
            continue
        end[a], end[b], after[a] = e, -1, after[b]
        if after[a] < n:
            before[after[a]] = a
        pair(a)
        if before[a] >= 0:
            pair(before[a])
    out, a = [], 0
    while a < n:
        out.append(unit[a : end[a]])
        a = after[a]
    return out


def _best_path(unit: str, pieces: dict, longest: int, unknown_score: float) -> list[str]:
    """Pieces of a unit under a unigram model: the path of _viterbi_fold."""
    best, back = [0.0], [0]
    for e in range(1, len(unit) + 1):
        cand = []
        for a in range(max(0, e - longest), e):
            got = pieces.get(unit[a:e])
            if got or a == e - 1:
                cand.append((best[a] + (got[1] if got else unknown_score), a))
        s, a = max(cand)
        best.append(s)
        back.append(a)
    out, e = [], len(unit)
    while e:
        out.append(unit[back[e] : e])
        e = back[e]
    return out[::-1]


def _worst(v: dict) -> float:
    return min((s for _, s in v["pieces"].values()), default=0.0) - 10


def long_ids(unit: str, v: dict, kind: str) -> list[int]:
    """What encode_units gives for a unit, in time that grows with its length."""
    parts = _merged(unit, v["pieces"]) if kind == "bpe" else _best_path(unit, v["pieces"], v["longest"], v["worst"])
    out: list[int] = []
    for p in parts:
        out += [v["pieces"][p][0]] if p in v["pieces"] else [v["bytes"][b] for b in p.encode()]
    return out


def split_units(texts: list[bytes]) -> Words:
    """units() of many texts; a blank stands for itself. Units fill the texts, so they are cut where one begins."""
    texts = [t and b" " + t.replace(BLANK.encode(), b" ") for t in texts]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(sizes) - sizes
    buf = np.frombuffer(b"".join(texts), np.uint8)
    blank, line = buf == 32, buf == 10
    start = line.copy()
    start[1:] |= line[:-1] | blank[1:] & ~blank[:-1]
    start[begins[sizes > 0]] = True
    at = np.flatnonzero(start)
    return Words(buf, at, None, np.searchsorted(at, begins))


def split_parts(terms: pa.Array, joins: _Joins | None) -> Words:
    """Parts of units, cut between two characters that never join; a unit is one part if joins is None."""
    sizes = np.asarray(pc.binary_length(terms)).astype(np.int64)
    begins, buf = np.cumsum(sizes) - sizes, np.zeros(0, np.uint8)
    if len(terms):
        at = np.frombuffer(terms.buffers()[1], np.int32)[terms.offset :]
        buf = np.frombuffer(terms.buffers()[2], np.uint8)[at[0] : at[len(terms)]]
    start = np.zeros(len(buf), bool)
    start[begins] = True
    if joins is not None and len(buf):
        kinds = joins.classes[np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)]
        start[np.flatnonzero((buf & 0xC0) != 0x80)[1:]] |= ~joins.open.ravel()[kinds[:-1].astype(np.int64) * len(joins.open) + kinds[1:]]
    at = np.flatnonzero(start)
    return Words(buf, at, None, np.searchsorted(at, begins))


def _named(terms: pa.Array) -> pa.Array:
    """Units as the model writes them."""
    return pc.replace_substring(terms.cast(pa.string()), " ", BLANK)


def frequent_units(docs: DataFrame, most: int, least_here: int = 2, max_fold: int = MAX_FOLD, joins=None) -> DataFrame:
    """At most `most` units, or parts of them if joins is a broadcast _Joins, that are worth a place in the dictionary. Which they are changes the cost and no result,
    so units that a chunk of texts has less than least_here times are not counted."""

    def run(batches):
        for _, part in chunks(batches, 0, CHUNK):
            w = split_units(part)
            p = split_parts(w.terms, joins and joins.value)
            n = np.bincount(p.codes, np.repeat(np.bincount(w.codes, minlength=len(w.terms)), p.sizes), len(p.terms)).astype(np.int64)
            named = _named(p.terms)
            keep = pa.array((n >= least_here) & (np.asarray(pc.utf8_length(named)) <= max_fold))
            yield pa.RecordBatch.from_arrays([named.filter(keep), pa.array(n).filter(keep)], ["unit", "n"])

    counts = stash(docs.select(F.col("text").cast("string")).mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n")), "units")
    band, least, total = F.floor(F.log2("n") * 32), None, 0
    for r in sorted(counts.groupBy(band.alias("band")).count().collect(), key=lambda r: -r["band"]):
        if total + r["count"] > most:
            break
        least, total = r["band"], total + r["count"]
    return counts.where(band >= least if least is not None else F.lit(False)).select("unit")


class _Dictionary:
    """Units with their ids, all ids in a row."""

    def __init__(self, units: pa.Array, ids: pa.Array):
        self.units, sizes = units, np.asarray(pc.fill_null(pc.list_value_length(ids), 0)).astype(np.int64)
        self.pool, self.sizes = np.asarray(pc.list_flatten(ids)).astype(np.int32), sizes
        self.starts = np.cumsum(sizes) - sizes

    def find(self, named: pa.Array) -> np.ndarray:
        return np.asarray(pc.fill_null(pc.index_in(named, value_set=self.units), -1)).astype(np.int64)


def _whole(column) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


CODED = "doc_id long, text_bytes long, ids array<int>"


def encode(docs: DataFrame, path: str | None = None, kind: str = "bpe", max_units: int = 400_000, max_fold: int = MAX_FOLD, part_bytes: int = 1 << 20, after=None, schema: str = CODED) -> DataFrame:
    """doc_id, text_bytes and ids of every row.

    ids is what the model's own encoder gives for the text. A null or empty text has no ids.
    Repeated rows are encoded each for itself; other columns are not read. A row is known by a hash of its
    doc_id and text, so the order in which docs gives its rows does not matter. after takes the batches of these columns
    where they are made, in the same Python worker, and gives those of schema.
    """
    if not 2 <= max_fold <= MAX_FOLD:
        raise ValueError(f"need 2 <= max_fold <= {MAX_FOLD}: cuts are the bits of a long")
    path = path or default_model()
    spark = docs.sparkSession
    joins = spark.sparkContext.broadcast(_Joins(merges(path)[1]) if kind == "bpe" else None)
    frequent = encode_units(frequent_units(docs, max_units, max_fold=max_fold, joins=joins).repartition(max(1, max_units // 10_000), "unit"), path, kind).toArrow()
    sent = spark.sparkContext.broadcast(_Dictionary(_whole(frequent["unit"]), _whole(frequent["ids"])))
    v = vocabulary(path)
    model = spark.sparkContext.broadcast({k: v[k] for k in ("pieces", "bytes", "longest")} | {"worst": _worst(v)})
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(partitions(spark), -(-total // part_bytes))  # small enough for edges to be grouped in memory

    def row_keys(b, texts) -> np.ndarray:
        digest = [xxhash.xxh3_128_digest(t, (1 << 63 if d is None else d) & (1 << 64) - 1) for d, t in zip(b.column(0).to_pylist(), texts)]
        return np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)

    def rare(batches):
        table = sent.value
        for b, texts in chunks(batches, 1, CHUNK):
            w = split_units(texts)
            p = split_parts(w.terms, joins.value)
            named = _named(p.terms)
            new = ((table.find(named) < 0) & (np.asarray(pc.utf8_length(named)) <= max_fold))[p.codes]
            # new parts of each unit, all in a row
            n = np.bincount(np.repeat(np.arange(len(w.terms)), p.sizes)[new], minlength=len(w.terms))
            codes, ends = w.spread(np.cumsum(n) - n, n, p.codes[new].astype(np.int64))
            pair = np.unique((np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0)) << 32) | codes)
            keys = row_keys(b, texts)[pair >> 32]
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), named.take(pa.array(pair & 0xFFFFFFFF))], ["k1", "k2", "unit"])

    others = source.mapInArrow(rare, "k1 long, k2 long, unit string").repartition(parts, "k1", "k2")
    rest = encode_units(others, path, kind).groupBy("k1", "k2").agg(F.collect_list(F.struct("unit", "ids")).alias("more"))

    def number(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for b, texts in chunks(batches, 1, CHUNK):
            keys = row_keys(b, texts)
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), b.column(0), pa.array([pack.compress(t) for t in texts], pa.binary())], ["k1", "k2", "doc_id", "z"])

    def assemble(batches):
        unpack, table = zstandard.ZstdDecompressor(), sent.value
        for b, packed in chunks(batches, 1, CHUNK // 2):
            texts = [unpack.decompress(z) for z in packed]
            w = split_units(texts)
            p = split_parts(w.terms, joins.value)
            named = _named(p.terms)
            at = table.find(named)
            more = pc.list_flatten(b.column(2))
            own = _Dictionary(pc.struct_field(more, "unit"), pc.struct_field(more, "ids"))
            here = own.find(named)
            lost = np.flatnonzero((at < 0) & (here < 0))
            long = [long_ids(u, model.value, kind) for u in named.take(pa.array(lost)).to_pylist()]
            added = _Dictionary(named.take(pa.array(lost)), pa.array(long, pa.list_(pa.int32())))
            starts, sizes = np.where(at >= 0, 0, len(table.pool)), np.zeros(len(at), np.int64)
            for place, d, base in ((at, table, 0), (np.where(at < 0, here, -1), own, len(table.pool))):
                hit = place >= 0
                starts[hit], sizes[hit] = base + d.starts[place[hit]], d.sizes[place[hit]]
            starts[lost], sizes[lost] = len(table.pool) + len(own.pool) + added.starts, added.sizes
            ids, ends = p.spread(starts, sizes, np.concatenate((table.pool, own.pool, added.pool)))
            sizes = np.diff(ends, prepend=0)
            ids, ends = w.spread(ends - sizes, sizes, ids)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, texts)), pa.int64()), lists], ["doc_id", "text_bytes", "ids"])

    texts = source.mapInArrow(number, "k1 long, k2 long, doc_id long, z binary").repartition(parts, "k1", "k2")
    last = assemble if after is None else lambda batches: after(assemble(batches))
    return texts.join(rest, ["k1", "k2"], "left").select("doc_id", "z", "more").mapInArrow(last, schema)


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Where each list begins and ends in the values, and the values; a null list is empty."""
    return np.concatenate(([0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)))), np.asarray(pc.list_flatten(column))


def decoder(path: str | None = None, together: int = 1 << 19):
    """Batches with doc_id and ids to batches of doc_id, ids and text; control ids give nothing, broken bytes the replacement character."""
    raw = vocabulary(path or default_model())["raw"]

    def run(batches):
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        starts, pool = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(raw), np.uint8)
        for b in batches:
            listed = b.column("ids")
            (at, ids), texts, lo = _lists(listed), [], 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + together, "right")) - 1)
                own = ids[at[lo] : at[hi]]
                n = sizes[own]
                ends = np.concatenate(([0], np.cumsum(n)))
                place = np.repeat(starts[own] - ends[:-1], n)
                place += np.arange(len(place))
                joined, cut = pool[place].tobytes(), ends[at[lo : hi + 1] - at[lo]].tolist()
                for f, t in zip(cut, cut[1:]):
                    x = joined[f:t].decode(errors="replace")
                    texts.append(x[1:] if x.startswith(" ") else x)
                lo = hi
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), listed, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return run


def decode(coded: DataFrame, path: str | None = None, together: int = 1 << 19) -> DataFrame:
    """doc_id, ids and text of rows with ids, by decoder."""
    return coded.select("doc_id", "ids").mapInArrow(decoder(path, together), "doc_id long, ids array<int>, text string")


def query(spark, sf_dir: str) -> DataFrame:
    """Per document the number of pieces, the CRC of its ids, and bytes and SHA-256 of the text decoded from them."""
    from .common import documents

    def digest(batches):
        for b in batches:
            at, ids = _lists(b.column(1))
            ids = ids.astype("<u4")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at)), pa.array([zlib.crc32(ids[f:t]) for f, t in zip(at[:-1].tolist(), at[1:].tolist())], pa.int64()), b.column(2)], ["doc_id", "n_pieces", "ids_crc32", "text"])

    read = decoder()
    got = encode(documents(spark, sf_dir), after=lambda batches: digest(read(batches)), schema="doc_id long, n_pieces long, ids_crc32 long, text string")
    return got.select("doc_id", "n_pieces", "ids_crc32", F.octet_length("text").cast("long").alias("decoded_bytes"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))
