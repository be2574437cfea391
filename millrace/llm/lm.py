"""Language-model scores from sharded Elias-Fano n-gram tries.

Counting and scoring share one shuffle: every bigram occurrence goes to the shard of its
context, where those of training documents are counted into a trie and all are looked up.
A trie has two levels. Contexts, pointers and successors are monotone sequences in
Elias-Fano code (a successor is coded relative to its context, so each context's range goes
on from the last); a context's pointers give the range in which its successors are searched.
Probabilities and back-off weights are absolute discounting, quantised to
8 bits. Everything lies in one memory map per shard. No model is sent to all tasks: what is
broadcast is a dictionary of at most `max_vocabulary` frequent words, a cache only: the counts of
other words are joined, and where any of them is over 1 (a word seen once has the lower-order probability
of one not seen) they go with the text to where its occurrences are sent. A context that would
fill a shard alone is split by its successors' hash; the kinds of its successors are counted
before (summed within tasks, packed by bucket), so every split backs off as the whole context does. A pair of words that would fill a part of
a shard alone (at most four for each shard) is broadcast with its probability and scored where it stands.
"""

from __future__ import annotations

import math
import mmap
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import partitions, stash

END = b""  # no word is empty
STEP = 0.04  # of log10, between quantised levels
DISCOUNT = 0.75
_SPREAD = 0x9E3779B1  # odd: a bijection of 32 bits
_HELD = 1 << 20  # pairs that a task holds before it sends them on


def _train_column(modulus: int, held: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus != held


def _texts(docs: DataFrame, modulus: int, held: int) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), _train_column(modulus, held).alias("train"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over training texts; the end of a text counts as the empty word."""

    def run(batches):
        for _, part in words.chunks(batches, 0):
            w = words.split(part)
            yield pa.RecordBatch.from_arrays([_with_end(w), pa.array(np.append(np.bincount(w.codes, minlength=len(w.terms)), len(part)))], ["word", "n"])

    return texts.where("train").select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _with_end(w: words.Words) -> pa.Array:
    """The different words of some texts, and the end as the last."""
    return pa.concat_arrays([w.terms, pa.array([END], pa.binary())])


def _flat(w: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words of some texts, each text with its end, and the texts' numbers."""
    sizes = w.sizes + 1
    flat, end = np.full(int(sizes.sum()), len(w.terms), np.int64), np.zeros(int(sizes.sum()), bool)
    end[np.cumsum(sizes) - 1] = True
    flat[~end] = w.codes
    return flat, np.repeat(np.arange(len(sizes)), sizes)


def quantise(log10p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10p / STEP), 0, 255).astype(np.uint8)


_LEVEL = 10.0 ** (-STEP * np.arange(256))


def _hash(word: bytes, seed: int = 0) -> int:
    return xxhash.xxh32_intdigest(word, seed)


START = _hash(b"", 1)


# ---- Elias-Fano trie --------------------------------------------------------------------

_BLOCK = 1 << 14


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary. Where each block begins is kept, so any range is decoded alone."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        top = int(values[-1]) if self.n else 0
        self.low = max(0, (top // max(self.n, 1)).bit_length() - 1)
        ones = (values >> np.uint64(self.low)).astype(np.int64) + np.arange(self.n)
        unary = np.zeros(int(ones[-1]) + 1 if self.n else 0, bool)
        unary[ones] = True
        self.high = np.packbits(unary, bitorder="little")
        self.begins, self.firsts = np.append(ones[::_BLOCK], len(unary)), values[::_BLOCK].astype(np.uint64)
        lows = []
        for lo in range(0, self.n if self.low else 0, _BLOCK):
            part = values[lo : lo + _BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
            lows.append(np.packbits(np.unpackbits(part, axis=1, bitorder="little")[:, : self.low].ravel(), bitorder="little"))
        self.lows = np.concatenate(lows) if lows else np.zeros(0, np.uint8)

    def arrays(self) -> list[str]:
        return ["high", "lows", "begins", "firsts"]

    def block(self, k: int) -> np.ndarray:
        """Values k * _BLOCK and on."""
        lo = k * _BLOCK
        n = min(_BLOCK, self.n - lo)
        byte = int(self.begins[k]) >> 3
        ones = np.flatnonzero(np.unpackbits(self.high[byte : (int(self.begins[k + 1]) + 7) >> 3], bitorder="little")) + (byte << 3)
        ones = ones[np.searchsorted(ones, self.begins[k]) :][:n]
        v = (ones - np.arange(lo, lo + n)).astype(np.uint64) << np.uint64(self.low)
        if self.low:
            start = lo * self.low // 8
            bits = np.unpackbits(self.lows[start : start + (n * self.low + 7) // 8], bitorder="little")[: n * self.low].reshape(n, self.low)
            wide = np.zeros((n, 64), np.uint8)
            wide[:, : self.low] = bits
            v |= np.packbits(wide, axis=1, bitorder="little").view("<u8").ravel()
        return v

    def range(self, lo: int, hi: int) -> np.ndarray:
        """Values lo to hi - 1."""
        if lo >= hi:
            return np.zeros(0, np.uint64)
        k = lo // _BLOCK
        return np.concatenate([self.block(j) for j in range(k, (hi - 1) // _BLOCK + 1)])[lo - k * _BLOCK : hi - k * _BLOCK]

    def find(self, queries: np.ndarray) -> np.ndarray:
        """Index of each query (ascending) in a strictly growing sequence; -1 where it is not in it."""
        out = np.full(len(queries), -1, np.int64)
        blocks = np.searchsorted(self.firsts, queries, side="right") - 1
        cut = np.flatnonzero(np.concatenate((np.ones(min(1, len(blocks)), bool), blocks[1:] != blocks[:-1])))
        for at, to in zip(cut.tolist(), np.append(cut[1:], len(blocks)).tolist()):
            if (k := int(blocks[at])) >= 0:
                v = self.block(k)
                i = np.searchsorted(v, queries[at:to])
                hit = v[np.minimum(i, len(v) - 1)] == queries[at:to]
                out[at:to][hit] = i[hit] + k * _BLOCK
        return out


class Trie:
    """Two levels over (context, successor) hashes with quantised discounted probabilities.

    Given are occurrences, with how often each counts (0: not at all); totals has those of whole split contexts.
    """

    def __init__(self, context: np.ndarray, successor: np.ndarray, times: np.ndarray, totals: dict[int, tuple[int, float]], discount: float = DISCOUNT):
        key, inverse = np.unique((context.astype(np.uint64) << np.uint64(32)) | successor.astype(np.uint64), return_inverse=True)
        count = np.bincount(inverse, times, len(key)).astype(np.int64)
        key, count = key[count > 0], count[count > 0]
        ctx = key >> np.uint64(32)
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(ctx)), bool), ctx[1:] != ctx[:-1])))
        kinds = np.diff(np.append(first, len(key)))
        known = ctx[first]
        total = np.add.reduceat(count, first).astype(float) if len(first) else np.zeros(0)
        # split contexts: occurrences and kinds of successors are those of the whole context
        self.split = np.array(sorted(totals), np.uint64)
        whole, whole_kinds = (np.array([totals[c][j] for c in self.split.tolist()], float) for j in (0, 1))
        self.split_backoff = quantise(np.log10(discount * whole_kinds / whole))
        back_kinds = kinds.astype(float)
        i, part = self._in_split(known)
        total[part], back_kinds[part] = whole[i[part]], whole_kinds[i[part]]
        own = np.repeat(np.arange(len(known)), kinds)
        self.contexts = EliasFano(known)
        self.pointers = EliasFano(np.append(first, len(key)).astype(np.uint64))
        self.successors = EliasFano((own.astype(np.uint64) << np.uint64(32)) | (key & np.uint64(0xFFFFFFFF)))
        self.p = quantise(np.log10(np.maximum(count - discount, 1e-9) / total[own])) if len(key) else np.zeros(0, np.uint8)
        self.backoff = quantise(np.log10(discount * back_kinds / total)) if len(known) else np.zeros(0, np.uint8)
        self._map()

    def _in_split(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places among the split contexts, and which of the contexts are there."""
        i = np.minimum(np.searchsorted(self.split, contexts.astype(np.uint64)), max(0, len(self.split) - 1))
        return i, self.split[i] == contexts if len(self.split) else np.zeros(len(contexts), bool)

    def _map(self) -> None:
        """Move all levels into one memory map."""
        owners = [(e, a) for e in (self.contexts, self.pointers, self.successors) for a in e.arrays()] + [(self, "p"), (self, "backoff")]
        self.memory = mmap.mmap(-1, max(1, sum(getattr(o, a).nbytes for o, a in owners)))
        at = 0
        for o, a in owners:
            x = getattr(o, a)
            self.memory[at : at + x.nbytes] = x.tobytes()
            setattr(o, a, np.frombuffer(self.memory, x.dtype, len(x), at))
            at += x.nbytes

    def log10(self, context: np.ndarray, successor: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Log probabilities; lower is the successors' lower-order probability. Any order of queries."""
        known, back = np.unique(context, return_inverse=True)
        at, weight = self.contexts.find(known.astype(np.uint64)), np.ones(len(known))
        i, part = self._in_split(known)  # a split may have no successor seen in training
        weight[part] = _LEVEL[self.split_backoff[i[part]]]
        weight[at >= 0] = _LEVEL[self.backoff[at[at >= 0]]]
        at, out = at[back], weight[back] * lower
        del known, back, weight
        rows = np.flatnonzero(at >= 0)
        p = out[rows]
        order = np.argsort((at[rows].astype(np.uint64) << np.uint64(32)) | successor[rows].astype(np.uint64))
        found = np.empty(len(rows), np.int64)
        found[order] = self._places(at[rows][order], successor[rows][order])
        del order, at
        seen = found >= 0
        p[seen] += _LEVEL[self.p[found[seen]]]
        out[rows] = p
        return np.log10(np.clip(out, 1e-300, 1.0))

    def _places(self, context: np.ndarray, successor: np.ndarray, together: int = 4096) -> np.ndarray:
        """Places of (context, successor), in ascending order, or -1. The pointers of a stretch of contexts give the
        range of successors to decode; each successor is searched among its context's own."""
        out, lo = np.full(len(context), -1, np.int64), 0
        while lo < len(context):
            first = int(context[lo])
            hi = int(np.searchsorted(context, first + together))
            bounds = self.pointers.range(first, int(context[hi - 1]) + 2).astype(np.int64)
            theirs = self.successors.range(int(bounds[0]), int(bounds[-1])) & np.uint64(0xFFFFFFFF)
            own = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds)) << np.uint64(32) | theirs
            key = (context[lo:hi] - first).astype(np.uint64) << np.uint64(32) | successor[lo:hi].astype(np.uint64)
            i = np.searchsorted(own, key)
            hit = own[np.minimum(i, len(own) - 1)] == key
            out[lo:hi][hit] = i[hit] + bounds[0]
            lo = hi
        return out


# ---- scoring ----------------------------------------------------------------------------


def frequent_words(counts: DataFrame, most: int) -> list:
    """The words of the highest counts, at most `most`: whole classes of counts on a log scale, so ties are not cut."""
    band = F.floor(F.log2("n") * 32)
    sizes = sorted(counts.groupBy(band.alias("band")).count().collect(), key=lambda r: -r["band"])
    least, total = None, 0
    for r in sizes:
        if total + r["count"] > most:
            break
        total, least = total + r["count"], r["band"]
    if least is None:
        return []
    return counts.where(band >= least).orderBy("word").collect()


def _model(counts: DataFrame, shards: int, texts_n: int, most: int) -> dict:
    """Totals, frequent words with their codes, and the contexts that are split."""
    n, v, again = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count(F.when(F.col("n") > 1, 1))).first()
    top = [(bytes(r["word"]), r["n"]) for r in frequent_words(counts, most)]
    c = np.array([x for _, x in top], np.int64)
    h = np.array([_hash(w) for w, _ in top], np.uint64)
    codes = quantise(np.log10(c / (n + 1))) if len(top) else np.zeros(0, np.uint8)
    share = max(1.0, n / (4 * shards))
    often = Counter({START: texts_n})
    for r in counts.where(F.col("n") > share).collect():  # at most 4 * shards
        often[_hash(bytes(r["word"]))] += r["n"]
    hot = {k: min(math.ceil(x / share), 4 * shards) for k, x in often.items() if x > share}
    return {
        "n": n, "v": v, "words": pa.array([w for w, _ in top], pa.binary()), "counts": c, "hash": h, "codes": codes, "rare": int(quantise(np.log10(np.array([1 / (n + 1)])))[0]), "tail": again > int((c > 1).sum()), "share": share, "hot_tokens": sum(often[k] for k in hot),
        "hot_keys": np.array(sorted(hot), np.uint64), "hot_splits": np.array([hot[k] for k in sorted(hot)], np.uint64),
    }


def _split_key(context: np.ndarray, part: np.ndarray) -> np.ndarray:
    x = (context.astype(np.uint64) << np.uint64(32)) | (part.astype(np.uint64) + np.uint64(1))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(32)).astype(np.uint64)


def _in_dictionary(m: dict, terms: pa.Array) -> np.ndarray:
    """Places in the dictionary, or -1."""
    return np.asarray(pc.fill_null(pc.index_in(terms, value_set=m["words"]), -1)).astype(np.int64)


def _bigrams(m: dict, part: list[bytes], own: dict[bytes, int]):
    """(context, successor, code of its lower-order probability, text number) of every token of some texts.

    own: codes of words outside the dictionary; those in neither have that of one occurrence."""
    w = words.split(part)
    terms = _with_end(w)
    at = _in_dictionary(m, terms)
    new = np.flatnonzero(at < 0)
    h, code = np.empty(len(at), np.uint64), np.empty(len(at), np.uint8)
    h[at >= 0], code[at >= 0] = m["hash"][at[at >= 0]], m["codes"][at[at >= 0]]
    named = terms.take(pa.array(new)).to_pylist()
    h[new], code[new] = [_hash(x) for x in named], [own.get(x, m["rare"]) for x in named]
    flat, text = _flat(w)
    succ = h[flat]
    ctx = np.concatenate((np.zeros(min(1, len(flat)), np.uint64), succ[:-1]))
    ctx[np.flatnonzero(np.diff(text, prepend=-1))] = START
    return ctx, succ, code[flat], text


def _hot_places(hot: np.ndarray, ctx: np.ndarray):
    """Places of the occurrences after hot contexts, and of their contexts among these."""
    at = np.searchsorted(hot, ctx)
    places = np.flatnonzero(hot[np.minimum(at, len(hot) - 1)] == ctx) if len(hot) else np.zeros(0, np.int64)
    return places, at[places]


def _summed(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, ascending, with the sum of its times."""
    order = np.argsort(key, kind="stable")  # runs in order are merged
    key, times = key[order], times[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    return key[first], np.add.reduceat(times, first) if len(first) else times


def _packed_pairs(key: np.ndarray, times: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row for each bucket: its keys, ascending, and their times."""
    pack = zstandard.ZstdCompressor(level=1)
    bucket = ((key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    key, times, at = key[order], times[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(at))
    rows = [pack.compress(np.stack((key[lo:hi], times[lo:hi].astype(np.uint64))).view(np.uint8).reshape(-1, 8).T.tobytes()) for lo, hi in zip(at[full].tolist(), at[full + 1].tolist())]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(rows, pa.binary())], ["bucket", "pairs"])


def _unpacked_pairs(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(8, -1).T.copy().view(np.uint64).reshape(2, -1)
    return both[0], both[1].astype(np.int64)


def score_texts(docs: DataFrame, modulus: int = 7, held: int = 2, max_vocabulary: int = 300_000, tokens_per_shard: int = 1_000_000, chunk_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score and score of every row.

    Learns from rows whose crc32(doc_id as text; empty for null) mod modulus is not `held`. A
    null text is empty and has its end token alone. docs is read twice and must give its rows in the
    same order both times, as a table does; if it does not, the job fails. Repeated rows are scored each for itself,
    alike, and count each in training. With no training text all probabilities are 1.
    """
    spark = docs.sparkSession
    texts = _texts(docs, modulus, held)
    counts = stash(word_counts(texts), "words")
    total_bytes, texts_n = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum(F.col("train").cast("long")), F.lit(0))).first()
    shards = max(partitions(spark), math.ceil(total_bytes / 6 / tokens_per_shard))
    model = _model(counts, shards, texts_n, max_vocabulary)
    n, v = model["n"], model["v"]
    sent = spark.sparkContext.broadcast(model)

    def told_uids(row, part):
        """Numbers of the rows of a task, each with a hash of its text."""
        uid = np.arange(row, row + len(part)) + (TaskContext.get().partitionId() << 32)
        return uid, np.array([xxhash.xxh3_64_intdigest(x) for x in part], np.uint64).view(np.int64)

    # 0. the successors of hot contexts, each counted once: summed in their task, packed by bucket, summed again by bucket
    buckets = max(partitions(spark), math.ceil(model["hot_tokens"] / tokens_per_shard))

    def pairs(batches):
        m, held = sent.value, []
        for _, part in words.chunks(batches, 1, chunk_bytes):
            ctx, succ, _, _ = _bigrams(m, part, {})
            places, _ = _hot_places(m["hot_keys"], ctx)
            held.append(np.unique((ctx[places] << np.uint64(32)) | succ[places], return_counts=True))
            if sum(len(key) for key, _ in held) >= _HELD:
                held = [_summed(*map(np.concatenate, zip(*held)))]
                if len(held[0][0]) >= _HELD // 2:
                    yield _packed_pairs(*held.pop(), buckets)
        if held:
            yield _packed_pairs(*_summed(*map(np.concatenate, zip(*held))), buckets)

    def successors(pdf: pd.DataFrame) -> pd.DataFrame:
        key, times = _summed(*map(np.concatenate, zip(*map(_unpacked_pairs, pdf["pairs"]))))
        ctx, first = np.unique(key >> np.uint64(32), return_index=True)
        large = times > sent.value["share"]
        rows = [np.concatenate((key[lo:hi][large[lo:hi]], times[lo:hi][large[lo:hi]].astype(np.uint64))).tobytes() for lo, hi in zip(first.tolist(), np.append(first[1:], len(key)).tolist())]
        return pd.DataFrame({"ctx": ctx.astype(np.int64), "kinds": np.diff(np.append(first, len(key))), "n": np.add.reduceat(times, first), "large": rows})

    # whole contexts' totals, and the pairs that would fill a part of a shard alone: at most 4 * shards
    totals, hot_pairs = {}, []
    if len(model["hot_keys"]):
        splits = dict(zip(model["hot_keys"].tolist(), model["hot_splits"].tolist()))
        seen_pairs = texts.where("train").mapInArrow(pairs, "bucket int, pairs binary").groupBy("bucket").applyInPandas(successors, "ctx long, kinds long, n long, large binary")
        for r in seen_pairs.groupBy("ctx").agg(F.sum("kinds").alias("kinds"), F.sum("n").alias("n"), F.collect_list(F.when(F.octet_length("large") > 0, F.col("large"))).alias("large")).collect():
            parts = splits[r["ctx"]]
            totals |= dict.fromkeys(_spread(_split_key(np.full(parts, r["ctx"], np.uint64), np.arange(parts))).tolist(), (r["n"], r["kinds"]))
            for x in r["large"]:
                key, times = np.frombuffer(x, np.uint64).reshape(2, -1).tolist()
                hot_pairs += [(k, (t - DISCOUNT) / r["n"], DISCOUNT * r["kinds"] / r["n"]) for k, t in zip(key, times)]
    hot_pairs.sort()
    pair_key = np.array([x for x, _, _ in hot_pairs], np.uint64)
    pair_p, pair_back = (_LEVEL[quantise(np.log10(np.array([x[k] for x in hot_pairs], float)))] for k in (1, 2))
    told = spark.sparkContext.broadcast((totals, pair_key, pair_p, pair_back))

    # 1. per text: what the dictionary knows, and the rare words by name
    def base(batches):
        m, row = sent.value, 0
        for b, part in words.chunks(batches, 1, chunk_bytes):
            w = words.split(part)
            terms = _with_end(w)
            at = _in_dictionary(m, terms)
            flat, text = _flat(w)
            known, value = at >= 0, np.zeros(len(at))
            value[known] = np.log10((m["counts"][at[known]] + 1) / (n + v + 1))
            rest = np.flatnonzero(~known[flat])
            key, times = np.unique((text[rest] << 32) | flat[rest], return_counts=True)
            bounds = pa.array(np.searchsorted(key >> 32, np.arange(len(part) + 1)), pa.int32())
            uid, check = told_uids(row, part)
            row += len(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(uid), pa.array(check), b.column(0), b.column(2), pa.array(w.sizes + 1), pa.array(np.bincount(text, known[flat], len(part)).astype(np.int64)), pa.array(np.bincount(text, value[flat], len(part))), pa.ListArray.from_arrays(bounds, terms.take(pa.array(key & 0xFFFFFFFF))), pa.ListArray.from_arrays(bounds, pa.array(times, pa.int64()))],
                ["uid", "check", "doc_id", "train", "n_tokens", "seen", "sum", "words", "times"],
            )

    about = stash(texts.mapInArrow(base, "uid long, check long, doc_id long, train boolean, n_tokens long, seen long, sum double, words array<binary>, times array<long>"), "texts")
    rare = about.select("uid", F.explode(F.arrays_zip("words", "times")).alias("x")).select("uid", "x.words", "x.times")
    rare = rare.join(counts.withColumnRenamed("word", "words"), "words", "left")
    rare = rare.groupBy("uid").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("more"), F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(n + v + 1)))).alias("rest"), F.array_join(F.collect_list(F.when(F.col("n") > 1, F.concat(F.col("n").cast("string"), F.lit(" "), F.col("words").cast("string")))), "\n").alias("tail"))
    source, joined = texts, model["tail"]
    if joined:
        rare = stash(rare, "rare")

        def number(batches):
            pack, row = zstandard.ZstdCompressor(level=3), 0
            for b, part in words.chunks(batches, 1, chunk_bytes):
                uid, check = told_uids(row, part)
                row += len(part)
                yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(check), pa.array([pack.compress(x.lower()) for x in part], pa.binary()), b.column(2)], ["uid", "check", "z", "train"])

        packed = texts.mapInArrow(number, "uid long, check long, z binary, train boolean")
        source = packed.join(rare.where("tail <> ''").select("uid", "tail"), "uid", "left").sortWithinPartitions("uid")

    def coded(batches):
        """uids with hashes, texts and train of a chunk, and the codes of their words outside the dictionary."""
        if not joined:
            row = 0
            for b, part in words.chunks(batches, 1, chunk_bytes):
                yield *told_uids(row, part), part, np.asarray(b.column(2).to_pylist(), bool), {}
                row += len(part)
            return
        unpack = zstandard.ZstdDecompressor()
        for b, zs in words.chunks(batches, 2, chunk_bytes // 3):
            tail = [x.split(b" ", 1) for t in b.column(4).cast(pa.binary()).to_pylist() if t for x in t.split(b"\n")]  # count and word
            own = dict(zip([w for _, w in tail], quantise(np.log10(np.array([x for x, _ in tail], float) / (n + 1))).tolist()))
            yield np.asarray(b.column(0)), np.asarray(b.column(1)), [unpack.decompress(z) for z in zs], np.asarray(b.column(3).to_pylist(), bool), own

    # 2. occurrences to the shards of their contexts, and partial sums back by chunk
    def send(batches):
        m, (_, pair_key, pair_p, pair_back) = sent.value, told.value
        chunk, pack = (TaskContext.get().partitionId() << 32) - 1, zstandard.ZstdCompressor(level=1)
        for uids, checks, part, train, own in coded(batches):
            chunk += 1
            ctx, succ, code, text = _bigrams(m, part, own)
            split, at = _hot_places(m["hot_keys"], ctx)
            # pairs in the broadcast are scored here
            here, i = _hot_places(pair_key, (ctx[split] << np.uint64(32)) | succ[split])
            score = np.log10(np.clip(pair_p[i] + pair_back[i] * _LEVEL[code[split[here]]], 1e-300, 1.0))
            local = np.bincount(text[split[here]], score, len(part))
            ctx[split] = _split_key(ctx[split], succ[split] % m["hot_splits"][at])
            left = np.ones(len(ctx), bool)
            left[split[here]] = False
            ctx, succ, code, text = _spread(ctx[left]), succ[left], code[left], text[left]
            key = (ctx << np.uint64(32)) | succ
            order = np.argsort(key)
            key, code, text = key[order], code[order], text[order]
            new = np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1]))
            word = (text << 2 | train[text] << 1 | new).astype(np.uint16)  # texts of a chunk are at most 1 << 14
            pair = np.flatnonzero(new)
            ctx, succ, code = key[pair] >> np.uint64(32), key[pair].astype(np.uint32), code[pair]
            shard = ctx * np.uint64(shards) >> np.uint64(32)
            cut = np.flatnonzero(np.concatenate((np.ones(min(1, len(shard)), bool), shard[1:] != shard[:-1])))
            ends = np.append(cut[1:], len(shard)) if len(cut) else cut
            at = np.append(pair, len(word))
            rows = []
            for lo, hi in zip(cut.tolist(), ends.tolist()):
                first = np.flatnonzero(np.concatenate(([True], ctx[lo + 1 : hi] != ctx[lo : hi - 1])))
                size = np.diff(np.append(first, hi - lo)).astype(np.uint32)
                rows.append([int(shard[lo]), chunk, len(part), ctx[lo:hi][first].astype(np.uint32).tobytes(), size.tobytes(), succ[lo:hi].tobytes(), pack.compress(code[lo:hi].tobytes()), pack.compress(word[at[lo] : at[hi]].view(np.uint8).reshape(-1, 2).T.tobytes()), b"", b""])
            rows = rows or [[0, chunk, len(part), b"", b"", b"", pack.compress(b""), pack.compress(b""), b"", b""]]
            rows[chunk % len(rows)][-2:] = [np.concatenate((uids, checks)).tobytes(), local.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["shard", "first", "size", "ctx", "runs", "succ", "code", "text", "uids", "local"])

    def shard_scores(pdf: pd.DataFrame) -> pd.DataFrame:
        unpack = zstandard.ZstdDecompressor()
        whole = lambda col, kind: np.frombuffer(b"".join(pdf[col]), kind)
        texts = [np.frombuffer(unpack.decompress(x), np.uint8).reshape(2, -1).T.copy().view(np.uint16).ravel() for x in pdf["text"]]
        code, text = np.frombuffer(b"".join([unpack.decompress(x) for x in pdf["code"]]), np.uint8), np.concatenate(texts)
        ctx, succ = np.repeat(whole("ctx", np.uint32), whole("runs", np.uint32)), whole("succ", np.uint32)
        pair = np.cumsum(text & 1) - 1
        trie = Trie(ctx, succ, np.bincount(pair, text >> 1 & 1, len(ctx)), told.value[0])
        logp = trie.log10(ctx, succ, _LEVEL[code])[pair]
        sizes = np.array([len(x) for x in texts], np.int64)
        ends = np.cumsum(sizes)
        sums = [np.bincount(text[e - s : e] >> 2, logp[e - s : e], k) for s, e, k in zip(sizes, ends, pdf["size"])]
        return pd.DataFrame({"first": pdf["first"], "sums": [(x + np.frombuffer(o) if o else x).tobytes() for x, o in zip(sums, pdf["local"])], "uids": pdf["uids"]})

    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        uids = np.frombuffer(b"".join(pdf["uids"]), np.int64).reshape(2, -1)
        return pd.DataFrame({"uid": uids[0], "same": uids[1], "score": sum(np.frombuffer(x) for x in pdf["sums"])})

    blobs = source.mapInArrow(send, "shard long, first long, size long, ctx binary, runs binary, succ binary, code binary, text binary, uids binary, local binary")
    scores = blobs.groupBy("shard").applyInPandas(shard_scores, "first long, sums binary, uids binary").groupBy("first").applyInPandas(add_up, "uid long, same long, score double")
    out = about.select("uid", "check", "doc_id", "train", "n_tokens", "seen", "sum").join(rare.drop("tail"), "uid", "left").join(scores, "uid", "left")
    score = F.when(F.col("check") == F.col("same"), F.col("score")).otherwise(F.raise_error(F.lit("the rows came in another order the second time")))
    return out.select("doc_id", "train", "n_tokens", (F.col("seen") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("sum") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), score.alias("score"))


def _spread(context: np.ndarray) -> np.ndarray:
    """Contexts under other names, whose upper bits deal them into shards."""
    return context * np.uint64(_SPREAD) & np.uint64(0xFFFFFFFF)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    got = score_texts(documents(spark, sf_dir))
    return got.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
