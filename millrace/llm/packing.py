"""Best-fit packing of token sequences with certified bin counts.

Documents become token pieces on the executors. Pieces are dealt evenly into partitions of a
bounded number of items; each partition is packed best-fit decreasing and certified against
lower bounds from dual feasible functions (volume, the classes u(eps), and the rounding
functions u(k)). Every partition keeps its filled bins and gives up the documents of its
emptiest bin; one that is above its bound gives up more of them, in proportion to the gap. The documents given
up are exchanged between partitions and packed again, until they fit one partition or no
round saves a bin.
"""

from __future__ import annotations

import itertools
import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import stash

CAPACITY = 4096
END_ID = 1
_ENCODERS: dict[str, "WordEncoder"] = {}
CACHE_WORDS, CACHE_IDS, TOGETHER = 500_000, 2_500_000, 1000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of words, each encoded once while it is kept.

    The tokenizer lower-cases, drops white space and never joins across it, nor a letter with
    the full stop or comma after it. So lower-cased words between ASCII white space, such a mark
    apart, can be encoded by themselves. A text that may hold a special token, which is matched
    in its exact case, is not lower-cased and its marks stay.

    Words are kept by their 128-bit hash in sorted arrays of at most CACHE_WORDS words and
    CACHE_IDS ids (about 20 MB), or those of one chunk. New words of letters go to the tokenizer many at a time: each
    gives one id with the end-of-word mark, its last; where that count differs they go singly.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.last[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True
        self.kind = np.uint16 if len(self.last) < 1 << 16 else np.uint32
        self._clear()

    def _clear(self) -> None:
        self.high, self.low = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.starts, self.sizes, self.pool = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, self.kind)

    def _singly(self, terms: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(terms, add_special_tokens=False)]

    def _encode(self, terms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of each term, and all ids in a row."""
        plain = [t.decode() for t in terms]
        letters = [i for i, t in enumerate(plain) if t.isalpha()]
        rest = [i for i, t in enumerate(plain) if not t.isalpha()]
        groups = [letters[lo : lo + TOGETHER] for lo in range(0, len(letters), TOGETHER)]
        order, sizes, ids = [], [], []
        for group, got in zip(groups, self._singly([" ".join([plain[i] for i in g]) for g in groups])):
            ends = np.flatnonzero(self.last[got]) + 1
            if len(ends) != len(group):
                rest += group
                continue
            order.append(np.array(group))
            sizes.append(np.diff(ends, prepend=0))
            ids.append(got)
        for lo in range(0, len(rest), 20_000):
            part = rest[lo : lo + 20_000]
            got = self._singly([plain[i] for i in part])
            order.append(np.array(part))
            sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
            ids += got
        n = np.zeros(len(terms), np.int64)
        if not order:
            return n, np.zeros(0, self.kind)
        order, sizes, pool = np.concatenate(order), np.concatenate(sizes), np.concatenate(ids)
        n[order] = sizes
        # back in the order of the terms
        start = np.zeros(len(terms), np.int64)
        start[order] = np.cumsum(sizes) - sizes
        at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(len(pool))
        return n, pool[at]

    def _slots(self, terms: list[bytes]) -> np.ndarray:
        key = np.frombuffer(b"".join([xxhash.xxh3_128_digest(t) for t in terms]), ">u8").reshape(-1, 2).astype(np.uint64)
        at, hit = self._find(key)
        new = np.flatnonzero(~hit)
        if len(self.high) and (len(self.high) + len(new) > CACHE_WORDS or len(self.pool) > CACHE_IDS):
            self._clear()
            new = np.arange(len(terms))
        if len(new):
            sizes, ids = self._encode([terms[i] for i in new.tolist()])
            starts = len(self.pool) + np.cumsum(sizes) - sizes
            order = new[np.argsort(key[new, 0], kind="stable")]
            back = np.searchsorted(new, order)
            place = np.searchsorted(self.high, key[order, 0])
            self.pool = np.append(self.pool, ids)
            for name, values in (("high", key[order, 0]), ("low", key[order, 1]), ("starts", starts[back]), ("sizes", sizes[back])):
                setattr(self, name, np.insert(getattr(self, name), place, values))
            at, hit = self._find(key)
        if not hit.all():  # two words of one chunk that share half of their hash
            raise RuntimeError("words clash")
        return at

    def _find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.high):
            return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(self.high, key[:, 0]), len(self.high) - 1)
        # words that share the first half stand side by side
        for _ in range(4):
            off = (self.high[at] == key[:, 0]) & (self.low[at] != key[:, 1]) & (at < len(self.high) - 1)
            if not off.any():
                break
            at = at + off
        return at, (self.high[at] == key[:, 0]) & (self.low[at] == key[:, 1])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """32-bit ids of each text."""
        exact = [i for i, t in enumerate(texts) if b"<|" in t]
        out = self._ids([b"" if b"<|" in t else t for t in texts], True)
        for i in exact:
            out[i] = self._ids([texts[i]], False)[0]
        return out

    def _ids(self, texts: list[bytes], lower: bool) -> list[np.ndarray]:
        w = words.split(texts, lower, marks=lower)
        slots = self._slots(w.terms.to_pylist())
        ids, ends = w.spread(self.starts[slots], self.sizes[slots], self.pool)
        return np.split(ids.astype("<u4"), ends[:-1])


def token_ids(texts: list[bytes], path: str) -> list[np.ndarray]:
    """Little-endian 32-bit ids of each text, without its end."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path].encode(texts)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and salt, a number that deals rows evenly."""
    kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 4)

    def run(batches):
        row = 0
        for b, texts in words.chunks(batches, 1):
            got = []
            for doc, ids in zip(b.column(0).to_pylist(), token_ids(texts, tokenizer)):
                ids = np.append(ids, np.uint32(end_id))
                row += 1
                for k, lo in enumerate(range(0, len(ids), capacity)):
                    cut = ids[lo : lo + capacity]
                    got.append((doc, k, lo, len(cut), zlib.crc32(cut), row * 131 + k))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, salt long")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of several dual feasible functions."""
    hist = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    n, vol = np.cumsum(hist), np.cumsum(hist * size)
    eps = np.arange(0, capacity // 2 + 1)
    lo = np.maximum(eps - 1, 0)
    above = n[-1] - n[capacity - eps]
    middle = vol[capacity - eps] - np.where(eps > 0, vol[lo], 0)
    best = int((above + -(-middle // capacity)).max())
    for k in range(1, 25):
        exact = size * (k + 1) % capacity == 0
        whole = np.where(exact, size * k, (size * (k + 1) // capacity) * capacity)  # times k * capacity
        best = max(best, -(-int((hist * whole).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item. The open bins' free space is a bit set, so the tightest fit is one shift."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, made = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                mask ^= 1 << r
        else:
            r, b, made = capacity, made, made + 1
        bins[i], offsets[i] = b, capacity - r
        if r > n:
            if not free[r - n]:
                mask |= 1 << (r - n)
            free[r - n].append(b)
    return bins, offsets


_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long, sequence_id long, offset long, partition_bins long, partition_bound long"


def _pack_group(level: int, capacity: int, last: bool):
    def run(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["length", "doc_id", "piece", "salt"], ascending=[False, True, True, True], kind="stable")
        lengths = items["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        made, bound = int(bins.max()) + 1, lower_bound(lengths, capacity)
        seq = (level << 52) + (int(key[0]) << 20) + bins
        given = np.zeros(len(items), bool)
        if not last:
            fill = np.bincount(bins, lengths)
            give = min(made, 1 + 4 * (made - bound))
            given = np.isin(bins, np.argsort(fill, kind="stable")[:give][np.sort(fill)[:give] < capacity])
        out = items[["doc_id", "piece", "start", "length", "ids_crc32", "salt"]].copy()
        out["sequence_id"] = pd.array(np.where(given, 0, seq), "Int64")
        out.loc[given, "sequence_id"] = pd.NA
        out["offset"], out["partition_bins"], out["partition_bound"] = offsets, made, bound
        return out

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, items_per_partition: int = 4096, max_rounds: int = 6) -> DataFrame:
    """Pieces with sequence_id and offset, and bins and lower bound of the partition that packed them.

    Pieces are token_pieces() rows of 1..capacity tokens. Repeated rows are packed each for
    itself; an empty table gives no rows. Work per task is items_per_partition rows at any size.
    """
    done, left = None, stash(pieces, "pieces")
    n = left.count()
    for level in range(max_rounds):
        groups = max(1, -(-n // items_per_partition))
        last = level == max_rounds - 1 or groups == 1
        dealt = left.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "salt", F.lit(level)), F.lit(groups)))
        got = dealt.groupBy("bucket").applyInPandas(_pack_group(level, capacity, last), _SCHEMA)
        if last:
            return got if done is None else done.unionByName(got)
        got = stash(got, "packed")
        kept = got.where("sequence_id is not null")
        done = kept if done is None else done.unionByName(kept)
        left = got.where("sequence_id is null").select(*pieces.columns)
        n = left.count()
        if n == 0:
            return done
    return done


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, **options) -> DataFrame:
    """Pack whole documents: null text counts as empty and is its end token alone; only documents longer than capacity are cut.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, partition_bins, partition_bound.
    """
    return pack(token_pieces(docs, tokenizer or default_tokenizer(), capacity), capacity, **options).drop("salt")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    return pack_documents(documents(spark, sf_dir))
