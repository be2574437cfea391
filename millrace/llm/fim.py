"""Fill-in-middle transformation over seekable compressed frames.

A text is stored as independent Zstandard frames of at most `frame_bytes`, cut between code
points, each with the units (lines), bytes and code points that end by its end. A cut after k
units is found in one frame, by its cumulative unit count, and only that frame is
decompressed. The transformed text is frames again: those that no cut touches are passed on
compressed as they are. Digests of the output, and of the text rebuilt from it, come from its
frames streamed in order, so no task holds more of a text than a few frames, besides the row it reads.
Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, stash

#: What stands before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")

STORED = "doc_id long, n long, marked boolean, frames array<struct<units: long, bytes: long, chars: long, frame: binary>>"
TRANSFORMED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output array<struct<bytes: long, frame: binary>>"


def code_points(raw) -> int:
    """Bytes that do not go on with a code point of UTF-8."""
    return int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))


class Frames:
    """Frames by their cumulative ends in bytes; the one decompressed last is kept."""

    def __init__(self, ends: list[int], frames: list[bytes]):
        self.ends, self.frames, self._kept = ends, frames, (-1, b"")
        self._open = zstandard.ZstdDecompressor().decompress

    @property
    def size(self) -> int:
        return self.ends[-1] if self.ends else 0

    def start(self, i: int) -> int:
        return self.ends[i - 1] if i else 0

    def raw(self, i: int) -> bytes:
        if self._kept[0] != i:
            self._kept = (i, self._open(self.frames[i]))
        return self._kept[1]

    def read(self, lo: int, hi: int) -> Iterator[bytes]:
        """Bytes lo to hi, frame by frame; only frames that hold some of them are decompressed."""
        i = bisect_right(self.ends, lo)
        while lo < hi:
            at, to = self.start(i), min(hi, self.ends[i])
            yield self.raw(i)[lo - at : to - at]
            lo, i = to, i + 1

    def find(self, what: bytes, lo: int) -> int:
        """Place of the first `what` at or after lo, also where it lies across frames; -1 if there is none."""
        tail = b""
        for part in self.read(lo, self.size):
            seen = tail + part
            at = seen.find(what)
            if at >= 0:
                return lo - len(tail) + at
            lo += len(part)
            tail = seen[max(0, len(seen) - len(what) + 1) :]
        return -1


class Writer:
    """Collects bytes and whole frames in order; bytes become frames of at most `most` bytes."""

    def __init__(self, most: int, level: int):
        self.most, self.held, self.ends, self.frames = most, bytearray(), [], []
        self._pack = zstandard.ZstdCompressor(level=level).compress

    def _put(self, size: int, frame: bytes) -> None:
        self.ends.append((self.ends[-1] if self.ends else 0) + size)
        self.frames.append(frame)

    def add(self, raw: bytes) -> None:
        self.held += raw
        while len(self.held) > self.most:
            self._put(self.most, self._pack(bytes(self.held[: self.most])))
            del self.held[: self.most]

    def pass_on(self, size: int, frame: bytes) -> None:
        self.flush()
        self._put(size, frame)

    def flush(self) -> None:
        if self.held:
            self._put(len(self.held), self._pack(bytes(self.held)))
            self.held = bytearray()


def pieces(raw: bytes, most: int) -> Iterator[bytes]:
    """raw in parts of at most `most` bytes (at least 4), cut between code points."""
    at = 0
    while at < len(raw):
        to = min(len(raw), at + most)
        while at < to < len(raw) and raw[to] & 0xC0 == 0x80:
            to -= 1
        to = to if to > at else min(len(raw), at + most)
        yield raw[at:to]
        at = to


def cut(units: list[int], chars: list[int], text: Frames, n: int, k: int) -> tuple[int, int]:
    """(bytes, code points) before the place after k of n units; units and chars are cumulative per frame."""
    if k == 0:
        return 0, 0
    if k == n:
        return text.size, chars[-1]
    i = bisect_left(units, k)
    raw = text.raw(i)
    at = int(np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)[k - (units[i - 1] if i else 0) - 1]) + 1
    return text.start(i) + at, (chars[i - 1] if i else 0) + code_points(raw[:at])


def _lists(sizes: list[int], kinds: dict[str, pa.DataType], columns: list[list]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], list(kinds)))


def _columns(lists: pa.ListArray) -> tuple[list[int], list[list]]:
    flat, offsets = lists.values, np.asarray(lists.offsets).tolist()
    return offsets, [flat.field(i).to_pylist() for i in range(flat.type.num_fields)]


def store(docs: DataFrame, markers: tuple[str, str, str] = MARKERS, frame_bytes: int = 256 << 10, level: int = 1) -> DataFrame:
    """doc_id, n (units), marked (holds a marker) and frames of every row; a null text is empty and has no frame.

    Frames carry cumulative units, bytes and code points. Rows are kept one by one: repeated rows,
    null doc_ids and columns of other names change nothing. An empty table gives an empty result.
    """
    tags = [m.encode() for m in markers]
    kinds = {"units": pa.int64(), "bytes": pa.int64(), "chars": pa.int64(), "frame": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=level).compress
        for b in batches:
            n, marked, sizes, made = [], [], [], ([], [], [], [])
            for x in b.column(1).cast(pa.binary()):
                raw = x.as_py() or b""
                units = size = chars = count = 0
                for part in pieces(raw, frame_bytes):
                    units, size, chars, count = units + part.count(b"\n"), size + len(part), chars + code_points(part), count + 1
                    for to, v in zip(made, (units, size, chars, pack(part))):
                        to.append(v)
                n.append(units + bool(raw and not raw.endswith(b"\n")))
                marked.append(any(t in raw for t in tags))
                sizes.append(count)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(marked, pa.bool_()), _lists(sizes, kinds, made)], ["doc_id", "n", "marked", "frames"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, STORED)


def choices(doc_id: int | None, n: int, salt: str = "7") -> tuple[int, int, int, int]:
    """First cut, second cut and two numbers for form and order, from the SHA-256 of salt:doc_id (nothing for null)."""
    h = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(h[i : i + 4], "big") for i in (0, 4, 8, 12))
    a, b = h1 % (n + 1), h2 % (n + 1)
    return min(a, b), max(a, b), h3, h4


def transform(stored: DataFrame, salt: str = "7", rate: int = 100, spm_rate: int = 50, markers: tuple[str, str, str] = MARKERS, frame_bytes: int = 256 << 10, level: int = 1) -> DataFrame:
    """Form, sizes and output frames of every stored row.

    plain, the text as it is: for empty texts, those that hold a marker, and 100 - rate of a hundred others.
    psm: prefix, suffix, middle, each behind its marker; spm (spm_rate of a hundred): suffix, prefix, middle.
    prefix_chars and middle_chars are code points, null if plain.
    """
    pre, suf, mid = (m.encode() for m in markers)
    kinds = {"bytes": pa.int64(), "frame": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, (units, ends, chars, frames) = _columns(b.column(3))
            out, sizes, made = [], [], ([], [])
            for i, (doc_id, n, marked) in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)))):
                at = slice(offsets[i], offsets[i + 1])
                text = Frames(ends[at], frames[at])
                first, second, h3, h4 = choices(doc_id, n, salt)
                if n == 0 or marked or h3 % 100 >= rate:
                    out.append(("plain", None, None))
                    sizes.append(len(text.ends))
                    made[0].extend(text.ends)
                    made[1].extend(text.frames)
                    continue
                (p, pc), (m, mc) = (cut(units[at], chars[at], text, n, k) for k in (first, second))
                spm = h4 % 100 < spm_rate
                w = Writer(frame_bytes, level)

                def copy(tag, lo, hi, w=w, text=text):
                    w.add(tag)
                    f = bisect_right(text.ends, lo)
                    while lo < hi:
                        start, end = text.start(f), text.ends[f]
                        if lo == start and hi >= end and len(text.ends) > 1:
                            w.pass_on(end - start, text.frames[f])
                        else:
                            w.add(text.raw(f)[lo - start : min(hi, end) - start])
                        lo, f = min(hi, end), f + 1

                parts = [(pre, 0, p), (suf, m, text.size)]
                for part in (*(reversed(parts) if spm else parts), (mid, p, m)):
                    copy(*part)
                w.flush()
                out.append(("spm" if spm else "psm", pc, mc - pc))
                sizes.append(len(w.ends))
                made[0].extend(w.ends)
                made[1].extend(w.frames)
            form, prefix, middle = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), _lists(sizes, kinds, made)],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return stored.select("doc_id", "n", "marked", "frames").mapInArrow(run, TRANSFORMED)


def restored(form: str, output: Frames, markers: tuple[str, str, str] = MARKERS) -> Iterator[bytes]:
    """The text, part by part, from the output and its form alone."""
    if form == "plain":
        yield from output.read(0, output.size)
        return
    pre, suf, mid = (m.encode() for m in markers)
    head, second = (pre, suf) if form == "psm" else (suf, pre)
    one, two = (a := len(head)), output.find(second, a)
    three = output.find(mid, two + len(second))
    if two < 0 or three < 0 or b"".join(output.read(0, a)) != head:
        raise ValueError("markers missing")
    x, y = (one, two), (two + len(second), three)
    prefix, suffix = (x, y) if form == "psm" else (y, x)
    for lo, hi in (prefix, (three + len(mid), output.size), suffix):
        yield from output.read(lo, hi)


def digests(transformed: DataFrame, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """output_sha256 and restored_sha256 in place of the output frames, which are streamed in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, (ends, frames) = _columns(b.column(5))
            out, back = [], []
            for i, form in enumerate(b.column(2).to_pylist()):
                at = slice(offsets[i], offsets[i + 1])
                text = Frames(ends[at], frames[at])
                for parts, to in ((text.read(0, text.size), out), (restored(form, text, markers), back)):
                    h = hashlib.sha256()
                    for part in parts:
                        h.update(part)
                    to.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(5)), pa.array(out, pa.string()), pa.array(back, pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])

    return transformed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def texts(transformed: DataFrame) -> DataFrame:
    """doc_id, form and the output as one string, for use in training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            offsets, (frames,) = _columns(b.column(2))
            whole = [b"".join(map(unpack, frames[lo:hi])).decode("utf-8", "replace") for lo, hi in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(whole, pa.string())], ["doc_id", "form", "text"])

    return transformed.select("doc_id", "form", F.transform("output", lambda x: F.struct(x["frame"].alias("frame"))).alias("output")).mapInArrow(run, "doc_id long, form string, text string")


def query(spark, sf_dir: str) -> DataFrame:
    return digests(transform(stash(store(documents(spark, sf_dir)), "frames")))


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id) AS h FROM documents
), h AS (
  SELECT doc_id, text, u, len(u) AS n, h, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS h1, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS h2,
         text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') AS plain, CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 AS spm
  FROM t
), p AS (
  SELECT doc_id, text, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(u[1:least(h1, h2)], '') AS pre, array_to_string(u[least(h1, h2) + 1:greatest(h1, h2)], '') AS mid, array_to_string(u[greatest(h1, h2) + 1:], '') AS suf
  FROM h
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
