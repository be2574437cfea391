"""Words of many texts at once: numpy finds them in the joined bytes, Arrow numbers the different ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The white space between words, space and \t to \r.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER, _MARK, _AFTER = (np.zeros(256, bool) for _ in range(3))
_LETTER[ord("a") : ord("z") + 1] = True
_MARK[[ord("."), ord(",")]] = True
_AFTER[[ord(" "), ord("\n")]] = True


class Words:
    """terms: the different words; codes: of every word in order, its number in terms; sizes: words of each text."""

    def __init__(self, buf: np.ndarray, start: np.ndarray, length: np.ndarray | None, begins: np.ndarray):
        """start, length: of words in buf, whose bytes outside words are gone already; begins: of texts, as numbers of words."""
        ends = np.append(start[1:], len(buf)) if length is None else start + length
        offsets = np.concatenate((start[:1], ends)).astype(np.int32) if len(start) else np.zeros(1, np.int32)
        got = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(buf)]).dictionary_encode()
        self.terms, self.codes = got.dictionary, np.asarray(got.indices)
        self.sizes = np.diff(np.append(begins, len(start)))

    def spread(self, starts: np.ndarray, sizes: np.ndarray, pool: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word replaced by pool[start : start + size] of its term; and where the values of each text end."""
        n = sizes[self.codes]
        ends = np.cumsum(n)
        at = np.repeat(starts[self.codes] - (ends - n), n)
        at += np.arange(len(at))
        return pool[at], np.concatenate(([0], ends))[np.cumsum(self.sizes)]


def split(texts: list[bytes], lower: bool = True, marks: bool = False) -> Words:
    """Words between white space, A-Z lower-cased if `lower`.

    marks: a full stop or comma after a-z and before a blank or line end is a word of its own.
    """
    joined = b"\r" + b"\r".join(texts)  # the text's own bytes never stand next to another text's
    buf = np.frombuffer(joined.lower() if lower else joined, np.uint8)
    space = _SPACE[buf]
    word = ~space
    start = word.copy()
    start[1:] &= space[:-1]
    if marks:
        own = np.flatnonzero(_MARK[buf[1:-1]]) + 1
        start[own[_LETTER[buf[own - 1]] & _AFTER[buf[own + 1]]]] = True
    at = np.flatnonzero(start)
    kept = buf[word]
    # the place of a word among the bytes that are no white space
    places = np.cumsum(word, dtype=np.int32)[at] - 1 if len(at) else np.zeros(0, np.int32)
    texts_at = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - np.fromiter(map(len, texts), np.int64, len(texts))
    return Words(kept, places, None, np.searchsorted(at, texts_at))


def chunks(batches, column: int, size: int = 8 << 20, rows: int = 1 << 14) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of record batches of about `size` bytes of text and at most `rows` rows, with their texts; a null text is empty."""
    for b in batches:
        texts = b.column(column).cast(pa.binary())
        ends, at = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)), 0
        while at < b.num_rows:
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size))))
            yield b.slice(at, to - at), [x or b"" for x in texts.slice(at, to - at).to_pylist()]
            at = to
