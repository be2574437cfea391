"""Extractors and embedders given by the user, run in Arrow tasks with their contracts checked; what breaks one is a value of its row and stops no other."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes of a document to the texts of its pages; an exception in place of a text is that page's error.
Extractor = Callable[[bytes], Sequence["str | Exception"]]
#: texts to one vector each, in their order.
Embedder = Callable[[list[str]], Sequence[Sequence[float]]]


def _reason(e: BaseException) -> str:
    return f"{type(e).__name__}: {e}"[:500]


def read_binary(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, content) of files below a folder. Spark's file readers pass over files of zero bytes, so these have no row."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "content")


def page_text(files: DataFrame, extract: Extractor, key: str = "path") -> DataFrame:
    """(key, page_number, text, error) of files(key, content): a row per page, numbered from 1.

    A page that fails has an empty text and its error. A file that fails as a whole, is null or has no pages is one row of page 0 with
    an empty text and an error. Null page texts are empty. Pages are handed on 256 at a time; a file is held whole by its extractor.
    """
    kind = files.schema[key].dataType.simpleString()

    def pages(content) -> list[tuple[int, str, str | None]]:
        if content is None:
            return [(0, "", "no content")]
        try:
            got = list(extract(bytes(content)))
        except Exception as e:  # whatever an extractor raises belongs to its row
            return [(0, "", _reason(e))]
        if not got:
            return [(0, "", "no pages")]
        return [(i, "", _reason(t)) if isinstance(t, Exception) else (i, "" if t is None else str(t), None) for i, t in enumerate(got, 1)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, content in zip(pdf[key], pdf["content"], strict=True):
                rows = pages(content)
                for at in range(0, len(rows), 256):
                    part = rows[at : at + 256]
                    yield pd.DataFrame({key: pd.Series([k] * len(part), dtype=pdf[key].dtype), "page_number": [r[0] for r in part], "text": [r[1] for r in part], "error": pd.Series([r[2] for r in part], dtype=object)})

    return files.select(key, "content").mapInPandas(run, f"`{key}` {kind}, page_number int, text string, error string")


def embed(rows: DataFrame, provider: Embedder, dimension: int, key: str, text: str = "text", batch: int = 64) -> DataFrame:
    """(key, embedding, error) of rows, `batch` texts a call.

    A batch that raises or returns another number of vectors than texts is asked again text by text, so that one bad text costs no other its vector.
    A vector that is no list of numbers, of another length, or holds null or non-finite entries is refused by its row. A null text is refused and not sent.
    """
    kind = rows.schema[key].dataType.simpleString()

    def checked(vector) -> tuple[list[float] | None, str | None]:
        try:
            v = [float(x) for x in vector]
        except (TypeError, ValueError):
            return None, "not numbers"
        if len(v) != dimension:
            return None, f"dimension {len(v)}, not {dimension}"
        return (v, None) if all(map(math.isfinite, v)) else (None, "not finite")

    def asked(texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
        try:
            got = list(provider(texts))
            fault = None if len(got) == len(texts) else f"{len(got)} vectors for {len(texts)} texts"
        except Exception as e:  # whatever a provider raises belongs to its rows
            got, fault = [], _reason(e)
        if fault is None:
            return [checked(v) for v in got]
        return [(None, fault)] if len(texts) == 1 else [asked([t])[0] for t in texts]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                there = part["__text"].notna().to_numpy()
                sent = iter(asked(part["__text"][there].tolist()) if there.any() else [])
                found = [next(sent) if t else (None, "no text") for t in there]
                yield pd.DataFrame({key: part[key].to_numpy(), "embedding": pd.Series([v for v, _ in found], dtype=object), "error": pd.Series([e for _, e in found], dtype=object)})

    return rows.select(key, F.col(text).alias("__text")).mapInPandas(run, f"`{key}` {kind}, embedding array<double>, error string")
