"""Language identification by hierarchical discrimination.

A text becomes square-root scaled counts of its hashed byte 2- and 3-grams. Linear support
vector machines separate language families first (one against one between families); inside
the winning family one-versus-one machines between its languages vote. The machines are
trained by dual coordinate descent on at most `max_per_language` texts of each language,
picked by a hash of doc_id; every text of the table is read whole.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Families of closely related languages. A language not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
}
UNKNOWN = "und"


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), f"only {lang}")


def features(raw: bytes, width: int) -> np.ndarray:
    """Unit vector of hashed 2- and 3-gram counts, ASCII letters lower-cased, other ASCII folded into blanks."""
    b = _FOLD[np.frombuffer(b" " + raw + b" ", np.uint8)]
    two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] + b[2:] * np.uint32(0xC2B2AE3D)
    shift = np.uint32(32 - int(width).bit_length() + 1)
    x = np.zeros(width)
    for h in (two, three):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        x += np.bincount(h >> shift, minlength=width)
    x = np.sqrt(x)
    return (x / np.linalg.norm(x)).astype(np.float32)


_FOLD = np.array([b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint32)


def has_letter(raw: bytes) -> bool:
    return any(c.isalpha() for c in raw[:200].decode(errors="ignore")) or any(c.isalpha() for c in raw.decode(errors="ignore"))


def fit_svm(x: np.ndarray, rows: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 12) -> np.ndarray:
    """Weights of a linear machine (hinge loss, dual coordinate descent) on the given rows of x, which are unit vectors; y is +1 or -1.

    Bias is the last weight. Works on x in place of a copy: the sample is the largest thing the driver holds.
    """
    w, bias, a = np.zeros(x.shape[1]), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            v = x[rows[i]]
            new = min(max(a[i] - (y[i] * (w @ v + bias) - 1) / 2.0, 0.0), c)
            if new != a[i]:
                w += (new - a[i]) * y[i] * v
                bias += (new - a[i]) * y[i]
                moved += abs(new - a[i])
                a[i] = new
        if moved < 1e-3:
            break
    return np.append(w, bias)


def fit_hierarchy(x: np.ndarray, langs: list[str]) -> dict:
    """Machines between families, and between the languages of each family."""
    langs_of: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        langs_of.setdefault(family_of(lang), []).append(lang)
    lang, fam = np.array(langs, dtype=object), np.array([family_of(v) for v in langs], dtype=object)

    def between(names: list[str], of: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        out = []
        for i, j in itertools.combinations(range(len(names)), 2):
            rows = np.flatnonzero((of == names[i]) | (of == names[j]))
            out.append((i, j, fit_svm(x, rows, np.where(of[rows] == names[i], 1.0, -1.0))))
        return out

    families = sorted(langs_of)
    return {"families": families, "machines": between(families, fam), "langs": langs_of, "inner": {f: between(v, lang) for f, v in langs_of.items()}}


def _vote(x: np.ndarray, n: int, machines: list) -> tuple[np.ndarray, np.ndarray]:
    """Winner of each row by votes, ties by summed margins, and a confidence from 0 to 1."""
    votes, margin, least = np.zeros((len(x), n)), np.zeros((len(x), n)), np.full((len(x), n), np.inf)
    for i, j, w in machines:
        m = x @ w[:-1] + w[-1]
        votes[:, i] += m > 0
        votes[:, j] += m <= 0
        margin[:, i] += m
        margin[:, j] -= m
        least[:, i], least[:, j] = np.minimum(least[:, i], m), np.minimum(least[:, j], -m)
    best = (votes + 0.5 * np.tanh(margin)).argmax(1) if n > 1 else np.zeros(len(x), int)
    return best, 1 / (1 + np.exp(-3 * least[np.arange(len(x)), best])) if n > 1 else np.ones(len(x))


def predict(model: dict, raw: list[bytes | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; `und` and 0 for null, no letter, or nothing learned."""
    langs, score = [UNKNOWN] * len(raw), np.zeros(len(raw))
    if not model["families"]:
        return langs, score
    for lo in range(0, len(raw), 256):
        rows = [i for i in range(lo, min(len(raw), lo + 256)) if raw[i] and has_letter(raw[i])]
        if not rows:
            continue
        x = np.stack([features(raw[i], model["width"]) for i in rows]).astype(np.float64)
        fam, sure = _vote(x, len(model["families"]), model["machines"])
        for k in np.unique(fam):
            of, name = np.flatnonzero(fam == k), model["families"][k]
            lang, inner = _vote(x[of], len(model["langs"][name]), model["inner"][name])
            for i, v, s in zip(of, lang, sure[of] * inner):
                langs[rows[i]], score[rows[i]] = model["langs"][name][v], s
    return langs, score


def fit(docs: DataFrame, folds: int = 5, max_per_language: int = 1000, width: int = 4096) -> dict:
    """Learn from text and lang of rows whose crc32(doc_id as text) mod folds is not 0.

    The sample holds at most about max_per_language texts of each language (a null doc_id
    counts as empty text). A table without such rows gives a model that predicts `und`.
    """
    rest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds != 0
    rows = docs.where(rest & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.create_map(*[F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, int(min(1.0, max_per_language / n) * (1 << 20)))]) if counts else None
    if share is None:
        return {"families": [], "machines": [], "langs": {}, "inner": {}, "width": width}
    picked = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < share[F.col("lang")])

    def run(batches):
        for b in batches:
            raw, langs = b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist()
            keep = [i for i, x in enumerate(raw) if has_letter(x)]
            yield pa.RecordBatch.from_arrays([pa.array([features(raw[i], width).astype(np.float16).tobytes() for i in keep], pa.binary()), pa.array([langs[i] for i in keep], pa.string())], ["x", "lang"])

    got = picked.select("text", "lang").mapInArrow(run, "x binary, lang string").limit(2 * max_per_language * len(counts)).toArrow()
    langs, x = got["lang"].to_pylist(), np.zeros((got.num_rows, width), np.float32)
    for i, row in enumerate(v for part in got["x"].chunks for v in part):
        x[i] = np.frombuffer(row.as_buffer(), np.float16)
    del got
    order = sorted(range(len(langs)), key=lambda i: (langs[i], zlib.crc32(x[i])))  # whatever order tasks end in
    x, langs = x[order], [langs[i] for i in order]
    return fit_hierarchy(x, langs) | {"width": width}


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred and score of every row.

    A null text, or one without a letter, is `und` with score 0. Repeated rows get the same
    answer. Only doc_id and text are read.
    """

    def run(batches):
        for b in batches:
            langs, score = predict(model, b.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs that have a language (not `und`), with all their columns."""

    @F.pandas_udf("string")
    def lang(text: pd.Series) -> pd.Series:
        return pd.Series(predict(model, [None if t is None else t.encode() for t in text])[0])

    return docs.where(lang(F.col("text").cast("string")) != UNKNOWN)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    docs = documents(spark, sf_dir)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return identify(docs, fit(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
