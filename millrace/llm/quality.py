"""Quality rules: document statistics scored by gradient-boosted trees.

The trees are grown here from class histograms, with monotonic constraints on chosen
features (repetition, repeated lines and symbols can only lower a score), and flattened
into numpy node arrays: complete binary trees, walked for all rows and trees at once.
They are fitted on at most `max_train` labelled rows (chosen by a hash of doc_id); every
row of the table is scored on its whole text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE = np.array([0x20, 9, 10, 11, 12, 13])
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_PUNCT = np.frombuffer(b".,;:!?'\"()-", np.uint8)
FEATURES = ("log_words", "mean_word_chars", "symbols_per_word", "dup_line_share", "repeat_share", "distinct_share", "digit_share", "upper_share", "high_byte_share", "punct_share", "lines_per_word", "longest_word", "top_word_share", "short_word_share")
#: -1: a larger value never raises the score.
MONOTONE = {"symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1}


def repeated_words(codes: np.ndarray, k: int, window: int = 5) -> int:
    """Words that lie in a window of `window` words found twice or more."""
    n = len(codes) - window + 1
    if n < 2:
        return 0
    if k**window < 2**62:
        key = codes[:n].copy()
        for i in range(1, window):
            key = key * k + codes[i : i + n]
    else:  # exact ranks of ever longer windows
        key = codes[:n]
        for i in range(1, window):
            key = np.unique(key * k + codes[i : i + n], return_inverse=True)[1]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    edge = np.zeros(len(codes) + 1, np.int64)
    edge[:n] += hit
    edge[window : window + n] -= hit
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(raw: bytes) -> tuple[int, int, int, int, int, list[float]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the features of one text."""
    words = raw.split()
    n = len(words)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    points = len(raw) - int(hist[0x80:0xC0].sum())
    word_chars = points - int(hist[_SPACE].sum())
    symbols = int(hist[_SYMBOLS].sum())
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    if not n:
        return 0, word_chars, symbols, dup, 0, [0.0] * len(FEATURES)
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    codes = np.fromiter(map(index.__getitem__, words), np.int64, n)
    repeat = repeated_words(codes, len(index))
    sizes = np.fromiter(map(len, words), np.int64, n)
    size = max(len(raw), 1)
    feats = [
        np.log1p(n), word_chars / n, symbols / n, dup / max(len(lines), 1), repeat / n, len(index) / n, hist[48:58].sum() / size,
        hist[65:91].sum() / size, hist[128:].sum() / size, hist[_PUNCT].sum() / size, len(lines) / n, sizes.max(), np.bincount(codes).max() / n, (sizes <= 2).sum() / n,
    ]
    return n, word_chars, symbols, dup, repeat, [float(x) for x in feats]


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < 10 or 100 * n_repeat > 20 * n_words


# ---- trees ------------------------------------------------------------------------------


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, l2: float = 2.0, least: int = 15) -> dict:
    """Newton boosting of the logistic loss on quantile bins; complete trees of `depth`.

    A split on a constrained feature must keep its children in order, and their values
    bound all values below them, so the whole score is monotone in that feature.
    """
    n, f = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(f)]
    q = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1) if n else np.zeros((0, f), int)
    rate0 = (y.sum() + 1) / (n + 2)
    base = float(np.log(rate0 / (1 - rate0)))
    out = {"base": base, "feature": np.zeros((trees, 2**depth - 1), np.int32), "threshold": np.full((trees, 2**depth - 1), np.inf), "value": np.zeros((trees, 2**depth)), "depth": depth}
    score = np.full(n, base)
    for t in range(trees if n else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node, bound = np.zeros(n, int), {0: (-np.inf, np.inf)}
        for level in range(depth):
            nxt = {}
            for k in range(2**level):
                at = 2**level - 1 + k
                lo, hi = bound[k]
                rows = np.flatnonzero(node == k)
                best = (1e-6, None)
                gs, hs = g[rows].sum(), h[rows].sum()
                if len(rows) >= 2 * least:
                    for j in range(f):
                        if not len(cuts[j]):
                            continue
                        m, b = len(cuts[j]) + 1, q[rows, j]
                        cg, ch, cn = (np.cumsum(np.bincount(b, w, m))[:-1] for w in (g[rows], h[rows], None))
                        vl, vr = np.clip(cg / (ch + l2), lo, hi), np.clip((gs - cg) / (hs - ch + l2), lo, hi)
                        gain = vl * cg - 0.5 * vl**2 * (ch + l2) + vr * (gs - cg) - 0.5 * vr**2 * (hs - ch + l2)
                        v0 = np.clip(gs / (hs + l2), lo, hi)
                        gain -= v0 * gs - 0.5 * v0**2 * (hs + l2)
                        ok = (cn >= least) & (len(rows) - cn >= least) & ((vr - vl) * monotone[j] >= 0)
                        gain[~ok] = -np.inf
                        i = int(gain.argmax())
                        if gain[i] > best[0]:
                            best = (gain[i], (j, i, vl[i], vr[i]))
                if best[1] is None:
                    nxt[2 * k] = nxt[2 * k + 1] = (lo, hi)
                    node[rows] = 2 * k
                    continue
                j, i, vl, vr = best[1]
                out["feature"][t, at], out["threshold"][t, at] = j, cuts[j][i]
                mid = (vl + vr) / 2
                nxt[2 * k], nxt[2 * k + 1] = ((lo, mid), (mid, hi)) if monotone[j] > 0 else ((mid, hi), (lo, mid)) if monotone[j] < 0 else ((lo, hi), (lo, hi))
                node[rows] = 2 * k + (q[rows, j] > i)
            bound = nxt
        value = np.bincount(node, g, 2**depth) / (np.bincount(node, h, 2**depth) + l2)
        value = rate * np.array([np.clip(v, *bound[k]) for k, v in enumerate(value)])
        out["value"][t] = value
        score += value[node]
    return out


def score_trees(model: dict, x: np.ndarray) -> np.ndarray:
    """Probability of a good document for each row of x: all trees of all rows step down together."""
    trees = np.arange(len(model["value"]))
    out = np.empty(len(x))
    for lo in range(0, len(x), 4096):
        part = x[lo : lo + 4096]
        at = np.zeros((len(part), len(trees)), np.int64)
        rows = np.arange(len(part))[:, None]
        for _ in range(model["depth"]):
            at = 2 * at + 1 + (part[rows, model["feature"][trees, at]] > model["threshold"][trees, at])
        out[lo : lo + 4096] = model["value"][trees, at - (2 ** model["depth"] - 1)].sum(1) + model["base"]
    return 1 / (1 + np.exp(-out))


# ---- on tables --------------------------------------------------------------------------


def _features(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            got = [statistics(x or b"") for x in b.column(1).cast(pa.binary()).to_pylist()]
            cols = [b.column(0), *(pa.array([r[i] for r in got], pa.int64()) for i in range(5)), pa.array([r[5] for r in got], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 8000, good_loss: float = 0.002) -> dict:
    """A model from at most max_train labelled rows, and the score under which a document goes.

    The cut-off loses at most the share good_loss of the sample's good documents. With no
    labelled bad or good document it is 0 and the model rejects nothing.
    """
    known = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").alias("__id"), F.col("quality").alias("__quality")).dropDuplicates(["__id"])
    n = known.count()
    share = min(1.0, max_train / max(n, 1))
    picked = known.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) < int(share * (1 << 20))).limit(max_train)
    rows = docs.join(F.broadcast(picked), docs["doc_id"] == F.col("__id")).select("doc_id", "text", "__quality")

    def run(batches):
        for b in batches:
            got = [statistics(x or b"") for x in b.column(1).cast(pa.binary()).to_pylist()]
            keep = [not base_failed(r[0], r[4]) for r in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[5] for r in got], pa.list_(pa.float64())), b.column(2), pa.array(keep)], ["id", "x", "y", "passed"])

    got = rows.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("__quality").cast("long")).mapInArrow(run, "id long, x array<double>, y long, passed boolean").limit(2 * max_train).collect()
    got.sort(key=lambda r: (r.id, r.x))
    x = np.array([r.x for r in got], float).reshape(-1, len(FEATURES))
    y = np.array([r.y > 0 for r in got], float)
    model = fit_trees(x, y, np.array([MONOTONE.get(f, 0) for f in FEATURES]))
    good = np.sort(score_trees(model, x[(y > 0) & np.array([r.passed for r in got], bool)])) if len(got) else np.zeros(0)
    bad = len(got) > 0 and (y == 0).any()
    model["cut"] = float(min(0.5, good[int(len(good) * good_loss)])) if len(good) and bad else 0.0
    return model


def apply_rules(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, the base counts, base_failed, score and kept of every row.

    Null and empty texts have no words and fail the base rule; repeated rows are judged each
    for itself, alike; other columns are not read.
    """

    def run(batches):
        for b in batches:
            x = np.array(b.column(6).flatten()).reshape(-1, len(FEATURES))
            n, rep = np.asarray(b.column(1)), np.asarray(b.column(5))
            failed = (n < 10) | (100 * rep > 20 * n)
            score = score_trees(model, x)
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(failed), pa.array(score), pa.array(~failed & (score >= model["cut"]))], [*b.schema.names[:6], "base_failed", "score", "kept"])

    return _features(docs).mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean")


def keep_good(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""

    @F.pandas_udf("boolean")
    def kept(text: pd.Series) -> pd.Series:
        got = [statistics((t or "").encode()) for t in text]
        score = score_trees(model, np.array([r[5] for r in got], float).reshape(-1, len(FEATURES)))
        return pd.Series([not base_failed(r[0], r[4]) and s >= model["cut"] for r, s in zip(got, score)], dtype=bool)

    return docs.where(kept(F.col("text").cast("string")))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import documents, table

    docs = documents(spark, sf_dir)
    return apply_rules(docs, fit(docs, table(spark, sf_dir, "labels")))
