"""Licence scans over a positional rare-token index. DataFrame functions only.

A template is a short word sequence with a label; its mandatory words are its key phrase.
One pass over all documents counts in how many each template word occurs. Every template
is then looked up by its two mandatory words of highest inverse document frequency: where
a document has both at the distance they have in the template, the template may start, and
the key phrase is verified word by word there. A verified key phrase always holds both rare
words, so no place is missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Label, template words, key phrase (its words are mandatory; all words where None).
BASE = (
    ("cc-by", "cc by", None),
    ("gpl", "general public license", None),
    ("reserved", "all rights reserved", None),
)
OWN = (
    ("agpl", "gnu affero general public license", "affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("bsd", "bsd license", None),
    ("cc-by-nc", "licensed under cc by nc", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    ("cc0", "cc0 1 0 universal", "cc0 1 0"),
    ("gpl-2.0", "gnu general public license version 2", "general public license version 2"),
    ("gpl-3.0", "gnu general public license version 3", "general public license version 3"),
    ("isc", "isc license", None),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mpl-2.0", "mozilla public license version 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software released"),
)
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def templates(base=BASE, own=OWN) -> list[dict]:
    """Templates as word lists with the positions of their mandatory words."""
    out = []
    for kind, rows in ((True, base), (False, own)):
        for label, text, key in rows:
            words, need = text.split(), (key or text).split()
            at = next(i for i in range(len(words) - len(need) + 1) if words[i : i + len(need)] == need)
            out.append({"label": label, "words": words, "need": list(range(at, at + len(need))), "base": kind})
    return out


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), WORD_BREAK), lambda w: w != "")


def document_frequency(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """Number of documents that hold each of the given words, over all documents; one row per word comes back."""
    found = docs.select(F.explode(F.array_intersect(words_of(F.col("text")), F.array(*map(F.lit, words)))).alias("w"))
    return {r["w"]: r["n"] for r in found.groupBy("w").agg(F.count("*").alias("n")).collect()}


def anchors(ts: list[dict], df: dict[str, int]) -> list[list[int]]:
    """Per template the positions of its one or two mandatory words of highest inverse document frequency."""
    out = []
    for t in ts:
        distinct = {t["words"][i]: i for i in reversed(t["need"])}
        out.append([distinct[w] for w in sorted(distinct, key=lambda w: (df.get(w, 0), w))[:2]])
    return out


def scan(docs: DataFrame, ts: list[dict] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    score is the largest share of a verified template's words that stand where the template
    has them; 0 without one. Null and empty texts have no words. Repeated rows get the same
    answer; only doc_id and text are read, so clashing names among other columns do no harm.
    """
    ts = ts or templates()
    places = anchors(ts, document_frequency(docs, sorted({t["words"][i] for t in ts for i in t["need"]})))
    struct = lambda **kw: F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in kw.items()])
    rare = sorted({ts[k]["words"][i] for k, at in enumerate(places) for i in at})
    postings = F.array(*[struct(w=ts[k]["words"][i], t=k, at=i, a=a) for k, p in enumerate(places) for a, i in enumerate(p)])
    single = [k for k, p in enumerate(places) if len(p) == 1]
    bodies = F.array(*[F.array(*map(F.lit, t["words"])) for t in ts])
    needs = F.array(*[F.array(*map(F.lit, t["need"])) for t in ts])
    labels = F.array(*[F.lit(t["label"]) for t in ts])
    n_base = sum(t["base"] for t in ts)
    words = F.col("words")

    hits = F.filter(F.transform(words, lambda w, i: F.when(w.isin(rare), F.struct(w.alias("w"), i.alias("i")))), lambda h: h.isNotNull())
    # a template and where it would start, in one long: arrays of longs intersect by hash
    pair = lambda t, off: F.shiftleft(t.cast("long"), 40) + off + (1 << 39)
    votes = F.flatten(F.transform(hits, lambda h: F.transform(F.filter(postings, lambda p: p["w"] == h["w"]), lambda p: struct(t=p["t"], start=pair(p["t"], h["i"] - p["at"]), a=p["a"]))))
    of = lambda v: F.transform(v, lambda x: x["start"])
    second = F.filter(F.col("votes"), lambda v: (v["a"] == 1) | v["t"].isin(single) if single else v["a"] == 1)
    both = F.array_intersect(of(F.filter(F.col("votes"), lambda v: v["a"] == 0)), of(second))
    starts = F.transform(both, lambda x: struct(t=F.shiftright(x, 40).cast("int"), off=(x.bitwiseAND(F.lit((1 << 40) - 1)) - (1 << 39)).cast("int")))

    def same(c, i):
        return F.coalesce(F.get(words, c["off"] + i) == F.get(F.get(bodies, c["t"]), i), F.lit(False))

    checked = F.filter(F.col("starts"), lambda c: F.forall(F.get(needs, c["t"]), lambda i: same(c, i)))
    share = F.transform(F.col("found"), lambda c: F.size(F.filter(F.sequence(F.lit(0), F.size(F.get(bodies, c["t"])) - 1), lambda i: same(c, i))) / F.size(F.get(bodies, c["t"])))
    label_text = lambda v: F.array_join(F.array_sort(F.array_distinct(F.transform(v, lambda c: F.get(labels, c["t"])))), ",")
    offs = F.transform(F.col("base"), lambda c: c["off"].cast("long"))

    rows = docs.select(F.col("doc_id"), words_of(F.col("text")).alias("words"))
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), F.when(F.arrays_overlap("words", F.array(*map(F.lit, rare))), words).otherwise(F.array().cast("array<string>")).alias("words"))
    rows = rows.withColumn("votes", votes).withColumn("starts", starts).withColumn("found", checked).withColumn("base", F.filter("found", lambda c: c["t"] < n_base))
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(offs).alias("first_word"), F.array_max(offs).alias("last_word"),
        label_text(F.col("base")).alias("base_labels"), label_text(F.col("found")).alias("labels"), F.coalesce(F.array_max(share), F.lit(0.0)).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    return scan(documents(spark, sf_dir))


def sql() -> str:
    """The same answer in DuckDB: each template's key phrase is looked for at every word."""
    places, shares = [], []
    for k, t in enumerate(templates()):
        first = t["need"][0]
        key = " AND ".join(f"w[i + {p - first + 1}] = '{t['words'][p]}'" for p in t["need"])
        places.append(f"list_filter(range(len(w)), lambda i: coalesce({key}, false)) AS p{k}")
        hit = " + ".join(f"CASE WHEN i + {p - first + 1} >= 1 AND w[i + {p - first + 1}] = '{w}' THEN 1 ELSE 0 END" for p, w in enumerate(t["words"]))
        shares.append(f"coalesce(list_max(list_transform(p{k}, lambda i: ({hit}) / {len(t['words'])}.0::DOUBLE)), 0.0)")
    ts = templates()
    base = [k for k, t in enumerate(ts) if t["base"]]
    offs = " || ".join(f"p{k}" for k in base)
    names = lambda ks: "array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{ts[k]['label']}' END" for k in ks) + "], lambda x: x IS NOT NULL))), ',')"
    breaks = WORD_BREAK.removesuffix("+")
    return f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{breaks}+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, {", ".join(places)} FROM d)
SELECT doc_id, len(w)::BIGINT AS n_words, len({offs})::BIGINT AS n_base, list_min({offs})::BIGINT AS first_word, list_max({offs})::BIGINT AS last_word,
  {names(base)} AS base_labels, {names(range(len(ts)))} AS labels, greatest({", ".join(shares)})::DOUBLE AS score
FROM p"""
