"""Text columns: terms, numbers, page features, canonical ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A term is a run of these ASCII characters, or a run of CJK characters.
ASCII_TERM = r"[a-z0-9_.%-]+"
CJK_TERM = r"[一-鿿]+"
NUMBER = r"(?<![0-9])[-+]?[0-9][0-9,]*(?:\.[0-9]+)?%?"


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once, however often the body names it; lambdas would work it out for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def terms(text: Column) -> Column:
    """Distinct terms: lower-cased ASCII tokens of two or more characters; CJK runs whole up to 8 characters, and all their 2- to 4-grams."""
    low = F.lower(F.coalesce(text, F.lit("")))
    ascii_terms = F.filter(F.regexp_extract_all(low, F.lit(ASCII_TERM), F.lit(0)), lambda t: F.length(t) >= 2)
    cjk = F.regexp_extract_all(low, F.lit(CJK_TERM), F.lit(0))
    none = F.array().cast("array<string>")

    def grams(n: int) -> Column:
        return F.flatten(F.transform(cjk, lambda r: F.when(F.length(r) >= n, F.transform(F.sequence(F.lit(1), F.length(r) - (n - 1)), lambda i: F.substr(r, i, F.lit(n)))).otherwise(none)))

    whole = F.filter(cjk, lambda r: (F.length(r) <= 8) & (F.length(r) >= 2))
    return F.array_distinct(F.concat(ascii_terms, whole, grams(2), grams(3), grams(4)))


def numbers(text: Column) -> Column:
    """Distinct numbers, commas removed and a percent sign kept."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit(""))))


def compact(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")


def term_hits(text: Column, words: tuple[str, ...]) -> Column:
    """Those of the words that occur in the text, whatever the case, in the order given."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(low.contains(w.lower()), F.lit(w)) for w in words]))


def sha_key(*parts: Column) -> Column:
    """Deterministic key: SHA-256 of the parts joined by colons; a null part is empty."""
    return F.sha2(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def candidate_id(**fields: Column) -> Column:
    """SHA-256 of the compact JSON of the fields in sorted order, nulls included."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def cut_bytes(text: Column, most: int) -> Column:
    """The longest prefix of whole characters that takes at most `most` UTF-8 bytes, by halving."""
    steps = [1 << i for i in range(most.bit_length() - 1, -1, -1)]
    n = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda k, s: F.when(F.octet_length(F.substr(text, F.lit(1), k + s)) <= most, k + s).otherwise(k))
    return F.substr(text, F.lit(1), n)


def within_budget(text: Column, most: int) -> Column:
    """struct(text, omitted, chars, bytes, sha256): the text if it fits its byte budget, else its prefix and what identifies the whole."""
    over = F.octet_length(text) > most
    return F.struct(F.when(over, cut_bytes(text, most)).otherwise(text).alias("text"), over.alias("omitted"), F.when(over, F.length(text)).cast("long").alias("chars"), F.when(over, F.octet_length(text)).cast("long").alias("bytes"), F.when(over, F.sha2(text, 256)).alias("sha256"))
