"""Tables from parsers that answer in different shapes, brought to one form."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import let

from .htmltables import first_markdown

# The fields that make an object a table, and what stands for a table that could not be read.
TABLE_FIELDS = ("pred_html", "ocr_text", "table_markdown", "table_html")
PLACEHOLDERS = ("no extractable cells", "[table: no extractable cells]", "[table on page")

_NONE = "array<variant>"


def _kind(v: Column) -> Column:
    """string, object, array or another kind of a variant; null for null."""
    kind = F.schema_of_variant(v)
    return F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").otherwise(F.lower(kind))


def table_items(output: Column, depth: int = 4) -> Column:
    """The texts and objects of a parser's output (a variant), in order: lists, and lists under `tables`, are opened up to `depth` deep."""
    listed = lambda v: F.try_variant_get(v, "$", _NONE)
    under = lambda v: F.try_variant_get(v, "$.tables", _NONE)
    opened = lambda v: F.coalesce(F.when(_kind(v) == "array", listed(v)).when(_kind(v) == "object", under(v)), F.array(v))
    items = F.array(output)
    for _ in range(depth):
        items = F.flatten(F.transform(items, opened))
    return F.filter(items, lambda v: _kind(v).isin("string", "object"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _markdowns(htmls: pd.Series) -> pd.Series:
    return htmls.map(lambda row: None if row is None else [first_markdown(x) if x else None for x in row])


def _first(*texts: Column) -> Column:
    """The first text that is not empty."""
    return reduce(lambda later, x: F.when(x != "", x).otherwise(later), reversed(texts))


def _parts(v: Column) -> Column:
    """What a text or object says of one table, as a struct of texts that are never null."""
    is_object = _kind(v) == "object"
    text = lambda path: F.trim(F.coalesce(F.try_variant_get(v, f"$.{path}", "string"), F.lit("")), F.lit(" \n\r\t"))
    of = lambda *paths: F.when(is_object, _first(*map(text, paths))).otherwise("")
    there = reduce(lambda a, b: a | b, [F.try_variant_get(v, f"$.{n}", "variant").isNotNull() for n in TABLE_FIELDS])
    kind = F.lower(of("metadata.content_type", "content_type"))
    fields = {
        "is_table": ~is_object | kind.isin("", "table") | there, "html": of("pred_html", "table_html", "metadata.table_html"), "markdown": of("table_markdown", "metadata.table_markdown"),
        "plain": F.when(is_object, _first(text("ocr_text"), text("content"))).otherwise(F.trim(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("")), F.lit(" \n\r\t"))),
        "conversion": F.lower(of("table_conversion", "metadata.table_conversion")), "upstream": of("provenance_id", "metadata.provenance_id"),
    }
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def is_placeholder(content: Column, conversion: Column) -> Column:
    """The text is empty or says that no cell could be read, or the table was converted as a placeholder."""
    squeezed = F.lower(F.trim(F.regexp_replace(content, r"\s+", " ")))
    return let(squeezed, lambda x: reduce(lambda a, b: a | b, [x.contains(p) for p in PLACEHOLDERS], (x == "") | (conversion == "placeholder")))


def normalize_tables(rows: DataFrame, depth: int = 4) -> DataFrame:
    """rows(doc_id, source, page_number, layer, output variant, candidate_reasons, fallback_from, fallback_reason, second_tried) to one row per table.

    An output is a text, an object, a list of such, or an object with a list under `tables`. An object of another
    content_type without any table field is none. Its Markdown is taken as it is, else made from its HTML, else its text with
    single blanks stands for it. Tables without content, converted as placeholders, or whose text says that no cell could be read, are dropped;
    table_index counts those that stay, provenance_id those that came. Null outputs, numbers and booleans give no row,
    null names count as empty. A page's tables stay together in its row, so nothing is shuffled.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    found = F.filter(F.transform(table_items(F.col("output"), depth), _parts), lambda p: p["is_table"])
    got = rows.withColumn("__found", found).where(F.size("__found") > 0)
    # only tables without Markdown of their own have their HTML laid out
    got = got.withColumn("__made", _markdowns(F.transform("__found", lambda p: F.when((p["markdown"] == "") & (p["html"] != ""), p["html"]))))
    squeeze = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))

    def whole(p: Column, made: Column) -> Column:
        markdown = F.when(p["markdown"] != "", p["markdown"]).when(p["html"] != "", F.coalesce(made, squeeze(p["plain"]))).otherwise("")
        return F.struct(_first(markdown, p["plain"]).alias("content"), markdown.alias("markdown"), p["html"].alias("html"), p["conversion"].alias("conversion"), p["upstream"].alias("upstream"))

    numbered = F.transform(F.zip_with("__found", "__made", whole), lambda t, i: F.struct((i + 1).alias("raw"), t.alias("t")))
    kept = got.withColumn("__kept", F.filter(numbered, lambda x: ~is_placeholder(x["t"]["content"], x["t"]["conversion"])))
    kept = kept.select("*", F.posexplode("__kept").alias("__k", "__x")).withColumn("table_index", F.col("__k") + 1)
    place, t = F.concat(F.lit("doc_"), text("doc_id"), F.lit(":page_"), text("page_number")), F.col("__x.t")
    head = F.concat(F.lit("[Table | source="), text("source"), F.lit(" | page="), text("page_number"), F.lit("]\n\n"))
    return kept.select(
        "doc_id", "source", "page_number", F.col("layer").alias("parser_layer"), "table_index",
        F.concat(place, F.lit(":table_"), text("table_index")).alias("table_id"), F.concat(place, F.lit(":"), F.lower(text("layer")), F.lit(":table_"), F.col("__x.raw").cast("string")).alias("provenance_id"), t["upstream"].alias("upstream_provenance_id"),
        F.when(F.col("layer") == "L2", "L1->L2").when(F.coalesce("second_tried", F.lit(False)), "L1->L2->L3").otherwise("L1->L3").alias("route_path"),
        text("fallback_from").alias("fallback_from"), text("fallback_reason").alias("fallback_reason"), F.coalesce("candidate_reasons", F.array().cast("array<string>")).alias("candidate_reasons"),
        F.when(t["content"].startswith("[Table |"), t["content"]).otherwise(F.concat(head, t["content"])).alias("content"), t["markdown"].alias("table_markdown"), t["html"].alias("table_html"),
    )
