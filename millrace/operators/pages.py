"""Page features, page classes, neighbours of title pages and the page cap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import text

from .metrics import rounded

LOW_TEXT, RATIO, LINES, CAP = 20, 0.18, 15, 80
#: Words that name the period a page is of.
PERIODS = ("生效日期", "更新日期", "截至", "Date", "Effective")
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"


def page_features(pages: DataFrame, titles: tuple[str, ...], metrics: tuple[str, ...], units: tuple[str, ...], periods: tuple[str, ...] = PERIODS) -> DataFrame:
    """pages(doc, page_number, text) with counts, the share of digits, and the words found."""
    c = text.compact(F.col("text"))
    chars = F.length(c)
    digits = F.length(F.regexp_replace(c, "[^0-9]", ""))
    return pages.select(
        *pages.columns, chars.alias("text_chars"), F.length(F.regexp_replace(c, r"[^㐀-䶿一-鿿]", "")).alias("chinese_chars"), digits.alias("digit_chars"),
        rounded(digits / F.greatest(chars, F.lit(1)), 6).alias("numeric_ratio"), F.size(F.filter(F.split(F.coalesce("text", F.lit("")), LINE_END), lambda x: x.rlike("\\S"))).alias("line_count"),
        text.term_hits(F.col("text"), titles).alias("title_hits"), text.term_hits(F.col("text"), metrics).alias("metric_hits"), text.term_hits(F.col("text"), units).alias("unit_hits"), text.term_hits(F.col("text"), periods).alias("period_hits"), (chars == 0).alias("empty_text"),
        F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])"), F.lit(0)))).alias("year_hits"), (chars < LOW_TEXT).alias("low_text"),
    )


def page_classify(features: DataFrame) -> DataFrame:
    title = F.size("title_hits") > 0
    numeric = (F.col("numeric_ratio") >= RATIO) & (F.col("line_count") >= LINES) & (F.size("metric_hits") > 0) & (F.size("unit_hits") > 0)
    return features.withColumn("reasons", F.array_compact(F.array(F.when(title, "ecommerce_table_title"), F.when(numeric, "numeric_ecommerce_page"), F.when(F.col("low_text"), "low_text"))))


def title_neighbors(classified: DataFrame, before: int = 1, after: int = 3) -> DataFrame:
    """Pages from `before` ahead of a title page to `after` behind it, of the pages there are."""
    w = Window.partitionBy("doc").orderBy("page_number").rangeBetween(-after, before)
    return classified.withColumn("near_title", F.max((F.size("title_hits") > 0).cast("int")).over(w) == 1)


def page_cap(rows: DataFrame, cap: int = CAP) -> DataFrame:
    """Of each document the first `cap` selected pages: title pages, then by share of digits, then in page order; the rest are dropped by the cap."""
    chosen = rows.where(F.col("near_title") | (F.size("reasons") > 0))
    w = Window.partitionBy("doc").orderBy((F.size("title_hits") == 0).cast("int"), F.desc("numeric_ratio"), "page_number")
    return chosen.withColumn("position", F.row_number().over(w)).withColumn("dropped_by_cap", F.col("position") > cap)


def page_inventory(pages: DataFrame) -> DataFrame:
    empty = F.length(text.compact(F.col("text"))) == 0
    agg = (F.count(F.lit(1)).alias("pages"), F.count(F.when(empty, 1)).alias("empty_pages"))
    return pages.groupBy("doc").agg(*agg).unionByName(pages.agg(*agg).withColumn("doc", F.lit("total")))
