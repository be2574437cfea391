"""HTML tables to cells: row and column spans laid out on a grid. A table beyond the grid's size becomes one cell with all its text."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import rounded

MAX_COLUMNS, MAX_ROWS = 200, 10_000


class _Grid(HTMLParser):
    """Collects the cells of each outermost table as (row, col, text, header, merged)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables, self.depth, self.cell = [], 0, None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables.append([])
        elif self.depth == 1 and tag == "tr":
            self._close()
            self.tables[-1].append([])
        elif self.depth == 1 and tag in ("td", "th"):
            self._close()
            if not self.tables[-1]:
                self.tables[-1].append([])
            size = dict(attrs)
            self.cell = [[], tag == "th", self._span(size.get("rowspan")), self._span(size.get("colspan"))]
        elif tag == "br" and self.cell:
            self.cell[0].append(" ")

    @staticmethod
    def _span(x):
        return int(x) if x and x.isdigit() and 0 < int(x) <= MAX_COLUMNS else 1

    def _close(self):
        if self.cell:
            text = " ".join("".join(self.cell[0]).split()).replace("|", "\\|")
            self.tables[-1][-1].append((text, *self.cell[1:]))
            self.cell = None

    def handle_endtag(self, tag):
        if self.depth == 1 and tag in ("td", "th", "tr", "table"):
            self._close()
        if tag == "table" and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if self.cell:
            self.cell[0].append(data)

    def cells(self):
        for t, rows in enumerate(self.tables):
            yield from ((t, *c) for c in self._laid_out(rows))

    @staticmethod
    def _laid_out(rows):
        """Cells of one table as (row, col, text, header, merged), spans filled."""
        taken, out = set(), []
        for r, row in enumerate(rows):
            col = 0
            for text, header, down, across in row:
                while (r, col) in taken:
                    col += 1
                if r >= MAX_ROWS or col + across > MAX_COLUMNS:
                    return [(0, 0, " ".join(c[0] for x in rows for c in x if c[0]), False, False)]
                for i in range(min(down, len(rows) - r)):
                    for j in range(across):
                        if (r + i, col + j) not in taken:
                            taken.add((r + i, col + j))
                            out.append((r + i, col + j, text, header, i + j > 0))
                col += across
        return out


def first_markdown(html: str) -> str | None:
    """The first table of a text as Markdown, its first row the header, short rows filled; null where there is no table or it is beyond the grid."""
    grid = _Grid()
    grid.feed(html)
    grid.close()
    cells = next((c for c in map(grid._laid_out, grid.tables) if c), None)
    if cells is None or (len(cells) == 1 and sum(map(len, grid.tables[0])) > 1):
        return None
    width, rows = max(c[1] for c in cells) + 1, {}
    for r, col, text, *_ in cells:
        rows.setdefault(r, [""] * width)[col] = text
    lines = ["| " + " | ".join(rows.get(r, [""] * width)) + " |" for r in range(max(rows) + 1)]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def extract_tables(pages: DataFrame) -> DataFrame:
    """(page_id, table_index, row, col, text, is_header, is_merged): one row per grid cell of pages(page_id, html)."""

    def run(batches):
        for b in batches:
            rows = []
            for page, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if html and "<table" in html.lower():
                    g = _Grid()
                    g.feed(html)
                    g.close()
                    rows += [(page, *c) for c in g.cells()]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["page_id", "table_index", "row", "col", "text", "is_header", "is_merged"])

    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).mapInArrow(run, "page_id long, table_index int, row int, col int, text string, is_header boolean, is_merged boolean")


def table_quality(cells: DataFrame) -> DataFrame:
    """Score of each table from its columns, rows, filled cells and merged cells, and a grade."""
    rows, cols = F.max("row") + 1, F.max("col") + 1
    t = cells.groupBy("page_id", "table_index").agg(rows.alias("n_rows"), cols.alias("n_cols"), (F.count(F.when(F.col("text") != "", 1)) / F.count(F.lit(1))).alias("fill"), F.max("is_merged").alias("merged"))
    score = F.lit(0.35) + F.when(F.col("n_cols") >= 2, 0.25).otherwise(0.10) + F.when(F.col("n_rows") >= 2, 0.25).otherwise(0.0) + F.col("fill") * 0.15 - F.when(F.col("merged"), 0.05).otherwise(0.0)
    t = t.withColumn("score", rounded(score, 4))
    return t.withColumn("grade", F.when(F.col("fill") == 0, "empty").when(F.col("score") >= 0.8, "good").when(F.col("score") >= 0.6, "usable").otherwise("degraded"))


def markdown(cells: DataFrame) -> DataFrame:
    """One markdown text per table: the first row is the header."""
    line = cells.groupBy("page_id", "table_index", "row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", "text"))), lambda x: x["text"]), " | ").alias("line"), F.count(F.lit(1)).alias("n"))
    line = line.withColumn("line", F.concat(F.lit("| "), "line", F.lit(" |")))
    rule = F.when(F.col("row") == 0, F.concat(F.col("line"), F.lit("\n|"), F.expr("repeat(' --- |', cast(n as int))"))).otherwise(F.col("line"))
    return line.groupBy("page_id", "table_index").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", rule.alias("line")))), lambda x: x["line"]), "\n").alias("markdown"))
