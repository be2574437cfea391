"""Tenant scope and read-only ad-hoc SQL over scoped views; no SQL is parsed here."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tables user SQL may read, and functions it may not call.
BUSINESS_TABLES = ("sales_records", "ad_performance", "inventory_snapshots", "competitor_prices")
DENIED_FUNCTIONS = ("java_method", "reflect", "try_reflect", "input_file_name", "current_user", "session_user", "current_catalog", "current_database", "raise_error", "sleep")


class Refused(ValueError):
    """The statement may not run."""


def shop_scope(rows: DataFrame, shop_id: str) -> DataFrame:
    """Rows of one shop; the filter reaches the scan."""
    if "shop_id" not in rows.columns:
        raise Refused("table has no shop_id")
    return rows.where(F.col("shop_id") == F.lit(shop_id))


def check_statement(sql: str) -> None:
    text = sql.strip()
    if not text or ";" in text or "--" in text or "/*" in text:
        raise Refused("one statement without comments, please")
    called = re.search(r"\b(" + "|".join(DENIED_FUNCTIONS) + r")\s*\(", text, re.IGNORECASE)
    if called:
        raise Refused(f"{called[1]} is not allowed")
    if "`" in text and re.search(r"`[^`]*/[^`]*`", text):
        raise Refused("files can't be read directly")


def read_only_sql(spark: SparkSession, tables: dict[str, DataFrame], shop_id: str, sql: str, max_rows: int = 1000) -> DataFrame:
    """Run a query on the shop's rows: scope at the source, then at most max_rows rows.

    The statement is placed in a subquery, where Spark parses no DDL, DML or SET; table names in it resolve
    to common table expressions that hold only the shop's rows. Any other relation is refused, and so are sums, averages and
    ranks of money that cross markets or currencies.
    """
    from .money import check_money

    if not isinstance(max_rows, int) or isinstance(max_rows, bool) or max_rows < 1:
        raise Refused("max_rows must be a positive integer")
    check_statement(sql)
    if "{" in sql or "}" in sql:
        raise Refused("braces are not allowed")
    check_relations(spark, list(tables), sql)
    scoped = {name: shop_scope(rows, shop_id) for name, rows in tables.items()}
    return check_money(spark.sql(_placed(sql, {name: f"{{{name}}}" for name in scoped}), **scoped)).limit(max_rows)


def _placed(sql: str, sources: dict[str, str]) -> str:
    """The statement behind one WITH clause per table, as a subquery."""
    heads = ", ".join(f"{name} AS (SELECT * FROM {source})" for name, source in sources.items())
    return f"SELECT * FROM (\nWITH {heads} SELECT * FROM (\n{sql}\n) AS u\n) AS q"


def check_relations(spark: SparkSession, names: list[str], sql: str) -> None:
    """Refuse a statement that reads anything but the named tables and its own WITH clauses, or none of the tables.

    Spark's parser tells which relations the statement names, subqueries included; a WITH name counts only where it is in scope.
    """
    bound = "bound_" + "_".join(names)
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(_placed(sql, {n: f"{bound}.{n}" for n in names}))
    except Exception as e:
        raise Refused("the statement can't be parsed") from e
    read: set[str] = set()

    def items(seq):
        return [seq.apply(i) for i in range(seq.size())]

    def visit(node, known: frozenset[str]) -> None:
        kind = node.nodeName()
        if kind == "UnresolvedRelation":
            parts = [p.lower() for p in items(node.multipartIdentifier())]
            if parts[0] != bound.lower() and (len(parts) > 1 or parts[0] not in known):
                raise Refused(f"{'.'.join(parts)} may not be read")
            read.update(parts if len(parts) == 1 else ())
        elif kind == "UnresolvedWith":
            for pair in items(node.cteRelations()):
                visit(pair._2(), known)
                known = known | {pair._1().lower()}
        elif node.children().isEmpty() and kind not in ("OneRowRelation", "UnresolvedInlineTable", "LocalRelation"):
            raise Refused(f"{kind} may not be read")
        if kind != "UnresolvedWith":
            for inner in items(node.innerChildren()):
                visit(inner, known)
        for child in items(node.children()):
            visit(child, known)

    visit(plan, frozenset())
    if not read & {n.lower() for n in names}:
        raise Refused("no business table is read")


def row_cap(rows: DataFrame, requested: int | None, max_rows: int = 1000) -> DataFrame:
    return rows.limit(min(requested, max_rows) if requested is not None else max_rows)


def preview(rows: DataFrame, shop_id: str, n: int, order: list[str]) -> DataFrame:
    """First n rows of a shop's table, 1 to 100, in a stated order."""
    if not 1 <= n <= 100:
        raise Refused("1 to 100 rows")
    return shop_scope(rows, shop_id).orderBy(*order).limit(n)
