"""All registered queries of the library, by key, and their SQL."""

from __future__ import annotations

from importlib import import_module

_PLANS = ("business", "retrieval", "operations", "streams", "verification", "reports", "support", "files", "questions", "scoring", "writers")


def _all(name: str) -> dict:
    out: dict = {}
    for plan in _PLANS:
        out |= getattr(import_module(f"millrace.plans.{plan}"), name)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")
