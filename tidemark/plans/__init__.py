"""Registered queries and their SQL: one module a field, each with QUERIES (name -> function, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, domain, lab, progress

FLAGSHIP = "delivery_audit_by_topic"
MODULES = (audit, progress, domain, lab)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for module in MODULES for name, (fn, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
