"""Every operator as a query over the given tables, with its SQL twin where it has one."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import configure
from . import sample

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_SHARED = {"catalogue": sample.CATALOGUE_SQL, "parts": sample.PART_DAYS_SQL, "checks": sample.CHECKS_SQL}


def complete_sql(text: str) -> str:
    """Put the shared tables the text speaks of in front of it."""
    used = [body for name, body in _SHARED.items() if f" {name}" in text]
    text = text.strip()
    if not used:
        return text
    head = "with recursive " if text.lower().startswith("with recursive ") else "with "
    if text.lower().startswith(head):
        return head + ",\n".join(used) + ",\n" + text[len(head):]
    return head + ",\n".join(used) + "\n" + text


def query(name: str, sql: str | None = None):
    def add(plan: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return plan(configure(spark), folder)

        if name in QUERIES:
            raise ValueError(f"query {name} is there twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = complete_sql(sql)
        return run
    return add


def load() -> None:
    from . import q_changes, q_classes, q_extract, q_filters, q_ledger, q_runs, q_scalars, q_shape, q_sources, q_streams  # noqa: F401
