"""Where queries and their SQL are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusq.shared import ship

from .fixtures import SQL_VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(sql: str) -> str:
    """The statement with the views it names, and those that these name, before it."""
    order: list[str] = []

    def need(text: str) -> None:
        for name, body in SQL_VIEWS.items():
            if name in text and name not in order:
                need(body)
                if name not in order:
                    order.append(name)

    need(sql)
    views = ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in order)
    if not views:
        return sql
    if sql.lstrip().upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {views}, {sql.lstrip()[len('WITH RECURSIVE'):]}"
    if sql.lstrip().upper().startswith("WITH"):
        return f"WITH {views}, {sql.lstrip()[len('WITH'):]}"
    return f"WITH {views}\n{sql}"


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with SQL for DuckDB."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return add
