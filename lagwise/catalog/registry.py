"""Named queries over the driver tables, each with the SQL that must return the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with its SQL when there is one."""

    def add(fn: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r6(column: str | Column, name: str | None = None) -> Column:
    """Six decimals, so that the order of additions does not show."""
    value = F.col(column) if isinstance(column, str) else column
    rounded = F.round(value.cast("double"), 6)
    return rounded.alias(name or column) if name or isinstance(column, str) else rounded


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Round the named columns, or every double column when none is named."""
    chosen = set(columns) or {n for n, t in df.dtypes if t == "double"}
    return df.select(*[r6(c) if c in chosen else F.col(c) for c in df.columns])


def with_ctes(*ctes: str, body: str) -> str:
    """One statement from common table expressions and a body; a body that opens with a comma adds its own."""
    return "WITH " + ",\n".join(ctes) + "\n" + body.strip()
