"""Query registry: each entry pairs a Spark job with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a job under ``name``; ``sql`` is its independent twin where SQL can say it."""

    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def r6(c: Column | str, name: str | None = None) -> Column:
    """Six decimals at the query edge. The nudge moves exact ties off the rounding point, where
    engines differ."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.round(c.cast("double") + 1e-9, 6)
    return out.alias(name) if name else out


def R(expr: str, name: str | None = None) -> str:
    """SQL form of :func:`r6`."""
    text = f"(round(CAST({expr} AS DOUBLE) + 1e-9, 6) + 0.0)"
    return f"{text} AS {name}" if name else text


def rounded(df: DataFrame) -> DataFrame:
    """Round every double column of a result."""
    return df.select(*[r6(c, c) if t == "double" else F.col(c) for c, t in df.dtypes])
