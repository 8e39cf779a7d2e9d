"""Registry of queries: a name, a Spark function of (spark, sf_dir), and SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.sources.fixtures import with_panels

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *panels: str) -> Callable[[Query], Query]:
    """Register a function under its own name; ``panels`` are the derived tables that ``sql`` reads."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_panels(sql, *panels) if panels else sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6, **by: int) -> DataFrame:
    """Round all double columns, as the oracles do: sums differ in the last bits between engines."""
    return df.select(*[(F.round(c, by.get(c, digits)) if t == "double" else F.col(c)).alias(c) for c, t in df.dtypes])


def r(x: Column | str, digits: int = 6) -> Column:
    return F.round(x, digits)
