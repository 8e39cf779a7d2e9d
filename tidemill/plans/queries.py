"""Registered panel queries and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import analysis, backtesting, forecasting, preparation  # noqa: F401  modules register their queries when imported
from .registry import ORACLES, QUERIES, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which naive model forecasts each series better, and how often? Backtest, scores and win rates."""
    return QUERIES["cv_summary"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
