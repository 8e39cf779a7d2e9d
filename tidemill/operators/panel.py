"""Cleaning of long panels: one row per (unique_id, ds); every window is partitioned by series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ID, DS = "unique_id", "ds"


def series_window() -> Window:
    return Window.partitionBy(ID).orderBy(DS)


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def floor_to(ds: str | Column, unit: str) -> Column:
    """``date_trunc`` that keeps timestamps without time zone."""
    return F.date_trunc(unit, ds).cast("timestamp_ntz")


def fill_gaps(df: DataFrame, unit: str = "hour") -> DataFrame:
    """Insert the missing timestamps of each series between its first and last; values there are null.

    A row whose timestamp is null or off the grid that begins at the first one raises: none is dropped.
    """
    require_columns(df, ID, DS)
    step = F.expr(f"interval 1 {unit}")
    grid = df.groupBy(ID).agg(F.min(DS).alias("lo"), F.max(DS).alias("hi")).select(ID, F.explode(F.sequence("lo", "hi", step)).alias(DS))
    both = grid.withColumn("__grid", F.lit(True)).join(df, [ID, DS], "full")
    off = F.raise_error(F.concat_ws(" ", F.lit("off the grid:"), F.col(ID), F.col(DS).cast("string")))
    return both.withColumn(DS, F.when(F.col("__grid").isNull(), off).otherwise(F.col(DS))).drop("__grid")


def clip_lower(df: DataFrame, col: str, floor: float = 5.0) -> DataFrame:
    """Values under ``floor`` become ``floor``; null stays null."""
    return df.withColumn(col, F.when(F.col(col) < floor, F.lit(floor)).otherwise(F.col(col)))


def low_counts(df: DataFrame, col: str, floor: float = 5.0) -> DataFrame:
    """How many values lie under ``floor``, by series and in total (``unique_id`` null)."""
    return df.groupBy(ID).agg(F.count_if(F.col(col) < floor).alias("n_low"), F.count(col).alias("n")).rollup(ID).agg(F.sum("n_low").alias("n_low"), F.sum("n").alias("n"))


def forward_fill(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The last value that is not null, within a series; leading nulls stay."""
    w = series_window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def mask_points(df: DataFrame, points: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Set ``cols`` to null at the listed (unique_id, ds)."""
    marked = points.select(ID, DS).distinct().withColumn("masked", F.lit(True))
    joined = df.join(marked, [ID, DS], "left")
    return joined.withColumns({c: F.when(F.col("masked").isNull(), F.col(c)) for c in cols}).drop("masked")


def resample_daily(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Calendar-day means; on a gap-filled panel empty days appear with null."""
    return df.groupBy(ID, floor_to(DS, "day").alias(DS)).agg(*[F.avg(c).alias(c) for c in cols])


WINTER_MONTHS, SUMMER_MONTHS = (11, 12, 1, 2, 3, 4), (5, 6, 7, 8, 9, 10)


def summarize_panel(df: DataFrame, col: str = "y", months: Sequence[int] | None = None) -> DataFrame:
    """Count, moments, quantiles, missing and zero counts, first and last timestamp of each series."""
    if months is not None:
        df = df.where(F.month(DS).isin(*months))
    quantiles = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    return df.groupBy(ID).agg(
        F.count(col).alias("n"),
        F.avg(col).alias("mean"),
        F.stddev_samp(col).alias("std"),
        F.min(col).alias("min"),
        *[F.percentile(col, F.lit(q)).alias(name) for name, q in quantiles.items()],
        F.max(col).alias("max"),
        F.count_if(F.col(col).isNull()).alias("missing"),
        F.count_if(F.col(col) == 0).alias("zeros"),
        F.min(DS).alias("start"),
        F.max(DS).alias("end"),
    )


def timestamp(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def hours(n: int | Column) -> Column:
    return F.make_interval(hours=n if isinstance(n, Column) else F.lit(n))


def time_slice(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows from ``start`` to ``end``, both included."""
    return df.where(F.col(DS).between(timestamp(start), timestamp(end)))


def train_test_split(df: DataFrame, start: str, end_train: str, end_test: str, max_lag: int = 0) -> DataFrame:
    """Adds ``split``; rows that a lag of the test part reaches back to appear in both parts."""
    if not start < end_train < end_test:
        raise ValueError("dates must be in order: start, end_train, end_test")
    train = F.col(DS).between(timestamp(start) - hours(max_lag), timestamp(end_train))
    test = F.col(DS).between(timestamp(end_train) - hours(max_lag) + hours(1), timestamp(end_test))
    parts = F.array_compact(F.array(F.when(train, F.lit("train")), F.when(test, F.lit("test"))))
    return df.withColumn("split", F.explode(parts))


def is_winter(ds: str | Column = DS) -> Column:
    """December to March, and November from the 15th."""
    return F.month(ds).isin(12, 1, 2, 3) | ((F.month(ds) == 11) & (F.dayofmonth(ds) >= 15))


def season_of(ds: str | Column = DS) -> Column:
    """Season by fixed dates: Spring from 21 March, Summer from 21 May, Autumn from 21 September, Winter from 21 December."""
    day = F.month(ds) * 100 + F.dayofmonth(ds)
    return F.when(day.between(321, 520), "Spring").when(day.between(521, 920), "Summer").when(day.between(921, 1220), "Autumn").otherwise("Winter")


def common_timestamps(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` whose timestamp occurs anywhere in ``right``."""
    return left.join(right.select(DS).distinct(), DS, "left_semi").select(*left.columns)


def last_full_day_end(df: DataFrame) -> DataFrame:
    """First and last whole day of each hourly series: ``first_start`` at 0 h, ``last_end`` at 23 h."""
    day = F.expr("interval 1 day")
    lo, hi = F.min(DS), F.max(DS)
    floor = floor_to(lo, "day")
    return df.groupBy(ID).agg(F.when(floor == lo, floor).otherwise(floor + day).alias("first_start"), (floor_to(hi - hours(23), "day") + hours(23)).alias("last_end"))


def tail_per_series(df: DataFrame, n: int) -> DataFrame:
    """The last ``n`` rows of each series."""
    w = Window.partitionBy(ID).orderBy(F.desc(DS))
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")
