"""Feature columns of panels. Row-based lags equal time lags on gap-filled panels only."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import DS, ID, floor_to, series_window


def add_lags(df: DataFrame, cols: Sequence[str], lags: Sequence[int]) -> DataFrame:
    """``{c}_lag{k}`` for every column and lag, all from one window."""
    w = series_window()
    return df.select("*", *[F.lag(c, k).over(w).alias(f"{c}_lag{k}") for c in cols for k in lags])


def rolling_mean_rows(df: DataFrame, cols: Sequence[str], days: Sequence[int] = (), hours: Sequence[int] = ()) -> DataFrame:
    """Means of the last 24*d or h rows, from the first row on: ``{c}_{d}days_avg`` and ``{c}_{h}hours_avg``."""
    w = series_window()
    mean = lambda c, n: F.avg(c).over(w.rowsBetween(-(n - 1), 0))
    return df.select("*", *[mean(c, 24 * d).alias(f"{c}_{d}days_avg") for c in cols for d in days], *[mean(c, h).alias(f"{c}_{h}hours_avg") for c in cols for h in hours])


def span_name(hours: int) -> str:
    d, h = divmod(hours, 24)
    return f"avg{d}d{h}h" if d and h else f"avg{d}d" if d else f"avg{h}h"


def seconds(ds: str | Column = DS) -> Column:
    """Seconds of a timestamp without zone, as a whole number."""
    return F.unix_timestamp(F.col(ds) if isinstance(ds, str) else ds)


def rolling_mean_time(df: DataFrame, cols: Sequence[str], hours: Sequence[int]) -> DataFrame:
    """Means over the time window (t - h, t], gaps or not."""
    w = Window.partitionBy(ID).orderBy(seconds())
    return df.select("*", *[F.avg(c).over(w.rangeBetween(-(h * 3600 - 1), 0)).alias(f"{c}_{span_name(h)}") for c in cols for h in hours])


def lag_of_rolling(df: DataFrame, cols: Sequence[str], day: int, hour: int, max_lag: int) -> DataFrame:
    """Lags of rolling means: daily means by 24*i rows, hourly means by i rows, i = 1..max_lag."""
    rolled = rolling_mean_rows(df, cols, [day], [hour])
    w, i = series_window(), range(1, max_lag + 1)
    return rolled.select(
        "*",
        *[F.lag(f"{c}_{day}days_avg", 24 * k).over(w).alias(f"{c}_{day}days_avg_lag{k}") for c in cols for k in i],
        *[F.lag(f"{c}_{hour}hours_avg", k).over(w).alias(f"{c}_{hour}hours_avg_lag{k}") for c in cols for k in i],
    )


def seasonal_diff(df: DataFrame, col: str = "y", season: int = 24) -> DataFrame:
    """``{col}_diff``: the value less the one a season before."""
    return df.withColumn(f"{col}_diff", F.col(col) - F.lag(col, season).over(series_window()))


def undiff24(deltas: DataFrame, anchors: DataFrame, season: int = 24) -> DataFrame:
    """Levels from seasonal differences over a horizon.

    ``deltas``: unique_id, cutoff, h (from 1), delta; ``anchors``: unique_id, cutoff, phase (0..season-1), level
    of the last observed season. Within a phase levels are the anchor plus the running sum of differences.
    """
    phased = deltas.withColumn("phase", (F.col("h") - 1) % season)
    w = Window.partitionBy(ID, "cutoff", "phase").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    return phased.join(anchors, [ID, "cutoff", "phase"]).withColumn("level", F.col("level") + F.sum("delta").over(w)).drop("phase", "delta")


def cyclic(x: Column, period: float, name: str) -> list[Column]:
    angle = x * (2 * math.pi / period)
    return [F.sin(angle).alias(f"{name}_sin"), F.cos(angle).alias(f"{name}_cos")]


def calendar_features(df: DataFrame) -> DataFrame:
    """Cyclic hour, weekday (Monday 0), month, and weekday / Saturday / Sunday class."""
    dow = F.weekday(DS)
    wss = F.when(dow == 5, 1).when(dow == 6, 2).otherwise(0)
    return df.select("*", *cyclic(F.hour(DS), 24, "hour"), *cyclic(dow, 7, "dow"), *cyclic(F.month(DS) - 1, 12, "month"), *cyclic(wss, 3, "wss"))


def fourier_terms(df: DataFrame, k_week: int, k_day: int) -> DataFrame:
    """Harmonics of 168 and 24 steps on each series' time index (1, 2, ...)."""
    t = F.row_number().over(series_window())
    indexed = df.withColumn("t", t)
    terms = [f(F.col("t") * (2 * math.pi * k / p)).alias(f"{n}{k}_{p}") for p, most in ((168, k_week), (24, k_day)) for k in range(1, most + 1) for n, f in (("sin", F.sin), ("cos", F.cos))]
    return indexed.select(*df.columns, *terms)


def cold_flag(df: DataFrame, temperature: str = "temperature", hours: int = 96, threshold: float | None = 13.5) -> DataFrame:
    """``is_cold``: mean temperature of the last ``hours`` at or under the threshold, or the months Nov-Mar without one."""
    if threshold is None:
        return df.withColumn("is_cold", F.month(DS).isin(11, 12, 1, 2, 3))
    w = Window.partitionBy(ID).orderBy(seconds()).rangeBetween(-(hours * 3600 - 1), 0)
    return df.withColumn("is_cold", F.avg(temperature).over(w) <= threshold)


def regime_split(df: DataFrame, cols: Sequence[str], flag: str = "is_cold", names: tuple[str, str] = ("cold", "warm"), drop_warm: bool = False, keep_warm: Sequence[str] = ()) -> DataFrame:
    """Each column as two: its value inside the regime else 0, and outside."""
    on, off = names
    inside = [F.when(F.col(flag), F.col(c)).otherwise(F.lit(0.0)).alias(f"{c}_{on}") for c in cols]
    outside = [F.when(~F.col(flag), F.col(c)).otherwise(F.lit(0.0)).alias(f"{c}_{off}") for c in cols if not drop_warm or c in keep_warm]
    return df.select(*[c for c in df.columns if c not in cols], *inside, *outside)


def peak_split(df: DataFrame, cols: Sequence[str], peak_hours: Mapping[str, Sequence[int]]) -> DataFrame:
    """``is_peak`` (a peak hour of the series, Monday to Friday) and ``{c}_peak`` / ``{c}_offpeak``."""
    spark = df.sparkSession
    rows = [(i, h) for i, hs in peak_hours.items() for h in sorted(set(hs))]
    table = spark.createDataFrame(rows, f"{ID} string, peak_hour int")
    joined = df.withColumn("peak_hour", F.hour(DS)).join(table.withColumn("listed", F.lit(True)), [ID, "peak_hour"], "left").drop("peak_hour")
    flagged = joined.withColumn("is_peak", F.coalesce("listed", F.lit(False)) & (F.weekday(DS) < 5)).drop("listed")
    return regime_split(flagged, cols, "is_peak", ("peak", "offpeak"))


def piecewise_sigmoid(x: Column, lower: float, upper: float, mid: float, slope: float) -> Column:
    """Two logistic halves that meet at ``mid`` with the value ``mid`` and equal slopes, between two asymptotes."""
    below, above = mid - lower, upper - mid
    left = lower + 2 * below / (1 + F.exp(-slope * (x - mid)))
    right = mid - above + 2 * above / (1 + F.exp(-(slope * below / above) * (x - mid)))
    return F.when(x <= mid, left).otherwise(right)


def trim_and_drop_nulls(df: DataFrame, head: int) -> DataFrame:
    """Drop the first ``head`` rows of each series, then rows with a null or NaN."""
    numeric = [c for c, t in df.dtypes if t in ("double", "float")]
    cut = df.withColumn("__rn", F.row_number().over(series_window())).where(F.col("__rn") > head).drop("__rn")
    for c in numeric:
        cut = cut.where(~F.isnan(c))
    return cut.dropna()


def full_cold_weeks(df: DataFrame, flag: str = "is_cold", least: int = 3, origin: str = "2000-01-03") -> DataFrame:
    """Hours of runs of ``least`` or more whole cold weeks, laid end to end on an hourly grid.

    A week (Monday 0 h to Sunday 23 h) counts with all 168 hours present and cold. ``grid_ds`` numbers the
    kept hours from the first Monday of 2000 on, so that weekdays stay.
    """
    weeks = df.withColumn("week", floor_to(DS, "week")).groupBy(ID, "week").agg(F.count_distinct(F.when(F.col(flag), F.col(DS))).alias("n"), F.count("*").alias("rows"))
    whole = weeks.where("n = 168 AND rows = 168")
    number = F.floor(F.datediff("week", F.lit("1970-01-05").cast("date")) / 7)
    island = whole.withColumn("island", number - F.row_number().over(Window.partitionBy(ID).orderBy("week")))
    long = island.withColumn("run", F.count("*").over(Window.partitionBy(ID, "island"))).where(F.col("run") >= least)
    kept = df.withColumn("week", floor_to(DS, "week")).join(long.select(ID, "week"), [ID, "week"], "left_semi").drop("week")
    at = F.row_number().over(series_window()) - 1
    return kept.withColumn("grid_ds", F.lit(origin).cast("timestamp_ntz") + F.make_interval(hours=at))
