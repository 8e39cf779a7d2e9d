"""Seasonal decompositions of panels: classical, none, STL and MSTL, and what is done with their parts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .panel import DS, ID, floor_to, series_window


def decompose_classical(df: DataFrame, period: int = 365, col: str = "y") -> DataFrame:
    """Additive: centred moving-average trend with edges continued by a line, centred phase means, remainder.

    An even period takes half weights at both ends. Edges follow the least-squares line of the first and last
    ``period`` trend values. Series shorter than two periods have no rows.
    """
    w = series_window()
    whole = Window.partitionBy(ID)
    rows = df.select(ID, DS, F.col(col).alias("y"), F.row_number().over(w).alias("i"), F.count("*").over(whole).alias("n")).where(F.col("n") >= 2 * period)
    half = period // 2
    if period % 2:
        mean = F.avg("y").over(w.rowsBetween(-half, half))
    else:
        mean = (F.sum("y").over(w.rowsBetween(-half, half)) - (F.lag("y", half).over(w) + F.lead("y", half).over(w)) / 2) / period
    rows = rows.withColumn("t", F.when((F.col("i") > half) & (F.col("i") <= F.col("n") - half), mean))
    left, right = F.col("i") <= half + period, F.col("i") > F.col("n") - half - period
    fits = [f(F.when(side, F.col("t")), F.when(side, F.col("i"))).over(whole).alias(f"{name}_{k}") for name, side in (("l", left), ("r", right)) for k, f in (("b", F.regr_slope), ("a", F.regr_intercept))]
    rows = rows.select("*", *fits)
    line = lambda s: F.col(f"{s}_a") + F.col(f"{s}_b") * F.col("i")
    rows = rows.withColumn("trend", F.when(F.col("i") <= half, line("l")).when(F.col("i") > F.col("n") - half, line("r")).otherwise(F.col("t")))
    phase = F.pmod(F.col("i") - 1, F.lit(period))
    observed = F.avg(F.when(F.col("t").isNotNull(), F.col("y") - F.col("t")))
    rows = rows.withColumn("phase", phase)
    means = rows.groupBy(ID, "phase").agg(observed.alias("s"))
    centred = means.withColumn("seasonal", F.col("s") - F.avg("s").over(whole)).drop("s")
    out = rows.join(centred, [ID, "phase"])
    return out.select(ID, DS, "y", "trend", "seasonal", (F.col("y") - F.col("trend") - F.col("seasonal")).alias("remainder"))


def decompose_none(df: DataFrame, col: str = "y") -> DataFrame:
    """The data as trend, zeros elsewhere."""
    return df.select(ID, DS, F.col(col).alias("y"), F.col(col).alias("trend"), F.lit(0.0).alias("seasonal"), F.lit(0.0).alias("remainder"))


def _loess_weights(n: int, q: int, degree: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Neighbourhoods and smoothing weights of equally spaced points: a row of weights a point."""
    q = min(q, n)
    start = np.clip(np.arange(n) - q // 2, 0, n - q)
    at = start[:, None] + np.arange(q)
    d = at - np.arange(n)[:, None]
    far = np.maximum(np.abs(d).max(axis=1, keepdims=True), 1) * (1 + 1e-9)
    return at, np.clip(1 - (np.abs(d) / far) ** 3, 0, None) ** 3


def _loess(y: np.ndarray, q: int, robust: np.ndarray | None = None) -> np.ndarray:
    """Local lines at equally spaced points."""
    at, w = _loess_weights(len(y), q)
    if robust is not None:
        w = w * robust[at]
    d = (at - np.arange(len(y))[:, None]).astype(float)
    s0, s1, s2 = w.sum(1), (w * d).sum(1), (w * d * d).sum(1)
    b0, b1 = (w * y[at]).sum(1), (w * d * y[at]).sum(1)
    det = s0 * s2 - s1 * s1
    flat = np.abs(det) < 1e-12 * np.maximum(s0 * s0, 1)
    return np.where(flat, b0 / np.where(s0 > 0, s0, 1), (b0 * s2 - b1 * s1) / np.where(flat, 1, det))


def _moving(y: np.ndarray, k: int) -> np.ndarray:
    return np.convolve(y, np.ones(k) / k, "valid")


def stl(y: np.ndarray, period: int, seasonal: int, robust: bool = False, inner: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Trend and seasonal part of a series without gaps (Cleveland et al. 1990), two periods or longer."""
    n = len(y)
    trend_q = int(np.ceil(1.5 * period / (1 - 1.5 / seasonal)))
    trend_q += trend_q % 2 == 0
    low_q = period + (period % 2 == 0)
    trend, season, weight = np.zeros(n), np.zeros(n), None
    for _ in range(5 if robust else 1):
        for _ in range(inner):
            d = y - trend
            cycle = np.empty(n + 2 * period)
            for p in range(period):
                sub = d[p::period]
                w = None if weight is None else weight[p::period]
                fit = _loess(sub, seasonal, w)
                # a value before and one after, by the line through the two nearest
                ends = (2 * fit[0] - fit[1], 2 * fit[-1] - fit[-2]) if len(fit) > 1 else (fit[0], fit[0])
                cycle[p :: period][: len(fit) + 2] = np.concatenate([[ends[0]], fit, [ends[1]]])
            low = _loess(_moving(_moving(_moving(cycle, period), period), 3), low_q)
            season = cycle[period : period + n] - low[:n]
            trend = _loess(y - season, trend_q, weight)
        if robust:
            e = np.abs(y - trend - season)
            h = 6 * np.median(e)
            weight = np.clip(1 - (e / h) ** 2, 0, None) ** 2 if h > 1e-12 else None
    return trend, season


def mstl(y: np.ndarray, periods: Sequence[int], windows: Sequence[int], rounds: int = 2) -> tuple[np.ndarray, list[np.ndarray]]:
    """Trend and one seasonal part a period (shortest first); periods of which fewer than two fit are zero."""
    fits = [p for p in periods if len(y) >= 2 * p]
    parts = {p: np.zeros(len(y)) for p in periods}
    trend = np.full(len(y), y.mean() if len(y) else 0.0)
    for _ in range(rounds if len(fits) > 1 else 1):
        for p, w in zip(periods, windows, strict=True):
            if p in fits:
                rest = y - sum(parts[o] for o in fits if o != p)
                trend, parts[p] = stl(rest, p, w)
    return trend, [parts[p] for p in periods]


def decompose_stl(df: DataFrame, period: int = 365, seasonal: int = 11, robust: bool = False, col: str = "y") -> DataFrame:
    """STL of each series, one task a series; series under two periods or with nulls have no rows."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values(DS).reset_index(drop=True)
        y = rows["y"].to_numpy(float)
        if len(y) < 2 * period or not np.isfinite(y).all():
            return rows.iloc[:0].assign(trend=[], seasonal=[], remainder=[])
        t, s = stl(y, period, seasonal, robust)
        return rows.assign(trend=t, seasonal=s, remainder=y - t - s)

    return df.select(ID, DS, F.col(col).cast("double").alias("y")).groupBy(ID).applyInPandas(run, f"{ID} string, {DS} timestamp_ntz, y double, trend double, seasonal double, remainder double")


def decompose_mstl(df: DataFrame, periods: Sequence[int] = (24, 168), windows: Sequence[int] = (11, 15), train_horizon: int = 1848, col: str = "y", keys: Sequence[str] = (ID,)) -> DataFrame:
    """MSTL of the last ``train_horizon`` rows of each group: trend, ``seasonal_<p>`` and remainder."""
    names = [f"seasonal_{p}" for p in periods]
    types = dict(df.dtypes)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values(DS).tail(train_horizon).reset_index(drop=True)
        y = rows["y"].to_numpy(float)
        if not np.isfinite(y).all():
            return rows.iloc[:0].assign(trend=[], remainder=[], **{n: [] for n in names})
        t, parts = mstl(y, periods, windows)
        return rows.assign(trend=t, **dict(zip(names, parts, strict=True)), remainder=y - t - sum(parts))

    schema = ", ".join(f"{k} {types[k]}" for k in keys) + f", {DS} timestamp_ntz, y double, trend double, " + ", ".join(f"{n} double" for n in names) + ", remainder double"
    columns = [*keys, DS, "y", "trend", *names, "remainder"]
    return df.select(*keys, DS, F.col(col).cast("double").alias("y")).groupBy(*keys).applyInPandas(lambda f: run(f)[columns], schema)


def _local_lines(rows: DataFrame, window: int) -> DataFrame:
    """Adds ``__fit``: lines through ``window`` rows around each, weighted by distance (tricube) and by ``__r``."""
    # the frame reaches far enough at the edges, where the window is shifted inwards
    near = F.collect_list(F.struct(F.col("__i").alias("i"), F.col("seasonal").alias("v"), F.col("__r").alias("r"))).over(series_window().rowsBetween(-window, window))
    start = F.greatest(F.lit(1), F.least(F.col("__i") - window // 2, F.col("__n") - window + 1))
    inside = F.filter("__w", lambda x: (x["i"] >= start) & (x["i"] < start + window))
    far = F.greatest(F.col("__i") - start, F.least(start + window - 1, F.col("__n")) - F.col("__i"), F.lit(1)) * (1 + 1e-9)
    tri = lambda d: F.pow(1 - F.pow(F.abs(d) / far, F.lit(3.0)), F.lit(3.0))
    rows = rows.withColumn("__w", near)
    rows = rows.withColumn("__w", F.transform(inside, lambda x: F.struct((x["i"] - F.col("__i")).cast("double").alias("d"), x["v"].alias("v"), (tri(x["i"] - F.col("__i")) * x["r"]).alias("w"))))
    total = lambda f: F.aggregate("__w", F.lit(0.0), lambda a, x: a + f(x))
    sums = {"s0": lambda x: x["w"], "s1": lambda x: x["w"] * x["d"], "s2": lambda x: x["w"] * x["d"] * x["d"], "b0": lambda x: x["w"] * x["v"], "b1": lambda x: x["w"] * x["d"] * x["v"]}
    rows = rows.withColumns({f"__{k}": total(f) for k, f in sums.items()})
    det = F.col("__s0") * F.col("__s2") - F.col("__s1") * F.col("__s1")
    fit = F.coalesce(F.try_divide(F.col("__b0") * F.col("__s2") - F.col("__b1") * F.col("__s1"), F.when(F.abs(det) > 1e-12, det)), F.try_divide("__b0", "__s0"))
    return rows.withColumn("__fit", F.when(F.col("__s0") > 1e-12, fit).otherwise(F.col("seasonal"))).drop("__w", *[f"__{k}" for k in sums])


def smooth_seasonal_loess(parts: DataFrame, window: int, rounds: int = 3) -> DataFrame:
    """Smooth the seasonal part by tricube-weighted local lines over ``window`` rows; the remainder takes the rest.

    ``rounds`` more passes weigh rows down by the size of their residual (bisquare over six medians of the series); a row
    whose whole window has no weight keeps its value.
    """
    series = Window.partitionBy(ID)
    rows = parts.select("*", F.row_number().over(series_window()).alias("__i"), F.count("*").over(series).alias("__n"), F.lit(1.0).alias("__r"))
    for left in range(rounds, -1, -1):
        rows = _local_lines(rows, window)
        if left:
            rows = rows.withColumn("__e", F.abs(F.col("seasonal") - F.col("__fit")))
            rows = rows.withColumn("__m", F.percentile("__e", F.lit(0.5)).over(series))
            u = F.col("__e") / (6 * F.col("__m"))
            rows = rows.withColumn("__r", F.when(~(F.col("__m") > 1e-12), 1.0).when(u < 1, F.pow(1 - u * u, F.lit(2.0))).otherwise(0.0)).drop("__fit", "__e", "__m")
    smooth = rows.withColumn("seasonal", F.col("__fit"))
    return smooth.withColumn("remainder", F.col("y") - F.col("trend") - F.col("seasonal")).select(*parts.columns)


def remove_annual(df: DataFrame, season: DataFrame, col: str = "y") -> DataFrame:
    """Subtract the daily seasonal value of each row's day; days without one give null."""
    days = season.select(ID, F.col(DS).alias("__day"), F.col("seasonal").alias("__s"))
    return df.withColumn("__day", floor_to(DS, "day")).join(days, [ID, "__day"], "left").withColumn(col, F.col(col) - F.col("__s")).select(*df.columns)


def add_annual(df: DataFrame, season: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Add the seasonal value of the day a calendar year before (29 February: the 28th) to forecast columns."""
    days = season.select(ID, F.to_date(DS).alias("__day"), F.col("seasonal").alias("__s"))
    back = F.add_months(F.to_date(DS), -12)
    return df.withColumn("__day", back).join(days, [ID, "__day"], "left").withColumns({c: F.col(c) + F.col("__s") for c in cols}).select(*df.columns)


def repeat_seasonal_tail(parts: DataFrame, season: int, n: int, col: str = "seasonal") -> DataFrame:
    """Continue the last ``season`` values of each series for ``n`` steps: unique_id, step (from 1), value."""
    w = Window.partitionBy(ID).orderBy(F.desc(DS))
    tail = parts.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= season).select(ID, (season - F.col("__k")).alias("__p"), F.col(col).alias("value"))
    whole = tail.withColumn("__n", F.count("*").over(Window.partitionBy(ID)))
    checked = whole.withColumn("value", F.when(F.col("__n") < season, F.raise_error(F.lit("history is shorter than a season"))).otherwise(F.col("value")))
    steps = checked.select(ID).distinct().withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("__p", (F.col("step") - 1) % season)
    return steps.join(checked, [ID, "__p"]).select(ID, "step", "value")


def trend_plus_remainder(parts: DataFrame) -> DataFrame:
    """``y_trend_rem``: what is left when all seasonal parts are gone; null raises."""
    x = F.col("trend") + F.col("remainder")
    return parts.select(ID, DS, F.when(x.isNull(), F.raise_error(F.lit("null in trend or remainder"))).otherwise(x).alias("y_trend_rem"))


def context_trend(df: DataFrame, parts: DataFrame, ends: DataFrame, seasons: Mapping[str, int], length: int, unit_hours: int = 1, col: str = "y") -> DataFrame:
    """``y_trend_rem`` of the last ``length`` rows of contexts that end after training, without a new decomposition.

    ``parts`` is the decomposition of the training span, with a seasonal column for each of ``seasons`` (periods in
    rows); ``ends`` has unique_id and ``context_end``. Up to the end of training a row's own seasonal values are taken
    off, behind it those of the last period, repeated from there on. A context that ends before training does raises,
    and so does a null, a missing row, or a history shorter than a period. Returns unique_id, context_end, ds, y_trend_rem.
    """
    step = lambda n: F.make_dt_interval(F.lit(0), n * unit_hours)
    trained = parts.groupBy(ID).agg(F.max(DS).alias("__end"))
    asked = ends.select(ID, "context_end").distinct().join(trained, ID, "left")
    early = F.coalesce(F.col("context_end") < F.col("__end"), F.lit(True))
    asked = asked.withColumn("context_end", F.when(early, F.raise_error(F.concat(F.lit("a context ends before training does, or without training: "), ID)).cast("timestamp_ntz")).otherwise(F.col("context_end")))
    spread = asked.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))).withColumn(DS, F.col("context_end") - step(F.col("__k")))
    rows = spread.join(df.select(ID, DS, F.col(col).alias("__rest")), [ID, DS], "left")
    behind = (F.unix_timestamp(F.col(DS).cast("timestamp")) - F.unix_timestamp(F.col("__end").cast("timestamp"))) / (3600 * unit_hours)
    for name, period in seasons.items():
        back = F.when(behind <= 0, F.col(DS)).otherwise(F.col("__end") - step((period - 1 - F.pmod(behind.cast("int") - 1, F.lit(period))).cast("int")))
        values = parts.select(ID, F.col(DS).alias("__ref"), F.col(name).alias("__s"))
        rows = rows.withColumn("__ref", back).join(values, [ID, "__ref"], "left").withColumn("__rest", F.col("__rest") - F.col("__s")).drop("__ref", "__s")
    whole = F.when(F.col("__rest").isNull(), F.raise_error(F.concat(F.lit("a null or missing value in the context of "), ID)).cast("double")).otherwise(F.col("__rest"))
    return rows.select(ID, "context_end", DS, whole.alias("y_trend_rem"))
