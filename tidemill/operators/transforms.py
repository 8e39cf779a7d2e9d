"""Variance-stabilising transforms, Box-Cox parameters and scalers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .panel import DS, ID, series_window

TRANSFORMS = ("none", "log", "boxcox", "arcsinh", "arcsinh2", "arcsinh10")
EPS = 1e-6


def transformed(y: Column, kind: str, lam: Column | None = None) -> Column:
    """Values on the transformed scale; ``lam`` is the Box-Cox parameter."""
    if kind == "none":
        return y
    if kind == "log":
        return F.ln(y)
    if kind == "boxcox":
        return F.when(lam == 0, F.ln(y)).otherwise((F.pow(y, lam) - 1) / F.nullif(lam, F.lit(0.0)))
    scale = {"arcsinh": 1.0, "arcsinh2": 2.0, "arcsinh10": 10.0}[kind]
    return F.asinh(y / scale)


def inverted(z: Column, kind: str, lam: Column | None = None) -> Column:
    """Back to the original scale."""
    if kind == "none":
        return z
    if kind == "log":
        return F.exp(z)
    if kind == "boxcox":
        return F.when(lam == 0, F.exp(z)).otherwise(F.pow(lam * z + 1, 1 / F.nullif(lam, F.lit(0.0))))
    scale = {"arcsinh": 1.0, "arcsinh2": 2.0, "arcsinh10": 10.0}[kind]
    return F.sinh(z) * scale


def transform_target(df: DataFrame, kind: str, lambdas: DataFrame | None = None, col: str = "y", inverse: bool = False) -> DataFrame:
    """Apply a transform, or its inverse, to ``col``; ``lambdas`` (unique_id, lambda) is one row a series.

    A series without a lambda raises: none is dropped.
    """
    if kind not in TRANSFORMS:
        raise ValueError(f"unknown transform {kind}")
    f = inverted if inverse else transformed
    if kind != "boxcox":
        return df.withColumn(col, f(F.col(col), kind))
    joined = df.join(lambdas.select(ID, F.col("lambda").alias("__l")), ID, "left")
    lam = F.when(F.col("__l").isNull(), F.raise_error(F.concat(F.lit("no lambda for series "), ID))).otherwise(F.col("__l"))
    return joined.withColumn(col, f(F.col(col), kind, lam)).drop("__l")


def _grid(lo: Column, hi: Column, step: float) -> Column:
    """Grid points lo, lo + step, ..., hi from whole multiples of the step, so that no error builds up."""
    return F.transform(F.sequence(F.round(lo / step).cast("int"), F.round(hi / step).cast("int")), lambda k: k * step)


def _loglik(rows: DataFrame, col: str, grid: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """The grid point of greatest profile log-likelihood of each series; the least one among equals.

    A column of the aggregate for every grid point, which may depend on ``keys``: no row is repeated.
    """
    sums = [F.var_pop(transformed(F.col(col), "boxcox", lam)).alias(f"__v{i}") for i, lam in enumerate(grid)]
    g = rows.groupBy(ID, *keys).agg(F.count("*").alias("__n"), F.sum(F.ln(col)).alias("__s"), *sums)
    # the logarithm of no variance is null and counts as least
    ll = [-F.col("__n") / 2 * F.ln(f"__v{i}") + (lam - 1) * F.col("__s") for i, lam in enumerate(grid)]
    best = F.array_max(F.array(*[F.struct(F.round(x, 6).alias("ll"), (-lam).alias("minus"), lam.alias("lambda")) for x, lam in zip(ll, grid)]))
    return g.select(ID, best["lambda"].alias("lambda"))


def boxcox_lambda_loglik(df: DataFrame, col: str = "y", lo: float = -1.0, hi: float = 2.0, step: float = 0.01) -> DataFrame:
    """Box-Cox parameter of each series by a grid scan: steps of 0.1, then of ``step`` around the best.

    Each scan is one aggregate over the panel; non-positive values are left out. Grid points are whole multiples of
    their step, so that no error builds up.
    """
    positive = df.where(F.col(col) > 0)
    coarse = _loglik(positive, col, [F.lit(k * 0.1) for k in range(round(lo / 0.1), round(hi / 0.1) + 1)])
    around = coarse.select(ID, F.round(F.col("lambda") / step).cast("int").alias("__at"))
    reach = round(0.1 / step)
    return _loglik(positive.join(around, ID), col, [(F.col("__at") + k) * step for k in range(-reach, reach + 1)], ["__at"])


def boxcox_lambda_guerrero(df: DataFrame, season: int = 365, col: str = "y", lo: float = -1.0, hi: float = 2.0, step: float = 0.05) -> DataFrame:
    """Parameter that makes sd / mean**(1 - lambda) of consecutive blocks of ``season`` rows vary least."""
    w = series_window()
    blocks = df.withColumn("block", F.floor((F.row_number().over(w) - 1) / season)).groupBy(ID, "block").agg(F.avg(col).alias("m"), F.stddev_samp(col).alias("s"), F.count(col).alias("n"))
    whole = blocks.where((F.col("n") == season) & (F.col("m") > 0))
    ratio = F.col("s") / F.pow("m", 1 - F.col("lambda"))
    points = whole.withColumn("lambda", F.explode(_grid(F.lit(lo), F.lit(hi), step))).withColumn("r", ratio)
    spread = points.groupBy(ID, "lambda").agg((F.stddev_samp("r") / F.nullif(F.avg("r"), F.lit(0.0))).alias("cv"))
    return spread.where("cv IS NOT NULL").groupBy(ID).agg(F.min_by("lambda", F.struct(F.round("cv", 9), "lambda")).alias("lambda"))


def fit_scaler(df: DataFrame, cols: Sequence[str], kind: str = "zscore", ddof: int = 0, end_train: Column | None = None, gap_hours: int = 0) -> DataFrame:
    """One row a series with the statistics of each column over the training slice: ``{c}_a`` and ``{c}_b``.

    zscore: mean and standard deviation (0 becomes 1); minmax: minimum and maximum.
    """
    if end_train is not None:
        df = df.where(F.col(DS) <= end_train - F.make_interval(hours=F.lit(gap_hours)))
    if kind == "minmax":
        aggs = [f(c).alias(f"{c}_{n}") for c in cols for n, f in (("a", F.min), ("b", F.max))]
    elif kind == "zscore":
        sd = F.stddev_pop if ddof == 0 else F.stddev_samp
        aggs = [x for c in cols for x in (F.avg(c).alias(f"{c}_a"), F.coalesce(F.nullif(sd(c), F.lit(0.0)), F.lit(1.0)).alias(f"{c}_b"))]
    else:
        raise ValueError(f"unknown scaler {kind}")
    return df.groupBy(ID).agg(*aggs)


def _scaled(x: Column, a: Column, b: Column, kind: str, low: float, high: float, inverse: bool) -> Column:
    if kind == "zscore":
        return x * (b + EPS) + a if inverse else (x - a) / (b + EPS)
    width = b - a + EPS
    return (x - low) / (high - low) * width + a if inverse else (x - a) / width * (high - low) + low


def apply_scaler(df: DataFrame, stats: DataFrame, cols: Sequence[str], kind: str = "zscore", low: float = 0.0, high: float = 1.0, inverse: bool = False, suffix: str = "") -> DataFrame:
    """Scale ``cols`` by ``stats`` (from ``fit_scaler``), or scale back; other columns are left alone. A series without statistics raises."""
    joined = df.join(stats.withColumn("__known", F.lit(True)), ID, "left")
    known = F.when(F.col("__known").isNull(), F.raise_error(F.concat(F.lit("no statistics for series "), ID))).otherwise(F.col(ID))
    joined = joined.withColumn(ID, known).drop("__known")
    new = {c: _scaled(F.col(c), F.col(f"{c}_a"), F.col(f"{c}_b"), kind, low, high, inverse) for c in cols}
    return joined.withColumns({f"{c}{suffix}": x for c, x in new.items()}).drop(*[f"{c}_{n}" for c in cols for n in "ab"])


def per_window_scaler(df: DataFrame, col: str = "y", length: int = 168) -> DataFrame:
    """``{col}_scaled``: each value by the mean and deviation of the ``length`` rows that end with it; null before."""
    w = series_window().rowsBetween(-(length - 1), 0)
    full = F.count(F.lit(1)).over(w) == length
    sd = F.coalesce(F.nullif(F.stddev_pop(col).over(w), F.lit(0.0)), F.lit(1.0))
    return df.withColumn(f"{col}_scaled", F.when(full, (F.col(col) - F.avg(col).over(w)) / (sd + EPS)))


