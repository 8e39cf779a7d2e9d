"""Exploratory panel analytics: profiles, responses, correlations, smoothers, components."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .features import add_lags
from .panel import DS, ID, season_of, timestamp


def _profile(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(col).alias("mean"), F.percentile(col, F.lit(0.1)).alias("p10"), F.percentile(col, F.lit(0.9)).alias("p90"))


def daily_profile(df: DataFrame, col: str = "y", where: Column | None = None) -> DataFrame:
    """Mean and central 80 % by series, month and hour."""
    rows = df if where is None else df.where(where)
    return _profile(rows.withColumns({"month": F.month(DS), "hour": F.hour(DS)}), [ID, "month", "hour"], col)


def weekly_profile(df: DataFrame, periods: Sequence[tuple[str, str, str]] | None = None, col: str = "y") -> DataFrame:
    """Mean and central 80 % by series, group and hour of the week; groups are months or named periods, later ones winning."""
    if periods is None:
        group = F.month(DS).cast("string")
    else:
        group = F.lit(None).cast("string")
        for name, start, end in periods:
            group = F.when(F.col(DS).between(timestamp(start), timestamp(end)), F.lit(name)).otherwise(group)
    rows = df.withColumns({"grp": group, "how": F.weekday(DS) * 24 + F.hour(DS)}).where(F.col("grp").isNotNull())
    return _profile(rows, [ID, "grp", "how"], col)


def temp_response(df: DataFrame, x: str = "temperature", y: str = "y") -> DataFrame:
    """Correlation and least-squares line of y on temperature by series, season and hour."""
    rows = df.withColumns({"season": season_of(), "hour": F.hour(DS)})
    return rows.groupBy(ID, "season", "hour").agg(F.corr(x, y).alias("corr"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def _long_pairs(df: DataFrame, cols: Sequence[str], f) -> DataFrame:
    pairs = list(combinations(sorted(cols), 2))
    wide = df.groupBy(ID).agg(*[f(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = wide.unpivot([ID], [f"`{a}|{b}`" for a, b in pairs], "pair", "value")
    parts = F.split("pair", r"\|")
    return long.select(ID, parts[0].alias("a"), parts[1].alias("b"), "value")


def _concordance(x: np.ndarray, y: np.ndarray) -> float | None:
    """Kendall's tau-b of two columns in n log n steps of search: discordant pairs are inversions of y in the order of x."""
    ties = lambda *c: sum(n * (n - 1) // 2 for n in np.unique(np.column_stack(c), axis=0, return_counts=True)[1].tolist())
    pairs, tx, ty = len(x) * (len(x) - 1) // 2, ties(x), ties(y)
    seen: list[float] = []
    discordant = 0
    for i, v in enumerate(y[np.lexsort((y, x))].tolist()):
        at = bisect_right(seen, v)
        discordant += i - at
        seen.insert(at, v)
    both = (pairs - tx) * (pairs - ty)
    return (pairs - tx - ty + ties(x, y) - 2 * discordant) / both**0.5 if both else None


def _kendall(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A task a series, as its rows must meet in order; series of one row have no pairs and give no rows."""
    pairs = list(combinations(sorted(cols), 2))
    schema = f"{ID} {dict(rows.dtypes)[ID]}, a string, b string, value double"

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        wanted = pairs if len(frame) > 1 else []
        out = [(key[0], a, b, _concordance(frame[a].to_numpy(float), frame[b].to_numpy(float))) for a, b in wanted]
        return pd.DataFrame(out, columns=[ID, "a", "b", "value"])

    return rows.groupBy(ID).applyInPandas(run, schema)


def corr_matrix(df: DataFrame, cols: Sequence[str], method: str = "pearson") -> DataFrame:
    """Correlation of each pair of columns within each series; ties get average ranks (spearman) or are left out (kendall tau-b)."""
    if method == "pearson":
        return _long_pairs(df, cols, F.corr)
    if method == "spearman":
        ranks = {}
        for c in cols:
            w = Window.partitionBy(ID)
            ranks[c] = F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(ID, c)) - 1) / 2.0
        return _long_pairs(df.dropna(subset=list(cols)).select(ID, *[x.alias(c) for c, x in ranks.items()]), cols, F.corr)
    if method == "kendall":
        return _kendall(df.dropna(subset=list(cols)).select(ID, *cols), cols)
    raise ValueError(f"unknown method {method}")


def _lowess(x: np.ndarray, y: np.ndarray, frac: float, rounds: int = 3) -> np.ndarray:
    """Locally weighted lines with tricube weights over the nearest frac * n points, and robustness rounds."""
    n = len(x)
    k = min(n, max(2, int(np.ceil(frac * n))))
    fit, robust = np.empty(n), np.ones(n)
    starts = np.zeros(n, int)
    first = 0
    for i in range(n):
        while first + k < n and x[first + k] - x[i] < x[i] - x[first]:
            first += 1
        starts[i] = first
    for _ in range(rounds + 1):
        for i in range(n):
            s = slice(starts[i], starts[i] + k)
            far = max(x[i] - x[s.start], x[s.stop - 1] - x[i]) or 1.0
            w = np.clip(1 - (np.abs(x[s] - x[i]) / far) ** 3, 0, None) ** 3 * robust[s]
            total = w.sum()
            if total <= 0:
                fit[i] = y[i]
                continue
            mx, my = w @ x[s] / total, w @ y[s] / total
            v = w @ (x[s] - mx) ** 2
            slope = w @ ((x[s] - mx) * (y[s] - my)) / v if v > 1e-12 else 0.0
            fit[i] = my + slope * (x[i] - mx)
        e = np.abs(y - fit)
        m = np.median(e)
        if m <= 1e-12:
            break
        robust = np.clip(1 - (e / (6 * m)) ** 2, 0, None) ** 2
    return fit


def lowess_curve(df: DataFrame, x: str, y: str, frac: float = 0.3, keys: Sequence[str] = (ID,)) -> DataFrame:
    """Smooth y on x within each group (one task a group; for aggregated panels)."""
    schema = ", ".join(f"{c} {t}" for c, t in df.select(*keys).dtypes) + ", x double, fit double"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.dropna().sort_values(["x", "y"], kind="stable").reset_index(drop=True)
        fit = _lowess(rows["x"].to_numpy(), rows["y"].to_numpy(), frac) if len(rows) else np.empty(0)
        return rows.assign(fit=fit)[[*keys, "x", "fit"]]

    return df.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).groupBy(*keys).applyInPandas(run, schema)


def dynamic_pca(df: DataFrame, cols: Sequence[str], max_lag: int = 5, k: int = 2) -> tuple[DataFrame, list[float]]:
    """Principal components of standardised columns and their lags, with calendar fields; and the explained variance."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

    lagged = add_lags(df.select(ID, DS, *cols), cols, range(1, max_lag + 1)).dropna()
    names = [c for c in lagged.columns if c not in (ID, DS)]
    vectors = VectorAssembler(inputCols=names, outputCol="v").transform(lagged)
    scaled = StandardScaler(withMean=True, inputCol="v", outputCol="z").fit(vectors).transform(vectors)
    model = PCA(k=k, inputCol="z", outputCol="pc").fit(scaled)
    from pyspark.ml.functions import vector_to_array

    parts = vector_to_array("pc")
    out = model.transform(scaled).select(ID, DS, *[parts[i].alias(f"pc{i + 1}") for i in range(k)], F.month(DS).alias("month"), F.quarter(DS).alias("quarter"), F.hour(DS).alias("hour"), F.dayofyear(DS).alias("doy"))
    return out, [float(v) for v in model.explainedVariance]


def pca_outliers(components: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` points of each series farthest from its centre, in standard deviations of its components."""
    pcs = [c for c in components.columns if c.startswith("pc")]
    w = Window.partitionBy(ID)
    z2 = sum((F.pow((F.col(c) - F.avg(c).over(w)) / F.nullif(F.stddev_pop(c).over(w), F.lit(0.0)), F.lit(2.0)) for c in pcs), F.lit(0.0))
    ranked = components.withColumn("distance", F.sqrt(z2)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("distance"), DS)))
    return ranked.where(F.col("rank") <= top).select(ID, DS, "distance", "rank")


def pivot_series(df: DataFrame, ids: Sequence[str], col: str = "y") -> DataFrame:
    """Wide table: a row a timestamp, a column a series of the given list."""
    return df.groupBy(DS).pivot(ID, list(ids)).agg(F.first(col))
