"""Forecast scoring on the long schema (unique_id, cutoff, ds, y, model, yhat)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .backtest import hours_between
from .panel import DS, ID, hours, series_window, timestamp



def _error() -> Column:
    return F.col("y") - F.col("yhat")


def mae() -> Column:
    return F.avg(F.abs(_error()))


def rmse() -> Column:
    return F.sqrt(F.avg(_error() * _error()))


def mape() -> Column:
    """Rows with y = 0 have no relative error and are left out."""
    return F.avg(F.abs(F.try_divide(_error(), F.col("y"))))


def me() -> Column:
    return F.avg(_error())


def smape(factor: float = 2.0, tiny: float = 1e-7) -> Column:
    size = F.abs("y") + F.abs("yhat")
    return F.avg(F.when(size <= tiny, 0.0).otherwise(factor * F.abs(_error()) / F.greatest(size, F.lit(tiny))))


#: Metrics that are aggregates of the scored rows alone; a registry that callers extend.
METRICS: dict[str, Callable[[], Column]] = {"mae": mae, "rmse": rmse, "mape": mape, "me": me, "smape": smape}


def normaliser(target: DataFrame, start: str = "2019-01-01 00:00:00", end: str = "2025-01-01 00:00:00") -> DataFrame:
    """Mean absolute target of each series over a period (both ends included); 0 becomes null."""
    return target.where(F.col(DS).between(timestamp(start), timestamp(end))).groupBy(ID).agg(F.nullif(F.avg(F.abs("y")), F.lit(0.0)).alias("__norm"))


def naive_scale(target: DataFrame, season: int = 24) -> DataFrame:
    """Mean |y_t - y_(t-season)| of each series up to each timestamp: a running average, looked up at cutoffs."""
    step = F.abs(F.col("y") - F.lag("y", season).over(series_window()))
    rows = target.select(ID, DS, step.alias("__d"))
    w = series_window().rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(ID, F.col(DS).alias("cutoff"), F.nullif(F.avg("__d").over(w), F.lit(0.0)).alias("__scale"))


def evaluate_cv(cv: DataFrame, target: DataFrame | None = None, metrics: Sequence[str] = ("mae", "rmse", "mape", "me", "smape", "nmae", "mase"), extra: Sequence[str] = (), season: int = 24) -> DataFrame:
    """Scores per (unique_id, cutoff, model) as (.., metric, value), all in one aggregate.

    ``target`` is the full panel, needed by nmae and mase. ``extra`` adds grouping keys, such as horizon_h.
    """
    keys = [ID, "cutoff", *extra, "model"]
    plain = [m for m in metrics if m in METRICS]
    scaled = [m for m in metrics if m in ("nmae", "mase")]
    if unknown := set(metrics) - set(plain) - set(scaled):
        raise ValueError(f"unknown metrics {sorted(unknown)}")
    if scaled and target is None:
        raise ValueError("nmae and mase need the target panel")
    wide = cv.groupBy(*keys).agg(*[METRICS[m]().alias(m) for m in plain], mae().alias("__mae"))
    if "nmae" in scaled:
        wide = wide.join(normaliser(target), ID, "left").withColumn("nmae", F.col("__mae") / F.col("__norm"))
    if "mase" in scaled:
        wide = wide.join(naive_scale(target, season), [ID, "cutoff"], "left").withColumn("mase", F.col("__mae") / F.col("__scale"))
    return wide.unpivot(keys, list(metrics), "metric", "value")


def evaluate(forecast: DataFrame, target: DataFrame, metrics: Sequence[str] = ("mae", "rmse", "mase"), insample: int | None = None, season: int = 24) -> DataFrame:
    """Scores of a single split; a seasonal naive model is added if absent, and only the last ``insample`` rows scale."""
    from .backtest import seasonal_naive
    from .panel import tail_per_series

    name = f"Naive{season}h"
    truth = forecast.select(ID, "cutoff", DS, "y").distinct()
    naive = seasonal_naive(target, truth, season, name).select(*forecast.columns)
    both = forecast.where(F.col("model") != name).unionByName(naive)
    past = target.join(forecast.groupBy(ID).agg(F.min("cutoff").alias("__c")), ID).where(F.col(DS) <= F.col("__c")).drop("__c")
    return evaluate_cv(both, past if insample is None else tail_per_series(past, insample), metrics, season=season)


def threshold_errors(cv: DataFrame, thresholds: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Mean over-forecast, mean under-forecast and mean absolute error where y exceeds its series' threshold.

    ``thresholds`` (unique_id, y_th) is one row a series. One row per (unique_id, model); 0.0 where no row counts,
    also for a series without a threshold.
    """
    e = F.col("yhat") - F.col("y")
    high = F.col("y") > F.col("y_th")
    mean = lambda where, x: F.coalesce(F.avg(F.when(where, x)), F.lit(0.0))
    rows = cv.join(thresholds.select(ID, "y_th"), ID, "left")
    return rows.groupBy(ID, *extra, "model").agg(mean(high & (e > 0), e).alias("over"), mean(high & (e < 0), -e).alias("under"), mean(high, F.abs(e)).alias("mae"))


def pct_increase(scores: DataFrame, baseline: str = "Naive24h") -> DataFrame:
    """``<metric>_pct_inc``: change against the baseline in percent, 0 for the baseline; none for ``me``."""
    keys = [c for c in scores.columns if c not in ("model", "value")]
    base = scores.where(F.col("model") == baseline).select(*keys, F.col("value").alias("__b"))
    inc = F.when(F.col("model") == baseline, 0.0).otherwise(F.try_divide(F.col("value") - F.col("__b"), F.col("__b")) * 100)
    return scores.where("metric != 'me'").join(base, keys, "left").select(*[c for c in keys if c != "metric"], "model", F.concat("metric", F.lit("_pct_inc")).alias("metric"), inc.alias("value"))


def wins(scores: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Credit of each model in each window: models as good as the best share one point; ``me`` counts by size."""
    keys = [ID, "metric", "cutoff", *extra]
    loss = F.when(F.col("metric") == "me", F.abs("value")).otherwise(F.col("value"))
    best = F.min("__loss").over(Window.partitionBy(*keys))
    close = F.abs(F.col("__loss") - best) <= 1e-8 + 1e-5 * F.abs(best)
    marked = scores.withColumn("__loss", loss).withColumn("__close", F.coalesce(close, F.lit(False)))
    share = F.sum(F.col("__close").cast("int")).over(Window.partitionBy(*keys))
    return marked.withColumn("credit", F.when(F.col("__close"), 1 / F.greatest(share, F.lit(1))).otherwise(0.0)).drop("__loss", "__close")


def cv_summary(scores: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Mean, median, deviation and win rate of each (unique_id, metric, model) over windows."""
    return wins(scores, extra).groupBy(ID, "metric", *extra, "model").agg(
        F.avg("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"), F.stddev_samp("value").alias("std"), F.avg("credit").alias("wrate"), F.count("value").alias("n")
    )


def summary_table(summary: DataFrame, metrics: Sequence[str], top: int | None = None, by: str | None = None, runs: DataFrame | None = None) -> DataFrame:
    """One row a (unique_id, model) with ``<metric>_<stat>`` columns, 'Average' rows over series, ranked within each id.

    ``runs`` (unique_id, model, avg_el_per_fit; a row each, as ``run_metadata`` makes) adds the seconds of a fit; null where unknown.
    """
    stats = ("mean", "median", "std", "wrate")
    aggs = [F.max(F.when(F.col("metric") == m, F.col(s))).alias(f"{m}_{s}") for m in metrics for s in stats]
    wide = summary.groupBy(ID, "model").agg(*aggs)
    names = [f"{m}_{s}" for m in metrics for s in stats]
    if runs is not None:
        wide = wide.join(runs.select(ID, "model", "avg_el_per_fit"), [ID, "model"], "left")
        names.append("avg_el_per_fit")
    average = wide.groupBy("model").agg(*[F.avg(c).alias(c) for c in names]).select(F.lit("Average").alias(ID), "model", *names)
    order = by or f"{metrics[0]}_mean"
    ranked = wide.unionByName(average).withColumn("rank", F.row_number().over(Window.partitionBy(ID).orderBy(F.asc_nulls_last(F.round(order, 9)), "model")))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def loss_diffs(scores: DataFrame, baseline: str = "Naive24h") -> DataFrame:
    """Loss of each model less the baseline's in the same window."""
    keys = [c for c in scores.columns if c not in ("model", "value")]
    base = scores.where(F.col("model") == baseline).select(*keys, F.col("value").alias("__b"))
    return scores.where(F.col("model") != baseline).join(base, keys).select(*keys, F.concat(F.lit("LD-"), "model").alias("model"), (F.col("value") - F.col("__b")).alias("value"))


def with_horizon(cv: DataFrame, every: int = 1) -> DataFrame:
    """Adds ``horizon_h``, hours since the cutoff; keeps each ``every``-th."""
    return cv.withColumn("horizon_h", hours_between("cutoff", DS)).where(F.col("horizon_h") % every == 0)


def metric_interval(scores: DataFrame, level: float = 0.8) -> DataFrame:
    """Mean and central percentile interval of each (unique_id, metric, model)."""
    tail = (1 - level) / 2
    return scores.groupBy(ID, "metric", "model").agg(F.avg("value").alias("mean"), F.percentile("value", F.lit(tail)).alias("lo"), F.percentile("value", F.lit(1 - tail)).alias("hi"))


def covariate_by_cutoff(scores: DataFrame, aux: DataFrame, col: str = "temperature") -> DataFrame:
    """Scores beside the mean covariate of the day that follows each cutoff."""
    day = F.date_trunc("day", DS).cast("timestamp_ntz") - hours(1)
    means = aux.groupBy(ID, day.alias("cutoff")).agg(F.avg(col).alias(col))
    return scores.join(means, [ID, "cutoff"], "left")


def fit_criteria(forecasts: DataFrame, k: Mapping[str, int]) -> DataFrame:
    """SSE-based adjusted R2, AIC, AICc and BIC of each (unique_id, model) with ``k`` predictors."""
    params = F.coalesce(*[F.when(F.col("model") == m, F.lit(v)) for m, v in k.items()], F.lit(0))
    e2 = _error() * _error()
    g = forecasts.groupBy(ID, "model").agg(F.sum(e2).alias("sse"), F.count(e2).alias("t"), F.var_pop("y").alias("v")).withColumn("k", params)
    t, n, sse = F.col("t").cast("double"), F.col("k").cast("double"), F.col("sse")
    aic = t * F.ln(sse / t) + 2 * (n + 2)
    r2 = 1 - F.try_divide(sse, t * F.col("v"))
    return g.select(ID, "model", (1 - (1 - r2) * (t - 1) / (t - n - 1)).alias("adj_r2"), aic.alias("aic"), (aic + 2 * (n + 2) * (n + 3) / (t - n - 3)).alias("aicc"), (t * F.ln(sse / t) + (n + 2) * F.ln(t)).alias("bic"))
