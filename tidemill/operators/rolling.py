"""Rolling-origin backtests of fitted models over an append-only store.

A model has two halves: ``fit`` makes a table of parameters, one row a series of a fit group, and ``forecast`` makes
forecasts of windows from that table. A backtest goes through the fit groups in order; in each, all series are fitted
and forecast at once. Parameters, forecasts and, last, a record of the windows done are written as partitions by
configuration and fit group. A partition is replaced as a whole when Spark commits its job, so a run that was
stopped is resumed by running it again: groups on record are not touched, and a group that was fitted but not
forecast keeps its parameters.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tidemill.sources.panel_io import config_hash, written

from .arima import Sarima
from .backtest import refit_schedule, resume_windows
from .models import contexts, ets_fit, ets_forward, ets_steps, mstl_parts, mstl_steps
from .panel import DS, ID, hours

_DONE = "unique_id string, window int, cutoff timestamp_ntz, seconds double, config_hash string, fit_group int"


@dataclass(frozen=True)
class Model:
    """``fit(data, fits)``: parameters for each (unique_id, cutoff) of ``fits``, one row a series; ``forecast(data, windows, fit, horizon)``:
    unique_id, cutoff, step, yhat. Neither may look beyond the cutoffs but at columns that are known ahead.

    ``data`` is what ``prepare(df, plan)`` makes once for a run, the panel itself if not given. ``config`` names everything
    that forecasts depend on.
    """

    name: str
    fit: Callable[[Any, DataFrame], DataFrame]
    forecast: Callable[[Any, DataFrame, DataFrame, int], DataFrame]
    config: Mapping[str, object] = field(default_factory=dict)
    prepare: Callable[[DataFrame, DataFrame], Any] = lambda df, plan: df


def ets_model(length: int = 504) -> Model:
    """Exponential smoothing of the last ``length`` hours; parameters of the fit group are carried over its windows."""

    def forecast(df: DataFrame, windows: DataFrame, fit: DataFrame, horizon: int) -> DataFrame:
        return ets_steps(ets_forward(contexts(df, windows, length), fit), horizon)

    return Model("ETS", lambda df, fits: ets_fit(contexts(df, fits, length)), forecast, {"length": length})


def mstl_model(periods: tuple[int, ...] = (24, 168), windows: tuple[int, ...] = (11, 15), length: int = 504) -> Model:
    """MSTL with smoothed trend + remainder: each window's context is decomposed, the smoothing parameters are the fit group's."""
    config = {"periods": periods, "windows": windows, "length": length}

    def fit(df: DataFrame, fits: DataFrame) -> DataFrame:
        return ets_fit(mstl_parts(df, fits, 1, **config).select(ID, "cutoff", "context"))

    def forecast(df: DataFrame, cutoffs: DataFrame, fit: DataFrame, horizon: int) -> DataFrame:
        parts = mstl_parts(df, cutoffs, horizon, **config)
        return mstl_steps(parts, ets_forward(parts.select(ID, "cutoff", "context"), fit), horizon)

    return Model("MSTL", fit, forecast, config)


def sarima_model(model: Sarima = Sarima()) -> Model:
    """``Sarima``: innovations from the first cutoff of the plan, coefficients of the fit group, contexts of each window."""

    def prepare(df: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
        return written(df.select(ID, DS, "y"), "panel"), *model.rows(df, plan)

    def fit(data: tuple, fits: DataFrame) -> DataFrame:
        return model.fit_rows(data[1], data[2], fits)

    def forecast(data: tuple, windows: DataFrame, fit: DataFrame, horizon: int) -> DataFrame:
        return model.forecast_rows(*data, windows, fit.drop("cutoff"), horizon)

    return Model("SARIMA", fit, forecast, asdict(model), prepare)


def _stored(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """What a folder of the store holds; nothing if it was never written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _commit(rows: DataFrame, path: str, digest: str, group: int) -> None:
    """Put ``rows`` in the place of the partition of a configuration and fit group."""
    named = rows.withColumns({"config_hash": F.lit(digest), "fit_group": F.lit(group)})
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("config_hash", "fit_group").parquet(path)


def cv_backtest(df: DataFrame, model: Model, plan: DataFrame, horizon: int, path: str, refit: int | bool | None = 1) -> DataFrame:
    """Forecasts of every window of ``plan`` (see ``cv_plan``): unique_id, cutoff, ds, y, model, yhat, from the store under ``path``.

    A model is fitted at the first window of each fit group: always (``refit`` None or True), once (False), or every
    ``refit`` windows. Windows on record with the same configuration are not run again; a fit group is run as a
    whole. Series without a context long enough have no forecasts, and are on record nonetheless.
    """
    spark = df.sparkSession
    digest = config_hash({"model": model.name, "horizon": horizon, "refit": str(refit), **model.config})
    schedule = written(refit_schedule(plan, refit).select(ID, "window", "cutoff", "fit_group"), "schedule")
    todo = resume_windows(schedule, _stored(spark, f"{path}/done", _DONE), digest)
    left = sorted(r[0] for r in todo.select("fit_group").distinct().collect())  # one a fit, however many series
    data = model.prepare(df, schedule) if left else None
    for group in left:
        began = time.time()
        windows = schedule.where(F.col("fit_group") == group)
        fits = windows.groupBy(ID).agg(F.min("cutoff").alias("cutoff"))
        fitted = model.fit(data, fits)
        kept = _fits(spark, path, digest, group)
        if kept is None:
            _commit(fitted.select(ID, F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("parameters")), f"{path}/fits", digest, group)
            kept = _fits(spark, path, digest, group)
        seconds = time.time() - began
        parameters = kept.select(F.from_json("parameters", fitted.schema).alias("p")).select("p.*")
        found = model.forecast(data, windows.select(ID, "cutoff"), parameters, horizon)
        named = windows.select(ID, "window", "cutoff").join(found.select(ID, "cutoff", "step", "yhat"), [ID, "cutoff"])
        _commit(named.withColumn("model", F.lit(model.name)), f"{path}/forecasts", digest, group)
        # the record comes last: without it the group is run again
        _commit(windows.select(ID, "window", "cutoff", F.lit(seconds / max(fits.count(), 1)).alias("seconds")), f"{path}/done", digest, group)
    return backtest_results(df, path, digest)


def _fits(spark: SparkSession, path: str, digest: str, group: int) -> DataFrame | None:
    rows = _stored(spark, f"{path}/fits", "unique_id string, parameters string, config_hash string, fit_group int")
    rows = rows.where((F.col("config_hash") == digest) & (F.col("fit_group") == group))
    return None if rows.isEmpty() else rows


def backtest_results(df: DataFrame, path: str, digest: str | None = None) -> DataFrame:
    """Forecasts of the fit groups on record (of one configuration, or of all) with the truth beside them."""
    spark = df.sparkSession
    done = _stored(spark, f"{path}/done", _DONE)
    rows = _stored(spark, f"{path}/forecasts", "unique_id string, window int, cutoff timestamp_ntz, step int, yhat double, model string, config_hash string, fit_group int")
    if digest is not None:
        done, rows = (x.where(F.col("config_hash") == digest) for x in (done, rows))
    whole = rows.join(done.select(ID, "window", "config_hash").distinct(), [ID, "window", "config_hash"], "left_semi")
    dated = whole.withColumn(DS, F.col("cutoff") + hours(F.col("step")))
    return dated.join(df.select(ID, DS, "y"), [ID, DS], "left").select(ID, "cutoff", DS, "y", "model", "yhat", *["config_hash"] * (digest is None))


def fit_seconds(spark: SparkSession, path: str) -> DataFrame:
    """Mean seconds a fit of each configuration on record: config_hash, avg_el_per_fit, n_fits, n_windows."""
    done = _stored(spark, f"{path}/done", _DONE)
    return done.groupBy("config_hash").agg(F.avg("seconds").alias("avg_el_per_fit"), F.count_distinct("unique_id", "fit_group").alias("n_fits"), F.count("*").alias("n_windows"))
