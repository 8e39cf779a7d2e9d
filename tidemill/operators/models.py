"""Forecast models as Spark jobs; the unit of work is (unique_id, cutoff), all windows in parallel.

None is a clone of a library's maximum-likelihood fit: see the notes at each function.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .backtest import decoder_samples, hours_between, safe_lags
from .decompose import add_annual, mstl, remove_annual
from .panel import DS, ID, hours, series_window
from .transforms import transform_target
from .window_sums import window_sums

#: Smoothing candidates: level, trend and damping; no trend where beta is null.
ALPHAS, BETAS, PHIS = (0.1, 0.3, 0.5, 0.8), (None, 0.05, 0.2), (1.0, 0.9)


def z_of(level: float) -> float:
    """Half width of a two-sided interval of ``level`` percent, in deviations."""
    return NormalDist().inv_cdf(0.5 + level / 200)


def relative(df: DataFrame, cutoffs: DataFrame, first: int, last: int) -> DataFrame:
    """Rows of ``df`` from ``first`` to ``last`` hours after each cutoff of their series: adds ``cutoff`` and ``step``.

    Cutoffs are spread over their hours and met by series and hour, so the join makes windows x hours rows, as
    many as are asked for, and never meets each row of a series with each of its windows.
    """
    spread = cutoffs.select(ID, "cutoff").distinct().withColumn("step", F.explode(F.sequence(F.lit(first), F.lit(last))))
    return df.join(spread.withColumn(DS, F.col("cutoff") + hours(F.col("step"))), [ID, DS])


def contexts(df: DataFrame, cutoffs: DataFrame, length: int, col: str = "y") -> DataFrame:
    """The last ``length`` values up to each cutoff as one array ``context`` per (unique_id, cutoff) of ``cutoffs``.

    A context may be shorter where its series begins later. One with a null, with a missing hour or without a
    value at its cutoff is left out, as its lags and seasons would be shifted.
    """
    rows = relative(df.select(ID, DS, F.col(col).cast("double").alias("v")), cutoffs, 1 - length, 0)
    found = rows.groupBy(ID, "cutoff").agg(F.sort_array(F.collect_list(F.struct("step", "v"))).alias("s"), F.min("step").alias("low"), F.count("v").alias("n"))
    whole = (F.col("n") == F.size("s")) & (F.col("n") == 1 - F.col("low"))
    return found.where(whole).select(ID, "cutoff", F.transform("s", lambda x: x["v"]).alias("context"))


def _smoothing(params: dict[str, Column]) -> Column:
    """The state (level ``l``, trend ``b``, sum of squared errors ``sse``) after the column ``context``."""
    start = F.struct(F.get("context", F.lit(0)).cast("double").alias("l"), F.when(params["beta"].isNotNull(), F.get("context", F.lit(1)) - F.get("context", F.lit(0))).otherwise(0.0).cast("double").alias("b"), F.lit(0.0).alias("sse"))

    def step(s, y):
        guess = s["l"] + params["phi"] * s["b"]
        e = y - guess
        level = guess + params["alpha"] * e
        trend = params["phi"] * s["b"] + params["alpha"] * F.coalesce(params["beta"], F.lit(0.0)) * e
        return F.struct(level.alias("l"), trend.alias("b"), (s["sse"] + e * e).alias("sse"))

    return F.aggregate(F.slice("context", 2, F.size("context") - 1), start, step)


def ets_fit(context: DataFrame) -> DataFrame:
    """Exponential smoothing without season: simple, linear and damped candidates on a small grid, best AICc.

    The recursion is the SQL function ``aggregate`` over the context array; every candidate of every series is a
    row: unique_id, cutoff, alpha, beta (null without trend), phi, level, trend, aicc, sigma2.
    """
    spark = context.sparkSession
    grid = [(a, b, p) for a in ALPHAS for b in BETAS for p in PHIS if b is not None or p == 1.0]
    candidates = spark.createDataFrame(grid, "alpha double, beta double, phi double")
    rows = context.where(F.size("context") >= 4).crossJoin(F.broadcast(candidates))  # a dozen candidates
    fitted = rows.withColumn("s", _smoothing({c: F.col(c) for c in candidates.columns}))
    n = (F.size("context") - 1).cast("double")
    k = F.when(F.col("beta").isNull(), 3.0).when(F.col("phi") == 1.0, 5.0).otherwise(6.0)
    aicc = n * F.ln(F.greatest(F.col("s.sse"), F.lit(1e-12)) / n) + 2 * k + 2 * k * (k + 1) / F.greatest(n - k - 1, F.lit(1.0))
    best = fitted.withColumn("aicc", aicc).groupBy(ID, "cutoff").agg(F.min_by(F.struct("alpha", "beta", "phi", F.col("s.l").alias("level"), F.col("s.b").alias("trend"), "aicc", (F.col("s.sse") / F.greatest(n - k, F.lit(1.0))).alias("sigma2")), F.struct("aicc", "alpha", "beta", "phi")).alias("m"))
    return best.select(ID, "cutoff", "m.*")


def ets_forward(context: DataFrame, fit: DataFrame) -> DataFrame:
    """States after other contexts under fixed parameters: ``fit`` has one row a series, with alpha, beta and phi.

    Returns level and trend after each context without refitting, ``sigma2``, the mean squared error of one step over
    the context (that of ``fit``, if it has one), and ``levels``, the level after each value of the context.
    """
    given = "sigma2" in fit.columns
    params = fit.select(ID, "alpha", "beta", "phi", *["sigma2"] * given)
    rows = context.where(F.size("context") >= 4).join(params, ID)
    rows = rows.withColumn("s", _smoothing({c: F.col(c) for c in ("alpha", "beta", "phi")}))
    sigma2 = F.col("sigma2") if given else F.col("s.sse") / (F.size("context") - 1)
    # levels follow from the recursion once more, which keeps its path
    first = F.struct(F.get("context", F.lit(0)).cast("double").alias("l"), F.when(F.col("beta").isNotNull(), F.get("context", F.lit(1)) - F.get("context", F.lit(0))).otherwise(0.0).cast("double").alias("b"), F.array(F.get("context", F.lit(0)).cast("double")).alias("path"))

    def step(s, i):
        guess = s["l"] + F.col("phi") * s["b"]
        e = F.get("context", i - 1) - guess
        level = guess + F.col("alpha") * e
        return F.struct(level.alias("l"), (F.col("phi") * s["b"] + F.col("alpha") * F.coalesce("beta", F.lit(0.0)) * e).alias("b"), F.array_append(s["path"], level).alias("path"))

    levels = F.aggregate(F.sequence(F.lit(2), F.size("context")), first, step, lambda s: s["path"])
    return rows.select(ID, "cutoff", "alpha", "beta", "phi", F.col("s.l").alias("level"), F.col("s.b").alias("trend"), sigma2.alias("sigma2"), levels.alias("levels"))


def _damped(h: Column) -> Column:
    """phi + phi ** 2 + ... + phi ** h."""
    return F.when(F.col("phi") == 1.0, h.cast("double")).otherwise(F.col("phi") * (1 - F.pow("phi", h)) / (1 - F.when(F.col("phi") != 1.0, F.col("phi"))))


def ets_variance(h: Column) -> Column:
    """Variance of a forecast ``h`` steps ahead from alpha, beta, phi and sigma2, for additive errors.

    An error moves the forecast j steps later by c(j) = alpha + alpha * beta * (phi + ... + phi ** j), so the variance is
    sigma2 * (1 + c(1) ** 2 + ... + c(h - 1) ** 2).
    """
    trend = F.col("alpha") * F.coalesce("beta", F.lit(0.0))
    past = F.when(h > 1, F.sequence(F.lit(1), h - 1)).otherwise(F.array().cast("array<int>"))
    return F.col("sigma2") * F.aggregate(past, F.lit(1.0), lambda s, j: s + F.pow(F.col("alpha") + trend * _damped(j), F.lit(2)))


def ets_steps(fit: DataFrame, horizon: int, name: str = "ETS", levels: Sequence[int] = ()) -> DataFrame:
    """Forecasts from fitted states: unique_id, cutoff, step, yhat, model, and ``lo-L`` and ``hi-L`` for each level in percent."""
    out = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    yhat, sd = F.col("level") + _damped(F.col("step")) * F.col("trend"), F.sqrt(ets_variance(F.col("step"))) if levels else None
    ends = [(yhat + sign * z_of(level) * sd).alias(f"{side}-{level}") for level in levels for side, sign in (("lo", -1), ("hi", 1))]
    return out.select(ID, "cutoff", "step", yhat.alias("yhat"), F.lit(name).alias("model"), *ends)


def ets_trend(context: DataFrame, horizon: int, name: str = "ETS", levels: Sequence[int] = ()) -> DataFrame:
    """Forecasts of the best smoothing candidate of each context: unique_id, cutoff, step, yhat, model, and intervals (see ``ets_steps``)."""
    return ets_steps(ets_fit(context), horizon, name, levels)


def mstl_parts(df: DataFrame, cutoffs: DataFrame, horizon: int, periods: Sequence[int] = (24, 168), windows: Sequence[int] = (11, 15), length: int = 504) -> DataFrame:
    """Of the context of each (series, cutoff): trend + remainder as ``context``, and the seasons ahead as ``season``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                y = np.asarray(r.context, float)
                if len(y) < 2 * min(periods) or not np.isfinite(y).all():
                    continue
                t, parts = mstl(y, periods, windows)
                ahead = sum(p[-q:][np.arange(horizon) % q] for p, q in zip(parts, periods, strict=True) if len(p) >= q)
                out.append((getattr(r, ID), r.cutoff, (y - sum(parts)).tolist(), np.asarray(ahead, float).tolist()))
            yield pd.DataFrame(out, columns=[ID, "cutoff", "context", "season"])

    return contexts(df, cutoffs, length).mapInPandas(run, f"{ID} string, cutoff timestamp_ntz, context array<double>, season array<double>")


def mstl_steps(parts: DataFrame, fit: DataFrame, horizon: int, name: str = "MSTL", levels: Sequence[int] = ()) -> DataFrame:
    """Forecasts of the smoothed trend + remainder (``fit``: its states) with the seasons of ``mstl_parts``; seasons move intervals as they are."""
    smooth = ets_steps(fit, horizon, name, levels)
    seasons = parts.select(ID, "cutoff", F.posexplode("season").alias("i", "s")).withColumn("step", F.col("i") + 1)
    ends = [f"{side}-{level}" for level in levels for side in ("lo", "hi")]
    return smooth.join(seasons, [ID, "cutoff", "step"]).select(ID, "cutoff", "step", (F.col("yhat") + F.col("s")).alias("yhat"), "model", *[(F.col(f"`{c}`") + F.col("s")).alias(c) for c in ends])


def mstl_forecast(df: DataFrame, cutoffs: DataFrame, horizon: int, periods: Sequence[int] = (24, 168), windows: Sequence[int] = (11, 15), length: int = 504, name: str = "MSTL", levels: Sequence[int] = ()) -> DataFrame:
    """Decompose the context of each (series, cutoff), smooth trend + remainder, repeat the last seasons.

    Only the decomposition is Python, a row at a time; smoothing, its intervals and seasons are expressions.
    """
    parts = mstl_parts(df, cutoffs, horizon, periods, windows, length)
    return mstl_steps(parts, ets_fit(parts.select(ID, "cutoff", "context")), horizon, name, levels)


def mstl_on_scale(df: DataFrame, cutoffs: DataFrame, horizon: int, kind: str = "none", lambdas: DataFrame | None = None, season: DataFrame | None = None, **kw) -> DataFrame:
    """``mstl_forecast`` on a transformed scale without the annual season, and back: unique_id, cutoff, step, yhat, model, intervals.

    The target is transformed (``kind``, ``lambdas``), the daily seasonal values of ``season`` (on that scale, from
    days before the cutoffs) are subtracted; forecasts and the ends of intervals get the value of the day a year before
    added and are inverted.
    """
    scaled = transform_target(df, kind, lambdas)
    found = mstl_forecast(scaled if season is None else remove_annual(scaled, season), cutoffs, horizon, **kw)
    values = [c for c in found.columns if c not in (ID, "cutoff", "step", "model")]
    if season is not None:
        dated = found.withColumn(DS, F.col("cutoff") + hours(F.col("step")))
        found = add_annual(dated, season, values).drop(DS)
    for c in values:
        found = transform_target(found, kind, lambdas, c, inverse=True)
    return found


def regression_rows(df: DataFrame, lags: Sequence[int], exog: Sequence[str] = (), k_day: int = 2, k_week: int = 1) -> tuple[DataFrame, list[str]]:
    """Regressors of each row: intercept, lags of y, exogenous columns, daily and weekly harmonics."""
    import math

    w = series_window()
    t = hours_between(F.lit("2000-01-03").cast("timestamp_ntz"), F.col(DS))
    terms = {"one": F.lit(1.0)} | {f"lag{k}": F.lag("y", k).over(w) for k in lags} | {c: F.col(c).cast("double") for c in exog}
    for p, most in ((24, k_day), (168, k_week)):
        for k in range(1, most + 1):
            terms |= {f"s{k}_{p}": F.sin(t * (2 * math.pi * k / p)), f"c{k}_{p}": F.cos(t * (2 * math.pi * k / p))}
    return df.select(ID, DS, "y", *[x.alias(f"x_{n}") for n, x in terms.items()]), [f"x_{n}" for n in terms]


def normal_equations(rows: DataFrame, names: Sequence[str], plan: DataFrame, input_size: int) -> DataFrame:
    """Sums of products of regressors over each training slice, one row per (unique_id, cutoff).

    ``xtx`` is the upper triangle row by row, ``xty`` and ``yty`` go with it. They are differences of running sums (see
    ``window_sums``), so long slices that overlap cost no more than short ones. Rows with a null do not count.
    """
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    values = {f"a{i}": F.col(a) * F.col(b) for i, (a, b) in enumerate(pairs)} | {f"b{i}": F.col(a) * F.col("y") for i, a in enumerate(names)} | {"yy": F.col("y") * F.col("y"), "n": F.lit(1).cast("bigint")}
    sums = window_sums(rows.dropna(subset=["y", *names]), values, plan, input_size)
    return sums.select(ID, "cutoff", F.array(*[f"a{i}" for i in range(len(pairs))]).alias("xtx"), F.array(*[f"b{i}" for i in range(len(names))]).alias("xty"), F.col("yy").alias("yty"), "n")


def _full(xtx: Sequence[float], k: int) -> np.ndarray:
    a = np.zeros((k, k))
    a[np.triu_indices(k)] = np.asarray(xtx, float)
    return a + np.triu(a, 1).T


def _solve(a: np.ndarray, xty: np.ndarray) -> np.ndarray:
    """Least squares from sums; regressors are scaled to length 1 first, so that the ridge for singular sums moves none by its unit."""
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    return np.linalg.solve(a / np.outer(scale, scale) + np.eye(len(xty)) * 1e-11, xty / scale) / scale


def dynamic_regression(df: DataFrame, plan: DataFrame, horizon: int, input_size: int = 504, lags: Sequence[int] = (1, 24, 25, 168), exog: Sequence[str] = (), name: str = "DynReg", z: float | None = None) -> DataFrame:
    """Regression on lags, harmonics and exogenous columns, forecast recursively: unique_id, cutoff, step, yhat, model.

    Coefficients solve least squares from sums that Spark aggregates; it has no moving-average terms and is not
    a maximum-likelihood seasonal ARIMA. Windows of one ``fit_group`` of the plan (see ``cv_plan``) share the
    coefficients of the first of them, and only their contexts move on. ``exog`` must be known over the horizon.
    With ``z`` (1.96 for 95 %) ``yhat_lo`` and ``yhat_hi`` are given, from the residuals' variance and the lags.
    """
    rows, names = regression_rows(df, lags, exog)
    keys = [ID, "fit_group"] if "fit_group" in plan.columns else [ID, "cutoff"]
    fits = plan.groupBy(*keys).agg(F.min("cutoff").alias("fit_cutoff"))
    sums = normal_equations(rows, names, fits.select(ID, F.col("fit_cutoff").alias("cutoff")), input_size).withColumnRenamed("cutoff", "fit_cutoff")
    windows = plan.select(*dict.fromkeys([ID, "cutoff", *keys])).distinct().join(fits, keys).select(ID, "cutoff", "fit_cutoff")
    fixed = [i for i, n in enumerate(names) if not n.startswith("x_lag")]
    most = max(lags)
    ahead = explode_horizon(rows.select(ID, DS, F.array(*[names[i] for i in fixed]).alias("x")), plan, horizon)
    future = ahead.groupBy(ID, "cutoff").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "x"))), lambda s: s["x"]).alias("future"))
    table = windows.join(sums, [ID, "fit_cutoff"]).join(future, [ID, "cutoff"]).join(contexts(df, plan, most), [ID, "cutoff"])

    def run(batches):
        for frame in batches:
            out = []
            for r in frame.itertuples(index=False):
                y = list(map(float, r.context))
                x = np.asarray([list(v) for v in r.future], float)
                if len(y) < most or len(x) < horizon or np.isnan(x).any():
                    continue
                xty = np.asarray(r.xty, float)
                beta = _solve(_full(r.xtx, len(names)), xty)
                x_fixed = x @ beta[fixed]
                weight = {k: beta[names.index(f"x_lag{k}")] for k in lags}
                variance = max(float(r.yty - beta @ xty), 0.0) / max(r.n - len(names), 1)
                psi = []
                for h in range(horizon):
                    y.append(float(x_fixed[h] + sum(b * y[-k] for k, b in weight.items())))
                    psi.append(1.0 if not h else sum(b * psi[h - k] for k, b in weight.items() if k <= h))
                    out.append((getattr(r, ID), r.cutoff, h + 1, y[-1], float(np.sqrt(variance * np.square(psi).sum()))))
            yield pd.DataFrame(out, columns=[ID, "cutoff", "step", "yhat", "sd"])

    found = table.select(ID, "cutoff", "xtx", "xty", "yty", "n", "future", "context").mapInPandas(run, f"{ID} string, cutoff timestamp_ntz, step int, yhat double, sd double")
    bands = [] if z is None else [(F.col("yhat") - z * F.col("sd")).alias("yhat_lo"), (F.col("yhat") + z * F.col("sd")).alias("yhat_hi")]
    return found.select(ID, "cutoff", "step", "yhat", F.lit(name).alias("model"), *bands)


def explode_horizon(rows: DataFrame, plan: DataFrame, horizon: int) -> DataFrame:
    """Rows of each window's horizon with their step."""
    return relative(rows, plan, 1, horizon)


def order_search(df: DataFrame, plan: DataFrame, orders: Sequence[Sequence[int]], input_size: int = 504) -> DataFrame:
    """Compare lag sets by AICc from the sums of squares of their fits: unique_id, cutoff, lags, n, sse, aic, aicc, bic, rank.

    All sets are fitted on the same rows, those that have every lag of every set, from one set of sums.
    """
    every = sorted({k for lags in orders for k in lags})
    rows, names = regression_rows(df, every)
    sums = normal_equations(rows, names, plan, input_size)
    sets = [(",".join(map(str, lags)), [i for i, n in enumerate(names) if not n.startswith("x_lag") or int(n[5:]) in lags]) for lags in orders]

    def run(batches):
        for frame in batches:
            out = []
            for r in frame.itertuples(index=False):
                xtx, xty = _full(r.xtx, len(names)), np.asarray(r.xty, float)
                for lags, some in sets:
                    beta = _solve(xtx[np.ix_(some, some)], xty[some])
                    out.append((getattr(r, ID), r.cutoff, lags, r.n, len(some) + 1.0, max(float(r.yty - beta @ xty[some]), 1e-9)))
            yield pd.DataFrame(out, columns=[ID, "cutoff", "lags", "n", "k", "sse"])

    fits = sums.mapInPandas(run, f"{ID} string, cutoff timestamp_ntz, lags string, n bigint, k double, sse double")
    n, k = F.col("n").cast("double"), F.col("k")
    base = n * F.ln(F.col("sse") / n)
    scored = fits.select(ID, "cutoff", "lags", "n", "sse", (base + 2 * k).alias("aic"), (base + 2 * k + 2 * k * (k + 1) / (n - k - 1)).alias("aicc"), (base + k * F.ln(n)).alias("bic"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(ID, "cutoff").orderBy("aicc", "lags")))


def direct_multihorizon(df: DataFrame, first_cutoff, n_windows: int, horizon: int = 24, t_in: int = 24, name: str = "Direct", exog: Sequence[str] = (), season: int = 24) -> DataFrame:
    """One linear model for all horizons of a series' windows: last values, season-ago value and step as features.

    The season-ago value is the last one of the same hour that the cutoff has seen, at any horizon. ``exog`` must
    be known over the horizon. Trained on windows that end before the first test cutoff, so no test value is seen.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    w = series_window()
    seen = F.array(*[F.lag("y", k).over(w) for k in range(max(season, 3))])  # values at the cutoff and before
    base = df.select(ID, DS, "y", *[F.lag("y", k - 1).over(w).alias(f"l{k}") for k in (1, 2, 3)], seen.alias("seen"), F.avg("y").over(w.rowsBetween(-(t_in - 1), 0)).alias("m"))
    steps = base.select(ID, F.col(DS).alias("cutoff"), "l1", "l2", "l3", "m", "seen", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    ago = F.get("seen", F.pmod(-F.col("step"), F.lit(season))).alias("season_ago")
    target = steps.select(ID, "cutoff", "l1", "l2", "l3", "m", "step", ago, (F.col("cutoff") + hours(F.col("step"))).alias(DS))
    rows = target.join(df.select(ID, DS, "y", *exog), [ID, DS]).dropna()
    names = ["l1", "l2", "l3", "m", "season_ago", "step", *exog]
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    model = LinearRegression(labelCol="y", predictionCol="yhat", regParam=1e-3).fit(vectors.where(F.col(DS) <= first_cutoff))
    k = hours_between(first_cutoff, F.col("cutoff"))
    test = vectors.where((k >= 0) & (k % horizon == 0) & (k / horizon < n_windows))
    return model.transform(test).select(ID, "cutoff", DS, "y", F.lit(name).alias("model"), "yhat")


LEARNERS = ("linear", "trees")


def direct_from_samples(df: DataFrame, first_cutoff: Column, n_windows: int, horizon: int = 24, lags: Sequence[int] = (24, 48, 168), exog: Sequence[str] = (), learner: str = "linear", season: int = 24, name: str = "Direct") -> DataFrame:
    """One model for all steps of all series from the samples of ``decoder_samples``: unique_id, cutoff, ds, y, model, yhat.

    A sample is exploded by step; features are the last three values, the mean of the last season, its value at the
    same place of the season, the safe lags and ``exog`` (known ahead) at the step, and the step. ``learner`` is
    'linear' or 'trees' (gradient boosting). It learns from steps up to the first cutoff, so no later value is seen.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression

    if learner not in LEARNERS:
        raise ValueError(f"unknown learner {learner}")
    samples = decoder_samples(df.select(ID, DS, "y", *exog), ["y"], exog, lags, season, horizon, last=season)
    safe = [f"lag{k}" for k in safe_lags(lags, horizon)]
    ends = {f"l{k}": F.element_at("last_y", -k) for k in (1, 2, 3)} | {"m": F.aggregate("last_y", F.lit(0.0), lambda a, x: a + x) / season}
    steps = samples.select(ID, "cutoff", *[x.alias(n) for n, x in ends.items()], "last_y", *[f"future_{c}" for c in (*exog, *safe)], F.posexplode("future_y").alias("i", "y"))
    at_step = {c: F.get(f"future_{c}", F.col("i")).cast("double") for c in (*exog, *safe)} | {"season_ago": F.get("last_y", F.pmod("i", F.lit(season))), "step": F.col("i") + 1}
    rows = steps.select(ID, "cutoff", *ends, *[x.alias(n) for n, x in at_step.items()], (F.col("cutoff") + hours(F.col("i") + 1)).alias(DS), F.col("y").cast("double").alias("y"))
    vectors = VectorAssembler(inputCols=[*ends, *at_step], outputCol="features").transform(rows)
    kind = LinearRegression(regParam=1e-3) if learner == "linear" else GBTRegressor(maxIter=10, maxDepth=4, seed=1)
    model = kind.setLabelCol("y").setPredictionCol("yhat").fit(vectors.where(F.col(DS) <= first_cutoff))
    k = hours_between(first_cutoff, F.col("cutoff"))
    test = vectors.where((k >= 0) & (k % horizon == 0) & (k / horizon < n_windows))
    return model.transform(test).select(ID, "cutoff", DS, "y", F.lit(name).alias("model"), "yhat")


def with_truth(forecasts: DataFrame, df: DataFrame) -> DataFrame:
    """Forecast steps as (unique_id, cutoff, ds, y, model, yhat)."""
    dated = forecasts.withColumn(DS, F.col("cutoff") + hours(F.col("step")))
    return dated.join(df.select(ID, DS, "y"), [ID, DS], "left").select(ID, "cutoff", DS, "y", "model", "yhat")

