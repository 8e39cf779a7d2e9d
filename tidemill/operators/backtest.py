"""Rolling-origin backtests: plans, windows, samples, naive forecasts, checks. No driver loops, no range joins.

The long forecast schema is (unique_id, cutoff, ds, y, model, yhat); ``cutoff`` is the last observed hour and
forecasts begin an hour later.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .features import seconds
from .panel import DS, ID, hours, last_full_day_end, require_columns, series_window

HOUR = 3600


def hours_between(a: Column | str, b: Column | str) -> Column:
    """Whole hours from ``a`` to ``b``."""
    return F.floor((seconds(b) - seconds(a)) / HOUR).cast("int")


def cv_plan(df: DataFrame, horizon: int = 24, n_windows: int | None = None, step: int | None = None, test_hours: int = 168, max_fits: int | None = None) -> DataFrame:
    """Windows of each series: unique_id, window, cutoff, forecast_end, start_train, refit, fit_group, n_windows, n_fits.

    The test span is the last ``test_hours`` up to the series' last full day. Exactly one of ``n_windows`` and
    ``step`` is given: a step follows as (T - h) // (n - 1), rounded down to whole days if it can be, and
    the number of windows as (T - h) // step + 1. With ``max_fits``, a model is refitted every
    ceil(n / max_fits) windows.
    """
    if (n_windows is None) == (step is None):
        raise ValueError("give exactly one of n_windows and step")
    if test_hours < horizon:
        raise ValueError("the test span is shorter than the horizon")
    if step is None:
        step = (test_hours - horizon) // (n_windows - 1) if n_windows > 1 else horizon
        step = step // 24 * 24 or step
    if step < 1:
        raise ValueError("windows do not fit into the test span")
    n = (test_hours - horizon) // step + 1
    refit = 1 if max_fits is None else -(-n // max_fits)
    span = last_full_day_end(df).select(ID, F.col("first_start").alias("start_train"), (F.col("last_end") - hours(test_hours)).alias("first"))
    out = span.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("window"))
    cutoff = F.col("first") + hours(F.col("window") * step)
    return out.where(F.col("first") >= F.col("start_train")).select(
        ID,
        "window",
        cutoff.alias("cutoff"),
        (cutoff + hours(horizon)).alias("forecast_end"),
        "start_train",
        F.lit(refit).alias("refit"),
        F.floor(F.col("window") / refit).cast("int").alias("fit_group"),
        F.lit(n).alias("n_windows"),
        F.lit(-(-n // refit)).alias("n_fits"),
    )


def explode_windows(df: DataFrame, first_cutoff: Column, n_windows: int, step: int, horizon: int) -> DataFrame:
    """Each row once for every window whose horizon (cutoff, cutoff + h] holds it: adds ``window`` and ``cutoff``.

    Window numbers follow from arithmetic on the hours since the first cutoff.
    """
    t = hours_between(first_cutoff, F.col(DS))
    low = F.greatest(F.ceil((t - horizon) / step).cast("int"), F.lit(0))
    high = F.least(F.floor((t - 1) / step).cast("int"), F.lit(n_windows - 1))
    inside = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    return df.withColumn("window", F.explode(inside)).withColumn("cutoff", first_cutoff + hours(F.col("window") * step))


def training_slices(df: DataFrame, plan: DataFrame, input_size: int | None = None, val_size: int = 0) -> DataFrame:
    """Rows that each fit sees: [cutoff - input_size + 1 h, cutoff] of the first window of each fit group.

    With ``val_size`` the last hours before the cutoff get ``part`` 'val'. Series that begin after the start of a
    slice have no such fit. At most ``n_fits`` copies of a row are made, bounded by the plan of its series.
    """
    fits = plan.where(F.col("window") % F.col("refit") == 0).select(ID, "fit_group", "cutoff", "start_train")
    begin = F.col("start_train") if input_size is None else F.col("cutoff") - hours(input_size - 1)
    fits = fits.select(ID, "fit_group", F.col("cutoff").alias("fit_cutoff"), begin.alias("fit_start")).where(begin >= F.col("start_train"))
    joined = df.join(fits, ID).where(F.col(DS).between(F.col("fit_start"), F.col("fit_cutoff")))
    part = F.when(F.col(DS) > F.col("fit_cutoff") - hours(val_size), "val").otherwise("train")
    return joined.withColumn("part", part).drop("fit_start")


def refit_schedule(plan: DataFrame, refit: int | bool | None) -> DataFrame:
    """``fits`` (whether a window fits a model) and ``fit_group`` for refit None or True (always), False (once), or every k windows."""
    w = F.col("window")
    group = w if refit is None or refit is True else F.lit(0) if not refit else F.floor(w / refit).cast("int")
    out = plan.drop("fit_group").withColumn("fit_group", group.cast("int"))
    first = F.row_number().over(Window.partitionBy(ID, "fit_group").orderBy("window")) == 1
    return out.withColumn("fits", first)


def sliding_samples(df: DataFrame, past: Sequence[str], future: Sequence[str], t_in: int, t_out: int, stride: int = 1, target: str = "y") -> DataFrame:
    """Supervised samples: arrays of the last ``t_in`` rows of ``past`` and the next ``t_out`` of ``future`` and the target.

    One row a sample; only complete windows. Columns are named ``past_*`` and ``future_*``; ``cutoff`` is the last
    past timestamp. Non-finite values raise, as a model would silently learn from them.
    """
    w = series_window()
    back, ahead = w.rowsBetween(-(t_in - 1), 0), w.rowsBetween(1, t_out)
    rn = F.row_number().over(w)
    finite = lambda c: F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")), F.raise_error(F.lit(f"non-finite {c}"))).otherwise(F.col(c))
    checked = df.withColumns({c: finite(c) for c in dict.fromkeys([*past, *future, target])})
    out = checked.select(ID, F.col(DS).alias("cutoff"), rn.alias("__rn"), *[F.collect_list(c).over(back).alias(f"past_{c}") for c in past], *[F.collect_list(c).over(ahead).alias(f"future_{c}") for c in dict.fromkeys([*future, target])])
    whole = (F.size(f"past_{past[0]}") == t_in) & (F.size(f"future_{target}") == t_out) & (F.pmod(F.col("__rn") - t_in, F.lit(stride)) == 0)
    return out.where(whole).drop("__rn")


def safe_lags(lags: Sequence[int], horizon: int) -> list[int]:
    """Lags that a decoder may see at every step of the horizon."""
    return [k for k in lags if k >= horizon]


def decoder_samples(df: DataFrame, past: Sequence[str], future: Sequence[str], lags: Sequence[int], t_in: int, t_out: int, stride: int = 1, target: str = "y", last: int = 24) -> DataFrame:
    """``sliding_samples`` with what a decoder may know: ``last_<target>``, the last values up to the cutoff, and ``future_lag<k>``.

    Only lags that are safe at every step of the horizon are given (see ``safe_lags``). Samples begin where every lag of
    their series is known.
    """
    w = series_window()
    safe = safe_lags(lags, t_out)
    rows = df.withColumns({f"lag{k}": F.lag(target, k).over(w) for k in safe} | {"__rn": F.row_number().over(w)})
    rows = rows.where(F.col("__rn") > max([0, *safe])).drop("__rn")
    samples = sliding_samples(rows, past, [*future, *(f"lag{k}" for k in safe)], t_in, t_out, stride, target)
    if last <= t_in and target in past:
        return samples.withColumn(f"last_{target}", F.slice(f"past_{target}", t_in - last + 1, last))
    tails = df.select(ID, F.col(DS).alias("cutoff"), F.collect_list(target).over(w.rowsBetween(-(last - 1), 0)).alias(f"last_{target}"))
    return samples.join(tails.where(F.size(f"last_{target}") == last), [ID, "cutoff"])


def slice_with_history(df: DataFrame, start: Column, end: Column, t_in: int) -> DataFrame:
    """Rows from ``t_in`` hours before ``start`` to ``end``."""
    return df.where(F.col(DS).between(start - hours(t_in), end))


def seasonal_naive(df: DataFrame, targets: DataFrame, season: int, name: str | None = None, col: str = "y") -> DataFrame:
    """Repeat the last observed season: ``targets`` (unique_id, cutoff, ds) with ``model`` and ``yhat``."""
    h = hours_between("cutoff", DS)
    ref = F.col("cutoff") - hours(F.lit(season - 1)) + hours((h - 1) % season)
    past = df.select(ID, F.col(DS).alias("__ref"), F.col(col).alias("yhat"))
    return targets.withColumn("__ref", ref).join(past, [ID, "__ref"], "left").drop("__ref").withColumn("model", F.lit(name or f"Naive{season}h"))


def naive_levels(df: DataFrame, forecasts: DataFrame, season: int, z: Mapping[int, float]) -> DataFrame:
    """Adds ``lo-L`` / ``hi-L``: the deviation of seasonal differences up to each cutoff grows with the root of seasons ahead."""
    w = series_window().rowsBetween(Window.unboundedPreceding, 0)
    diff = df.withColumn("__d", F.col("y") - F.lag("y", season).over(series_window()))
    sigma = diff.select(ID, F.col(DS).alias("cutoff"), F.sqrt(F.avg(F.col("__d") * F.col("__d")).over(w)).alias("__s"))
    k = F.floor((hours_between("cutoff", DS) - 1) / season) + 1
    wide = forecasts.join(sigma, [ID, "cutoff"], "left").withColumn("__w", F.col("__s") * F.sqrt(k))
    bands = [f(F.col("__w") * v).alias(f"{n}-{lv}") for lv, v in z.items() for n, f in (("lo", lambda x: F.col("yhat") - x), ("hi", lambda x: F.col("yhat") + x))]
    return wide.select(*forecasts.columns, *bands)


def window_mean(df: DataFrame, targets: DataFrame, length: int, name: str, col: str = "y") -> DataFrame:
    """Forecast the mean of the last ``length`` rows up to the cutoff."""
    w = series_window().rowsBetween(-(length - 1), 0)
    means = df.select(ID, F.col(DS).alias("cutoff"), F.avg(col).over(w).alias("yhat"))
    return targets.join(means, [ID, "cutoff"], "left").withColumn("model", F.lit(name))


def naive_backtest(df: DataFrame, first_cutoff: Column, n_windows: int, step: int, horizon: int, seasons: Sequence[int] = (24, 168), mean_of: int | None = 24) -> DataFrame:
    """Long forecasts of seasonal naive models (and a mean) for all series and windows at once."""
    truth = explode_windows(df.select(ID, DS, "y"), first_cutoff, n_windows, step, horizon).drop("window")
    parts = [seasonal_naive(df, truth, s) for s in seasons]
    if mean_of:
        parts.append(window_mean(df, truth, mean_of, f"Mean{mean_of}h"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(ID, "cutoff", DS, "y", "model", "yhat")


def align_forecasts(parts: Sequence[DataFrame]) -> DataFrame:
    """Long forecasts of several models as one wide frame: a union and a pivot in place of outer joins."""
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    return to_wide(long)


def to_wide(long: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    keys = [c for c in long.columns if c not in ("model", "yhat", "y")]
    grouped = long.groupBy(*keys)
    pivot = grouped.pivot("model", list(models)) if models else grouped.pivot("model")
    wide = pivot.agg(F.first("yhat", ignorenulls=True))
    truth = long.groupBy(*keys).agg(F.max("y").alias("y"))
    return truth.join(wide, keys)


def to_long(wide: DataFrame, models: Sequence[str]) -> DataFrame:
    keys = [c for c in wide.columns if c not in models]
    return wide.unpivot(keys, list(models), "model", "yhat")


def cv_info(cv: DataFrame) -> DataFrame:
    """One row a series: windows, models, horizon lengths, first and last cutoff, steps in hours, whether spacing varies."""
    per = cv.groupBy(ID, "cutoff").agg(F.count_distinct(DS).alias("h"))
    step = hours_between(F.lag("cutoff").over(Window.partitionBy(ID).orderBy("cutoff")), F.col("cutoff"))
    stepped = per.withColumn("step", step)
    models = cv.groupBy(ID).agg(F.concat_ws(",", F.array_sort(F.collect_set("model"))).alias("models"))
    info = stepped.groupBy(ID).agg(
        F.count("*").alias("n_windows"),
        F.min("h").alias("min_horizon"),
        F.max("h").alias("max_horizon"),
        F.min("cutoff").alias("first_cutoff"),
        F.max("cutoff").alias("last_cutoff"),
        F.min("step").alias("min_step"),
        F.max("step").alias("max_step"),
        (F.count_distinct("step") > 1).alias("unequal_spacing"),
    )
    return info.join(models, ID)


RULES = ("columns", "null_keys", "equal_horizon", "contiguous", "n_windows", "spacing", "last_cutoff", "finite", "positive")


def cv_sanity(cv: DataFrame, horizon: int, n_windows: int, step: int, end: Column) -> DataFrame:
    """One row per rule: whether it holds, and how many windows or rows break it. All windows of all series are checked."""
    needed = [ID, DS, "cutoff", "y", "model", "yhat"]
    require_columns(cv, *needed)
    per = cv.groupBy(ID, "model", "cutoff").agg(F.count("*").alias("n"), F.count_distinct(DS).alias("d"), F.min(DS).alias("lo"), F.max(DS).alias("hi"))
    gap = hours_between(F.lag("cutoff").over(Window.partitionBy(ID, "model").orderBy("cutoff")), F.col("cutoff"))
    per = per.withColumn("gap", gap)
    contiguous = (F.col("lo") == F.col("cutoff") + hours(1)) & (F.col("hi") == F.col("cutoff") + hours(F.col("n").cast("int"))) & (F.col("n") == F.col("d"))
    sums = per.agg(
        F.count_if(F.col("n") != horizon).alias("equal_horizon"),
        F.count_if(~contiguous).alias("contiguous"),
        F.count_if(F.col("gap") != step).alias("spacing"),
    )
    counts = per.groupBy(ID, "model").agg(F.count("*").alias("k"), F.max("cutoff").alias("last")).agg(F.count_if(F.col("k") != n_windows).alias("n_windows"), F.count_if(F.col("last") + hours(horizon) != end).alias("last_cutoff"))
    x = F.col("yhat")
    rows = cv.agg(
        F.lit(0).cast("bigint").alias("columns"),
        F.count_if(F.col(ID).isNull() | F.col(DS).isNull() | F.col("cutoff").isNull()).alias("null_keys"),
        F.count_if(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))).alias("finite"),
        F.count_if(x <= 0).alias("positive"),
    )
    wide = rows.crossJoin(sums).crossJoin(counts)  # one row each
    return wide.unpivot([], list(RULES), "rule", "broken").withColumn("ok", F.col("broken") == 0)


def subsample_cutoffs(cv: DataFrame, every: int = 7) -> DataFrame:
    """Keep each ``every``-th cutoff of a series, from the first on."""
    rank = F.dense_rank().over(Window.partitionBy(ID).orderBy("cutoff"))
    return cv.withColumn("__k", rank).where((F.col("__k") - 1) % every == 0).drop("__k")


def context_window(df: DataFrame, cv: DataFrame, before: int, after: int) -> DataFrame:
    """Truth around the forecasts of each series, with the forecasts beside it (null outside the horizons)."""
    span = cv.groupBy(ID).agg((F.min(DS) - hours(before)).alias("__a"), (F.max(DS) + hours(after)).alias("__b"))
    truth = df.join(span, ID).where(F.col(DS).between(F.col("__a"), F.col("__b"))).select(ID, DS, "y")
    return truth.join(cv.select(ID, DS, "cutoff", "model", "yhat"), [ID, DS], "left")


def resume_windows(plan: DataFrame, done: DataFrame, config_hash: str | None = None) -> DataFrame:
    """Planned windows that are still to run: ``done`` (unique_id, window) counts only as whole fit groups.

    With ``config_hash``, ``done`` also holds a column of that name, and windows of other parameters (or of none) do not count.
    """
    if config_hash is not None:
        done = done.where(F.col("config_hash") == config_hash)
    have = plan.join(done.select(ID, "window").distinct(), [ID, "window"], "left_semi").groupBy(ID, "fit_group").agg(F.count("*").alias("have"))
    want = plan.groupBy(ID, "fit_group").agg(F.count("*").alias("want"))
    finished = want.join(have, [ID, "fit_group"]).where("have = want").select(ID, "fit_group")
    return plan.join(finished, [ID, "fit_group"], "left_anti").select(*plan.columns)


def missing_timestamps(df: DataFrame, unit: str = "hour") -> DataFrame:
    """Timestamps that the grid of each series has and the series has not."""
    grid = df.groupBy(ID).agg(F.min(DS).alias("lo"), F.max(DS).alias("hi")).select(ID, F.explode(F.sequence("lo", "hi", F.expr(f"interval 1 {unit}"))).alias(DS))
    return grid.join(df, [ID, DS], "left_anti")


def latest_runs(paths: DataFrame, col: str = "path") -> DataFrame:
    """Newest run of each (model, id, horizon) from directory names ``<id>_<horizon>_test_<model>_<timestamp>``."""
    pattern = r"([A-Za-z0-9-]+)_(day|week)_test_([A-Za-z0-9]+)_([0-9]{8}T[0-9]{6})$"
    part = lambda k, n: F.regexp_extract(col, pattern, k).alias(n)
    runs = paths.select(F.col(col).alias("path"), part(1, ID), part(2, "horizon"), part(3, "model"), part(4, "stamp")).where("stamp != ''")
    w = Window.partitionBy("model", ID, "horizon").orderBy(F.desc("stamp"), "path")
    return runs.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
