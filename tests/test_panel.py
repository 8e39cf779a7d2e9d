"""Hand-made frames: nulls, ties, gaps, constant series, leap days, leaks."""

import datetime as dt
import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import backtest as T
from tidemill.operators import decompose as E
from tidemill.operators import draws as G
from tidemill.operators import explore as K
from tidemill.operators import features as C
from tidemill.operators import metrics as M
from tidemill.operators import models as H
from tidemill.operators import panel as B
from tidemill.operators import significance as J
from tidemill.operators import transforms as D
from tidemill.operators import trials as L
from tidemill.plans.queries import queries
from tidemill.sources import panel_io as P

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "unique_id string, ds timestamp_ntz, y double"


def panel(spark, *series):
    rows = [(i, T0 + dt.timedelta(hours=h), y) for i, points in series for h, y in points]
    return spark.createDataFrame(rows, SCHEMA)


def wave(spark, n=720, ids=("a", "b")):
    return panel(spark, *[(i, [(h, 50 + k + 10 * math.sin(h * math.pi / 12) + 0.01 * h + (h * 7 % 11) / 5) for h in range(n)]) for k, i in enumerate(ids)])


def values(df, col="y"):
    return [r[col] for r in df.orderBy("unique_id", "ds").collect()]


def test_fill_and_forward_fill_start_per_series(spark):
    df = panel(spark, ("a", [(0, None), (2, 1.0), (4, 3.0)]), ("b", [(3, 7.0)]))
    filled = B.fill_gaps(df)
    assert filled.count() == 6
    assert values(B.forward_fill(filled, ["y"])) == [None, None, 1.0, 1.0, 3.0, 7.0]


def test_clip_keeps_null(spark):
    assert values(B.clip_lower(panel(spark, ("a", [(0, None), (1, 2.0), (2, 9.0)])), "y", 5.0)) == [None, 5.0, 9.0]


def test_split_overlap_and_bad_dates(spark):
    df = panel(spark, ("a", [(h, float(h)) for h in range(48)]))
    parts = B.train_test_split(df, "2024-01-01 00:00:00", "2024-01-01 11:00:00", "2024-01-01 20:00:00", 3)
    assert {r["split"]: r["count"] for r in parts.groupBy("split").count().collect()} == {"train": 12, "test": 12}
    with pytest.raises(ValueError):
        B.train_test_split(df, "2024-01-02", "2024-01-01", "2024-01-03")


def test_scaler_of_constant_series_inverts(spark):
    df = panel(spark, ("a", [(h, 4.0) for h in range(5)]))
    for kind in ("zscore", "minmax"):
        stats = D.fit_scaler(df, ["y"], kind)
        back = D.apply_scaler(D.apply_scaler(df, stats, ["y"], kind, -1.0, 1.0), stats, ["y"], kind, -1.0, 1.0, inverse=True)
        assert np.allclose(values(back), 4.0)


def test_boxcox_of_zero_lambda_is_log(spark):
    df = panel(spark, ("a", [(0, 1.0), (1, math.e)]))
    lam = spark.createDataFrame([("a", 0.0)], "unique_id string, lambda double")
    assert np.allclose(values(D.transform_target(df, "boxcox", lam)), [0.0, 1.0])
    with pytest.raises(ValueError):
        D.transform_target(df, "cube")


def test_rolling_time_window_is_open_on_the_left(spark):
    df = panel(spark, ("a", [(0, 1.0), (1, 2.0), (5, 9.0)]))
    assert values(C.rolling_mean_time(df, ["y"], [4]), "y_avg4h") == [1.0, 1.5, 9.0]


def test_cold_weeks_need_three_in_a_row(spark):
    monday = [(h, 1.0) for h in range(4 * 168)]
    df = panel(spark, ("a", monday), ("b", [(h, 0.0 if h == 200 else 1.0) for h in range(4 * 168)])).withColumn("is_cold", F.col("y") > 0)
    kept = C.full_cold_weeks(df)
    assert {r["unique_id"]: r["count"] for r in kept.groupBy("unique_id").count().collect()} == {"a": 672}
    assert kept.where("weekday(ds) != weekday(grid_ds)").count() == 0


def test_add_annual_on_leap_day(spark):
    days = spark.createDataFrame([("a", dt.datetime(2023, 2, 28), 5.0)], "unique_id string, ds timestamp_ntz, seasonal double")
    df = spark.createDataFrame([("a", dt.datetime(2024, 2, 29, 13), 1.0)], SCHEMA)
    assert values(E.add_annual(df, days, ["y"])) == [6.0]


def test_decompositions_add_up(spark):
    df = wave(spark, 400)
    for parts, seasons in ((E.decompose_classical(df, 24), ["seasonal"]), (E.decompose_stl(df, 24), ["seasonal"]), (E.decompose_mstl(df), ["seasonal_24", "seasonal_168"])):
        total = sum((F.col(s) for s in seasons), F.col("trend") + F.col("remainder"))
        assert parts.count() == 800
        assert parts.where(F.abs(total - F.col("y")) > 1e-9).count() == 0


def test_stl_recovers_a_season():
    n = np.arange(480)
    y = 20 + 0.02 * n + 5 * np.sin(2 * np.pi * n / 24)
    trend, season = E.stl(y, 24, 11)
    assert np.abs(season[48:-48] - 5 * np.sin(2 * np.pi * n / 24)[48:-48]).max() < 0.3
    assert np.abs(trend[48:-48] - (20 + 0.02 * n)[48:-48]).max() < 0.3


def test_seasonal_naive_repeats_beyond_a_season(spark):
    df = panel(spark, ("a", [(h, float(h)) for h in range(72)]))
    out = T.naive_backtest(df, B.timestamp("2024-01-01 23:00:00"), 1, 24, 48, seasons=[24], mean_of=None)
    assert [r["yhat"] for r in out.orderBy("ds").collect()] == [float(h % 24) for h in range(48)]


def test_no_model_sees_past_its_cutoff(spark):
    df = wave(spark)
    plan = T.cv_plan(df, 24, n_windows=2, test_hours=48)
    first = plan.agg(F.min("cutoff")).first()[0]
    other = df.withColumn("y", F.when(F.col("ds") > F.lit(first).cast("timestamp_ntz"), F.col("y") * 3 + 7).otherwise(F.col("y")))
    one = plan.where(F.col("window") == 0)
    for model in (lambda d: H.ets_trend(H.contexts(d, one, 300), 24), lambda d: H.dynamic_regression(d, one, 24), lambda d: H.mstl_forecast(d, one, 24, length=360)):
        a, b = ([(r["unique_id"], r["step"], round(r["yhat"], 6)) for r in model(d).orderBy("unique_id", "step").collect()] for d in (df, other))
        assert a == b and len(a) == 48


@pytest.mark.parametrize("horizon", [24, 72])
def test_direct_model_sees_nothing_past_its_cutoff(spark, horizon):
    df = wave(spark)
    last = df.agg(F.max("ds")).first()[0]
    first = F.lit(last - dt.timedelta(hours=horizon)).cast("timestamp_ntz")
    other = df.withColumn("y", F.when(F.col("ds") > first, F.col("y") * 3 + 7).otherwise(F.col("y")))
    a, b = ([(r["unique_id"], r["ds"], round(r["yhat"], 6)) for r in H.direct_multihorizon(d, first, 1, horizon).orderBy("unique_id", "ds").collect()] for d in (df, other))
    assert a == b and len(a) == 2 * horizon


def test_contexts_keep_their_series_and_their_hours(spark):
    """Each series has its own cutoffs; a null or a missing hour leaves a context out."""
    df = panel(spark, ("a", [(h, float(h)) for h in range(48)]), ("b", [(h, float(h)) for h in range(72)]), ("c", [(h, None if h == 40 else 1.0) for h in range(48)]), ("d", [(h, 1.0) for h in range(48) if h != 41]))
    at = lambda h: T0 + dt.timedelta(hours=h)
    cutoffs = spark.createDataFrame([("a", at(47)), ("b", at(71)), ("b", at(60)), ("c", at(47)), ("c", at(39)), ("d", at(47)), ("a", at(60))], "unique_id string, cutoff timestamp_ntz")
    got = {(r["unique_id"], r["cutoff"]): r["context"] for r in H.contexts(df, cutoffs, 24).collect()}
    assert set(got) == {("a", at(47)), ("b", at(71)), ("b", at(60)), ("c", at(39))}
    assert got["b", at(60)] == [float(h) for h in range(37, 61)] and len(H.contexts(df, cutoffs, 100).where("unique_id = 'a'").first()["context"]) == 48


def test_orders_are_compared_on_the_same_rows(spark):
    df = wave(spark)
    plan = T.cv_plan(df, 24, n_windows=1, test_hours=24)
    rows = H.order_search(df, plan, [[1], [1, 24], [1, 24, 25, 168]], 400).collect()
    assert len({(r["unique_id"], r["n"]) for r in rows}) == 2 and sorted(r["rank"] for r in rows) == [1, 1, 2, 2, 3, 3]
    by = {r["lags"]: r["sse"] for r in rows if r["unique_id"] == "a"}
    assert by["1"] >= by["1,24"] >= by["1,24,25,168"] - 1e-6


def test_bands_and_shared_fits(spark):
    """Bands hold the forecast and widen; windows of one fit group share the first window's coefficients."""
    df = wave(spark).withColumn("x", F.hour("ds") / 24.0)
    plan = T.cv_plan(df, 24, n_windows=4, test_hours=96, max_fits=1)
    rows = H.dynamic_regression(df, plan, 24, exog=["x"], z=1.96).collect()
    assert len(rows) == 2 * 4 * 24 and all(r["yhat_lo"] <= r["yhat"] <= r["yhat_hi"] for r in rows)
    width = {(r["unique_id"], r["step"]): round(r["yhat_hi"] - r["yhat_lo"], 9) for r in rows}
    assert all(round(r["yhat_hi"] - r["yhat_lo"], 9) == width[r["unique_id"], r["step"]] for r in rows)
    assert all(width[i, h] <= width[i, h + 1] + 1e-9 for i in "ab" for h in range(1, 24))


def test_smoothing_forward_keeps_parameters(spark):
    df = wave(spark)
    plan = T.cv_plan(df, 24, n_windows=3, test_hours=72)
    one = H.contexts(df, plan.where("window = 0"), 200)
    fit = H.ets_fit(one)
    same = {r["unique_id"]: r for r in H.ets_forward(one, fit).collect()}
    for r in fit.collect():
        assert abs(same[r["unique_id"]]["level"] - r["level"]) < 1e-9 and abs(same[r["unique_id"]]["levels"][-1] - r["level"]) < 1e-9
        assert len(same[r["unique_id"]]["levels"]) == 200
    assert H.ets_forward(H.contexts(df, plan, 200), fit).count() == 6


def test_mstl_on_a_scale_comes_back(spark):
    df = wave(spark)
    plan = T.cv_plan(df, 24, n_windows=1, test_hours=24)
    days = df.groupBy("unique_id", F.date_trunc("day", "ds").cast("timestamp_ntz").alias("ds")).agg(F.lit(0.25).alias("seasonal"))
    year = days.unionByName(days.withColumn("ds", F.add_months("ds", -12).cast("timestamp_ntz"))).distinct()
    truth = H.with_truth(H.mstl_on_scale(df, plan, 24, "arcsinh10", season=year, length=360), df)
    assert truth.count() == 48 and M.evaluate_cv(truth, metrics=["mae"]).agg(F.max("value")).first()[0] < 2.0


def test_nothing_is_dropped_in_silence(spark):
    df = panel(spark, ("a", [(0, 1.0), (1, 2.0)]), ("b", [(0, 1.0), (2, 2.0)]))
    lam = spark.createDataFrame([("a", 0.5)], "unique_id string, lambda double")
    with pytest.raises(Exception, match="no lambda for series b"):
        D.transform_target(df, "boxcox", lam).collect()
    with pytest.raises(Exception, match="no statistics for series b"):
        D.apply_scaler(df, D.fit_scaler(df.where("unique_id = 'a'"), ["y"]), ["y"]).collect()
    off = df.unionByName(spark.createDataFrame([("a", T0 + dt.timedelta(minutes=30), 3.0)], SCHEMA))
    with pytest.raises(Exception, match="off the grid"):
        B.fill_gaps(off).collect()
    assert B.fill_gaps(df).count() == 5


def test_threshold_errors(spark):
    rows = [("a", T0, T0, y, "m", f) for y, f in ((1.0, 9.0), (5.0, 7.0), (6.0, 3.0), (7.0, 7.0))]
    cv = spark.createDataFrame(rows, "unique_id string, cutoff timestamp_ntz, ds timestamp_ntz, y double, model string, yhat double")
    for th, want in ((4.0, (2.0, 3.0, 5 / 3)), (99.0, (0.0, 0.0, 0.0))):
        r = M.threshold_errors(cv, spark.createDataFrame([("a", th)], "unique_id string, y_th double")).first()
        assert np.allclose((r["over"], r["under"], r["mae"]), want)


def test_models_beat_the_mean(spark):
    df = wave(spark)
    plan = T.cv_plan(df, 24, n_windows=2, test_hours=48)
    truth = H.with_truth(H.dynamic_regression(df, plan, 24), df)
    assert M.evaluate_cv(truth, metrics=["mae"]).agg(F.max("value")).first()[0] < 2.0


def test_plan_arguments(spark):
    df = wave(spark, 400)
    with pytest.raises(ValueError):
        T.cv_plan(df)
    with pytest.raises(ValueError):
        T.cv_plan(df, 24, n_windows=3, step=24)
    with pytest.raises(ValueError):
        T.cv_plan(df, 200, n_windows=3, test_hours=100)


def test_samples_refuse_gaps(spark):
    df = panel(spark, ("a", [(0, 1.0), (1, None), (2, 3.0), (3, 4.0)]))
    with pytest.raises(Exception, match="non-finite"):
        T.sliding_samples(df, ["y"], [], 2, 1).collect()


def test_wins_share_ties_and_skip_missing_models(spark):
    rows = [("a", "mae", 1, "x", 2.0), ("a", "mae", 1, "y", 2.0), ("a", "mae", 1, "z", 3.0), ("a", "mae", 2, "x", None), ("a", "mae", 2, "y", 1.0)]
    s = spark.createDataFrame(rows, "unique_id string, metric string, cutoff int, model string, value double")
    assert {(r["cutoff"], r["model"]): r["credit"] for r in M.wins(s).collect()} == {(1, "x"): 0.5, (1, "y"): 0.5, (1, "z"): 0.0, (2, "x"): 0.0, (2, "y"): 1.0}


def test_metrics_guard_zero(spark):
    cv = spark.createDataFrame([("a", T0, T0, 0.0, "m", 0.0)], "unique_id string, cutoff timestamp_ntz, ds timestamp_ntz, y double, model string, yhat double")
    got = {r["metric"]: r["value"] for r in M.evaluate_cv(cv, metrics=["smape", "mape", "mae"]).collect()}
    assert got == {"smape": 0.0, "mape": None, "mae": 0.0}
    with pytest.raises(ValueError):
        M.evaluate_cv(cv, metrics=["wape"])


def test_holm_is_monotone(spark):
    p = spark.createDataFrame([("a", "m", 0.01), ("b", "m", 0.04), ("c", "m", 0.03), ("d", "m", 0.9)], "unique_id string, model string, p double")
    got = {r["unique_id"]: round(r["p_holm"], 6) for r in J.holm_adjust(p.withColumn("metric", F.lit("mae")), ["metric"]).collect()}
    assert got == {"a": 0.04, "c": 0.09, "b": 0.09, "d": 0.9}


def test_bins_cover_every_row_once(spark):
    rows = [(i, "COMPLETE", float(i % 7), i % 5) for i in range(60)]
    t = spark.createDataFrame(rows, "number int, state string, value double, x int")
    for how in ("quantile", "uniform", "unique"):
        b = L.bin_param(t, "x", 3, how)
        assert b.count() == 60 and b.where("bin is null").count() == 0
    one = L.bin_param(t.withColumn("x", F.lit(1)), "x", 3)
    assert [r["label"] for r in one.select("label").distinct().collect()] == ["all"]
    assert L.marginal_1d(L.bin_param(t, "x", 3)).agg(F.sum("count")).first()[0] == 60


def test_resume_counts_whole_fit_groups(spark):
    df = wave(spark, 400, ("a",))
    plan = T.cv_plan(df, 24, n_windows=4, test_hours=96, max_fits=2)
    done = plan.where(F.col("window").isin(0, 1, 2))
    assert sorted(r["window"] for r in T.resume_windows(plan, done).collect()) == [2, 3]


def test_acf_of_short_series_equals_sums(spark):
    series = {"a": [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0], "b": [2.0, 7.0], "c": [1.0]}
    df = panel(spark, *[(i, list(enumerate(v))) for i, v in series.items()])
    found = {(r["unique_id"], r["lag"]): r["acf"] for r in J.acf(df, ["unique_id"], ["ds"], "y", 4).collect()}
    expected = {}
    for i, v in series.items():
        d = np.array(v) - np.mean(v)
        for k in range(min(5, len(v))):
            expected[i, k] = float(d[: len(d) - k] @ d[k:] / (d @ d)) if d @ d else None
    assert found.keys() == expected.keys()
    assert all(found[k] is None if v is None else abs(found[k] - v) < 1e-12 for k, v in expected.items())


def test_kde_equals_sum_over_bins(spark):
    y = np.random.default_rng(5).normal(size=200)
    df = panel(spark, ("a", [(h, float(v)) for h, v in enumerate(y)]), ("flat", [(0, 1.0), (1, 1.0)]))
    rows = J.kde(df, "y", 20, 50, ["unique_id"]).orderBy("k").collect()
    assert {r["unique_id"] for r in rows} == {"a"} and len(rows) == 20  # a constant series has no density
    step, h = (y.max() - y.min()) / 50, y.std(ddof=1) * 200**-0.2
    centres = y.min() + (np.minimum((y - y.min()) // step, 49) + 0.5) * step
    for r in rows:
        assert abs(r["density"] - np.exp(-0.5 * ((r["x"] - centres) / h) ** 2).sum() / (200 * h * math.sqrt(2 * math.pi))) < 1e-9


def test_kendall_equals_all_pairs(spark):
    g = np.random.default_rng(6)
    x, y = g.integers(0, 6, 60).astype(float), g.integers(0, 9, 60).astype(float)
    rows = [("a", float(p), float(q)) for p, q in zip(x, y)] + [("a", None, 1.0), ("one", 1.0, 2.0), ("flat", 1.0, 2.0), ("flat", 1.0, 3.0)]
    found = {r["unique_id"]: r["value"] for r in K.corr_matrix(spark.createDataFrame(rows, "unique_id string, x double, y double"), ["x", "y"], "kendall").collect()}
    sx, sy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    assert found.keys() == {"a", "flat"} and found["flat"] is None
    assert abs(found["a"] - (sx * sy).sum() / math.sqrt(np.abs(sx).sum() * np.abs(sy).sum())) < 1e-12


def test_robust_loess_equals_local_lines(spark):
    g = np.random.default_rng(7)
    v = np.sin(np.arange(90) / 9) + 0.1 * g.normal(size=90)
    v[40] = 30.0
    parts = panel(spark, ("a", [(h, float(x)) for h, x in enumerate(v)])).selectExpr("unique_id", "ds", "y", "0D AS trend", "y AS seasonal", "0D AS remainder")
    found = values(E.smooth_seasonal_loess(parts, 21), "seasonal")
    assert np.allclose(found, K._lowess(np.arange(90.0), v, 21 / 90), atol=1e-6)
    plain = values(E.smooth_seasonal_loess(parts, 21, 0), "seasonal")
    assert abs(plain[40]) > 1.5 > abs(found[40])  # the outlier no longer bends the line


def test_bootstrap_takes_a_length_of_each_group(spark):
    rows = [(i, "mae", "m", h, float((h * 7 + k) % 5)) for k, i in enumerate("ab") for h in range(11)]
    diffs = spark.createDataFrame(rows, "unique_id string, metric string, model string, cutoff int, value double")
    one = sorted(J.block_bootstrap_mean(diffs, 50, 4).collect())
    table = diffs.select("unique_id", "metric", "model").distinct().withColumn("block", F.lit(4))
    assert sorted(J.block_bootstrap_mean(diffs, 50, table).collect()) == one
    assert J.block_bootstrap_mean(diffs, 20, J.optimal_block_length(diffs)).count() == 2
    with pytest.raises(Exception, match="no block length"):
        J.block_bootstrap_mean(diffs, 20, table.where("unique_id = 'a'")).collect()


def test_summary_has_seconds_per_fit(spark):
    summary = spark.createDataFrame([("a", "mae", "m", 1.0), ("b", "mae", "m", 2.0), ("a", "mae", "n", 3.0)], "unique_id string, metric string, model string, mean double")
    summary = summary.selectExpr("*", "mean AS median", "0D AS std", "0D AS wrate")
    runs = spark.createDataFrame([("a", "m", 4.0), ("b", "m", 8.0)], "unique_id string, model string, avg_el_per_fit double")
    found = {(r["unique_id"], r["model"]): r["avg_el_per_fit"] for r in M.summary_table(summary, ["mae"], runs=runs).collect()}
    assert found == {("a", "m"): 4.0, ("b", "m"): 8.0, ("a", "n"): None, ("Average", "m"): 6.0, ("Average", "n"): None}


def test_resuming_compares_parameters(spark):
    plan = spark.createDataFrame([("a", w, w // 2) for w in range(4)], "unique_id string, window int, fit_group int")
    new, old = P.config_hash({"lags": [1, 24], "k": 2}), P.config_hash({"k": 3})
    assert new == P.config_hash({"k": 2, "lags": [1, 24]})
    done = spark.createDataFrame([("a", 0, new), ("a", 1, new), ("a", 2, old), ("a", 3, None)], "unique_id string, window int, config_hash string")
    assert sorted(r["window"] for r in T.resume_windows(plan, done, new).collect()) == [2, 3]
    cv = spark.createDataFrame([("a", "m", 1, 2)], "unique_id string, model string, cutoff int, ds int")
    record = P.run_metadata(cv, 1, 2.5, {"k": 3}, "cpu").collect()[0]
    assert (record["config"], record["config_hash"], record["device"], record["for_cv"]) == ('{"k": 3}', old, "cpu", True)


def test_labels_are_bins_of_their_own(spark):
    df = spark.createDataFrame([("x", 1), (None, 2), ("b", 3), ("x", 4)], "p string, number int")
    assert {r["number"]: (r["bin"], r["label"]) for r in L.bin_param(df, "p").collect()} == {2: (0, None), 3: (1, "b"), 1: (2, "x"), 4: (2, "x")}


def test_few_numbers_are_categories_and_empty_bins_stay(spark):
    few = spark.createDataFrame([(i, (i % 3) * 10) for i in range(9)] + [(9, None)], "number int, p int")
    assert {(r["p"], r["bin"], r["label"]) for r in L.bin_param(few, "p").collect()} == {(0, 0, "0.0"), (10, 1, "10.0"), (20, 2, "20.0"), (None, None, None)}
    gap = spark.createDataFrame([(i, float(i), x) for i, x in enumerate([0, 1, 2, 3, 4, 97, 98, 99, 100])], "number int, value double, p int")
    binned, every = L.bin_param(gap, "p", 3, "uniform"), L.bin_list(gap, "p", 3, "uniform")
    found = {r["bin"]: r for r in L.marginal_1d(binned, top_k=2, all_bins=every).collect()}
    assert {b: (r["count"], r["contribution"]) for b, r in found.items()} == {0: (5, 1.0), 1: (0, 0.0), 2: (4, 0.0)}
    assert (found[1]["mean"], found[1]["share"]) == (None, None) and found[1]["label"].startswith("(33.3")


def test_running_best_over_blocks(spark):
    rows = [(i, "COMPLETE" if i % 4 else "FAIL", None if i % 7 == 0 else float((i * 37) % 101)) for i in range(200)]
    df = spark.createDataFrame(rows, "number int, state string, value double").repartition(7)
    found, best, expected = {r["number"]: r["best"] for r in L.best_so_far(df, block=16).collect()}, None, {}
    for i, state, v in rows:
        if state == "COMPLETE":
            best = v if best is None else best if v is None else min(best, v)
            expected[i] = best
    assert found == expected


def test_region_bootstrap_broadcasts_no_draws(spark, capsys):
    rows = [(i * 3 - 700, float((i * 37) % 101) if i % 11 else None, i % 5) for i in range(1000)]
    df = spark.createDataFrame(rows, "number int, value double, p int").repartition(7)
    sides = {s: [v for _, v, p in rows if v is not None and (p == 1) == (s == 1)] for s in (0, 1)}

    def mean(side, b):
        values = sides[side]
        names = [f"region:{side}:{b}:{k}" for k in range(len(values))]
        return sum(values[int(hashlib.md5(name.encode()).hexdigest()[:8], 16) % len(values)] for name in names) / len(values)

    inside, outside = ([mean(s, b) for b in range(100)] for s in (1, 0))
    point = [sum(sides[s]) / len(sides[s]) for s in (1, 0)]
    expected = [point[0], *np.quantile(inside, [0.025, 0.975]), point[0] - point[1], *np.quantile(np.subtract(inside, outside), [0.025, 0.975])]
    found = L.region_bootstrap(df, F.col("p") == 1, n_boot=100)
    assert list(found.collect()[0]) == pytest.approx(expected)
    found.explain()
    plan = capsys.readouterr().out.split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in plan and re.search(r"ShuffledHashJoin \[side#\d+, i#\d+L\]", plan)
    assert list(L.region_bootstrap(df, F.col("p") == 1, n_boot=100, block=16).collect()[0]) == pytest.approx(expected)


def _hashed(name):
    return int(hashlib.md5(name.encode()).hexdigest()[:8], 16)


def test_draws_hash_the_names_of_replicate_and_draw():
    values = np.random.default_rng(5).normal(50, 9, 1234)
    for prefix in ("region:1", "", *("x" * n for n in range(36, 58)), "\u00e9" * 80):  # names of one, two and three blocks of MD5
        expected = [sum(values[_hashed(f"{prefix}:{b}:{k}") % 1234] for k in range(1234)) for b in range(98, 102)]
        assert G.drawn_sums(prefix, range(98, 102), 1234, values) == pytest.approx(expected)
    parts = [G.drawn_sums(prefix, range(98, 102), 1234, values[i : i + 500], i) for i in (0, 500, 1000)]
    assert sum(parts) == pytest.approx(expected)


def test_region_bootstrap_adds_up_segments(spark, monkeypatch):
    df = spark.createDataFrame([(i, float((i * 37) % 101), i % 5) for i in range(1000)], "number int, value double, p int").repartition(7)
    whole = list(L.region_bootstrap(df, F.col("p") == 1, n_boot=70).collect()[0])
    for name, size in (("CHUNK", 16), ("SEGMENT", 144), ("REPLICATES", 40)):
        monkeypatch.setattr(L, name, size)
    assert list(L.region_bootstrap(df, F.col("p") == 1, n_boot=70).collect()[0]) == pytest.approx(whole)
    assert list(L.region_bootstrap(df, F.col("p") < 9, n_boot=70).collect()[0])[3:] == [None] * 3  # nothing outside


def test_region_bootstrap_query_draws_the_reference_s_replicates(spark, tmp_path):
    rows = [(i, 900.0 + (i * 37) % 101 + i / 7, i % 25 + 1, f"Brand#{i % 3}", "PROMO") for i in range(30)]
    spark.createDataFrame(rows, "p_partkey bigint, p_retailprice double, p_size int, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    sides = {s: [v for _, v, size, _, _ in rows if (size <= 10) == (s == 1)] for s in (0, 1)}
    means = {s: [sum(vs[_hashed(f"region:{s}:{b}:{k}") % len(vs)] for k in range(len(vs))) / len(vs) for b in range(10_000)] for s, vs in sides.items()}
    point = [sum(sides[s]) / len(sides[s]) for s in (1, 0)]
    expected = [point[0], *np.quantile(means[1], [0.025, 0.975]), point[0] - point[1], *np.quantile(np.subtract(means[1], means[0]), [0.025, 0.975])]
    assert list(queries()["region_bootstrap"](spark, str(tmp_path)).collect()[0]) == pytest.approx(expected, abs=6e-5)


def test_boxcox_scan_takes_the_likeliest(spark):
    rng = np.random.default_rng(3)
    ys = {"a": np.exp(rng.normal(2, 0.5, 300)), "b": rng.normal(50, 3, 300), "c": rng.normal(5, 0.3, 300) ** 2, "e": np.full(5, 3.0)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in ys.items() for v in [*vs, -1.0]], "unique_id string, y double")
    found = {r["unique_id"]: r["lambda"] for r in D.boxcox_lambda_loglik(df, step=0.001).collect()}

    def ll(y, lam):
        z = np.log(y) if lam == 0 else (y**lam - 1) / lam
        return -len(y) / 2 * np.log(z.var()) + (lam - 1) * np.log(y).sum()

    assert set(found) == set(ys)  # a constant series has a parameter, too
    for k in "abc":
        coarse = max((i * 0.1 for i in range(-10, 21)), key=lambda x: ll(ys[k], x))
        near = [(round(coarse / 0.001) + j) * 0.001 for j in range(-100, 101)]
        assert ll(ys[k], found[k]) >= max(ll(ys[k], x) for x in near) - 1e-5
