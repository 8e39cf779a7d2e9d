"""Running sums, seasonal regressions with moving averages, order search, intervals and stored backtests."""

import datetime
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import arima, decompose, rolling
from tidemill.operators import backtest as T
from tidemill.operators import models as H
from tidemill.operators.window_sums import window_sums

BEGIN = datetime.datetime(2024, 1, 1)


def at(h):
    return BEGIN + datetime.timedelta(hours=int(h))


def hourly(spark, **series):
    rows = [(i, at(h), float(v)) for i, ys in series.items() for h, v in enumerate(ys)]
    return spark.createDataFrame(rows, "unique_id string, ds timestamp_ntz, y double")


def cutoffs(spark, rows):
    return spark.createDataFrame([(i, at(h)) for i, h in rows], "unique_id string, cutoff timestamp_ntz")


def simulated(n, seed, phi, big_phi, big_theta, sd=1.0):
    """(1, 0, 0)(1, 1, 1) of season 24."""
    rng = np.random.default_rng(seed)
    e, w, y = rng.normal(0, sd, n + 500), np.zeros(n + 500), np.zeros(n + 500)
    for t in range(60, n + 500):
        w[t] = phi * w[t - 1] + big_phi * w[t - 24] - phi * big_phi * w[t - 25] + e[t] + big_theta * e[t - 24]
        y[t] = w[t] + y[t - 24]
    return y[500:] + 50


@pytest.fixture(scope="module")
def long_panel(spark):
    df = hourly(spark, a=simulated(4000, 1, 0.6, -0.4, -0.5), b=100 + 5 * simulated(4000, 2, 0.2, 0.5, 0.4)).repartition(4)
    return df.cache()


def test_window_sums_by_brute_force(spark):
    """Windows that begin before the data, end after it, lie in one day, in gaps, or at odd hours."""
    rng = np.random.default_rng(3)
    rows = [(i, h, float(v)) for i in "ab" for h, v in zip(sorted(rng.choice(400, 150, False)), rng.normal(size=150), strict=True) if not (i == "a" and 120 < h < 220)]
    df = spark.createDataFrame([(i, at(h), v) for i, h, v in rows], "unique_id string, ds timestamp_ntz, y double")
    ends = [(i, h) for i in "abc" for h in (-50, 0, 5, 23, 24, 130, 199, 250, 399, 400, 700)]
    for length in (1, 7, 24, 100, 5000):
        got = {(r["unique_id"], r["cutoff"]): (r["s"], r["q"]) for r in window_sums(df, {"s": F.col("y"), "q": F.col("y") * F.col("y")}, cutoffs(spark, ends), length).collect()}
        want = {}
        for i, h in ends:
            some = [v for j, t, v in rows if j == i and h - length < t <= h]
            if some:
                want[i, at(h)] = (sum(some), sum(v * v for v in some))
        assert got.keys() == want.keys() and want
        assert all(abs(x - y) < 1e-9 for k in want for x, y in zip(got[k], want[k], strict=True))
    assert window_sums(df.limit(0), {"s": F.col("y")}, cutoffs(spark, ends), 9).count() == 0


def test_normal_equations_are_slices(spark, long_panel):
    """Sums equal those over the rows of each slice, and slices of any length shuffle alike."""
    plan = T.cv_plan(long_panel, 24, n_windows=5, test_hours=120)
    rows, names = H.regression_rows(long_panel, (1, 24))
    local = {(r["unique_id"], r["ds"]): np.array([r[n] for n in names] + [r["y"]], float) for r in rows.dropna().collect()}
    for r in H.normal_equations(rows, names, plan, 500).collect():
        x = np.array([v for (i, t), v in local.items() if i == r["unique_id"] and r["cutoff"] - datetime.timedelta(hours=500) < t <= r["cutoff"]])
        xtx = (x[:, :-1].T @ x[:, :-1])[np.triu_indices(len(names))]
        assert r["n"] == len(x) == 500
        assert np.allclose(r["xtx"], xtx, rtol=1e-9, atol=1e-6) and np.allclose(r["xty"], x[:, :-1].T @ x[:, -1], rtol=1e-9, atol=1e-6) and math.isclose(r["yty"], x[:, -1] @ x[:, -1])


def test_lags_multiply_out():
    assert arima.Order(1, 0, 1, 1).ar == [1, 24, 25] and arima.Order(1, 0, 1, 1).ma == [24]
    assert arima.lags_of(2, 1, 24) == [1, 2, 24, 25, 26] and arima.lags_of(0, 0, 24) == []


def test_known_coefficients_are_found(spark, long_panel):
    """(1, 0, 0)(1, 1, 1) of season 24: the lags' coefficients are phi, Phi, -phi Phi and Theta."""
    model = arima.Sarima(input_size=3600)
    fit = {r["unique_id"]: r for r in model.fit(long_panel, cutoffs(spark, [("a", 3900), ("b", 3900)])).collect()}
    for name, phi, seasonal, theta, variance in (("a", 0.6, -0.4, -0.5, 1), ("b", 0.2, 0.5, 0.4, 25)):
        found = fit[name]["beta"]
        assert np.allclose(found[1:], [phi, seasonal, -phi * seasonal, theta], atol=0.09), (name, found)
        assert abs(fit[name]["sigma2"] / variance - 1) < 0.1


def test_sarima_sees_nothing_behind_the_cutoff(spark, long_panel):
    plan = T.cv_plan(long_panel, 24, n_windows=3, test_hours=72, max_fits=1)
    model = arima.Sarima(input_size=1000)
    first = plan.where("window = 0").agg(F.min("cutoff")).first()[0]
    spoilt = long_panel.withColumn("y", F.when(F.col("ds") > F.lit(first), F.lit(1e6)).otherwise(F.col("y")))
    one, other = ({(r["unique_id"], r["step"]): r["yhat"] for r in arima.sarima(df, plan, 24, model).where(F.col("cutoff") == F.lit(first)).collect()} for df in (long_panel, spoilt))
    assert one == other and len(one) == 48


def test_sarima_forecasts_by_hand(spark, long_panel):
    """The recursion against a plain loop, with a covariate that is differenced and weekly harmonics; bands cover."""
    df = long_panel.withColumn("x", (F.hour("ds") * F.dayofweek("ds")) % 7 / 1.0)
    plan = T.cv_plan(df, 24, n_windows=10, test_hours=240, max_fits=1)
    plain = arima.sarima(long_panel, plan, 24, arima.Sarima(input_size=2000), levels=[80, 95])
    rows = H.with_truth(plain, long_panel).count(), plain.join(long_panel.withColumnRenamed("ds", "t"), "unique_id").where("t = cutoff + make_dt_interval(0, step, 0, 0)").collect()
    assert rows[0] == len(rows[1]) == 480
    inside = {level: np.mean([r[f"lo-{level}"] <= r["y"] <= r[f"hi-{level}"] for r in rows[1]]) for level in (80, 95)}
    assert 0.7 < inside[80] < 0.9 < inside[95] < 0.99
    model = arima.Sarima(arima.Order(2, 1, 1, 1), ("x",), 1, 2000)
    fits = plan.where("window = 0").select("unique_id", "cutoff")
    fit = {r["unique_id"]: r for r in model.fit(df, fits).collect()}
    regressors, names = model.rows(df, fits)
    known = {(r["unique_id"], r["ds"]): r.asDict() for r in regressors.collect()}
    ys = {(r["unique_id"], r["ds"]): r["y"] for r in df.collect()}
    got = model.forecast(df, plan, model.fit(df, fits).drop("cutoff"), 24).collect()
    assert len(got) == 480
    for i in "ab":
        cutoff = max(r["cutoff"] for r in got)
        beta, y, w, e = dict(zip(names, fit[i]["beta"], strict=True)), {}, {}, {}
        for h in range(-80, 1):
            t = cutoff + datetime.timedelta(hours=h)
            y[h], w[h], e[h] = ys[i, t], known[i, t]["y"], known[i, t]["e"]
        for h in range(1, 25):
            x = known[i, cutoff + datetime.timedelta(hours=h)]
            w[h] = sum(b * (w[h - int(n[4:])] if n.startswith("x_ar") else e[h - int(n[4:])] if n.startswith("x_ma") else x[n]) for n, b in beta.items())
            e[h], y[h] = 0.0, w[h] + y[h - 24]
        assert np.allclose([r["yhat"] for r in sorted(got, key=lambda r: r["step"]) if r["unique_id"] == i and r["cutoff"] == cutoff], [y[h] for h in range(1, 25)])


def test_sarima_on_a_scale(spark, long_panel):
    lam = spark.createDataFrame([("a", 0.0), ("b", 0.5)], "unique_id string, lambda double")
    df = long_panel.withColumn("y", F.exp(F.col("y") / 100))
    plan = T.cv_plan(df, 24, n_windows=1, test_hours=24)
    rows = arima.sarima(df, plan, 24, arima.Sarima(input_size=1000), [90], "boxcox", lam).collect()
    assert len(rows) == 48 and all(0 < r["lo-90"] < r["yhat"] < r["hi-90"] for r in rows)


def test_stepwise_search_ends_in_a_local_optimum(spark, long_panel):
    """No neighbour of the best order is better among all orders, each is fitted once, and the current order is compared."""
    most, plan = arima.Order(2, 1, 1, 1), T.cv_plan(long_panel, 24, n_windows=1, test_hours=24)
    found = arima.stepwise_orders(long_panel, plan, most, 3000, current=arima.Order(0, 1, 1, 0)).cache()
    visited = {(r["unique_id"], *(r[c] for c in arima.ORDER)): r for r in found.collect()}
    assert len(visited) == found.count()
    every = [(p, q, s, u) for p in range(3) for q in range(2) for s in range(2) for u in range(2)]
    sums, names = arima.order_sums(long_panel, plan, most, 3000)
    orders = sums.select("unique_id", "cutoff").withColumn("o", F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(o, arima.ORDER, strict=True)]) for o in every]))).select("unique_id", "cutoff", "o.*")
    aicc = {(r["unique_id"], *(r[c] for c in arima.ORDER)): r["aicc"] for r in arima.order_criteria(sums, names, orders, 24).collect()}
    assert len(aicc) == 2 * len(every) and all(math.isclose(aicc[k], r["aicc"], rel_tol=1e-9) for k, r in visited.items())
    for i in "ab":
        best = [k for k, r in visited.items() if r["best"] and k[0] == i]
        assert len(best) == 1
        near = [(i, *(x + sign * d for x, d in zip(best[0][1:], step, strict=True))) for step in arima.STEPS for sign in (1, -1)]
        assert aicc[best[0]] <= min(aicc[k] for k in near if k in aicc) and aicc[best[0]] == min(r["aicc"] for k, r in visited.items() if k[0] == i and r["round"] is not None)
        assert aicc[best[0]] <= min(aicc[i, 1, 0, 1, 1], aicc[i, 0, 0, 0, 0])
    table = {(r["unique_id"], r["criterion"]): r for r in arima.order_comparison(found).collect()}
    assert len(table) == 8 and all(table[i, "aicc"]["best"] <= table[i, "aicc"]["current"] and table[i, "loglik"]["best"] >= table[i, "loglik"]["current"] for i in "ab")


def test_smoothing_intervals(spark):
    """Variances by simulation of the state; 80 % intervals of series that follow the model hold four in five values."""
    rng = np.random.default_rng(5)
    fit = spark.createDataFrame([("a", 0.3, 0.2, 0.9, 4.0), ("b", 0.5, None, 1.0, 1.0), ("c", 0.4, 0.1, 1.0, 2.0)], "unique_id string, alpha double, beta double, phi double, sigma2 double")
    rows = fit.withColumn("h", F.explode(F.array(F.lit(1), F.lit(2), F.lit(12)))).select("*", H.ets_variance(F.col("h")).alias("v")).collect()
    for r in rows:
        level, trend = np.zeros(200_000), np.zeros(200_000)
        for _ in range(r["h"]):
            e = rng.normal(0, math.sqrt(r["sigma2"]), 200_000)
            guess = level + r["phi"] * trend
            level, trend = guess + r["alpha"] * e, r["phi"] * trend + r["alpha"] * (r["beta"] or 0) * e
        assert abs(np.var(guess + e) / r["v"] - 1) < 0.02, r
    walk = {}
    for k in range(60):
        e = rng.normal(0, 1, 300)
        walk[f"s{k}"] = e + np.concatenate([[0], 0.5 * np.cumsum(e)[:-1]])
    df = hourly(spark, **walk)
    found = H.ets_trend(H.contexts(df, cutoffs(spark, [(k, 287) for k in walk]), 200), 12, levels=[80]).collect()
    inside = np.mean([r["lo-80"] <= walk[r["unique_id"]][287 + r["step"]] <= r["hi-80"] for r in found])
    assert len(found) == 720 and 0.7 < inside < 0.9
    parts = H.mstl_forecast(df, cutoffs(spark, [("s1", 287)]), 12, (24,), (11,), 200, levels=[80]).collect()
    assert len(parts) == 12 and all(r["lo-80"] < r["yhat"] < r["hi-80"] for r in parts)


class Halted(Exception):
    pass


def test_a_halted_backtest_resumes(spark, long_panel, tmp_path):
    """Stopped while it forecasts the second fit group, then run again: equal to a whole run, and nothing on record is written anew."""
    model, plan = rolling.ets_model(200), T.cv_plan(long_panel, 24, n_windows=3, test_hours=72).cache()
    whole = rolling.cv_backtest(long_panel, model, plan, 24, f"file://{tmp_path}/whole", refit=2)
    want = sorted(map(tuple, whole.collect()))
    assert len(want) == 2 * 3 * 24
    calls = {"fit": 0, "forecast": 0}

    def counted(name, f, stop=None):
        def run(*a):
            calls[name] += 1
            if calls[name] == stop:
                raise Halted
            return f(*a)

        return run

    store = f"file://{tmp_path}/halted"
    with pytest.raises(Halted):
        rolling.cv_backtest(long_panel, rolling.Model(model.name, model.fit, counted("forecast", model.forecast, 2), model.config), plan, 24, store, refit=2)
    files = {f: os.stat(f).st_mtime_ns for d, _, names in os.walk(tmp_path / "halted") for f in [os.path.join(d, x) for x in names] if "part-" in f}
    assert sum("/fits/" in f for f in files) >= 2  # the second group was fitted before
    got = rolling.cv_backtest(long_panel, model, plan, 24, store, refit=2)
    assert sorted(map(tuple, got.collect())) == want
    assert all(os.stat(f).st_mtime_ns == t for f, t in files.items())
    # a third run has nothing to do, another configuration has
    calls["forecast"] = 0
    rolling.cv_backtest(long_panel, rolling.Model(model.name, model.fit, counted("forecast", model.forecast), model.config), plan, 24, store, refit=2)
    assert calls["forecast"] == 0
    rolling.cv_backtest(long_panel, rolling.Model(model.name, model.fit, counted("forecast", model.forecast), model.config), plan, 24, store, refit=False)
    assert calls["forecast"] == 1
    seconds = rolling.fit_seconds(spark, store).collect()
    assert sorted((r["n_fits"], r["n_windows"]) for r in seconds) == [(2, 6), (4, 6)] and all(r["avg_el_per_fit"] > 0 for r in seconds)
    assert rolling.backtest_results(long_panel, store).count() == 2 * len(want)


def test_contexts_carry_seasons_on(spark):
    """Two seasons over a context that begins in training and ends behind it; what should raise does."""
    n, end = 100, 70
    day, week = [5.0, 1.0, -6.0], [2.0, 0.0, -1.0, 4.0, -5.0]
    df = hourly(spark, a=[h * 0.5 + day[h % 3] + week[h % 5] for h in range(n)])
    parts = spark.createDataFrame([("a", at(h), day[h % 3], week[h % 5]) for h in range(end)], "unique_id string, ds timestamp_ntz, short double, long double")
    ends = lambda *hs: spark.createDataFrame([("a", at(h)) for h in hs], "unique_id string, context_end timestamp_ntz")
    seasons = {"short": 3, "long": 5}
    got = {(r["context_end"], r["ds"]): r["y_trend_rem"] for r in decompose.context_trend(df, parts, ends(69, 75, 99), seasons, 20).collect()}
    assert got.keys() == {(at(e), at(e - k)) for e in (69, 75, 99) for k in range(20)}
    assert all(abs(v - (t - BEGIN).total_seconds() / 7200) < 1e-9 for (_, t), v in got.items())
    with pytest.raises(Exception, match="a context ends before training does"):
        decompose.context_trend(df, parts, ends(68), seasons, 5).collect()
    with pytest.raises(Exception, match="a null or missing value"):
        decompose.context_trend(df, parts, ends(101), seasons, 5).collect()
    with pytest.raises(Exception, match="a null or missing value"):
        decompose.context_trend(df, parts.where(F.col("ds") >= F.lit(at(67))), ends(75), seasons, 5).collect()


@pytest.mark.parametrize("horizon", [24, 168])
@pytest.mark.parametrize("learner", H.LEARNERS)
def test_models_of_samples_see_nothing_behind_the_cutoff(spark, horizon, learner):
    """Values behind the first cutoff change no forecast from it; a lag shorter than the horizon is no feature."""
    rng = np.random.default_rng(4)
    series = {i: 20 + 5 * np.sin(np.arange(700) * 2 * np.pi / 24 + k) + rng.normal(0, 0.3, 700) for k, i in enumerate("ab")}
    df = hourly(spark, **series).cache()
    first = F.lit(at(699 - horizon)).cast("timestamp_ntz")
    spoilt = df.withColumn("y", F.when(F.col("ds") > first, F.col("y") * 3 + 7).otherwise(F.col("y")))
    one, other = ({(r["unique_id"], r["ds"]): (r["y"], r["yhat"]) for r in H.direct_from_samples(d, first, 1, horizon, (24, 168), learner=learner).collect()} for d in (df, spoilt))
    assert one.keys() == other.keys() and len(one) == 2 * horizon
    assert all(math.isclose(one[k][1], other[k][1], rel_tol=1e-9) for k in one)
    assert np.mean([abs(y - x) for y, x in one.values()]) < 1.5
