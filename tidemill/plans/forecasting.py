"""Queries over decompositions, forecast models and stored runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import arima as G
from tidemill.operators import backtest as T
from tidemill.operators import decompose as E
from tidemill.operators import models as H
from tidemill.operators import panel as B
from tidemill.operators import rolling as R
from tidemill.sources import fixtures as fx
from tidemill.sources import panel_io as A

from .backtesting import FIRST, cv
from .registry import query, rounded

_CLASSICAL = (
    "i AS (SELECT unique_id, ds, y, row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS i, count(*) OVER (PARTITION BY unique_id) AS n FROM {t}),"
    " m AS (SELECT *, CASE WHEN i > 182 AND i <= n - 182 THEN avg(y) OVER (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN 182 PRECEDING AND 182 FOLLOWING) END AS t FROM i),"
    " l AS (SELECT unique_id, regr_slope(CASE WHEN i <= 547 THEN t END, CASE WHEN i <= 547 THEN i END) AS lb, regr_intercept(CASE WHEN i <= 547 THEN t END, CASE WHEN i <= 547 THEN i END) AS la, regr_slope(CASE WHEN i > n - 547 THEN t END, CASE WHEN i > n - 547 THEN i END) AS rb, regr_intercept(CASE WHEN i > n - 547 THEN t END, CASE WHEN i > n - 547 THEN i END) AS ra FROM m GROUP BY 1),"
    " tr AS (SELECT m.*, CASE WHEN i <= 182 THEN la + lb * i WHEN i > n - 182 THEN ra + rb * i ELSE t END AS trend, (i - 1) % 365 AS ph FROM m JOIN l ON l.unique_id = m.unique_id),"
    " s AS (SELECT unique_id, ph, avg(y - t) AS s FROM tr GROUP BY 1, 2), c AS (SELECT unique_id, ph, s - avg(s) OVER (PARTITION BY unique_id) AS seasonal FROM s),"
    " parts AS (SELECT tr.unique_id, tr.ds, tr.y, tr.trend, c.seasonal, tr.y - tr.trend - c.seasonal AS remainder FROM tr JOIN c ON c.unique_id = tr.unique_id AND c.ph = tr.ph)"
)


@query(f"WITH {_CLASSICAL.format(t='daily')} SELECT unique_id, ds, round(y, 3) AS y, round(trend, 3) AS trend, round(seasonal, 3) AS seasonal, round(remainder, 3) AS remainder FROM parts", "daily")
def decompose_classical(spark, sf):
    return rounded(E.decompose_classical(fx.daily(spark, sf)), 3)


@query("SELECT unique_id, ds, round(y, 3) AS y, round(y, 3) AS trend, 0.0::DOUBLE AS seasonal, 0.0::DOUBLE AS remainder FROM daily", "daily")
def decompose_none(spark, sf):
    return rounded(E.decompose_none(fx.daily(spark, sf)), 3)


@query(None)
def decompose_stl(spark, sf):
    return E.decompose_stl(fx.daily(spark, sf))


@query(None)
def decompose_mstl(spark, sf):
    return E.decompose_mstl(fx.hourly(spark, sf))


@query(None)
def smooth_seasonal_loess(spark, sf):
    return E.smooth_seasonal_loess(E.decompose_classical(fx.daily(spark, sf)), 31)


_HOURLY_SEASON = "se AS (SELECT unique_id, date_trunc('day', ds) AS day, avg(y) AS seasonal FROM hourly GROUP BY 1, 2)"


@query(f"WITH {_HOURLY_SEASON} SELECT h.unique_id, h.ds, round(h.y - s.seasonal, 6) AS y FROM hourly h LEFT JOIN se s ON s.unique_id = h.unique_id AND s.day = date_trunc('day', h.ds)", "hourly")
def remove_annual(spark, sf):
    df = fx.hourly(spark, sf)
    season = B.resample_daily(df, ["y"]).withColumnRenamed("y", "seasonal")
    return rounded(E.remove_annual(df, season))


@query(f"WITH {_CLASSICAL.format(t='daily')} SELECT d.unique_id, d.ds, round(d.y + p.seasonal, 3) AS y FROM daily d LEFT JOIN parts p ON p.unique_id = d.unique_id AND p.ds = d.ds - INTERVAL 1 YEAR", "daily")
def add_annual(spark, sf):
    df = fx.daily(spark, sf)
    return rounded(E.add_annual(df, E.decompose_classical(df), ["y"]), 3)


@query(f"WITH {_CLASSICAL.format(t='daily')}, k AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS k FROM parts), g AS (SELECT unnest(generate_series(1, 400)) AS step) SELECT k.unique_id, CAST(step AS INTEGER) AS step, round(k.seasonal, 3) AS value FROM g JOIN k ON 365 - k.k = (step - 1) % 365 WHERE k.k <= 365", "daily")
def repeat_seasonal_tail(spark, sf):
    return rounded(E.repeat_seasonal_tail(E.decompose_classical(fx.daily(spark, sf)), 365, 400), 3)


@query(f"WITH {_CLASSICAL.format(t='daily')} SELECT unique_id, ds, round(trend + remainder, 3) AS y_trend_rem FROM parts", "daily")
def trend_plus_remainder(spark, sf):
    return rounded(E.trend_plus_remainder(E.decompose_classical(fx.daily(spark, sf))), 3)


_ENDS = "(VALUES (TIMESTAMP '2000-12-31 00:00:00'), (TIMESTAMP '2001-01-20 00:00:00'), (TIMESTAMP '2001-07-15 00:00:00')) ends(e)"


@query(
    f"WITH td AS (SELECT * FROM daily WHERE ds < TIMESTAMP '2001-01-01'), {_CLASSICAL.format(t='td')}, last AS (SELECT unique_id, max(ds) AS t FROM parts GROUP BY 1),"
    f" rows AS (SELECT d.unique_id, e AS context_end, d.ds, d.y, CASE WHEN d.ds <= t THEN d.ds ELSE t - (364 - (date_diff('day', t, d.ds) - 1) % 365) * INTERVAL 1 DAY END AS ref FROM daily d JOIN last ON last.unique_id = d.unique_id JOIN {_ENDS} ON d.ds <= e AND d.ds > e - INTERVAL 200 DAY)"
    " SELECT rows.unique_id, context_end, rows.ds, round(rows.y - seasonal, 3) AS y_trend_rem FROM rows JOIN parts ON parts.unique_id = rows.unique_id AND parts.ds = rows.ref",
    "daily",
)
def context_trend(spark, sf):
    """Contexts of 200 days at the end of training and up to half a year behind it, with the seasons of the training span."""
    df = fx.daily(spark, sf)
    parts = E.decompose_classical(df.where(F.col("ds") < B.timestamp("2001-01-01 00:00:00")))
    days = F.array(*[B.timestamp(f"{d} 00:00:00") for d in ("2000-12-31", "2001-01-20", "2001-07-15")])
    ends = df.select("unique_id").distinct().select("unique_id", F.explode(days).alias("context_end"))
    return rounded(E.context_trend(df, parts, ends, {"seasonal": 365}, 200, 24), 3)


def plan(spark, sf):
    return T.cv_plan(fx.hourly(spark, sf), 24, n_windows=7, test_hours=168)


@query(None)
def ets_trend(spark, sf):
    df = fx.hourly(spark, sf)
    return H.with_truth(H.ets_trend(H.contexts(df, plan(spark, sf), 504), 24), df)


@query(None)
def mstl_forecast(spark, sf):
    df = fx.hourly(spark, sf)
    return H.with_truth(H.mstl_forecast(df, plan(spark, sf), 24), df)


@query(None)
def dynamic_regression(spark, sf):
    df = fx.hourly(spark, sf)
    return H.with_truth(H.dynamic_regression(df, plan(spark, sf), 24), df)


@query(None)
def dynamic_regression_exog(spark, sf):
    """With a covariate that is known ahead, one fit for all windows of a series, and 95 % bands."""
    df = fx.hourly_panel(spark, sf)
    return H.dynamic_regression(df, T.cv_plan(df, 24, n_windows=7, test_hours=168, max_fits=1), 24, exog=["temperature"], z=1.96)


_PLAN = "p AS (SELECT unique_id, last - (168 - 24 * w) * INTERVAL 1 HOUR AS cutoff FROM (SELECT unique_id, max(ds) AS last FROM hourly GROUP BY 1), (SELECT unnest(generate_series(0, 6)) AS w))"


@query(
    f"WITH {_PLAN}, x AS (SELECT unique_id, ds, y, lag(y, 1) OVER w AS a, lag(y, 24) OVER w AS b FROM hourly WINDOW w AS (PARTITION BY unique_id ORDER BY ds))"
    " SELECT x.unique_id, cutoff, count(*) AS n, round(sum(a), 3) AS one_lag1, round(sum(a * a), 1) AS lag1_lag1, round(sum(a * b), 1) AS lag1_lag24, round(sum(a * y), 1) AS lag1_y, round(sum(y * y), 1) AS yty"
    " FROM x JOIN p ON p.unique_id = x.unique_id AND ds <= cutoff AND ds > cutoff - INTERVAL 504 HOUR WHERE b IS NOT NULL GROUP BY 1, 2",
    "hourly",
)
def normal_equations(spark, sf):
    """The sums that a dynamic regression solves, for two lags."""
    rows, names = H.regression_rows(fx.hourly(spark, sf), (1, 24), k_day=0, k_week=0)
    sums = H.normal_equations(rows, names, plan(spark, sf), 504)
    at = lambda column, i, name, digits=1: F.round(F.get(column, F.lit(i)), digits).alias(name)
    return sums.select("unique_id", "cutoff", "n", at("xtx", 1, "one_lag1", 3), at("xtx", 3, "lag1_lag1"), at("xtx", 4, "lag1_lag24"), at("xty", 1, "lag1_y"), F.round("yty", 1).alias("yty"))


_W = "w AS (SELECT unique_id, ds, y - lag(y, 24) OVER o AS w FROM hourly WINDOW o AS (PARTITION BY unique_id ORDER BY ds)), x AS (SELECT *, lag(w) OVER (PARTITION BY unique_id ORDER BY ds) AS w1 FROM w)"


@query(
    f"WITH {_PLAN}, {_W}, f AS (SELECT x.unique_id, regr_slope(w, w1) AS b, regr_intercept(w, w1) AS a FROM x JOIN (SELECT unique_id, min(cutoff) AS cutoff FROM p GROUP BY 1) c ON c.unique_id = x.unique_id AND ds <= cutoff AND ds > cutoff - INTERVAL 504 HOUR WHERE w1 IS NOT NULL GROUP BY 1),"
    " e AS (SELECT x.*, w - a - b * w1 AS e FROM x JOIN f ON f.unique_id = x.unique_id), z AS (SELECT *, lag(e) OVER (PARTITION BY unique_id ORDER BY ds) AS e1 FROM e)"
    " SELECT z.unique_id, cutoff, count(*) AS n, round(sum(w1 * e1), 1) AS ar1_ma1, round(sum(e1 * e1), 1) AS ma1_ma1, round(sum(e1 * w), 1) AS ma1_y, round(sum(w * w), 1) AS yty"
    " FROM z JOIN p ON p.unique_id = z.unique_id AND ds <= cutoff AND ds > cutoff - INTERVAL 504 HOUR WHERE e1 IS NOT NULL GROUP BY 1, 2",
    "hourly",
)
def hannan_rissanen_sums(spark, sf):
    """Sums of the second regression of order (1, 0, 1)(0, 1, 0): innovations of a first one are its moving-average terms."""
    windows = plan(spark, sf)
    rows, names = G.Sarima(G.Order(1, 1, 0, 0), long=(1,)).rows(fx.hourly(spark, sf), windows)
    sums = H.normal_equations(rows, names, windows, 504)
    at = lambda column, i, name: F.round(F.get(column, F.lit(i)), 1).alias(name)
    return sums.select("unique_id", "cutoff", "n", at("xtx", 4, "ar1_ma1"), at("xtx", 5, "ma1_ma1"), at("xty", 2, "ma1_y"), F.round("yty", 1).alias("yty"))


@query(None)
def sarima(spark, sf):
    """Order (1, 0, 0)(1, 1, 1) of season 24, one fit for all windows of a series, on an arcsinh scale, with intervals."""
    df = fx.hourly(spark, sf)
    return G.sarima(df, T.cv_plan(df, 24, n_windows=7, test_hours=168, max_fits=1), 24, levels=[80, 95], kind="arcsinh10")


@query(None)
def stepwise_orders(spark, sf):
    df = fx.hourly(spark, sf)
    return G.stepwise_orders(df, plan(spark, sf).where("window = 0"), G.Order(2, 1, 1, 1), current=G.Order())


@query(None)
def order_comparison(spark, sf):
    """Criteria of the order that a stepwise search finds beside those of (1, 0, 0)(1, 1, 1)."""
    df = fx.hourly(spark, sf)
    return G.order_comparison(G.stepwise_orders(df, plan(spark, sf).where("window = 0"), G.Order(2, 1, 1, 1), current=G.Order()))


_GROUPS = "g AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY cutoff) - 1 AS w FROM p), gs AS (SELECT unique_id, cutoff, min(cutoff) OVER (PARTITION BY unique_id, w // 3) AS fit FROM g)"


@query(
    f"WITH {_PLAN}, {_GROUPS}, x AS (SELECT *, lag(y) OVER (PARTITION BY unique_id ORDER BY ds) AS y1 FROM hourly), f AS (SELECT x.unique_id, fit, regr_slope(y, y1) AS b, regr_intercept(y, y1) AS a FROM x JOIN (SELECT DISTINCT unique_id, fit FROM gs) c ON c.unique_id = x.unique_id AND ds <= fit AND ds > fit - INTERVAL 504 HOUR WHERE y1 IS NOT NULL GROUP BY 1, 2)"
    " SELECT gs.unique_id, cutoff, t.ds, round(t.y, 6) AS y, 'SARIMA' AS model, round(a * (1 - power(b, h)) / (1 - b) + power(b, h) * c.y, 3) AS yhat"
    " FROM gs JOIN f ON f.unique_id = gs.unique_id AND f.fit = gs.fit JOIN hourly c ON c.unique_id = gs.unique_id AND c.ds = cutoff, (SELECT unnest(generate_series(1, 24)) AS h) LEFT JOIN hourly t ON t.unique_id = gs.unique_id AND t.ds = cutoff + h * INTERVAL 1 HOUR",
    "hourly",
)
def cv_backtest_refit(spark, sf):
    """A first-order autoregression refitted every three windows, through the store; forecasts are geometric sums."""
    df = fx.hourly(spark, sf)
    model = R.sarima_model(G.Sarima(G.Order(1, 0, 0, 0, 0), long=(1,)))
    found = R.cv_backtest(df, model, plan(spark, sf), 24, A.scratch_path(spark, "backtest"), refit=3)
    return rounded(found, 3, y=6)


@query(None)
def cv_backtest_mstl(spark, sf):
    """MSTL with the smoothing parameters of the first window, through the store."""
    return R.cv_backtest(fx.hourly(spark, sf), R.mstl_model(), plan(spark, sf), 24, A.scratch_path(spark, "backtest"), refit=False)


_HOLT = (
    f"{_PLAN}, c AS (SELECT p.unique_id, cutoff, row_number() OVER (PARTITION BY p.unique_id, cutoff ORDER BY ds) AS i, y FROM p JOIN hourly h ON h.unique_id = p.unique_id AND ds <= cutoff AND ds > cutoff - INTERVAL 168 HOUR),"
    " s AS (SELECT a.unique_id, a.cutoff, 1::BIGINT AS i, a.y AS l, b.y - a.y AS b, 0.0::DOUBLE AS sse FROM c a JOIN c b ON b.unique_id = a.unique_id AND b.cutoff = a.cutoff AND b.i = 2 WHERE a.i = 1"
    " UNION ALL SELECT s.unique_id, s.cutoff, c.i, s.l + 0.9 * s.b + 0.3 * (c.y - s.l - 0.9 * s.b), 0.9 * s.b + 0.3 * 0.2 * (c.y - s.l - 0.9 * s.b), s.sse + power(c.y - s.l - 0.9 * s.b, 2) FROM s JOIN c ON c.unique_id = s.unique_id AND c.cutoff = s.cutoff AND c.i = s.i + 1)"
)


@query(
    f"WITH RECURSIVE {_HOLT}, e AS (SELECT unique_id, cutoff, l, b, sse / 167 AS v FROM s WHERE i = 168), k AS (SELECT CAST(unnest(generate_series(1, 24)) AS INTEGER) AS step),"
    " d AS (SELECT step, 0.9 * (1 - power(0.9, step)) / (1 - 0.9) AS d FROM k), q AS (SELECT k.step, 1 + coalesce(sum(power(0.3 + 0.3 * 0.2 * d.d, 2)), 0) AS q FROM k LEFT JOIN d ON d.step < k.step GROUP BY 1)"
    " SELECT unique_id, cutoff, k.step, 'ETS' AS model, round(l + d * b, 4) AS yhat, round(l + d * b - 1.2815515655446004 * sqrt(v * q), 4) AS lo_80, round(l + d * b + 1.2815515655446004 * sqrt(v * q), 4) AS hi_80 FROM e, k, d, q WHERE d.step = k.step AND q.step = k.step",
    "hourly",
)
def ets_levels(spark, sf):
    """Forecasts of damped smoothing with given parameters and their 80 % intervals."""
    windows = plan(spark, sf)
    given = windows.select("unique_id").distinct().select("unique_id", F.lit(0.3).alias("alpha"), F.lit(0.2).alias("beta"), F.lit(0.9).alias("phi"))
    found = H.ets_steps(H.ets_forward(H.contexts(fx.hourly(spark, sf), windows, 168), given), 24, levels=[80])
    return rounded(found.withColumnsRenamed({"lo-80": "lo_80", "hi-80": "hi_80"}), 4)


@query(None)
def mstl_levels(spark, sf):
    """MSTL forecasts with 80 and 95 % intervals, through an arcsinh scale and back."""
    df = fx.hourly(spark, sf)
    return H.mstl_on_scale(df, plan(spark, sf), 24, "arcsinh10", levels=[80, 95])


@query(None)
def mstl_on_scale(spark, sf):
    """MSTL forecasts on an arcsinh scale, and back."""
    df = fx.hourly(spark, sf)
    return H.with_truth(H.mstl_on_scale(df, plan(spark, sf), 24, "arcsinh10"), df)


@query(None)
def ets_forward(spark, sf):
    """Smoothing parameters of the first window carried over all windows of a series."""
    df = fx.hourly(spark, sf)
    windows = plan(spark, sf)
    fit = H.ets_fit(H.contexts(df, windows.where("window = 0"), 504))
    return H.with_truth(H.ets_steps(H.ets_forward(H.contexts(df, windows, 504), fit), 24), df)


@query(None)
def order_search(spark, sf):
    return H.order_search(fx.hourly(spark, sf), plan(spark, sf), [[1], [1, 24], [1, 24, 25, 168]])


@query(None)
def direct_multihorizon(spark, sf):
    return H.direct_multihorizon(fx.hourly(spark, sf), B.timestamp(FIRST), 7)


@query(None)
def direct_from_samples(spark, sf):
    """Gradient-boosted trees over the samples of a decoder, with a covariate that is known ahead."""
    return H.direct_from_samples(fx.hourly_panel(spark, sf), B.timestamp(FIRST), 7, exog=["temperature"], learner="trees")


@query("SELECT unique_id, model, count(DISTINCT cutoff) AS n_windows, min(cutoff) AS first_cutoff, max(ds) AS end_test, 24 AS step_size, CAST(NULL AS DOUBLE) AS avg_el_per_fit FROM cv_long GROUP BY 1, 2", "cv_long")
def run_metadata(spark, sf):
    return A.run_metadata(cv(spark, sf), 24)


@query("SELECT unique_id FROM (SELECT DISTINCT unique_id FROM cv_long) WHERE unique_id = 'error'", "cv_long")
def check_metadata(spark, sf):
    """One series' runs of one model lack a window, so its models must not be compared."""
    some = cv(spark, sf).where(~((F.col("unique_id") == "error") & (F.col("model") == "Mean24h") & (F.col("cutoff") == B.timestamp(FIRST))))
    return A.check_metadata(A.run_metadata(some, 24)).select("unique_id")


_HOURLY = "SELECT unique_id, ds, round(y, 6) AS y FROM hourly"


@query(_HOURLY, "hourly")
def read_panel_csv(spark, sf):
    """The hourly panel written as one semicolon-separated folder a series, and read back with ids from the path."""
    path = A.scratch_path(spark, "csv")
    A.write_panel(fx.hourly(spark, sf), path, "csv")
    return rounded(A.read_panel_csv(spark, f"{path}/*/*.csv", ["y"], "unique_id=([A-Za-z0-9]+)"))


@query(_HOURLY, "hourly")
def write_panel(spark, sf):
    path = A.scratch_path(spark, "panel")
    A.write_panel(fx.hourly(spark, sf), path)
    return rounded(spark.read.parquet(path).select("unique_id", "ds", "y"))


@query("SELECT unique_id, cutoff, ds, round(y, 6) AS y, model, round(yhat, 6) AS yhat FROM cv_long WHERE model = 'Naive168h'", "cv_long")
def read_cv_results(spark, sf):
    """Stored forecasts of one model: the partition filter reads its folder only."""
    path = A.scratch_path(spark, "cv")
    A.write_cv_results(cv(spark, sf), path)
    one = A.read_cv_results(spark, path).where("model = 'Naive168h'")
    return rounded(one.select("unique_id", "cutoff", "ds", "y", "model", "yhat"))
