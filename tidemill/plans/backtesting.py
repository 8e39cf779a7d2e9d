"""Queries over windows, naive backtests and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import backtest as T
from tidemill.operators import metrics as M
from tidemill.operators import panel as B
from tidemill.sources import fixtures as fx

from .registry import query, rounded

FIRST, LAST, N, H = "2024-01-23 23:00:00", "2024-01-29 23:00:00", 7, 24
END = "2024-01-30 23:00:00"
MODELS = ["Mean24h", "Naive168h", "Naive24h"]


def cv(spark, sf):
    """Day-ahead forecasts of three naive models over the last week."""
    return T.naive_backtest(fx.hourly(spark, sf), B.timestamp(FIRST), N, 24, H)


_METRIC = {
    "mae": "avg(abs(y - yhat))",
    "rmse": "sqrt(avg((y - yhat) * (y - yhat)))",
    "mape": "avg(abs((y - yhat) / nullif(y, 0)))",
    "me": "avg(y - yhat)",
    "smape": "avg(CASE WHEN abs(y) + abs(yhat) <= 1e-7 THEN 0 ELSE 2 * abs(y - yhat) / (abs(y) + abs(yhat)) END)",
}


def _scores(keys: str = "", source: str = "cv_long", scaled: bool = True) -> str:
    """SQL of the long scores: one SELECT a metric."""
    group = f"unique_id, cutoff, {keys}model"
    parts = [f"SELECT {group}, '{m}' AS metric, {x} AS value FROM {source} GROUP BY ALL" for m, x in _METRIC.items()]
    if scaled:
        parts.append(f"SELECT {', '.join('s.' + g.strip() for g in group.split(','))}, 'nmae' AS metric, s.v / n.v AS value FROM (SELECT {group}, avg(abs(y - yhat)) AS v FROM {source} GROUP BY ALL) s JOIN (SELECT unique_id, nullif(avg(abs(y)), 0) AS v FROM hourly WHERE ds BETWEEN TIMESTAMP '2019-01-01 00:00:00' AND TIMESTAMP '2025-01-01 00:00:00' GROUP BY 1) n ON n.unique_id = s.unique_id")
        parts.append(f"SELECT {', '.join('s.' + g.strip() for g in group.split(','))}, 'mase' AS metric, s.v / n.v AS value FROM (SELECT {group}, avg(abs(y - yhat)) AS v FROM {source} GROUP BY ALL) s JOIN (SELECT c.cutoff, d.unique_id, avg(d.d) AS v FROM (SELECT unique_id, ds, abs(y - lag(y, 24) OVER (PARTITION BY unique_id ORDER BY ds)) AS d FROM hourly) d JOIN cutoffs c ON d.ds <= c.cutoff GROUP BY 1, 2) n ON n.unique_id = s.unique_id AND n.cutoff = s.cutoff")
    return " UNION ALL ".join(parts)


SCORES = _scores()


@query(
    "WITH s AS (SELECT unique_id, date_trunc('day', max(ds) - INTERVAL 23 HOUR) + INTERVAL 23 HOUR - INTERVAL 168 HOUR AS first, CASE WHEN date_trunc('day', min(ds)) = min(ds) THEN min(ds) ELSE date_trunc('day', min(ds)) + INTERVAL 1 DAY END AS start_train FROM hourly GROUP BY 1)"
    ' SELECT unique_id, CAST(k AS INTEGER) AS "window", first + to_days(CAST(k AS INTEGER)) AS cutoff, first + to_days(CAST(k + 1 AS INTEGER)) AS forecast_end, start_train, 2 AS refit, CAST(k // 2 AS INTEGER) AS fit_group, 7 AS n_windows, 4 AS n_fits FROM s, generate_series(0, 6) t(k) WHERE first >= start_train',
    "hourly",
)
def cv_plan(spark, sf):
    return T.cv_plan(fx.hourly(spark, sf), horizon=24, n_windows=7, test_hours=168, max_fits=4)


@query('SELECT h.unique_id, h.ds, round(h.y, 6) AS y, CAST(k AS INTEGER) AS "window", c.cutoff FROM hourly h JOIN (SELECT k, TIMESTAMP \'2024-01-20 23:00:00\' + to_days(CAST(k AS INTEGER)) AS cutoff FROM generate_series(0, 2) t(k)) c ON h.ds > c.cutoff AND h.ds <= c.cutoff + INTERVAL 168 HOUR', "hourly")
def explode_windows(spark, sf):
    return rounded(T.explode_windows(fx.hourly(spark, sf), B.timestamp("2024-01-20 23:00:00"), 3, 24, 168))


@query("SELECT h.unique_id, h.ds, round(h.y, 6) AS y, CAST(g AS INTEGER) AS fit_group, c AS fit_cutoff, CASE WHEN h.ds > c - INTERVAL 24 HOUR THEN 'val' ELSE 'train' END AS part FROM hourly h JOIN (SELECT g, TIMESTAMP '2024-01-23 23:00:00' + to_days(CAST(2 * g AS INTEGER)) AS c FROM generate_series(0, 3) t(g)) f ON h.ds BETWEEN c - INTERVAL 199 HOUR AND c", "hourly")
def training_slices(spark, sf):
    df = fx.hourly(spark, sf)
    plan = T.cv_plan(df, 24, n_windows=7, test_hours=168, max_fits=4)
    return rounded(T.training_slices(df, plan, 200, 24).select("unique_id", "ds", "y", "fit_group", "fit_cutoff", "part"))


@query('SELECT unique_id, CAST(k AS INTEGER) AS "window", CAST(k // 3 AS INTEGER) AS fit_group, k % 3 = 0 AS fits FROM (SELECT DISTINCT unique_id FROM hourly), generate_series(0, 6) t(k)', "hourly")
def refit_schedule(spark, sf):
    plan = T.cv_plan(fx.hourly(spark, sf), 24, n_windows=7, test_hours=168)
    return T.refit_schedule(plan, 3).select("unique_id", "window", "fit_group", "fits")


@query(
    "WITH s AS (SELECT unique_id, ds AS cutoff, row_number() OVER w AS rn, list(round(y, 4)) OVER (w ROWS BETWEEN 47 PRECEDING AND CURRENT ROW) AS a, list(round(temperature, 4)) OVER (w ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING) AS b, list(round(y, 4)) OVER (w ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING) AS c FROM hourly_panel WINDOW w AS (PARTITION BY unique_id ORDER BY ds))"
    " SELECT unique_id, cutoff, array_to_string(a, ',') AS past_y, array_to_string(b, ',') AS future_temperature, array_to_string(c, ',') AS future_y FROM s WHERE len(a) = 48 AND len(c) = 24 AND (rn - 48) % 24 = 0",
    "hourly_panel",
)
def sliding_samples(spark, sf):
    df = rounded(fx.hourly_panel(spark, sf), 4)
    out = T.sliding_samples(df, ["y"], ["temperature"], 48, 24, 24)
    return out.select("unique_id", "cutoff", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("past_y", "future_temperature", "future_y")])


@query(
    "WITH l AS (SELECT unique_id, ds, round(y, 4) AS y, lag(round(y, 4), 48) OVER w AS lag48, row_number() OVER w AS rn FROM hourly_panel WINDOW w AS (PARTITION BY unique_id ORDER BY ds)),"
    " s AS (SELECT unique_id, ds AS cutoff, row_number() OVER w AS rn, list(y) OVER (w ROWS BETWEEN 47 PRECEDING AND CURRENT ROW) AS a, list(y) OVER (w ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS b, list(lag48) OVER (w ROWS BETWEEN 1 FOLLOWING AND 36 FOLLOWING) AS c, list(y) OVER (w ROWS BETWEEN 1 FOLLOWING AND 36 FOLLOWING) AS d FROM l WHERE rn > 48 WINDOW w AS (PARTITION BY unique_id ORDER BY ds))"
    " SELECT unique_id, cutoff, array_to_string(b, ',') AS last_y, array_to_string(c, ',') AS future_lag48, array_to_string(d, ',') AS future_y FROM s WHERE len(a) = 48 AND len(d) = 36 AND (rn - 48) % 12 = 0",
    "hourly_panel",
)
def decoder_samples(spark, sf):
    """Of the lags 24 and 48 only the second is safe over 36 hours."""
    out = T.decoder_samples(rounded(fx.hourly_panel(spark, sf), 4), ["y"], [], [24, 48], 48, 36, 12)
    return out.select("unique_id", "cutoff", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("last_y", "future_lag48", "future_y")])


@query("SELECT unique_id, ds, round(y, 6) AS y FROM hourly WHERE ds BETWEEN TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 48 HOUR AND TIMESTAMP '2024-01-22 23:00:00'", "hourly")
def slice_with_history(spark, sf):
    return rounded(T.slice_with_history(fx.hourly(spark, sf), B.timestamp("2024-01-20 00:00:00"), B.timestamp("2024-01-22 23:00:00"), 48))


@query("SELECT unique_id, cutoff, ds, round(y, 6) AS y, round(yhat, 6) AS yhat, model FROM cv_long WHERE model <> 'Mean24h'", "cv_long")
def seasonal_naive(spark, sf):
    return rounded(T.naive_backtest(fx.hourly(spark, sf), B.timestamp(FIRST), N, 24, H, mean_of=None))


@query(
    "WITH d AS (SELECT unique_id, ds, y - lag(y, 24) OVER (PARTITION BY unique_id ORDER BY ds) AS d FROM hourly), s AS (SELECT d.unique_id, c.cutoff, sqrt(avg(d.d * d.d)) AS s FROM d JOIN cutoffs c ON d.ds <= c.cutoff GROUP BY 1, 2)"
    ' SELECT f.unique_id, f.cutoff, f.ds, round(f.y, 5) AS y, f.model, round(f.yhat, 5) AS yhat, round(f.yhat - 1.2815515655446004 * s, 5) AS "lo-80", round(f.yhat + 1.2815515655446004 * s, 5) AS "hi-80" FROM cv_long f JOIN s ON s.unique_id = f.unique_id AND s.cutoff = f.cutoff WHERE model = \'Naive24h\'',
    "cv_long",
)
def naive_levels(spark, sf):
    df = fx.hourly(spark, sf)
    return rounded(T.naive_levels(df, cv(spark, sf).where("model = 'Naive24h'"), 24, {80: 1.2815515655446004}), 5)


@query("SELECT unique_id, cutoff, ds, round(y, 6) AS y, model, round(yhat, 6) AS yhat FROM cv_long", "cv_long")
def cv_backtest(spark, sf):
    return rounded(cv(spark, sf))


@query("SELECT unique_id, cutoff, ds, round(max(y), 6) AS y, round(max(CASE WHEN model = 'Mean24h' THEN yhat END), 6) AS \"Mean24h\", round(max(CASE WHEN model = 'Naive168h' THEN yhat END), 6) AS \"Naive168h\", round(max(CASE WHEN model = 'Naive24h' THEN yhat END), 6) AS \"Naive24h\" FROM cv_long GROUP BY ALL", "cv_long")
def align_forecasts(spark, sf):
    long = cv(spark, sf)
    return rounded(T.align_forecasts([long.where(F.col("model") == m) for m in MODELS]))


@query(
    "SELECT unique_id, cutoff, ds, round(y, 6) AS y, model, round(yhat, 6) AS yhat FROM cv_long UNION ALL SELECT unique_id, cutoff, ds, round(y, 6), 'Supplied', round(yhat * 1.5 + 1, 6) FROM cv_long WHERE model = 'Naive24h'",
    "cv_long",
)
def ingest_external_forecasts(spark, sf):
    """Forecasts of an outside model, supplied by key without truth, join the backtest."""
    own = cv(spark, sf)
    supplied = own.where("model = 'Naive24h'").select("unique_id", "cutoff", "ds", F.lit("Supplied").alias("model"), (F.col("yhat") * 1.5 + 1).alias("yhat"))
    truth = own.select("unique_id", "cutoff", "ds", "y").distinct()
    return rounded(own.unionByName(supplied.join(truth, ["unique_id", "cutoff", "ds"])))


@query(
    "WITH c AS (SELECT k AS season FROM (VALUES (24), (48), (72), (168)) t(k)), f AS (SELECT t.unique_id, c2.cutoff, t.ds, t.y, c.season, a.y AS yhat FROM hourly t JOIN cutoffs c2 ON t.ds > c2.cutoff AND t.ds <= c2.cutoff + INTERVAL 24 HOUR CROSS JOIN c JOIN hourly a ON a.unique_id = t.unique_id AND a.ds = t.ds - to_hours(CAST(c.season AS INTEGER)))"
    " SELECT unique_id, 'Naive' || season || 'h' AS config_id, round(avg(abs(y - yhat)), 5) AS mae, CAST(row_number() OVER (PARTITION BY unique_id ORDER BY round(avg(abs(y - yhat)), 9), 'Naive' || season || 'h') AS INTEGER) AS rank FROM f GROUP BY unique_id, season",
    "cv_long",
)
def grid_backtest(spark, sf):
    """A grid of naive seasons, all configurations and windows in one job, ranked within each series."""
    from pyspark.sql import Window

    df = fx.hourly(spark, sf)
    grid = spark.createDataFrame([(24,), (48,), (72,), (168,)], "season int")
    truth = T.explode_windows(df.select("unique_id", "ds", "y"), B.timestamp(FIRST), N, 24, H).drop("window").crossJoin(F.broadcast(grid))
    h = T.hours_between("cutoff", "ds")
    ref = F.col("cutoff") - B.hours(F.col("season") - 1) + B.hours((h - 1) % F.col("season"))
    past = df.select("unique_id", F.col("ds").alias("ref"), F.col("y").alias("yhat"))
    scored = truth.withColumn("ref", ref).join(past, ["unique_id", "ref"]).withColumn("config_id", F.concat(F.lit("Naive"), "season", F.lit("h"))).groupBy("unique_id", "config_id").agg(M.mae().alias("mae"))
    return rounded(scored.withColumn("rank", F.row_number().over(Window.partitionBy("unique_id").orderBy(F.round("mae", 9), "config_id"))), 5)


@query(
    "WITH p AS (SELECT unique_id, cutoff, count(DISTINCT ds) AS h FROM cv_long GROUP BY 1, 2), g AS (SELECT *, date_diff('hour', lag(cutoff) OVER (PARTITION BY unique_id ORDER BY cutoff), cutoff) AS s FROM p)"
    " SELECT unique_id, count(*) AS n_windows, min(h) AS min_horizon, max(h) AS max_horizon, min(cutoff) AS first_cutoff, max(cutoff) AS last_cutoff, CAST(min(s) AS INTEGER) AS min_step, CAST(max(s) AS INTEGER) AS max_step, count(DISTINCT s) > 1 AS unequal_spacing, 'Mean24h,Naive168h,Naive24h' AS models FROM g GROUP BY 1",
    "cv_long",
)
def cv_info(spark, sf):
    return T.cv_info(cv(spark, sf))


@query(
    "WITH w AS (SELECT unique_id, model, cutoff, count(*) AS n, count(DISTINCT ds) AS d, min(ds) AS lo, max(ds) AS hi FROM cv_long GROUP BY ALL)"
    " SELECT * FROM (SELECT 'columns' AS rule, 0::BIGINT AS broken, true AS ok UNION ALL SELECT 'null_keys', count(*), count(*) = 0 FROM cv_long WHERE unique_id IS NULL OR ds IS NULL OR cutoff IS NULL UNION ALL SELECT 'equal_horizon', count(*), count(*) = 0 FROM w WHERE n <> 24"
    " UNION ALL SELECT 'contiguous', count(*), count(*) = 0 FROM w WHERE NOT (n = d AND lo = cutoff + INTERVAL 1 HOUR AND hi = cutoff + to_hours(CAST(n AS INTEGER))) UNION ALL SELECT 'n_windows', count(*), count(*) = 0 FROM (SELECT count(*) AS k FROM w GROUP BY unique_id, model) WHERE k <> 7"
    " UNION ALL SELECT 'spacing', count(*), count(*) = 0 FROM (SELECT date_diff('hour', lag(cutoff) OVER (PARTITION BY unique_id, model ORDER BY cutoff), cutoff) AS g FROM w) WHERE g <> 24 UNION ALL SELECT 'last_cutoff', count(*), count(*) = 0 FROM (SELECT max(cutoff) AS c FROM w GROUP BY unique_id, model) WHERE c + INTERVAL 24 HOUR <> TIMESTAMP '2024-01-30 23:00:00'"
    " UNION ALL SELECT 'finite', count(*), count(*) = 0 FROM cv_long WHERE yhat IS NULL OR isnan(yhat) OR isinf(yhat) UNION ALL SELECT 'positive', count(*), count(*) = 0 FROM cv_long WHERE yhat <= 0)",
    "cv_long",
)
def cv_sanity(spark, sf):
    return T.cv_sanity(cv(spark, sf), H, N, 24, B.timestamp(END))


@query("SELECT unique_id, cutoff, ds, round(y, 6) AS y, model, round(yhat, 6) AS yhat FROM cv_long WHERE date_diff('day', TIMESTAMP '2024-01-23 23:00:00', cutoff) % 3 = 0", "cv_long")
def subsample_cutoffs(spark, sf):
    return rounded(T.subsample_cutoffs(cv(spark, sf), 3))


@query("WITH c AS (SELECT * FROM cv_long WHERE model = 'Naive24h' AND cutoff = TIMESTAMP '2024-01-25 23:00:00') SELECT h.unique_id, h.ds, round(h.y, 6) AS y, c.cutoff, c.model, round(c.yhat, 6) AS yhat FROM hourly h LEFT JOIN c ON c.unique_id = h.unique_id AND c.ds = h.ds WHERE h.ds BETWEEN TIMESTAMP '2024-01-26 00:00:00' - INTERVAL 48 HOUR AND TIMESTAMP '2024-01-26 23:00:00' + INTERVAL 12 HOUR", "cv_long")
def context_window(spark, sf):
    one = cv(spark, sf).where(F.col("model") == "Naive24h").where(F.col("cutoff") == B.timestamp("2024-01-25 23:00:00"))
    return rounded(T.context_window(fx.hourly(spark, sf), one, 48, 12))


@query("SELECT g.unique_id, g.ds FROM hour_grid g ANTI JOIN hourly_raw r ON r.unique_id = g.unique_id AND r.ds = g.ds", "hour_grid")
def missing_timestamps(spark, sf):
    return T.missing_timestamps(fx.hourly_raw(spark, sf)).select("unique_id", "ds")


@query('SELECT unique_id, CAST(k AS INTEGER) AS "window", CAST(k // 2 AS INTEGER) AS fit_group FROM (SELECT DISTINCT unique_id FROM hourly), generate_series(0, 6) t(k) WHERE k // 2 > 0 OR unique_id = \'error\'', "hourly")
def resume_windows(spark, sf):
    """Windows 0-2 are done, but for one series without window 1: only whole fit groups are skipped."""
    plan = T.cv_plan(fx.hourly(spark, sf), 24, n_windows=7, test_hours=168, max_fits=4)
    done = plan.where("`window` <= 2").where("NOT (unique_id = 'error' AND `window` = 1)")
    return T.resume_windows(plan, done).select("unique_id", "window", "fit_group")


_RUNS = "c_mktsegment || '_' || CASE WHEN c_nationkey % 2 = 0 THEN 'day' ELSE 'week' END || '_test_M' || (c_custkey % 3) || '_20240' || (1 + c_custkey % 9) || '15T' || lpad(CAST(c_custkey % 1000000 AS VARCHAR), 6, '0')"


@query(
    f"WITH p AS (SELECT '/runs/' || {_RUNS} AS path FROM customer), r AS (SELECT path, regexp_extract(path, '([A-Za-z0-9-]+)_(day|week)_test_([A-Za-z0-9]+)_([0-9]{{8}}T[0-9]{{6}})$', 1) AS unique_id, regexp_extract(path, '_(day|week)_test_', 1) AS horizon, regexp_extract(path, '_test_([A-Za-z0-9]+)_', 1) AS model, right(path, 15) AS stamp FROM p)"
    " SELECT path, unique_id, horizon, model, stamp FROM (SELECT *, row_number() OVER (PARTITION BY model, unique_id, horizon ORDER BY stamp DESC, path) AS rn FROM r) WHERE rn = 1",
)
def latest_runs(spark, sf):
    """Run directories named after customers; the newest of each (model, id, horizon)."""
    names = fx.read(spark, sf, "customer").select(
        F.concat(
            F.lit("/runs/"),
            "c_mktsegment",
            F.when(F.col("c_nationkey") % 2 == 0, "_day").otherwise("_week"),
            F.lit("_test_M"),
            (F.col("c_custkey") % 3).cast("string"),
            F.lit("_20240"),
            (1 + F.col("c_custkey") % 9).cast("string"),
            F.lit("15T"),
            F.lpad((F.col("c_custkey") % 1000000).cast("string"), 6, "0"),
        ).alias("path")
    )
    return T.latest_runs(names)


@query(f"SELECT unique_id, cutoff, model, metric, round(value, 5) AS value FROM ({SCORES})", "cv_long")
def evaluate_cv(spark, sf):
    return rounded(scores(spark, sf), 5)


def scores(spark, sf, **kw):
    return M.evaluate_cv(cv(spark, sf), fx.hourly(spark, sf), **kw)


for _name in ("mae", "rmse", "mape", "me", "smape", "nmae", "mase"):

    def _one(spark, sf, metric=_name):
        return rounded(scores(spark, sf, metrics=[metric]).select("unique_id", "cutoff", "model", "value"), 5)

    _one.__name__ = _name
    query(f"SELECT unique_id, cutoff, model, round(value, 5) AS value FROM ({SCORES}) WHERE metric = '{_name}'", "cv_long")(_one)


@query(
    "WITH f AS (SELECT * FROM cv_long WHERE cutoff = TIMESTAMP '2024-01-28 23:00:00' AND model <> 'Mean24h'), n AS (SELECT unique_id, avg(d) AS v FROM (SELECT unique_id, abs(y - lag(y, 24) OVER (PARTITION BY unique_id ORDER BY ds)) AS d FROM (SELECT * FROM hourly WHERE ds > TIMESTAMP '2024-01-28 23:00:00' - INTERVAL 240 HOUR AND ds <= TIMESTAMP '2024-01-28 23:00:00')) GROUP BY 1)"
    " SELECT f.unique_id, f.cutoff, f.model, 'mae' AS metric, round(avg(abs(y - yhat)), 5) AS value FROM f GROUP BY ALL UNION ALL SELECT f.unique_id, f.cutoff, f.model, 'rmse', round(sqrt(avg((y - yhat) * (y - yhat))), 5) FROM f GROUP BY ALL UNION ALL SELECT f.unique_id, f.cutoff, f.model, 'mase', round(avg(abs(y - yhat)) / max(n.v), 5) FROM f JOIN n ON n.unique_id = f.unique_id GROUP BY ALL",
    "cv_long",
)
def evaluate(spark, sf):
    """A single split: the naive model is added, scaling sees the last 240 training hours."""
    one = cv(spark, sf).where(F.col("cutoff") == B.timestamp("2024-01-28 23:00:00")).where("model = 'Naive168h'")
    return rounded(M.evaluate(one, fx.hourly(spark, sf), insample=240), 5)


_BESIDE = f"WITH s AS ({SCORES}), w AS (SELECT *, max(CASE WHEN model = 'Naive24h' THEN value END) OVER (PARTITION BY unique_id, cutoff, metric) AS base FROM s)"


@query(f"{_BESIDE} SELECT unique_id, cutoff, model, metric || '_pct_inc' AS metric, round(CASE WHEN model = 'Naive24h' THEN 0 ELSE (value - base) / nullif(base, 0) * 100 END, 4) AS value FROM w WHERE metric <> 'me'", "cv_long")
def pct_increase(spark, sf):
    return rounded(M.pct_increase(scores(spark, sf)), 4)


_WINS = f"s AS ({SCORES}), l AS (SELECT *, CASE WHEN metric = 'me' THEN abs(value) ELSE value END AS loss FROM s), b AS (SELECT *, min(loss) OVER (PARTITION BY unique_id, metric, cutoff) AS best FROM l), k AS (SELECT *, coalesce(abs(loss - best) <= 1e-8 + 1e-5 * abs(best), false) AS hit FROM b), w AS (SELECT *, CASE WHEN hit THEN 1.0 / sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY unique_id, metric, cutoff) ELSE 0 END AS credit FROM k)"
_CV_SUMMARY = "SELECT unique_id, metric, model, avg(value) AS mean, quantile_cont(value, 0.5) AS median, stddev_samp(value) AS std, avg(credit) AS wrate, count(value) AS n FROM w GROUP BY ALL"


@query(f"WITH {_WINS} SELECT unique_id, metric, model, round(mean, 5) AS mean, round(median, 5) AS median, round(std, 5) AS std, round(wrate, 5) AS wrate, n FROM ({_CV_SUMMARY})", "cv_long")
def cv_summary(spark, sf):
    return rounded(M.cv_summary(scores(spark, sf)), 5)


_WIDE = ", ".join(f"max(CASE WHEN metric = '{m}' THEN {s} END) AS {m}_{s}" for m in ("mae", "rmse") for s in ("mean", "median", "std", "wrate"))
_WIDE_NAMES = [f"{m}_{s}" for m in ("mae", "rmse") for s in ("mean", "median", "std", "wrate")]


@query(
    f"WITH {_WINS}, c AS ({_CV_SUMMARY}), t AS (SELECT unique_id, model, {_WIDE} FROM c GROUP BY 1, 2), u AS (SELECT * FROM t UNION ALL SELECT 'Average', model, {', '.join(f'avg({n})' for n in _WIDE_NAMES)} FROM t GROUP BY model)"
    f" SELECT unique_id, model, {', '.join(f'round({n}, 5) AS {n}' for n in _WIDE_NAMES)}, CAST(row_number() OVER (PARTITION BY unique_id ORDER BY round(mae_mean, 9), model) AS INTEGER) AS rank FROM u QUALIFY rank <= 2",
    "cv_long",
)
def summary_table(spark, sf):
    return rounded(M.summary_table(M.cv_summary(scores(spark, sf)), ["mae", "rmse"], top=2), 5)


@query(f"{_BESIDE} SELECT unique_id, cutoff, metric, 'LD-' || model AS model, round(value - base, 5) AS value FROM w WHERE model <> 'Naive24h'", "cv_long")
def loss_diffs(spark, sf):
    return rounded(M.loss_diffs(scores(spark, sf)), 5)


@query(f"WITH h AS (SELECT *, CAST(date_diff('hour', cutoff, ds) AS INTEGER) AS horizon_h FROM cv_long), k AS (SELECT * FROM h WHERE horizon_h % 6 = 0), s AS ({_scores('horizon_h, ', 'k', False)}) SELECT unique_id, metric, horizon_h, model, round(avg(value), 5) AS mean, round(quantile_cont(value, 0.5), 5) AS median FROM s WHERE metric IN ('mae', 'me') GROUP BY ALL", "cv_long")
def by_horizon(spark, sf):
    long = M.with_horizon(cv(spark, sf), 6)
    s = M.evaluate_cv(long, metrics=["mae", "me"], extra=["horizon_h"])
    return rounded(M.cv_summary(s, ["horizon_h"]).select("unique_id", "metric", "horizon_h", "model", "mean", "median"), 5)


@query(
    "WITH t AS (SELECT unique_id, avg(y) AS th FROM hourly GROUP BY 1), e AS (SELECT c.unique_id, model, yhat - y AS e, y > th AS high FROM cv_long c JOIN t ON t.unique_id = c.unique_id)"
    " SELECT unique_id, model, round(coalesce(avg(CASE WHEN high AND e > 0 THEN e END), 0), 5) AS over, round(coalesce(avg(CASE WHEN high AND e < 0 THEN -e END), 0), 5) AS under, round(coalesce(avg(CASE WHEN high THEN abs(e) END), 0), 5) AS mae FROM e GROUP BY 1, 2",
    "cv_long",
    "hourly",
)
def threshold_errors(spark, sf):
    high = fx.hourly(spark, sf).groupBy("unique_id").agg(F.avg("y").alias("y_th"))
    return rounded(M.threshold_errors(cv(spark, sf), high), 5)


@query(f"WITH s AS ({SCORES}) SELECT unique_id, metric, model, round(avg(value), 5) AS mean, round(quantile_cont(value, 0.1), 5) AS lo, round(quantile_cont(value, 0.9), 5) AS hi FROM s GROUP BY ALL", "cv_long")
def metric_interval(spark, sf):
    return rounded(M.metric_interval(scores(spark, sf)), 5)


@query(f"WITH s AS ({SCORES}), d AS (SELECT unique_id, date_trunc('day', ds) - INTERVAL 1 HOUR AS cutoff, avg(temperature) AS t FROM hourly_panel GROUP BY ALL) SELECT s.unique_id, s.cutoff, s.model, s.metric, round(s.value, 5) AS value, round(d.t, 5) AS temperature FROM s LEFT JOIN d ON d.unique_id = s.unique_id AND d.cutoff = s.cutoff WHERE metric = 'mae'", "cv_long", "hourly_panel")
def covariate_by_cutoff(spark, sf):
    return rounded(M.covariate_by_cutoff(scores(spark, sf, metrics=["mae"]), fx.hourly_panel(spark, sf)), 5)


@query(
    "WITH g AS (SELECT unique_id, model, sum((y - yhat) * (y - yhat)) AS sse, count(*)::DOUBLE AS t, var_pop(y) AS v, CASE model WHEN 'Naive168h' THEN 2.0 ELSE 1.0 END AS k FROM cv_long GROUP BY 1, 2)"
    " SELECT unique_id, model, round(1 - (sse / (t * v)) * (t - 1) / (t - k - 1), 5) AS adj_r2, round(t * ln(sse / t) + 2 * (k + 2), 5) AS aic, round(t * ln(sse / t) + 2 * (k + 2) + 2 * (k + 2) * (k + 3) / (t - k - 3), 5) AS aicc, round(t * ln(sse / t) + (k + 2) * ln(t), 5) AS bic FROM g",
    "cv_long",
)
def fit_criteria(spark, sf):
    return rounded(M.fit_criteria(cv(spark, sf), {"Naive24h": 1, "Naive168h": 2, "Mean24h": 1}), 5)
