"""Queries over cleaning, features and transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import features as C
from tidemill.operators import panel as B
from tidemill.operators import transforms as D
from tidemill.sources import fixtures as fx

from .registry import query, rounded

W = "OVER (PARTITION BY unique_id ORDER BY ds)"


@query("SELECT unique_id, ds, round(y, 6) AS y FROM hourly_gaps", "hourly_gaps")
def fill_gaps(spark, sf):
    return rounded(B.fill_gaps(fx.hourly_raw(spark, sf)))


@query("SELECT unique_id, ds, round(CASE WHEN y < 40.0 THEN 40.0 ELSE y END, 6) AS y FROM hourly_gaps", "hourly_gaps")
def clip_lower(spark, sf):
    return rounded(B.clip_lower(B.fill_gaps(fx.hourly_raw(spark, sf)), "y", 40.0))


@query("SELECT unique_id, CAST(sum(CASE WHEN y < 40 THEN 1 ELSE 0 END) AS BIGINT) AS n_low, count(y) AS n FROM hourly_raw GROUP BY ROLLUP (unique_id)", "hourly_raw")
def low_counts(spark, sf):
    return B.low_counts(fx.hourly_raw(spark, sf), "y", 40.0)


@query("SELECT unique_id, ds, round(last_value(y IGNORE NULLS) OVER (PARTITION BY unique_id ORDER BY ds ROWS UNBOUNDED PRECEDING), 6) AS y FROM hourly_gaps", "hourly_gaps")
def forward_fill(spark, sf):
    return rounded(B.forward_fill(B.fill_gaps(fx.hourly_raw(spark, sf)), ["y"]))


@query("SELECT unique_id, ds, round(last_value(CASE WHEN y > 100 THEN NULL ELSE y END IGNORE NULLS) OVER (PARTITION BY unique_id ORDER BY ds ROWS UNBOUNDED PRECEDING), 6) AS y FROM hourly", "hourly")
def mask_points(spark, sf):
    df = fx.hourly(spark, sf)
    return rounded(B.forward_fill(B.mask_points(df, df.where("y > 100"), ["y"]), ["y"]))


@query("SELECT unique_id, date_trunc('day', ds) AS ds, round(avg(y), 6) AS y FROM hourly_gaps GROUP BY 1, 2", "hourly_gaps")
def resample_daily(spark, sf):
    return rounded(B.resample_daily(B.fill_gaps(fx.hourly_raw(spark, sf)), ["y"]))


_SUMMARY = "SELECT unique_id, count(y) AS n, round(avg(y), 4) AS mean, round(stddev_samp(y), 4) AS std, round(min(y), 4) AS min, round(quantile_cont(y, 0.05), 4) AS p05, round(quantile_cont(y, 0.25), 4) AS p25, round(quantile_cont(y, 0.5), 4) AS p50, round(quantile_cont(y, 0.75), 4) AS p75, round(quantile_cont(y, 0.95), 4) AS p95, round(max(y), 4) AS max, count(*) - count(y) AS missing, CAST(sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zeros, min(ds) AS start, max(ds) AS \"end\" FROM {} GROUP BY 1"


@query(_SUMMARY.format("hourly_gaps"), "hourly_gaps")
def summarize_panel(spark, sf):
    return rounded(B.summarize_panel(B.fill_gaps(fx.hourly_raw(spark, sf))), 4)


@query(_SUMMARY.format("daily WHERE month(ds) IN (11, 12, 1, 2, 3, 4)"), "daily")
def summarize_panel_winter(spark, sf):
    return rounded(B.summarize_panel(fx.daily(spark, sf), months=B.WINTER_MONTHS), 4)


@query("SELECT unique_id, ds, round(y, 6) AS y FROM hourly WHERE ds BETWEEN TIMESTAMP '2024-01-10 05:00:00' AND TIMESTAMP '2024-01-20 17:00:00'", "hourly")
def time_slice(spark, sf):
    return rounded(B.time_slice(fx.hourly(spark, sf), "2024-01-10 05:00:00", "2024-01-20 17:00:00"))


@query(
    "SELECT unique_id, ds, round(y, 6) AS y, 'train' AS split FROM hourly WHERE ds BETWEEN TIMESTAMP '2024-01-04 00:00:00' AND TIMESTAMP '2024-01-20 23:00:00'"
    " UNION ALL SELECT unique_id, ds, round(y, 6) AS y, 'test' FROM hourly WHERE ds BETWEEN TIMESTAMP '2024-01-20 00:00:00' AND TIMESTAMP '2024-01-28 23:00:00'",
    "hourly",
)
def train_test_split(spark, sf):
    return rounded(B.train_test_split(fx.hourly(spark, sf), "2024-01-05 00:00:00", "2024-01-20 23:00:00", "2024-01-28 23:00:00", 24))


@query("SELECT unique_id, ds, (month(ds) IN (12, 1, 2, 3) OR (month(ds) = 11 AND day(ds) >= 15)) AS winter FROM daily", "daily")
def is_winter(spark, sf):
    return fx.daily(spark, sf).select("unique_id", "ds", B.is_winter().alias("winter"))


@query("SELECT unique_id, ds, CASE WHEN month(ds) * 100 + day(ds) BETWEEN 321 AND 520 THEN 'Spring' WHEN month(ds) * 100 + day(ds) BETWEEN 521 AND 920 THEN 'Summer' WHEN month(ds) * 100 + day(ds) BETWEEN 921 AND 1220 THEN 'Autumn' ELSE 'Winter' END AS season FROM daily", "daily")
def season_of(spark, sf):
    return fx.daily(spark, sf).select("unique_id", "ds", B.season_of().alias("season"))


@query("SELECT unique_id, ds, round(y, 6) AS y FROM hourly_raw WHERE ds IN (SELECT ds FROM hourly_aux WHERE humidity > 1)", "hourly_raw", "hourly_aux")
def common_timestamps(spark, sf):
    return rounded(B.common_timestamps(fx.hourly_raw(spark, sf), fx.hourly_aux(spark, sf).where("humidity > 1")))


@query("SELECT unique_id, CASE WHEN date_trunc('day', min(ds)) = min(ds) THEN min(ds) ELSE date_trunc('day', min(ds)) + INTERVAL 1 DAY END AS first_start, date_trunc('day', max(ds) - INTERVAL 23 HOUR) + INTERVAL 23 HOUR AS last_end FROM hourly GROUP BY 1", "hourly")
def last_full_day_end(spark, sf):
    return B.last_full_day_end(fx.hourly(spark, sf))


@query("SELECT unique_id, ds, round(y, 6) AS y FROM (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS rn FROM hourly) WHERE rn <= 48", "hourly")
def tail_per_series(spark, sf):
    return rounded(B.tail_per_series(fx.hourly(spark, sf), 48))


@query(f"SELECT unique_id, ds, round(y, 6) AS y, round(lag(y, 1) {W}, 6) AS y_lag1, round(lag(y, 24) {W}, 6) AS y_lag24, round(lag(y, 168) {W}, 6) AS y_lag168 FROM hourly", "hourly")
def add_lags(spark, sf):
    return rounded(C.add_lags(fx.hourly(spark, sf), ["y"], [1, 24, 168]))


@query("SELECT unique_id, ds, round(avg(y) OVER (PARTITION BY unique_id ORDER BY ds ROWS 95 PRECEDING) + 1e-9, 6) AS y_4days_avg, round(avg(y) OVER (PARTITION BY unique_id ORDER BY ds ROWS 5 PRECEDING) + 1e-9, 6) AS y_6hours_avg FROM hourly", "hourly")
def rolling_mean_rows(spark, sf):
    out = C.rolling_mean_rows(fx.hourly(spark, sf), ["y"], [4], [6]).drop("y")
    return rounded(out.withColumns({c: F.col(c) + 1e-9 for c in ("y_4days_avg", "y_6hours_avg")}))  # halves round up in both engines


@query("SELECT unique_id, ds, round(avg(y) OVER (PARTITION BY unique_id ORDER BY ds RANGE BETWEEN INTERVAL 5 HOUR PRECEDING AND CURRENT ROW), 6) AS y_avg6h, round(avg(y) OVER (PARTITION BY unique_id ORDER BY ds RANGE BETWEEN INTERVAL 29 HOUR PRECEDING AND CURRENT ROW), 6) AS y_avg1d6h FROM hourly_raw", "hourly_raw")
def rolling_mean_time(spark, sf):
    return rounded(C.rolling_mean_time(fx.hourly_raw(spark, sf), ["y"], [6, 30]).drop("y"))


@query(f"WITH m AS (SELECT unique_id, ds, avg(y) OVER (PARTITION BY unique_id ORDER BY ds ROWS 23 PRECEDING) AS d, avg(y) OVER (PARTITION BY unique_id ORDER BY ds ROWS 2 PRECEDING) AS h FROM hourly) SELECT unique_id, ds, round(d, 6) AS y_1days_avg, round(h, 6) AS y_3hours_avg, round(lag(d, 24) {W}, 6) AS y_1days_avg_lag1, round(lag(d, 48) {W}, 6) AS y_1days_avg_lag2, round(lag(h, 1) {W}, 6) AS y_3hours_avg_lag1, round(lag(h, 2) {W}, 6) AS y_3hours_avg_lag2 FROM m", "hourly")
def lag_of_rolling(spark, sf):
    return rounded(C.lag_of_rolling(fx.hourly(spark, sf), ["y"], 1, 3, 2).drop("y"))


@query(f"SELECT unique_id, ds, round(y, 6) AS y, round(y - lag(y, 24) {W}, 6) AS y_diff FROM hourly", "hourly")
def seasonal_diff(spark, sf):
    return rounded(C.seasonal_diff(fx.hourly(spark, sf)))


@query(
    "WITH t AS (SELECT unique_id, ds, y, date_diff('hour', TIMESTAMP '2024-01-27 23:00:00', ds) AS h FROM hourly) SELECT unique_id, CAST(h AS INTEGER) AS h, round(y, 5) AS level FROM t WHERE h BETWEEN 1 AND 72",
    "hourly",
)
def undiff24(spark, sf):
    """Differences over three days, summed back: the levels themselves are the oracle."""
    cutoff = B.timestamp("2024-01-27 23:00:00")
    df = C.seasonal_diff(fx.hourly(spark, sf)).withColumn("cutoff", cutoff).withColumn("h", ((C.seconds() - C.seconds(cutoff)) / 3600).cast("int"))
    deltas = df.where("h between 1 and 72").select("unique_id", "cutoff", "h", F.col("y_diff").alias("delta"))
    anchors = df.where("h between -23 and 0").select("unique_id", "cutoff", (F.col("h") + 23).alias("phase"), F.col("y").alias("level"))
    return rounded(C.undiff24(deltas, anchors).select("unique_id", "h", "level"), 5)


_CYCLIC = ", ".join(f"round({f}({x} * {2} * pi() / {p}), 6) AS {n}_{f}" for n, x, p in (("hour", "hour(ds)", 24), ("dow", "(isodow(ds) - 1)", 7), ("month", "(month(ds) - 1)", 12), ("wss", "(CASE isodow(ds) WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 0 END)", 3)) for f in ("sin", "cos"))


@query(f"SELECT unique_id, ds, {_CYCLIC} FROM hourly", "hourly")
def calendar_features(spark, sf):
    return rounded(C.calendar_features(fx.hourly(spark, sf).drop("y")))


_FOURIER = ", ".join(f"round({f}(t * 2 * pi() * {k} / {p}), 6) AS {f}{k}_{p}" for p, most in ((168, 2), (24, 3)) for k in range(1, most + 1) for f in ("sin", "cos"))


@query(f"SELECT unique_id, ds, {_FOURIER} FROM (SELECT *, row_number() {W} AS t FROM hourly)", "hourly")
def fourier_terms(spark, sf):
    return rounded(C.fourier_terms(fx.hourly(spark, sf).drop("y"), 2, 3))


_COLD = "SELECT *, avg(temperature) OVER (PARTITION BY unique_id ORDER BY ds RANGE BETWEEN INTERVAL 95 HOUR PRECEDING AND CURRENT ROW) <= 50 AS is_cold FROM hourly_panel"


@query(f"SELECT unique_id, ds, is_cold FROM ({_COLD})", "hourly_panel")
def cold_flag(spark, sf):
    return C.cold_flag(fx.hourly_panel(spark, sf), threshold=50.0).select("unique_id", "ds", "is_cold")


@query(f"SELECT unique_id, ds, is_cold, round(CASE WHEN is_cold THEN y ELSE 0 END, 6) AS y_cold, round(CASE WHEN NOT is_cold THEN y ELSE 0 END, 6) AS y_warm, round(CASE WHEN is_cold THEN humidity ELSE 0 END, 6) AS humidity_cold, round(CASE WHEN NOT is_cold THEN humidity ELSE 0 END, 6) AS humidity_warm FROM ({_COLD})", "hourly_panel")
def regime_split(spark, sf):
    df = C.cold_flag(fx.hourly_panel(spark, sf), threshold=50.0).drop("temperature")
    return rounded(C.regime_split(df, ["y", "humidity"]))


PEAKS = {"click": [7, 8, 9, 18, 19], "purchase": [6, 7, 20], "error": [12]}


@query("SELECT unique_id, ds, round(y, 6) AS y, p AS is_peak, round(CASE WHEN p THEN temperature ELSE 0 END, 6) AS temperature_peak, round(CASE WHEN NOT p THEN temperature ELSE 0 END, 6) AS temperature_offpeak FROM (SELECT *, isodow(ds) <= 5 AND ((unique_id = 'click' AND hour(ds) IN (7, 8, 9, 18, 19)) OR (unique_id = 'purchase' AND hour(ds) IN (6, 7, 20)) OR (unique_id = 'error' AND hour(ds) = 12)) AS p FROM hourly_panel)", "hourly_panel")
def peak_split(spark, sf):
    return rounded(C.peak_split(fx.hourly_panel(spark, sf).drop("humidity"), ["temperature"], PEAKS))


@query("SELECT unique_id, ds, round(CASE WHEN y <= 60 THEN 20 + 80 / (1 + exp(-0.05 * (y - 60))) ELSE -100 + 320 / (1 + exp(-(0.05 * 40 / 160) * (y - 60))) END, 6) AS s FROM hourly", "hourly")
def piecewise_sigmoid(spark, sf):
    return rounded(fx.hourly(spark, sf).select("unique_id", "ds", C.piecewise_sigmoid(F.col("y"), 20.0, 220.0, 60.0, 0.05).alias("s")))


@query("SELECT unique_id, ds, round(y, 6) AS y FROM (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS rn FROM hourly_gaps) WHERE rn > 30 AND y IS NOT NULL", "hourly_gaps")
def trim_and_drop_nulls(spark, sf):
    return rounded(C.trim_and_drop_nulls(B.fill_gaps(fx.hourly_raw(spark, sf)), 30))


@query(
    "WITH f AS (SELECT unique_id, ds, y >= 5 AS cold, date_trunc('week', ds) AS week FROM hourly),"
    " w AS (SELECT unique_id, week FROM f GROUP BY 1, 2 HAVING count(*) = 168 AND bool_and(cold)),"
    " i AS (SELECT *, week - to_days(CAST(7 * row_number() OVER (PARTITION BY unique_id ORDER BY week) AS INTEGER)) AS island FROM w),"
    " k AS (SELECT unique_id, week FROM (SELECT *, count(*) OVER (PARTITION BY unique_id, island) AS run FROM i) WHERE run >= 3),"
    " s AS (SELECT f.unique_id, f.ds, row_number() OVER (PARTITION BY f.unique_id ORDER BY f.ds) AS rn FROM f JOIN k ON f.unique_id = k.unique_id AND f.week = k.week)"
    " SELECT unique_id, ds, TIMESTAMP '2000-01-03 00:00:00' + to_hours(CAST(rn - 1 AS INTEGER)) AS grid_ds FROM s",
    "hourly",
)
def full_cold_weeks(spark, sf):
    df = fx.hourly(spark, sf).select("unique_id", "ds", (F.col("y") >= 5).alias("is_cold"))
    return C.full_cold_weeks(df).select("unique_id", "ds", "grid_ds")


_LAMBDAS = "(SELECT unique_id, CASE WHEN unique_id = 'click' THEN 0.0 ELSE 0.5 END AS l FROM hourly GROUP BY 1)"


@query(f"SELECT unique_id, ds, round(CASE WHEN l = 0 THEN ln(y) ELSE (pow(y, l) - 1) / l END, 6) AS boxcox, round(ln(y), 6) AS log, round(asinh(y / 2), 6) AS arcsinh2 FROM hourly JOIN {_LAMBDAS} USING (unique_id)", "hourly")
def transform_target(spark, sf):
    df = fx.hourly(spark, sf)
    lambdas = df.select("unique_id").distinct().withColumn("lambda", F.when(F.col("unique_id") == "click", 0.0).otherwise(0.5))
    both = df.withColumn("boxcox", F.col("y")).withColumn("log", D.transformed(F.col("y"), "log")).withColumn("arcsinh2", D.transformed(F.col("y"), "arcsinh2"))
    return rounded(D.transform_target(both, "boxcox", lambdas, "boxcox").drop("y"))


@query("SELECT unique_id, ds, round(y, 6) AS boxcox, round(y, 6) AS arcsinh10 FROM hourly", "hourly")
def inverse_transform(spark, sf):
    """A transform and its inverse: the values themselves are the oracle."""
    df = fx.hourly(spark, sf)
    lambdas = df.select("unique_id").distinct().withColumn("lambda", F.lit(0.3))
    there = D.transform_target(df.withColumnRenamed("y", "boxcox").withColumn("arcsinh10", F.col("boxcox")), "boxcox", lambdas, "boxcox")
    there = D.transform_target(there, "arcsinh10", col="arcsinh10")
    back = D.transform_target(D.transform_target(there, "boxcox", lambdas, "boxcox", inverse=True), "arcsinh10", col="arcsinh10", inverse=True)
    return rounded(back)


_BC = "CASE WHEN l = 0 THEN ln(y) ELSE (pow(y, l) - 1) / CASE WHEN l = 0 THEN 1 ELSE l END END"
_LL = f"-count(*) / 2.0 * ln(var_pop({_BC})) + (l - 1) * sum(ln(y))"


@query(
    f"WITH a AS (SELECT unique_id, k * 0.1 AS l, round({_LL.replace('(l - 1)', '(k * 0.1 - 1)')}, 6) AS ll FROM (SELECT unique_id, y, k, CAST(k * 0.1 AS DOUBLE) AS l FROM hourly, generate_series(-10, 20) t(k)) GROUP BY unique_id, k),"
    " b AS (SELECT unique_id, l AS c FROM (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ll DESC, l) AS rn FROM a) WHERE rn = 1),"
    f" f AS (SELECT unique_id, k, round({_LL.replace('(l - 1)', '(k * 0.01 - 1)')}, 6) AS ll FROM (SELECT h.unique_id, y, k, CAST(k * 0.01 AS DOUBLE) AS l FROM hourly h JOIN b ON b.unique_id = h.unique_id CROSS JOIN generate_series(-110, 210) t(k) WHERE k BETWEEN round((c - 0.1) * 100) AND round((c + 0.1) * 100)) GROUP BY unique_id, k)"
    " SELECT unique_id, round(CAST(k * 0.01 AS DOUBLE), 6) AS lambda FROM (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ll DESC, k) AS rn FROM f) WHERE rn = 1",
    "hourly",
)
def boxcox_lambda_loglik(spark, sf):
    return rounded(D.boxcox_lambda_loglik(fx.hourly(spark, sf)))


@query(
    "WITH b AS (SELECT unique_id, block, avg(y) AS m, stddev_samp(y) AS s FROM (SELECT *, (row_number() OVER (PARTITION BY unique_id ORDER BY ds) - 1) // 365 AS block FROM daily) GROUP BY 1, 2 HAVING count(y) = 365),"
    " p AS (SELECT unique_id, k, s / pow(m, 1 - k * 0.05) AS q FROM b, generate_series(-20, 40) t(k)),"
    " c AS (SELECT unique_id, k, round(stddev_samp(q) / avg(q), 9) AS cv FROM p GROUP BY 1, 2)"
    " SELECT unique_id, round(CAST(k * 0.05 AS DOUBLE), 6) AS lambda FROM (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY cv, k) AS rn FROM c WHERE cv IS NOT NULL) WHERE rn = 1",
    "daily",
)
def boxcox_lambda_guerrero(spark, sf):
    return rounded(D.boxcox_lambda_guerrero(fx.daily(spark, sf)))


_TRAIN = "hourly WHERE ds <= TIMESTAMP '2024-01-20 23:00:00' - INTERVAL 24 HOUR"


@query(f"SELECT unique_id, round(avg(y), 6) AS y_a, round(CASE WHEN stddev_pop(y) = 0 THEN 1 ELSE stddev_pop(y) END, 6) AS y_b FROM {_TRAIN} GROUP BY 1", "hourly")
def fit_scaler(spark, sf):
    return rounded(D.fit_scaler(fx.hourly(spark, sf), ["y"], end_train=B.timestamp("2024-01-20 23:00:00"), gap_hours=24))


@query(f"SELECT h.unique_id, ds, round((y - a) / (b - a + 0.000001) * 2 - 1, 6) AS y FROM hourly h JOIN (SELECT unique_id, min(y) AS a, max(y) AS b FROM {_TRAIN} GROUP BY 1) s ON s.unique_id = h.unique_id", "hourly")
def apply_scaler(spark, sf):
    df = fx.hourly(spark, sf)
    stats = D.fit_scaler(df, ["y"], "minmax", end_train=B.timestamp("2024-01-20 23:00:00"), gap_hours=24)
    return rounded(D.apply_scaler(df, stats, ["y"], "minmax", -1.0, 1.0))


@query("SELECT unique_id, ds, round(y, 6) AS y FROM hourly", "hourly")
def invert_scaler(spark, sf):
    """Scaled and scaled back: the values themselves are the oracle."""
    df = fx.hourly(spark, sf)
    stats = D.fit_scaler(df, ["y"], ddof=1)
    return rounded(D.apply_scaler(D.apply_scaler(df, stats, ["y"]), stats, ["y"], inverse=True))


@query("SELECT unique_id, ds, round(y, 6) AS y, round(CASE WHEN count(*) OVER w = 168 THEN (y - avg(y) OVER w) / (CASE WHEN stddev_pop(y) OVER w = 0 THEN 1 ELSE stddev_pop(y) OVER w END + 0.000001) END, 6) AS y_scaled FROM hourly WINDOW w AS (PARTITION BY unique_id ORDER BY ds ROWS 167 PRECEDING)", "hourly")
def per_window_scaler(spark, sf):
    return rounded(D.per_window_scaler(fx.hourly(spark, sf)))
