"""Queries over significance tests, exploration and hyper-parameter trials."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import explore as K
from tidemill.operators import metrics as M
from tidemill.operators import significance as J
from tidemill.operators import trials as L
from tidemill.operators import panel as B
from tidemill.sources import fixtures as fx

from .backtesting import SCORES, cv, scores
from .registry import query, rounded

_RES = "r AS (SELECT unique_id, cutoff, ds, model, y - yhat AS residual FROM cv_long WHERE y - yhat IS NOT NULL AND NOT isnan(y - yhat) AND NOT isinf(y - yhat))"
#: The baseline stands beside each model by a window, so that the scores are read once.
_LD = f"s AS ({SCORES}), w AS (SELECT *, max(CASE WHEN model = 'Naive24h' THEN value END) OVER (PARTITION BY unique_id, cutoff, metric) AS base FROM s), d AS (SELECT unique_id, cutoff, metric, 'LD-' || model AS model, value - base AS value FROM w WHERE model <> 'Naive24h')"


def diffs(spark, sf):
    return M.loss_diffs(scores(spark, sf))


@query(f"WITH {_RES} SELECT unique_id, cutoff, ds, model, round(residual, 6) AS residual FROM r", "cv_long")
def residuals(spark, sf):
    return rounded(J.residuals(cv(spark, sf)))


_ACF = "i AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY {o}) AS i, {v} - avg({v}) OVER (PARTITION BY {k}) AS d, count(*) OVER (PARTITION BY {k}) AS n FROM {t}), c AS (SELECT {ka}, lag, sum(a.d * b.d) AS c, max(a.n) AS n FROM i a CROSS JOIN (SELECT unnest(generate_series(0, {m})) AS lag) JOIN i b ON {on} AND b.i = a.i + lag GROUP BY ALL)"


def _acf_sql(table: str, keys: list[str], order: str, value: str, most: int) -> str:
    return _ACF.format(k=", ".join(keys), o=order, v=value, t=table, ka=", ".join(f"a.{k}" for k in keys), m=most, on=" AND ".join(f"a.{k} = b.{k}" for k in keys))


@query(f"WITH {_RES}, {_acf_sql('r', ['unique_id', 'model'], 'cutoff, ds', 'residual', 24)} SELECT unique_id, model, CAST(lag AS INTEGER) AS lag, round(c / first_value(c) OVER (PARTITION BY unique_id, model ORDER BY lag), 6) AS acf, round(1.96 / sqrt(n), 6) AS band FROM c", "cv_long")
def acf(spark, sf):
    return rounded(J.acf(J.residuals(cv(spark, sf)), ["unique_id", "model"], ["cutoff", "ds"], "residual", 24))


@query(
    f"WITH {_RES}, s AS (SELECT unique_id, model, min(residual) AS lo, max(residual) AS hi, count(*) AS n FROM r GROUP BY 1, 2), b AS (SELECT r.unique_id, r.model, coalesce(least(floor((residual - lo) / nullif((hi - lo) / 30, 0)), 29), 0) AS bin, lo, (hi - lo) / 30 AS w, n FROM r JOIN s ON s.unique_id = r.unique_id AND s.model = r.model)"
    " SELECT unique_id, model, CAST(b.bin AS INTEGER) AS bin, count(*) AS count, round(max(lo) + b.bin * max(w), 5) AS left_edge, round(count(*) / (max(n) * nullif(max(w), 0)), 8) AS density FROM b GROUP BY unique_id, model, b.bin",
    "cv_long",
)
def histogram(spark, sf):
    return rounded(J.histogram(J.residuals(cv(spark, sf))), 5, density=8)


@query(
    f"WITH {_RES}, s AS (SELECT unique_id, model, count(*) AS n, stddev_samp(residual) * pow(count(*), -0.2) AS h, min(residual) AS lo, (max(residual) - min(residual)) / 2000 AS step, quantile_cont(residual, 0.005) AS a, quantile_cont(residual, 0.995) AS b FROM r GROUP BY 1, 2),"
    " c AS (SELECT r.unique_id, r.model, least(floor((residual - lo) / step), 1999) AS bin, count(*) AS c FROM r JOIN s ON s.unique_id = r.unique_id AND s.model = r.model GROUP BY 1, 2, 3)"
    " SELECT s.unique_id, s.model, CAST(k AS INTEGER) AS k, round(any_value(a + k * (b - a) / 49), 5) AS x, round(sum(c.c * exp(-0.5 * pow(((a + k * (b - a) / 49) - (lo + (bin + 0.5) * step)) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 8) AS density FROM s CROSS JOIN (SELECT unnest(generate_series(0, 49)) AS k) JOIN c ON c.unique_id = s.unique_id AND c.model = s.model GROUP BY 1, 2, 3",
    "cv_long",
)
def kde(spark, sf):
    return rounded(J.kde(J.residuals(cv(spark, sf)), points=50), 5, density=8)


_PAIRS = "p AS (SELECT a.unique_id, a.model AS a, b.model AS b, a.{v} AS x, b.{v} AS y FROM {t} a JOIN {t} b ON a.unique_id = b.unique_id AND a.cutoff = b.cutoff AND a.ds = b.ds AND a.model < b.model)"


@query(f"WITH {_RES}, {_PAIRS.format(v='residual', t='r')} SELECT unique_id, a, b, round(corr(x, y), 6) AS corr, round(regr_r2(y, x), 6) AS r2 FROM p GROUP BY 1, 2, 3", "cv_long")
def residual_corr(spark, sf):
    return rounded(J.residual_corr(cv(spark, sf)))


@query(
    f"WITH {_RES}, q AS (SELECT unique_id, model, quantile_cont(abs(residual), 0.9) AS cut FROM r GROUP BY 1, 2), f AS (SELECT r.*, CASE WHEN abs(residual) > cut THEN abs(residual) ELSE 0 END AS m FROM r JOIN q ON q.unique_id = r.unique_id AND q.model = r.model), {_PAIRS.format(v='m', t='f')}"
    " SELECT unique_id, a, b, round(sum(CASE WHEN x > 0 AND y > 0 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN x > 0 OR y > 0 THEN 1 ELSE 0 END), 0), 6) AS jaccard, round(sum(least(x, y)) / nullif(sum(greatest(x, y)), 0), 6) AS weighted FROM p GROUP BY 1, 2, 3",
    "cv_long",
)
def error_cooccurrence(spark, sf):
    return rounded(J.error_cooccurrence(cv(spark, sf)))


@query(f"WITH {_LD} SELECT unique_id, metric, model, round(avg(value), 5) AS mean, count(value) AS n, round(avg(value) * sqrt(count(value)) / stddev_samp(value), 4) AS t, CAST(count(value) - 1 AS DOUBLE) AS df FROM d WHERE metric <> 'me' GROUP BY 1, 2, 3", "cv_long")
def paired_ttest(spark, sf):
    return rounded(J.paired_ttest(diffs(spark, sf).where("metric != 'me'")).drop("p"), 5, t=4)


@query(None)
def diebold_mariano(spark, sf):
    return J.diebold_mariano(diffs(spark, sf), 2)


@query(f"WITH {_LD} SELECT unique_id, cutoff, metric, model, round(value, 5) AS value FROM d WHERE cutoff BETWEEN TIMESTAMP '2024-01-25 00:00:00' AND TIMESTAMP '2024-01-28 23:00:00'", "cv_long")
def loss_deltas(spark, sf):
    return rounded(J.loss_deltas(diffs(spark, sf), "2024-01-25 00:00:00", "2024-01-28 23:00:00"), 5)


_HASH = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"


@query(
    f"WITH {_LD}, e AS (SELECT unique_id, model, cutoff, value FROM d WHERE metric = 'mae'), i AS (SELECT *, row_number() OVER (PARTITION BY unique_id, model ORDER BY cutoff) - 1 AS i, count(*) OVER (PARTITION BY unique_id, model) AS n, avg(value) OVER (PARTITION BY unique_id, model) AS mean FROM e),"
    " b AS (SELECT DISTINCT unique_id, model, n, mean, b, k FROM i CROSS JOIN (SELECT unnest(generate_series(0, 199)) AS b) CROSS JOIN (SELECT unnest(generate_series(0, 2)) AS k)),"
    f" q AS (SELECT *, {_HASH.format(chr(39) + 'boot:' + chr(39) + ' || unique_id || ' + chr(39) + ':mae:' + chr(39) + ' || model || ' + chr(39) + ':' + chr(39) + ' || b || ' + chr(39) + ':' + chr(39) + ' || k')} % n AS start, least(3, n - k * 3) AS len FROM b),"
    " m AS (SELECT q.unique_id, q.model, q.b, sum(i.value) / max(q.n) AS m, max(q.mean) AS mean FROM q CROSS JOIN (SELECT unnest(generate_series(0, 2)) AS j) JOIN i ON i.unique_id = q.unique_id AND i.model = q.model AND i.i = (q.start + j) % q.n WHERE j < q.len GROUP BY 1, 2, 3)"
    " SELECT unique_id, 'mae' AS metric, model, round(max(mean), 5) AS mean, round(quantile_cont(m, 0.025), 5) AS lo, round(quantile_cont(m, 0.975), 5) AS hi, round(avg(CASE WHEN abs(m - mean) >= abs(mean) - 1e-12 THEN 1.0 ELSE 0 END), 5) AS p FROM m GROUP BY 1, 3",
    "cv_long",
)
def block_bootstrap_mean(spark, sf):
    return rounded(J.block_bootstrap_mean(diffs(spark, sf).where("metric = 'mae'"), n_boot=200), 5)


@query(None)
def optimal_block_length(spark, sf):
    return J.optimal_block_length(diffs(spark, sf))


_P = "round(abs(sin(avg(value))), 6)"


@query(
    f"WITH {_LD}, p AS (SELECT unique_id, metric, model, {_P} AS p FROM d GROUP BY 1, 2, 3), i AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY p, unique_id, model) AS i, count(p) OVER (PARTITION BY metric) AS m FROM p)"
    " SELECT unique_id, metric, model, round(p, 5) AS p, round(max(least(1, (m - i + 1) * p)) OVER (PARTITION BY metric ORDER BY i ROWS UNBOUNDED PRECEDING), 5) AS p_holm FROM i",
    "cv_long",
)
def holm_adjust(spark, sf):
    """Step-down adjustment of numbers between 0 and 1 that stand in for p-values, so that SQL can say the whole."""
    p = diffs(spark, sf).groupBy("unique_id", "metric", "model").agg(F.round(F.abs(F.sin(F.avg("value"))), 6).alias("p"))
    return rounded(J.holm_adjust(p, ["metric"]), 5)


_Q = "round(avg(y), 6) AS mean, round(quantile_cont(y, 0.1), 6) AS p10, round(quantile_cont(y, 0.9), 6) AS p90"


@query(f'SELECT unique_id, CAST(month(ds) AS INTEGER) AS "month", CAST(hour(ds) AS INTEGER) AS "hour", {_Q} FROM hourly GROUP BY 1, 2, 3', "hourly")
def daily_profile(spark, sf):
    return rounded(K.daily_profile(fx.hourly(spark, sf)))


@query(f"WITH g AS (SELECT *, CASE WHEN ds BETWEEN TIMESTAMP '2024-01-14 00:00:00' AND TIMESTAMP '2024-01-24 23:00:00' THEN 'late' WHEN ds BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-16 23:00:00' THEN 'early' END AS grp FROM hourly) SELECT unique_id, grp, CAST((isodow(ds) - 1) * 24 + hour(ds) AS INTEGER) AS how, {_Q} FROM g WHERE grp IS NOT NULL GROUP BY 1, 2, 3", "hourly")
def weekly_profile(spark, sf):
    return rounded(K.weekly_profile(fx.hourly(spark, sf), [("early", "2024-01-01 00:00:00", "2024-01-16 23:00:00"), ("late", "2024-01-14 00:00:00", "2024-01-24 23:00:00")]))


@query("SELECT unique_id, 'Winter' AS season, CAST(hour(ds) AS INTEGER) AS \"hour\", round(corr(temperature, y), 6) AS corr, round(regr_slope(y, temperature), 6) AS slope, round(regr_intercept(y, temperature), 5) AS intercept FROM hourly_panel GROUP BY 1, 3", "hourly_panel")
def temp_response(spark, sf):
    return rounded(K.temp_response(fx.hourly_panel(spark, sf)), 6, intercept=5)


_COLS = ("humidity", "temperature", "y")
_PAIR_NAMES = [("humidity", "temperature"), ("humidity", "y"), ("temperature", "y")]


@query(" UNION ALL ".join(f"SELECT unique_id, '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS value FROM hourly_panel GROUP BY 1" for a, b in _PAIR_NAMES), "hourly_panel")
def corr_matrix(spark, sf):
    return rounded(K.corr_matrix(fx.hourly_panel(spark, sf), _COLS))


_RANK = ", ".join(f"rank() OVER (PARTITION BY unique_id ORDER BY {c}) + (count(*) OVER (PARTITION BY unique_id, {c}) - 1) / 2.0 AS {c}" for c in _COLS)


@query(f"WITH k AS (SELECT unique_id, {_RANK} FROM hourly_panel) " + " UNION ALL ".join(f"SELECT unique_id, '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS value FROM k GROUP BY 1" for a, b in _PAIR_NAMES), "hourly_panel")
def corr_matrix_spearman(spark, sf):
    return rounded(K.corr_matrix(fx.hourly_panel(spark, sf), _COLS, "spearman"))


_DAY = "day AS (SELECT unique_id, date_trunc('day', ds) AS ds, round(avg(humidity), 9) AS humidity, round(avg(temperature), 9) AS temperature, round(avg(y), 9) AS y FROM hourly_panel GROUP BY 1, 2)"


@query(f"WITH {_DAY}, k AS (SELECT a.unique_id, " + ", ".join(f"sign(a.{c} - b.{c}) AS {c}" for c in _COLS) + " FROM day a JOIN day b ON a.unique_id = b.unique_id AND a.ds < b.ds) " + " UNION ALL ".join(f"SELECT unique_id, '{a}' AS a, '{b}' AS b, round(sum({a} * {b}) / nullif(sqrt(sum(abs({a})) * sum(abs({b}))), 0), 6) AS value FROM k GROUP BY 1" for a, b in _PAIR_NAMES), "hourly_panel")
def corr_matrix_kendall(spark, sf):
    daily = rounded(B.resample_daily(fx.hourly_panel(spark, sf), _COLS), 9)
    return rounded(K.corr_matrix(daily, _COLS, "kendall"))


@query(None)
def lowess_curve(spark, sf):
    daily = B.resample_daily(fx.hourly_panel(spark, sf), ["temperature", "y"])
    return rounded(K.lowess_curve(daily, "temperature", "y"), 5)


@query(None)
def dynamic_pca(spark, sf):
    out, _ = K.dynamic_pca(fx.hourly_panel(spark, sf), ["y", "temperature", "humidity"])
    return out


@query(None)
def pca_outliers(spark, sf):
    out, _ = K.dynamic_pca(fx.hourly_panel(spark, sf), ["y", "temperature", "humidity"])
    return K.pca_outliers(out)


@query("SELECT ds, " + ", ".join(f"round(max(CASE WHEN unique_id = '{i}' THEN y END), 6) AS \"{i}\"" for i in ("click", "error", "purchase")) + " FROM hourly GROUP BY 1", "hourly")
def pivot_series(spark, sf):
    return rounded(K.pivot_series(fx.hourly(spark, sf), ["click", "error", "purchase"]))


@query("SELECT t.number, state, round(value, 4) AS objective, params_size, params_brand, params_type, CAST(last_epoch AS INTEGER) AS last_epoch FROM trials t LEFT JOIN (SELECT number, max(epoch) + 1 AS last_epoch FROM intermediate GROUP BY 1) i ON i.number = t.number WHERE state = 'COMPLETE'", "trials", "intermediate")
def trials_table(spark, sf):
    return rounded(L.trials_table(fx.trials(spark, sf), fx.intermediate(spark, sf)), 4)


@query("SELECT number, state, round(value, 4) AS value, params_size, params_brand, params_type FROM (SELECT * FROM trials ORDER BY number LIMIT 500) WHERE value < 1000 AND params_size IN (1, 2, 3, 5, 8, 13, 21, 34) AND params_type <> 'PROMO'", "trials")
def trial_filter(spark, sf):
    """The first 500 trials, cheap ones of some sizes, without a type: the limit is the operator's."""
    return rounded(L.trial_filter(fx.trials(spark, sf), 500, F.col("value") < 1000, {"params_size": [1, 2, 3, 5, 8, 13, 21, 34]}, {"params_type": ["PROMO"]}), 4)


_EDGES = "e AS (SELECT list_sort(list_distinct(quantile_cont(params_size, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e FROM trials)"
_BIN = "greatest(len(list_filter(e, lambda v: v < params_size)) - 1, 0)"


@query(f"WITH {_EDGES} SELECT number, CAST({_BIN} AS INTEGER) AS bin FROM trials, e", "trials")
def bin_param(spark, sf):
    return L.bin_param(fx.trials(spark, sf), "params_size").select("number", "bin")


@query(
    f"WITH {_EDGES}, b AS (SELECT t.*, {_BIN} AS bin FROM trials t, e), r AS (SELECT *, rank() OVER (ORDER BY value) AS r, count(*) OVER () AS n FROM b)"
    " SELECT CAST(bin AS INTEGER) AS bin, count(*) AS count, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS median, round(stddev_pop(value), 4) AS std, round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.75), 4) AS p75, round(sum(CASE WHEN r <= greatest(1, ceil(n * 0.1)) THEN 1 ELSE 0 END) / count(*), 4) AS share, round(sum(CASE WHEN r <= 20 THEN 1 ELSE 0 END) / sum(sum(CASE WHEN r <= 20 THEN 1 ELSE 0 END)) OVER (), 4) AS contribution FROM r GROUP BY bin",
    "trials",
)
def marginal_1d(spark, sf):
    trials = fx.trials(spark, sf)
    return rounded(L.marginal_1d(L.bin_param(trials, "params_size"), all_bins=L.bin_list(trials, "params_size")).drop("label"), 4)


@query(
    "WITH b AS (SELECT value, dense_rank() OVER (ORDER BY params_type) - 1 AS bin_a, dense_rank() OVER (ORDER BY params_brand) - 1 AS bin_b FROM trials), g AS (SELECT * FROM (SELECT DISTINCT bin_a FROM b), (SELECT DISTINCT bin_b FROM b))"
    " SELECT CAST(g.bin_a AS INTEGER) AS bin_a, CAST(g.bin_b AS INTEGER) AS bin_b, round(quantile_cont(value, 0.5), 7) AS median, round(avg(value), 7) AS mean, round(stddev_samp(value), 7) AS std, count(value) AS count FROM g LEFT JOIN b ON b.bin_a = g.bin_a AND b.bin_b = g.bin_b GROUP BY 1, 2",
    "trials",
)
def marginal_2d(spark, sf):
    return rounded(L.marginal_2d(fx.trials(spark, sf), "params_type", "params_brand"), 7)


@query(
    "SELECT 'params_size' AS param, count(*) AS n, CAST(sum((state = 'COMPLETE')::INT) AS BIGINT) AS complete, CAST(sum((state = 'PRUNED')::INT) AS BIGINT) AS pruned, CAST(sum((state = 'FAIL')::INT) AS BIGINT) AS failed, round(count(DISTINCT params_size) / count(*), 6) AS unique_ratio, min(params_size)::DOUBLE AS min, quantile_cont(params_size, 0.25)::DOUBLE AS p25, quantile_cont(params_size, 0.5)::DOUBLE AS p50, quantile_cont(params_size, 0.75)::DOUBLE AS p75, max(params_size)::DOUBLE AS max, count(DISTINCT least(floor(params_size / 60.0 * 10), 9)) / 10 AS cell_coverage, round((max(params_size) - min(params_size)) / 60.0, 6) AS span_ratio FROM trials",
    "trials",
)
def param_coverage_numeric(spark, sf):
    return rounded(L.param_coverage_numeric(fx.trials(spark, sf), {"params_size": (0.0, 60.0)}))


@query(
    "WITH c AS (SELECT params_type AS level, count(*) AS c FROM trials GROUP BY 1), p AS (SELECT *, c / sum(c) OVER () AS p FROM c)"
    " SELECT 'params_type' AS param, count(*) AS levels, round(sum(CASE WHEN level IN ('ECONOMY', 'PROMO', 'STANDARD', 'MISSING') THEN 1 ELSE 0 END) / 4, 6) AS coverage, round(max(c) / avg(c), 6) AS imbalance, round(-sum(p * ln(p + 1e-12)) / ln(count(*)), 6) AS entropy_ratio, (SELECT string_agg(level || '=' || c, ', ' ORDER BY c DESC, level) FROM (SELECT * FROM c ORDER BY c DESC, level LIMIT 3)) AS top_levels FROM p",
    "trials",
)
def param_coverage_categorical(spark, sf):
    return rounded(L.param_coverage_categorical(fx.trials(spark, sf), {"params_type": ["ECONOMY", "PROMO", "STANDARD", "MISSING"]}))


@query("SELECT params_type, round(min(value), 4) AS min, round(quantile_cont(value, 0.25), 4) AS q1, round(quantile_cont(value, 0.5), 4) AS median, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.75), 4) AS q3, round(max(value), 4) AS max, round(stddev_samp(value), 4) AS std, count(value) AS count FROM trials GROUP BY 1", "trials")
def value_distribution(spark, sf):
    return rounded(L.value_distribution(fx.trials(spark, sf), keys=["params_type"]), 4)


_BEST = "b AS (SELECT number, epoch AS best_epoch FROM (SELECT *, row_number() OVER (PARTITION BY number ORDER BY val_loss, epoch) AS rn FROM intermediate) WHERE rn = 1)"


@query(f"WITH {_BEST}, g AS (SELECT unnest(generate_series((SELECT min(best_epoch) FROM b), (SELECT max(best_epoch) FROM b))) AS best_epoch) SELECT CAST(g.best_epoch AS INTEGER) AS best_epoch, count(b.number) AS n, (SELECT CAST(quantile_cont(best_epoch, 0.5) AS DOUBLE) FROM b) AS median FROM g LEFT JOIN b ON b.best_epoch = g.best_epoch GROUP BY 1", "intermediate")
def best_epoch_counts(spark, sf):
    return L.best_epoch_counts(fx.intermediate(spark, sf))


@query(
    "WITH i AS (SELECT side, row_number() OVER (PARTITION BY side ORDER BY number) - 1 AS i, value AS v, count(*) OVER (PARTITION BY side) AS n FROM (SELECT *, CASE WHEN params_size <= 10 THEN 1 ELSE 0 END AS side FROM trials)),"
    f" d AS (SELECT i.side, i.n, b, i.i AS k, {_HASH.format(chr(39) + 'region:' + chr(39) + ' || i.side || ' + chr(39) + ':' + chr(39) + ' || b || ' + chr(39) + ':' + chr(39) + ' || i.i')} % i.n AS j FROM i CROSS JOIN (SELECT unnest(generate_series(0, 9999)) AS b)),"
    " m AS (SELECT b, avg(CASE WHEN d.side = 1 THEN v END) AS x, avg(CASE WHEN d.side = 1 THEN v END) - avg(CASE WHEN d.side = 0 THEN v END) AS y FROM d JOIN i ON i.side = d.side AND i.i = d.j GROUP BY 1)"
    " SELECT round((SELECT avg(v) FROM i WHERE side = 1), 4) AS mean, round(quantile_cont(x, 0.025), 4) AS mean_lo, round(quantile_cont(x, 0.975), 4) AS mean_hi, round((SELECT avg(v) FROM i WHERE side = 1) - (SELECT avg(v) FROM i WHERE side = 0), 4) AS diff, round(quantile_cont(y, 0.025), 4) AS diff_lo, round(quantile_cont(y, 0.975), 4) AS diff_hi FROM m",
    "trials",
)
def region_bootstrap(spark, sf):
    return rounded(L.region_bootstrap(fx.trials(spark, sf), F.col("params_size") <= 10, n_boot=10_000), 4)


_ETA = "SELECT '{p}' AS param, (sum(n * m * m) - pow(sum(n * m), 2) / sum(n)) / nullif(sum(s2) - pow(sum(n * m), 2) / sum(n), 0) AS eta2 FROM (SELECT count(*) AS n, avg(value) AS m, sum(value * value) AS s2 FROM {t} GROUP BY bin)"


@query(
    f"WITH {_EDGES}, a AS (SELECT t.*, {_BIN} AS bin FROM trials t, e), b AS (SELECT *, params_brand AS bin FROM trials), c AS (SELECT *, params_type AS bin FROM trials), x AS ({_ETA.format(p='params_size', t='a')} UNION ALL {_ETA.format(p='params_brand', t='b')} UNION ALL {_ETA.format(p='params_type', t='c')})"
    " SELECT param, round(eta2, 6) AS eta2, round(eta2 / sum(eta2) OVER (), 6) AS importance FROM x",
    "trials",
)
def param_importance(spark, sf):
    return rounded(L.param_importance(fx.trials(spark, sf), ["params_size", "params_brand", "params_type"]))


@query("SELECT number, round(value, 4) AS value, round(min(value) OVER (ORDER BY number ROWS UNBOUNDED PRECEDING), 4) AS best FROM trials WHERE state = 'COMPLETE'", "trials")
def best_so_far(spark, sf):
    return rounded(L.best_so_far(fx.trials(spark, sf)), 4)


@query(f"WITH {_BEST}, l AS (SELECT number, val_loss AS last_loss FROM (SELECT *, row_number() OVER (PARTITION BY number ORDER BY epoch DESC) AS rn FROM intermediate) WHERE rn = 1) SELECT b.number, b.best_epoch, round(l.last_loss + 1e-9, 4) AS last_loss, round(avg(i.val_loss) + 1e-9, 4) AS near_best FROM b JOIN l ON l.number = b.number JOIN intermediate i ON i.number = b.number AND abs(i.epoch - b.best_epoch) <= 1 GROUP BY ALL", "intermediate")
def near_best_average(spark, sf):
    out = L.near_best_average(fx.intermediate(spark, sf))
    return rounded(out.withColumns({c: F.col(c) + 1e-9 for c in ("last_loss", "near_best")}), 4)  # halves round up in both engines


@query(
    "SELECT brand, size, CAST(CAST('0x' || substr(sha256('brand=' || brand || ',size=' || size), 1, 16) AS UHUGEINT) % 2147483647 AS BIGINT) AS seed FROM (SELECT DISTINCT p_brand AS brand FROM part), (SELECT DISTINCT p_size AS size FROM part)",
)
def search_space_grid(spark, sf):
    """The grid of all brands and sizes that occur."""
    part = fx.read(spark, sf, "part")
    brands = [r[0] for r in part.select("p_brand").distinct().orderBy("p_brand").collect()]
    sizes = [r[0] for r in part.select("p_size").distinct().orderBy("p_size").collect()]
    return L.search_space_grid(spark, {"brand": brands, "size": sizes}).select("brand", F.col("size").cast("int").alias("size"), "seed")


_U = "(CAST('0x' || substr(md5('study:{}:' || number), 1, 8) AS BIGINT) / 4294967296.0)"


@query(
    "WITH b AS (SELECT min(params_size) AS lo, max(params_size) AS hi, min(value) AS low, max(value) AS high FROM trials) SELECT number, CAST(floor(lo + "
    + _U.format("size")
    + " * (hi - lo + 1)) AS BIGINT) AS size, round(low + "
    + _U.format("price")
    + " * (high - low), 4) AS price, round(exp(ln(low) + "
    + _U.format("rate")
    + " * (ln(high) - ln(low))), 4) AS rate, CAST(CAST('0x' || substr(sha256('study:' || number || ':0'), 1, 16) AS UHUGEINT) % 2147483647 AS BIGINT) AS seed FROM trials, b WHERE state = 'FAIL'",
    "trials",
)
def search_space_random(spark, sf):
    """New random configurations for the trials that failed, within the ranges of all trials."""
    trials = fx.trials(spark, sf)
    lo, hi, low, high = trials.agg(F.min("params_size"), F.max("params_size"), F.min("value"), F.max("value")).first()
    return rounded(L.search_space_random(trials.where("state = 'FAIL'"), {"size": ("int", lo, hi), "price": ("float", low, high), "rate": ("log", low, high)}), 4)
