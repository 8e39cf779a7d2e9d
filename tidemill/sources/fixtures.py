"""Panels derived from the star-schema tables: the inputs of the registered panel queries.

Each has the same definition in Spark (functions below) and in SQL (``CTE``), so that queries and their
oracles start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.panel import clip_lower, fill_gaps, forward_fill

FLOOR = 5.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly sums of event values, one series an event type; hours without events are missing."""
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("unique_id"), hour.alias("ds")).agg(F.sum("value").alias("y"))


def hourly_aux(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly covariates of the same keys."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("unique_id"), hour.alias("ds")).agg(
        F.avg(k).alias("temperature"),
        F.avg("value").alias("dew_point"),
        F.min("value").alias("wind_speed"),
        F.max("value").alias("pressure"),
        F.count_distinct("user_id").cast("double").alias("humidity"),
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap-free hourly panel: filled forward, values under the floor raised to it."""
    return clip_lower(forward_fill(fill_gaps(hourly_raw(spark, sf_dir)), ["y"]), "y", FLOOR)


def hourly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``hourly`` with forward-filled temperature and humidity."""
    aux = forward_fill(fill_gaps(hourly_aux(spark, sf_dir).select("unique_id", "ds", "temperature", "humidity")), ["temperature", "humidity"])
    return hourly(spark, sf_dir).join(aux, ["unique_id", "ds"])


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily order totals by priority, gap-filled and filled forward: six annual cycles."""
    rows = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("unique_id"), F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("ds")).agg(F.sum("o_totalprice").alias("y"))
    return forward_fill(fill_gaps(rows, "day"), ["y"])


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hyper-parameter trial table: numbers, states, objective values and three parameters."""
    digit = F.col("p_partkey") % 10
    state = F.when(digit == 0, "PRUNED").when(digit == 1, "FAIL").otherwise("COMPLETE")
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("number"),
        state.alias("state"),
        F.col("p_retailprice").alias("value"),
        F.col("p_size").alias("params_size"),
        F.col("p_brand").alias("params_brand"),
        F.col("p_type").alias("params_type"),
    )


def intermediate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intermediate losses of trials by epoch."""
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("number"), F.col("l_linenumber").alias("epoch")).agg(F.avg("l_extendedprice").alias("val_loss"))


#: The same panels as SQL common table expressions; each name may use those before it.
CTE = {
    "hourly_raw": "SELECT event_type AS unique_id, date_trunc('hour', ts) AS ds, sum(value) AS y FROM events GROUP BY 1, 2",
    "hourly_aux": "SELECT event_type AS unique_id, date_trunc('hour', ts) AS ds, avg(CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER)) AS temperature, avg(value) AS dew_point, min(value) AS wind_speed, max(value) AS pressure, CAST(count(DISTINCT user_id) AS DOUBLE) AS humidity FROM events GROUP BY 1, 2",
    "hour_grid": "SELECT unique_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ds FROM (SELECT unique_id, min(ds) AS lo, max(ds) AS hi FROM hourly_raw GROUP BY 1)",
    "hourly_gaps": "SELECT g.unique_id, g.ds, r.y FROM hour_grid g LEFT JOIN hourly_raw r ON g.unique_id = r.unique_id AND g.ds = r.ds",
    "hourly": "SELECT unique_id, ds, CASE WHEN f < 5.0 THEN 5.0 ELSE f END AS y FROM (SELECT unique_id, ds, last_value(y IGNORE NULLS) OVER (PARTITION BY unique_id ORDER BY ds ROWS UNBOUNDED PRECEDING) AS f FROM hourly_gaps)",
    "hourly_panel": "SELECT h.unique_id, h.ds, h.y, last_value(a.temperature IGNORE NULLS) OVER w AS temperature, last_value(a.humidity IGNORE NULLS) OVER w AS humidity FROM hourly h LEFT JOIN hourly_aux a ON h.unique_id = a.unique_id AND h.ds = a.ds WINDOW w AS (PARTITION BY h.unique_id ORDER BY h.ds ROWS UNBOUNDED PRECEDING)",
    "daily_raw": "SELECT o_orderpriority AS unique_id, date_trunc('day', o_orderdate) AS ds, sum(o_totalprice) AS y FROM orders GROUP BY 1, 2",
    "daily": "SELECT unique_id, ds, last_value(y IGNORE NULLS) OVER (PARTITION BY unique_id ORDER BY ds ROWS UNBOUNDED PRECEDING) AS y FROM (SELECT g.unique_id, g.ds, r.y FROM (SELECT unique_id, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS ds FROM (SELECT unique_id, CAST(min(ds) AS TIMESTAMP) AS lo, CAST(max(ds) AS TIMESTAMP) AS hi FROM daily_raw GROUP BY 1)) g LEFT JOIN daily_raw r ON g.unique_id = r.unique_id AND g.ds = r.ds)",
    "trials": "SELECT p_partkey AS number, CASE WHEN p_partkey % 10 = 0 THEN 'PRUNED' WHEN p_partkey % 10 = 1 THEN 'FAIL' ELSE 'COMPLETE' END AS state, p_retailprice AS value, p_size AS params_size, p_brand AS params_brand, p_type AS params_type FROM part",
    "intermediate": "SELECT l_partkey AS number, l_linenumber AS epoch, avg(l_extendedprice) AS val_loss FROM lineitem GROUP BY 1, 2",
    # naive backtest: a week of daily cutoffs, day-ahead horizons, three models
    "cutoffs": "SELECT TIMESTAMP '2024-01-23 23:00:00' + to_days(CAST(k AS INTEGER)) AS cutoff FROM generate_series(0, 6) t(k)",
    "cv_long": "SELECT t.unique_id, c.cutoff, t.ds, t.y, m.model, CASE m.model WHEN 'Naive24h' THEN a.y WHEN 'Naive168h' THEN b.y ELSE s.mean24 END AS yhat FROM hourly t JOIN cutoffs c ON t.ds > c.cutoff AND t.ds <= c.cutoff + INTERVAL 24 HOUR CROSS JOIN (SELECT unnest(['Naive24h', 'Naive168h', 'Mean24h']) AS model) m LEFT JOIN hourly a ON a.unique_id = t.unique_id AND a.ds = t.ds - INTERVAL 24 HOUR LEFT JOIN hourly b ON b.unique_id = t.unique_id AND b.ds = t.ds - INTERVAL 168 HOUR LEFT JOIN (SELECT h.unique_id, c.cutoff, avg(h.y) AS mean24 FROM hourly h JOIN cutoffs c ON h.ds > c.cutoff - INTERVAL 24 HOUR AND h.ds <= c.cutoff GROUP BY 1, 2) s ON s.unique_id = t.unique_id AND s.cutoff = c.cutoff",
}
_USES = {
    "hour_grid": ["hourly_raw"],
    "hourly_gaps": ["hour_grid"],
    "hourly": ["hourly_gaps"],
    "hourly_panel": ["hourly", "hourly_aux"],
    "daily": ["daily_raw"],
    "cv_long": ["hourly", "cutoffs"],
}


def _needed(names: list[str]) -> list[str]:
    out: list[str] = []

    def add(name: str) -> None:
        for n in _USES.get(name, []):
            add(n)
        if name not in out:
            out.append(name)

    for name in names:
        add(name)
    return out


def with_panels(sql: str, *names: str) -> str:
    """``sql`` with the named panels (and what they use) in front; ``sql`` may itself begin with more CTEs."""
    head = ", ".join(f"{n} AS ({CTE[n]})" for n in _needed(list(names)))
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head} {body}"
