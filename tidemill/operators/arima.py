"""Seasonal regression with autoregressive and moving-average errors, and a stepwise search of its orders.

Coefficients come from two regressions (Hannan and Rissanen): a long autoregression of each series gives its
innovations, and a second regression takes their lags as moving-average terms. Both solve normal equations that
Spark sums over all windows at once. Seasonal factors are multiplied out into their lags, and the coefficients of
the products are free. This is no maximum-likelihood fit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.sources.panel_io import scratch_path, written

from .models import _full, _solve, contexts, explode_horizon, normal_equations, z_of
from .panel import DS, ID, series_window
from .transforms import transform_target


@dataclass(frozen=True)
class Order:
    """Orders (p, 0, q)(P, D, Q) of a season of so many hours."""

    p: int = 1
    q: int = 0
    P: int = 1
    Q: int = 1
    D: int = 1
    season: int = 24

    @property
    def ar(self) -> list[int]:
        return lags_of(self.p, self.P, self.season)

    @property
    def ma(self) -> list[int]:
        return lags_of(self.q, self.Q, self.season)


def lags_of(short: int, seasonal: int, season: int) -> list[int]:
    """Lags of the product of a polynomial and a seasonal polynomial."""
    return sorted({i + season * j for i in range(short + 1) for j in range(seasonal + 1)} - {0})


def long_lags(season: int, short: int = 3, seasonal: int = 4) -> list[int]:
    """Lags of the long autoregression: the last hours, and those around each of the last seasons."""
    return sorted({*range(1, short + 1), *(season * j + i for j in range(1, seasonal + 1) for i in range(2))})


def seasonal_difference(df: DataFrame, season: int, columns: Sequence[str]) -> DataFrame:
    """Each of ``columns`` less its value a season before, in place; rows are hourly and without gaps."""
    w = series_window()
    return df.withColumns({c: F.col(c).cast("double") - F.lag(F.col(c).cast("double"), season).over(w) for c in columns})


def innovations(df: DataFrame, plan: DataFrame, lags: Sequence[int], input_size: int) -> DataFrame:
    """Adds ``e``, the errors of an autoregression of ``y`` over ``lags`` (null where a lag is missing).

    It is fitted once a series, on the hours up to the first cutoff of the plan, so no later value is seen.
    """
    w = series_window()
    terms = ["x_one", *(f"x_{k}" for k in lags)]
    rows = df.withColumns({"x_one": F.lit(1.0)} | {f"x_{k}": F.lag("y", k).over(w) for k in lags})
    first = plan.groupBy(ID).agg(F.min("cutoff").alias("cutoff"))
    sums = normal_equations(rows.select(ID, DS, "y", *terms), terms, first, input_size)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            beta = [_solve(_full(a, len(terms)), np.asarray(b, float)).tolist() for a, b in zip(frame["xtx"], frame["xty"], strict=True)]
            yield pd.DataFrame({ID: frame[ID], "beta": beta}, columns=[ID, "beta"])

    fitted = sums.select(ID, "xtx", "xty").mapInPandas(run, f"{ID} string, beta array<double>")
    guess = sum((F.get("beta", F.lit(i)) * F.col(t) for i, t in enumerate(terms[1:], 1)), F.get("beta", F.lit(0)))
    return rows.join(fitted, ID).withColumn("e", F.col("y") - guess).drop("beta", *terms)


def arma_rows(df: DataFrame, ar: Sequence[int], ma: Sequence[int], exog: Sequence[str] = (), k_week: int = 0) -> tuple[DataFrame, list[str]]:
    """Regressors of each row of ``innovations``: intercept, lags of ``y`` and of ``e``, exogenous columns, weekly harmonics."""
    w = series_window()
    t = (F.unix_timestamp(F.col(DS).cast("timestamp")) / 3600) % 168
    terms: dict[str, Column] = {"x_one": F.lit(1.0)} | {f"x_ar{k}": F.lag("y", k).over(w) for k in ar} | {f"x_ma{k}": F.lag("e", k).over(w) for k in ma} | {f"x_{c}": F.col(c).cast("double") for c in exog}
    for k in range(1, k_week + 1):
        terms |= {f"x_s{k}": F.sin(t * (2 * math.pi * k / 168)), f"x_c{k}": F.cos(t * (2 * math.pi * k / 168))}
    return df.select(ID, DS, "y", "e", *[x.alias(n) for n, x in terms.items()]), list(terms)


@dataclass(frozen=True)
class Sarima:
    """An order with its exogenous columns, weekly harmonics, training hours and lags of the long autoregression."""

    order: Order = Order()
    exog: tuple[str, ...] = ()
    k_week: int = 0
    input_size: int = 504
    long: tuple[int, ...] = ()

    def rows(self, df: DataFrame, plan: DataFrame) -> tuple[DataFrame, list[str]]:
        """Differences, innovations and regressors of every hour, written once; the first cutoffs of ``plan`` bound what innovations are fitted on."""
        o = self.order
        flat = seasonal_difference(df, o.season, ["y", *self.exog]) if o.D else df
        flat = written(flat.select(ID, DS, "y", *self.exog), "differences")
        rows, names = arma_rows(innovations(flat, plan, self.long or long_lags(o.season), self.input_size), o.ar, o.ma, self.exog, self.k_week)
        return written(rows, "regressors"), names

    def fit(self, df: DataFrame, fits: DataFrame) -> DataFrame:
        """Coefficients of each (unique_id, cutoff) of ``fits``: ``beta``, ``sigma2`` and ``n``; ``start`` names the first cutoff, of the innovations."""
        return self.fit_rows(*self.rows(df, fits), fits)

    def fit_rows(self, rows: DataFrame, names: Sequence[str], fits: DataFrame) -> DataFrame:
        """``fit`` from the rows of ``rows``."""
        sums = normal_equations(rows, names, fits, self.input_size)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for r in frame.itertuples(index=False):
                    xty = np.asarray(r.xty, float)
                    beta = _solve(_full(r.xtx, len(names)), xty)
                    out.append((getattr(r, ID), r.cutoff, beta.tolist(), max(float(r.yty - beta @ xty), 0.0) / max(r.n - len(names), 1), int(r.n)))
                yield pd.DataFrame(out, columns=[ID, "cutoff", "beta", "sigma2", "n"])

        found = sums.mapInPandas(run, f"{ID} string, cutoff timestamp_ntz, beta array<double>, sigma2 double, n bigint")
        return found.join(fits.groupBy(ID).agg(F.min("cutoff").alias("start")), ID)

    def forecast(self, df: DataFrame, windows: DataFrame, fit: DataFrame, horizon: int) -> DataFrame:
        """unique_id, cutoff, step, ``yhat`` and its deviation ``sd``: ``fit`` has one row a series or one for each ``cutoff`` of ``windows``.

        Contexts with a null or missing hour, and windows whose exogenous values are not known, have no forecast.
        """
        rows, names = self.rows(df, fit.select(ID, F.col("start").alias("cutoff")).distinct())
        return self.forecast_rows(df, rows, names, windows, fit, horizon)

    def forecast_rows(self, df: DataFrame, rows: DataFrame, names: Sequence[str], windows: DataFrame, fit: DataFrame, horizon: int) -> DataFrame:
        """``forecast`` from the rows of ``rows``."""
        o, past = self.order, max([1, *self.order.ar, *self.order.ma])
        keys = [ID, "cutoff"] if "cutoff" in fit.columns else [ID]
        fixed = [n for n in names if not n.startswith(("x_ar", "x_ma"))]
        if fixed == ["x_one"]:  # nothing of the horizon is asked for
            future = windows.select(ID, "cutoff").distinct().withColumn("future", F.array_repeat(F.array(F.lit(1.0)), horizon))
        else:
            ahead = explode_horizon(rows.select(ID, DS, F.array(*fixed).alias("x")), windows, horizon)
            future = ahead.groupBy(ID, "cutoff").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "x"))), lambda s: s["x"]).alias("future"))
        table = windows.select(ID, "cutoff").distinct().join(fit.select(*keys, "beta", "sigma2"), keys).join(future, [ID, "cutoff"])
        table = table.join(contexts(df, windows, o.season + past).withColumnRenamed("context", "level"), [ID, "cutoff"])
        for c in ("y", "e"):
            table = table.join(contexts(rows, windows, past, c).withColumnRenamed("context", f"past_{c}"), [ID, "cutoff"])

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for r in frame.itertuples(index=False):
                    level, y, e = (list(map(float, x)) for x in (r.level, r.past_y, r.past_e))
                    x = np.array([list(v) for v in r.future], float)
                    if len(level) < o.season + past or len(x) < horizon or np.isnan(x).any():
                        continue
                    beta = dict(zip(names, r.beta, strict=True))
                    base, psi, total = x @ [beta[n] for n in fixed], [], []
                    for h in range(horizon):
                        y.append(base[h] + sum(beta[f"x_ar{k}"] * y[-k] for k in o.ar) + sum(beta[f"x_ma{k}"] * e[-k] for k in o.ma))
                        e.append(0.0)
                        level.append(y[-1] + (level[-o.season] if o.D else 0.0))
                        psi.append(1.0 if not h else beta.get(f"x_ma{h}", 0.0) * (h in o.ma) + sum(beta[f"x_ar{k}"] * psi[h - k] for k in o.ar if k <= h))
                        total.append(psi[h] + (total[h - o.season] if o.D and h >= o.season else 0.0))
                        out.append((getattr(r, ID), r.cutoff, h + 1, level[-1], math.sqrt(r.sigma2 * float(np.square(total).sum()))))
                yield pd.DataFrame(out, columns=[ID, "cutoff", "step", "yhat", "sd"])

        return table.mapInPandas(run, f"{ID} string, cutoff timestamp_ntz, step int, yhat double, sd double")


def sarima(df: DataFrame, plan: DataFrame, horizon: int, model: Sarima = Sarima(), levels: Sequence[int] = (), kind: str = "none", lambdas: DataFrame | None = None, name: str = "SARIMA") -> DataFrame:
    """Forecasts of every window of a plan: unique_id, cutoff, step, yhat, model, and ``lo-L`` and ``hi-L`` for each level in percent.

    Windows of one ``fit_group`` share the coefficients of the first of them. With ``kind`` (see ``transform_target``)
    the target is modelled on its scale; forecasts and the ends of intervals are brought back.
    """
    scaled = transform_target(df, kind, lambdas)
    keys = [ID, "fit_group"] if "fit_group" in plan.columns else [ID, "cutoff"]
    firsts = plan.groupBy(*keys).agg(F.min("cutoff").alias("fit_cutoff"))
    windows = written(plan.select(*dict.fromkeys([ID, "cutoff", *keys])).distinct().join(firsts, keys).select(ID, "cutoff", "fit_cutoff"), "windows")
    fits = windows.select(ID, F.col("fit_cutoff").alias("cutoff")).distinct()
    rows, names = model.rows(scaled, fits)
    fitted = written(model.fit_rows(rows, names, fits).withColumnRenamed("cutoff", "fit_cutoff"), "fits")
    found = model.forecast_rows(scaled, rows, names, windows, windows.join(fitted, [ID, "fit_cutoff"]), horizon)
    ends = {f"{side}-{level}": F.col("yhat") + sign * z_of(level) * F.col("sd") for level in levels for side, sign in (("lo", -1), ("hi", 1))}
    found = found.select(ID, "cutoff", "step", "yhat", *[x.alias(n) for n, x in ends.items()])
    for c in ("yhat", *ends):
        found = transform_target(found, kind, lambdas, c, inverse=True)
    return found.select(ID, "cutoff", "step", "yhat", F.lit(name).alias("model"), *[F.col(f"`{n}`") for n in ends])


_NAMES = ("p", "q", "P", "Q")
#: Orders from which a search starts, and the steps to an order's neighbours.
STARTS = ((1, 0, 1, 1), (2, 2, 1, 1), (0, 0, 0, 0), (1, 0, 1, 0), (0, 1, 0, 1))
STEPS = ((1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1), (1, 1, 0, 0), (0, 0, 1, 1))
ORDER = ("ar_short", "ma_short", "ar_season", "ma_season")
CRITERIA = ("loglik", "aic", "aicc", "bic")


def order_sums(df: DataFrame, plan: DataFrame, most: Order, input_size: int = 504) -> tuple[DataFrame, list[str]]:
    """Normal equations with the lags of every order up to ``most``, one row a (unique_id, cutoff): all orders are fitted on the same rows."""
    model = Sarima(most, input_size=input_size)
    rows, names = model.rows(df, plan)
    return written(normal_equations(rows, names, plan, input_size), "sums"), names


def order_criteria(sums: DataFrame, names: Sequence[str], orders: DataFrame, season: int) -> DataFrame:
    """Fits of ``orders`` (unique_id, cutoff and the columns ORDER) from the sums: n, k, sse, loglik, aic, aicc and bic."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                p, q, ps, qs = (getattr(r, c) for c in ORDER)
                has = {"x_one", *(f"x_ar{k}" for k in lags_of(p, ps, season)), *(f"x_ma{k}" for k in lags_of(q, qs, season))}
                some = [i for i, n in enumerate(names) if n in has]
                xty = np.asarray(r.xty, float)[some]
                beta = _solve(_full(r.xtx, len(names))[np.ix_(some, some)], xty)
                out.append((getattr(r, ID), r.cutoff, p, q, ps, qs, int(r.n), len(some) + 1.0, max(float(r.yty - beta @ xty), 1e-9)))
            yield pd.DataFrame(out, columns=[ID, "cutoff", *ORDER, "n", "k", "sse"])

    fits = orders.join(sums, [ID, "cutoff"]).mapInPandas(run, f"{ID} string, cutoff timestamp_ntz, {', '.join(f'{c} int' for c in ORDER)}, n bigint, k double, sse double")
    n, k = F.col("n").cast("double"), F.col("k")
    loglik = -n / 2 * (F.ln(2 * math.pi * F.col("sse") / n) + 1)
    out = fits.withColumn("loglik", loglik).withColumn("aic", 2 * k - 2 * F.col("loglik"))
    return out.withColumn("aicc", F.col("aic") + 2 * k * (k + 1) / F.greatest(n - k - 1, F.lit(1.0))).withColumn("bic", F.col("aic") + k * (F.ln(n) - 2))


def stepwise_orders(df: DataFrame, plan: DataFrame, most: Order = Order(3, 2, 2, 1), input_size: int = 504, current: Order | None = None) -> DataFrame:
    """Every order that a stepwise search by AICc visits: unique_id, cutoff, ORDER, n, k, sse, CRITERIA, ``round``, ``best``, ``current``.

    All series search at once: a round fits the neighbours of the best order of each series that improved in the
    round before, in one job over the sums, and none twice. The search of a series ends when no neighbour of its best
    order is better; orders stay within ``most``. ``current`` is fitted too, for comparison, but is no start.
    """
    sums, names = order_sums(df, plan, most, input_size)
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "orders")
    limits = [getattr(most, n) for n in _NAMES]
    inside = [o for o in STARTS if all(a <= b for a, b in zip(o, limits, strict=True))]

    def orders(options: Sequence[Sequence[int]] | Column) -> Column:
        if isinstance(options, Column):
            return options
        return F.array(*[F.struct(*[F.lit(v).cast("int").alias(c) for v, c in zip(o, ORDER, strict=True)]) for o in options])

    base = sums.select(ID, "cutoff")
    frontier = base.select("*", F.explode(orders(inside)).alias("o")).select(ID, "cutoff", "o.*")
    better = F.min_by(F.struct(*ORDER), F.struct("aicc", "k", *ORDER)).alias("o")
    number = 0
    while True:
        order_criteria(sums, names, frontier, most.season).withColumn("round", F.lit(number)).write.mode("append").parquet(f"{path}/visited")
        visited = spark.read.parquet(f"{path}/visited")
        best = visited.groupBy(ID, "cutoff").agg(better)
        before = visited.where(F.col("round") < number).groupBy(ID, "cutoff").agg(better).withColumnRenamed("o", "was")
        moved = best.join(before, [ID, "cutoff"], "left").where(~F.col("o").eqNullSafe(F.col("was")))
        steps = F.array(*[F.struct(*[(F.col(f"o.{c}") + sign * d).cast("int").alias(c) for c, d in zip(ORDER, step, strict=True)]) for step in STEPS for sign in (1, -1)])
        near = moved.select(ID, "cutoff", F.explode(steps).alias("o")).select(ID, "cutoff", "o.*")
        for c, limit in zip(ORDER, limits, strict=True):
            near = near.where(F.col(c).between(0, limit))
        near.join(visited, [ID, "cutoff", *ORDER], "left_anti").write.parquet(f"{path}/frontier-{number}")
        frontier = spark.read.parquet(f"{path}/frontier-{number}")
        if frontier.isEmpty():
            break
        number += 1
    found = visited.join(best, [ID, "cutoff"]).withColumn("best", F.struct(*ORDER) == F.col("o")).drop("o")
    if current is None:
        return found.withColumn("current", F.lit(False))
    own = [getattr(current, n) for n in _NAMES]
    is_own = F.lit(True)
    for c, v in zip(ORDER, own, strict=True):
        is_own &= F.col(c) == v
    found = found.withColumn("current", is_own)
    asked = base.select("*", F.explode(orders([own])).alias("o")).select(ID, "cutoff", "o.*").join(visited, [ID, "cutoff", *ORDER], "left_anti")
    extra = order_criteria(sums, names, asked, most.season).withColumns({"round": F.lit(None).cast("int"), "best": F.lit(False), "current": F.lit(True)})
    return found.unionByName(extra)


def order_comparison(found: DataFrame) -> DataFrame:
    """Best and current order of a search side by side: unique_id, cutoff, criterion, best, current."""
    long = found.where("best OR current").select(ID, "cutoff", "best", "current", F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(c).alias("value")) for c in CRITERIA])).alias("c"))
    return long.groupBy(ID, "cutoff", F.col("c.criterion").alias("criterion")).agg(F.max(F.when(F.col("best"), F.col("c.value"))).alias("best"), F.max(F.when(F.col("current"), F.col("c.value"))).alias("current"))
