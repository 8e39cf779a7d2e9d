"""Residual diagnostics, loss comparisons and significance tests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import DS, ID, timestamp

KEYS = [ID, "model"]


def residuals(cv: DataFrame) -> DataFrame:
    """y - yhat of every finite forecast."""
    e = F.col("y") - F.col("yhat")
    return cv.select(ID, "cutoff", DS, "model", e.alias("residual")).where(F.col("residual").isNotNull() & ~F.isnan("residual") & (F.abs("residual") != float("inf")))


def acf(df: DataFrame, keys: list[str], order: list[str], value: str, max_lag: int) -> DataFrame:
    """Biased autocorrelation at lags 0..max_lag and the band 1.96 / sqrt(n); rows pair up by their place in the series.

    All lags share one window, and sums are taken per series before lags become rows; a series has lags below its length only.
    """
    w = Window.partitionBy(*keys)
    rows = df.select(*dict.fromkeys([*keys, *order]), (F.col(value) - F.avg(value).over(w)).alias("__d"), F.count("*").over(w).alias("__n"))
    lags = range(max_lag + 1)
    products = rows.select(*keys, "__n", *[(F.col("__d") * F.lead("__d", k).over(w.orderBy(*order))).alias(f"__c{k}") for k in lags])
    sums = products.groupBy(*keys).agg(F.max("__n").alias("__n"), *[F.sum(f"__c{k}").alias(f"__c{k}") for k in lags])
    long = sums.select(*keys, "__n", "__c0", F.posexplode(F.array(*[f"__c{k}" for k in lags])).alias("lag", "__c")).where("lag < __n")
    return long.select(*keys, "lag", F.try_divide("__c", "__c0").alias("acf"), (1.96 / F.sqrt("__n")).alias("band"))


def histogram(df: DataFrame, value: str = "residual", bins: int = 30, keys: list[str] = KEYS) -> DataFrame:
    """Density histogram over [min, max] of each group; the last bin is closed; constant groups have one bin of width 0."""
    span = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    bin_no = F.least(F.floor(F.try_divide(F.col(value) - F.col("lo"), width)), F.lit(bins - 1))
    rows = df.join(span, keys).withColumn("bin", F.coalesce(bin_no, F.lit(0)).cast("int"))
    out = rows.groupBy(*keys, "bin").agg(F.count("*").alias("count"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("n").alias("n"))
    return out.select(*keys, "bin", "count", (F.col("lo") + F.col("bin") * width).alias("left_edge"), F.try_divide(F.col("count"), F.col("n") * width).alias("density"))


def kde(df: DataFrame, value: str = "residual", points: int = 400, bins: int = 2000, keys: list[str] = KEYS) -> DataFrame:
    """Gaussian density (Scott's bandwidth) at ``points`` between the 0.5 and 99.5 percentiles.

    Values are counted in ``bins`` fine bins first; the bins of a group are one array, which each point of its grid sums up.
    """
    stats = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.stddev_samp(value).alias("sd"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.percentile(value, F.lit(0.005)).alias("a"), F.percentile(value, F.lit(0.995)).alias("b")
    )
    stats = stats.withColumn("h", F.col("sd") * F.pow("n", F.lit(-0.2))).withColumn("step", (F.col("hi") - F.col("lo")) / bins)
    stats = stats.where("h > 0 AND step > 0")
    bin_no = F.least(F.floor((F.col(value) - F.col("lo")) / F.col("step")), F.lit(bins - 1))
    counts = df.join(stats.select(*keys, "lo", "step"), keys).groupBy(*keys, bin_no.alias("bin")).agg(F.count("*").alias("c"))
    cells = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", "c"))).alias("cells"))  # at most ``bins`` entries
    at = lambda k: F.col("a") + k * (F.col("b") - F.col("a")) / (points - 1)

    def density(x: Column) -> Column:
        z = lambda cell: (x - (F.col("lo") + (cell["bin"] + 0.5) * F.col("step"))) / F.col("h")
        total = F.aggregate("cells", F.lit(0.0), lambda t, cell: t + cell["c"] * F.exp(-0.5 * z(cell) * z(cell)))
        return total / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))

    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.struct(k.alias("k"), at(k).alias("x"), density(at(k)).alias("density")))
    return stats.join(cells, keys).select(*keys, F.inline(grid))


def _pairs(rows: DataFrame, value: str) -> DataFrame:
    """Values of two models side by side at the same place, each pair of models once."""
    a = rows.select(ID, "cutoff", DS, F.col("model").alias("a"), F.col(value).alias("x"))
    b = rows.select(ID, "cutoff", DS, F.col("model").alias("b"), F.col(value).alias("y"))
    return a.join(b, [ID, "cutoff", DS]).where("a < b")


def residual_corr(cv: DataFrame) -> DataFrame:
    """Pearson correlation and R2 (of a simple regression) of the residuals of each pair of models."""
    return _pairs(residuals(cv), "residual").groupBy(ID, "a", "b").agg(F.corr("x", "y").alias("corr"), F.regr_r2("y", "x").alias("r2"))


def error_cooccurrence(cv: DataFrame, q: float = 0.9) -> DataFrame:
    """How often two models err largely together: Jaccard index of |residual| over its q-quantile, plain and by magnitude."""
    rows = residuals(cv).withColumn("residual", F.abs("residual"))
    cut = rows.groupBy(ID, "model").agg(F.percentile("residual", F.lit(q)).alias("cut"))
    flagged = rows.join(cut, [ID, "model"]).withColumn("m", F.when(F.col("residual") > F.col("cut"), F.col("residual")).otherwise(0.0))
    p = _pairs(flagged, "m").groupBy(ID, "a", "b").agg(
        F.count_if((F.col("x") > 0) & (F.col("y") > 0)).alias("both"),
        F.count_if((F.col("x") > 0) | (F.col("y") > 0)).alias("any"),
        F.sum(F.least("x", "y")).alias("shared"),
        F.sum(F.greatest("x", "y")).alias("total"),
    )
    return p.select(ID, "a", "b", F.try_divide("both", "any").alias("jaccard"), F.try_divide("shared", "total").alias("weighted"))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function by a rational approximation (error under 7.5e-8)."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def student_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t by a normal approximation of it (Hill's cornish-fisher form)."""
    g = (df - 1.5) / F.pow(df - 1, F.lit(2.0))
    z = F.sqrt(F.ln(1 + t * t / df) / g)
    return 2 * (1 - normal_cdf(F.coalesce(z, F.lit(0.0))))


def paired_ttest(diffs: DataFrame, value: str = "value", keys: list[str] = (ID, "metric", "model")) -> DataFrame:
    """t statistic, degrees of freedom and p of the mean of paired differences."""
    g = diffs.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
    t = F.try_divide(F.col("mean") * F.sqrt("n"), F.col("sd"))
    out = g.select(*keys, "mean", "n", t.alias("t"), (F.col("n") - 1).cast("double").alias("df"))
    return out.withColumn("p", F.when(F.col("df") > 1.5, student_two_sided(F.col("t"), F.col("df"))))


def diebold_mariano(diffs: DataFrame, h: int, value: str = "value", keys: list[str] = (ID, "metric", "model"), order: str = "cutoff") -> DataFrame:
    """Diebold-Mariano statistic with the small-sample correction of Harvey et al., and its p.

    The long-run variance sums autocovariances up to lag h - 1.
    """
    keys = list(keys)
    n_mean = diffs.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("v"))
    r = acf(diffs, keys, [order], value, h - 1).groupBy(*keys).agg(F.sum(F.when(F.col("lag") == 0, 1.0).otherwise(2.0) * F.col("acf")).alias("s"))
    g = n_mean.join(r, keys)
    n = F.col("n").cast("double")
    dm = F.col("mean") / F.sqrt(F.when(F.col("v") * F.col("s") > 0, F.col("v") * F.col("s") / n))
    corrected = dm * F.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)
    return g.select(*keys, "n", corrected.alias("dm"), student_two_sided(corrected, n - 1).alias("p"))


def loss_deltas(diffs: DataFrame, start: str, end: str) -> DataFrame:
    """Loss differences of the windows whose cutoff lies in a period."""
    return diffs.where(F.col("cutoff").between(timestamp(start), timestamp(end)))


def _draw(name: Column, bound: Column) -> Column:
    """A number from 0 to bound - 1 by hashing a name: repeatable under any partitioning."""
    return F.pmod(F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("bigint"), bound)


def block_bootstrap_mean(diffs: DataFrame, n_boot: int = 1000, block: int | DataFrame = 3, alpha: float = 0.05, value: str = "value", keys: list[str] = (ID, "metric", "model"), order: str = "cutoff", seed: str = "boot") -> DataFrame:
    """Circular block bootstrap of the mean: percentile interval and p = P(|m* - m| >= |m|).

    ``block`` is one length, or a table (keys, block) such as ``optimal_block_length`` makes; a group without one raises.
    Block totals come from prefix sums of the doubled series, so that a replicate has n / block rows, not n; its
    last block is cut to make n values.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys)
    rows = diffs.where(F.col(value).isNotNull()).select(*keys, F.row_number().over(w.orderBy(order)).alias("i"), F.col(value).alias("v"), F.count("*").over(w).alias("n"))
    doubled = rows.withColumn("i", F.explode(F.array(F.col("i"), F.col("i") + F.col("n"))))
    prefix = doubled.select(*keys, F.col("i").cast("bigint").alias("i"), F.sum("v").over(w.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    prefix = prefix.unionByName(rows.select(*keys).distinct().select(*keys, F.lit(0).cast("bigint").alias("i"), F.lit(0.0).alias("s")))
    sizes = rows.groupBy(*keys).agg(F.max("n").alias("n"), F.avg("v").alias("mean"))
    if isinstance(block, DataFrame):
        known = sizes.join(block.select(*keys, F.col("block").alias("__block")), keys, "left")
        length = F.coalesce(F.col("__block"), F.raise_error(F.lit("a group has no block length")).cast("int"))
        sizes = known.withColumn("__block", length)
    else:
        sizes = sizes.withColumn("__block", F.lit(block))
    size = F.col("__block")
    boots = sizes.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b")).select("*", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / size) - 1).cast("int"))).alias("k"))
    name = F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in keys], F.col("b").cast("string"), F.col("k").cast("string"))
    boots = boots.withColumn("start", _draw(name, F.col("n"))).withColumn("stop", F.col("start") + F.least(size, F.col("n") - F.col("k") * size))
    lo, hi = prefix.toDF(*keys, "start", "s0"), prefix.toDF(*keys, "stop", "s1")
    means = boots.join(lo, [*keys, "start"]).join(hi, [*keys, "stop"]).groupBy(*keys, "b").agg((F.sum(F.col("s1") - F.col("s0")) / F.first("n")).alias("m"), F.first("mean").alias("mean"))
    return means.groupBy(*keys).agg(
        F.first("mean").alias("mean"),
        F.percentile("m", F.lit(alpha / 2)).alias("lo"),
        F.percentile("m", F.lit(1 - alpha / 2)).alias("hi"),
        F.avg((F.abs(F.col("m") - F.col("mean")) >= F.abs("mean") - 1e-12).cast("double")).alias("p"),
    )


def optimal_block_length(diffs: DataFrame, value: str = "value", keys: list[str] = (ID, "metric", "model"), order: str = "cutoff") -> DataFrame:
    """Block length for the circular bootstrap after Politis and White, with a flat-top window, rounded up.

    The window ends at twice the last of the first lags whose autocorrelation stands out (2 sqrt(log10 n / n)).
    """
    keys = list(keys)
    n = diffs.groupBy(*keys).agg(F.count(value).alias("n"), F.var_pop(value).alias("v"))
    most = 20
    r = acf(diffs.where(F.col(value).isNotNull()), keys, [order], value, most).join(n, keys)
    out = F.abs("acf") >= 2 * F.sqrt(F.log10(F.col("n").cast("double")) / F.col("n"))
    m = r.where("lag > 0").groupBy(*keys).agg((2 * F.greatest(F.max(F.when(out, F.col("lag"))), F.lit(1))).alias("m"))
    both = r.join(m.withColumn("m", F.coalesce("m", F.lit(2))), keys)
    x = F.col("lag") / F.col("m")
    weight = F.when(x <= 0.5, 1.0).when(x <= 1, 2 * (1 - x)).otherwise(0.0) * F.when(F.col("lag") == 0, 1.0).otherwise(2.0)
    g = both.groupBy(*keys).agg(F.first("n").alias("n"), F.sum(weight * F.col("lag") * F.col("acf")).alias("g"), F.sum(weight * F.col("acf")).alias("s"))
    d = F.nullif(4.0 / 3 * F.col("s") * F.col("s"), F.lit(0.0))
    length = F.pow(2 * F.col("g") * F.col("g") / d, F.lit(1.0 / 3)) * F.pow(F.col("n").cast("double"), F.lit(1.0 / 3))
    return g.select(*keys, F.greatest(F.lit(1), F.least(F.ceil(F.coalesce(length, F.lit(1.0))), F.ceil(3 * F.sqrt("n")))).cast("int").alias("block"))


def holm_adjust(tests: DataFrame, group: list[str], p: str = "p", order: list[str] = (ID, "model")) -> DataFrame:
    """``p_holm``: step-down adjusted p-values within each group; ties take the order of the keys."""
    w = Window.partitionBy(*group)
    i = F.row_number().over(w.orderBy(F.asc_nulls_last(p), *order))
    raw = F.least(F.lit(1.0), (F.count(p).over(w) - i + 1) * F.col(p))
    stepped = tests.withColumn("__i", i).withColumn("__p", raw)
    return stepped.withColumn("p_holm", F.max("__p").over(w.orderBy("__i").rowsBetween(Window.unboundedPreceding, 0))).drop("__i", "__p")
