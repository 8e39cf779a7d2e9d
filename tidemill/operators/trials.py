"""Analytics of hyper-parameter trial tables: number, state, value, params_*; windows run over trials only."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .draws import drawn_sums

#: Of a bootstrap: places whose values share a row, values that a unit of work holds at most (32 MB), and its replicates.
CHUNK, SEGMENT, REPLICATES = 1 << 14, 1 << 22, 200


def trials_table(trials: DataFrame, losses: DataFrame, states: Sequence[str] = ("COMPLETE",), objective: str = "objective") -> DataFrame:
    """Trials of given states with ``last_epoch`` (last reported epoch + 1) and the value under the objective's name."""
    last = losses.groupBy("number").agg((F.max("epoch") + 1).alias("last_epoch"))
    return trials.where(F.col("state").isin(*states)).join(last, "number", "left").withColumnRenamed("value", objective)


def trial_filter(trials: DataFrame, first: int | None = None, where: Column | None = None, include: Mapping[str, Sequence] | None = None, exclude: Mapping[str, Sequence] | None = None) -> DataFrame:
    """The first n trials by number (running ones left out), a predicate, values that must all or must never occur."""
    out = trials.where("state != 'RUNNING'")
    if first is not None:
        out = out.orderBy("number").limit(first)
    if where is not None:
        out = out.where(where)
    for c, values in (include or {}).items():
        out = out.where(F.col(c).isin(*values))
    for c, values in (exclude or {}).items():
        out = out.where(~F.coalesce(F.col(c).isin(*values), F.lit(False)))
    return out


def _bins(edges: Column, x: Column) -> Column:
    """Bin of ``x``: edges below it, less one; bins are closed on the right, the first also on the left."""
    below = F.size(F.filter(edges, lambda e: e < x))
    return F.when(x.isNotNull() & (x >= F.get(edges, F.lit(0))) & (x <= F.try_element_at(edges, F.lit(-1))), F.greatest(below - 1, F.lit(0)))


def bin_edges(df: DataFrame, col: str, bins: int = 5, how: str = "quantile", edges: Sequence[float] | None = None) -> DataFrame:
    """One row with ``edges`` (sorted, distinct): quantiles, equal widths, distinct values, or given edges or quantiles."""
    x = F.col(col).cast("double")
    if how == "custom":
        return df.sparkSession.createDataFrame([(sorted(set(map(float, edges))),)], "edges array<double>")
    if how in ("quantile", "custom_quantile"):
        qs = [i / bins for i in range(bins + 1)] if how == "quantile" else list(edges)
        return df.agg(F.array_sort(F.array_distinct(F.percentile(x, F.array(*map(F.lit, qs))))).alias("edges"))
    if how == "uniform":
        stats = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count_distinct(x).alias("u"))
        n = F.least(F.lit(bins), F.greatest(F.lit(2), F.floor(F.sqrt("u")).cast("int")))
        made = F.transform(F.sequence(F.lit(0), n), lambda i: F.when(i == n, F.col("hi")).otherwise(F.col("lo") + i * (F.col("hi") - F.col("lo")) / n))
        return stats.select(F.array_distinct(made).alias("edges"))
    if how == "unique":
        return df.agg(F.array_sort(F.collect_set(x)).alias("edges"))
    raise ValueError(f"unknown binning {how}")


def _cuts(df: DataFrame, col: str, bins: int, how: str, edges: Sequence[float] | None) -> DataFrame:
    """One row: ``edges``, and ``few``, the sorted values of a column that has at least two and at most ``bins`` of them (else empty)."""
    e = bin_edges(df, col, bins, how, edges)
    if how not in ("quantile", "uniform"):
        return e.withColumn("few", F.array().cast("array<double>"))
    x = F.col(col).cast("double").alias("x")
    least = df.select(x).where("x IS NOT NULL").distinct().orderBy("x").limit(bins + 1)  # one more than may be categories
    few = least.agg(F.array_sort(F.collect_list("x")).alias("few"))
    return e.crossJoin(few.select(F.when(F.size("few").between(2, bins), F.col("few")).otherwise(F.array().cast("array<double>")).alias("few")))  # one row each


def _cut_label(bin_: Column) -> Column:
    """Label of a numeric bin from ``edges`` and ``few``."""
    text = lambda v: F.round(v, 4).cast("string")
    low, high = F.get("edges", bin_), F.get("edges", bin_ + 1)
    interval = F.concat(F.when(bin_ == 0, "[").otherwise("("), text(low), F.lit(", "), text(high), F.lit("]"))
    return F.when(F.size("few") > 0, F.get("few", bin_).cast("string")).when(F.size("edges") < 2, "all").otherwise(interval)


def bin_param(df: DataFrame, col: str, bins: int = 5, how: str = "quantile", edges: Sequence[float] | None = None) -> DataFrame:
    """Adds ``bin`` (from 0) and ``label``; a column without two edges is one bin 'all'.

    Strings, flags, and numbers of at most ``bins`` values (under quantile and uniform) are their own bins. A null
    number has no bin, unless all is one bin.
    """
    if dict(df.dtypes)[col] in ("string", "boolean"):
        labels = df.select(F.col(col).cast("string").alias("__l")).distinct().withColumn("bin", F.dense_rank().over(Window.orderBy("__l")) - 1)
        return df.withColumn("label", F.col(col).cast("string")).join(labels, F.col("label").eqNullSafe(F.col("__l")), "left").drop("__l")
    x = F.col(col).cast("double")
    if how == "unique":
        joined = df.crossJoin(F.broadcast(bin_edges(df, col, bins, how, edges)))  # one row of edges
        number = F.array_position("edges", x) - 1
        return joined.withColumn("bin", number.cast("int")).withColumn("label", x.cast("string")).drop("edges")
    joined = df.crossJoin(F.broadcast(_cuts(df, col, bins, how, edges)))  # one row of edges
    number = F.when(F.size("few") > 0, (F.array_position("few", x) - 1).cast("int")).when(F.size("edges") < 2, F.lit(0)).otherwise(_bins(F.col("edges"), x))
    return joined.withColumn("bin", number).withColumn("label", _cut_label(F.col("bin"))).drop("edges", "few")


def bin_list(df: DataFrame, col: str, bins: int = 5, how: str = "quantile", edges: Sequence[float] | None = None) -> DataFrame:
    """Every ``bin`` and ``label`` that ``bin_param`` may give, those without rows too."""
    if dict(df.dtypes)[col] in ("string", "boolean") or how == "unique":
        return bin_param(df, col, bins, how, edges).select("bin", "label").distinct()
    n = F.when(F.size("few") > 0, F.size("few")).otherwise(F.greatest(F.size("edges") - 1, F.lit(1)))
    cells = _cuts(df, col, bins, how, edges).select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("bin"))
    return cells.select("bin", _cut_label(F.col("bin")).alias("label"))


def marginal_1d(binned: DataFrame, value: str = "value", top_k: int = 20, top_fraction: float = 0.1, min_count: int = 3, all_bins: DataFrame | None = None) -> DataFrame:
    """Per bin: count, mean, median, deviation (population), quartiles, and its part of the best trials (least values).

    ``share`` is the part of a bin's trials among the best fraction, ``contribution`` the bin's part of the best
    ``top_k``; trials that tie with the last of the best count as best. Statistics and share of thin bins are null.
    With ``all_bins`` (from ``bin_list``) bins without trials have a count of 0.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy())
    rank = F.rank().over(Window.orderBy(value))
    # a trial table is small and is the whole window
    ranked = binned.where(F.col(value).isNotNull() & F.col("bin").isNotNull()).withColumn("__n", n).withColumn("__r", rank)
    best_k, best_f = F.col("__r") <= top_k, F.col("__r") <= F.greatest(F.lit(1), F.ceil(F.col("__n") * top_fraction))
    thick = F.count("*") >= min_count
    stats = {"mean": F.avg(value), "median": F.percentile(value, F.lit(0.5)), "std": F.stddev_pop(value), "p25": F.percentile(value, F.lit(0.25)), "p75": F.percentile(value, F.lit(0.75))}
    g = ranked.groupBy("bin", "label").agg(F.count("*").alias("count"), *[F.when(thick, x).alias(c) for c, x in stats.items()], F.count_if(best_k).alias("__k"), F.count_if(best_f).alias("__f"))
    total = F.sum("__k").over(Window.partitionBy())
    share = F.when(F.col("count") >= min_count, F.try_divide("__f", "count"))
    out = g.select("bin", "label", "count", *stats, share.alias("share"), F.try_divide(F.col("__k"), total).alias("contribution"))
    if all_bins is None:
        return out
    known = all_bins.where("bin IS NOT NULL").select("bin", F.col("label").alias("__label"))
    kept = known.join(out, "bin", "left").withColumn("label", F.coalesce("label", "__label")).drop("__label")
    return kept.fillna(0, ["count"]).withColumn("contribution", F.coalesce("contribution", F.when(F.col("count") == 0, 0.0))).select(*out.columns)


def marginal_2d(df: DataFrame, a: str, b: str, value: str = "value", bins: int = 4, how: str = "quantile") -> DataFrame:
    """Median, mean, deviation (sample) and count on the grid of the bins of two parameters; empty cells count 0."""
    one = bin_param(df, a, bins, how).withColumnsRenamed({"bin": "bin_a", "label": "label_a"})
    both = bin_param(one, b, bins, how).withColumnsRenamed({"bin": "bin_b", "label": "label_b"})
    cells = both.groupBy("bin_a", "bin_b").agg(F.percentile(value, F.lit(0.5)).alias("median"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("count"))
    grid = both.select("bin_a").distinct().crossJoin(both.select("bin_b").distinct())  # bins x bins
    return grid.join(cells, ["bin_a", "bin_b"], "left").withColumn("count", F.coalesce("count", F.lit(0).cast("bigint")))


def param_coverage_numeric(trials: DataFrame, params: Mapping[str, tuple[float, float]], bins: int = 10) -> DataFrame:
    """Per numeric parameter: trials by state, distinct share, quantiles, and how much of the declared range is met."""
    names = list(params)
    long = trials.select("number", "state", *[F.col(c).cast("double").alias(c) for c in names]).unpivot(["number", "state"], names, "param", "x").where("x IS NOT NULL")
    low = F.coalesce(*[F.when(F.col("param") == c, F.lit(float(v[0]))) for c, v in params.items()])
    high = F.coalesce(*[F.when(F.col("param") == c, F.lit(float(v[1]))) for c, v in params.items()])
    cell = F.least(F.floor((F.col("x") - low) / (high - low) * bins), F.lit(bins - 1))
    g = long.groupBy("param").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("state") == "COMPLETE").alias("complete"),
        F.count_if(F.col("state") == "PRUNED").alias("pruned"),
        F.count_if(F.col("state") == "FAIL").alias("failed"),
        (F.count_distinct("x") / F.count("*")).alias("unique_ratio"),
        F.min("x").alias("min"),
        F.percentile("x", F.lit(0.25)).alias("p25"),
        F.percentile("x", F.lit(0.5)).alias("p50"),
        F.percentile("x", F.lit(0.75)).alias("p75"),
        F.max("x").alias("max"),
        (F.count_distinct(cell) / bins).alias("cell_coverage"),
    )
    return g.withColumn("span_ratio", (F.col("max") - F.col("min")) / (high - low))


def param_coverage_categorical(trials: DataFrame, params: Mapping[str, Sequence[str]], top: int = 3) -> DataFrame:
    """Per categorical parameter: levels seen, coverage of the declared ones, imbalance, entropy ratio, most frequent levels."""
    names = list(params)
    long = trials.select("number", *[F.col(c).cast("string").alias(c) for c in names]).unpivot(["number"], names, "param", "level").where("level IS NOT NULL")
    counts = long.groupBy("param", "level").agg(F.count("*").alias("c"))
    declared = F.coalesce(*[F.when(F.col("param") == c, F.lit(len(set(v)))) for c, v in params.items()])
    known = F.coalesce(*[F.when(F.col("param") == c, F.col("level").isin(*v)) for c, v in params.items()])
    p = F.col("c") / F.sum("c").over(Window.partitionBy("param"))
    rows = counts.withColumn("p", p).withColumn("known", known)
    first = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "level"))), 1, top)
    g = rows.groupBy("param").agg(
        F.count("*").alias("levels"),
        F.count_if("known").alias("__k"),
        (F.max("c") / F.avg("c")).alias("imbalance"),
        (-F.sum(F.col("p") * F.ln(F.col("p") + 1e-12))).alias("__h"),
        F.concat_ws(", ", F.transform(first, lambda s: F.concat(s["level"], F.lit("="), (-s["c"]).cast("string")))).alias("top_levels"),
    )
    ratio = F.when(F.col("levels") > 1, F.col("__h") / F.ln(F.col("levels").cast("double"))).otherwise(F.lit(0.0))
    return g.select("param", "levels", (F.col("__k") / declared).alias("coverage"), "imbalance", ratio.alias("entropy_ratio"), "top_levels")


def value_distribution(trials: DataFrame, value: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    q = lambda p: F.percentile(value, F.lit(p))
    return trials.groupBy(*keys).agg(F.min(value).alias("min"), q(0.25).alias("q1"), q(0.5).alias("median"), F.avg(value).alias("mean"), q(0.75).alias("q3"), F.max(value).alias("max"), F.stddev_samp(value).alias("std"), F.count(value).alias("count"))


def best_epochs(losses: DataFrame) -> DataFrame:
    """Epoch of least loss of each trial; the first among equals."""
    return losses.groupBy("number").agg(F.min_by("epoch", F.struct("val_loss", "epoch")).alias("best_epoch"))


def best_epoch_counts(losses: DataFrame) -> DataFrame:
    """Trials by best epoch, with zeros in between, and the median best epoch."""
    best = best_epochs(losses)
    span = best.agg(F.min("best_epoch").alias("lo"), F.max("best_epoch").alias("hi"), F.percentile("best_epoch", F.lit(0.5)).alias("median"))
    grid = span.select(F.explode(F.sequence("lo", "hi")).alias("best_epoch"), "median")
    counts = best.groupBy("best_epoch").agg(F.count("*").alias("n"))
    return grid.join(counts, "best_epoch", "left").select("best_epoch", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "median")


def _positions(rows: DataFrame, key: str, order: str, block: int) -> DataFrame:
    """Adds the size ``n`` of the row's group and its place ``i`` from 0 in numeric order; nulls come first.

    Rows are ranked inside blocks of ``block`` numbers; only the counts of blocks, one row a block, meet in a group's task.
    """
    rows = rows.withColumn("__b", F.floor(F.col(order) / block))
    group = Window.partitionBy(key)
    earlier = group.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(key, "__b").agg(F.count("*").alias("__c"))
    counts = counts.select(F.col(key).alias("__key"), F.col("__b").alias("__k"), F.coalesce(F.sum("__c").over(earlier), F.lit(0)).alias("__before"), F.sum("__c").over(group).alias("n"))
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy(key, "__b").orderBy(order)) - 1)
    placed = ranked.join(counts, (F.col(key) == F.col("__key")) & F.col("__b").eqNullSafe(F.col("__k")))
    return placed.select(*[c for c in rows.columns if c != "__b"], "n", (F.col("__before") + F.col("__r")).alias("i"))


def region_bootstrap(trials: DataFrame, region: Column, value: str = "value", n_boot: int = 2_000, alpha: float = 0.05, seed: str = "region", block: int = 1_000) -> DataFrame:
    """Mean of a region and its difference to the rest, each with an interval from independent resamples.

    Draws hash the names of replicate and draw, so results do not depend on partitioning. A unit of work is a side's
    ``REPLICATES`` replicates; the side's values come to it by a shuffle, packed into rows of ``CHUNK`` places, and its draws
    are made and added up where the values are: no draw is moved. A unit holds ``SEGMENT`` values at most; a side with more
    has units for each segment, which make the draws again and add up those that meet their segment.
    """
    side = trials.where(F.col(value).isNotNull()).select(F.when(region, 1).otherwise(0).alias("side"), "number", F.col(value).cast("double").alias("v"))
    start = lambda c, size: (F.col(c) - F.col(c) % size).cast("bigint")
    rows = _positions(side, "side", "number", block).groupBy("side", start("i", CHUNK).alias("first"))
    values = rows.agg(F.array_sort(F.collect_list(F.struct("i", "v"))).getField("v").alias("values")).withColumnRenamed("first", "i")
    chunks = side.groupBy("side").agg(F.count("*").alias("n")).select("side", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(CHUNK).cast("bigint"))).alias("i"))
    units = chunks.select("*", start("i", SEGMENT).alias("segment"), F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1), F.lit(REPLICATES))).alias("b"))
    met = units.join(values.hint("shuffle_hash"), ["side", "i"]).repartition(2 * math.ceil(n_boot / REPLICATES), "side", "segment", "b")

    def draw(unit: pd.DataFrame) -> pd.DataFrame:
        s, n, first, b = (int(unit[c].iloc[0]) for c in ("side", "n", "segment", "b"))
        replicates = range(b, min(b + REPLICATES, n_boot))
        sums = drawn_sums(f"{seed}:{s}", replicates, n, np.concatenate(unit.sort_values("i")["values"].to_list()), first)
        return pd.DataFrame({"side": s, "b": replicates, "m": sums / n})

    parts = met.groupBy("side", "segment", "b").applyInPandas(draw, "side int, b int, m double")
    means = parts.groupBy("b").agg(F.sum(F.when(F.col("side") == 1, F.col("m"))).alias("inside"), F.sum(F.when(F.col("side") == 0, F.col("m"))).alias("outside"))
    means = means.withColumn("diff", F.col("inside") - F.col("outside"))
    q = lambda c, p: F.percentile(c, F.lit(p))
    ci = means.agg(q("inside", alpha / 2).alias("mean_lo"), q("inside", 1 - alpha / 2).alias("mean_hi"), q("diff", alpha / 2).alias("diff_lo"), q("diff", 1 - alpha / 2).alias("diff_hi"))
    point = side.agg(F.avg(F.when(F.col("side") == 1, F.col("v"))).alias("mean"), F.avg(F.when(F.col("side") == 0, F.col("v"))).alias("__o"))
    return point.crossJoin(ci).select("mean", "mean_lo", "mean_hi", (F.col("mean") - F.col("__o")).alias("diff"), "diff_lo", "diff_hi")  # one row each


def param_importance(trials: DataFrame, params: Sequence[str], value: str = "value", bins: int = 5) -> DataFrame:
    """Share of the variance of values that lies between the bins of each parameter, normalised to sum to 1."""
    out = None
    for c in params:
        binned = bin_param(trials.where(F.col(value).isNotNull()), c, bins)
        g = binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.sum(F.col(value) * F.col(value)).alias("s2"))
        total, n = F.sum(F.col("n") * F.col("m")), F.sum("n")
        between = F.sum(F.col("n") * F.col("m") * F.col("m")) - total * total / n
        whole = F.sum("s2") - total * total / n
        one = g.agg(F.lit(c).alias("param"), F.try_divide(between, whole).alias("eta2"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("importance", F.try_divide(F.col("eta2"), F.sum("eta2").over(Window.partitionBy())))  # a row a parameter


def best_so_far(trials: DataFrame, value: str = "value", block: int = 100_000) -> DataFrame:
    """Running best value by trial number.

    A running minimum inside blocks of ``block`` numbers, and the least value of all blocks before: only the block
    minima, one row a block, meet in one task. Trials without a number come first.
    """
    done = trials.where("state = 'COMPLETE'").select("number", F.col(value).alias("value"), F.floor(F.col("number") / block).alias("__b"))
    inside = Window.partitionBy("__b").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    minima = done.groupBy("__b").agg(F.min("value").alias("__m")).select(F.col("__b").alias("__k"), F.min("__m").over(earlier).alias("__before"))
    running = done.withColumn("__r", F.min("value").over(inside)).join(minima, F.col("__b").eqNullSafe(F.col("__k")), "left")
    return running.select("number", "value", F.least("__r", "__before").alias("best"))


def near_best_average(losses: DataFrame, width: int = 1) -> DataFrame:
    """Per trial: mean loss within ``width`` epochs of the best one, the last loss, the best epoch."""
    best = losses.groupBy("number").agg(F.min_by("epoch", F.struct("val_loss", "epoch")).alias("best_epoch"), F.max_by("val_loss", "epoch").alias("last_loss"))
    near = losses.join(best, "number").where(F.abs(F.col("epoch") - F.col("best_epoch")) <= width)
    return near.groupBy("number", "best_epoch", "last_loss").agg(F.avg("val_loss").alias("near_best"))


def _seed(name: Column) -> Column:
    """The first 16 hex digits of sha256, as an unsigned number, modulo 2**31 - 1."""
    digits = F.substring(F.sha2(name.cast("binary"), 256), 1, 16)
    number = F.conv(digits, 16, 10).cast("decimal(20,0)")
    return F.pmod(number, F.lit((1 << 31) - 1).cast("decimal(20,0)")).cast("bigint")


def search_space_grid(spark: SparkSession, space: Mapping[str, Sequence]) -> DataFrame:
    """All combinations of the choices, each with a seed from its sorted ``name=value`` list."""
    out = spark.range(1).select()
    for c in sorted(space):
        out = out.crossJoin(spark.createDataFrame([(v,) for v in space[c]], [c]))
    text = F.concat_ws(",", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in sorted(space)])
    return out.withColumn("seed", _seed(text))


def search_space_random(trials: DataFrame, space: Mapping[str, tuple], study: str = "study", base: int = 0) -> DataFrame:
    """A random configuration for each ``number``: ``space`` maps names to (kind, low, high), kind being int, float or log.

    Draws hash the number, so they do not depend on partitioning or on which other trials there are.
    """
    columns = []
    for c, (kind, low, high) in space.items():
        name = F.concat_ws(":", F.lit(study), F.lit(c), F.col("number").cast("string"))
        u = F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
        x = F.exp(math.log(low) + u * (math.log(high) - math.log(low))) if kind == "log" else low + u * (high - low)
        columns.append((F.floor(low + u * (high - low + 1)) if kind == "int" else x).alias(c))
    seed = _seed(F.concat_ws(":", F.lit(study), F.col("number").cast("string"), F.lit(str(base))))
    return trials.select("number", *columns, seed.alias("seed"))
