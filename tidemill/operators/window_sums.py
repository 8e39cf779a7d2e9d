"""Sums over the hours before many cutoffs, from running sums by day: the cost does not depend on the windows' length."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import DS, ID, hours


def window_sums(rows: DataFrame, values: Mapping[str, Column], windows: DataFrame, length: int) -> DataFrame:
    """Sum of each of ``values`` over the rows in (cutoff - ``length`` hours, cutoff]: unique_id, cutoff and the sums.

    Rows shrink to one a series and day before they are ordered; a window is the difference of two running sums,
    each with the rows of its own day up to its hour (24 at most). Windows without rows have no sums.
    """
    names = list(values)
    day = F.to_date(DS).alias("day")
    parts = rows.select(ID, DS, day, *[x.alias(n) for n, x in values.items()], F.lit(1).cast("bigint").alias("__n"))
    every = [*names, "__n"]
    days = parts.groupBy(ID, "day").agg(*[F.sum(n).alias(n) for n in every])
    span = days.groupBy(ID).agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    grid = span.select(ID, F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("day"))
    so_far = Window.partitionBy(ID).orderBy("day")
    running = grid.join(days, [ID, "day"], "left").select(ID, F.date_add("day", 1).alias("day"), *[F.sum(F.coalesce(n, F.lit(0))).over(so_far).alias(n) for n in every])
    ends = F.array(F.struct(F.col("cutoff").alias("at"), F.lit(1).alias("sign")), F.struct((F.col("cutoff") - hours(length)).alias("at"), F.lit(-1).alias("sign")))
    edges = windows.select(ID, "cutoff").distinct().select(ID, "cutoff", F.explode(ends).alias("e")).select(ID, "cutoff", "e.*", F.to_date("e.at").alias("day"))
    signed = [(F.col("sign") * F.col(n)).alias(n) for n in every]
    # days before an edge's own; after the last day the running sums stay what they are
    whole = edges.join(span, ID).withColumn("day", F.least("day", F.date_add("hi", 1))).join(running, [ID, "day"]).select(ID, "cutoff", *signed)
    part = parts.join(edges, [ID, "day"]).where(F.col(DS) <= F.col("at")).select(ID, "cutoff", *signed)
    sums = whole.unionByName(part).groupBy(ID, "cutoff").agg(*[F.sum(n).alias(n) for n in every])
    return sums.where(F.col("__n") > 0).drop("__n")
