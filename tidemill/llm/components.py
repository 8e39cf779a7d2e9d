"""Connected components by alternating star contraction, all on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, join_counted


def _stars(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """Link each node's neighbours to the least of them: its larger neighbours, or the smaller ones and itself.

    A node may have any share of the edges (of which there are ``total``): those of a hub meet their node in many tasks.
    """
    ends = edges.select("u", "v")
    both = ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    met = join_counted(both.where("v > u") if large else both, least, ["u"], 2 * total if large else total)
    out = met.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges``: columns ``u``, ``v`` of any orderable type. Returns ``node`` and ``root``, its least reachable node.

    Every node of an edge has one row, roots included; self-links, nulls and repeated edges are ignored.
    A round contracts every path to about half; each round's edges are written to the shared folder.
    """
    state = durable(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")
    before = None
    while True:
        sign = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == before or not sign[0]:
            break
        before = sign
        state = durable(_stars(state, True, sign[0]), "edges")
        state = durable(_stars(state, False, state.count()), "edges")
    found = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
