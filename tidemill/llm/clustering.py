"""Centroid clustering over zone maps of Hilbert-ordered vectors.

Integer vectors are put on a Hilbert curve over their most varied components, range-partitioned along it and cut
into blocks of consecutive vectors. A block keeps the least and greatest value of every component (its box). In
each round a block first meets the centroids with its box: no vector of it is closer to a centroid than the box
is, and none is further from it than the box's far corner. Centroids whose lower bound is above the least upper
bound cannot be nearest to any vector of the block; only the others are compared exactly, as one matrix product.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable
from .vectors import EXACT, floored, groups, matrix, whole


@dataclass(frozen=True)
class Clustering:
    """``k`` centroids, ``rounds`` of updates, vectors of ``dim`` components times ``scale``; ``seed`` names the first centroids."""

    k: int = 16
    rounds: int = 3
    dim: int = 64
    scale: int = 64
    seed: int = 1


#: Components on the curve and bits of each: a key has curve_dims * curve_bits bits at most.
CURVE_DIMS, CURVE_BITS = 8, 7
#: Vectors of a block.
BLOCK = 256


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of ``cells``, whose entries have ``bits`` bits (Skilling's transform)."""
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    for bit in range(bits - 1, 0, -1):
        below = np.uint64((1 << bit) - 1)
        for i in range(n):
            up = (x[i] >> np.uint64(bit)) & np.uint64(1) == 1
            swap = np.where(up, np.uint64(0), (x[0] ^ x[i]) & below)
            x[0] = np.where(up, x[0] ^ below, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint64)
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where((x[n - 1] >> np.uint64(bit)) & np.uint64(1) == 1, np.uint64((1 << bit) - 1), np.uint64(0))
    x ^= flip
    key = np.zeros(x.shape[1], np.uint64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(bit)) & np.uint64(1))
    return key


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that can be nearest to a vector in the box; ties with the bound stay."""
    low, high, c = low.astype(float), high.astype(float), centroids.astype(float)
    nearest = np.square(np.maximum(np.maximum(low - c, c - high), 0)).sum(axis=1)
    furthest = np.square(np.maximum(np.abs(c - low), np.abs(c - high))).sum(axis=1)
    # bounds of large numbers are rounded: give way by a little
    return np.flatnonzero(nearest * (1 - 1e-9) <= furthest.min())


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smaller of equals) and the squared distance, exactly."""
    reach = int(np.abs(vectors).max(initial=0)) + int(np.abs(centroids).max(initial=0))
    if vectors.shape[1] * reach * reach < EXACT:
        v, c = vectors.astype(float), centroids.astype(float)
        far = (v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)
    else:
        far = np.stack([np.square(vectors - c).sum(axis=1) for c in centroids], axis=1)
    at = far.argmin(axis=1)
    return at, far[np.arange(len(at)), at].astype(np.int64)


def _spread(vectors: DataFrame, dim: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """The most varied components with their least and greatest values."""
    each = vectors.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.var_pop("x").alias("var"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    rows = sorted(each.collect(), key=lambda r: (-r["var"], r["i"]))[: min(CURVE_DIMS, dim)]  # a row a component
    return [r["i"] for r in rows], np.array([r["lo"] for r in rows], float), np.array([r["hi"] for r in rows], float)


def zone_maps(vectors: DataFrame, dim: int, block: int = BLOCK) -> DataFrame:
    """Blocks of ``vectors`` (``id``, ``v``) along the curve: ``ids``, ``vectors`` (int64 matrix), ``low`` and ``high`` (int64).

    Vectors that share a place on the curve are dealt over partitions too, so copies make no hot task.
    """
    id_type = vectors.schema["id"].dataType
    dims, lo, hi = _spread(vectors, dim)
    cells = (1 << CURVE_BITS) - 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1))[:, dims].astype(float)
                at = np.floor((x - lo) / np.maximum(hi - lo, 1) * cells)
                yield pa.record_batch([*batch.columns, pa.array(hilbert(at, CURVE_BITS).astype(np.int64))], names=[*batch.schema.names, "h"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in groups(batches, [], block):
            x = matrix(some["v"]).astype(np.int64)
            ids = pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), some["id"].combine_chunks())
            yield pa.record_batch([ids, *(pa.array([y.tobytes()], pa.binary()) for y in (x, x.min(axis=0), x.max(axis=0)))], names=["ids", "vectors", "low", "high"])

    placed = vectors.mapInArrow(place, T.StructType([T.StructField("id", id_type), T.StructField("v", T.ArrayType(T.LongType())), T.StructField("h", T.LongType())]))
    dealt = placed.withColumn("turn", F.xxhash64(F.monotonically_increasing_id()))
    ordered = dealt.repartitionByRange("h", "turn").sortWithinPartitions("h", "turn").select("id", "v")
    schema = T.StructType([T.StructField("ids", T.ArrayType(id_type)), *(T.StructField(c, T.BinaryType()) for c in ("vectors", "low", "high"))])
    return durable(ordered.mapInArrow(cut, schema), "zones")


def _blocks(batches: Iterator[pa.RecordBatch], dim: int, centroids: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Of every block: ids, vectors, numbers of the nearest centroids, squared distances."""
    for batch in batches:
        for i in range(batch.num_rows):
            low, high = (np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in (2, 3))
            some = candidates(low, high, centroids)
            v = np.frombuffer(batch.column(1)[i].as_py(), np.int64).reshape(-1, dim)
            at, far = nearest(v, centroids[some])
            yield batch.column(0)[i].values, v, some[at], far


def _update(zones: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after a round: floors of the means; a task sends one row a cluster, an empty cluster keeps its centroid."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), object)
        for _, v, at, _ in _blocks(batches, dim, centroids):
            for c in np.unique(at):
                mine = v[at == c]
                count[c] += len(mine)
                total[c] += mine.sum(axis=0)
        for c in np.flatnonzero(count):
            yield pa.record_batch([pa.array([int(c)] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([count[c]] * dim, pa.int64()), pa.array([str(x) for x in total[c]])], names=["cluster", "i", "n", "total"])

    parts = zones.mapInArrow(run, "cluster int, i int, n bigint, total string")
    sums = parts.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    new = centroids.copy()
    for r in sums.collect():  # k * dim rows
        new[r["cluster"], r["i"]] = int(r["total"]) // r["n"]
    return new


def cluster(docs: DataFrame, how: Clustering = Clustering(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row a kept vector: id, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid_sha256``.

    Vectors that are null, have another number of components or one that is null or not finite are left out.
    The first centroids are the vectors with the smallest hash of ``seed:id``; equal ids are told apart by their
    components, null ids take part but are no first centroid. With fewer vectors than ``k`` there are fewer
    centroids. Repeated rows are answered each; an empty table, and one without any id, gives an empty result;
    other columns are not read.
    """
    spark, dim = docs.sparkSession, how.dim
    valid = whole(F.col(vec_col), dim)
    kept = docs.where(valid).select(F.col(id_col).alias("id"), floored(F.col(vec_col), how.scale, valid).alias("v"))
    sha = F.sha2(F.concat_ws(":", F.lit(str(how.seed)), F.col("id").cast("string")).cast("binary"), 256)
    first = kept.where("id is not null").orderBy(sha, "v").limit(how.k).select("v").collect()
    out = f"{id_col} {kept.schema['id'].dataType.simpleString()}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], out)
    zones = zone_maps(kept, dim)
    centroids = np.array([r["v"] for r in first], np.int64)
    for _ in range(how.rounds):
        centroids = _update(zones, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, at, far in _blocks(batches, dim, centroids):
            yield pa.record_batch([ids, pa.array(at.astype(np.int32)), pa.array(far)], names=["id", "cluster", "distance"])

    schema = T.StructType([T.StructField("id", kept.schema["id"].dataType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    found = durable(zones.mapInArrow(run, schema), "clusters")
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    total = sum(sums.values())
    facts = [(int(c), int(s), int(total), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sorted(sums.items())]
    each = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(each), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
