"""Hard negatives by threshold joins over an inverted index of integer vectors.

Anchors meet all rows in blocks. A block of rows is an inverted index: components are ordered by their energy in
the block and cut into segments, and a row has postings for the first segments only. The rest is omitted once its
norm, times the norm of any anchor, is under the lowest threshold: what is omitted cannot reach a threshold by
itself. Anchors accumulate partial scores segment by segment; a row goes as soon as its score plus the product of
the remaining norms is under the anchor's threshold, and what is left is completed exactly.

A search asks for the best rows of every window (lowest score, highest score, same or other label). Thresholds
begin high and are lowered, round by round, for those anchors whose windows are not yet full. A window ends when it
is full or when its threshold is its own lowest score, so its rows are the first ones, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable
from .vectors import floored, groups, matrix, products, whole

#: Components of a segment; rows and anchors of a block.
SEGMENT, ROWS, ANCHORS = 8, 4096, 1024
#: Pairs whose scores are held at a time.
HELD = 1 << 21
#: No limit.
NONE_LOW, NONE_HIGH = -(1 << 62), 1 << 62


@dataclass(frozen=True)
class Mining:
    """How many positives and negatives, and the negatives' scores in percent of the positive's."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    scale: int = 256


class Postings:
    """Inverted index of a block of integer rows; ``cut`` is the norm under which the rest of a row is omitted."""

    def __init__(self, rows: np.ndarray, cut: float):
        self.order = np.argsort(-np.square(rows.astype(float)).sum(axis=0), kind="stable")
        y = rows[:, self.order]
        self.edges = [*range(0, y.shape[1], SEGMENT), y.shape[1]]
        norms = np.cumsum(np.square(y.astype(float))[:, ::-1], axis=1)[:, ::-1]
        # norms of what is left at each edge, and how many segments are indexed
        self.rest = np.sqrt(np.stack([norms[:, e] if e < y.shape[1] else np.zeros(len(y)) for e in self.edges], axis=1))
        depth = (self.rest[:, :-1] >= cut).sum(axis=1)
        self.at = np.argsort(-depth, kind="stable")
        self.rows, self.rest, depth = y[self.at], self.rest[self.at], depth[self.at]
        # rows with postings for a segment come first
        self.filled = [int(np.searchsorted(-depth, -s, "left")) for s in range(len(self.edges) - 1)]
        self.whole = self.rows.astype(float)

    def search(self, anchors: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (anchor, row) with a score of at least the anchor's threshold, and the scores."""
        q = anchors[:, self.order]
        f = q.astype(float)
        norms = np.cumsum(np.square(f)[:, ::-1], axis=1)[:, ::-1]
        rest = np.sqrt(np.stack([norms[:, e] if e < q.shape[1] else np.zeros(len(q)) for e in self.edges], axis=1))
        n = self.filled[0]
        partial = np.zeros((len(q), n))
        segments = len(self.edges) - 1
        half = max(1, segments * 3 // 4)
        for s in range(half):
            a, b = self.edges[s], self.edges[s + 1]
            partial[:, : self.filled[s]] += f[:, a:b] @ self.whole[: self.filled[s], a:b].T
        # a row that stops earlier has its whole remainder as a bound
        stop = np.minimum(half, np.searchsorted(-np.asarray(self.filled), -np.arange(n), "left"))
        bound = np.zeros_like(partial)
        for s in np.unique(stop):
            bound[:, stop == s] = rest[:, s, None] * self.rest[:n][stop == s, s]
        # sums and roots are rounded: give way by a little
        i, j = np.nonzero(partial + bound * (1 + 1e-9) + 1 >= thresholds[:, None])
        if 20 * len(i) > partial.size:
            scores = products(q, self.rows[:n])[i, j]
        else:
            few = HELD // 64
            scores = np.concatenate([np.zeros(0, np.int64), *((q[i[k : k + few]] * self.rows[j[k : k + few]]).sum(axis=1) for k in range(0, len(i), few))])
        good = scores >= thresholds[i]
        return i[good], self.at[j[good]], scores[good]


def best(i: np.ndarray, scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Of pairs, the first ``most`` of each ``i``: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -scores, i))
    turn = np.arange(len(order)) - np.searchsorted(i[order], i[order], "left")
    return order[turn < most]


def _blocks(rows: DataFrame, size: int, name: str, columns: Sequence[str]) -> DataFrame:
    """One row a block of rows of one ``dim``: arrays of ``columns`` and a matrix of ``v``."""
    fields = [T.StructField("dim", T.IntegerType()), *(T.StructField(c, T.ArrayType(rows.schema[c].dataType)) for c in columns), T.StructField("v", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in groups(batches, ["dim"], size):
            flat = matrix(some["v"]).astype(np.int32)
            arrays = [pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), some[c].combine_chunks()) for c in columns]
            yield pa.record_batch([pa.array([some["dim"][0].as_py()], pa.int32()), *arrays, pa.array([flat.tobytes()], pa.binary())], names=["dim", *columns, "v"])

    return durable(rows.select("dim", *columns, "v").sortWithinPartitions("dim").mapInArrow(run, T.StructType(fields)), name)


def search(blocks: DataFrame, anchors: DataFrame, windows: DataFrame, most: int, same: bool) -> DataFrame:
    """The first ``most`` rows of every window: ``anchor``, ``w``, ``score``, ``id``, ``missing``, ``label``.

    ``windows`` has ``anchor``, ``w``, ``low`` and ``high``. Anchors that have a window are put into blocks of
    bounded size; each meets every block of rows of its dimension.
    """
    asked = windows.groupBy("anchor").agg(F.collect_list(F.struct("w", "low", "high")).alias("windows"))
    # blocks are dealt by hash: as many partitions as anchors need
    n = max(1, -(-asked.count() // ANCHORS))
    sides = _blocks(anchors.join(asked, "anchor").repartition(n, "anchor"), ANCHORS, "anchors", ["anchor", "label", "windows"])
    sides = sides.select("dim", F.monotonically_increasing_id().alias("block"), F.col("anchor").alias("anchors"), F.col("label").alias("labels"), "windows", F.col("v").alias("q"))
    # every block of rows meets every block of anchors; rows are salted so that few anchors make many tasks
    salts = max(1, min(blocks.count(), 4 * blocks.sparkSession.sparkContext.defaultParallelism))
    left = blocks.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
    right = sides.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    label_type = anchors.schema["label"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch.column(c)[k] for c in batch.schema.names}
                dim = r["dim"].as_py()
                y, q = (np.frombuffer(r[c].as_py(), np.int32).reshape(-1, dim).astype(np.int64) for c in ("v", "q"))
                names, asked = r["anchors"].values.to_numpy(), r["windows"].as_py()
                who = np.repeat(np.arange(len(asked)), [len(a) for a in asked])
                w, low, high = (np.array([x[c] for a in asked for x in a], np.int64) for c in ("w", "low", "high"))
                least = np.full(len(q), NONE_HIGH, np.int64)
                np.minimum.at(least, who, low)
                norms = np.sqrt(np.square(q.astype(float)).sum(axis=1))
                cut = (least / np.maximum(norms, 1e-9)).min() * (1 - 1e-9)
                index = Postings(y, max(cut, 0.0))
                row, ids, label = r["row"].values.to_numpy(), r["id"].values.to_numpy(), r["label"].values
                missing = r["missing"].values.to_numpy(zero_copy_only=False)
                codes, own = _codes(label, r["labels"].values)
                out = []
                for first in range(0, len(q), max(1, HELD // max(len(y), 1))):
                    part = slice(first, first + max(1, HELD // max(len(y), 1)))
                    i, j, s = index.search(q[part], least[part])
                    i = i + first
                    keep = (names[i] != row[j]) & ((codes[j] == own[i]) == same)
                    i, j, s = i[keep], j[keep], s[keep]
                    # pairs meet the windows of their anchor
                    starts, size = np.searchsorted(who, i, "left"), np.bincount(who, minlength=len(q))[i]
                    at = np.repeat(np.arange(len(i)), size)
                    of = np.repeat(starts, size) + np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
                    keep = (s[at] >= low[of]) & (s[at] <= high[of])
                    at, of = at[keep], of[keep]
                    top = best(of, s[at], ids[j[at]], most)
                    out.append((of[top], j[at[top]], s[at[top]]))
                of, j, s = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.record_batch([pa.array(names[who[of]]), pa.array(w[of].astype(np.int32)), pa.array(s), pa.array(ids[j]), pa.array(missing[j]), label.take(pa.array(j))], names=["anchor", "w", "score", "id", "missing", "label"])

    met = left.join(right, ["dim", "salt"]).select("dim", "row", "id", "missing", "label", "v", "anchors", "labels", "windows", "q")
    schema = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("w", T.IntegerType()), T.StructField("score", T.LongType()), T.StructField("id", T.LongType()), T.StructField("missing", T.BooleanType()), T.StructField("label", label_type)])
    found = met.mapInArrow(run, schema)
    rank = F.row_number().over(Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most)


def _codes(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for labels, equal where the labels are."""
    both = pa.concat_arrays([a, b.cast(a.type)]).dictionary_encode().indices.to_numpy()
    return both[: len(a)], both[len(a) :]


def _lowered(blocks: DataFrame, anchors: DataFrame, windows: DataFrame, thresholds: Sequence[Column], most: int, same: bool, name: str) -> DataFrame:
    """``search`` with one threshold after the other for the windows that are not full; the last must be ``low`` itself."""
    left, done = windows, None
    for k, threshold in enumerate(thresholds):
        last = k == len(thresholds) - 1
        now = left.withColumn("floor", F.col("low") if last else F.greatest("low", threshold.cast("bigint")))
        found = durable(search(blocks, anchors, now.select("anchor", "w", F.col("floor").alias("low"), "high"), most, same), name)
        full = found.groupBy("anchor", "w").agg(F.count("*").alias("n"))
        judged = durable(now.join(full, ["anchor", "w"], "left").withColumn("ended", (F.coalesce("n", F.lit(0)) >= most) | (F.col("floor") <= F.col("low"))), f"{name}-windows")
        whole_ones = found.join(judged.where("ended").select("anchor", "w"), ["anchor", "w"], "left_semi")
        done = whole_ones if done is None else done.unionByName(whole_ones)
        left = judged.where(~F.col("ended")).select(*windows.columns)
        if last or left.isEmpty():
            return done
    raise ValueError("no threshold")


def hard_negatives(docs: DataFrame, is_anchor: Column, how: Mining = Mining(), id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score``.

    ``is_anchor`` tells anchors among the columns of ``docs``. Rows with a null label, a null or empty vector or a
    component that is null or not finite take no part; a row meets rows of as many components. Ids are longs; a null
    id comes last among ties. Repeated rows take part each, and an anchor is not its own positive. Anchors without
    positives, and positives without negatives in the window (all of those with a negative score), have no rows. An
    empty table gives an empty result; other columns are not read.
    """
    last = (1 << 63) - 1
    valid = whole(F.col(vec_col)) & F.col(label_col).isNotNull()
    rows = docs.where(valid).select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(last)).alias("id"), F.col(id_col).isNull().alias("missing"), F.col(label_col).alias("label"), F.size(vec_col).alias("dim"), floored(F.col(vec_col), how.scale, valid).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchors"))
    rows = durable(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    blocks = _blocks(rows, ROWS, "blocks", ["row", "id", "missing", "label"])
    anchors = rows.where("anchors").select(F.col("row").alias("anchor"), "dim", "label", "v")
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    norms = rows.groupBy("dim").agg(F.sqrt(F.max(square("v"))).alias("longest"))
    wanted = anchors.join(F.broadcast(norms), "dim").select("anchor", F.lit(0).alias("w"), F.lit(NONE_LOW).alias("low"), F.lit(NONE_HIGH).alias("high"), (F.sqrt(square("v")) * F.col("longest")).alias("reach"))
    shares = [F.floor(F.col("reach") * c) for c in (0.9, 0.45, 0.25)]
    positives = _lowered(blocks, anchors, wanted, [*shares, F.col("low")], how.positives, True, "positives")
    positives = durable(positives.select("anchor", F.col("rank").alias("w"), F.col("id").alias("positive_id"), F.col("missing").alias("no_positive"), F.col("score").alias("positive_score")), "found")
    # a window below zero is empty, as its lower end is above its upper one
    spans = positives.where("positive_score >= 0").select("anchor", "w", F.expr(f"({how.low} * positive_score + 99) div 100").alias("low"), F.expr(f"({how.high} * positive_score) div 100").alias("high")).where("low <= high")
    steps = [F.floor(F.col("high") * c) for c in (0.8, 0.6)]
    negatives = _lowered(blocks, anchors, spans, [*steps, F.col("low")], how.negatives, False, "negatives")
    chosen = negatives.select("anchor", "w", "rank", F.when(~F.col("missing"), F.col("id")).alias("negative_id"), F.col("score").alias("negative_score"))
    ids = rows.where("anchors").select(F.col("row").alias("anchor"), F.when(~F.col("missing"), F.col("id")).alias("anchor_id"))
    out = chosen.join(positives, ["anchor", "w"]).join(ids, "anchor")
    return out.select("anchor_id", F.when(~F.col("no_positive"), F.col("positive_id")).alias("positive_id"), "rank", "negative_id", "positive_score", "negative_score")
