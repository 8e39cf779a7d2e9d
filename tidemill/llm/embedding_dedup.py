"""Near-duplicate vectors through spherical-cap filters.

A filter is a direction; a vector has it if their inner product is at least a threshold, that is if the vector
lies in the cap around it. Two vectors meet if they share a filter. Directions are structured: after a random
rotation the components are cut into parts, each part has a code of random unit vectors, and a direction is one
code word of each part. So codes of M words make M ** parts directions, of which a vector's are listed part by
part, dropping every beginning that the best remaining words cannot lift to the threshold (list decoding).

Lists of one rotation are long for some vectors and empty for others, so several rotated tables are used. The
threshold and the number of tables are found by simulation for the dimension and the cosine asked for: random
vectors have ``listed`` filters a table on average, and of random pairs exactly at that cosine at least
``recall`` meet. Pairs that meet are then compared exactly, as matrix products.

A pair is counted at the first filter that it shares. A crowded filter is cut into blocks that meet pairwise in
tasks of bounded size; tasks send numbers of links a vector and a spanning forest of the links, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, join_counted
from .components import components
from .simhash import _Forest
from .vectors import groups, matrix, whole

#: Vectors of one filter that meet in one task at most; a filter with more is cut into blocks of so many.
BLOCK = 2048
#: Filters of random vectors: one in so many is shared with any other vector of the table.
APART = 12
#: Words of a code of two parts at most; beyond it, directions have three parts.
WORDS = 1024


@dataclass(frozen=True)
class Caps:
    """Filters for vectors of ``dim`` components: ``tables`` rotated codes of ``words`` words for each of ``parts`` parts."""

    dim: int
    parts: int
    words: int
    tables: int
    threshold: float


@lru_cache(maxsize=64)
def _code(dim: int, parts: int, words: int, table: int) -> tuple[np.ndarray, list[tuple[slice, np.ndarray]]]:
    """Rotation and code words of one table; alike in every process, and made once in each."""
    rng = np.random.default_rng([dim, parts, words, table])
    q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
    cuts = [dim * i // parts for i in range(parts + 1)]
    code = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        c = rng.standard_normal((words, b - a))
        code.append((slice(a, b), np.unique(c / np.linalg.norm(c, axis=1, keepdims=True), axis=0)))
    return q * np.sign(np.diag(r)), code


def decode(x: np.ndarray, caps: Caps, table: int) -> tuple[np.ndarray, np.ndarray]:
    """All directions of a table that the unit rows of ``x`` exceed: numbers of rows and of directions."""
    turn, code = _code(caps.dim, caps.parts, caps.words, table)
    turned = x @ turn
    scores = [turned[:, part] @ words.T for part, words in code]
    rest = [np.zeros(len(x))]
    for s in reversed(scores[1:]):
        rest.append(rest[-1] + s.max(axis=1))
    row, direction, sums = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
    for s, lift in zip(scores, reversed(rest), strict=True):
        reached = sums[:, None] + s[row]
        i, word = np.nonzero(reached >= (caps.threshold * math.sqrt(caps.parts) - lift)[row, None])
        row, direction, sums = row[i], direction[i] * caps.words + word, reached[i, word]
    return row, direction


@lru_cache(maxsize=16)
def calibrated(dim: int, cosine: float, rows: int, listed: float = 4.0, recall: float = 0.995, trials: int = 1000) -> Caps:
    """Filters for ``rows`` vectors, by simulation with fixed seeds: threshold and number of tables; directions grow with the rows."""
    parts = 1 if dim < 4 else 2
    words = 1 << math.ceil(math.log2(max(64, (rows * listed * APART) ** (1 / parts))))
    if words > WORDS and dim >= 24:
        parts, words = 3, 1 << math.ceil(math.log2(max(64, (rows * listed * APART) ** (1 / 3))))
    words = words if parts == 3 else min(words, WORDS)
    rng = np.random.default_rng([dim, rows, trials])

    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    x = unit(rng.standard_normal((trials, dim)))
    aside = rng.standard_normal((trials, dim))
    aside -= (aside * x).sum(axis=1, keepdims=True) * x
    y = cosine * x + math.sqrt(1 - cosine * cosine) * unit(aside) if dim > 1 else x
    some = x[:400]
    length = lambda t: len(decode(some, Caps(dim, parts, words, 1, t), 0)[0]) / len(some)
    # a cap is as wide as the angle asked for at least; in few dimensions fewer directions do
    while length(cosine) > 2 * listed and words > 2:
        words //= 2
    high, low = cosine, cosine
    while length(low) < listed and low > 0.1:
        high, low = low, low - 0.05
    for _ in range(8 if low < high else 0):
        mid = (low + high) / 2
        low, high = (mid, high) if length(mid) >= listed else (low, mid)
    caps, met, tables = Caps(dim, parts, words, 1, low), np.zeros(trials, bool), 0
    each = directions_of(caps)
    while met.mean() < recall:
        a, b = (row * each + direction for row, direction in (decode(v, caps, tables) for v in (x, y)))
        met[np.intersect1d(a, b) // each] = True
        tables += 1
    return Caps(dim, parts, words, tables, low)


def directions_of(caps: Caps) -> int:
    return caps.words**caps.parts


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; powers of two first, so that no square overflows."""
    x = x.astype(np.float64)
    _, e = np.frexp(np.abs(x).max(axis=1, initial=0))
    x = np.ldexp(x, -e[:, None])
    return x / np.sqrt(np.square(x).sum(axis=1, keepdims=True))


def _filters(nodes: DataFrame, cosine: float) -> DataFrame:
    """``label``, ``dim``, ``filter`` and ``node``: the filters of every node."""
    sizes = {r["dim"]: r["n"] for r in nodes.groupBy("label", "dim").count().groupBy("dim").agg(F.max("count").alias("n")).collect()}  # a row a dimension
    # of sizes between powers of two, the codes are alike
    caps = {dim: calibrated(dim, cosine, 1 << (n - 1).bit_length()) for dim, n in sizes.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                dims = part.column(2).to_numpy()
                for dim in np.unique(dims):
                    some = np.flatnonzero(dims == dim)
                    x, c = unit_rows(matrix(part.column(3).take(pa.array(some)))), caps[int(dim)]
                    for table in range(c.tables):
                        row, direction = decode(x, c, table)
                        at = pa.array(some[row])
                        yield pa.record_batch([part.column(0).take(at), part.column(1).take(at), part.column(2).take(at), pa.array(direction + table * directions_of(c))], names=["node", "label", "dim", "filter"])

    kind = nodes.schema["label"].dataType.simpleString()
    return nodes.select("node", "label", "dim", "v").mapInArrow(run, f"node bigint, label {kind}, dim int, filter bigint")


def cell_links(x: np.ndarray, weight: np.ndarray, lists: list[np.ndarray], own: int, side: np.ndarray, cosine: float, rows: int = 512) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """For the vectors that meet at filter ``own``: weights of the partners counted here, and a spanning forest of the links.

    ``lists`` has the filters of each vector; a pair that shares an earlier one is counted there. Vectors of two
    sides meet the other side only.
    """
    n, forest, counts = len(x), _Forest(len(x)), np.zeros(len(x), np.int64)
    two = side.min() != side.max()
    who = np.repeat(np.arange(n), [len(f) for f in lists])
    flat = np.concatenate(lists)
    who, flat = who[flat < own], flat[flat < own]
    names, at, times = np.unique(flat, return_inverse=True, return_counts=True)
    has = np.zeros((n, len(names)), np.float32)
    has[who, at] = 1
    has = has[:, times > 1]
    for first in range(0, n, rows):
        stop = min(first + rows, n)
        link = x[first:stop] @ x.T >= cosine
        link[np.arange(stop - first), np.arange(first, stop)] = False
        if two:
            link &= side[first:stop, None] != side
        here = link & (has[first:stop] @ has.T == 0) if has.shape[1] else link
        counts[first:stop] = here @ weight
        for i in np.flatnonzero(link.any(axis=1)):
            forest.join(first + int(i), np.flatnonzero(link[i]))
    return counts, forest.links


def _compared(cells: DataFrame, cosine: float) -> DataFrame:
    """Rows (``u``, ``v``, null) of a spanning forest and rows (``u``, null, ``n``) of counted links, of cells sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v, n = [], [], []
        for cell in groups(batches, ["label", "dim", "filter", "a", "b"]):
            if cell.num_rows > 1:
                node, x = cell["node"].to_numpy(), unit_rows(matrix(cell["v"]))
                lists = [np.asarray(f, np.int64) for f in cell["filters"].to_pylist()]
                side = cell["own"].to_numpy() if cell["a"][0] != cell["b"][0] else np.zeros(len(node), np.int64)
                counts, forest = cell_links(x, cell["weight"].to_numpy(), lists, cell["filter"][0].as_py(), side, cosine)
                found = np.flatnonzero(counts)
                u += [*node[found].tolist(), *(int(node[i]) for i, _ in forest)]
                v += [*[None] * len(found), *(int(node[j]) for _, j in forest)]
                n += [*counts[found].tolist(), *[None] * len(forest)]
            if len(u) > 10_000:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in (u, v, n)], names=["u", "v", "n"])
                u, v, n = [], [], []
        yield pa.record_batch([pa.array(c, pa.int64()) for c in (u, v, n)], names=["u", "v", "n"])

    return cells.mapInArrow(run, "u bigint, v bigint, n bigint")


def embedding_duplicates(docs: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: id, ``n_links`` (rows of its label with this cosine or more, as found), ``component_id``, ``kept``.

    Vectors that are null, empty or zero, hold a component that is null or not finite, or have no label link with
    nothing; vectors of different lengths do not link. Equal vectors of a label are one node and all linked. Rows
    that repeat an id are answered each; null ids name no component unless it has no other id. An empty table
    gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"), F.col(label_col).alias("label"))
    usable = F.coalesce(F.col("label").isNotNull() & whole(F.col("v")) & F.exists("v", lambda x: x != 0), F.lit(False))
    valid = rows.where(usable)
    nodes = valid.groupBy("label", "v").agg(F.min("id").alias("least"), F.count("*").alias("weight"))
    nodes = durable(nodes.withColumn("dim", F.size("v")).withColumn("node", F.monotonically_increasing_id()), "vectors")
    entries = durable(_filters(nodes, cosine), "filters")
    key, total = ["label", "dim", "filter"], entries.count()
    met = entries.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    shared = durable(join_counted(entries, met, key, total), "shared")
    lists = shared.groupBy("node").agg(F.collect_list("filter").alias("filters"))
    loaded = nodes.select("node", "v", "weight").join(lists, "node")
    # the cell of blocks a <= b holds both; a node meets each other block of its filter once
    dealt = shared.withColumn("own", F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = dealt.select(*key, F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "node").join(loaded, "node")
    ordered = cells.repartition(*key, "a", "b").sortWithinPartitions(*key, "a", "b")
    found = durable(_compared(ordered, cosine), "links")
    counts = found.where("n is not null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("links"))
    roots = components(found.where("v is not null").select("u", "v"))
    named = nodes.select("node", "label", "v", "least", "weight").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = durable(named.join(counts, "node", "left"), "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = join_counted(named, least, ["root"], named.count()).select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id", F.col("weight").alias("n"))
    linked = join_counted(valid, named, ["label", "v"], valid.count()).select("id", "n_links", "component_id")
    alone = rows.where(~usable).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
