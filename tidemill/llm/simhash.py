"""SimHash near-duplicates with pigeonring filtering.

A 64-bit fingerprint is cut into ``SEGMENTS`` segments on a ring. If two fingerprints differ in at most
``max_bits`` bits, some segment starts a chain of consecutive segments whose cumulative differences stay
within proportional budgets: l segments of the chain differ in at most l * max_bits / SEGMENTS bits. The head
of the chain keys the candidates:

* ``max_bits`` < SEGMENTS: the first segment is equal, and of b + 1 parts of the second, b being the budget
  of two segments, one is equal too. A key is the first segment with one such part.
* up to 3 * SEGMENTS - 1 bits: the first segment differs in two bits at most. A key is the first segment as it
  is or with one bit flipped, so that two such segments share a key.

The longer prefixes of the chain are checked one after the other, and only survivors meet the full Hamming
check. For wide budgets, which unrelated texts meet by chance, fingerprints have further 64-bit words that
are checked last, and texts whose numbers of distinct shingles differ too much for the similarity are never
compared. Where fingerprints only guess at a Jaccard similarity, their limits are loose and the shingles of both
texts of a link are compared exactly.

Equal fingerprints are one node. A key with many nodes is cut into blocks that meet pairwise in tasks of
bounded size, and each task emits a spanning forest of the links it finds, never all pairs. In a crowded cell a
few pivots first join what is near to them; only nodes outside the largest tree are then compared with all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _mixed, durable, join_counted
from .components import components

BITS = 64
SEGMENTS = 5
MAX_BITS = 4
SHINGLE = 4
SEED = 42
#: Fingerprints of one key that meet in one task at most; larger keys are cut into blocks of so many.
BLOCK = 8192
#: Keys that are cut number at most so many, which bounds their table.
MOST_CUT = 65_536
#: Cells of more nodes are joined around pivots first.
PIVOT_CELL, PIVOTS = 256, 12
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of UTF-8 ``text``: words between white space, A-Z lower-cased; a shorter text is one shingle."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.empty(0, ">u8")
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], ">u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)), ">u8", len(starts))


def majority(hashes: np.ndarray) -> int:
    """SimHash of shingle hashes; 0 without any."""
    counts = np.zeros(BITS, np.int64)
    for first in range(0, len(hashes), 4096):
        part = hashes[first : first + 4096]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of UTF-8 ``text``; 0 without words."""
    return majority(shingles(text, shingle))


@dataclass(frozen=True)
class Likeness:
    """When two texts are linked: ``max_bits`` of the first word of their fingerprints, and ``all_bits`` of all ``words``.

    ``size_ratio`` bounds how the numbers of distinct shingles may differ (0: no bound). With ``jaccard`` a link holds
    only if the sets of shingles are so similar; texts that differ in ``sure_bits`` at most hardly ever are not.
    """

    max_bits: int = MAX_BITS
    words: int = 1
    all_bits: int = MAX_BITS
    size_ratio: float = 0.0
    jaccard: float = 0.0
    sure_bits: int = 0


#: A Jaccard similarity of 0.8 or more. At 0.8, 39 of 256 bits differ on average, with a deviation of 6.
FOUR_FIFTHS = Likeness(max_bits=14, words=4, all_bits=52, size_ratio=0.8, jaccard=0.8, sure_bits=24)
#: Links of one text that are verified in one task at most.
VERIFIED = 256


def sketch(text: bytes, shingle: int, words: int) -> tuple[int, bytes, int]:
    """First word of the fingerprint, the further words, and the number of distinct shingles."""
    hashes = shingles(text, shingle)
    if words == 1:
        return majority(hashes), b"", 0
    plain = hashes.astype(np.uint64)
    more = [majority(_mixed(plain ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).astype(">u8")) for k in range(1, words)]
    return majority(hashes), np.array(more, np.uint64).tobytes(), len(np.unique(plain))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, words: int = 1) -> DataFrame:
    """``id``, ``fp`` (signed 64 bits), ``more`` (further words) and ``size`` of every row; null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).fill_null(b"")
            for first in range(0, len(texts), 4000):
                part = [sketch(t.as_py(), shingle, words) for t in texts[first : first + 4000]]
                fps = np.fromiter((x[0] for x in part), np.uint64, len(part))
                yield pa.record_batch([batch.column(0)[first : first + 4000], pa.array(fps.view(np.int64)), pa.array([x[1] for x in part], pa.binary()), pa.array([x[2] for x in part], pa.int32())], names=["id", "fp", "more", "size"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, fp bigint, more binary, size int")


def segments() -> list[tuple[int, int]]:
    """First bit and width of each segment of the ring."""
    cuts = [BITS * i // SEGMENTS for i in range(SEGMENTS + 1)]
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _budgets(max_bits: int) -> list[list[tuple[np.uint64, int]]]:
    """For each first segment: masks of the chain's growing prefixes and the bits they may differ in."""
    ring, out = segments(), []
    for first in range(SEGMENTS):
        chain, mask = [], 0
        for step in range(SEGMENTS):
            at, width = ring[(first + step) % SEGMENTS]
            mask |= ((1 << width) - 1) << at
            chain.append((np.uint64(mask), (step + 1) * max_bits // SEGMENTS))
        out.append(chain)
    return out


def _bits(at: int, width: int) -> Column:
    return F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1))


def _keys(max_bits: int) -> Column:
    """Keys of a fingerprint: an array of (first segment's number, ``key``, ``flip``); flip is 0 unless a bit was flipped."""
    out, ring = [], segments()
    for s, (at, width) in enumerate(ring):
        first = _bits(at, width)
        if max_bits < SEGMENTS:
            start, wide = ring[(s + 1) % SEGMENTS]
            parts = 2 * max_bits // SEGMENTS + 1
            cuts = [wide * i // parts for i in range(parts + 1)]
            keys = [(F.shiftleft(first * parts + k, 32) + _bits(start + a, b - a), 0) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
        elif max_bits < 3 * SEGMENTS:
            keys = [(first, 0)] + [(first.bitwiseXOR(F.lit(1 << b)), b + 1) for b in range(width)]
        else:
            raise ValueError(f"at most {3 * SEGMENTS - 1} bits")
        out += [F.struct(F.lit(s).alias("s"), k.cast("long").alias("key"), F.lit(f).alias("flip")) for k, f in keys]
    return F.array(*out)


class _Forest:
    """Joins classes of a small array of nodes; keeps one link for each join."""

    def __init__(self, n: int):
        self.label, self.links = np.arange(n), []

    def join(self, i: int, others: np.ndarray) -> None:
        new = others[self.label[others] != self.label[i]]
        if not len(new):
            return
        labels, at = np.unique(self.label[new], return_index=True)
        self.links += [(i, int(new[a])) for a in at]
        self.label[np.isin(self.label, labels)] = self.label[i]


class Cell:
    """Nodes that share a key: arrays of first words, further words, sizes, flips and sides (blocks)."""

    def __init__(self, fp: np.ndarray, more: np.ndarray, size: np.ndarray, flip: np.ndarray, side: np.ndarray, chain: list, like: Likeness):
        self.fp, self.more, self.size, self.flip, self.side, self.chain, self.like = fp, more, size, flip, side, chain, like
        self.two_sides = side.min() != side.max()

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs are linked."""
        return self.within(i, j, self.like.all_bits)[0]

    def within(self, i: np.ndarray, j: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs differ in at most ``limit`` bits of all, and in how many."""
        good = np.arange(len(i))
        differ = self.fp[i] ^ self.fp[j]
        for mask, most in self.chain:
            keep = np.bitwise_count(differ & mask) <= most
            good, differ = good[keep], differ[keep]
        i, j = i[good], j[good]
        keep = np.minimum(self.size[i], self.size[j]) >= self.like.size_ratio * np.maximum(self.size[i], self.size[j])
        total = np.bitwise_count(differ) + np.bitwise_count(self.more[i] ^ self.more[j]).sum(axis=1, dtype=np.int64)
        keep &= total <= limit
        return good[keep], total[keep]

    def links(self) -> list[tuple[int, int]]:
        """Index pairs: a spanning forest of the links in the cell, the closest pairs first if they are to be verified."""
        n = len(self.fp)
        # segments that are equal meet where nothing is flipped
        if n < 2 or self.flip.min() == self.flip.max() > 0:
            return []
        forest, like = _Forest(n), self.like
        if not like.jaccard:
            self._join(forest, like.all_bits)
            return forest.links
        self._join(forest, like.sure_bits)
        labels, count = np.unique(forest.label, return_counts=True)
        rest = np.flatnonzero(forest.label != labels[count.argmax()])
        found = list(self._pairs(forest, rest, like.all_bits))
        if found:
            i, j, bits = (np.concatenate(x) for x in zip(*found, strict=True))
            for k in np.argsort(bits, kind="stable"):
                forest.join(int(i[k]), j[k : k + 1])
        return forest.links

    def _join(self, forest: _Forest, limit: int) -> None:
        """Join all pairs within ``limit``."""
        n, rest = len(self.fp), np.arange(len(self.fp))
        if n > PIVOT_CELL:
            for _ in range(PIVOTS):
                i = int(rest[0])
                others = np.flatnonzero(forest.label != forest.label[i])
                forest.join(i, others[self.within(np.full(len(others), i), others, limit)[0]])
                labels, count = np.unique(forest.label, return_counts=True)
                rest = np.flatnonzero(forest.label != labels[count.argmax()])
                if not len(rest):
                    return
                rest = np.roll(rest, -(len(rest) // 2))
        for i, j, _ in self._pairs(forest, rest, limit):
            by = np.argsort(i, kind="stable")
            i, j = i[by], j[by]
            cuts = np.flatnonzero(np.diff(i)) + 1
            for x, y in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(i)]]), strict=True):
                if y > x:
                    forest.join(int(i[x]), j[x:y])

    def _pairs(self, forest: _Forest, rest: np.ndarray, limit: int, rows: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of a node of ``rest`` with any other that are within ``limit`` and not joined yet, with their bits."""
        n = len(self.fp)
        order = np.argsort(self.size, kind="stable")
        sizes, waits = self.size[order], np.zeros(n, bool)
        waits[rest] = True
        turn = order[waits[order]]
        mask, most = self.chain[1]
        for first in range(0, len(turn), rows):
            some = turn[first : first + rows]
            low, high = self.size[some[0]], self.size[some[-1]]
            ratio = self.like.size_ratio
            a, b = (0, n) if not ratio else (np.searchsorted(sizes, low * ratio - 1), np.searchsorted(sizes, high / ratio + 1, "right"))
            window = order[a:b]
            i, j = np.nonzero(np.bitwise_count((self.fp[some][:, None] ^ self.fp[window][None]) & mask) <= most)
            i, j = some[i], window[j]
            # of two nodes that wait, the one with the larger index is met; others are met by those that wait
            keep = ((j > i) | ~waits[j]) & ((self.flip[i] != self.flip[j]) | (self.flip[i] == 0)) & (forest.label[i] != forest.label[j])
            if self.two_sides:
                keep &= self.side[i] != self.side[j]
            i, j = i[keep], j[keep]
            good, bits = self.within(i, j, limit)
            yield i[good], j[good], bits


def links(nodes: DataFrame, like: Likeness = Likeness(), block: int = BLOCK) -> DataFrame:
    """Links ``u``, ``v`` that connect all nodes (``node``, ``fp``, ``more``, ``size``) that are alike."""
    chains = _budgets(like.max_bits)
    keyed = nodes.select("node", "fp", "more", "size", F.explode(_keys(like.max_bits)).alias("k")).select("node", "fp", "more", "size", "k.*")
    # at most MOST_CUT keys can have so many rows: this table is bounded
    many = F.greatest(F.lit(block), F.ceil(F.lit(keyed.count()) / MOST_CUT))
    crowded = keyed.groupBy("s", "key").agg(F.count("*").alias("n")).where(F.col("n") > many).select("s", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    dealt = keyed.join(F.broadcast(crowded), ["s", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("blocks")).cast("int"))
    # the cell of blocks a <= b holds both; a node meets each other block of its key once
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("s", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "flip", "node", "fp", "size", "more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [np.asarray(batch.column(c)).astype(np.int64) for c in range(9)]
            more = np.frombuffer(b"".join(batch.column(9).to_pylist()), np.uint64).reshape(batch.num_rows, like.words - 1)
            cols.append(more)
            if rest:
                cols = [np.concatenate([x, y]) for x, y in zip(rest, cols, strict=True)]
            cuts = np.flatnonzero(np.any([np.diff(c) != 0 for c in cols[:4]], axis=0)) + 1
            done = int(cuts[-1]) if len(cuts) else 0
            rest = [x[done:] for x in cols]
            if done:
                yield emit([x[:done] for x in cols], cuts[:-1])
        if rest:
            yield emit(rest, np.flatnonzero(np.any([np.diff(c) != 0 for c in rest[:4]], axis=0)) + 1)

    def emit(cols: list[np.ndarray], cuts: np.ndarray) -> pa.RecordBatch:
        s, _, a, b, own, flip, node, fp, size, more = cols
        found: list[np.ndarray] = []
        for x, y in zip(np.concatenate([[0], cuts]).tolist(), np.concatenate([cuts, [len(s)]]).tolist(), strict=True):
            if y - x > 1:
                side = own[x:y] if a[x] != b[x] else np.zeros(y - x, np.int64)
                pairs = Cell(fp[x:y].view(np.uint64), more[x:y], size[x:y], flip[x:y], side, chains[s[x]], like).links()
                if pairs:
                    found.append(node[x:y][np.array(pairs)])
        pairs = np.concatenate(found) if found else np.empty((0, 2), np.int64)
        return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    # links to verify go to the least nodes of a cell, so that cells find the same ones
    ordered = cells.repartition("s", "key", "a", "b").sortWithinPartitions("s", "key", "a", "b", *["node"] * bool(like.jaccard))
    return ordered.mapInArrow(run, "u bigint, v bigint")


def verified(edges: DataFrame, texts: DataFrame, shingle: int, jaccard: float) -> DataFrame:
    """Those of ``edges`` (``u``, ``v``) whose texts (``node``, ``text``) have a Jaccard similarity of ``jaccard`` of their shingles.

    A text meets its partners in tasks of at most VERIFIED of them, so its shingles are sent once a task.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                sets = [np.unique(shingles(t or b"", shingle).astype(np.uint64)).tobytes() for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(sets, pa.binary())], names=["node", "hashes"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, mine = None, np.empty(0, np.uint64)
        for batch in batches:
            found = []
            for u, v, data in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if v is None:
                    own, mine = u, np.frombuffer(data, np.uint64)
                    continue
                assert own == u
                other = np.frombuffer(data, np.uint64)
                common = len(np.intersect1d(mine, other, assume_unique=True))
                if common >= jaccard * (len(mine) + len(other) - common):
                    found.append((u, v))
            yield pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    edges = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    edges = durable(edges, "candidates")
    sets = durable(texts.mapInArrow(hashed, "node bigint, hashes binary"), "shingles")
    salts = edges.groupBy("u").agg(F.ceil(F.count("*") / VERIFIED).alias("salts"))
    dealt = edges.join(salts, "u").withColumn("salt", F.pmod(F.xxhash64("v"), "salts"))
    partners = dealt.join(sets, F.col("v") == F.col("node")).select("u", "salt", "v", "hashes")
    owners = dealt.select("u", "salt").distinct().join(sets, F.col("u") == F.col("node")).select("u", "salt", F.lit(None).cast("bigint").alias("v"), "hashes")
    ordered = owners.unionByName(partners).repartition("u", "salt").sortWithinPartitions("u", "salt", F.asc_nulls_first("v"))
    return ordered.select("u", "v", "hashes").mapInArrow(compared, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", like: Likeness = Likeness(), shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: id, ``fp`` and ``component_id``, the least id reachable by links.

    Null and empty texts have fingerprint 0 and are linked like any other. Rows that repeat an id are
    answered each; null ids are least but do not name a component unless it has no other id. An empty table
    gives an empty result; other columns are not read.
    """
    same = ["fp", "more", "size"]
    prints = durable(fingerprints(docs, id_col, text_col, shingle, like.words), "fingerprints")
    nodes = prints.groupBy(*same).agg(F.min("id").alias("least"), F.count("*").alias("n"))
    nodes = durable(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    edges = links(nodes, like, block)
    if like.jaccard:
        edges = durable(edges, "links")
        ends = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        # a text for each node: that of its least id
        wanted = nodes.join(ends, "node", "left_semi").select("node", "least")
        ids = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        edges = verified(edges, ids.join(wanted, F.col("id").eqNullSafe(F.col("least"))).select("node", "text").dropDuplicates(["node"]), shingle, like.jaccard)
    roots = components(edges)
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).withColumnRenamed("n", "rows")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    # one component may hold most of the nodes
    named = join_counted(named, least, ["root"], nodes.count()).select(*same, F.col("rows").alias("n"), "component_id")
    return join_counted(prints, named, same, prints.count()).select(F.col("id").alias(id_col), "fp", "component_id")
