"""Best-fit packing of documents into fixed-length sequences by a grouping genetic algorithm.

Documents are tokenized where they lie; only piece lengths and checksums move on. Pieces are dealt into
blocks of about ``BLOCK`` pieces by a hash, so no key decides a task's size. Every block is solved by
``islands`` populations, which start from best fit in random order: a crossover injects whole well-filled bins
of one parent into another, removes the documents that then occur twice, and places displaced documents by
best fit. Between epochs each island
sends its elite to the next island of its block, as rows through a shuffle. Bins that the blocks leave
poorly filled are opened, and their pieces dealt into fewer blocks and packed once more.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, free_name
from .tokens import encoder, ids_crc32

CAPACITY = 2048
END_ID = 0
BLOCK = 3000
ISLANDS = 2
EPOCHS = 3
GENERATIONS = 8
POPULATION = 6
#: Bins filled to this share stay closed when the rest is packed once more.
FULL = 0.995


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document (its ids, then the end id); null texts count as empty."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, "dropped").encode
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                rows, piece, start, length, crc = [], [], [], [], []
                for r, ids in enumerate(encode(part.column(1))):
                    ids = np.append(ids, np.uint32(END_ID))
                    for p, a in enumerate(range(0, len(ids), capacity)):
                        x = ids[a : a + capacity]
                        rows.append(r)
                        piece.append(p)
                        start.append(a)
                        length.append(len(x))
                        crc.append(ids_crc32(x))
                columns = [pa.array(x, pa.int64()) for x in (start, length, crc)]
                yield pa.record_batch([part.column(0).take(pa.array(rows, pa.int32())), pa.array(piece, pa.int32()), *columns], names=["id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(sizes: np.ndarray, items: list[int], bins: list[list[int]], room: list[int], capacity: int, decreasing: bool = True) -> None:
    """Place ``items`` (largest first, or as they come) each into the fullest bin that takes it, opening bins as needed."""
    free = sorted((r, b) for b, r in enumerate(room) if r)
    for i in sorted(items, key=lambda i: (-sizes[i], i)) if decreasing else items:
        size = int(sizes[i])
        at = bisect_left(free, (size, -1))
        if at == len(free):
            bins.append([i])
            room.append(capacity - size)
            b = len(bins) - 1
        else:
            _, b = free.pop(at)
            bins[b].append(i)
            room[b] -= size
        if room[b]:
            insort(free, (room[b], b))


def _room(sizes: np.ndarray, bins: list[list[int]], capacity: int) -> list[int]:
    return [capacity - int(sizes[b].sum()) for b in bins]


def fitness(room: list[int]) -> tuple[int, float]:
    """Fewer bins first, then fuller ones (sum of squared room, larger is better)."""
    return -len(room), float(np.square(np.array(room, np.float64)).sum())


def crossover(sizes: np.ndarray, giver: list[list[int]], taker: list[list[int]], rng: np.random.Generator, capacity: int) -> list[list[int]]:
    """Inject a random half of the giver's best-filled bins into the taker, and best-fit what they displace."""
    order = np.argsort(_room(sizes, giver, capacity), kind="stable")
    best = order[: max(1, len(order) // 2)]
    chosen = best[rng.random(len(best)) < 0.5].tolist() or [int(best[0])]
    placed = np.zeros(len(sizes), bool)
    for b in chosen:
        placed[giver[b]] = True
    child, displaced = [list(giver[b]) for b in chosen], []
    for b in taker:
        held = placed[b]
        if not held.any():
            child.append(list(b))
        elif not held.all():
            displaced += [i for i, x in zip(b, held, strict=True) if not x]
    best_fit(sizes, displaced, child, _room(sizes, child, capacity), capacity)
    return child


def mutated(sizes: np.ndarray, bins: list[list[int]], rng: np.random.Generator, capacity: int) -> list[list[int]]:
    """Empty up to half of the bins, the worst-filled ones and a few others, and best-fit their documents."""
    room = _room(sizes, bins, capacity)
    gone = set(np.argsort(room, kind="stable")[::-1][: max(1, int(len(bins) * rng.random() / 2))].tolist())
    gone |= set(rng.choice(len(bins), max(1, len(bins) // 50)).tolist())
    kept = [list(b) for i, b in enumerate(bins) if i not in gone]
    best_fit(sizes, [i for g in sorted(gone) for i in bins[g]], kept, _room(sizes, kept, capacity), capacity)
    return kept


def seed(sizes: np.ndarray, rng: np.random.Generator | None, capacity: int) -> list[list[int]]:
    """A packing to start from: best fit in a random order, or of the largest first."""
    bins: list[list[int]] = []
    order = list(range(len(sizes))) if rng is None else rng.permutation(len(sizes)).tolist()
    best_fit(sizes, order, bins, [], capacity, decreasing=rng is None)
    return bins


def evolve(sizes: np.ndarray, elite: list[list[list[int]]], number: int, generations: int, capacity: int, population: int = POPULATION) -> list[list[int]]:
    """The best packing of an island after some generations, from ``elite`` packings and seeds.

    Best fit of the largest first is the result if no packing takes fewer bins; it is no parent, as a population that
    holds it settles near it. Evolution ends early only with as few bins as the total of the sizes needs. Parents are
    the better of two.
    """
    rng = np.random.default_rng(number)
    least = -(-int(sizes.sum()) // capacity)
    plain = seed(sizes, None, capacity)
    if len(plain) <= least:
        return plain
    people = [list(p) for p in elite] + [seed(sizes, rng, capacity) for _ in range(population - len(elite))]
    people = sorted(((fitness(_room(sizes, p, capacity)), i, p) for i, p in enumerate(people)), reverse=True)[:population]
    born = len(people)
    for _ in range(generations):
        if len(people[0][2]) <= least:
            break
        giver, taker = (min(rng.integers(0, len(people), 2).tolist()) for _ in range(2))
        child = mutated(sizes, crossover(sizes, people[giver][2], people[taker][2], rng, capacity), rng, capacity)
        score = fitness(_room(sizes, child, capacity))
        if score > people[-1][0] and all(score != p[0] for p in people):
            born += 1
            people[-1] = (score, born, child)
            people.sort(reverse=True)
    return min(people[0][2], plain, key=len)


def _numbered(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.empty(n, np.int64)
    for b, items in enumerate(bins):
        out[items] = b
    return out


def _lists(numbers: np.ndarray) -> list[list[int]]:
    order = np.argsort(numbers, kind="stable")
    cuts = np.flatnonzero(np.diff(numbers[order])) + 1
    return [x.tolist() for x in np.split(order, cuts)]


def _pack(pieces: DataFrame, blocks: int, capacity: int, salt: str, islands: int, epochs: int, generations: int) -> DataFrame:
    """Adds ``block`` and ``bin``; pieces that repeat in all columns may swap places, which changes nothing."""
    columns = pieces.columns
    schema = pieces.schema.simpleString()[len("struct<") : -1].replace(":", " ")
    # pieces come from a written table, whose row numbers stay; rows that repeat spread over blocks too
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64(F.lit(salt), F.monotonically_increasing_id()), F.lit(blocks)))

    def solve(epoch: int):
        def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            block, island = int(key[0]), int(key[1])
            base = frame if not epoch else frame[frame["source"] == frame["source"].min()]
            order = [*columns]
            base = base.sort_values(order, kind="stable").reset_index(drop=True)
            sizes = base["length"].to_numpy()
            elite = []
            if epoch:
                for _, one in frame.groupby("source"):
                    elite.append(_lists(one.sort_values(order, kind="stable")["bin"].to_numpy()))
            best = evolve(sizes, elite, block * 1009 + island * 31 + epoch, generations, capacity)
            return base[columns].assign(block=block, island=island, bin=_numbered(best, len(sizes)), bins=len(best))

        return run

    out_schema = f"{schema}, block bigint, island int, bin bigint, bins int"
    state = dealt.withColumn("island", F.explode(F.array([F.lit(i) for i in range(islands)]))).groupBy("block", "island").applyInPandas(solve(0), out_schema)
    for epoch in range(1, epochs):
        # each island meets its own best packing and the elite of the island before it
        to = F.array(F.col("island"), F.pmod(F.col("island") + 1, F.lit(islands)).cast("int")) if islands > 1 else F.array("island")
        sent = state.withColumn("source", F.col("island")).withColumn("island", F.explode(to))
        state = sent.groupBy("block", "island").applyInPandas(solve(epoch), out_schema)
    state = durable(state, "packed")
    best = state.groupBy("block").agg(F.min_by("island", F.struct("bins", "island")).alias("island"))
    return state.join(best, ["block", "island"]).select(*columns, "block", "bin")


def pack(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``pieces`` (a column ``length`` of 1..capacity; others are kept).

    Sequences hold at most ``capacity``; inside one, pieces lie without gaps from offset 0, longest first. Rows
    that repeat are packed each, null ids like any other. Columns of any names are kept; where one is called like a new
    one, the new one's name gets an underscore. An empty table stays empty.
    """
    named = [*pieces.columns, free_name("sequence_id", pieces.columns)]
    named.append(free_name("offset", named))
    # names of one's own, so that none clashes with those of the packing
    pieces = pieces.toDF(*[c if c == "length" else f"c{i}" for i, c in enumerate(pieces.columns)])
    columns = pieces.columns
    whole = pieces.where(F.col("length") == capacity).select(*columns, F.lit("w").alias("round"), F.monotonically_increasing_id().alias("block"), F.lit(0).cast("long").alias("bin"))
    rest = pieces.where(F.col("length") < capacity)
    n = rest.count()
    first = _pack(rest, max(1, -(-n // block)), capacity, "first", islands, epochs, generations)
    fill = first.groupBy("block", "bin").agg(F.sum("length").alias("filled"))
    # bins are few pieces each, and hash evenly: no hot key
    first = first.join(fill, ["block", "bin"])
    closed = first.where(F.col("filled") >= FULL * capacity).select(*columns, F.lit("a").alias("round"), "block", "bin")
    left = durable(first.where(F.col("filled") < FULL * capacity).select(*columns, "block", "bin"), "unfilled")
    again = _pack(left.select(*columns), max(1, -(-left.count() // block)), capacity, "again", islands, epochs, generations)
    # what was opened stays as it was if packing it once more gains nothing
    bins = [x.select("block", "bin").distinct().count() for x in (left, again)]
    rest = again.withColumn("round", F.lit("b")) if bins[1] < bins[0] else left.withColumn("round", F.lit("a"))
    packed = whole.unionByName(closed).unionByName(rest)
    rounds = F.when(F.col("round") == "w", 0).when(F.col("round") == "a", 1).otherwise(2).cast("long")
    # block numbers and bins are under 2**38 and 2**13 for the packed rounds
    number = F.when(rounds == 0, F.shiftleft("block", 2)).otherwise(F.shiftleft("block", 15) + F.shiftleft("bin", 2) + rounds)
    place = Window.partitionBy("sequence_id").orderBy(F.desc("length"), *[c for c in columns if c != "length"])
    return packed.withColumn("sequence_id", number).withColumn("offset", F.sum("length").over(place.rowsBetween(Window.unboundedPreceding, -1))).select(*columns, "sequence_id", F.coalesce("offset", F.lit(0).cast("long"))).toDF(*named)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and ``offset``; a null or empty text is one piece that holds the end id."""
    return pack(durable(token_pieces(docs, tokenizer, capacity, id_col, text_col), "pieces"), capacity).withColumnRenamed("id", id_col)
