"""Helpers shared by the corpus operators: durable tables and vectorised words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into numpy arrays at a time; one longer text makes a longer chunk.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; local sessions without one get a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidemill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared folder and read it back: later stages survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemill-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key is crowded if it has more than one row in so many; so no table has more crowded keys than that.
CROWDED = 1000


def join_counted(rows: DataFrame, groups: DataFrame, on: list[str], total: int, n: str = "n") -> DataFrame:
    """Inner join of ``rows`` with ``groups``, which has one row a key and in ``n`` how many rows the key has.

    A key with more than total / CROWDED rows would make a hot task. There are at most CROWDED such keys, as
    ``total`` is the number of rows: these are broadcast, and only the others are shuffled.
    """
    crowded = groups.where(F.col(n) * CROWDED > total)
    hot = rows.join(F.broadcast(crowded), on)
    rest = rows.join(F.broadcast(crowded.select(*on)), on, "left_anti")
    return hot.unionByName(rest.join(groups.where(F.col(n) * CROWDED <= total), on))


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores appended while a column is called so."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


class Texts:
    """UTF-8 bytes of some consecutive texts, nulls as empty, and where each begins and ends."""

    def __init__(self, column: pa.Array, first: int, stop: int):
        offsets = np.frombuffer(column.buffers()[1], column_offsets(column), column.offset + len(column) + 1)[column.offset :]
        self.first, self.n = first, stop - first
        low, high = int(offsets[first]), int(offsets[stop])
        data = column.buffers()[2]
        self.bytes = np.frombuffer(data, np.uint8, high - low, low) if high > low else np.empty(0, np.uint8)
        self.starts = (offsets[first:stop] - low).astype(np.int64)
        self.ends = (offsets[first + 1 : stop + 1] - low).astype(np.int64)

    def text(self, i: int) -> str:
        return self.bytes[self.starts[i] : self.ends[i]].tobytes().decode("utf-8")


def column_offsets(column: pa.Array) -> type:
    return np.int64 if pa.types.is_large_string(column.type) else np.int32


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Cut a string column into runs of whole texts of about ``limit`` bytes."""
    column = column.fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], column_offsets(column), column.offset + len(column) + 1)[column.offset :]
    first = 0
    while first < len(column):
        stop = max(first + 1, int(np.searchsorted(offsets, np.int64(offsets[first]) + limit, "right")) - 1)
        stop = min(stop, len(column))
        yield Texts(column, first, stop)
        first = stop


class _Powers:
    """Powers of an odd base and of its inverse, modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * CHUNK_BYTES)
            rows = []
            for b in (self.base, self.inverse):
                x = np.full(size, b, np.uint64)
                x[0] = 1
                rows.append(np.cumprod(x, dtype=np.uint64))
            self.up, self.down = rows
        return self.up[:n], self.down[:n]


_BYTE_POWERS, _WORD_POWERS, _CHECK_POWERS = _Powers(0x9E3779B97F4A7C15), _Powers(0xD6E8FEB86659FD93), _Powers(0xD1342543DE82EF95)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Words:
    """Words of the texts of a chunk: byte bounds, text number, 64-bit hash.

    ``member`` marks the bytes that words consist of, ``fold`` maps bytes first (e.g. to lower case).
    """

    def __init__(self, texts: Texts, member: np.ndarray, fold: np.ndarray | None = None):
        data = texts.bytes if fold is None else fold[texts.bytes]
        inside = member[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[texts.starts] = True
        before = np.empty(len(data), bool)
        before[:1] = False
        before[1:] = inside[:-1]
        after = np.empty(len(data), bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.data = data
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.text = np.searchsorted(texts.starts, self.start, "right") - 1
        self.first = np.searchsorted(self.text, np.arange(texts.n + 1))
        up, down = _BYTE_POWERS.upto(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        size = (self.end - self.start).astype(np.uint64)
        self.hash = _mixed((sums[self.end] - sums[self.start]) * down[self.start] + size * np.uint64(0x94D049BB133111EB))

    def __len__(self) -> int:
        return len(self.start)

    def windows(self, k: int, check: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``k`` words from each word on, and whether they all belong to one text; ``check``: a second hash."""
        n = len(self)
        if n < k:
            return np.empty(0, np.uint64), np.empty(0, bool)
        up, down = (_CHECK_POWERS if check else _WORD_POWERS).upto(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hash * up[:-1], out=sums[1:])
        value = _mixed((sums[k:] - sums[:-k]) * down[: n - k + 1] + np.uint64(k))
        return value, self.text[k - 1 :] == self.text[: n - k + 1]

    def joined(self, first: int, stop: int) -> bytes:
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.start[first:stop], self.end[first:stop], strict=True))


def byte_set(members: str = "", upper_half: bool = False, inverse: bool = False) -> np.ndarray:
    """A table of 256 flags; ``upper_half`` adds all bytes of non-ASCII characters."""
    flags = np.zeros(256, bool)
    flags[[ord(c) for c in members]] = True
    flags[128:] |= upper_half
    return ~flags if inverse else flags


#: Bytes of white-space-separated words, and the map of A-Z to a-z.
NOT_SPACE = byte_set(" \t\n\v\f\r", inverse=True)
TO_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
