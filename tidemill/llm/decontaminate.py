"""Benchmark decontamination: prefix-filtered set join of item windows with documents.

Windows of benchmark items are sets of word shingles. Shingles are ordered by how rare they are in the
corpus (all documents are counted); for exact containment the necessary prefix of a window is its rarest
shingle. Document shingles are joined with those prefix shingles only; the shingle's offset in the window
gives the place where the window would begin, which must lie inside the document, as must its end; the
words there are then compared. Documents are read twice and never shuffled; windows are broadcast in blocks
of at most ``BLOCK_WINDOWS``, so the size of what is broadcast is bounded however many items there are.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TO_LOWER, Texts, Words, byte_set, durable, text_chunks

#: Bytes of words: digits, letters (A-Z are lower-cased first), anything beyond ASCII.
MEMBER = byte_set("0123456789abcdefghijklmnopqrstuvwxyz", upper_half=True)
SHINGLE = 3
WINDOW = 10
#: Distinct windows broadcast at a time, with ten words each at most some 30 MB, and their shingles' counts, 13 MB;
#: the items of further windows take another pass over the documents.
BLOCK_WINDOWS = 100_000
_HIT_TYPE = "start int, stop int"


def _words(texts: Texts) -> Words:
    return Words(texts, MEMBER, TO_LOWER)


def item_windows(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct windows of all items: ``key`` (words joined by a space), ``words`` and ``ids`` of the items."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_chunks(batch.column(1)):
                words = _words(texts)
                keys, ids = [], []
                for i, name in enumerate(batch.column(0).slice(texts.first, texts.n).to_pylist()):
                    a, b = int(words.first[i]), int(words.first[i + 1])
                    found = {words.joined(j, min(j + window, b)).decode() for j in range(a, max(a + 1, b - window + 1))} if b > a else set()
                    keys += found
                    ids += [name] * len(found)
                yield pa.record_batch([pa.array(keys, pa.string()), pa.array(ids, pa.string())], names=["key", "id"])

    rows = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    return rows.mapInArrow(cut, "key string, id string").groupBy("key").agg(F.sort_array(F.collect_set("id")).alias("ids"))


class _Block:
    """Windows of one block, as they are broadcast: words' hashes, shingles and, once ordered, prefixes."""

    def __init__(self, rows: pa.Table):
        self.keys = [k.encode() for k in rows["key"].to_pylist()]
        self.ids = rows["ids"].to_pylist()
        column = pa.array(rows["key"].to_pylist(), pa.large_string())
        self.hashes: list[np.ndarray] = []
        self.shingles: list[np.ndarray] = []
        for texts in text_chunks(column):
            words = _words(texts)
            by_size = {k: words.windows(k)[0] for k in range(1, SHINGLE + 1)}
            for i in range(texts.n):
                a, b = int(words.first[i]), int(words.first[i + 1])
                k = min(SHINGLE, b - a)
                self.hashes.append(words.hash[a:b].copy())
                self.shingles.append(by_size[k][a : b - k + 1].copy())
        self.sizes = sorted({min(SHINGLE, len(h)) for h in self.hashes})
        self.all = np.unique(np.concatenate(self.shingles)) if self.keys else np.empty(0, np.uint64)
        self.prefixes: dict[int, list[tuple[int, int]]] = {}
        self.prefix_keys = np.empty(0, np.uint64)

    def order(self, counts: dict[int, int]) -> None:
        """Choose each window's prefix: the shingle that the corpus holds least often (ties: the first).

        A window with a shingle that no document holds can't occur and gets no prefix."""
        prefixes = defaultdict(list)
        for w, shingles in enumerate(self.shingles):
            held = [counts.get(int(s), 0) for s in shingles]
            if least := min(held):
                at = held.index(least)
                prefixes[int(shingles[at])].append((w, at))
        self.prefixes = dict(prefixes)
        self.prefix_keys = np.sort(np.array(list(prefixes), np.uint64))


def _hits(wanted: np.ndarray, flags: np.ndarray, words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``k``-word shingles of a chunk that are among ``wanted`` (sorted), and the shingles."""
    value, whole = words.windows(k)
    at = np.flatnonzero(flags[(value >> np.uint64(44)).astype(np.int64)] & whole)
    place = np.minimum(np.searchsorted(wanted, value[at]), len(wanted) - 1)
    at = at[wanted[place] == value[at]]
    return at, value[at]


def _flags(wanted: np.ndarray) -> np.ndarray:
    flags = np.zeros(1 << 20, bool)
    flags[(wanted >> np.uint64(44)).astype(np.int64)] = True
    return flags


def _shingle_counts(docs: DataFrame, block) -> dict[int, int]:
    """How often the shingles of a block occur in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        flags, totals = _flags(b.all), np.zeros(len(b.all), np.int64)
        for batch in batches:
            for texts in text_chunks(batch.column(0)):
                words = _words(texts)
                for k in b.sizes:
                    _, value = _hits(b.all, flags, words, k)
                    np.add.at(totals, np.searchsorted(b.all, value), 1)
        some = np.flatnonzero(totals)
        yield pa.record_batch([pa.array(b.all[some].view(np.int64)), pa.array(totals[some])], names=["shingle", "n"])

    # at most one row a shingle of the block
    rows = docs.mapInArrow(count, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(np.asarray(rows["shingle"]).view(np.uint64).tolist(), rows["n"].to_pylist(), strict=True))


def _block_hits(docs: DataFrame, block, id_type: str) -> DataFrame:
    """Per document: number of words, merged word ranges that windows cover, items whose windows occur."""
    ranges = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        flags = _flags(b.prefix_keys)
        for batch in batches:
            for texts in text_chunks(batch.column(1)):
                words = _words(texts)
                found: dict[int, list] = defaultdict(list)
                items: dict[int, set] = defaultdict(set)
                for k in b.sizes if len(b.prefix_keys) else ():
                    for at, value in zip(*(x.tolist() for x in _hits(b.prefix_keys, flags, words, k)), strict=True):
                        d = int(words.text[at])
                        low, high = int(words.first[d]), int(words.first[d + 1])
                        for w, offset in b.prefixes[value]:
                            start, size = at - offset, len(b.hashes[w])
                            if start < low or start + size > high or not np.array_equal(words.hash[start : start + size], b.hashes[w]):
                                continue
                            if words.joined(start, start + size) == b.keys[w]:
                                found[d].append((start - low, start + size - low))
                                items[d].update(b.ids[w])
                spans = [[{"start": x, "stop": y} for x, y in merged(found[d])] if d in found else [] for d in range(texts.n)]
                yield pa.record_batch(
                    [
                        batch.column(0).slice(texts.first, texts.n),
                        pa.array(np.diff(words.first), pa.int64()),
                        pa.array(spans, ranges),
                        pa.array([sorted(items[d]) if d in items else [] for d in range(texts.n)], pa.list_(pa.string())),
                        batch.column(2).slice(texts.first, texts.n),
                    ],
                    names=["id", "n_words", "hits", "items", "row"],
                )

    return docs.mapInArrow(search, f"id {id_type}, n_words bigint, hits array<struct<{_HIT_TYPE}>>, items array<string>, row bigint")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans without overlaps that cover the same positions."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``hits`` (array of word ranges), ``items`` (array of ids as strings).

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window.
    Words are runs of digits, letters and non-ASCII characters after A-Z were lower-cased. Null texts have no
    words; items without id are left out; items or documents that repeat are each answered; an empty table on
    either side gives no hits. Other columns are not read.
    """
    spark = docs.sparkSession
    id_type = docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    windows = item_windows(items, window, item_id, item_text)
    n = windows.count()
    n_blocks = max(1, -(-n // block_windows))
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(0).cast("bigint").alias("row"))
    if n_blocks > 1:
        # rows are numbered once, so that every block and every repeated task means the same row
        windows = durable(windows, "windows")
        keyed = durable(keyed.withColumn("row", F.monotonically_increasing_id()), "documents")
    texts = keyed.select("text")
    parts = []
    for b in range(n_blocks):
        rows = windows.where(F.pmod(F.xxhash64("key"), F.lit(n_blocks)) == b).orderBy("key").toArrow()
        block = _Block(rows)
        shared = spark.sparkContext.broadcast(block)
        block.order(_shingle_counts(texts, shared) if block.keys else {})
        parts.append(_block_hits(keyed, spark.sparkContext.broadcast(block), id_type))
    if n_blocks == 1:
        return parts[0].select(F.col("id").alias(id_col), "n_words", "hits", "items")
    return _merge_blocks(parts, id_col)


def _merge_blocks(parts: list[DataFrame], id_col: str) -> DataFrame:
    """Unite what the blocks found in each document row; a document has a row for each block."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    grouped = rows.groupBy("row").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    none = F.array().cast(f"array<struct<{_HIT_TYPE}>>")

    def add(done, span):
        last = F.try_element_at(done, F.lit(-1))
        return F.when((F.size(done) > 0) & (span["start"] <= last["stop"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], span["stop"]).alias("stop"))))).otherwise(F.concat(done, F.array(span)))

    return grouped.select(F.col("id").alias(id_col), "n_words", F.aggregate("hits", none, add).alias("hits"), "items")

