"""Repeated passages by a sparse suffix array.

Suffixes of the documents' word sequences are retained at content-selected positions only: where the hash of
the next ``span`` words is the least among ``gap`` consecutive positions (a minimiser). Every window of
span + gap - 1 = 50 words has one minimiser, at the same words wherever the window occurs.

*Sort.* The retained suffixes are grouped by their first ``span`` words; one that shares them with another may
lie in a repeated passage, all others are dropped.

*Extend left and right.* A suffix that is left stands for the windows of which it is the minimiser, up to
``gap`` of them: they reach from it to the left and to the right and are whole passages. These are sorted across
the cluster and neighbours compared: equal ones form chains, and each is linked with the first of its chain.
Links of consecutive windows to consecutive windows are one passage. So no neighbour is passed over because a
frequent clause sorts between two copies of a passage, and there is no bound on how many copies there are.

Sorting splits frequent passages over tasks; ranges are joined by one row a range. A chain costs one row a
copy, never a pair of copies. Texts move once, to meet their retained suffixes. Windows are compared by 96 bits
of two independent hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, Words, durable, join_counted, text_chunks

SPAN = 25
GAP = 26
MIN_WORDS = SPAN + GAP - 1


def minimisers(words: Words, span: int = SPAN, gap: int = GAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of a chunk at which windows of span + gap - 1 words of one text begin, each window's minimiser, and the hashes of ``span`` words."""
    value, _ = words.windows(span)
    if len(value) < gap:
        return np.empty(0, np.int64), np.empty(0, np.int64), value
    view = np.lib.stride_tricks.sliding_window_view(value, gap)
    begin = np.flatnonzero(words.text[: len(view)] == words.text[span + gap - 2 :][: len(view)])
    picked = [begin[i : i + 16_384] + view[begin[i : i + 16_384]].argmin(axis=1) for i in range(0, len(begin), 16_384)]
    return begin, np.concatenate(picked) if picked else begin, value


def _samples(rows: DataFrame, span: int, gap: int) -> DataFrame:
    """Retained suffixes of ``rows`` (id, tie, text): id, tie, word number ``pos``, ``key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_chunks(batch.column(2)):
                words = Words(texts, NOT_SPACE)
                _, picked, value = minimisers(words, span, gap)
                at = np.unique(picked)
                row = words.text[at]
                take = pa.array(row + texts.first)
                yield pa.record_batch([batch.column(0).take(take), batch.column(1).take(take), pa.array((at - words.first[row]).astype(np.int32)), pa.array(value[at].view(np.int64))], names=["id", "tie", "pos", "key"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, tie bigint, pos int, key bigint")


def _windows(rows: DataFrame, span: int, gap: int) -> DataFrame:
    """Windows of ``rows`` (d, text, ``kept``) whose minimisers are among the kept ones: ``key`` and ``check``, d, pos."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in text_chunks(batch.column(1)):
                words = Words(texts, NOT_SPACE)
                begin, picked, _ = minimisers(words, span, gap)
                kept = np.zeros(len(words) + 1, bool)
                lists = batch.column(2).slice(texts.first, texts.n)
                kept[np.asarray(lists.flatten()) + np.repeat(words.first[:-1], np.asarray(lists.value_lengths()))] = True
                at = begin[kept[picked]]
                row = words.text[at]
                key, check = (words.windows(span + gap - 1, c)[0][at] for c in (False, True))
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(check.astype(np.uint32).view(np.int32)), batch.column(0).take(pa.array(row + texts.first)), pa.array((at - words.first[row]).astype(np.int32))], names=["key", "check", "d", "pos"])

    return rows.mapInArrow(run, "key bigint, check int, d bigint, pos int")


_LINKS = "d bigint, pos int, d1 bigint, pos1 int, part int, head boolean, border int, key bigint, check int"


def _chains(windows: DataFrame) -> DataFrame:
    """Windows that equal one before them in the sorted order, with the first of their chain: d, pos, d1, pos1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, first, head = TaskContext.get().partitionId(), None, None, True

        def rows(columns: list, head, border: int) -> pa.RecordBatch:
            n = len(columns[0])
            fixed = [np.full(n, part, np.int32), np.broadcast_to(head, n), np.full(n, border, np.int32)]
            keys = [np.full(n, x) for x in last] if border else [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())]
            return pa.record_batch([pa.array(x) for x in (*columns, *fixed, *keys)], names=[x.split()[0] for x in _LINKS.split(", ")])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, check, d, pos = (np.asarray(batch.column(c)) for c in range(4))
            if last is None:
                last, first = (key[0], check[0]), (d[0], pos[0])
                yield rows([d[:1], pos[:1], d[:1], pos[:1]], True, 1)
                again = np.zeros(len(key), bool)
            else:
                again = np.array([(key[0], check[0]) == last] + [False] * (len(key) - 1))
            again[1:] |= (key[1:] == key[:-1]) & (check[1:] == check[:-1])
            # the chain of the range's first window goes on until another begins
            begins = ~again
            if head and (d[0], pos[0]) == first:
                begins[0] = False
            start = np.maximum.accumulate(np.where(~again, np.arange(len(key)), -1))
            heads = head & (np.cumsum(begins) == 0)
            d1, pos1 = (np.where(start < 0, f, x[start]) for f, x in zip(first, (d, pos), strict=True))
            at = np.flatnonzero(again)
            yield rows([x[at] for x in (d, pos, d1, pos1)], heads[at], 0)
            last, first, head = (key[-1], check[-1]), (d1[-1], pos1[-1]), bool(heads[-1])
        if last is not None:
            yield rows([np.array([x]) for x in (*first, *first)], head, 2)

    order = ["key", "check", "d", "pos"]
    ordered = windows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    found = durable(ordered.mapInArrow(run, _LINKS), "chains")
    # two rows a range: chains that go on from the range before
    carried, open_, end = [], None, None
    for r in found.where("border > 0").orderBy("part", "border").collect():
        key = (r["key"], r["check"])
        if r["border"] == 1:
            open_ = end[1] if end and end[0] == key else None
            if open_:
                carried.append((r["part"], *open_, r["d"], r["pos"]))
        else:
            end = (key, open_ if open_ and r["head"] else (r["d"], r["pos"]))
    links = found.where("border = 0").select("d", "pos", "d1", "pos1", "part", "head")
    if not carried:
        return links.select("d", "pos", "d1", "pos1")
    far = windows.sparkSession.createDataFrame(carried, "part int, d2 bigint, pos2 int, d bigint, pos int")
    own = links.join(F.broadcast(far.select("part", F.lit(True).alias("head"), "d2", "pos2")), ["part", "head"], "left")
    own = own.select("d", "pos", F.coalesce("d2", "d1").alias("d1"), F.coalesce("pos2", "pos1").alias("pos1"))
    return own.unionByName(far.select("d", "pos", F.col("d2").alias("d1"), F.col("pos2").alias("pos1")))


def repeated_passages(docs: DataFrame, span: int = SPAN, gap: int = GAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages of span + gap - 1 words or more that occur at an earlier place.

    A window of span + gap - 1 words is linked with its first occurrence, in the order of id (null first), text
    hash and word. One row per run of consecutive windows that are linked with consecutive windows: the document
    ``id_col``, its words ``start`` to ``stop`` (exclusive), and the place that they repeat, ``source_<id_col>`` and
    ``source_start``. So every window that occurs twice or more is in a row, as a later copy or as the source.
    Words are runs of characters other than space and \\t-\\r. Repeats inside a document count. Rows that repeat
    in id and text are one document; null texts hold nothing; an empty table gives no rows; other columns are
    not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("tie"), F.col(text_col).alias("text")).where("text is not null")
    samples = durable(_samples(rows, span, gap), "samples")
    groups = durable(samples.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    kept = join_counted(samples, groups, ["key"], samples.count()).groupBy("id", "tie").agg(F.collect_set("pos").alias("kept"))
    # documents are numbered in their order, so that windows are sorted by small numbers
    kept = durable(kept.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").withColumn("d", F.monotonically_increasing_id()), "kept")
    marks = kept.toDF("id2", "tie2", "kept", "d")
    same = F.col("id").eqNullSafe(F.col("id2")) & (F.col("tie") == F.col("tie2"))
    windows = durable(_windows(rows.join(marks, same).select("d", "text", "kept"), span, gap), "windows")
    links = _chains(windows).where("d != d1 or pos != pos1").distinct()
    diagonal = ["d", "d1", F.col("pos") - F.col("pos1")]
    links = links.withColumn("run", F.col("pos") - F.row_number().over(Window.partitionBy(*diagonal).orderBy("pos")))
    found = links.groupBy("d", "d1", diagonal[2].alias("shift"), "run").agg(F.min("pos").alias("start"), (F.max("pos") + (span + gap - 1)).alias("stop"))
    later, source = kept.select("d", F.col("id").alias(id_col)), kept.select(F.col("d").alias("d1"), F.col("id").alias(f"source_{id_col}"))
    return found.join(later, "d").join(source, "d1").select(id_col, "start", "stop", f"source_{id_col}", (F.col("start") - F.col("shift")).alias("source_start"))
