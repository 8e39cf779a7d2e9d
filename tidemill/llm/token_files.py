"""Token-id files: ids of each document compressed on their own, with one shared zstandard dictionary.

A file set is a folder of Parquet tables that any Spark reader opens:

* ``dictionary`` - one row: ``dict_hash`` (sha256 of the dictionary), ``kind`` ('trained', or 'raw' where the
  sample is too small to train on and is the dictionary itself) and ``bytes``.
* ``shards`` - rows of up to ``SHARD_BYTES`` of frames: ``part`` and ``shard`` number the rows in document
  order, ``first_doc`` and ``last_doc`` bound the ids (null ids aside), ``dict_hash`` names the dictionary, ``docs`` lists the ids of the documents, ``offsets`` is the offset
  index (document i is ``frames[offsets[i]:offsets[i+1]]``, one zstandard frame of little-endian unsigned
  32-bit ids), ``starts`` counts the ids before each document within the part.

One document is read by decompressing its own frame only: shards of other ids are skipped by their bounds, and
frames of other ids are dropped before any is decompressed. Documents are range-partitioned by id and each part
is written in ascending order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .tokens import encoder

END_ID = 0
SHARD_BYTES = 1 << 20
LEVEL = 3
#: The dictionary is trained on a piece of at most so many characters of each of at most so many documents.
SAMPLE_DOCS = 2000
SAMPLE_CHARS = 20_000
DICT_BYTES = 112_640
_SHARDS = "part int, shard int, first_doc {id}, last_doc {id}, dict_hash string, docs array<{id}>, offsets array<int>, starts array<bigint>, n_tokens bigint, frames binary"


def train_dictionary(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, bytes]:
    """Kind and bytes of a zstandard dictionary from the serialized ids of a bounded sample.

    The sample is SAMPLE_DOCS distinct ids with a text, least hashes first; of a text longer than SAMPLE_CHARS one
    piece is taken, which the id's hash chooses.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.length(text_col).alias("n")).where("n > 0 and id is not null")
    rank = F.xxhash64("id")
    # ids and lengths are chosen first, so that only the sample's texts move
    chosen = rows.groupBy("id").agg(F.max("n").alias("n")).orderBy(rank, "id").limit(SAMPLE_DOCS)
    piece = F.pmod(F.xxhash64(F.lit("piece"), "id"), F.ceil(F.col("n") / SAMPLE_CHARS)).cast("int")
    picked = rows.join(F.broadcast(chosen), ["id", "n"]).groupBy("id").agg(F.min(F.substring("text", piece * SAMPLE_CHARS + 1, F.lit(SAMPLE_CHARS))).alias("text"))
    texts = [r["text"] for r in picked.orderBy(rank, "id").collect()]
    samples = [x.astype("<u4").tobytes() for x in encoder(tokenizer, "kept").encode(pa.array(texts, pa.string())) if len(x)]
    total = sum(map(len, samples))
    if len(samples) >= 100 and total >= 64 * 1024:
        return "trained", zstandard.train_dictionary(min(DICT_BYTES, total // 8), samples, level=LEVEL, threads=0).as_bytes()
    return "raw", (np.full(16, END_ID, "<u4").tobytes() + b"".join(samples))[-DICT_BYTES:]


def _coder(kind, dictionary: bytes, **kw):
    return kind(dict_data=zstandard.ZstdCompressionDict(dictionary), **kw)


def write_token_files(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every document, append the end id and write the file set to ``path``.

    Null texts count as empty and null ids sort first; rows that repeat an id are written each, ordered by
    the text's hash. Other columns are not read. An empty table gives an empty set.
    """
    spark = docs.sparkSession
    made, dictionary = train_dictionary(docs, tokenizer, id_col, text_col)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, made, bytearray(dictionary))], "dict_hash string, kind string, bytes binary").write.parquet(f"{path}/dictionary")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    arrow_id = to_arrow_type(rows.schema["id"].dataType)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, press = encoder(tokenizer, "kept").encode, _coder(zstandard.ZstdCompressor, dictionary, level=LEVEL, write_content_size=True)
        part, shard, total = TaskContext.get().partitionId(), 0, 0
        names, frames, starts, size, before = [], [], [], 0, 0

        def row() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype(np.int32)
            some = [x for x in names if x is not None]
            values = [[part], [shard], some[:1] or [None], some[-1:] or [None], [digest], [names], [offsets], [starts], [total - before], [b"".join(frames)]]
            types = [pa.int32(), pa.int32(), arrow_id, arrow_id, pa.string(), pa.list_(arrow_id), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            return pa.record_batch([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=["part", "shard", "first_doc", "last_doc", "dict_hash", "docs", "offsets", "starts", "n_tokens", "frames"])

        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                piece = batch.slice(first, 1000)
                for name, ids in zip(piece.column(0).to_pylist(), encode(piece.column(1)), strict=True):
                    frame = press.compress(np.append(ids, np.uint32(END_ID)).astype("<u4").tobytes())
                    if frames and size + len(frame) > SHARD_BYTES:
                        yield row()
                        names, frames, starts, size, shard, before = [], [], [], 0, shard + 1, total
                    names.append(name)
                    frames.append(frame)
                    starts.append(total)
                    size += len(frame)
                    total += len(ids) + 1
        if frames:
            yield row()

    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    ordered.mapInArrow(write, _SHARDS.format(id=kind)).write.option("compression", "uncompressed").parquet(f"{path}/shards")


def _dictionary(spark: SparkSession, path: str) -> dict[str, bytes]:
    return {r["dict_hash"]: bytes(r["bytes"]) for r in spark.read.parquet(f"{path}/dictionary").collect()}


def read_token_files(spark: SparkSession, path: str, first=None, last=None) -> DataFrame:
    """One row per document, read back from the files: id, ``start`` (ids of all documents before), ``n_tokens``, ``ids``.

    ``ids`` is binary: little-endian unsigned 32-bit ids; ``n_tokens`` counts them. ``first`` and ``last`` bound the
    ids wanted (null ids are then left out): only shards that may hold such ids are read, and only their frames
    decompressed.
    """
    shards = spark.read.parquet(f"{path}/shards")
    # one row a part
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    totals = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    some = shards
    for bound, column, sign in ((first, "last_doc", 1), (last, "first_doc", -1)):
        if bound is not None:
            some = some.where(F.col(column) >= bound if sign > 0 else F.col(column) <= bound)
    rows = some.join(F.broadcast(totals), "part").select("base", "dict_hash", "docs", "offsets", "starts", "frames")
    kind = rows.schema["docs"].dataType.elementType.simpleString()
    dictionaries = _dictionary(spark, path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a batch holds no more shards than a split of the file, as Spark cuts them by bytes
        press = {h: _coder(zstandard.ZstdDecompressor, d) for h, d in dictionaries.items()}
        for batch in batches:
            for r in range(batch.num_rows):
                names = batch.column(2)[r].values
                base, digest = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
                offsets, starts = np.array(batch.column(3)[r].values), np.array(batch.column(4)[r].values) + base
                frames = memoryview(batch.column(5)[r].as_buffer())
                wanted = [i for i, x in enumerate(names.to_pylist()) if (first is None or x is not None and x >= first) and (last is None or x is not None and x <= last)]
                for at in range(0, len(wanted), 200):
                    some = wanted[at : at + 200]
                    ids = [press[digest].decompress(frames[offsets[i] : offsets[i + 1]]) for i in some]
                    sizes = np.array([len(x) // 4 for x in ids], np.int64)
                    yield pa.record_batch([names.take(pa.array(some, pa.int32())), pa.array(starts[some]), pa.array(sizes), pa.array(ids, pa.binary())], names=["doc", "start", "n_tokens", "ids"])

    return rows.mapInArrow(read, f"doc {kind}, start bigint, n_tokens bigint, ids binary")
