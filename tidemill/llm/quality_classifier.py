"""Compression quality classifier.

Two zstandard dictionaries are trained, on good and on bad labelled texts. A text is compressed in chunks
with either; how much smaller the good dictionary makes it, against the bad one and per byte, is the
feature, and a logistic curve fitted on other labelled texts turns it into the probability of label 1.

Training takes a bounded sample of the labelled rows (``Sample``), chosen by a hash of the id; scoring reads
every whole text once, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 2048
LEVEL = 3


@dataclass(frozen=True)
class Sample:
    """Bounds of the training sample: documents a class for the dictionaries and for the curve, and their length."""

    dictionary_docs: int = 1200
    curve_docs: int = 1500
    max_chars: int = 20_000
    dictionary_bytes: int = 131_072


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 0 when divided by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the raw texts where there are too few to train on."""
    chunks = [t[i : i + CHUNK] for t in texts for i in range(0, len(t), CHUNK)]
    if len(chunks) >= 100 and sum(map(len, chunks)) >= 8 * size:
        return zstandard.train_dictionary(size, chunks, level=LEVEL).as_bytes()
    return b"".join(chunks)[:size]


class _Sizes:
    """Compressed sizes of texts with the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.press = []
        for d in (good, bad):
            made = zstandard.ZstdCompressionDict(d) if d else None
            if made is not None:
                made.precompute_compress(level=LEVEL)
            options = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
            self.press.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=made, **options) if made is not None else zstandard.ZstdCompressor(level=LEVEL, **options))

    def features(self, text: bytes) -> tuple[float, float, float]:
        """1, the size difference (bad - good) over their sum, and the same times how much text there is."""
        sizes = [sum(len(p.compress(text[i : i + CHUNK])) for i in range(0, len(text), CHUNK)) for p in self.press]
        x = (sizes[1] - sizes[0]) / (sizes[0] + sizes[1]) if text else 0.0
        return 1.0, x, x * min(1.0, len(text) / CHUNK)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), gradient)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, sample: Sample = Sample(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit dictionaries and curve on labelled rows that are not held out.

    Labels other than 0 and 1 and ids with both are left out. Without rows of both classes the model knows
    only the share of label 1 (one half if there are no labels), which every text then scores.
    """
    known = labels.where(~held_out(id_col) & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("most"))
    known = known.where("y = most").select("id", F.col("y").cast("int").alias("y"))
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        p = min(0.99, max(0.01, totals.get(1, 0) / max(1, sum(totals.values())))) if totals else 0.5
        return Model(b"", b"", (float(np.log(p / (1 - p))), 0.0, 0.0))
    bound = sample.dictionary_docs + sample.curve_docs
    rank = F.xxhash64("id")
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(rank, "id").limit(bound)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most 2 * bound ids: small enough to broadcast
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text").between(1, sample.max_chars))
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text")).orderBy(rank, "id").collect()
    by = {y: [r["text"].encode() for r in rows if r["y"] == y] for y in (0, 1)}
    if not by[0] or not by[1]:
        p = totals[1] / (totals[0] + totals[1])
        return Model(b"", b"", (float(np.log(p / (1 - p))), 0.0, 0.0))
    # the curve takes texts that the dictionaries have not seen, half of them where labels are few
    cut = {y: min(sample.dictionary_docs, max(1, len(t) // 2)) for y, t in by.items()}
    least = min(sum(map(len, by[y][: cut[y]])) for y in by)
    size = max(1024, min(sample.dictionary_bytes, least // 8))
    good, bad = (_dictionary(by[y][: cut[y]], size) for y in (1, 0))
    sizes = _Sizes(good, bad)
    x, y, weight = [], [], []
    for label, texts_of in by.items():
        rest = texts_of[cut[label] :] or texts_of
        x += [sizes.features(t) for t in rest]
        y += [label] * len(rest)
        weight += [totals[label] / len(rest)] * len(rest)
    w = np.array(weight)
    return Model(good, bad, tuple(float(v) for v in _logistic(np.array(x), np.array(y, float), w * (len(w) / w.sum()))))


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``score`` (probability of label 1) and ``predicted`` of every row; null texts count as empty.

    Only the text enters the score. Rows that repeat are each answered; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, w = _Sizes(model.good, model.bad), np.array(model.weights)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).fill_null(b"")
            x = np.array([sizes.features(t.as_py()) for t in texts], float).reshape(-1, 3)
            yield pa.record_batch([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))))], names=["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
