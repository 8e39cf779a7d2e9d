"""Helpers shared by the vector operators: integer components, matrices of Arrow lists, groups of sorted rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Inner products and squared distances of vectors stay below this, so that float64 arithmetic is exact.
EXACT = 1 << 53


def whole(vector: Column, dim: int | None = None) -> Column:
    """Whether a vector is there, has components (``dim`` of them, if given) and none is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    size = F.size(vector) > 0 if dim is None else F.size(vector) == dim
    return F.coalesce(vector.isNotNull() & size & ~bad, F.lit(False))


def floored(vector: Column, scale: int, valid: Column, most: int = 1 << 26) -> Column:
    """Components as integers floor(scale * x), null where not ``valid``.

    A component beyond ``most`` raises, as sums of products would not fit into a long. ``valid`` is told here too, as
    a plan may compute columns before it drops rows.
    """

    def number(x: Column) -> Column:
        y = F.lit(float(scale)) * x.cast("double")
        return F.when(F.abs(y) > most, F.raise_error(F.lit(f"a component is beyond {most} / {scale}")).cast("bigint")).otherwise(F.floor(y))

    return F.when(valid, F.transform(vector, number))


def matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """Rows of a list column without nulls, all of one length, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1 if len(column) else dim or 0)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the integer rows of ``a`` with those of ``b``."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if a.shape[1] * int(np.abs(a).max()) * int(np.abs(b).max()) < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], most: int | None = None) -> Iterator[pa.Table]:
    """Rows that agree in all ``keys``, of batches sorted by them; only the last group is held over a batch's end.

    With ``most``, groups come in pieces of so many rows and less than a piece is held.
    """
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        if most and sum(t.num_rows for t in held) < most:
            continue
        some = pa.concat_tables(held)
        cuts = [0, *_cuts(some, keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield from _pieces(some.slice(a, b - a), most)
        rest = some.slice(cuts[-1])
        if most:
            pieces = rest.num_rows // most * most
            yield from _pieces(rest.slice(0, pieces), most)
            rest = rest.slice(pieces)
        held = [rest] if rest.num_rows else []
    if held:
        some = pa.concat_tables(held)
        cuts = [0, *_cuts(some, keys), some.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield from _pieces(some.slice(a, b - a), most)


def _pieces(rows: pa.Table, most: int | None) -> Iterator[pa.Table]:
    for first in range(0, rows.num_rows, most or max(rows.num_rows, 1)):
        yield rows.slice(first, most or rows.num_rows)


def _cuts(rows: pa.Table, keys: Sequence[str]) -> list[int]:
    """Where the rows begin that differ from the row before."""
    new = np.zeros(max(rows.num_rows - 1, 0), bool)
    for k in keys:
        column = rows[k].combine_chunks()
        new |= pc.fill_null(pc.not_equal(column[1:], column[:-1]), True).to_numpy(zero_copy_only=False) & ~(column[1:].is_null().to_numpy(False) & column[:-1].is_null().to_numpy(False))
    return (np.flatnonzero(new) + 1).tolist()
