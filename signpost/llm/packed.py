"""Vectors of whole numbers in binary columns, and sums of them over all tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Components from this on are not representable: squares and products of 64 of them would pass 64 bits.
LIMIT = 2**27
#: Tasks that add up the tasks' partial sums before the driver adds up theirs.
ADDERS = 32


def integer_rows(column: pa.Array, scale: int, dim: int | None = None) -> tuple[np.ndarray, list[np.ndarray] | np.ndarray]:
    """Places of the usable vectors of a list column, and floor(scale * x) of each.

    Usable: neither null nor holding null, NaN, infinite or unrepresentable components, and of `dim` components if that
    is given. With `dim` the vectors are one matrix, else a list.
    """
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths >= 0 if dim is None else lengths == dim)
    flat = column.take(pa.array(at, pa.int64())).flatten()
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(flat.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float) * scale)
        good = np.abs(x) < LIMIT
    if dim is not None:
        rows = x.reshape(len(at), dim)
        usable = good.reshape(len(at), dim).all(axis=1)
        return at[usable], rows[usable].astype(np.int32)
    ends = np.cumsum(lengths[at])
    bad = np.concatenate([[0], np.cumsum(~good)])
    usable = bad[ends] == bad[ends - lengths[at]]
    return at[usable], [x[e - n : e].astype(np.int32) for e, n in zip(ends[usable], lengths[at][usable], strict=True)]


def pack(rows: np.ndarray) -> pa.Array:
    """A binary value per row of a matrix."""
    n = len(rows)
    width = rows.dtype.itemsize * rows.shape[1]
    offsets = (np.arange(n + 1, dtype=np.int64) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def unpack(column: pa.Array, dtype, width: int) -> np.ndarray:
    """The matrix behind a binary column without nulls, all values being of `width` numbers."""
    if not len(column):
        return np.zeros((0, width), dtype)
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    count = len(column) * width
    return np.frombuffer(column.buffers()[2], dtype, count, int(offsets[0])).reshape(len(column), width)


def tree_sum(rows: DataFrame, dtype, width: int) -> np.ndarray:
    """Sum of the binary column `part`: rows of `width` numbers, one per task; the driver gets ADDERS rows at most."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, dtype)
        for b in batches:
            total += unpack(b.column("part"), dtype, width).sum(axis=0, dtype=dtype)
        yield pa.RecordBatch.from_arrays([pack(total[None, :])], ["part"])

    total = np.zeros(width, dtype)
    for row in rows.repartition(ADDERS).mapInArrow(add, "part binary").collect():
        total += np.frombuffer(row.part, dtype)
    return total
