"""Vectors as exact integers, for operators whose results must not depend on the order in which rows are added up."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructType

from latentspark.llm.common import written

#: Largest integer component: squared distances of parts of up to 1024 components, times 256, fit 64 bits.
LARGEST = 1 << 21
#: Rows that a worker turns into integers or compares at a time.
BLOCK = 4096


def packed(rows: np.ndarray) -> pa.Array:
    """A matrix as binary values, one a row."""
    rows = np.ascontiguousarray(rows)
    width = rows.itemsize * rows.shape[1]
    offsets = np.arange(len(rows) + 1, dtype=np.int64) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(rows.tobytes())])


def unpacked(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    """The matrix that :func:`packed` made."""
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = b"" if data is None or not len(column) else memoryview(data)[offsets[0] : offsets[-1]]
    return np.frombuffer(raw, dtype=dtype).reshape(-1, width)


def floored(column: pa.Array, scale: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Indexes of rows whose vector is whole, and their components times ``scale``, floored."""
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    at, rows = [], []
    for n in np.unique(lengths[lengths > 0]):
        have = np.flatnonzero(lengths == n)
        values = column.take(pa.array(have)).flatten()
        x = np.floor(float(scale) * values.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, n))
        whole = np.isfinite(x).all(axis=1)
        if whole.any() and np.abs(x[whole]).max() > LARGEST:
            raise ValueError(f"components must be at most {LARGEST / scale:g} in size for exact sums")
        at.append(have[whole])
        rows += list(x[whole].astype(np.int32))
    at = np.concatenate(at) if at else np.empty(0, dtype=np.int64)
    order = np.argsort(at, kind="stable")
    return at[order], [rows[i] for i in order]


def integer_rows(df: DataFrame, scale: float, id_col: str, vector_col: str, label_col: str | None = None) -> DataFrame:
    """(vec_id, label, n, q): every row with a whole vector, its length and ``floor(scale * x)`` as little-endian
    32-bit integers; a written table.

    Vectors that are null or empty or hold null or non-finite components go.
    Null ids and labels, repeated rows and repeated ids stay; other columns are
    left out, whatever their names. A component over ``LARGEST`` after scaling is an
    error, because its squares would not be exact."""
    label = df[label_col] if label_col else F.lit(None).cast("int")
    source = df.select(df[id_col].cast("long").alias("vec_id"), label.alias("label"), df[vector_col].cast("array<double>").alias("v"))
    labels = source.schema["label"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, BLOCK):
                part = b.slice(start, BLOCK)
                at, q = floored(part.column(2), scale)
                keep = part.take(pa.array(at))
                lengths = pa.array([len(r) for r in q], pa.int32())
                yield pa.RecordBatch.from_arrays([keep.column(0), keep.column(1), lengths, pa.array([r.astype("<i4").tobytes() for r in q], pa.binary())], ["vec_id", "label", "n", "q"])

    schema = StructType().add("vec_id", LongType()).add("label", labels.dataType).add("n", IntegerType()).add("q", BinaryType())
    return written(source.mapInArrow(rows, schema), "integer-vectors")


def floor_mean(total: list[int], n: int) -> list[int]:
    """Componentwise, rounded down; exact."""
    return [t // n for t in total]
