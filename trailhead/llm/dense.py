"""Vector columns as numpy matrices inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType


def entries(df: DataFrame, vector: str) -> Column:
    """The vector column as array<float> where it is that already, else as array<double>."""
    kind = df.schema[vector].dataType
    plain = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    return F.col(f"`{vector}`") if plain else F.col(f"`{vector}`").cast("array<double>")


def finite(vector: Column) -> Column:
    """True where the vector is there and every entry is a finite number."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """One row of doubles per vector; shorter vectors are filled up with zeros."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def stacked(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    """A binary column whose rows hold ``width`` numbers each, as one matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width)


def binaries(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as a binary column, without a copy per row."""
    data = np.ascontiguousarray(rows)
    step = data.shape[1] * data.itemsize
    offsets = np.arange(len(data) + 1, dtype=np.int32) * np.int32(step)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])
