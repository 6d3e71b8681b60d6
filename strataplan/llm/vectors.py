"""Embedding tables as integer vectors, for the operators that count on exact arithmetic."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def integer_vectors(vectors: DataFrame, scale: int, *columns: str) -> DataFrame:
    """The given columns and ``x array<long>``, each component as floor(scale * component) in double
    precision (beyond a long: its nearest bound). Rows whose vector is null or holds null or non-finite
    components are left out."""
    v = F.transform("embedding", lambda c: c.cast("double"))
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.where(F.col("embedding").isNotNull() & finite).select(*columns, F.transform(v, lambda c: F.floor(c * F.lit(float(scale)))).alias("x"))


def by_length(rows: DataFrame) -> list[tuple[int, DataFrame]]:
    """The rows of each length of ``x``; vectors of different lengths have nothing in common."""
    lengths = sorted(r[0] for r in rows.select(F.size("x").alias("d")).distinct().collect())
    return [(d, rows.where(F.size("x") == d)) for d in lengths]


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def largest(x: np.ndarray) -> int:
    """Largest magnitude, as a Python integer."""
    return max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))


def narrow(x: np.ndarray) -> np.ndarray:
    """The smallest signed integer type that holds the values."""
    most = largest(x)
    for kind in (np.int8, np.int16, np.int32):
        if most <= np.iinfo(kind).max:
            return x.astype(kind)
    return x


def clipped(value: int) -> int:
    """The nearest long."""
    return max(-(2**63) + 1, min(2**63 - 1, int(value)))
