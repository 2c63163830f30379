"""Vectors of real numbers as whole numbers, exactly."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Numbers below this have a floor that fits 64 bits under every scale used here.
NARROW = 2.0**44
# Numbers from this on are whole, so that they need no floor and no product that may overflow.
WHOLE = 2.0**53


def finite(vector: Column | str) -> Column:
    """The vector is there and all its components are finite numbers."""
    vector = F.col(vector) if isinstance(vector, str) else vector

    def good(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    return F.coalesce(F.forall(vector, good), F.lit(False))


def usual_length(vectors: DataFrame, vector: str) -> int:
    """The length that most vectors have, the longer of two as frequent; 0 for an empty table."""
    lengths = vectors.groupBy(F.size(vector).alias("n")).count()
    most = lengths.orderBy(F.desc("count"), F.desc("n")).first()
    return most["n"] if most else 0


def flat(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """All components of a list column end to end, in double precision."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(values, pa.ChunkedArray):
        values = pa.concat_arrays(values.chunks)
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)


def floors(values: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of each number, ``scale`` a power of two no larger than 4096: 64-bit
    integers, or Python's own where one of them is too large for that.

    A product with a power of two is exact in double precision unless it overflows.
    """
    if not len(values) or np.abs(values).max() < NARROW:
        return np.floor(values * scale).astype(np.int64)
    return np.array(
        [math.floor(x * scale) if abs(x) < WHOLE else int(x) * scale for x in values.tolist()],
        dtype=object,
    )
