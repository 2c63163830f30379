"""Vector expressions. Arithmetic is in double; stored vectors are float arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Distances are compared after rounding to this many steps per unit: vectors are
# stored as 32-bit floats, so finer differences are noise, and rounding makes equal
# distances compare equal whatever the order of summation was.
DISTANCE_STEPS = 1e9


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def l2_normalize(vector: Column | str) -> Column:
    """Vector divided by its Euclidean norm; a zero vector stays zero."""
    vector = _column(vector)
    norm = F.sqrt(
        F.aggregate(
            vector,
            F.lit(0.0),
            lambda total, x: total + x.cast("double") * x.cast("double"),
        )
    )
    return F.when(
        norm > 0, F.transform(vector, lambda x: (x.cast("double") / norm).cast("float"))
    ).otherwise(vector)


def squared_l2(left: Column | str, right: Column | str) -> Column:
    """Squared Euclidean distance of two vectors of one length."""
    squares = F.zip_with(
        _column(left),
        _column(right),
        lambda a, b: (a.cast("double") - b.cast("double"))
        * (a.cast("double") - b.cast("double")),
    )
    return F.aggregate(squares, F.lit(0.0), lambda total, x: total + x)


def distance_key(distance: Column) -> Column:
    """Distance as a whole number of ``1 / DISTANCE_STEPS``, for ranking."""
    return F.floor(distance * F.lit(DISTANCE_STEPS) + F.lit(0.5)).cast("long")
