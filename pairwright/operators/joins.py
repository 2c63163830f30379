"""Joins of rows with a table that has each key once, where one key may have any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bytes of a table that may be broadcast.
BROADCAST_BYTES = 64 << 20


def join_counted(rows: DataFrame, table: DataFrame, key: str, size: str, row_bytes: int) -> DataFrame:
    """``rows`` with the columns of ``table`` by a key that is never null, as an inner join.

    ``table`` says in ``size`` how many of the rows have the key; ``row_bytes`` bounds one of its
    rows. A table that fits is broadcast. Otherwise its largest keys are, as many as fit however the rows
    are spread, and the others, none of which has many rows, meet theirs in a shuffle.
    """
    fits = max(1, BROADCAST_BYTES // row_bytes)
    found = table.agg(F.count("*").alias("keys"), F.sum(size).alias("rows")).first()
    if found["keys"] <= fits:
        return rows.join(F.broadcast(table), key)
    # No more than `fits` keys can have that many of the rows each.
    least = found["rows"] // fits + 1
    large, small = table.where(F.col(size) >= least), table.where(F.col(size) < least)
    in_large = rows.join(F.broadcast(large), key)
    others = rows.join(F.broadcast(large.select(key)), key, "left_anti")
    return in_large.unionByName(others.join(small, key))
