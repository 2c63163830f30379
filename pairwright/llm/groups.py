"""Joining rows with figures of their groups, where one group may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright.operators.changes import FILTER_WORDS, LEAST_BITS, split_by_filter

# Rows of a table of figures that may be broadcast: narrow ones, some 100 bytes each.
BROADCAST_ROWS = 200_000
# Keys, or pairs of keys, of fixed width that may be broadcast: some 50 MB.
BROADCAST_KEYS = 1_000_000


def with_figures(rows: DataFrame, figures: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` with the columns of ``figures``, which has one row for each ``key`` (null is a key
    like any other) and in ``size`` how many of the rows have it.

    Few figures are broadcast. Of more only those of groups so large that no more than
    ``BROADCAST_ROWS`` of them can exist; the other groups are small and meet in a shuffle.
    """
    other = f"_{key}"
    figures = figures.withColumnRenamed(key, other)
    match = F.col(key).eqNullSafe(F.col(other))
    found = figures.agg(F.count("*").alias("groups"), F.sum(size).alias("rows")).first()
    if found["groups"] <= BROADCAST_ROWS:
        return rows.join(F.broadcast(figures), match).drop(other)
    # At most rows / least groups have as many rows as that.
    least = found["rows"] // BROADCAST_ROWS + 1
    large, small = figures.filter(F.col(size) >= least), figures.filter(F.col(size) < least)
    in_large = rows.join(F.broadcast(large), match)
    others = rows.join(F.broadcast(large.select(other)), match, "left_anti")
    return in_large.union(others.join(small, match)).drop(other)


def narrow(table: DataFrame) -> DataFrame:
    """``table`` marked for broadcast if its columns are numbers and it has few enough rows."""
    fixed = all(isinstance(f.dataType, T.NumericType) for f in table.schema)
    return F.broadcast(table) if fixed and table.count() <= BROADCAST_KEYS else table


def among(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is in ``keys``, a written table with each key once in its one column.

    Wide rows stay where they are: few keys are broadcast, of more a Bloom filter is, and only the
    rows that it lets through are shuffled. Beyond what a filter may hold all rows are.
    """
    keys = keys.toDF(key)
    n_keys = keys.count()
    fixed = isinstance(keys.schema[key].dataType, T.NumericType)
    if fixed and n_keys <= BROADCAST_KEYS:
        return rows.join(F.broadcast(keys), key, "left_semi")
    if n_keys * LEAST_BITS <= FILTER_WORDS * 64:
        held = rows.select(F.col(key).alias("id"), F.struct("*").alias("row"))
        _, maybe = split_by_filter(held, keys.toDF("id"), n_keys)
        rows = maybe.select(*[F.col("row")[c].alias(c) for c in rows.columns])
    return rows.join(keys, key, "left_semi")
