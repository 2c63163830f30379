"""Weighted rendezvous hashing of record keys over shards.

A key's score for a shard comes from a digest of both, so a key goes where its score is
highest whatever else exists: adding a shard takes keys only into it, raising a weight takes
keys only to that shard. No state is kept and nothing is broadcast.

Rows get a gapless place in their shard, in the order of the key's digest, which is a fixed
random order. Numbering counts the rows of narrow digest ranges first and adds the counts of
the ranges before, so a shard is numbered by many tasks. Rows alike in all of key, size and
checksum are counted as one group before the shuffle and numbered together, so one key may
hold any share of the rows.

A null text has no bytes. A null key is a key like any other. Ties of scores go to the smaller
shard number. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Hex digits of a digest that make a number below one; 13 digits fit a double exactly.
DIGITS = 13
# Rows of one digest range, on average.
RANGE_ROWS = 50_000
# Rows written out of one group of equal rows at a time.
COPIES_AT_ONCE = 4096


def unit(digest: Column) -> Column:
    """A number strictly between zero and one from a hex digest."""
    value = F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double")
    return (value + 0.5) / float(16**DIGITS)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard, from 0, with the highest weighted score for the key."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above zero")
    name = F.coalesce(key.cast("string"), F.lit("null"))
    scores = [
        F.struct(
            (-float(weight) / F.log(unit(F.md5(F.concat(name, F.lit(f"/{shard}")))))).alias("s"),
            F.lit(-shard).alias("n"),
        )
        for shard, weight in enumerate(weights)
    ]
    return -F.array_max(F.array(*scores))["n"]


def shard(
    rows: DataFrame,
    weights: Sequence[float],
    grown: Sequence[float],
    *,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``key, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    ``grown_shard`` is the shard under the weights ``grown``. ``size`` is the text's UTF-8
    length plus one.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    slim = rows.select(
        F.col(key),
        (F.octet_length(content) + 1).cast("long").alias("size"),
        F.crc32(content).alias("text_crc32"),
    )
    alike = slim.groupBy(key, "size", "text_crc32").agg(F.count("*").alias("copies"))
    alike = alike.select(
        "*",
        rendezvous(F.col(key), weights).cast("int").alias("shard"),
        rendezvous(F.col(key), grown).cast("int").alias("grown_shard"),
        F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null"))).alias("place"),
    )
    # The number of ranges follows the number of rows; one digest prefix is one range.
    n_rows = rows.count()
    prefix = 1
    while 16**prefix * RANGE_ROWS * len(weights) < n_rows:
        prefix += 1
    alike = alike.withColumn("prefix", F.substring("place", 1, prefix))
    counts = alike.groupBy("shard", "prefix").agg(F.sum("copies").alias("n"))
    before = Window.partitionBy("shard").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "shard", "prefix", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    within = (
        Window.partitionBy("shard", "prefix")
        .orderBy("place", "size", "text_crc32")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    numbered = alike.withColumn("earlier", F.coalesce(F.sum("copies").over(within), F.lit(0)))
    numbered = numbered.join(starts, ["shard", "prefix"])
    last = F.col("copies") - 1
    chunks = numbered.withColumn(
        "copy", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(COPIES_AT_ONCE).cast("long")))
    )
    every = chunks.withColumn(
        "copy",
        F.explode(
            F.sequence("copy", F.least(F.col("copy") + (COPIES_AT_ONCE - 1), last), F.lit(1).cast("long"))
        ),
    )
    return every.select(
        F.col(key),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("start") + F.col("earlier") + F.col("copy")).cast("long").alias("slot"),
        "grown_shard",
    )
