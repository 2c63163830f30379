"""Joins by id: names of ids, rows of ids, labels of id arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.functions import canonical_uuid
from pairwright.operators.changes import BROADCAST_IDS

# A map is searched from front to back, so it pays for small dimensions only.
MAP_ROWS = 256


def asked_for(table: DataFrame, ids: DataFrame, n_ids: int | None = None) -> DataFrame:
    """Rows of the table whose id is asked for, each once.

    The table is only scanned where the ids fit a broadcast: ``n_ids`` says so, or Spark's
    own estimate.
    """
    ids = ids.select("id").distinct()
    if n_ids is not None and n_ids <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return table.join(ids, "id", "left_semi")


def row_of(table: DataFrame, ident: str) -> DataFrame:
    """The row with one id, if there is one: the comparison reaches the scan, and row groups
    of a table ordered by id are skipped."""
    return table.where(F.col("id") == canonical_uuid(F.lit(ident))).limit(1)


def names_by_ids(
    table: DataFrame, ids: DataFrame, name: str = "name", n_ids: int | None = None
) -> DataFrame:
    """Names of the rows whose id is asked for; each row once, unknown ids ignored."""
    return asked_for(table.select("id", name), ids, n_ids).select(name)


def lookup(
    table: DataFrame, ids: DataFrame, columns: list[str], n_ids: int | None = None
) -> DataFrame:
    """Every id asked for with ``columns`` of its row; ``found`` is false where there is none.

    The table is cut down to the ids first, so the outer join is between small sides.
    """
    rows = asked_for(table.select("id", *columns), ids, n_ids).withColumn("found", F.lit(True))
    return ids.join(rows, "id", "left").withColumn(
        "found", F.coalesce(F.col("found"), F.lit(False))
    )


def enrich(
    records: DataFrame,
    ids: str,
    dimension: DataFrame,
    output: str,
    name: str = "name",
    key: str = "id",
) -> DataFrame:
    """``records`` with the names of an id array, in the array's order; unknown ids vanish.

    Rows of ``dimension`` without a name are as unknown as missing ones, and of an id in several
    rows the smallest name counts. Up to ``MAP_ROWS`` rows it becomes a literal map, and
    names are looked up inside the arrays: nothing is shuffled. A larger dimension is joined:
    only the ids are exploded and regrouped, and a record's names are never more than its own
    array. ``key`` need not be unique.
    """
    found = F.array().cast("array<string>")
    named = dimension.select(F.col("id").alias("_id"), F.col(name).alias("_name"))
    named = named.where("_id is not null and _name is not null")
    named = named.groupBy("_id").agg(F.min("_name").alias("_name"))
    few = named.limit(MAP_ROWS + 1).collect()
    if len(few) <= MAP_ROWS:
        pairs = [F.lit(part) for row in few for part in row]
        names = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string, string>")
        known = F.array_compact(F.transform(ids, lambda ident: F.element_at(names, ident)))
        return records.withColumn(output, F.coalesce(known, found))
    numbered = records.withColumn("_record", F.to_json(F.struct(key, ids)))
    pairs = numbered.select("_record", ids).distinct().select("_record", F.posexplode(ids).alias("_pos", "_id"))
    lists = (
        pairs.join(named, "_id")
        .groupBy("_record")
        .agg(F.array_sort(F.collect_list(F.struct("_pos", "_name"))).alias("_found"))
        .select("_record", F.transform("_found", lambda pair: pair["_name"]).alias(output))
    )
    return numbered.join(lists, "_record", "left").drop("_record").withColumn(
        output, F.coalesce(F.col(output), found)
    )


def name_of(
    records: DataFrame, ident: str, dimension: DataFrame, output: str, name: str = "name"
) -> DataFrame:
    """``records`` with the name of a single id; null where the id is null or unknown.

    Rows without an id keep out of the join, so they do not gather in one task.
    """
    names = dimension.select(F.col("id").alias(ident), F.col(name).alias(output))
    without = records.where(F.col(ident).isNull()).withColumn(
        output, F.lit(None).cast(names.schema[output].dataType)
    )
    return records.where(F.col(ident).isNotNull()).join(names, ident, "left").unionByName(without)
