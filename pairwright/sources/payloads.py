"""JSON commands, bulk payloads, change feeds and requests as DataFrames.

Reading declares the schema, so nothing is inferred. ``unpack`` turns nested
commands into flat columns as they came; ``typed`` gives them their final types and
defaults. Rules run in between, on the values as they came.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright.functions import canonical_uuid
from pairwright.operators.validate import (
    REASONS,
    command_problems,
    op_problem,
    request_problems,
    split,
)
from pairwright.schemas import (
    DEFAULT_LIMIT,
    DELETE,
    OP,
    SEQ,
    UPSERT,
    EntitySpec,
    RequestSpec,
)

MALFORMED = "_corrupt_record"

# The order of a bulk payload's items among all: the payload's ``seq``, the payload, the place.
PLACE = "_place_in_bulk"


def envelope(schema: T.StructType) -> T.StructType:
    return T.StructType(schema.fields + [T.StructField(MALFORMED, T.StringType())])


def feed_schema(spec: EntitySpec) -> T.StructType:
    """Schema of a change feed: a command with ``seq`` and ``op``, or an ``id`` to delete."""
    extra = T.StructType().add(SEQ, T.LongType()).add(OP, T.StringType()).add("id", T.StringType())
    return envelope(T.StructType(extra.fields + spec.command_schema.fields))


def read_commands(spark: SparkSession, spec: EntitySpec, path: str) -> DataFrame:
    """JSON lines, one command each, unpacked."""
    return unpack(spark.read.schema(feed_schema(spec)).json(path), spec)


def read_feed(spark: SparkSession, spec: EntitySpec, path: str, **options: str) -> DataFrame:
    """The same as a stream of files landing in ``path``."""
    return unpack(spark.readStream.options(**options).schema(feed_schema(spec)).json(path), spec)


def read_bulk(spark: SparkSession, spec: EntitySpec, path: str) -> DataFrame:
    """JSON lines, one bulk payload ``{"seq": n, "items": [command, ...]}`` each."""
    schema = T.StructType().add(SEQ, T.LongType()).add("items", T.ArrayType(spec.command_schema))
    return spark.read.schema(envelope(schema)).json(path)


def read_requests(spark: SparkSession, spec: RequestSpec, path: str) -> DataFrame:
    """JSON lines, one recommendation request each."""
    return spark.read.schema(envelope(spec.schema)).json(path)


def record_of(spec: EntitySpec, command: Column | None) -> Column:
    """The nested record of a command; of its alternative names the first listed wins."""
    names = [F.col(name) if command is None else command[name] for name in spec.payload]
    return names[0] if len(names) == 1 else F.coalesce(*names)


def unpack(
    commands: DataFrame, spec: EntitySpec, command: str | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Flat columns of nested commands, values as they came.

    ``command`` names a struct column that holds the command; without it the command's
    fields are the columns of the table.
    """
    holder = F.col(command) if command else None
    record = record_of(spec, holder)
    at_top = set(commands.columns)
    columns = [F.col(name) for name in keep]
    for name, _ in spec.record:
        value = record[name]
        if name == "id" and holder is None and "id" in at_top:
            value = F.coalesce(value, F.col("id"))
        columns.append(value.alias(name))
    for name, _ in spec.labels:
        columns.append((F.col(name) if holder is None else holder[name]).alias(name))
    columns += [F.col(name) for name in (SEQ, OP, MALFORMED) if name in at_top and name not in keep]
    return commands.select(*columns)


def typed(flat: DataFrame, spec: EntitySpec) -> DataFrame:
    """Canonical ids, parsed timestamps and defaults of unpacked commands.

    A missing ``seq`` stays missing: the store orders such a command by its arrival.
    """
    changes: dict[str, Column] = {name: canonical_uuid(name) for name in spec.uuids}
    for name, kind in (*spec.record, *spec.labels):
        if isinstance(kind, T.ArrayType):
            value = F.col(name)
            if name in spec.uuid_arrays:
                value = F.transform(value, canonical_uuid)
            changes[name] = F.coalesce(value, F.array().cast(kind))
    for name in spec.timestamps:
        changes[name] = F.try_to_timestamp(F.col(name))
    for name, default in spec.defaults:
        changes[name] = F.coalesce(F.col(name), F.lit(default))
    if OP in flat.columns:
        changes[OP] = F.coalesce(F.col(OP), F.lit(UPSERT))
    return flat.withColumns(changes).drop(MALFORMED)


def accept(flat: DataFrame, spec: EntitySpec) -> tuple[DataFrame, DataFrame]:
    """Valid commands, typed, and the rejected ones as they came with their reasons.

    A change that deletes needs nothing but its id.
    """
    problems = command_problems(spec, F.col)
    if OP in flat.columns:
        only_id = F.filter(problems, lambda reason: reason.startswith("id:"))
        problems = F.when(F.col(OP) == DELETE, only_id).otherwise(problems)
        problems = F.concat(problems, F.array_compact(F.array(op_problem(F.col(OP)))))
    if MALFORMED in flat.columns:
        problems = F.when(
            F.col(MALFORMED).isNotNull(), F.array(F.lit("payload: malformed"))
        ).otherwise(problems)
    valid, rejected = split(flat, problems)
    return typed(valid, spec), rejected


def explode_items(
    payloads: DataFrame, spec: EntitySpec, keep: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """Items of bulk payloads as typed commands, and the payloads rejected.

    A payload with one bad item is rejected whole. That is decided inside the array,
    so no shuffle is needed. Of an id given twice the later one counts: by the payload's
    ``seq`` (payloads without one come last), then by the order of payloads as read, then by
    the position, ``pos``.
    """

    def is_bad(item: Column) -> Column:
        record = record_of(spec, item)
        labels = {name for name, _ in spec.labels}
        problems = command_problems(
            spec, lambda name: item[name] if name in labels else record[name]
        )
        return F.size(problems) > 0

    # A null item of an array makes exists() unknown; it is a bad item as well.
    bad = F.exists("items", lambda item: item.isNull() | is_bad(item))
    problems = F.array_compact(
        F.array(
            F.when(F.col("items").isNull(), F.lit("items: missing")),
            F.when(bad, F.lit("items: invalid")),
        )
    )
    if MALFORMED in payloads.columns:
        problems = F.when(
            F.col(MALFORMED).isNotNull(), F.array(F.lit("payload: malformed"))
        ).otherwise(problems)
    valid, rejected = split(payloads, problems)
    own = F.col(SEQ) if SEQ in payloads.columns else F.lit(None).cast("long")
    items = valid.select(
        *keep,
        own.alias(SEQ),
        F.monotonically_increasing_id().alias("_payload"),
        F.posexplode("items").alias("pos", "item"),
    ).withColumn(PLACE, F.struct(F.col(SEQ).isNull().alias("without"), SEQ, "_payload", "pos"))
    return typed(unpack(items, spec, "item", keep=(*keep, "pos", SEQ, PLACE)), spec), rejected


def accept_requests(requests: DataFrame, spec: RequestSpec) -> tuple[DataFrame, DataFrame]:
    """Valid requests with defaults filled in, and the rejected ones with reasons.

    Columns that the request may lack are added as null first.
    """
    absent = {
        name: F.lit(None).cast(kind)
        for name, kind in ((f.name, f.dataType) for f in spec.schema)
        if name not in requests.columns
    }
    requests = requests.withColumns(absent) if absent else requests
    problems = request_problems(spec, F.col)
    if MALFORMED in requests.columns:
        problems = F.when(
            F.col(MALFORMED).isNotNull(), F.array(F.lit("payload: malformed"))
        ).otherwise(problems)
    valid, rejected = split(requests, problems)
    changes: dict[str, Column] = {name: canonical_uuid(name) for name in spec.uuids}
    changes["limit"] = F.coalesce(F.col("limit"), F.lit(DEFAULT_LIMIT)).cast("int")
    return valid.withColumns(changes).drop(MALFORMED), rejected


__all__ = [
    "REASONS",
    "accept",
    "accept_requests",
    "explode_items",
    "feed_schema",
    "read_bulk",
    "read_commands",
    "read_feed",
    "read_requests",
    "typed",
    "unpack",
]
