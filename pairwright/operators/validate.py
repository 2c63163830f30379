"""Rules for commands and requests, as one array of reasons per row.

A rule is a condition on columns; a row with no reason is valid. The rules are
written against a field accessor so that they apply to flat columns as well as to
the elements of an array of commands, without exploding it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright.functions import canonical_uuid
from pairwright.schemas import DELETE, MAX_LIMIT, UPSERT, EntitySpec, RequestSpec

Field = Callable[[str], Column]
REASONS = "reasons"


def _missing(field: Field, name: str) -> Column:
    return F.when(field(name).isNull(), F.lit(f"{name}: missing"))


def _not_uuid(field: Field, name: str) -> Column:
    value = field(name)
    return F.when(
        value.isNotNull() & canonical_uuid(value).isNull(), F.lit(f"{name}: not a uuid")
    )


def _not_uuids(field: Field, name: str) -> Column:
    bad = F.exists(field(name), lambda value: canonical_uuid(value).isNull())
    return F.when(F.coalesce(bad, F.lit(False)), F.lit(f"{name}: not a uuid"))


def _null_items(field: Field, name: str) -> Column:
    nulls = F.exists(field(name), lambda value: value.isNull())
    return F.when(F.coalesce(nulls, F.lit(False)), F.lit(f"{name}: null item"))


def _arrays(fields: tuple[tuple[str, T.DataType], ...]) -> list[str]:
    return [name for name, kind in fields if isinstance(kind, T.ArrayType)]


def _not_timestamp(field: Field, name: str) -> Column:
    value = field(name)
    return F.when(
        value.isNotNull() & F.try_to_timestamp(value).isNull(),
        F.lit(f"{name}: not a timestamp"),
    )


def command_problems(spec: EntitySpec, field: Field) -> Column:
    """Reasons why a command of this entity is not acceptable."""
    return F.array_compact(
        F.array(
            *[_missing(field, name) for name in spec.required],
            *[_not_uuid(field, name) for name in spec.uuids],
            *[_not_uuids(field, name) for name in spec.uuid_arrays],
            *[_not_timestamp(field, name) for name in spec.timestamps],
            *[_null_items(field, name) for name in _arrays(spec.labels)],
        )
    )


def request_problems(spec: RequestSpec, field: Field) -> Column:
    """Reasons why a recommendation request is not acceptable."""
    limit = field("limit")
    return F.array_compact(
        F.array(
            *[_missing(field, name) for name in ("request_id", *spec.required)],
            *[_not_uuid(field, name) for name in spec.uuids],
            *[_null_items(field, name) for name in _arrays(spec.fields)],
            F.when((limit < 1) | (limit > MAX_LIMIT), F.lit("limit: out of range")),
        )
    )


def id_problems(field: Field) -> Column:
    """Reasons why a delete command is not acceptable."""
    return F.array_compact(F.array(_missing(field, "id"), _not_uuid(field, "id")))


def op_problem(op: Column) -> Column:
    """The reason why a change's ``op`` is not acceptable; a missing one means an upsert."""
    return F.when(op.isNotNull() & ~op.isin(UPSERT, DELETE), F.lit("op: unknown"))


def split(df: DataFrame, problems: Column) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others with their ``reasons``."""
    checked = df.withColumn(REASONS, problems)
    return (
        checked.where(F.size(REASONS) == 0).drop(REASONS),
        checked.where(F.size(REASONS) > 0),
    )
