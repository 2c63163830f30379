"""Entities: stored tables, command payloads and request payloads."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import types as T

from pairwright.functions import (
    professor_document,
    project_document,
    skill_document,
    student_document,
)
from pairwright.functions.wording import UNDECLARED_MAJOR

STRING = T.StringType()
BOOLEAN = T.BooleanType()
TIMESTAMP = T.TimestampType()
STRINGS = T.ArrayType(STRING)
VECTOR = T.ArrayType(T.FloatType())

# Columns every stored table carries besides its own: the position of the change
# that wrote the row, and what it did ("U" upsert, "D" delete).
SEQ, OP = "seq", "op"
UPSERT, DELETE = "U", "D"
# Two more order the changes of a stored table: how many merges without a ``seq`` came before,
# and the version that wrote the row.
EPOCH, ARRIVAL = "epoch", "arrival"
ORDER = (EPOCH, SEQ, ARRIVAL)


@dataclass(frozen=True)
class EntitySpec:
    """One entity: its record, its labels and the text that is embedded.

    ``record`` and ``labels`` name the fields of a command: the record is nested
    under ``payload`` (the first name that is present wins), labels stand beside it.
    Only the record is stored; labels serve to render the document. A replaced table is
    ordered by ``cluster_by``, so that filters on these columns skip row groups.
    """

    table: str
    payload: tuple[str, ...]
    record: tuple[tuple[str, T.DataType], ...]
    labels: tuple[tuple[str, T.DataType], ...]
    required: tuple[str, ...]
    uuids: tuple[str, ...]
    uuid_arrays: tuple[str, ...]
    document: Callable[[], Column]
    defaults: tuple[tuple[str, str], ...] = ()
    cluster_by: tuple[str, ...] = ("id",)

    @property
    def table_schema(self) -> T.StructType:
        schema = T.StructType()
        for name, kind in self.record:
            schema.add(name, kind)
        schema.add("vector", VECTOR).add(SEQ, T.LongType()).add(OP, STRING)
        return schema.add(EPOCH, T.LongType()).add(ARRIVAL, T.LongType())

    @property
    def columns(self) -> list[str]:
        """Public columns of the stored table."""
        return [name for name, _ in self.record] + ["vector"]

    @property
    def command_schema(self) -> T.StructType:
        """Schema of one JSON command. Timestamps arrive as text and are parsed later."""
        record = T.StructType()
        for name, kind in self.record:
            record.add(name, STRING if kind == TIMESTAMP else kind)
        schema = T.StructType()
        for name in self.payload:
            schema.add(name, record)
        for name, kind in self.labels:
            schema.add(name, kind)
        return schema

    @property
    def timestamps(self) -> list[str]:
        return [name for name, kind in self.record if kind == TIMESTAMP]


SKILLS = EntitySpec(
    table="skills",
    payload=("skill",),
    record=(("id", STRING), ("name", STRING)),
    labels=(),
    required=("id", "name"),
    uuids=("id",),
    uuid_arrays=(),
    document=skill_document,
)

STUDENTS = EntitySpec(
    table="students",
    payload=("student",),
    record=(
        ("id", STRING),
        ("full_name", STRING),
        ("major_id", STRING),
        ("specialty_ids", STRINGS),
        ("skill_ids", STRINGS),
        ("about_me", STRING),
    ),
    labels=(("major_name", STRING), ("specialty_names", STRINGS), ("skill_names", STRINGS)),
    required=("id", "full_name"),
    uuids=("id", "major_id"),
    uuid_arrays=("specialty_ids", "skill_ids"),
    document=student_document,
    defaults=(("major_name", UNDECLARED_MAJOR),),
)

PROFESSORS = EntitySpec(
    table="professors",
    payload=("professor",),
    record=(
        ("id", STRING),
        ("full_name", STRING),
        ("department", STRING),
        ("rank", STRING),
        ("is_accepting_projects", BOOLEAN),
        ("research_interest_ids", STRINGS),
        ("about_me", STRING),
    ),
    labels=(("interest_areas", STRINGS),),
    required=("id", "full_name", "department", "rank", "is_accepting_projects"),
    uuids=("id",),
    uuid_arrays=("research_interest_ids",),
    document=professor_document,
    cluster_by=("is_accepting_projects", "id"),
)

PROJECTS = EntitySpec(
    table="project_templates",
    payload=("project_template", "template"),
    record=(
        ("id", STRING),
        ("title", STRING),
        ("description", STRING),
        ("provider_id", STRING),
        ("created_at", TIMESTAMP),
        ("skill_ids", STRINGS),
        ("major_id", STRING),
        ("specialty_id", STRING),
    ),
    labels=(("major_name", STRING), ("specialty_name", STRING), ("skill_names", STRINGS)),
    required=("id", "title", "description", "provider_id", "created_at"),
    uuids=("id", "provider_id", "major_id", "specialty_id"),
    uuid_arrays=("skill_ids",),
    document=project_document,
    cluster_by=("major_id", "id"),
)

# Bounds of a request's limit.
DEFAULT_LIMIT = 10
MAX_LIMIT = 100


@dataclass(frozen=True)
class RequestSpec:
    """One kind of recommendation request: its fields and which must be there."""

    name: str
    fields: tuple[tuple[str, T.DataType], ...]
    required: tuple[str, ...]
    uuids: tuple[str, ...] = ()

    @property
    def schema(self) -> T.StructType:
        schema = T.StructType().add("request_id", STRING)
        for name, kind in self.fields:
            schema.add(name, kind)
        return schema.add("limit", T.IntegerType())


_STUDENT_FIELDS = (
    ("major_name", STRING),
    ("specialty_names", STRINGS),
    ("skill_names", STRINGS),
    ("about_me", STRING),
)
PROJECT_REQUESTS = RequestSpec(
    "projects",
    _STUDENT_FIELDS + (("restrict_to_major_id", STRING),),
    ("major_name",),
    ("restrict_to_major_id",),
)
SKILL_REQUESTS = RequestSpec("skills", _STUDENT_FIELDS, ("major_name",))
ADVISOR_REQUESTS = RequestSpec(
    "professors",
    (
        ("title", STRING),
        ("description", STRING),
        ("major_name", STRING),
        ("specialty_name", STRING),
        ("skill_names", STRINGS),
    ),
    ("title", "description"),
)
