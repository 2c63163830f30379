"""Column expressions: text, templates, ids and vectors."""

from pairwright.functions.ids import canonical_uuid
from pairwright.functions.templates import (
    advisor_query,
    professor_document,
    project_document,
    project_query,
    skill_document,
    skill_query,
    student_document,
)
from pairwright.functions.text import (
    fill,
    join_or,
    prefixed,
    strip_text,
    text_or,
    with_period,
)
from pairwright.functions.vectors import distance_key, l2_normalize, squared_l2

__all__ = [
    "advisor_query",
    "canonical_uuid",
    "distance_key",
    "fill",
    "join_or",
    "l2_normalize",
    "prefixed",
    "professor_document",
    "project_document",
    "project_query",
    "skill_document",
    "skill_query",
    "squared_l2",
    "strip_text",
    "student_document",
    "text_or",
    "with_period",
]
