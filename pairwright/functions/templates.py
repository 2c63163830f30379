"""The seven texts that are embedded, as expressions over flat columns.

Each takes its columns by name, with the names of the flat command and request
tables as defaults, so ``df.withColumn("document", student_document())`` works on
them directly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwright.functions import wording as w
from pairwright.functions.text import (
    fill,
    fill_if,
    has_items,
    is_filled,
    join_or,
    strip_text,
    text_or,
    with_period,
)


def skill_document(name="name") -> Column:
    return fill(w.SKILL_DOCUMENT, name=name)


def student_document(
    full_name="full_name",
    major_name="major_name",
    specialty_names="specialty_names",
    skill_names="skill_names",
    about_me="about_me",
) -> Column:
    return fill(
        w.STUDENT_DOCUMENT,
        full_name=full_name,
        major_name=major_name,
        specialties=join_or(specialty_names, w.STUDENT_NO_SPECIALTIES),
        skills=join_or(skill_names, w.STUDENT_NO_SKILLS),
        about=text_or(about_me, w.STUDENT_NO_ABOUT),
    )


def professor_document(
    full_name="full_name",
    department="department",
    rank="rank",
    interest_areas="interest_areas",
    about_me="about_me",
) -> Column:
    return fill(
        w.PROFESSOR_DOCUMENT,
        full_name=full_name,
        department=department,
        rank=rank,
        interests=join_or(interest_areas, w.PROFESSOR_NO_INTERESTS),
        about=text_or(about_me, w.PROFESSOR_NO_ABOUT),
    )


def project_document(
    title="title",
    description="description",
    major_name="major_name",
    specialty_name="specialty_name",
    skill_names="skill_names",
) -> Column:
    return fill(
        w.PROJECT_DOCUMENT,
        title=title,
        description=with_period(description),
        major=F.when(is_filled(major_name), fill(w.PROJECT_MAJOR, major_name=major_name)).otherwise(
            F.lit(w.PROJECT_NO_MAJOR)
        ),
        specialty=fill_if(
            is_filled(specialty_name), w.PROJECT_SPECIALTY, specialty_name=specialty_name
        ),
        skills=join_or(skill_names, w.PROJECT_NO_SKILLS),
    )


def project_query(
    major_name="major_name",
    specialty_names="specialty_names",
    skill_names="skill_names",
    about_me="about_me",
) -> Column:
    return fill(
        w.PROJECT_QUERY,
        major_name=major_name,
        specialties=join_or(specialty_names, w.PROJECT_QUERY_NO_SPECIALTIES),
        skills=join_or(skill_names, w.PROJECT_QUERY_NO_SKILLS),
        about=text_or(about_me, w.PROJECT_QUERY_NO_ABOUT),
    )


def skill_query(
    major_name="major_name",
    specialty_names="specialty_names",
    skill_names="skill_names",
    about_me="about_me",
) -> Column:
    return fill(
        w.SKILL_QUERY,
        major_name=major_name,
        specialties=fill_if(
            has_items(specialty_names),
            w.SKILL_QUERY_SPECIALTIES,
            names=join_or(specialty_names, ""),
        ),
        skills=join_or(skill_names, w.SKILL_QUERY_NO_SKILLS),
        about=fill_if(is_filled(about_me), w.SKILL_QUERY_ABOUT, about=strip_text(about_me)),
    )


def advisor_query(
    title="title",
    description="description",
    major_name="major_name",
    specialty_name="specialty_name",
    skill_names="skill_names",
) -> Column:
    return fill(
        w.ADVISOR_QUERY,
        major=fill_if(is_filled(major_name), w.ADVISOR_MAJOR, major_name=major_name),
        specialty=fill_if(
            is_filled(specialty_name), w.ADVISOR_SPECIALTY, specialty_name=specialty_name
        ),
        title=title,
        description=with_period(description),
        skills=join_or(skill_names, w.ADVISOR_NO_SKILLS),
    )
