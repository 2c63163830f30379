"""Templates and text expressions against expected strings and against Python."""

import random
import uuid

import pytest

from pairwright.functions import (
    advisor_query,
    canonical_uuid,
    join_or,
    professor_document,
    project_document,
    project_query,
    skill_document,
    skill_query,
    strip_text,
    student_document,
    text_or,
    with_period,
)
from pairwright.functions.wording import WHITESPACE

STUDENT = "full_name string, major_name string, specialty_names array<string>, skill_names array<string>, about_me string"
PROFESSOR = "full_name string, department string, rank string, interest_areas array<string>, about_me string"
PROJECT = "title string, description string, major_name string, specialty_name string, skill_names array<string>"

GOLDEN = [
    (
        skill_document,
        "name string",
        ("Soil Sampling",),
        "Technical and professional competency skill: Soil Sampling",
    ),
    (
        student_document,
        STUDENT,
        ("Ida Moss", "Botany", ["Ferns", "Mosses"], ["Drawing"], " \t Likes rain. "),
        "Student Profile: Ida Moss. Primary Academic Major Path: Botany. "
        "Sub-Track Concentrations: Ferns, Mosses. Technical Competency Skill Matrix: Drawing. "
        "Personal Background and Career Aspirations: Likes rain.",
    ),
    (
        student_document,
        STUDENT,
        ("Ida Moss", "Botany", [], None, None),
        "Student Profile: Ida Moss. Primary Academic Major Path: Botany. "
        "Sub-Track Concentrations: No specialized sub-tracks designated. "
        "Technical Competency Skill Matrix: No technical skills indexed yet. "
        "Personal Background and Career Aspirations: No professional biography or summary provided.",
    ),
    (
        professor_document,
        PROFESSOR,
        ("Prof. Reed", "Biology", "Dean", ["Rivers", "Lakes"], "\nRuns the pond lab. "),
        "Academic Faculty Professor Profile: Prof. Reed. Department Division: Biology. "
        "Institutional Rank: Dean. Active Research Interest Domains: [Rivers, Lakes]. "
        "Biography, Research Focus, and Lab Direction: Runs the pond lab.",
    ),
    (
        professor_document,
        PROFESSOR,
        ("Prof. Reed", "Biology", "Dean", None, ""),
        "Academic Faculty Professor Profile: Prof. Reed. Department Division: Biology. "
        "Institutional Rank: Dean. "
        "Active Research Interest Domains: [General academic supervision and instruction]. "
        "Biography, Research Focus, and Lab Direction: No professional biography or lab summary provided.",
    ),
    (
        project_document,
        PROJECT,
        ("Pond Map", " Map all ponds ", "Geography", "Water", ["GIS", "Rowing"]),
        "Academic Project Assignment Blueprint. Project Title: Pond Map. "
        "Core Description, Scope, and Deliverable Objectives: Map all ponds. "
        "Academic Requirements: Targeted primarily toward Geography academic paths. "
        "Aligned with the Water specialization track. "
        "Required Student Technical Competencies: [GIS, Rowing].",
    ),
    (
        project_document,
        PROJECT,
        ("Pond Map", "Map all ponds.", None, "", []),
        "Academic Project Assignment Blueprint. Project Title: Pond Map. "
        "Core Description, Scope, and Deliverable Objectives: Map all ponds. "
        "Academic Requirements: Open to all general majors. "
        "Required Student Technical Competencies: [General cross-functional capabilities].",
    ),
    (
        project_query,
        STUDENT,
        ("-", "Botany", ["Ferns"], ["Drawing", "Latin"], " plants "),
        "Find academic project assignment blueprints and research opportunities that strongly align "
        "with a student majoring in Botany, pursuing concentrations in [Ferns], "
        "who possesses technical expertise in [Drawing, Latin], and is deeply interested in: plants",
    ),
    (
        project_query,
        STUDENT,
        ("-", "Botany", None, [], None),
        "Find academic project assignment blueprints and research opportunities that strongly align "
        "with a student majoring in Botany, pursuing concentrations in [general curriculum studies], "
        "who possesses technical expertise in [foundational academic concepts], "
        "and is deeply interested in: practical applied learning experiences",
    ),
    (
        skill_query,
        STUDENT,
        ("-", "Botany", ["Ferns", "Mosses"], ["Latin"], " gardens "),
        "Identify complementary industry skills, technical frameworks, or professional competencies "
        "that are highly relevant or a natural progression for a Botany student "
        "specializing in Ferns, Mosses who currently knows [Latin]. Career focus: gardens",
    ),
    (
        skill_query,
        STUDENT,
        ("-", "Botany", [], None, ""),
        "Identify complementary industry skills, technical frameworks, or professional competencies "
        "that are highly relevant or a natural progression for a Botany student "
        "who currently knows [beginner academic tracks].",
    ),
    (
        # Blank text counts as given: it strips to nothing and leaves its label behind.
        skill_query,
        STUDENT,
        ("-", "Botany", [], None, "   "),
        "Identify complementary industry skills, technical frameworks, or professional competencies "
        "that are highly relevant or a natural progression for a Botany student "
        "who currently knows [beginner academic tracks]. Career focus: ",
    ),
    (
        advisor_query,
        PROJECT,
        ("Pond's Map", "Map all ponds", "Geography", "Water", ["GIS"]),
        "Identify an academic faculty professor and research advisor in the Geography department "
        "focusing on Water whose expert research interests, industry backgrounds, and current lab "
        "direction directly align with supervising a student project titled 'Pond's Map'. "
        "The project entails: Map all ponds. "
        "The supervisor should have background relevant to these student competencies: [GIS].",
    ),
    (
        advisor_query,
        PROJECT,
        ("Pond Map", "", None, None, None),
        "Identify an academic faculty professor and research advisor "
        "whose expert research interests, industry backgrounds, and current lab "
        "direction directly align with supervising a student project titled 'Pond Map'. "
        "The project entails: . "
        "The supervisor should have background relevant to these student competencies: [academic research methods].",
    ),
]


@pytest.mark.parametrize("template, schema, row, expected", GOLDEN)
def test_template(spark, template, schema, row, expected):
    assert spark.createDataFrame([row], schema).select(template()).first()[0] == expected


def test_strip_equals_python(spark):
    rng = random.Random(7)
    inner = WHITESPACE + "ab.​é᠎﻿"
    texts = ["".join(rng.choices(inner, k=rng.randint(0, 9))) for _ in range(2000)]
    texts += list(WHITESPACE)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strip_text("t"))
    assert all(got == text.strip() for text, got in rows.collect())


def test_descriptions_get_one_period_only_where_none_is(spark):
    given = {"a": "a.", "a.": "a.", "a...": "a...", "": ".", " a. ": "a.", " a\x1c": "a."}
    rows = spark.createDataFrame([(t,) for t in given], "t string").select("t", with_period("t"))
    assert dict(map(tuple, rows.collect())) == given


def test_fallbacks(spark):
    given = {None: "none", "": "none", "   ": "", " x ": "x"}
    rows = spark.createDataFrame([(t,) for t in given], "t string").select("t", text_or("t", "none"))
    assert dict(map(tuple, rows.collect())) == given
    lists = [(None, "none"), ([], "none"), (["a"], "a"), (["a", "b"], "a, b")]
    rows = spark.createDataFrame(lists, "t array<string>, e string")
    assert all(got == expected for got, expected in rows.select(join_or("t", "none"), "e").collect())


def test_uuid_forms(spark):
    one = str(uuid.UUID(int=0xABCDEF0123456789ABCDEF0123456789))
    good = [one, one.upper(), "{" + one + "}", f"urn:uuid:{one}", one.replace("-", "")]
    bad = ["bad", "", one[:-1], one + "0", one.replace("a", "g"), f" {one}", None]
    rows = spark.createDataFrame([(t,) for t in good + bad], "t string")
    got = [row[0] for row in rows.coalesce(1).select(canonical_uuid("t")).collect()]
    assert got == [one] * len(good) + [None] * len(bad)


def test_rendering_stays_in_the_jvm(spark):
    df = spark.createDataFrame([], STUDENT).select(student_document())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
