"""JSON sources, aliases, defaults and rejection."""

import json

from pyspark.sql import functions as F

from pairwright.operators.validate import REASONS, id_problems, split
from pairwright.schemas import (
    ADVISOR_REQUESTS,
    PROFESSORS,
    PROJECT_REQUESTS,
    PROJECTS,
    SKILLS,
    STUDENTS,
)
from pairwright.sources.payloads import (
    accept,
    accept_requests,
    explode_items,
    read_bulk,
    read_commands,
    read_requests,
)

ONE = "00000000-0000-0000-0000-000000000001"
TWO = "00000000-0000-0000-0000-000000000002"


def landed(tmp_path, *lines):
    path = tmp_path / "in.json"
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    return str(path)


def project(**fields):
    return {
        "id": ONE,
        "title": "T",
        "description": "D",
        "provider_id": TWO,
        "created_at": "2026-01-02T03:04:05Z",
        **fields,
    }


def test_record_may_have_either_name_and_the_first_wins(spark, tmp_path):
    path = landed(
        tmp_path,
        {"template": project(title="old")},
        {"project_template": project(title="new")},
        {"template": project(title="no"), "project_template": project(title="yes")},
    )
    valid, rejected = accept(read_commands(spark, PROJECTS, path), PROJECTS)
    assert sorted(r.title for r in valid.collect()) == ["new", "old", "yes"]
    assert rejected.count() == 0


def test_defaults(spark, tmp_path):
    path = landed(tmp_path, {"student": {"id": ONE.upper(), "full_name": "A"}})
    row = accept(read_commands(spark, STUDENTS, path), STUDENTS)[0].first()
    assert (row.id, row.major_name, row.major_id) == (ONE, "Undeclared", None)
    assert row.skill_ids == row.specialty_ids == row.skill_names == row.specialty_names == []


def test_rejected_commands_keep_their_reasons(spark, tmp_path):
    path = landed(
        tmp_path,
        {"project_template": project()},
        {"project_template": project(id="bad", created_at="yesterday")},
        {"project_template": project(title=None, skill_ids=[TWO, "bad"])},
        {"major_name": "no record at all"},
        {"project_template": project(), "skill_names": ["a", None]},
        "{ this is not json",
    )
    valid, rejected = accept(read_commands(spark, PROJECTS, path), PROJECTS)
    assert valid.count() == 1
    assert str(valid.select(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")).first()[0]) == "2026-01-02 03:04:05"
    reasons = sorted(sorted(r[REASONS]) for r in rejected.collect())
    assert reasons == sorted(
        [
            ["created_at: not a timestamp", "id: not a uuid"],
            ["skill_ids: not a uuid", "title: missing"],
            ["created_at: missing", "description: missing", "id: missing", "provider_id: missing", "title: missing"],
            ["payload: malformed"],
            ["skill_names: null item"],
        ]
    )


def professor(ident):
    return {
        "professor": {
            "id": ident,
            "full_name": "P",
            "department": "D",
            "rank": "R",
            "is_accepting_projects": False,
        },
        "interest_areas": ["x"],
    }


def test_bulk_payload_keeps_order_and_is_rejected_whole(spark, tmp_path):
    path = landed(
        tmp_path,
        {"seq": 3, "items": [professor(ONE), professor(TWO), professor(ONE)]},
        {"seq": 4, "items": [professor(ONE), professor("bad")]},
        {"seq": 5, "items": [professor(ONE), None]},
        {"seq": 8, "items": [{**professor(ONE), "interest_areas": ["x", None]}]},
        {"seq": 6, "items": []},
        {"seq": 7},
    )
    commands, rejected = explode_items(read_bulk(spark, PROFESSORS, path), PROFESSORS)
    rows = sorted((r.seq, r.pos, r.id) for r in commands.collect())
    assert [row[1:] for row in rows] == [(0, ONE), (1, TWO), (2, ONE)]
    assert {row[0] for row in rows} == {3}
    place = commands.orderBy("_place_in_bulk")
    assert [r.pos for r in place.collect()] == [0, 1, 2]
    assert sorted(r.seq for r in rejected.collect()) == [4, 5, 7, 8]


def test_deletes_in_a_feed_need_only_an_id(spark, tmp_path):
    path = landed(
        tmp_path,
        {"seq": 1, "op": "U", "skill": {"id": ONE, "name": "a"}},
        {"seq": 2, "op": "D", "id": ONE},
        {"seq": 3, "op": "D", "id": "bad"},
        {"seq": 4, "op": "U", "id": TWO},
    )
    valid, rejected = accept(read_commands(spark, SKILLS, path), SKILLS)
    assert sorted((r.seq, r.op, r.id, r.name) for r in valid.collect()) == [
        (1, "U", ONE, "a"),
        (2, "D", ONE, None),
    ]
    assert sorted(r.seq for r in rejected.collect()) == [3, 4]


def test_request_limits(spark, tmp_path):
    base = {"title": "T", "description": "D"}
    path = landed(
        tmp_path,
        *[{"request_id": f"r{n}", "limit": n, **base} for n in (0, 1, 100, 101)],
        {"request_id": "none", **base},
        {"request_id": "untitled", "description": "D"},
        {"request_id": "nulls", "skill_names": [None], **base},
        base,
    )
    valid, rejected = accept_requests(read_requests(spark, ADVISOR_REQUESTS, path), ADVISOR_REQUESTS)
    assert {r.request_id: r.limit for r in valid.collect()} == {"r1": 1, "r100": 100, "none": 10}
    assert {r.request_id: r[REASONS] for r in rejected.collect()} == {
        "r0": ["limit: out of range"],
        "r101": ["limit: out of range"],
        "untitled": ["title: missing"],
        "nulls": ["skill_names: null item"],
        None: ["request_id: missing"],
    }


def test_requests_lacking_columns(spark):
    given = spark.createDataFrame([("r", "Botany", "nope")], "request_id string, major_name string, restrict_to_major_id string")
    valid, rejected = accept_requests(given, PROJECT_REQUESTS)
    assert valid.count() == 0
    assert rejected.first()[REASONS] == ["restrict_to_major_id: not a uuid"]


def test_delete_commands(spark):
    ids = spark.createDataFrame([(ONE,), ("bad",), (None,)], "id string")
    valid, rejected = split(ids, id_problems(F.col))
    assert [r.id for r in valid.collect()] == [ONE]
    assert rejected.count() == 2
