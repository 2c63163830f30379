"""Bulk payloads read item by item."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pairwright.schemas import SKILLS
from pairwright.sources import bulkitems
from pairwright.sources.bulkitems import Range, _Payload, explode_streamed
from pairwright.sources.payloads import explode_items, read_bulk


def ident(number):
    return f"00000000-0000-0000-0000-{number:012d}"


def skill(number, name="a"):
    return {"skill": {"id": ident(number), "name": name}}


def fed(text, sizes):
    """Items, fault and seq of a payload that comes in pieces of the given sizes."""
    data, payload, items, at = text.encode(), _Payload(), [], 0
    while at < len(data) or not items and at == 0:
        step = next(sizes)
        items += payload.feed(data[at : at + step], at + step >= len(data))
        at += step
    return items, payload


def endless(rng, most):
    while True:
        yield rng.randint(1, most)


TRICKY = ['{"a": "}],[{"}', '{"b": [1, {"c": "\\\\\\""}]}', "null", '"x,y"', "12", "{}", '{"é": "\\u00e9 ]"}']


@pytest.mark.parametrize("most", (1, 3, 17, 1000))
def test_items_end_where_json_says(most):
    rng = random.Random(most)
    for _ in range(200):
        items = [rng.choice(TRICKY) for _ in range(rng.randint(0, 6))]
        members = [f'"items": [{(", " if rng.random() < 0.5 else ",").join(items)}]']
        if rng.random() < 0.7:
            members.insert(rng.randint(0, 1), f'"seq":{rng.randint(0, 99)}')
        if rng.random() < 0.5:
            members.insert(rng.randint(0, len(members)), '"other": {"items": [1, 2], "x": "\\""}')
        text = "{" + ", ".join(members) + "}"
        got, payload = fed(text, endless(rng, most))
        assert payload.fault is None
        assert [x.decode() for x in got] == items
        assert payload.seq == json.loads(text).get("seq")
        assert payload.n_items == len(items) and payload.has_items


@pytest.mark.parametrize(
    "text",
    ['{"items": [1', '{"items": [1]', '[1]', '{"items": {"a": 1}}', '{"items": [1,]}', '{"items": [,1]}', '{"items": [1]} x',
     '{"seq": "a", "items": []}', '{"seq": true, "items": []}', '{"items": [1]}{"items": [2]}', '{"items": [1], "items": [2]}', '{"items: [1]}'],
)
@pytest.mark.parametrize("most", (1, 1000))
def test_malformed_payloads_are_told(text, most):
    _, payload = fed(text, endless(random.Random(1), most))
    assert payload.fault == "malformed"


def landed(tmp_path, *lines):
    path = tmp_path / "landing"
    path.mkdir()
    texts = [line if isinstance(line, str) else json.dumps(line) for line in lines]
    (path / "a.json").write_text("\n".join(texts[::2]) + "\n")
    (path / "b.json").write_text("\n\n".join(texts[1::2]))
    (path / "_SUCCESS").write_text("")
    return str(path)


def test_streamed_payloads_equal_whole_ones(spark, tmp_path):
    path = landed(
        tmp_path,
        {"seq": 1, "items": [skill(1), skill(2), skill(1, "later")]},
        {"items": [skill(3)], "seq": 2},
        {"seq": 3, "items": [skill(4), {"skill": {"id": "bad", "name": "x"}}]},
        {"seq": 4, "items": [skill(5), None]},
        {"items": [skill(6, "no seq")]},
        {"seq": 5},
        {"seq": 6, "items": []},
        '{"seq": 7, "items": [{"skill": ',
        {"seq": 8, "items": [{"skill": [ident(7)]}]},
        {"seq": 9, "items": None},
    )
    commands, rejected = explode_streamed(spark, SKILLS, path)
    whole, refused = explode_items(read_bulk(spark, SKILLS, path), SKILLS)
    columns = ("seq", "pos", "id", "name")
    got = sorted((tuple(r[c] for c in columns) for r in commands.collect()), key=repr)
    assert got == sorted((tuple(r[c] for c in columns) for r in whole.collect()), key=repr)
    assert len(got) == 5
    # A payload with an item of another shape is malformed to one reader and has invalid items to the other.
    assert rejected.count() == refused.count() == 6
    reasons = {r.seq: r.reasons for r in rejected.collect() if r.seq}
    assert reasons == {3: ["items: invalid"], 4: ["items: invalid"], 5: ["items: missing"], 7: ["payload: malformed"],
                       8: ["items: invalid"], 9: ["items: missing"]}
    place = commands.orderBy("_place_in_bulk").select("seq", "pos").collect()
    assert [tuple(r) for r in place] == [(1, 0), (1, 1), (1, 2), (2, 0), (None, 0)]


def test_lines_belong_to_the_range_they_begin_in(tmp_path, monkeypatch):
    monkeypatch.setattr(bulkitems, "PIECE_BYTES", 7)
    rng = random.Random(5)
    lines = ["x" * rng.randint(0, 30) for _ in range(60)]
    data = "\n".join(lines).encode()
    (tmp_path / "f").write_bytes(data)
    for width in (1, 5, 13, 64, 5000):
        got = []
        for start in range(0, len(data), width):
            with open(tmp_path / "f", "rb") as source:
                span = Range("f", start, min(start + width, len(data)))
                for offset, pieces in bulkitems._lines(source, span, len(data)):
                    got.append((offset, b"".join(piece for piece, _ in pieces).decode()))
        offsets, at = [], 0
        for line in lines:
            offsets.append((at, line))
            at += len(line) + 1
        assert got == [pair for pair in offsets if pair[0] < len(data)]


def test_a_payload_of_a_million_items_is_read_in_pieces(spark, tmp_path):
    """One payload with nearly all items, among others: no task holds it, no join gathers it."""
    n = 1_000_000
    with open(tmp_path / "big.json", "w") as out:
        out.write('{"items": [')
        for number in range(n):
            comma = "," if number else ""
            out.write(f'{comma}{{"skill": {{"id": "{ident(number)}", "name": "s{number % 1000}"}}}}')
        out.write('], "seq": 7}\n')
        out.write(json.dumps({"seq": 8, "items": [skill(n)]}) + "\n")
    commands, rejected = explode_streamed(spark, SKILLS, str(tmp_path / "big.json"))
    figures = commands.agg(
        F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.sum(F.col("pos").cast("long")).alias("places")
    ).first()
    assert tuple(figures) == (n + 1, n + 1, n * (n - 1) // 2)
    assert rejected.count() == 0
