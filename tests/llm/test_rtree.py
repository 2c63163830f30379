"""Hard negatives against a plain comparison of all rows."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.llm import queries, rtree

SF_DIR = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>, label int, id int, anchor int"
LONGEST = 2**63 - 1


def plain(rows, anchors, positives=5, negatives=3):
    """rows of (id, vector, label) that take part; ``anchors`` tells the anchors' ids."""
    whole = [(i, [math.floor(256 * Fraction(x)) for x in v], label) for i, v, label in rows]
    out = []

    def held(x):
        return x if abs(x) <= LONGEST else None

    for own, q, label in {(i, tuple(v), label) for i, v, label in whole if anchors(i)}:
        scored = [(sum(a * b for a, b in zip(q, v)), i, other == label) for i, v, other in whole if i != own]
        near = sorted({(-s, i) for s, i, same in scored if same})[:positives]
        for p, positive in near:
            far = {(-s, i) for s, i, same in scored if not same and 50 * -p <= 100 * s <= 95 * -p}
            for rank, (s, i) in enumerate(sorted(far)[:negatives], 1):
                out.append((own, positive, rank, i, held(-p), held(-s)))
    return sorted(out, key=repr)


def results(df):
    return sorted((tuple(row) for row in df.collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*row, 3, 4) for row in rows], SCHEMA).repartition(3)


def mined(spark, rows, modulus=5, **settings):
    return results(rtree.hard_negatives(table(spark, rows), F.col("vec_id") % modulus == 0, **settings))


@pytest.mark.parametrize("leaf,fanout,tile,taken", [(4, 3, 7, 1), (16, 2, 64, 4), (128, 16, 256, 8)])
@pytest.mark.parametrize("kind", ["float", "int64", "object"])
def test_tree_finds_the_best_of_every_window(monkeypatch, leaf, fanout, tile, taken, kind):
    for name, value in (("LEAF", leaf), ("FANOUT", fanout), ("TILE", tile), ("TAKEN", taken)):
        monkeypatch.setattr(rtree, name, value)
    rng = np.random.default_rng(leaf)
    scale = {"float": 1, "int64": 1 << 26, "object": 1 << 40}[kind]
    rows = rng.integers(-4, 5, (300, 3)) * scale
    numbers = rtree.Numbers(3, 4 * scale)
    rows = rows.astype(object).astype(numbers.kind)
    ids, labels = rng.permutation(300), rng.integers(0, 3, 300)
    number = np.arange(40)
    low = rng.integers(-10, 20, (40, 2)) * scale * scale
    high = low + rng.integers(0, 30, (40, 2)) * scale * scale
    for same in (True, False):
        asked = rtree.Asked(number, ids[:40], labels[:40], rows[:40], low.astype(object).astype(numbers.kind), high.astype(object).astype(numbers.kind), same)
        found = rtree.Found(40, 2, 4, numbers.kind)
        for some in (slice(0, 170), slice(170, 300)):
            rtree.search(rtree.Tree(ids[some], labels[some], rows[some]), asked, found)
        got = {}
        for cell, i, s in zip(found.cell, found.id, found.score):
            got.setdefault(int(cell), []).append((int(-s), int(i)))
        for a in range(40):
            for w in range(2):
                scores = [(-sum(int(x) * int(y) for x, y in zip(rows[a], rows[r])), int(ids[r])) for r in range(300)
                          if ids[r] != ids[a] and (labels[r] == labels[a]) == same]
                fit = sorted(x for x in scores if low[a, w] <= -x[0] <= high[a, w])
                assert got.get(2 * a + w, []) == fit[:4]


def test_packing_fills_leaves_and_keeps_rows():
    rows = np.random.default_rng(0).normal(size=(1000, 5))
    order = rtree.packed_order(rows, 10)
    assert sorted(order) == list(range(1000))
    boxes = rows[order].reshape(100, 10, 5)
    volume = (boxes.max(axis=1) - boxes.min(axis=1)).prod(axis=1).mean()
    loose = rows.reshape(100, 10, 5)
    assert volume < 0.2 * (loose.max(axis=1) - loose.min(axis=1)).prod(axis=1).mean()
    assert len(rtree.packed_order(np.zeros((300, 0)), 10)) == 300
    # Equal rows cannot be parted by any coordinate.
    assert sorted(rtree.packed_order(np.ones((95, 2)), 10)) == list(range(95))


def test_ties_copies_and_rough_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(0, 3, 4).astype(float).tolist(), int(rng.integers(0, 3))) for i in range(160)]
    rows += [(i % 7, [1.0, 1.0, 0.0, 2.0], 1) for i in range(60)] + rows[:30] + [(500, [0.0] * 4, 1)]
    bad = [(None, [1.0] * 4, 1), (600, None, 1), (605, [1.0] * 4, None), (610, [float("nan")] + [1.0] * 3, 1),
           (615, [None] + [1.0] * 3, 1), (620, [float("inf")] + [1.0] * 3, 1), (625, [1.0], 1), (630, [], 1)]
    assert mined(spark, rows + bad) == plain(rows, lambda i: i % 5 == 0)
    assert mined(spark, bad[:7] + rows[-1:]) == []
    assert rtree.hard_negatives(table(spark, rows).limit(0), F.col("vec_id") % 5 == 0).count() == 0
    one_label = [(i, v, 1) for i, v, _ in rows]
    assert mined(spark, one_label) == []


@pytest.mark.parametrize("size", [2.0**18, 2.0**30, 1e20, 1e300])
def test_large_numbers(spark, size):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=6).tolist(), i % 2) for i in range(90)]
    rows += [(90 + i, (rng.normal(size=6) * size).tolist(), i % 2) for i in range(30)]
    assert mined(spark, rows, 3) == plain(rows, lambda i: i % 3 == 0)


def test_anchors_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(rtree, "BLOCK_BYTES", 8 * 6 * 8)
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=6).tolist(), i % 3) for i in range(120)]
    assert mined(spark, rows, 4) == plain(rows, lambda i: i % 4 == 0)


def test_registered_query(spark):
    rows = [
        (r.vec_id, list(r.embedding), (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label)
        for r in queries.table(spark, SF_DIR, "embeddings").collect()
    ]
    got = results(queries.op11_negatives(spark, SF_DIR))
    assert got and got == plain(rows, lambda i: i % 50 == 0)
