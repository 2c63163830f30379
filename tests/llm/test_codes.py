"""Vector codes against a plain version with full distances."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from pairwright.llm import codes, groups, queries

SF_DIR = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>, label int, code int"


def plain(rows, parts=8, entries=16, rounds=6):
    """rows of (id, vector, label) that are kept -> {position: (code, error)}, codebooks."""
    width = -(-len(rows[0][1]) // parts)
    whole = []
    for _, vector, _ in rows:
        values = [math.floor(4096 * Fraction(x)) for x in vector]
        values += [0] * (parts * width - len(values))
        whole.append([values[p * width : (p + 1) * width] for p in range(parts)])
    first = {}
    for place, (name, vector, _) in enumerate(rows):
        name = (name is None, name or 0)
        if name not in first or vector < rows[first[name]][1]:
            first[name] = place
    seeds = [first[name] for name in sorted(first)[:entries]]
    books = [[whole[s][p] for s in seeds] for p in range(parts)]

    def assign():
        out = []
        for vector in whole:
            near = [
                min((sum((a - b) ** 2 for a, b in zip(vector[p], entry)), i) for i, entry in enumerate(books[p]))
                for p in range(parts)
            ]
            out.append(([i for _, i in near], sum(d for d, _ in near)))
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for i in range(len(books[p])):
                own = [v[p] for v, (code, _) in zip(whole, found) if code[p] == i]
                if own:
                    books[p][i] = [sum(column) // len(own) for column in zip(*own)]
    return assign(), books


def expected(rows, **settings):
    found, books = plain(rows, **settings)
    sums = {}
    for (_, _, label), (_, error) in zip(rows, found):
        sums[label] = sums.get(label, 0) + error
    big = 2**63 - 1
    wrong = {label for (_, _, label), (_, error) in zip(rows, found) if error > big}
    numbers = ",".join(str(x) for book in books for entry in book for x in entry)
    digest = hashlib.sha256(numbers.encode()).hexdigest()
    return sorted(
        (
            (name, label, "".join(f"{i:02x}" for i in code), error if error <= big else None,
             None if label in wrong or sums[label] > big else sums[label], digest)
            for (name, _, label), (code, error) in zip(rows, found)
        ),
        key=repr,
    )


def results(df):
    return sorted((tuple(row) for row in df.collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, 7) for i, v, label in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("length", [8, 16, 24, 64, 11])
def test_equals_the_plain_version(spark, length):
    rng = np.random.default_rng(length)
    rows = [(i, rng.normal(size=length).tolist(), i % 3) for i in range(90)]
    assert results(codes.compress(table(spark, rows))) == expected(rows)


def test_rough_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i // 2, rng.integers(-2, 3, 16).astype(float).tolist(), None if i % 3 else 4) for i in range(60)]
    rows += [(100, [1.0] * 16, 2)] * 40 + [(None, [0.5] * 16, None), (None, [0.25] * 16, 1)]
    bad = [(1000, None, 1), (1001, [float("nan")] * 16, 1), (1002, [None] + [1.0] * 15, 1),
           (1003, [float("inf")] * 16, 1), (1004, [1.0], 1), (-5, [], 1)]
    got = results(codes.compress(table(spark, rows + bad)))
    assert got == expected(rows)
    assert results(codes.compress(table(spark, bad[:4]))) == []
    assert results(codes.compress(table(spark, rows).limit(0))) == []


def test_fewer_ids_than_entries_and_ties(spark):
    rows = [(1, [1.0] * 8, 1), (2, [-1.0] * 8, 1), (3, [0.0] * 8, 1), (4, [0.0] * 8, None), (5, [1.0] * 8, 1)]
    assert results(codes.compress(table(spark, rows))) == expected(rows)
    assert results(codes.compress(table(spark, rows[2:3]))) == expected(rows[2:3])


@pytest.mark.parametrize("size", [2.0**20, 2.0**45, 1e20, 1e300])
def test_large_numbers(spark, size):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist(), i % 2) for i in range(40)]
    rows[20:23] = [(i, [size, -size, 3.0, size / 3, 0.0, 1.0, size, size], 2) for i in range(20, 23)]
    assert results(codes.compress(table(spark, rows))) == expected(rows)
    rows[0] = (0, [size] * 8, 3)
    assert results(codes.compress(table(spark, rows))) == expected(rows)


def test_transform_keeps_distances_and_orders_sign_changes():
    rng = np.random.default_rng(1)
    for size in (1, 2, 8, 32):
        order = codes.sequency_order(size)
        matrix = codes.walsh(np.eye(size, dtype=np.int64), order)
        changes = (np.diff(matrix.T, axis=1) != 0).sum(axis=1)
        assert changes.tolist() == list(range(size))
        a, b = rng.integers(-99, 99, (2, size))
        gap = codes.walsh(a, order) - codes.walsh(b, order)
        assert (gap**2).sum() == size * ((a - b) ** 2).sum()


def test_labels_by_shuffle(spark, monkeypatch):
    """Many labels, one of them with a third of the rows, are joined in two ways."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8).tolist(), 0 if i % 3 == 0 else None if i % 7 == 0 else i) for i in range(120)]
    monkeypatch.setattr(groups, "BROADCAST_ROWS", 10)
    assert results(codes.compress(table(spark, rows))) == expected(rows)


def test_registered_query(spark):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in queries.table(spark, SF_DIR, "embeddings").collect()]
    got = results(queries.op12_codes(spark, SF_DIR))
    assert got == expected(rows)
