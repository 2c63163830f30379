"""Tree search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.llm import queries, vptree

SF_DIR = "/root/testdata/sf0.01"


def brute(rows, asked, k):
    """query -> [(vec_id, score)] in order."""
    ids = np.array([i for i, _ in rows])
    base = np.array([v for _, v in rows], float)
    out = {}
    for i, v in rows:
        if i in asked:
            score = (base * np.array(v, float)).sum(axis=1)
            order = sorted((-s, j) for s, j in zip(score.tolist(), ids.tolist()) if j != i)
            out[i] = [(j, -s) for s, j in order[:k]]
    return out


def results(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r["rank"]
    return out


def test_factor_one_is_exact(spark, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD", 40)
    monkeypatch.setattr(vptree, "BLOCK_BYTES", 8 * 3 * 4)
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(150)]
    rows = [(i, v) for i, v in rows if any(v)]
    rows += [(1000 + i, [1.0, 1.0, 0.0]) for i in range(60)]
    bad = [(2000, None), (2020, [0.0] * 3), (2040, [1.0, float("nan"), 1.0]), (2060, [1.0, None, 1.0]),
           (2080, [float("inf"), 1.0, 1.0]), (2100, [1.0]), (2120, []), rows[0]]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("shard", F.lit(1))
    got = results(vptree.nearest(table, F.col("vec_id") % 20 == 0, k=7, factor=1.0))
    expected = brute(rows, {i for i, _ in rows if i % 20 == 0}, 7)
    assert got == expected


def test_fewer_candidates_than_asked_for(spark):
    table = spark.createDataFrame([(20, [1.0, 2.0]), (1, [3.0, 0.5]), (2, [-1.0, 1.0])], "vec_id long, embedding array<double>")
    assert results(vptree.nearest(table, F.col("vec_id") == 20)) == {20: [(1, 4.0), (2, 1.0)]}
    assert vptree.nearest(table.limit(0), F.col("vec_id") == 20).count() == 0
    assert vptree.nearest(table.filter("vec_id = 20"), F.col("vec_id") == 20).count() == 0
    with pytest.raises(ValueError):
        vptree.nearest(table, F.col("vec_id") == 20, factor=0.5)


def test_recall_of_the_registered_query(spark, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD", 250)
    rows = [(r.vec_id, r.embedding) for r in queries.table(spark, SF_DIR, "embeddings").collect()]
    expected = brute(rows, {i for i, _ in rows if i % 20 == 0}, 20)
    got = results(queries.op5_nearest(spark, SF_DIR))
    assert set(got) == set(expected)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in expected)
    assert hits >= 0.9 * 20 * len(expected)
    for q, found in got.items():
        known = dict(brute(rows, {q}, len(rows))[q])
        assert all(known[i] == pytest.approx(s, abs=1e-12) for i, s in found)


@pytest.mark.parametrize("dimensions,clusters", [(4, 0), (8, 0), (16, 0), (64, 5)])
def test_recall_on_other_vectors(spark, monkeypatch, dimensions, clusters):
    """Vectors in a subspace of 64 dimensions, or around few points, at one and several shards."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=(4000, dimensions))
    if clusters:
        base = 0.3 * base / np.sqrt(dimensions) + rng.normal(size=(clusters, dimensions))[rng.integers(clusters, size=4000)]
    base = base @ np.linalg.qr(rng.normal(size=(64, 64)))[0][:dimensions]
    base /= np.linalg.norm(base, axis=1)[:, None]
    rows = list(enumerate(base.tolist()))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    expected = brute(rows, set(range(0, 4000, 20)), 20)
    for shard in (4000, 1300):
        monkeypatch.setattr(vptree, "SHARD", shard)
        got = results(vptree.nearest(table, F.col("vec_id") % 20 == 0))
        hits = sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in expected)
        assert hits >= 0.9 * 20 * len(expected)


@pytest.mark.parametrize("large", [1e-3, 1e6, 1e8, 1e9, 1e150])
def test_vectors_of_any_norm_are_found(spark, large):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(1200, 32))
    base /= np.linalg.norm(base, axis=1)[:, None]
    base[7] *= large
    base[40] *= large
    base[::9] *= rng.uniform(1e-3, 1e3, len(base[::9]))[:, None]
    rows = list(enumerate(base.tolist()))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = results(vptree.nearest(table, F.col("vec_id") % 20 == 0, k=10))
    assert got == brute(rows, set(range(0, 1200, 20)), 10)


def test_ties_go_to_smaller_ids(spark, monkeypatch):
    """Distinct vectors of small whole numbers: many have the same product with a query."""
    monkeypatch.setattr(vptree, "SHARD", 700)
    rng = np.random.default_rng(6)
    base = np.unique(rng.integers(-1, 2, (4000, 8)), axis=0)
    base = base[np.abs(base).any(axis=1)].astype(float)
    ids = rng.permutation(len(base)).tolist()
    rows = list(zip(ids, base.tolist()))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = results(vptree.nearest(table, F.col("vec_id") % 20 == 0))
    assert got == brute(rows, {i for i in ids if i % 20 == 0}, 20)
