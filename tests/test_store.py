"""Versioned tables and keyed changes."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from pairwright.errors import StoreError
from pairwright.operators import changes
from pairwright.operators.changes import delete, fold, live, merge, newest
from pairwright.schemas import PROJECTS, SKILLS, VECTOR
from pairwright.sources.store import VersionedTable

ROW = "id string, name string, seq long, op string"


def rows(spark, *given):
    """Rows of the skills table: (id, name[, seq[, op]])."""
    width = len(given[0]) if given else 2
    schema = ", ".join(ROW.split(", ")[:width])
    return spark.createDataFrame(list(given), schema).withColumn("vector", F.expr("array(1.0f)"))


def names(table):
    return {r.id: r.name for r in table.read().collect()}


def table(spark, root):
    return VersionedTable(spark, root, SKILLS)


def test_no_version_is_an_empty_table(spark, root):
    empty = VersionedTable(spark, root, PROJECTS)
    assert empty.read().columns == PROJECTS.columns
    assert empty.read().count() == 0 and empty.row_bound() == 0


def test_merge_updates_and_inserts_and_twice_is_once(spark, root):
    t = table(spark, root)
    t.replace(rows(spark, ("a", "1"), ("b", "1")))
    changes = rows(spark, ("b", "2", 5), ("c", "2", 6), ("b", "3", 7))
    t.merge(changes)
    once = names(t)
    t.merge(changes)
    assert once == names(t) == {"a": "1", "b": "3", "c": "2"}


def test_delete_is_idempotent(spark, root):
    t = table(spark, root)
    t.replace(rows(spark, ("a", "1"), ("b", "1")))
    ids = spark.createDataFrame([("a",), ("a",), ("unknown",)], "id string")
    t.delete(ids)
    assert names(t) == {"b": "1"}
    t.delete(ids)
    assert names(t) == {"b": "1"}
    t.merge(rows(spark, ("a", "again")))
    assert names(t) == {"a": "again", "b": "1"}


def test_replace_leaves_nothing_of_the_old_rows(spark, root):
    t = table(spark, root)
    t.replace(rows(spark, ("a", "1", 1), ("b", "1", 2)))
    t.merge(rows(spark, ("c", "1", 9)))
    t.replace(rows(spark, ("d", "first", 0), ("d", "last", 1), ("e", "1", 0)))
    assert names(t) == {"d": "last", "e": "1"}
    # A change from before the replacement comes too late, one after it counts.
    t.merge(rows(spark, ("a", "late", 9), ("e", "late", 3)))
    assert names(t) == {"d": "last", "e": "1"}
    t.merge(rows(spark, ("e", "2", 10)))
    assert names(t) == {"d": "last", "e": "2"}


def test_empty_inputs_make_no_version(spark, root):
    t = table(spark, root)
    t.replace(rows(spark, ("a", "1")))
    before = t.state()
    t.replace(rows(spark, ("a", "1")).where("false"))
    t.merge(rows(spark, ("a", "1")).where("false"))
    t.delete(spark.createDataFrame([], "id string"))
    assert t.state() == before


def test_late_update_does_not_bring_a_deleted_row_back(spark, root):
    t = table(spark, root)
    t.merge(rows(spark, ("a", "1", 1, "U"), ("b", "1", 2, "U")))
    t.merge(rows(spark, ("a", None, 5, "D")))
    t.merge(rows(spark, ("a", "late", 4, "U"), ("b", "late", 1, "U")))
    assert names(t) == {"b": "1"}
    t.compact()
    t.merge(rows(spark, ("a", "late", 4, "U")))
    assert names(t) == {"b": "1"}
    t.compact(forget_before=6)
    assert t.state()["base_rows"] == 1


def test_random_changes_in_any_order_and_any_batches(spark, root):
    rng = random.Random(5)
    feed = [
        (f"k{rng.choice([0, 0, 0, rng.randint(1, 20)])}", f"v{seq}", seq, rng.choice("UUUD"))
        for seq in range(200)
    ]
    last = {}
    for ident, name, seq, op in feed:
        last[ident] = (name, op)
    expected = {ident: name for ident, (name, op) in last.items() if op == "U"}
    for number in range(3):
        shuffled = feed if number == 0 else rng.sample(feed, len(feed))
        t = table(spark, f"{root}/{number}")
        for start in range(0, 200, 50):
            t.merge(rows(spark, *shuffled[start : start + 50 + 10 * number]))
            if start == 100:
                t.compact()
        assert names(t) == expected


def test_batches_of_a_stream_count_once(spark, root):
    t = table(spark, root)
    t.merge(rows(spark, ("a", "1")), batch=("s", 0))
    t.merge(rows(spark, ("a", "replayed")), batch=("s", 0))
    assert names(t) == {"a": "1"}
    t.merge(rows(spark, ("a", "2")), batch=("s", 1))
    assert names(t) == {"a": "2"}


def test_two_writers_from_one_version(spark, root, monkeypatch):
    one, two = table(spark, root), table(spark, root)
    one.replace(rows(spark, ("a", "1"), ("b", "1")))
    stale = two.state()
    states = iter([stale])
    fresh = two.state
    monkeypatch.setattr(two, "state", lambda: next(states, None) or fresh())
    one.merge(rows(spark, ("a", "2")))
    two.merge(rows(spark, ("b", "2")))
    assert names(table(spark, root)) == {"a": "2", "b": "2"}
    assert stale["version"] + 2 == fresh()["version"]


def test_changes_without_seq_count_as_they_arrive(spark, root):
    t = table(spark, root)
    t.replace(rows(spark, ("a", "0"), ("b", "0")))
    for n in range(1, 4):
        t.merge(rows(spark, ("a", f"first {n}"), ("a", str(n))))
        assert names(t) == {"a": str(n), "b": "0"}
    t.merge(rows(spark, ("new", "1")))
    assert names(t) == {"a": "3", "b": "0", "new": "1"}


def test_compaction_never_changes_what_is_read(spark, root):
    steps = [("stream5", 5), ("manual", None), ("stream6", 6), ("late5", 5), ("manual2", None)]
    seen = []
    for compact_at in range(-1, len(steps)):
        t = table(spark, f"{root}/{compact_at}")
        t.replace(rows(spark, ("a", "0")))
        read = []
        for n, (name, seq) in enumerate(steps):
            given = spark.createDataFrame([("a", name, seq)], "id string, name string, seq long")
            t.merge(given.withColumn("vector", F.expr("array(1.0f)")))
            if n == compact_at:
                t.compact()
            read.append(names(t)["a"])
        seen.append(read)
    assert all(read == seen[0] for read in seen)
    assert seen[0] == ["stream5", "manual", "stream6", "stream6", "manual2"]


def test_rows_that_cannot_be_stored_are_set_aside(spark, root):
    t = VersionedTable(spark, root, SKILLS, dimension=2)
    good = rows(spark, ("a", "1", 105)).withColumn("vector", F.expr("array(1.0f, 2.0f)"))
    t.merge(good)
    t.replace(good.withColumn("name", F.lit("whole")))
    vectors = ["array(1.0f)", "cast(null as array<float>)", "array(1.0f, null)", "array(1.0f, float('nan'))", "array(1.0f, float('inf'))"]
    for n, vector in enumerate(vectors):
        t.merge(rows(spark, (f"bad{n}", "x")).withColumn("vector", F.expr(vector)))
    t.merge(rows(spark, ("c", "late", 103)).withColumn("vector", F.expr("array(1.0f, 2.0f)")))
    assert names(t) == {"a": "whole"}
    rejected = sorted((r.id, r.reason) for r in t.rejected().collect())
    assert rejected == [(f"bad{n}", "vector: unusable") for n in range(5)] + [
        ("c", "seq: before the last replacement")
    ]
    with pytest.raises(StoreError, match="no row"):
        t.replace(rows(spark, ("z", "1")))


def test_small_merges_leave_the_base_untouched(spark, root, monkeypatch):
    from pairwright.sources import store

    monkeypatch.setattr(store, "MAX_CHANGE_SETS", 4)
    t = table(spark, root)
    t.replace(rows(spark, ("a", "0")))
    base = t.state()["base"]
    for n in range(12):
        t.merge(rows(spark, (f"k{n}", str(n))))
        t.maintain()
        assert len(t.state()["changes"]) <= 5
    assert t.state()["base"] == base and len(names(t)) == 13


def test_failing_maintenance_is_not_a_failed_merge(spark, root, monkeypatch):
    t = VersionedTable(spark, root, SKILLS, compact_above=0)
    t.replace(rows(spark, ("a", "0")))

    def fail(*_):
        raise StoreError("full disk")

    monkeypatch.setattr(t, "compact", fail)
    t.merge(rows(spark, ("a", "1")))
    t.maintain()
    assert names(t) == {"a": "1"}


def test_failed_write_leaves_the_version(spark, root):
    t = table(spark, root)
    t.replace(rows(spark, ("a", "1")))
    before = t.state()
    broken = rows(spark, ("a", "2")).withColumn("name", F.raise_error(F.lit("no")))
    for write in (t.replace, t.merge):
        with pytest.raises(StoreError):
            write(broken)
    assert t.state() == before and names(t) == {"a": "1"}


def test_many_change_sets_are_compacted_and_old_data_vacuumed(spark, root, monkeypatch):
    from pairwright.sources import store

    monkeypatch.setattr(store, "MAX_CHANGE_SETS", 3)
    t = table(spark, root)
    for n in range(5):
        t.merge(rows(spark, (f"k{n}", str(n))))
    t.maintain()
    t.compact()
    assert not t.state()["changes"] and t.state()["base"]
    before = names(t)
    assert len(before) == 5
    assert t.vacuum(keep=1)
    assert names(t) == before
    assert t.vacuum(keep=1) == []


def test_commits_do_not_grow_with_their_number(spark, root, monkeypatch):
    """A thousand merges with rejects each: commits stay small, old ones are forgotten."""
    from pairwright.sources import store

    t = table(spark, root)
    t.replace(rows(spark, ("a", "1")))
    # The same write stands for all: what is tested is what commits say.
    folder, written = t._write(
        t._sequenced(rows(spark, ("b", "1", 1), ("c", "1", 2, "U")[:3]), t.state())
        .withColumn("vector", F.when(F.col("id") == "b", F.col("vector"))), "changes",
    )
    assert {fate: row["rows"] for fate, row in written.items()} == {"stored": 1, "vector": 1}
    monkeypatch.setattr(t, "_write", lambda *given: (folder, written))
    monkeypatch.setattr(t, "_merge_change_sets", lambda state: t._commit(state, changes=state["changes"][-1:]) or state)
    monkeypatch.setattr(t, "compact", lambda: t.state())
    sizes, n_commits = [], []
    changes_of = rows(spark, ("b", "1", 1))
    monkeypatch.setattr(t, "_sequenced", lambda rows, state: rows)
    monkeypatch.setattr(store, "newest", lambda rows, order=None: rows)
    monkeypatch.setattr(store, "KEPT_VERSIONS", 50)
    for n in range(1000):
        t.merge(changes_of, (f"stream{n % 3}", n))
        state = t.maintain()
        if n % 50 == 49:
            names_of = t._commits()
            n_commits.append(len(names_of))
            sizes.append(len(t._files.read_text(f"{t.path}/commits/{names_of[-1]}")))
    assert max(sizes[1:]) <= min(sizes[1:]) + 1500
    assert max(n_commits) <= 2 * 50 + 60
    assert state["version"] > 1000 and len(state["batches"]) == 3


def test_fold_scans_a_large_base_without_a_shuffle(spark, root):
    t = table(spark, root)
    t.replace(rows(spark, *[(f"k{n}", "x") for n in range(50)]))
    t.merge(rows(spark, ("k1", "y")))
    df = t.read().where("name = 'x'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    base = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "EqualTo(name,x)" in base
    above = plan[: plan.index(base)]
    assert "BroadcastHashJoin" in above and "Exchange hashpartitioning" not in above
    assert names(t) == {**{f"k{n}": "x" for n in range(50)}, "k1": "y"}


def test_unchanged_rows_of_a_large_merge_are_not_shuffled(spark, tmp_path, monkeypatch):
    """More changes than may be broadcast: a filter of their ids keeps other rows out of the join."""
    path = str(tmp_path / "base")
    base = spark.range(20_000).select(
        F.concat(F.lit("id-"), "id").alias("id"), F.col("id").alias("seq"), F.lit("U").alias("op"), F.lit("old").alias("v")
    )
    base.write.parquet(path)
    changed = spark.range(500).select((F.col("id") * 41).alias("n"))
    rows = changed.select(
        F.concat(F.lit("id-"), "n").alias("id"),
        # A third are late, a third level with the stored row, a third new; some ids are unknown.
        (F.col("n") + F.col("n") % 3 - 1).alias("seq"),
        F.when(F.col("n") % 5 == 0, "D").otherwise("U").alias("op"),
        F.lit("new").alias("v"),
    )
    rows = rows.union(rows.limit(50)).cache()
    base = spark.read.parquet(path)
    expected = sorted(map(tuple, changes.fold(base, rows, rows.count()).collect()))
    assert sum(row[3] == "new" for row in expected) > 200
    monkeypatch.setattr(changes, "BROADCAST_IDS", 100)
    n = rows.count()
    untouched, touched = changes.split_by_filter(base, rows, n)
    known = rows.join(base, "id", "left_semi").select("id").distinct().count()
    assert known <= touched.count() <= known + 0.01 * 20_000
    assert untouched.count() + touched.count() == 20_000
    for part in (untouched, touched):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    folded = changes.fold(base, rows, n)
    assert sorted(map(tuple, folded.collect())) == expected
    for count in (None, 10**9):  # without a filter
        assert sorted(map(tuple, changes.fold(base, rows, count).collect())) == expected
    # Few bits for each id let more rows through, and lose none.
    monkeypatch.setattr(changes, "FILTER_WORDS", 40)
    monkeypatch.setattr(changes, "LEAST_BITS", 1)
    assert changes.split_by_filter(base, rows, n)[1].count() > 2 * known
    assert sorted(map(tuple, changes.fold(base, rows, n).collect())) == expected


def test_newest_cuts_a_hot_key_before_the_shuffle(spark):
    hot = spark.range(3000).selectExpr(
        "if(id % 3 = 0, 'hot', concat('k', id)) as id", "id as seq", "'U' as op"
    )
    df = newest(hot)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert df.where("id = 'hot'").first().seq == 2997
    assert df.count() == 2001


def test_operators_without_a_store(spark):
    base = spark.createDataFrame([("a", "1", 0, "U"), ("b", "1", 9, "U")], ROW)
    changes = spark.createDataFrame([("a", None, 3, "D"), ("b", "2", 3, "U"), ("c", "2", 4, "U")], ROW)
    for n in (None, 3):
        folded = fold(base, changes, n)
        assert folded.count() == 3 and live(folded).count() == 2
        got = {r.id: r.name for r in merge(base, changes, n).collect()}
        assert got == {"b": "1", "c": "2"}
    ids = spark.createDataFrame([("a",), ("z",)], "id string")
    assert [r.id for r in delete(base, ids).collect()] == ["b"]
    assert [r.id for r in delete(base, ids, 2).collect()] == ["b"]


def shuffled(df):
    """Columns of the rows that the plan shuffles."""
    queries = df._jdf.queryExecution()
    plan = df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(queries, "formatted")
    return re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", plan)


@pytest.mark.parametrize("with_base", [True, False])
def test_many_changes_are_folded_without_moving_rows(spark, root, monkeypatch, with_base):
    from pairwright.sources import store

    t = table(spark, root)
    if with_base:
        t.replace(rows(spark, *[(f"k{n}", "base") for n in range(200)]))
    t.merge(rows(spark, *[(f"k{n}", "first", n, "D" if n % 5 == 0 else "U") for n in range(100)]))
    t.merge(rows(spark, *[(f"k{n}", "second", 300 - n) for n in range(50, 250)]))
    t.merge(rows(spark, *[(f"k{n}", "third") for n in range(0, 250, 9)]))
    before = sorted(map(tuple, t._rows(t.state()).collect()))
    ids = [row[0] for row in before]
    assert len(ids) == len(set(ids)) == 250
    monkeypatch.setattr(store, "BROADCAST_IDS", 10)
    folded = t._rows(t.state())
    assert sorted(map(tuple, folded.collect())) == before
    exchanges = shuffled(folded)
    assert exchanges and not any("vector#" in columns for columns in exchanges)
    live_before = names(t)
    t.compact()
    assert names(t) == live_before


def test_compaction_lets_go_of_what_older_versions_read(spark, root):
    t = table(spark, root)
    bad = rows(spark, ("x", "bad")).withColumn("vector", F.lit(None).cast(VECTOR))
    t.replace(rows(spark, ("a", "1"), ("b", "1")).union(bad))
    first = t.state()["base"]
    held = lambda folder, fate: os.path.exists(f"{t.path}/data/{folder}/_fate={fate}")
    t.merge(rows(spark, ("a", "2")))
    reader = t.read()
    t.compact()
    second = t.state()["base"]
    assert held(first, "stored") and {r.id: r.name for r in reader.collect()} == {"a": "2", "b": "1"}
    t.merge(rows(spark, ("b", "3")))
    t.compact()
    assert not held(first, "stored") and held(first, "vector") and held(second, "stored")
    assert names(t) == {"a": "2", "b": "3"}
    assert [r.id for r in t.rejected().collect()] == ["x"]
    assert t.runs().count() == 3


def test_rows_of_ids_that_come_once_stay_where_they_are(spark, tmp_path):
    def read(name, given):
        spark.createDataFrame(given, "id string, name string, seq long").write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    single = read("single", [(f"k{n}", "x", n) for n in range(50)])
    assert not shuffled(changes.newest_of_scan(single, F.col("seq")))
    given = [(f"k{n % 40}" if n % 3 else "hot", f"n{n}", n) for n in range(60)] + [(None, "p", 1), (None, "q", 2)]
    repeated = read("repeated", given)
    expected = sorted(map(str, newest(repeated, order="seq").collect()))
    assert sorted(map(str, changes.newest_of_scan(repeated, F.col("seq")).collect())) == expected
    assert changes.read_again(repeated) and not changes.read_again(repeated.distinct())
    # A limit above a Python stage ends it before its figures are in.
    assert not changes.read_again(repeated.limit(5))


def test_many_repeated_ids_are_shuffled_whole(spark, tmp_path, monkeypatch):
    given = [(f"k{n % 30}", n) for n in range(90)]
    spark.createDataFrame(given, "id string, seq long").write.parquet(str(tmp_path / "rows"))
    read = spark.read.parquet(str(tmp_path / "rows"))
    monkeypatch.setattr(changes, "BROADCAST_IDS", 5)
    got = changes.newest_of_scan(read, F.col("seq"))
    assert sorted(map(tuple, got.collect())) == sorted((f"k{n}", 60 + n) for n in range(30))
