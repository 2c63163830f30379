"""Scratch tables and the scopes that delete them."""

import os

import pytest

from pairwright import scratch
from pairwright.scratch import in_scope, scope, stored


def test_a_scope_deletes_what_is_not_kept(spark):
    with scope() as outer:
        with scope() as inner:
            lost = stored(spark.range(5))
            handed_on = inner.keep(stored(lost))
            assert handed_on.count() == 5
        assert not os.path.exists(lost._scratch) and os.path.exists(handed_on._scratch)
        also = stored(handed_on)
        kept = outer.keep(stored(also))
    assert not os.path.exists(handed_on._scratch) and not os.path.exists(also._scratch)
    assert kept.count() == 5
    free = stored(spark.range(3))
    with pytest.raises(ZeroDivisionError), scope():
        half = stored(spark.range(2))
        raise ZeroDivisionError
    assert not os.path.exists(half._scratch)
    assert free.count() == 3


def test_shuffle_files_are_let_go_after_large_tables(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(scratch, "reclaim", asked.append)
    monkeypatch.setattr(scratch, "_written", {})
    table = stored(spark.range(1000))
    assert asked == [] and all("zstd" in name for name in os.listdir(table._scratch) if name.endswith(".parquet"))
    monkeypatch.setattr(scratch, "RECLAIM_BYTES", 1)
    stored(spark.range(1000))
    assert asked == [spark]


def test_folders_named_to_a_scope_go_with_it(spark, tmp_path):
    path = str(tmp_path / "json")
    spark.range(5).write.json(path)
    with scope():
        assert in_scope(path, spark.read.json(path)).count() == 5
    assert not os.path.exists(path)
