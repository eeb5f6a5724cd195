"""Stores: what a dying write leaves, which files an upsert touches, and what is removed."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.operators.store import Table

SCHEMA = "id string, n int, kind string"


def rows(spark, *values):
    return spark.createDataFrame([(f"k{i}", n, "a" if i % 2 else "b") for i, n in values], SCHEMA)


def held(table):
    return {r.id: r.n for r in table.read().collect()}


def test_a_write_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    table = Table(spark, str(tmp_path / "t"), SCHEMA, ("id",), "kind")
    assert held(table) == {}
    table.upsert(rows(spark, *((i, i) for i in range(50))))
    before = held(table)
    with monkeypatch.context() as m:
        m.setattr(Table, "_commit", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError, match="killed"):
            table.upsert(rows(spark, (1, 100), (99, 99)))
    assert held(table) == before
    table.upsert(rows(spark, (1, 100), (99, 99)))
    assert held(table) == before | {"k1": 100, "k99": 99}


def test_an_upsert_leaves_other_buckets_alone(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"), SCHEMA, ("id",))
    table.upsert(rows(spark, *((i, i) for i in range(200))))
    _, before = table._current()
    assert len(before) == 16
    table.upsert(rows(spark, (7, -7)))
    _, after = table._current()
    assert sum(before[b] != after[b] for b in before) == 1
    assert held(table) == {f"k{i}": i for i in range(200)} | {"k7": -7}
    assert table.delete(F.col("id") == "k8") == 1 and table.delete(F.col("id") == "k8") == 0
    assert "k8" not in held(table) and len(held(table)) == 199


def test_old_versions_are_removed_and_late_writes_fail(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"), SCHEMA, ("id",))
    for n in range(5):
        table.write(rows(spark, (1, n), (2, n)))
    assert len(list(Path(tmp_path / "t").glob("v-*"))) == 2 and held(table) == {"k1": 4, "k2": 4}
    number, folders = table._current()
    with pytest.raises(RuntimeError, match="committed first"):
        table._commit(number, folders)
    assert table.delete(F.col("n") == 4) == 2 and held(table) == {}
