"""Commits: upserts that are repeated, broken off, and made by two writers."""

import pytest
from tests.conftest import listed

from fieldlens.operators import preparation
from fieldlens.sources import committed

COLUMNS = "collection string, deploymentID string, locationID string"


def merge(old, new):
    return preparation.upsert(old, new, ["collection", "deploymentID"])


def read(spark, path, commit=None):
    return listed(committed.read_committed(spark, path, spark.createDataFrame([], COLUMNS).schema, commit))


def test_upserts_and_broken_commits(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    assert read(spark, path) == []
    first = spark.createDataFrame([("R1", "a", "x"), ("R1", "b", "x"), ("R 2/é", "a", "y")], COLUMNS)
    assert committed.commit_change(spark, path, first, merge) == 1
    change = spark.createDataFrame([("R1", "b", "new"), ("R1", "c", "new"), ("R3", "a", "z")], COLUMNS)

    def broken(*_):
        raise OSError("broken off")

    with monkeypatch.context() as patch:
        patch.setattr(committed, "_publish", broken)
        with pytest.raises(OSError):
            committed.commit_change(spark, path, change, merge)
    assert read(spark, path) == listed(first)  # nothing has changed
    want = sorted([("R1", "a", "x"), ("R1", "b", "new"), ("R1", "c", "new"), ("R 2/é", "a", "y"), ("R3", "a", "z")])
    assert committed.commit_change(spark, path, change, merge) == 2 and read(spark, path) == want
    assert committed.commit_change(spark, path, change, merge) == 3 and read(spark, path) == want
    assert read(spark, path, 1) == listed(first)
    # The collection that was not touched lies where the first commit put it.
    folders = [f.name for f in (tmp_path / "table" / "data").glob("version=*/collection=*")]
    assert sum("R1" in f for f in folders) == 4 and sum("R 2" in f for f in folders) == 1


def test_two_writers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    rows = spark.createDataFrame([("R1", "a", "x")], COLUMNS)
    committed.commit_change(spark, path, rows, merge)
    monkeypatch.setattr(committed, "last_commit", lambda *_: 0)
    late = spark.createDataFrame([("R1", "a", "late")], COLUMNS)
    with pytest.raises(committed.CommitConflict):
        committed.commit_change(spark, path, late, merge)
    monkeypatch.undo()
    assert read(spark, path) == listed(rows)
