"""Merges of stored tables: new and known keys, null keys, new columns, broken merges, untouched buckets."""

import os

import pytest
from pyspark.errors import AnalysisException

from wardgraph.sources import store

DDL = "key string, part int, x string, n int"


def rows(spark, path):
    return sorted([tuple(r) for r in store.read(spark, path).select("key", "part", "x", "n").collect()], key=str)


def test_merge(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(AnalysisException):
        store.read(spark, path)
    store.merge(spark.createDataFrame([("a", 1, "old", 1), ("b", None, "old", 2), (None, None, "old", 3)], DDL), path, ["key", "part"], buckets=4)
    store.merge(spark.createDataFrame([("b", "new"), ("c", "new"), (None, "new")], "key string, x string").selectExpr("key", "cast(null as int) part", "x"), path, ["key", "part"], buckets=4)
    assert rows(spark, path) == sorted([("a", 1, "old", 1), ("b", None, "new", 2), ("c", None, "new", None), (None, None, "new", 3)], key=str)
    # Only the named column changes on known rows; equal keys of one merge count once.
    store.merge(spark.createDataFrame([("a", 1, "z", 9), ("a", 1, "y", 9)], DDL), path, ["key", "part"], buckets=4, on_match=["n"])
    assert ("a", 1, "old", 9) in rows(spark, path)
    # A new column reaches all rows.
    store.merge(spark.createDataFrame([("a", 1, True)], "key string, part int, seen boolean"), path, ["key", "part"], buckets=4)
    assert {r.key: r.seen for r in store.read(spark, path).collect()}["a"] is True
    store.merge(spark.createDataFrame([], DDL), path, ["key", "part"], buckets=4)
    assert len(rows(spark, path)) == 4


def test_a_broken_merge_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    store.merge(spark.createDataFrame([(f"k{i}", i, "old", i) for i in range(40)], DDL), path, ["key"], buckets=8)
    before, manifest = rows(spark, path), store.manifest(spark, path)
    change = spark.createDataFrame([("k7", 7, "new", 0)], DDL)
    store.prepare_merge(change, path, ["key"], buckets=8)
    assert rows(spark, path) == before
    store.merge(change, path, ["key"], buckets=8)
    after = store.manifest(spark, path)
    assert after[0] == manifest[0] + 1
    # The other buckets are those that were there.
    changed = [b for b in after[1] if after[1][b] != manifest[1][b]]
    assert len(changed) == 1 and len(os.listdir(f"{path}/data/{after[1][changed[0]]}")) <= 3
    assert sorted(set(rows(spark, path)) ^ set(before), key=str) == sorted([("k7", 7, "new", 0), ("k7", 7, "old", 7)], key=str)
