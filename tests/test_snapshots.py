"""Commits over several tables: all or nothing, conflicts, history and cascades."""

import pytest
from pyspark.sql import functions as F

from sparkfolio.sources import snapshots, store


@pytest.fixture
def tables(spark, tmp_path):
    return snapshots.Snapshots(spark, f"file://{tmp_path}/store")


def numbers(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "project long")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_a_snapshot_is_all_or_nothing(spark, tables):
    assert tables.numbers() == [] and tables.state()["tables"] == {}
    assert tables.commit({"a": numbers(spark, 1), "b": numbers(spark, 10)}) == 1
    stop = F.when(F.col("project") > 0, F.raise_error(F.lit("worker lost")).cast("long")).otherwise(F.col("project"))
    with pytest.raises(Exception, match="worker lost"):  # breaks off when one table is written and the other isn't
        tables.commit({"a": numbers(spark, 2), "b": numbers(spark, 20).select(stop.alias("project"))})
    assert tables.numbers() == [1]
    assert rows(tables.read("a")) == [(1,)] and rows(tables.read("b")) == [(10,)]
    assert tables.commit({"b": numbers(spark, 20)}) == 2
    assert rows(tables.read("a")) == [(1,)] and rows(tables.read("b")) == [(20,)] and rows(tables.read("b", 1)) == [(10,)]


def test_of_two_writers_one_is_told(spark, tables):
    tables.commit({"a": numbers(spark, 1)})
    began = tables.state()["number"]
    other = snapshots.Snapshots(spark, tables.root)
    assert other.commit({"a": numbers(spark, 2)}, began) == 2
    with pytest.raises(snapshots.Conflict):
        tables.commit({"a": numbers(spark, 3)}, began)
    assert rows(tables.read("a")) == [(2,)] and tables.numbers() == [1, 2]
    assert tables.commit({"a": None, "c": numbers(spark)}) == 3
    assert rows(tables.read("c")) == []
    with pytest.raises(ValueError, match="no table a"):
        tables.read("a")
    with pytest.raises(ValueError, match="no snapshot 9"):
        tables.read("a", 9)


def test_expired_snapshots_take_only_their_own_folders(spark, tables):
    tables.commit({"a": numbers(spark, 1), "b": numbers(spark, 1)})
    tables.commit({"a": numbers(spark, 2)})
    tables.commit({"a": numbers(spark, 3)})
    assert tables.expire(2) == 1
    assert tables.numbers() == [2, 3]
    assert rows(tables.read("a", 2)) == [(2,)] and rows(tables.read("a")) == [(3,)] and rows(tables.read("b")) == [(1,)]
    assert tables.expire(5) == 0


def test_save_replace_and_purge(spark, tables):
    projects = spark.createDataFrame([(1, None), (2, 50), (3, 99), (None, 10)], "project long, deleted_at long")
    photos = spark.createDataFrame([(1, "c"), (1, "a"), (2, "b"), (3, "z"), (3, "y"), (None, "n")], "project long, hash string")
    photos = snapshots.positioned(photos, ["project"], [F.col("hash")])
    tables.commit({"projects": projects, "photos": photos})
    new = snapshots.positioned(spark.createDataFrame([(1, "q"), (None, "m")], "project long, hash string"), ["project"], [F.col("hash")])
    tables.commit({"photos": snapshots.replaced(tables.read("photos"), new, "project")})
    assert rows(tables.read("photos")) == sorted([(1, "q", 0), (2, "b", 0), (3, "y", 0), (3, "z", 1), (None, "m", 0)], key=repr)
    number = snapshots.purge(tables, ["photos"], "projects", "project", "deleted_at", F.lit(50))
    assert number == 3
    assert rows(tables.read("projects")) == sorted([(1, None), (3, 99), (None, 10)], key=repr)
    assert rows(tables.read("photos")) == sorted([(1, "q", 0), (3, "y", 0), (3, "z", 1), (None, "m", 0)], key=repr)
    assert {r.project for r in store.purged(projects, "deleted_at", F.lit(50)).collect()} == {1, 3}
