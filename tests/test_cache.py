"""The content cache: filter, pins and marks."""

import json

import pytest
from pyspark.sql import functions as F

from sparkfolio.functions import scalar as sc
from sparkfolio.operators import cache


def test_the_filter_never_misses_and_rules_most_out(spark):
    keys, others = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("k")), spark.range(3000).select(F.concat(F.lit("o"), "id").alias("k"))
    row, bits = cache.bloom_filter(keys.unionByName(spark.createDataFrame([(None,)], "k string")), "k")
    words = row.first().words
    assert bits == 64 * len(words) >= 10 * 3000
    test = lambda df: df.join(F.broadcast(row)).where(cache.might_hold(F.col("words"), bits, F.col("k"))).count()
    assert test(keys) == 3000
    assert test(others) < 150
    assert test(spark.createDataFrame([(None,)], "k string")) == 0
    assert cache.bloom_filter(keys, "k", most_bytes=100) is None


@pytest.mark.parametrize("most", [cache.MOST_BYTES, 0])
def test_left_lookup_changes_no_result(spark, most):
    rows = spark.createDataFrame([(i, f"k{i % 7}" if i % 5 else None) for i in range(40)], "id int, k string")
    known = spark.createDataFrame([(f"k{i}", i * 10) for i in range(0, 7, 2)], "of string, v int")
    got = sorted(map(repr, cache.left_lookup(rows, "k", known, "of", most).collect()))
    assert got == sorted(map(repr, rows.join(known, F.col("k") == F.col("of"), "left").collect()))
    assert cache.left_lookup(rows, "k", known.limit(0), "of", most).count() == 40


def test_pins_come_from_five_places(spark):
    one = lambda *h: spark.createDataFrame([(x,) for x in h], "hash string")
    stamps = spark.createDataFrame([("/a/x", "s1"), ("/a/b/y", "s2"), ("/ab/z", "s3"), ("/c", "s4"), ("/d/e", "s5")], "path string, hash string")
    drafts = [json.dumps({"overrides": {"o1": "include"}, "folders": ["/a/", "/c", None]}), "not json", json.dumps({"folders": []}), json.dumps({"overrides": {"o1": "exclude", "o2": "include"}})]
    got = cache.pins(one("l1", "l1"), one("p1", None), one("v1"), spark.createDataFrame([(d,) for d in drafts], "json string"), stamps)
    assert sorted(r.hash for r in got.collect()) == ["l1", "o1", "o2", "p1", "s1", "s2", "s4", "v1"]
    everything = cache.under_folders(stamps, spark.createDataFrame([("/",)], "folder string"))
    assert everything.count() == 5


def test_marks_follow_what_could_be_read(spark):
    rows = [("/a", 1, 10, "hit"), ("/b", 2, 20, "failed"), ("/c", 2, 20, "failed"), ("/d", 3, 30, "failed"), ("/e", None, 1, "failed"), ("/f", 4, 40, "miss")]
    lookup = spark.createDataFrame([(*r, "denied") for r in rows], "path string, size long, modified long, state string, error string")
    keyed = spark.createDataFrame([(1, 10), (3, 30), (4, 40), (9, 90)], "size long, modified long").select(sc.failure_key(F.col("size"), F.col("modified")).alias("key"))
    clear, add = cache.marks(lookup, keyed)
    assert clear.count() == 2
    assert [(r.path, r.error) for r in add.collect()] == [("/b", "denied")]
