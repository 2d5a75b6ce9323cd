"""Target encoding against brute force, SQL and odd inputs."""

import datetime as dt
import random
import zlib

import pytest
from compare import same
from conftest import SMALL
from pyspark.sql import functions as F

from sparkfolio.llm import target_encoding as te

ROWS = "id long, t long, fold int, n long, s long, a string, b long"


def brute(rows, col, row):
    past = [r for r in rows if r[col] == row[col] and r[1] < row[1] and r[2] != row[2]]
    return sum(r[3] for r in past), sum(r[4] for r in past)


@pytest.mark.parametrize(("chunk", "fan", "ranges"), [(10_000, 1024, 8192), (25, 3, 8192), (7, 2, 3)])
def test_histories(spark, monkeypatch, chunk, fan, ranges):
    monkeypatch.setattr(te, "RANGES", ranges)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    draw = random.Random(chunk)
    rows = [(i, draw.choice([5, 5, 5, draw.randint(0, 9), draw.randint(0, 400)]), draw.randrange(5), draw.randint(0, 3), draw.randint(0, 2), draw.choice(["x", "x", "x", "y", None, "null"]), draw.choice([7, 7, -1, None, draw.randint(0, 3)])) for i in range(400)]
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    got = {r.id: (r.a_n, r.a_s, r.b_n, r.b_s) for r in te.histories(df, ["a", "b"], chunk=chunk, fan=fan).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {r[0]: brute(rows, 5, r) + brute(rows, 6, r) for r in rows}


def test_prefix_sums(spark):
    draw = random.Random(1)
    rows = [(draw.choice(["a", "a", "b"]), i, draw.randint(0, 9)) for i in range(200)]
    got = {r.seq: r.v for r in te.prefix_sums(spark.createDataFrame(rows, "group string, seq long, v long"), ["v"], 200, fan=4).collect()}
    assert got == {i: sum(v for g, k, v in rows if g == own and k < i) for own, i, _ in rows}


def test_matches_sql(spark, duck):
    same(te.query(spark, SMALL), duck, te.ORACLE_SQL)


def frames(spark, lines, sales):
    return (
        spark.createDataFrame(lines, "sale_id long, item_id long, vendor_id long, flag string, n int"),
        spark.createDataFrame(sales, "sale_id long, client_id long, sold_at timestamp_ntz, t int"),
        spark.createDataFrame([(1, "k"), (1, "a"), (2, None)], "item_id long, kind string"),
        spark.createDataFrame([(1, 4)], "vendor_id long, nation_id int"),
        spark.createDataFrame([(9, "s")], "client_id long, segment string"),
    )


def test_odd_rows(spark):
    at = dt.datetime(2024, 1, 1)
    lines = [(1, 1, 1, "returned", 0), (1, 1, 1, "returned", 0), (2, None, None, None, 0), (3, 2, 1, "kept", 0), (4, 1, 1, "kept", 0), (None, 1, 1, "kept", 0), (5, 1, 1, "kept", 0), (6, 1, 1, "kept", 0)]
    sales = [(1, 9, at, 0), (2, None, at, 0), (3, 9, at + dt.timedelta(microseconds=1), 0), (4, 9, None, 0), (None, 9, at, 0), (5, 9, at + dt.timedelta(days=1), 0), (6, None, at + dt.timedelta(days=2), 0), (6, 9, at + dt.timedelta(days=2), 0)]
    got = {}
    for r in te.encoded(*frames(spark, lines, sales)).collect():
        got.setdefault(r.sale_id, []).append(r)
    assert sorted(got) == [1, 2, 3, 5, 6] and len(got[6]) == 2
    assert (got[1][0].n_lines, got[1][0].n_returned, got[1][0].item_n, got[1][0].item_rate) == (2, 2, 0, 500_000)
    assert got[2][0].item_id == -1 and got[2][0].vendor_id is None
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    assert got[5][0].item_n == (2 if fold(1) != fold(5) else 0)
    empty = frames(spark, lines, sales)
    assert te.encoded(empty[0].limit(0), *empty[1:]).collect() == []
    assert te.encoded(empty[0], empty[1].limit(0), *empty[2:]).collect() == []


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_micros(spark, kind):
    at = dt.datetime(2024, 2, 29, 13, 14, 15, 123456)
    df = spark.createDataFrame([(at,), (None,)], "sold_at timestamp_ntz").select(F.col("sold_at").cast(kind).alias("sold_at"))
    want = (at - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    assert [r.m for r in df.select(te.micros(df, "sold_at").alias("m")).collect()] == [want, None]
