"""First-come sets, places and orders against the sequential rules."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfolio.operators import firstcome


def sequential(rows, radius):
    """rows: (group, at, vector, fixed) -> the ones that stay."""
    stay, ahead = set(), {}
    for g, at, v, fixed in sorted(rows, key=lambda r: (repr(r[0]), r[1])):
        if not v:
            stay.add((g, at))
            continue
        near = [u for u in ahead.get(g, []) if len(u) == len(v) and math.dist(u, v) <= radius]
        if fixed or not near:
            stay.add((g, at))
            ahead.setdefault(g, []).append(v)
    return stay


@pytest.mark.parametrize(("block", "piece"), [(2048, 50_000), (7, 11), (1, 3)])
def test_first_come(spark, block, piece):
    draw = random.Random(block)
    n = 260 if block > 1 else 60
    rows = [(draw.choice(["a", "a", "b", None]), i, draw.choice([None, [], [draw.random()], [draw.random() * 3, draw.random() * 3], [1.0, 1.0]]), draw.random() < 0.1) for i in range(n)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, at long, v array<double>, fixed boolean").repartition(3)
    got = firstcome.first_come(df, ["g"], "at", "v", 0.4, "fixed", block=block, piece=piece).collect()
    assert len(got) == n
    assert {(r.g, r.at) for r in got if r.first} == sequential(rows, 0.4)


def test_first_come_on_a_large_event(spark):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(300, 8))
    v = centres[draw.integers(0, 300, 20_000)] + draw.normal(size=(20_000, 8)) * 0.15
    stay = []
    for i, x in enumerate(v):
        if not stay or not (((v[stay] - x) ** 2).sum(axis=1) <= 0.35**2).any():
            stay.append(i)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "at long, v array<double>").withColumn("g", F.lit(1))
    found = firstcome.first_come(df, ["g"], "at", "v", 0.35, block=512, piece=4000)
    assert sorted(r.at for r in found.where("first").select("at").collect()) == stay


def test_places_cross_the_pole_and_the_date_line(spark):
    rows = [(1, 0, 10.0, 179.99), (1, 1, 10.0, -179.99), (1, 2, 89.99, 0.0), (1, 3, 89.99, 180.0), (1, 4, 0.0, 0.0), (1, 5, None, 3.0), (2, 0, None, None), (None, 0, 5.0, 5.0), (None, 1, 5.0, 6.0)]
    df = spark.createDataFrame(rows, "g int, at long, lat double, lon double")
    assert {r.g: r.places for r in firstcome.places_visited(df, ["g"], "at", "lat", "lon", 10.0).collect()} == {1: 2, 2: 0, None: 2}


def covered(roles, scores, included, distinct):
    """The sequential rule on one list."""
    order = list(range(len(roles)))
    start = included + 1
    end = min(start + firstcome.ROLE_WINDOW, distinct)
    if end <= start or distinct <= end:
        return order
    up = []
    for role in firstcome.OWED:
        if len(up) < end - start and role not in [roles[i] for i in order[:end]]:
            up += [i for i in order[end:distinct] if roles[i] == role and scores[i] >= firstcome.ROLE_FLOOR][:1]
    keep = end - len(up)
    return order[:keep] + up + [i for i in order[keep:distinct] if i not in up] + order[distinct:] if up else order


def test_cover_roles(spark):
    draw = random.Random(8)
    rows, want = [], {}
    for g in range(60):
        n = draw.randint(1, 14)
        roles, scores = [draw.choice([*firstcome.OWED, "moment", "moment"]) for _ in range(n)], [draw.randint(0, 100) for _ in range(n)]
        included = draw.randint(0, min(3, n))
        distinct = draw.randint(included, n)
        want[g] = covered(roles, scores, included, distinct)
        rows += [(g, i, roles[i], scores[i], included, distinct) for i in range(n)]
    df = spark.createDataFrame(rows, "g int, seat int, role string, score int, included int, distinct int").withColumn("i", F.col("seat"))
    got = {}
    for r in firstcome.cover_roles(df, ["g"], "seat", "role", "score").orderBy("g", "seat").collect():
        got.setdefault(r.g, []).append(r.i)
    assert got == want
