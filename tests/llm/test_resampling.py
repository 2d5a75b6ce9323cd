"""Importance resampling against brute force, SQL and odd inputs."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from compare import same
from conftest import SMALL

from sparkfolio.llm import resampling

DOCS = "doc_id long, text string"


def grams_of(text, orders):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [" ".join(words[i : i + k]) for k in range(1, orders + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, orders=1, buckets=10_000, share=10, least=20, seed=2024):
    of = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (collections.Counter(of(g) for x in texts for g in grams_of(x, orders)[1]) for texts in ([x for _, x in docs], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = {}
    for i, text in docs:
        words, grams = grams_of(text, orders)
        weight = sum(gain(of(g)) for g in grams) // len(grams) if grams else 0
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        out[i] = [len(words), len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))]
    able = sorted((i for i in out if out[i][0] >= least), key=lambda i: (-out[i][3], i))
    rank = {i: k + 1 for k, i in enumerate(able[: share * len(able) // 100])}
    return {i: (*x[1:], rank.get(i)) for i, x in out.items()}


def corpus(n=80):
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abAé ß19_") for _ in range(draw.randint(1, 5)))
    return [(i, " ".join(word() for _ in range(draw.randint(0, 60)))) for i in range(n)] + [(1000, None), (1001, ""), (1002, "--- !")]


@pytest.mark.parametrize(("orders", "block"), [(1, 1 << 16), (3, 1 << 16), (3, 7), (2, 4)])
def test_against_brute_force(spark, monkeypatch, orders, block):
    monkeypatch.setattr(resampling, "BLOCK", block)
    docs, target = corpus(), ["ab AB ab é1", "b a", None, "ß"]
    rows = resampling.ranked(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame([(x,) for x in target], "text string"), orders=orders, buckets=97, share=30).collect()
    assert {r.id: (r.n_features, r.weight, r.score, r.rank) for r in rows} == brute(docs, target, orders, 97, 30)


def test_matches_sql(spark, duck):
    same(resampling.query(spark, SMALL), duck, resampling.ORACLE_SQL)


def test_odd_rows(spark):
    text = " ".join(f"w{i % 50}" for i in range(40))
    docs = [(5, text, 1), (5, text, 2), (None, text, 3), (None, None, 4), (6, "w " * 100_000, 5)]
    df, target = spark.createDataFrame(docs, "doc_id long, text string, rank int"), spark.createDataFrame([("w1",)], "text string")
    rows = resampling.ranked(df, target, share=100).collect()
    assert sorted(r.rank or 0 for r in rows) == [0, 1, 2, 3, 4]
    assert [r.n_features for r in rows if r.id == 6] == [100_000]
    taken = resampling.drawn(df, target, share=100)
    assert taken.columns == df.columns and sorted(r["rank"] for r in taken.collect()) == [1, 2, 3, 5]
    assert resampling.ranked(df.limit(0), target).collect() == []
    assert all(r.weight <= 0 for r in resampling.ranked(df, target.limit(0)).collect() if r.n_features == 100_000)
