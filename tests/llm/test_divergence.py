"""Quality rules against brute force, SQL and odd inputs."""

import math
import random
import re

import pytest
from compare import same
from conftest import SMALL
from pyspark.sql import functions as F

from sparkfolio.llm import divergence

DOCS = "doc_id long, lang string, text string"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def some_texts():
    draw = random.Random(5)
    texts = [None, "", " \t\n", "a", "a b", "a b c", "a a a a", "a b c a b c", "x\n\ny\nx\n x\nx\r\n", "é😀 ß|# z a", "w " * 500, "p q " * 90 + "r"]
    for _ in range(40):
        words = [draw.choice("abcde") * draw.randint(1, 2) for _ in range(draw.randint(3, 60))]
        texts.append("".join(w + draw.choice([" ", " ", "\n", "\t ", " | "]) for w in words))
    return texts


@pytest.mark.parametrize("few", [64, 0])
def test_measures(spark, monkeypatch, few):
    monkeypatch.setattr(divergence, "FEW", few)
    texts = some_texts()
    rows = divergence.judged(spark.createDataFrame([(i, "xx", t) for i, t in enumerate(texts)], DOCS).repartition(3)).collect()
    got = {r.doc_id: (r.rule_n_words, r.rule_word_chars, r.rule_n_symbols, r.rule_n_dup_lines, r.rule_n_repeat_words) for r in rows}
    assert [got[i] for i in range(len(texts))] == [brute(t) for t in texts]
    for r in rows:
        assert r.rule_base_failed == (r.rule_n_words < 50 or 100 * r.rule_n_repeat_words > 50 * r.rule_n_words)
        assert not (r.rule_base_failed and r.rule_kept)


def test_matches_sql(spark, duck):
    same(divergence.query(spark, SMALL), duck, divergence.ORACLE_SQL)


def test_junk_goes_and_prose_stays(spark):
    labels, docs = spark.read.parquet(f"{SMALL}/labels.parquet"), spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = divergence.judged(docs).join(labels, "doc_id").where("NOT rule_base_failed").groupBy("quality").agg(F.avg(F.col("rule_kept").cast("int")).alias("kept"), F.count("*").alias("n")).collect()
    kept = {r.quality: r.kept for r in rows}
    assert kept[1] >= 0.98
    assert kept.get(0, 0.0) <= 0.25


def test_distance(spark):
    p, q = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    part = lambda x: sum(a * math.log2(a / c) for a, c in zip(x, m, strict=True) if a)
    row = spark.range(1).select(divergence.distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, q))).alias("d"), divergence.distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, p))).alias("same")).first()
    assert row.d == pytest.approx(math.sqrt((part(p) + part(q)) / 2))
    assert row.same == 0


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    docs = [(1, None, "a b c " * 30), (1, None, "a b c " * 30), (None, "xx", None), (2, "xx", ""), (3, "rare", long)]
    df = spark.createDataFrame([(*d, "x") for d in docs], DOCS + ", rule_kept string")
    rows = divergence.judged(df).collect()
    assert len(rows) == 5 and {r.rule_kept for r in rows} == {"x"} and all(r._rule_kept is not None for r in rows)
    assert [r._rule_n_words for r in rows if r.doc_id == 3] == [60_000]
    empty = divergence.judged(spark.createDataFrame([], DOCS))
    assert empty.collect() == [] and "rule_kept" in empty.columns


def test_no_python_in_the_plan(spark):
    plan = divergence.query(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
