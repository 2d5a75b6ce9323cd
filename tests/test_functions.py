"""Small column functions on known values, unknown ones included."""

import pytest
from pyspark.sql import functions as F

from sparkfolio.functions import geometry as geo
from sparkfolio.functions import printing as pr
from sparkfolio.functions import scalar as sc
from sparkfolio.operators import rules

BOX = "struct<x:double,y:double,w:double,h:double>"
SPEC = pr.PrintSpec(10.0, 10.0, 0.1, 0.5, 0.2, 100, 300)


def value(spark, column, schema="x int", row=(1,)):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first().v


def box(*b):
    return F.struct(*[F.lit(float(v)).alias(c) for c, v in zip("xywh", b, strict=True)])


def nothing():
    return F.lit(None).cast(BOX)


def test_names(spark):
    got = value(spark, F.array(sc.extension(F.lit("/a.b/C.JPG")), sc.extension(F.lit("/a.b/c")), sc.failure_key(F.lit(5), F.lit(7)), sc.byte_label(F.lit(2_500_000_000)), sc.byte_label(F.lit(1_600_000)), sc.byte_label(F.lit(900))))
    assert got == ["jpg", "", "stamp:5:7", "2.5 GB", "2 MB", "1 KB"]
    names = value(spark, F.transform(F.array(*map(F.lit, (7, 42, 107))), lambda p: sc.file_name(p, F.lit(1), F.lit("0123456789"))))
    assert names == ["p07-z1-01234567", "p42-z1-01234567", "p107-z1-01234567"]
    assert value(spark, F.array(sc.is_digest(F.lit("a" * 64)), sc.is_digest(F.lit("A" * 64)), sc.is_digest(F.lit("a" * 63)), sc.is_digest(F.lit(None).cast("string")))) == [True, False, False, False]
    assert value(spark, F.array(sc.instant(F.lit(100), F.lit(40)), sc.instant(F.lit(100), F.lit(None).cast("int")))) == [60, 100]


def test_scores_of_unknown_things_are_neutral(spark):
    none = F.lit(None).cast("double")
    assert value(spark, F.array(pr.face_quality(none), pr.face_quality(F.lit(1.5)), pr.face_quality(F.lit(-1.0)), pr.face_quality(F.lit(0.3)))) == [0.5, 1.0, 0.0, 0.3]
    assert value(spark, F.array(geo.gap_distance(none, F.lit(3.0)), geo.gap_distance(F.lit(0.0), F.lit(1800.0)), geo.gap_distance(F.lit(0.0), F.lit(1e9)))) == [0.5, 0.5, 1.0]
    assert value(spark, geo.intersect(nothing(), box(0, 0, 1, 1))) is None
    assert value(spark, geo.intersect(box(0, 0, 1, 1), nothing())) is None
    assert value(spark, F.array(geo.retention(box(0, 0, 0.5, 1), nothing()), geo.retention(box(0, 0, 0.5, 1), box(0.25, 0, 0.5, 1)), geo.retention(box(0, 0, 0.5, 1), box(0.6, 0, 0.2, 1)))) == [0.5, 0.5, 0.0]
    colour = lambda r, g, b: F.struct(F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b"))
    unknown = F.lit(None).cast("struct<r:double,g:double,b:double>")
    assert value(spark, F.array(geo.colour_distance(colour(0.0, 0.0, 0.0), colour(1.0, 1.0, 1.0)), geo.colour_distance(unknown, colour(0.0, 0.0, 0.0)))) == pytest.approx([1.0, 0.5])
    side = F.lit("left")
    assert value(spark, F.array(pr.gutter_saliency(SPEC, nothing(), box(0, 0, 1, 1), box(0, 0, 1, 1), side), pr.gutter_saliency(SPEC, box(0.9, 0, 0.1, 1), box(0, 0, 1, 1), box(0, 0, 1, 1), side))) == pytest.approx([1.0, 0.5])
    assert value(spark, F.array(pr.hero_match(F.lit(40), F.lit(80), F.lit(True)), pr.hero_match(F.lit(40), F.lit(0), F.lit(True)), pr.hero_match(F.lit(40), F.lit(80), F.lit(False)))) == [0.5, 0.5, 0.5]


def test_resolution_and_light(spark):
    assert value(spark, F.array(geo.effective_dpi(F.lit(3000.0), F.lit(0.5), F.lit(5.0)), geo.headroom(F.lit(200.0), 100, 300), geo.headroom(F.lit(50.0), 100, 300), geo.headroom(F.lit(900.0), 100, 300))) == [300.0, 0.5, 0.0, 1.0]
    warm = F.array(F.struct(F.lit(1.0).alias("r"), F.lit(0.0).alias("b"), F.lit(3.0).alias("weight")), F.struct(F.lit(0.0).alias("r"), F.lit(1.0).alias("b"), F.lit(1.0).alias("weight")))
    assert value(spark, F.array(geo.warmth(warm), geo.warmth(F.filter(warm, lambda c: F.lit(False))))) == [0.75, 0.5]
    assert value(spark, geo.share_over(F.array(F.lit(0.1), F.lit(0.6), F.lit(0.9), F.lit(0.5)), 0.5)) == 0.5
    assert value(spark, geo.share_over(F.array().cast("array<double>"), 0.5)) is None


def test_bleeding_edges(spark):
    full, edge = box(0, 0, 1, 1), lambda *e: F.array(*map(F.lit, e))
    assert value(spark, F.array(pr.bleeds_correctly(full, edge("left", "top", "bottom"), F.lit("left")), pr.bleeds_correctly(full, edge("right"), F.lit("left")), pr.bleeds_correctly(full, edge("right"), F.lit("right")), pr.bleeds_correctly(box(0.1, 0, 0.9, 1), edge("left"), F.lit("left")), pr.bleeds_correctly(box(0.1, 0.1, 0.5, 0.5), F.array().cast("array<string>"), F.lit("left")))) == [True, False, True, False, True]


def test_findings_by_severity(spark):
    df = spark.createDataFrame([(1, 5), (2, 50), (3, None)], "id int, x int")
    block, warn = rules.by_severity(rules.findings(df, ["id"], [("small", "block", F.col("x") < 10), ("odd", "warn", F.col("x") > 1)]))
    assert [(r.id, r.rule) for r in block.collect()] == [(1, "small")]
    assert sorted((r.id, r.rule) for r in warn.collect()) == [(1, "odd"), (2, "odd")]
