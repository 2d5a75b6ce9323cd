import pytest
from pyspark.sql import functions as F

from sparkfolio.operators import story


def test_roles(spark):
    rows = [(1, 0.03, []), (1, 0.01, ["adult"]), (1, 0.01, ["food"]), (0, 0.0, ["food", "lake"]), (0, 0.0, ["x"]), (0, 0.5, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, faces int, area double, tags array<string>")
    got = df.select("i", story.shot_role(F.col("faces"), F.col("area"), F.col("tags")).alias("r")).orderBy("i")
    assert [r.r for r in got.collect()] == ["people", "people", "detail", "establishing", "moment", "moment"]


@pytest.mark.parametrize(
    ("roles", "calm", "want"),
    [
        ("mmem", [0, 0, 0, 0], [0, 1, 2, 3]),  # beyond the first half: no opener
        ("memm", [0, 0, 0, 0], [1, 0, 2, 3]),
        ("mmmm", [0, 0, 9, 0], [0, 1, 3, 2]),
        ("eem", [0, 9, 0], [0, 1, 2]),
        ("mmeemm", [0, 0, 0, 7, 5, 1], [1, 2, 0, 5, 3, 4]),
    ],
)
def test_sequence(spark, roles, calm, want):
    names = {"m": "moment", "e": "establishing"}
    df = spark.createDataFrame([(1, i, names[r], 50, float(c)) for i, (r, c) in enumerate(zip(roles, calm, strict=True))], "k int, pos int, role string, score int, calm double")
    got = story.sequenced(df, ["k"], "pos", "role", "score", "calm").orderBy("pos")
    assert [r.seat for r in got.collect()] == want


def test_anchors_and_repeats(spark):
    df = spark.createDataFrame([(1, i, "a") for i in range(4)] + [(2, i, "ab"[i % 2]) for i in range(3)], "k int, pos int, v string")
    assert {(r.k, r.pos) for r in story.anchors(df, ["k"], "pos").where("lead OR tail").collect()} == {(1, 0), (1, 3)}
    assert {(r.k, r.pos) for r in story.same_three(df, ["k"], "pos", "v").where("repeats").collect()} == {(1, 1), (1, 2)}
    kept = story.strongest(df, ["k"], [F.desc("pos")], 2, F.col("pos") == 0)
    assert {(r.k, r.pos) for r in kept.collect()} == {(1, 0), (1, 3), (2, 0), (2, 2)}


def test_header_title_harmony_focus(spark):
    df = spark.createDataFrame([(1, 0, "h"), (1, 1, None), (1, 2, "i")], "k int, pos int, h string")
    assert [r.active for r in story.active_header(df, ["k"], "pos", "h").orderBy("pos").collect()] == ["h", "h", "i"]
    none = F.lit(None).cast("timestamp")
    assert spark.range(1).select(story.event_title(F.lit(" "), none, none, F.lit(3))).first()[0] == "Event 3"
    colours = spark.createDataFrame([(1, 1.0, 0.0), (1, 1.0, 0.0), (2, 1.0, 0.0), (3, 1.0, 0.0), (3, 0.0, 1.0)], "k int, r double, b double")
    got = {r.k: r.harmony for r in story.harmony(colours, ["k"], "r", "b").collect()}
    assert got[1] == pytest.approx(1) and got[2] == 0.5 and got[3] == pytest.approx(0.5**0.5)
    boxes = spark.createDataFrame([([((0.0, 0.0, 0.2, 0.2), 0.5)], (0.5, 0.5, 0.2, 0.2)), (None, None)], "f array<struct<box:struct<x:double,y:double,w:double,h:double>,quality:double>>, s struct<x:double,y:double,w:double,h:double>")
    got = [tuple(r[0]) for r in boxes.select(story.focus(F.col("f"), F.col("s"))).collect()]
    assert got[0] == pytest.approx((0.225, 0.225)) and got[1] == (0.5, 0.5)
