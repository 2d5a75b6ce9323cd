import base64
import datetime
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from sparkfolio.functions import geometry as geo
from sparkfolio.functions import scalar as sc
from sparkfolio.operators import cluster, joins, rules, search, selection, windows
from sparkfolio.operators.aggregates import auc, gini, mode, spherical_centroid, vector_mean
from sparkfolio.operators.running import percentile_rank, running_sum
from sparkfolio.sources import records, store
from sparkfolio.streaming import ingest

NAN = float("nan")


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_percentile_nan_is_zero_and_not_counted(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, NAN), (4, 9.0), (5, None)], "i int, x double")
    got = {r.i: r.p for r in percentile_rank(df, "x", "p").collect()}
    assert got == {1: 67, 2: 67, 3: 0, 4: 100, 5: 0}
    assert percentile_rank(df.limit(0), "x", "p").collect() == []


def test_running_sum(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 7)
    got = {r.id: r.s for r in running_sum(df, "k", ["id"], F.lit(1), "s").collect()}
    order = sorted(range(1000), key=lambda i: (i % 7, i))
    assert [got[i] for i in order] == list(range(1, 1001))


def test_gap_equal_to_threshold_does_not_split_and_undated_are_last(spark):
    df = spark.createDataFrame([(1, 0), (2, 10), (3, 21), (4, None), (5, None)], "i int, t long").withColumn("k", F.lit(1))
    assert [r.session for r in windows.gap_sessions(df, ["k"], "t", 10, "i").orderBy("i").collect()] == [0, 0, 1, 2, 2]
    none = df.where("t IS NULL")
    assert {r.session for r in windows.gap_sessions(none, ["k"], "t", 10, "i").collect()} == {0}


def test_anchored_windows_do_not_chain(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([0, 100, 121, 240, 400, None, None])], "i int, t long").withColumn("k", F.lit(1))
    assert [r.window for r in windows.anchored_windows(df, ["k"], "t", 120, "i").orderBy("i").collect()] == [0, 0, 1, 1, 2, 3, 4]


def test_complete_linkage_does_not_chain():
    assert cluster.linkage([(0.1, 1, 2), (0.2, 2, 3)], [1, 2, 3]) == {1: 1, 2: 1, 3: 3}
    assert cluster.linkage([(0.1, 1, 2), (0.2, 2, 3), (0.3, 1, 3)], [1, 2, 3]) == {1: 1, 2: 1, 3: 1}


def test_chapters_split_by_place_only_if_the_next_is_away_too(spark):
    town, far = (48.0, 11.0), (52.5, 13.4)
    places = [town] * 10 + [far] + [town] * 2 + [far] * 2
    assert cluster.place_chapters([0] * 15, places, 100) == [0] * 13 + [1] * 2
    rows = [(i, 100 * i, *(town if i < 3 else far)) for i in range(6)]
    df = spark.createDataFrame(rows, "i int, t long, lat double, lon double").withColumn("k", F.lit(1))
    assert [r.chapter for r in cluster.chapters(df, ["k"], "t", "lat", "lon", "i", 1000, 20.0).orderBy("i").collect()] == [0, 0, 0, 1, 1, 1]
    assert {r.chapter for r in cluster.chapters(df, ["k"], "t", "lat", "lon", "i", 1000, None).collect()} == {0}


def test_hash_and_vectors(spark):
    big = F.lit("18446744073709551615").cast("decimal(20,0)")
    assert one(spark, sc.signed_bits(big), sc.hamming(sc.signed_bits(big), F.lit(0).cast("long"))) == (-1, 64)
    a, b = F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0), F.lit(1.0))
    assert one(spark, sc.l2(a, b), sc.l2_shorter(a, b)) == (None, 5.0)
    empty = F.array().cast("array<string>")
    assert one(spark, sc.jaccard(empty, empty), sc.tag_distance(empty, empty)) == (0.0, 0.5)


@pytest.mark.parametrize(("text", "want"), [("+02:30", 9000), ("-14:00", -50400), ("+15:00", None), ("+2:30", None), ("+02:60", None), (None, None)])
def test_offset(spark, text, want):
    assert one(spark, sc.offset_seconds(F.lit(text).cast("string"))) == (want,)


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [(1773277200, 1773280800, "12 Mar 2026"), (1773280800, 1773277200, "12 Mar 2026"), (-1, -1, "31 Dec 1969"), (1772236800, 1772409600, "28 Feb - 2 Mar 2026"), (1772496000, 1773014400, "3-9 Mar 2026"), (1767139200, 1767225600, "31 Dec 2025 - 1 Jan 2026")],
)
def test_date_range(spark, a, b, want):
    assert one(spark, sc.date_range(F.timestamp_seconds(F.lit(a)), F.timestamp_seconds(F.lit(b)))) == (want,)


def test_places(spark):
    assert one(spark, sc.valid_place(F.lit(0.0), F.lit(0.0)), sc.valid_place(F.lit(0.0), F.lit(5.0)), sc.valid_place(F.lit(91.0), F.lit(5.0))) == (False, True, False)
    df = spark.createDataFrame([(1, 10.0, 170.0), (1, 10.0, -170.0), (2, 0.0, 0.0), (2, 0.0, 180.0)], "k int, lat double, lon double")
    got = {r.k: (r.lat, r.lon) for r in spherical_centroid(df, ["k"], "lat", "lon").collect()}
    assert abs(abs(got[1][1]) - 180) < 1e-6
    assert got[2] == (None, None)


def test_names(spark):
    assert one(spark, sc.page_count(F.lit(7)), sc.page_count(F.lit(31)), sc.page_count(F.lit(151))) == (20, 32, None)
    assert one(spark, sc.base_name(F.lit("/a/b//")), sc.first_name(F.lit(" "), F.lit(None).cast("string"), F.lit(" x "))) == ("b", "x")
    assert one(spark, sc.hex_colour(F.lit(1.0), F.lit(0.0), F.lit(0.5))) == ("#ff0080",)


def test_geometry(spark):
    r = lambda *v: geo.rect(*[F.lit(float(x)) for x in v])
    assert one(spark, geo.area(geo.intersect(r(0, 0, 0.5, 0.5), r(0.25, 0.25, 1, 1))), geo.intersect(r(0, 0, 0.1, 0.1), r(0.5, 0.5, 0.1, 0.1))) == (0.0625, None)
    assert one(spark, geo.fold_side(r(0, 0, 0.5, 1)), geo.fold_side(r(0.4, 0, 0.2, 1)), geo.fold_side(r(0.5, 0, 0.5, 1))) == ("left", None, "right")
    boxes = F.array(r(-0.5, 0, 1, 1), r(2, 2, 1, 1), r(0.1, 0.1, 0.2, 0.2))
    assert [tuple(b) for b in one(spark, geo.in_frame(boxes))[0]] == [(0.0, 0.0, 0.5, 1.0), (0.1, 0.1, 0.2, 0.2)]


def test_aggregates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (1, "a"), (2, "c")], "k int, v string")
    assert {tuple(r) for r in mode(df, ["k"], "v").collect()} == {(1, "b", 2), (2, "c", 1)}
    zero = spark.createDataFrame([(1, 0), (1, 0), (2, 0), (2, 4)], "k int, n int")
    assert {tuple(r) for r in gini(zero, ["k"], "n").collect()} == {(1, 0.0), (2, 0.5)}
    scores = spark.createDataFrame([(1, 0.5, True), (1, 0.5, False), (2, 1.0, True)], "k int, s double, p boolean")
    assert {tuple(r) for r in auc(scores, ["k"], "s", "p").collect()} == {(1, 0.5), (2, 0.5)}
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [1.0]), (2, [1.0, 2.0])], "k int, v array<double>")
    assert {r.k: r["mean"] for r in vector_mean(vectors, ["k"], "v").collect()} == {1: [2.0, 3.0], 2: None}


def test_joins(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    with pytest.raises(Exception, match="no match for 2"):
        joins.lookup_or_fail(left, left.where("k = 1").select("k", F.lit(1).alias("f")), ["k"], "f").collect()
    got = joins.ordered_lookup(spark.createDataFrame([([2, 9, 1],)], "keys array<int>"), "keys", left, "k").orderBy("pos")
    assert [(r.k, r.v) for r in got.collect()] == [(2, "y"), (9, None), (1, "x")]
    new = spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    assert {tuple(r) for r in joins.overlay(left, new, ["k"], ["v"]).collect()} == {(1, "x"), (2, "z"), (3, "w")}


def test_evictions_and_selection(spark):
    df = spark.createDataFrame([(1, 10, 5, False), (2, 20, 5, False), (3, 30, 5, True)], "k int, t int, s int, p boolean")
    assert {r.k: r.evict for r in selection.evictions(df, "t", "k", "s", "p", 10).collect()} == {1: True, 2: False, 3: False}
    assert not any(r.evict for r in selection.evictions(df, "t", "k", "s", "p", 15).collect())
    got = selection.select_to(df, F.col("p"), [F.desc("t")], 2)
    assert {r.k for r in got.collect()} == {2, 3}


def test_rules_and_search(spark):
    df = spark.createDataFrame([(1, 5), (2, 50), (3, None)], "k int, x int")
    found = rules.findings(df, ["k"], [("big", "block", F.col("x") > 10), ("odd", "warn", F.col("x") % 2 == 1)])
    assert {tuple(r) for r in found.collect()} == {(2, "big", "block"), (1, "odd", "warn")}
    good, bad = rules.admitted(df, [("big", "block", F.col("x") > 10)])
    assert (good.count(), [r.problems for r in bad.collect()]) == (2, [["big"]])
    assert search.terms("Beaches, beach! the SEAS") == ["beache", "beach", "the", "sea"]
    assert search.keyword_search(df, " ", F.array(F.lit("a")), [F.col("k")], 5).count() == 0


def test_strict_records(spark):
    whole = {"path": "a", "hash": "h", "width": 1, "height": 1, "exif": {}, "isUtility": False, "aestheticScore": 0.5, "sharpness": 1.0, "faces": [], "faceAreaFraction": 0.0, "sceneTags": [], "palette": [], "clippedLow": 0.0, "clippedHigh": 0.0, "phash": 18446744073709551615}
    lacks = {k: v for k, v in whole.items() if k != "faces"}
    df = spark.createDataFrame([(1, json.dumps(whole)), (2, json.dumps(lacks)), (3, "nonsense"), (4, None)], "i int, j string")
    good, bad = records.parse(df, "j")
    assert [(r.i, r.faces, int(r.phash)) for r in good.collect()] == [(1, [], 18446744073709551615)]
    assert {r.i for r in bad.collect()} == {2, 3, 4}
    with pytest.raises(Exception, match="faces"):
        records.parse_all(df.where("i = 2"), "j").collect()
    values = [0.0, -1.5, 3.25, 1e-40, 65504.125]
    text = base64.b64encode(struct.pack("<5f", *values)).decode()
    got = one(spark, records.floats(F.lit(text)), records.floats(F.lit("AAA=")), records.floats(F.lit("")))
    assert got[0] == pytest.approx(list(struct.unpack("<5f", struct.pack("<5f", *values))), rel=1e-12)
    assert got[1:] == (None, [])


def test_scan(spark, tmp_path):
    for name in ("a.JPG", "b.txt", "._c.jpg", "d/e.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    found = records.scan_files(spark, [str(tmp_path), str(tmp_path)])
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["a.JPG", "e.png"]
    found, unreadable = records.scan_tolerant(spark, [str(tmp_path), "/no/such/folder"])
    assert (found.count(), unreadable) == (2, ["/no/such/folder"])


def test_store(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, n int")
    assert {tuple(r) for r in store.upserted(old, new, ["k"], "n").collect()} == {(1, "a"), (2, "d"), (3, "e")}
    assert {r.k for r in store.removed(old, old, ["k"], old.where("k = 1")).collect()} == {1}
    history = spark.createDataFrame([(1, s) for s in range(60)], "p int, s int")
    kept = store.committed(history, spark.createDataFrame([(1, 56)], "p int, s int"), "p", "s", pointer=55, keep=50)
    assert sorted(r.s for r in kept.collect()) == list(range(7, 57))
    states = F.create_map(F.lit("x"), F.lit("include"))
    assert one(spark, store.override(states, F.lit("x"), F.lit("auto")), store.override(states, F.lit("y"), F.lit("exclude"))) == ({}, {"x": "include", "y": "exclude"})
    pages = spark.createDataFrame([(1, [("b", 2), ("a", 1)])], "number int, placements array<struct<f string, z int>>")
    items = store.export_items(pages).select("number", "pos", F.col("placement.f").alias("f"))
    assert json.loads(store.manifest(items, "number", "pos", ["f"]).first().json) == {"page": 1, "items": [{"f": "b"}, {"f": "a"}]}


def test_streams(spark, tmp_path):
    assert ingest.ramp() == [4, 8, 16]
    rows = [(i % 3, datetime.datetime(2024, 1, 1, i)) for i in range(6)]
    spark.createDataFrame(rows, "k int, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, ts timestamp").parquet(str(tmp_path / "in"))
    table = str(tmp_path / "table")
    spark.createDataFrame([(0, None)], "k int, ts timestamp").write.parquet(table)
    seen = []
    run = ingest.ingest(stream, lambda: spark.read.parquet(table), "k", lambda d: d, lambda d: d.write.mode("append").parquet(table), str(tmp_path / "ck"), seen.append)
    run.awaitTermination()
    assert {r.k for r in spark.read.parquet(table).collect()} == {0, 1, 2}
    assert seen[-1] == {"scanned": 3, "cached": 1, "saved": 2}


def test_band_pairs_of_rows_without_a_time(spark, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK", 5)
    draw = random.Random(3)
    rows = [(i, draw.choice([None, draw.randrange(900)]), draw.choice([None, 0.2, 0.4, 0.45, 0.9]), draw.randrange(1 << 6)) for i in range(40)]

    def fits(p, q):  # the reference's rule: only two dated rows can be too far apart
        return p[1] is None or q[1] is None or abs(p[1] - q[1]) <= 120

    def linked(p, q):
        d = None if p[2] is None or q[2] is None else abs(p[2] - q[2])
        near = bin(p[3] ^ q[3]).count("1") <= 1
        return near if d is None else d <= 0.1 or (near and d <= 0.5)

    pairs = joins.band_pairs(spark.createDataFrame(rows, "id long, t long, x double, h long"), "id", "t", 120, ["x", "h"])
    found = sorted((min(r.a, r.b), max(r.a, r.b)) for r in pairs.collect())
    assert found == [(p[0], q[0]) for i, p in enumerate(rows) for q in rows[i + 1 :] if fits(p, q)]
    scored = pairs.selectExpr("a", "b", "abs(a_x - b_x) AS d", "bit_count(a_h ^ b_h) AS bits")
    got = cluster.near_links(scored, "d", "bits", close=0.1, most_bits=1)
    want = [(p[0], q[0]) for i, p in enumerate(rows) for q in rows[i + 1 :] if fits(p, q) and linked(p, q)]
    assert sorted((min(r.a, r.b), max(r.a, r.b)) for r in got.collect()) == want


def test_similar_links_of_odd_rows_without_rows_for_pairs(spark, monkeypatch):
    from sparkfolio.functions import scalar as sc
    from sparkfolio.operators import finalize

    monkeypatch.setattr(finalize, "BLOCK", 17)
    monkeypatch.setattr(finalize, "HELD", 40)
    draw = random.Random(5)
    odd = [None, [], [0.0], [None, 1.0, 0.0], [float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0], [1e200, 0.0, 0.0]]
    vector = lambda: draw.choice(odd) if draw.random() < 0.3 else [draw.choice([0.0, 0.2, 0.35, 0.5]) for _ in range(3)]
    rows = [(i, draw.choice([None, draw.randrange(2000)]), vector(), draw.choice([None, *[draw.randrange(1 << 8) for _ in range(6)]])) for i in range(90)]
    frame = spark.createDataFrame(rows, "id long, t long, v array<double>, h long")
    got = finalize.similar_links(frame, "id", "t", "v", "h", most_bits=2)
    pairs = joins.band_pairs(frame, "id", "t", finalize.SPAN, ["v", "h"]).withColumn("d", sc.l2(F.col("a_v"), F.col("b_v"))).withColumn("bits", sc.hamming(F.col("a_h"), F.col("b_h")))
    want = {(min(r.a, r.b), max(r.a, r.b)): float("inf") if r.d is None else r.d for r in cluster.near_links(pairs, "d", "bits", most_bits=2).collect()}
    found = got.collect()
    assert len(found) == len(want) > 100 and {(r.a, r.b): r.distance for r in found} == want
    assert "CoGroups" in got._jdf.queryExecution().toString()
    assert finalize.similar_links(frame.where("t IS NOT NULL"), "id", "t", "v", "h").where("a >= b").count() == 0


def test_block_distances_have_room_for_rounding():
    import numpy as np
    import pandas as pd

    from sparkfolio.operators import finalize

    draw = np.random.default_rng(3)
    vectors = [*(draw.normal(size=(60, 8)) * 10.0 ** draw.integers(-25, 25, size=(60, 1))), *np.full((2, 8), np.nan), *np.full((2, 8), 1e300)]
    vectors += [v + w for v in vectors[:60] for w in (np.full(8, 0.5 / 8**0.5), np.zeros(8))]  # at the limit or equal
    side = pd.DataFrame({"id": range(len(vectors)), "v": vectors, "h": draw.integers(0, 64, len(vectors)), "_size": 8, "_hashed": draw.random(len(vectors)) < 0.8, "_dated": False})
    got = finalize.near_in_block(side[::2], side, "id", "v", "h", 0.5, 2, 0.35)
    got = {(a, b): d for a, b, d, bits in zip(got.a, got.b, got.distance, got.bits) if d <= 0.35 or (bits <= 2 and d <= 0.5)}
    want = {}
    for a in range(0, len(vectors), 2):
        for b in range(a + 1, len(vectors)):
            total = 0.0
            with np.errstate(all="ignore"):
                for x, y in zip(vectors[a], vectors[b], strict=True):
                    total += (x - y) ** 2
                d = np.sqrt(total)
            if d <= 0.35 or (d <= 0.5 and side._hashed[a] and side._hashed[b] and (int(side.h[a]) ^ int(side.h[b])).bit_count() <= 2):
                want[a, b] = d
    assert got == want and len(want) > 60


def _least_reached(links):
    of = {}
    for a, b in links:
        x, y = of.setdefault(a, {a}), of.setdefault(b, {b})
        if x is not y:
            x |= y
            for n in y:
                of[n] = x
    return {n: min(group) for n, group in of.items()}


def test_components_of_dense_links_take_few_rounds(spark, monkeypatch):
    rounds, write = [], cluster.written
    monkeypatch.setattr(cluster, "written", lambda df, name: rounds.append(name) or write(df, name))
    draw = random.Random(4)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(3000)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(30)] + [(3001, 3000)] * 2 + [(5000, 5000)]
    want = _least_reached((a, b) for a, b in links if a != b)
    frame = spark.createDataFrame(links, "a long, b long").repartition(4)
    assert {r.node: r.component for r in cluster.components(frame).collect()} == want
    rounds.clear()
    dense = spark.createDataFrame(links[:3000], "a long, b long").repartition(4)
    found = cluster.connected(dense).collect()
    assert len(found) == 3000 and all(r.component == want[r.a] for r in found)
    assert len(rounds) <= 2  # stars alternated four times and more before
    assert cluster.components(frame.where("a < 0")).count() == 0


def test_stars_go_piece_by_piece(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(cluster, "PIECE", 7)
    draw = random.Random(8)
    links = [(draw.randrange(60), draw.randrange(60)) for _ in range(50)]
    links = [(a, b) for a, b in links if a != b]
    parts = [pd.DataFrame(links[i : i + 3], columns=["u", "v"]) for i in range(0, len(links), 3)]
    got = [(int(u), int(v)) for part in cluster._in_stars(iter(parts)) for u, v in zip(part.u, part.v, strict=True)]
    assert all(u > v for u, v in got) and _least_reached(got) == _least_reached(links)


@pytest.mark.parametrize("kind", ["distances", "few distances", "copies"])
def test_clusters_merge_in_rounds_as_one_by_one(spark, monkeypatch, kind):
    monkeypatch.setattr(cluster, "LEFT", 20)
    rounds, once = [], cluster.merged_once
    monkeypatch.setattr(cluster, "merged_once", lambda pairs: rounds.append(1) or once(pairs))
    draw = random.Random(kind)
    if kind == "copies":
        links = [(0.0, a, b) for g in range(4) for a in range(10 * g, 10 * g + 10) for b in range(a + 1, 10 * g + 10)] + [(0.5, a, a + 10) for a in range(30)]
    else:
        groups = [draw.sample(range(120), 9) for _ in range(40)]
        pairs = {(min(a, b), max(a, b)) for g in groups for a in g for b in g if a != b and draw.random() < 0.95}
        links = [(draw.random() if kind == "distances" else draw.choice([0.1, 0.2, float("inf")]), a, b) for a, b in pairs]
    want = cluster.linkage(links, sorted({n for _, a, b in links for n in (a, b)}))
    frame = spark.createDataFrame([(b, a, d) for d, a, b in links], "a long, b long, distance double").repartition(3)
    got = {r.node: r.cluster for r in cluster.complete_clusters(frame).collect()}
    assert {n: got.get(n, n) for n in want} == want and set(got) <= set(want)
    assert rounds


def test_scan_takes_names_with_underscores(spark, tmp_path):
    for name in ("_DSC1.ARW", "_sub/b.jpg", "_sub/_deep/c.JPEG", ".hidden/d.jpg", "._e.jpg", "f.txt", "g.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * 5)
    (tmp_path / "link").symlink_to(tmp_path / "_sub")
    rows = records.scan_files(spark, [str(tmp_path), f"file://{tmp_path}/"]).collect()
    assert sorted(r.path.removeprefix(f"{tmp_path}/") for r in rows) == ["_DSC1.ARW", "_sub/_deep/c.JPEG", "_sub/b.jpg", "g.png"]
    assert all(r.length == 5 and r.modified_ns > 10**18 for r in rows)
    found, unreadable = records.scan_tolerant(spark, [str(tmp_path), str(tmp_path / "none")])
    assert (found.count(), unreadable) == (4, [str(tmp_path / "none")])


def test_digests_keep_errors(spark, tmp_path):
    import hashlib

    (tmp_path / "_a.jpg").write_bytes(b"abc" * 700_000)
    paths = [str(tmp_path / "none.jpg"), str(tmp_path / "_a.jpg"), str(tmp_path)]
    rows = records.digests(spark, paths).orderBy("pos").collect()
    assert [r.path for r in rows] == paths
    assert [r.hash for r in rows] == [None, hashlib.sha256(b"abc" * 700_000).hexdigest(), None]
    assert [r.error is None for r in rows] == [False, True, False]


def test_finalized_by_hand(spark):
    from sparkfolio.operators import finalize

    schema = "path string, at long, print array<double>, phash long, aesthetic double, sharpness double, faces array<int>, is_utility boolean"
    rows = [
        ("/a", 0, [0.0, 0.0], 0, 0.2, 0.5, [1], False),
        ("/b", 60, [0.1, 0.0], 255, 0.9, 0.5, [], False),  # near /a by vector
        ("/c", 500, [0.1, 0.0], 255, 0.8, 0.1, None, False),  # too late for /b
        ("/d", None, [0.1, 0.1], 0, 0.7, 0.1, [1, 2], False),  # undated: near all of them
        ("/e", 20_000, None, 3, 0.5, float("nan"), [], False),
        ("/f", 20_010, None, 1, None, 0.9, [], False),  # near /e by hash alone
        ("/g", 60_000, [9.0, 9.0], 77, 0.99, 0.9, [], True),
    ]
    got = {r.path: r for r in finalize.finalized(spark.createDataFrame(rows, schema)).collect()}
    groups = {}
    for r in got.values():
        groups.setdefault(r.near_dup_cluster, set()).add(r.path)
    # complete linkage: the nearest of /b-/d and /c-/d joins first, the rest must be linked to all
    assert {"/e", "/f"} in groups.values()
    assert {"/g"} in groups.values()
    assert not any({"/b", "/c"} <= g for g in groups.values())
    assert [got[p].event_cluster for p in ("/a", "/b", "/c", "/e", "/f", "/g", "/d")] == [0, 0, 0, 1, 1, 2, 3]
    assert (got["/g"].aesthetic_pct, got["/g"].kept, got["/e"].kept, got["/f"].kept) == (100, False, False, True)
    assert [got[p].face_count for p in ("/a", "/c", "/d")] == [1, 0, 2]
    assert "phash" not in got["/a"].asDict()
    assert sum(r.kept for r in got.values()) == len(groups) - 1
    assert sorted({r.near_dup_cluster for r in got.values()}) == list(range(len(groups))) and got["/a"].near_dup_cluster == 0
    assert {r.status for r in got.values()} == {"ok"}


RECORD = "path string, at long, offset int, print array<double>, phash long, aesthetic double, sharpness double, quality double, low double, high double, faces array<int>, is_utility boolean, refused boolean"


def _finalized(spark, rows):
    from sparkfolio.operators import finalize

    frame = spark.createDataFrame(rows, RECORD).repartition(3)
    return {r.path: r for r in finalize.finalized(frame, offset="offset", quality="quality", clipped=("low", "high"), refused="refused").collect()}


@pytest.mark.parametrize(
    ("better", "worse"),
    [
        # aesthetic, sharpness, quality, low, high: what decides, in its order
        ((0.1, 0.1, None, 0.0, 0.9), (0.9, 0.9, 0.9, 0.95, 0.0)),
        ((0.1, 0.1, None, 0.9, 0.0), (0.9, 0.9, 0.9, 0.0, 0.91)),
        ((0.1, 0.9, None, 0.0, 0.0), (0.9, 0.1, 0.9, 0.0, 0.0)),
        ((0.1, 0.5, 0.2, 0.0, 0.0), (0.9, 0.5, 0.1, 0.0, 0.0)),
        ((0.1, 0.5, 0.0, 0.0, 0.0), (0.9, 0.5, None, 0.0, 0.0)),
        ((0.9, 0.5, 0.5, 0.0, 0.0), (0.1, 0.5, 0.5, 0.0, 0.0)),
    ],
)
def test_survivor_of_a_cluster(spark, better, worse):
    def row(path, score):
        aesthetic, sharpness, quality, low, high = score
        return (path, 10, None, [0.0], 0, aesthetic, sharpness, quality, low, high, [], False, False)

    for first, second in ((better, worse), (worse, better)):
        got = _finalized(spark, [row("/a", first), row("/b", second)])
        assert {p for p, r in got.items() if r.kept} == {"/a" if first is better else "/b"}


def test_survivor_ties_refusals_and_overlooked_rows(spark):
    same = (None, [0.0], 0, 0.5, 0.5, 0.5, 0.0, 0.0, [])
    rows = [("/c", 10, *same, False, False), ("/b", 11, *same, False, False), ("/a", 12, *same, True, False), ("/0", 13, *same, False, True)]
    got = _finalized(spark, rows)
    assert {p for p, r in got.items() if r.kept} == {"/b"}
    assert {r.near_dup_cluster for r in got.values()} == {0}


def test_offsets_are_borrowed_and_instants_decide(spark):
    other = ([0.0], 0, 0.5, 0.5, None, 0.0, 0.0, [], False, False)
    far = ([99.0], 0, 0.5, 0.5, None, 0.0, 0.0, [], False, False)
    rows = [("/a", 1000, 3600, *other), ("/b", 1100, None, *other), ("/c", 1200, -3600, *far), ("/d", 90_000, None, *far), ("/e", None, 7200, [50.0], *far[1:]), ("/f", 1000 - 3600, None, *far)]
    got = _finalized(spark, rows)
    # /b is as near to /a as to /c: the earlier path; /d has nobody on its day, /f lies on the day before
    assert [got[p].utc_offset_sec for p in ("/a", "/b", "/c", "/d", "/e", "/f")] == [3600, 3600, -3600, None, None, None]
    assert got["/a"].near_dup_cluster == got["/b"].near_dup_cluster
    assert len({got[p].near_dup_cluster for p in ("/a", "/c", "/d", "/e", "/f")}) == 5
    assert [got[p].event_cluster for p in ("/f", "/a", "/c", "/d", "/e")] == [0, 0, 0, 1, 2]


def test_equal_links_merge_in_the_order_of_paths(spark):
    # chains a-b-c by hash alone, whose ends differ by 8 bits: the first two paths join
    rows = []
    for k in range(12):
        for j, bits in enumerate((0, 0b1111, 0b11111111)):
            rows.append((f"/{k:02}{'abc'[(j + k) % 3]}", k * 1000, None, None, bits, 0.5, 0.5, None, 0.0, 0.0, [], False, False))
    got = _finalized(spark, rows)
    for k in range(12):
        of = {r[0][-1]: r[4] for r in rows if r[0].startswith(f"/{k:02}")}
        pairs = sorted((x, y) for x in of for y in of if x < y and bin(of[x] ^ of[y]).count("1") <= 4)
        x, y = pairs[0]
        alone = ({"a", "b", "c"} - {x, y}).pop()
        number = {c: got[f"/{k:02}{c}"].near_dup_cluster for c in "abc"}
        assert number[x] == number[y] != number[alone]


def test_running_operators_follow_one_order(spark):
    from sparkfolio.operators import running

    draw = random.Random(9)
    rows = [(i, draw.choice([None, 5, 5, 5, draw.randint(0, 900)]), draw.choice([None, float("nan"), 1.0, 1.0, draw.random()])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, at long, x double").repartition(5)
    places = {r.id: r.place for r in running.placed(df, ["at", "id"]).collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert [places[r[0]] for r in order] == list(range(500))
    dated, number, before, want = [r for r in order if r[1] is not None], 0, None, {}
    for i, at, _ in dated:
        number += before is not None and at - before > 3
        before, want[i] = at, number
    want |= {r[0]: number + 1 for r in rows if r[1] is None}
    assert {r.id: r.session for r in running.gap_numbers(df, "at", 3, "id").collect()} == want
    assert {r.session for r in running.gap_numbers(df.where("at IS NULL"), "at", 3, "id").collect()} == {0}
    total, sums = 0, {}
    for i, at, _ in dated:
        total += at
        sums[i] = total
    assert {r.id: r.up for r in running.running_sum(df.where("at IS NOT NULL"), "at", ["id"], F.col("at"), "up").collect()} == sums
    valid = [r[2] for r in rows if r[2] is not None and r[2] == r[2]]
    pct = lambda x: 0 if x is None or x != x else int(100 * sum(v <= x for v in valid) / len(valid) + 0.5)
    assert {r.id: r.pct for r in running.percentile_rank(df, "x", "pct").collect()} == {r[0]: pct(r[2]) for r in rows}
    assert {r.pct for r in running.percentile_rank(df.where("x IS NULL"), "x", "pct").collect()} == {0}


