"""Queries of what is picked and in which order: places, look-alikes, roles."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import cache, firstcome, layouts
from ..operators.running import percentile_of
from ..sources import ledger, snapshots
from ..sources.shared import shared_dir, written
from .queries import LAT, LON, SPEC, query, table

PLACE_KM = 700.0
#: States kept by user; few, so that the oldest are trimmed.
LEDGER_CAP = 8


@query(f"""WITH RECURSIVE p AS (SELECT c_nationkey AS g, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k, radians({LAT}) AS la, radians({LON}) AS lo FROM customer
    WHERE {LAT} BETWEEN -90 AND 90 AND {LON} BETWEEN -180 AND 180 AND NOT ({LAT} = 0 AND {LON} = 0)),
  c AS (SELECT g, 0::BIGINT AS k, []::STRUCT(a DOUBLE, o DOUBLE)[] AS seen FROM (SELECT DISTINCT g FROM p) UNION ALL
    SELECT c.g, p.k, CASE WHEN len(list_filter(seen, lambda q: 2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin((q.a - la) / 2), 2) + cos(la) * cos(q.a) * pow(sin((q.o - lo) / 2), 2)))) <= {PLACE_KM})) = 0
      THEN list_append(seen, {{'a': la, 'o': lo}}) ELSE seen END FROM c JOIN p ON p.g = c.g AND p.k = c.k + 1)
  SELECT g AS c_nationkey, CAST(max(len(seen)) AS BIGINT) AS places FROM c GROUP BY g""")
def places_visited(spark, sf_dir):
    """How many places far from each other the customers of a nation are in, first come."""
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.expr(LAT).cast("double").alias("lat"), F.expr(LON).cast("double").alias("lon"))
    return firstcome.places_visited(rows, ["c_nationkey"], "c_custkey", "lat", "lon", PLACE_KM)


@query(f"""WITH RECURSIVE r AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e, vec_id % 50 = 0 AS fixed, round(embedding[1]::DOUBLE, 1) AS aes,
      CASE vec_id % 9 WHEN 0 THEN 'establishing' WHEN 1 THEN 'people' WHEN 2 THEN 'detail' ELSE 'moment' END AS role FROM embeddings),
  o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY NOT fixed, CASE WHEN fixed THEN 0 ELSE -aes END, vec_id) AS k, CAST(round(100.0 * count(*) OVER (ORDER BY aes) / count(*) OVER ()) AS INT) AS pct FROM r),
  n AS (SELECT a.label, a.k, list(b.k) AS near FROM o a JOIN o b ON a.label = b.label AND b.k < a.k AND list_distance(a.e, b.e) <= 1.0 GROUP BY ALL),
  m AS (SELECT o.label, o.k, fixed, coalesce(near, []) AS near FROM o LEFT JOIN n ON n.label = o.label AND n.k = o.k),
  c AS (SELECT label, 0::BIGINT AS k, []::BIGINT[] AS ahead FROM (SELECT DISTINCT label FROM o) UNION ALL
    SELECT c.label, m.k, CASE WHEN fixed OR len(list_intersect(near, ahead)) = 0 THEN list_append(ahead, m.k) ELSE ahead END FROM c JOIN m ON m.label = c.label AND m.k = c.k + 1),
  f AS (SELECT label, arg_max(ahead, k) AS ahead FROM c GROUP BY label),
  s AS (SELECT o.*, list_contains(ahead, k) AS first, row_number() OVER (PARTITION BY o.label ORDER BY NOT fixed, NOT list_contains(ahead, k), k) - 1 AS seat FROM o JOIN f ON f.label = o.label),
  d AS (SELECT *, count(*) FILTER (WHERE fixed) OVER g AS included, count(*) FILTER (WHERE fixed OR first) OVER g AS fresh FROM s WINDOW g AS (PARTITION BY label)),
  w AS (SELECT *, included + 1 AS a, least(included + 1 + {firstcome.ROLE_WINDOW}, fresh) AS b FROM d),
  h AS (SELECT label, max(a) AS a, max(b) AS b, max(fresh) AS fresh, [x FOR x IN [
      CASE WHEN count(*) FILTER (WHERE role = 'establishing' AND seat < b) = 0 THEN min(seat) FILTER (WHERE role = 'establishing' AND seat >= b AND seat < fresh AND pct >= {firstcome.ROLE_FLOOR}) END,
      CASE WHEN count(*) FILTER (WHERE role = 'people' AND seat < b) = 0 THEN min(seat) FILTER (WHERE role = 'people' AND seat >= b AND seat < fresh AND pct >= {firstcome.ROLE_FLOOR}) END,
      CASE WHEN count(*) FILTER (WHERE role = 'detail' AND seat < b) = 0 THEN min(seat) FILTER (WHERE role = 'detail' AND seat >= b AND seat < fresh AND pct >= {firstcome.ROLE_FLOOR}) END] IF x IS NOT NULL] AS up FROM w GROUP BY label),
  u AS (SELECT label, CASE WHEN b > a AND fresh > b THEN up[1:b - a] ELSE [] END AS up FROM h),
  x AS (SELECT w.*, up, b - len(up) AS keep FROM w JOIN u ON u.label = w.label)
  SELECT label, vec_id, included, fresh AS "distinct", CAST(CASE WHEN list_contains(up, seat) THEN keep + list_position(up, seat) - 1
    WHEN len(up) > 0 AND seat >= keep AND seat < fresh THEN seat + len(list_filter(up, lambda y: y > seat)) ELSE seat END AS INT) AS seat FROM x""")
def event_order(spark, sf_dir):
    """The order of an event's pictures: chosen ones, best unlike ones with every role early, look-alikes."""
    rows = table(spark, sf_dir, "embeddings").withColumn("fixed", F.col("vec_id") % 50 == 0).withColumn("aes", F.round(F.element_at("embedding", 1).cast("double"), 1))
    role = F.element_at(F.array(*[F.lit(x) for x in ("establishing", "people", "detail", *["moment"] * 6)]), (F.col("vec_id") % 9 + 1).cast("int"))
    rows = rows.withColumn("role", role).withColumn("pct", percentile_of(rows, "aes"))
    best = F.when(F.col("fixed"), F.lit(0.0)).otherwise(-F.col("aes"))
    rows = rows.withColumn("at", F.row_number().over(W.partitionBy("label").orderBy((~F.col("fixed")).cast("int"), best, "vec_id")))
    seated = firstcome.look_alikes_last(rows, ["label"], "at", "embedding", "fixed", 1.0)
    return firstcome.cover_roles(seated, ["label"], "seat", "role", "pct").select("label", "vec_id", "included", "distinct", "seat")

#: Templates of one to four slots: template, side, box and whether the slot is the hero's.
LIBRARY = [
    ("a1", "left", (0.1, 0.1, 0.8, 0.8), True),
    ("b1", "right", (0.2, 0.1, 0.7, 0.5), False),
    ("a2", "left", (0.1, 0.1, 0.8, 0.6), True),
    ("a2", "right", (0.1, 0.1, 0.8, 0.6), False),
    ("b2", "left", (0.1, 0.1, 0.4, 0.8), False),
    ("b2", "left", (0.55, 0.1, 0.4, 0.8), False),
    ("a3", "left", (0.1, 0.1, 0.8, 0.8), True),
    ("a3", "right", (0.1, 0.1, 0.4, 0.4), False),
    ("a3", "right", (0.55, 0.1, 0.4, 0.4), False),
    ("b3", "left", (0.05, 0.05, 0.4, 0.4), False),
    ("b3", "left", (0.05, 0.5, 0.4, 0.4), False),
    ("b3", "right", (0.0, 0.0, 1.0, 1.0), True),
    ("a4", "left", (0.1, 0.1, 0.35, 0.35), False),
    ("a4", "left", (0.55, 0.1, 0.35, 0.35), False),
    ("a4", "right", (0.1, 0.1, 0.35, 0.35), False),
    ("a4", "right", (0.55, 0.1, 0.35, 0.35), False),
    ("b4", "left", (0.1, 0.1, 0.8, 0.8), True),
    ("b4", "right", (0.1, 0.1, 0.25, 0.6), False),
    ("b4", "right", (0.4, 0.1, 0.25, 0.6), False),
    ("b4", "right", (0.7, 0.1, 0.25, 0.6), False),
]
SEATS = [(t, sum(x[0] == t for x in LIBRARY[:i]), side, box, hero) for i, (t, side, box, hero) in enumerate(LIBRARY)]
_SEATS_SQL = ", ".join(f"('{t}', {k}, '{side}', {x}::DOUBLE, {y}::DOUBLE, {w}::DOUBLE, {h}::DOUBLE, {hero})" for t, k, side, (x, y, w, h), hero in SEATS)
_ORDERS_SQL = ", ".join(f"({n}, {list(p)})" for n in range(1, 5) for p in itertools.permutations(range(n)))
_G = SPEC.gutter / SPEC.page_w


@query(f"""WITH seats(template, slot, side, x, y, w, h, hero) AS (SELECT * FROM (VALUES {_SEATS_SQL}) v(a, b, c, d, e, f, g, i)),
  orders_of(n, o) AS (SELECT * FROM (VALUES {_ORDERS_SQL}) v(a, b)),
  l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n, (2000 + 500 * (l_partkey % 7))::DOUBLE AS pw, (2000 + 500 * (l_suppkey % 5))::DOUBLE AS ph,
    CASE WHEN l_linenumber % 3 > 0 THEN (l_linenumber % 3) * 0.4::DOUBLE END AS q, l_quantity::INT % 2 = 0 AS sal, (l_partkey % 5) / 10.0::DOUBLE AS sx, (l_suppkey % 4) / 10.0::DOUBLE AS sy, (l_partkey % 4) / 4.0::DOUBLE AS fx, l_quantity::INT * 2 AS score,
    [l_linestatus, l_returnflag] AS tags, CASE WHEN l_partkey % 6 > 0 THEN (l_partkey % 100) * 60 END AS at, l_suppkey % 2 AS event FROM lineitem),
  p AS (SELECT *, max(score) OVER (PARTITION BY k) AS best FROM l WHERE n <= 4),
  t AS (SELECT *, count(*) OVER (PARTITION BY template) AS n, row_number() OVER (PARTITION BY template ORDER BY side <> 'left', x, y, slot) AS rp, max(w * h) OVER (PARTITION BY template) AS large FROM seats),
  c AS (SELECT p.k, p.i, template, slot, side, x, y, w, h, hero, pw, q, sal, sx, sy, score, best, pw / ph AS a, w * 11.0::DOUBLE / (h * 8.5::DOUBLE) AS tgt, fx FROM p JOIN t USING (n)),
  d AS (SELECT *, CASE WHEN a > tgt THEN tgt / a ELSE 1.0::DOUBLE END AS cw, CASE WHEN a > tgt THEN 1.0::DOUBLE ELSE a / tgt END AS ch FROM c),
  e AS (SELECT *, greatest(0.0::DOUBLE, least(1 - cw, fx - cw / 2)) AS cx, greatest(0.0::DOUBLE, least(1 - ch, 0.5::DOUBLE - ch / 2)) AS cy, pw * cw / (w * 11.0::DOUBLE) AS dpi FROM d),
  f AS (SELECT *, greatest(sx, cx) AS ix, greatest(sy, cy) AS iy, least(sx + 0.3::DOUBLE, cx + cw) - greatest(sx, cx) AS iw, least(sy + 0.4::DOUBLE, cy + ch) - greatest(sy, cy) AS ih FROM e),
  m AS (SELECT *, x + (ix - cx) * (w / cw) AS mx, y + (iy - cy) * (h / ch) AS my, iw * (w / cw) AS mw, ih * (h / ch) AS mh FROM f),
  z AS (SELECT k, i, template, slot, CASE WHEN dpi >= {SPEC.min_dpi} THEN least(tgt, a) / greatest(tgt, a)
      + CASE WHEN sal THEN CASE WHEN iw > 0 AND ih > 0 THEN iw * ih ELSE 0.0::DOUBLE END / (0.3::DOUBLE * 0.4::DOUBLE) ELSE 0.5::DOUBLE END + 0.5::DOUBLE + coalesce(q, 0.5::DOUBLE)
      + CASE WHEN hero AND best > 0 THEN score::DOUBLE / best ELSE 0.5::DOUBLE END + greatest(0.0::DOUBLE, least(1.0::DOUBLE, (dpi - {SPEC.min_dpi}) / ({SPEC.warn_dpi} - {SPEC.min_dpi}::DOUBLE)))
      + CASE WHEN sal AND iw > 0 AND ih > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - greatest(0.0::DOUBLE, CASE WHEN side = 'left' THEN least(mx + mw, {1.0 - _G + _G}::DOUBLE) - greatest(mx, {1.0 - _G}::DOUBLE) ELSE least(mx + mw, {_G}::DOUBLE) - greatest(mx, 0.0::DOUBLE) END)
        * greatest(0.0::DOUBLE, least(my + mh, 1.0::DOUBLE) - greatest(my, 0.0::DOUBLE)) / (mw * mh))) ELSE 1.0::DOUBLE END END AS s FROM m),
  pair AS (SELECT a.k, a.i, b.i AS j, (1 - len(list_intersect(a.tags, b.tags))::DOUBLE / len(list_distinct(list_concat(a.tags, b.tags))) + 0.5::DOUBLE + CASE WHEN a.at IS NULL OR b.at IS NULL THEN 0.5::DOUBLE ELSE least(1.0::DOUBLE, abs(a.at - b.at) / 3600.0::DOUBLE) END) / 3.0::DOUBLE AS far FROM p a JOIN p b ON a.k = b.k AND a.i < b.i),
  far AS (SELECT k, list_reduce(list_prepend(0.0::DOUBLE, list(far ORDER BY i, j)), lambda a, b: a + b) / count(*) AS far FROM pair GROUP BY k),
  g AS (SELECT k, max(n) AS n, CASE WHEN max(n) < 2 THEN 0 ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, (max(score) - (sum(score) - max(score))::DOUBLE / (max(n) - 1)) / 100.0::DOUBLE)) END AS stand FROM p GROUP BY k),
  v AS (SELECT template, list_reduce(list_prepend(0.0::DOUBLE, list(w * h ORDER BY slot)), lambda a, b: a + b) AS whole, list_reduce(list_prepend(0.0::DOUBLE, list(CASE WHEN hero THEN w * h ELSE 0.0::DOUBLE END ORDER BY slot)), lambda a, b: a + b) AS hero, count(*) AS n FROM seats GROUP BY template),
  whole AS (SELECT g.k, v.template, coalesce(far, 0.5::DOUBLE) AS far, CASE WHEN stand = 0 THEN 0.5::DOUBLE ELSE 0.5::DOUBLE + 0.5::DOUBLE * stand * greatest(0.0::DOUBLE, least(1.0::DOUBLE, (hero / whole - 1.0::DOUBLE / v.n) / (1.0::DOUBLE - 1.0::DOUBLE / v.n))) END AS hero, CASE WHEN g.k % 5 = 0 AND template = 'a' || g.n THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS other FROM g JOIN v USING (n) LEFT JOIN far USING (k)),
  x AS (SELECT p.k, t.template, o, list(z.s ORDER BY t.slot) AS each, max(CASE WHEN p.i = 0 AND (rp = 1 OR w * h = large) THEN 1 ELSE 0 END) AS lead_, max(CASE WHEN p.i = t.n - 1 AND rp = t.n THEN 1 ELSE 0 END) AS tail_, min(CASE WHEN w * h = large THEN rp END) AS first_large, max(CASE WHEN p.i = 0 THEN rp END) AS lead_at, t.n AS n,
      list({{'e': p.event, 'a': p.at}} ORDER BY rp) AS read FROM t JOIN orders_of USING (n) JOIN p ON p.n = t.n AND p.i = o[t.slot + 1] JOIN z ON z.k = p.k AND z.i = p.i AND z.template = t.template AND z.slot = t.slot GROUP BY p.k, t.template, o, t.n),
  y AS (SELECT x.k, x.template, o, list_reduce(list_prepend(0.0::DOUBLE, each), lambda a, b: a + b) + 0.5::DOUBLE + far + hero + other AS score,
      len(list_filter(range(1, x.n + 1), lambda i: len(list_filter(range(i + 1, x.n + 1), lambda j: read[i].e <> read[j].e AND coalesce(read[j].a < read[i].a, FALSE))) > 0)) = 0 AS in_time,
      x.k % 3 = 0 OR lead_at = 1 OR lead_at = first_large AS leads, x.k % 4 = 0 OR tail_ = 1 AS ends FROM x JOIN whole ON whole.k = x.k AND whole.template = x.template WHERE len(list_filter(each, lambda s: s IS NULL)) = 0),
  w AS (SELECT *, rank() OVER (PARTITION BY k ORDER BY in_time DESC, leads DESC, ends DESC, score DESC) AS place FROM y),
  u AS (SELECT k, round(any_value(score), 6) AS score, count(*) AS tied, list({{'t': template, 'o': o}} ORDER BY template, o) AS ties, (k::UHUGEINT * 7919 + {layouts.STEP}::UHUGEINT) % 18446744073709551616::UHUGEINT AS s0 FROM w WHERE place = 1 GROUP BY k),
  s AS (SELECT *, (xor(s0, s0 >> 30) * {layouts.MIX_A}::UHUGEINT) % 18446744073709551616::UHUGEINT AS s1 FROM u),
  s2 AS (SELECT *, (xor(s1, s1 >> 27) * {layouts.MIX_B}::UHUGEINT) % 18446744073709551616::UHUGEINT AS s2 FROM s)
  SELECT k AS l_orderkey, ties[(xor(s2, s2 >> 31) % tied::UHUGEINT)::INT + 1].t AS template, array_to_string(ties[(xor(s2, s2 >> 31) % tied::UHUGEINT)::INT + 1].o, ',') AS seats, score, tied FROM s2""")
def best_spread(spark, sf_dir):
    """The best template and assignment of the pictures of each small order, with the story's order first."""
    m = lambda c, n: F.col(c) % n
    box = lambda x, y, w, h: F.struct(*[v.cast("double").alias(c) for c, v in zip("xywh", (x, y, w, h), strict=True)])

    def picture(l: Column) -> Column:
        of = lambda c, n: l[c] % n
        fields = {
            "width": (2000 + 500 * of("l_partkey", 7)).cast("double"),
            "height": (2000 + 500 * of("l_suppkey", 5)).cast("double"),
            "faces": F.array().cast("array<struct<x:double,y:double,w:double,h:double>>"),
            "quality": F.when(of("l_linenumber", 3) > 0, of("l_linenumber", 3) * F.lit(0.4)),
            "salient": F.when(l["l_quantity"].cast("int") % 2 == 0, box(of("l_partkey", 5) / 10, of("l_suppkey", 4) / 10, F.lit(0.3), F.lit(0.4))),
            "focus_x": of("l_partkey", 4) / 4,
            "focus_y": F.lit(0.5),
            "score": l["l_quantity"].cast("int") * 2,
            "tags": F.array(l["l_linestatus"], l["l_returnflag"]),
            "colour": F.lit(None).cast("struct<r:double,g:double,b:double>"),  # sines differ in their last bits, and exact ties count
            "at": F.when(of("l_partkey", 6) > 0, of("l_partkey", 100) * 60),
            "event": of("l_suppkey", 2),
        }
        return F.struct(*[c.alias(n) for n, c in fields.items()])

    lines = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_linestatus", "l_returnflag")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("group")).agg(F.sort_array(F.collect_list(lines)).alias("all"))
    rows = rows.where(F.size("all") <= 4).withColumn("pictures", F.transform("all", picture))
    n = F.size("pictures")
    groups = rows.select("group", "pictures", F.when(m("group", 5) == 0, F.concat(F.lit("a"), n.cast("string"))).alias("previous"), (F.col("group") * 7919).alias("seed"), F.when(m("group", 3) > 0, F.lit(0)).alias("lead"), F.when(m("group", 4) > 0, n - 1).alias("tail"))
    slots = spark.createDataFrame(SEATS, "template string, slot int, side string, rect struct<x:double,y:double,w:double,h:double>, hero boolean")
    found = layouts.best_layouts(groups, slots, SPEC)
    return found.select(F.col("group").alias("l_orderkey"), "template", F.concat_ws(",", F.transform("assignment", lambda x: x.cast("string"))).alias("seats"), F.round("score", 6).alias("score"), F.col("tied").cast("long").alias("tied"))


@query(f"""WITH RECURSIVE a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, CASE WHEN event_id % 7 < 4 THEN 'commit' WHEN event_id % 7 < 6 THEN 'undo' ELSE 'redo' END AS action FROM events),
  c AS (SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS seq, NULL::BIGINT AS low, NULL::BIGINT AS high FROM (SELECT DISTINCT user_id FROM events) UNION ALL
    SELECT a.user_id, a.k, CASE WHEN action = 'commit' THEN coalesce(seq, 0) + 1 WHEN action = 'undo' AND seq > low THEN seq - 1 WHEN action = 'redo' AND seq < high THEN seq + 1 ELSE seq END,
      CASE WHEN action = 'commit' THEN greatest(coalesce(low, 0), coalesce(seq, 0) + 2 - {LEDGER_CAP}) ELSE low END, CASE WHEN action = 'commit' THEN coalesce(seq, 0) + 1 ELSE high END
    FROM c JOIN a ON a.user_id = c.user_id AND a.k = c.k + 1),
  e AS (SELECT user_id, arg_max(seq, k) FILTER (WHERE seq IS NOT NULL) AS seq, max(low) AS low, arg_max(high, k) FILTER (WHERE high IS NOT NULL) AS high FROM c GROUP BY 1),
  s AS (SELECT a.user_id, seq, arg_max(event_id::VARCHAR, a.k) AS label FROM a JOIN c ON c.user_id = a.user_id AND c.k = a.k WHERE action = 'commit' GROUP BY 1, 2 UNION ALL SELECT user_id, 0, '' FROM e WHERE seq IS NOT NULL),
  v AS (SELECT s.* FROM s JOIN e ON e.user_id = s.user_id WHERE s.seq BETWEEN e.low AND e.high)
  SELECT e.user_id, e.seq, e.low, e.high, CASE WHEN b.label IS NOT NULL THEN n.label END AS undo, f.label AS redo FROM e LEFT JOIN v n ON n.user_id = e.user_id AND n.seq = e.seq
    LEFT JOIN v b ON b.user_id = e.user_id AND b.seq = e.seq - 1 LEFT JOIN v f ON f.user_id = e.user_id AND f.seq = e.seq + 1""")
def ledger_status(spark, sf_dir):
    """What undo and redo offer each user, when events are commits, undos and redos."""
    kind = F.when(F.col("event_id") % 7 < 4, ledger.COMMIT).when(F.col("event_id") % 7 < 6, ledger.UNDO).otherwise(ledger.REDO)
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", kind.alias("action"), F.col("event_id").cast("string").alias("label"))
    replay = written(ledger.replayed(rows, "user_id", ["ts", "event_id"], "action", LEDGER_CAP), "replay")
    ends, states = ledger.timelines(replay, "user_id", ["ts", "event_id"], "action", "label")
    return ledger.status(ends, states, "user_id")


@query("""WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS deleted_at FROM orders),
  l AS (SELECT l_orderkey, count(*) AS n, sum(row_number) AS places FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) - 1 AS row_number FROM lineitem) GROUP BY 1)
  SELECT o_orderkey, deleted_at, n AS photos, CAST(places AS BIGINT) AS places FROM p LEFT JOIN l ON l_orderkey = o_orderkey WHERE deleted_at IS NULL OR deleted_at > 700""")
def project_purge(spark, sf_dir):
    """Orders as projects with their lines as photos: saved in one snapshot, and those deleted long ago purged in the next."""
    store = snapshots.Snapshots(spark, f"{shared_dir(spark)}/projects-{uuid.uuid4().hex}")
    projects = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("project"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).alias("deleted_at"))
    photos = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("project"), "l_partkey", "l_suppkey", "l_linenumber")
    store.commit({"projects": projects, "photos": snapshots.positioned(photos, ["project"], [F.col(c) for c in ("l_partkey", "l_suppkey", "l_linenumber")])})
    number = snapshots.purge(store, ["photos"], "projects", "project", "deleted_at", F.lit(700))
    counts = store.read("photos", number).groupBy(F.col("project").alias("_p")).agg(F.count("*").alias("photos"), F.sum("position").alias("places"))
    return store.read("projects", number).join(counts, F.col("project") == F.col("_p"), "left").select(F.col("project").alias("o_orderkey"), "deleted_at", "photos", "places")


@query("""SELECT '/f/' || o_orderkey AS path, CASE WHEN NOT known AND o_orderkey % 11 = 0 THEN NULL ELSE 'h' || CASE WHEN known THEN o_custkey ELSE o_custkey + 1 END END AS hash,
    CASE WHEN NOT known AND o_orderkey % 11 = 0 THEN 'failed' WHEN (CASE WHEN known THEN o_custkey ELSE o_custkey + 1 END) % 4 < 2 AND (CASE WHEN known THEN o_custkey ELSE o_custkey + 1 END) % 16 <> 1
      AND (CASE WHEN known THEN o_custkey ELSE o_custkey + 1 END) IN (SELECT c_custkey FROM customer) THEN 'hit' ELSE 'miss' END AS state, NOT known AND o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0 AS restamp
  FROM (SELECT *, o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AS known FROM orders)""")
def cache_lookup(spark, sf_dir):
    """Orders as files: stamps known for a third (some changed, some files unstamped), records known for half of the customers' hashes."""
    orders = table(spark, sf_dir, "orders")
    name, m = F.concat(F.lit("/f/"), F.col("o_orderkey").cast("string")), lambda n: F.col("o_orderkey") % n
    files = orders.select(name.alias("path"), F.when(m(7) != 0, F.col("o_custkey")).alias("size"), F.col("o_orderkey").alias("modified"))
    stamps = orders.where(m(3) == 0).select(name.alias("path"), F.col("o_custkey").alias("size"), (F.col("o_orderkey") - F.when(m(5) == 0, 1).otherwise(0)).alias("modified"), F.concat(F.lit("h"), F.col("o_custkey").cast("string")).alias("hash"))
    new = F.when(m(11) != 0, F.concat(F.lit("h"), (F.col("o_custkey") + 1).cast("string")))
    content = orders.select(name.alias("_p"), new.alias("hash"), F.when(m(11) == 0, "denied").alias("error"))
    records = table(spark, sf_dir, "customer").where("c_custkey % 4 < 2").select(F.concat(F.lit("h"), F.col("c_custkey").cast("string")).alias("hash"), (F.col("c_custkey") % 16 != 1).alias("whole"))
    found = cache.looked_up(files, stamps, records, lambda unread: unread.join(content, F.col("path") == F.col("_p")).select("path", "hash", "error"), F.col("whole"))
    return found.select("path", "hash", "state", "restamp")


@query("""WITH r AS (SELECT c_custkey AS h, c_custkey % 1000 AS b, c_custkey * 7919 % 10007 AS u, c_custkey % 9 > 0 AS cur FROM customer), t AS (SELECT CASE WHEN c_custkey % 6 = 0 THEN c_custkey + 1000000 ELSE c_custkey END AS h, 500 + c_custkey % 7 AS b FROM customer WHERE c_custkey % 2 = 0),
  p AS (SELECT DISTINCT CASE WHEN c_custkey % 4 = 0 THEN c_custkey + 1000000 ELSE c_custkey END AS h FROM customer WHERE c_custkey % 13 = 0),
  e AS (SELECT coalesce(r.h, t.h) AS h, coalesce(r.b, 0) + coalesce(t.b, 0) AS b, coalesce(u, 0) AS u, p.h IS NOT NULL AS pin, r.h IS NULL AND p.h IS NULL AS orphan FROM (SELECT * FROM r WHERE cur) r FULL JOIN t ON r.h = t.h LEFT JOIN p ON p.h = coalesce(r.h, t.h)),
  k AS (SELECT *, (SELECT sum(b) FROM e WHERE NOT orphan) - sum(CASE WHEN pin THEN 0 ELSE b END) OVER (ORDER BY pin, u, h) + b > 200000 AS over FROM e WHERE NOT orphan)
  SELECT h AS hash, b AS bytes, CASE WHEN over AND NOT pin THEN 'evicted' ELSE 'kept' END AS outcome FROM k UNION ALL SELECT h, b, 'orphan' FROM e WHERE orphan UNION ALL SELECT h, b, 'stale' FROM r WHERE NOT cur""")
def cache_enforce(spark, sf_dir):
    """Customers as cached rows with thumbnails, kept to a size."""
    key, m = F.col("c_custkey"), lambda n: F.col("c_custkey") % n
    rows = table(spark, sf_dir, "customer").select("c_custkey")
    cached = rows.select(key.alias("hash"), m(1000).alias("bytes"), (key * 7919 % 10007).alias("last_used"), F.when(m(9) > 0, 2).otherwise(1).alias("version"))
    moved = lambda n: F.when(m(n) == 0, key + 1_000_000).otherwise(key)
    thumbs, pinned = rows.where(m(2) == 0).select(moved(6).alias("hash"), (500 + m(7)).alias("bytes")), rows.where(m(13) == 0).select(moved(4).alias("hash"))
    return cache.enforced(cached, thumbs, pinned, 2, 200_000)
