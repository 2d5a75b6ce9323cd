"""Layout choice: the best assignment of a group's pictures to a template's slots, in DataFrame functions only.

A group and a template of as many slots give a table of picture by slot scores,
which is null where a hard rule forbids the placement.  A score is a row of its
own until the table is gathered, so that Spark compiles it.  Every permutation of
the pictures is one sum over that table; the story's order is compared first, then
the score, and exact ties are broken by a seeded draw.  A group has at most
``MOST`` pictures, so a table has at most 36 scores and 720 permutations, whose
reading orders are worked out once for each template.
"""

from __future__ import annotations

import itertools
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import printing as pr
from ..functions import scalar as sc

#: Most pictures of a group.
MOST = 6
#: The constants of the seeded draw.
STEP, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
LOW32 = 0xFFFFFFFF
#: Slots of all templates up to which they are broadcast.
FEW = 10_000


@dataclass(frozen=True)
class Weights:
    """Weights of the terms of a score."""

    aspect_fit: float = 1.0
    saliency_retention: float = 1.0
    face_area_retention: float = 1.0
    face_quality: float = 1.0
    hero_match: float = 1.0
    resolution_headroom: float = 1.0
    gutter_saliency: float = 1.0
    palette_harmony: float = 1.0
    spread_diversity: float = 1.0
    hero_prominence: float = 1.0
    variety: float = 1.0


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def wrapping_add(a: Column, b: Column) -> Column:
    """The sum of two longs modulo 2^64, where ``+`` would stop at an overflow."""
    low = a.bitwiseAND(LOW32) + b.bitwiseAND(LOW32)
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(LOW32))


def wrapping_mul(a: Column, constant: int) -> Column:
    """A long times an unsigned constant modulo 2^64, by digits of 16 bits, so no product overflows.

    ``a`` is read ten times, so callers give a name, not an expression.
    """
    digit = [F.shiftrightunsigned(a, 16 * k).bitwiseAND(0xFFFF) for k in range(4)]
    place = lambda k: reduce(lambda x, y: x + y, [digit[i] * F.lit(constant >> 16 * (k - i) & 0xFFFF).cast("long") for i in range(k + 1)])
    high = lambda low: place(2) + F.shiftleft(place(3), 16) + F.shiftrightunsigned(low, 32)
    return sc.once(place(0) + F.shiftleft(place(1), 16), lambda low: F.shiftleft(high(low), 32).bitwiseOR(low.bitwiseAND(LOW32)))


def tie_break(seed: Column, n: Column) -> Column:
    """A number from 0 to ``n`` - 1 that follows from the seed alone; 0 where ``n`` is 0."""
    mixed = lambda z, by: F.shiftrightunsigned(z, by).bitwiseXOR(z)
    times = lambda z, by, constant: sc.once(mixed(z, by), lambda x: wrapping_mul(x, constant))
    first = wrapping_add(seed.cast("long"), F.lit(_signed(STEP)))
    last = sc.once(sc.once(first, lambda z: times(z, 30, MIX_A)), lambda z: times(z, 27, MIX_B))
    unsigned = lambda z, m: (F.shiftrightunsigned(z, 32) % m * (F.lit(1 << 32) % m) + z.bitwiseAND(LOW32) % m) % m
    drawn = lambda m: F.when(m > 0, sc.once(last, lambda z: sc.once(mixed(z, 31), lambda x: unsigned(x, m)))).otherwise(F.lit(0).cast("long"))
    return sc.once(n.cast("long"), drawn)


def pair_distance(a: Column, b: Column) -> Column:
    """How unlike two pictures are, 0 to 1: the mean distance of tags, main colour and time."""
    return (sc.tag_distance(a["tags"], b["tags"]) + geo.colour_distance(a["colour"], b["colour"]) + geo.gap_distance(a["at"], b["at"])) / 3.0


def spread_diversity(pictures: Column) -> Column:
    """The mean distance of all pairs of an array of pictures (tags, colour, at); 0.5 for fewer than two."""
    n = F.size(pictures)
    later = lambda i: F.slice(pictures, i + 2, n)
    each = F.flatten(F.transform(pictures, lambda a, i: F.transform(later(i), lambda b: pair_distance(a, b))))
    mean = sc.once(each, lambda x: F.aggregate(x, F.lit(0.0), lambda s, d: s + d) / F.size(x))
    return F.when(n < 2, F.lit(0.5)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean)))


def palette_harmony(pictures: Column) -> Column:
    """How closely the main colours point one way, 0 to 1; 0.5 for fewer than two colours."""
    hues = F.transform(F.filter(pictures, lambda p: p["colour"].isNotNull()), lambda p: F.atan2(p["colour"]["b"], p["colour"]["r"]))
    total = lambda h, f: F.aggregate(F.transform(h, f), F.lit(0.0), lambda s, x: s + x) / F.size(h)
    return sc.once(hues, lambda h: F.when(F.size(h) < 2, F.lit(0.5)).otherwise(F.least(F.lit(1.0), F.hypot(total(h, F.cos), total(h, F.sin)))))


def _unit(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def standout(scores: Column) -> Column:
    """How far the best of an array of percentiles stands out, 0 to 1."""
    n, best = F.size(scores), F.array_max(scores).cast("double")
    total = F.aggregate(F.transform(scores, lambda s: s.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when(n >= 2, _unit((best - (total - best) / (n - 1)) / 100.0))


def dominance(areas: Column, heroes: Column) -> Column:
    """How much more than an even share of the room a template gives its hero, 0 to 1; null without any room."""
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    total, hero, even = add(areas), add(F.zip_with(areas, heroes, lambda a, h: F.when(h, a).otherwise(F.lit(0.0)))), 1.0 / F.size(areas)
    return F.when((F.size(areas) > 1) & (total > 0), _unit((hero / total - even) / (1.0 - even)))


def hero_prominence(stands: Column, room: Column) -> Column:
    """Whether a template gives its hero as much room (``dominance``) as the best picture stands out (``standout``); 0.5 is neutral."""
    return F.when(stands.isNull() | (stands == 0) | room.isNull(), F.lit(0.5)).otherwise(_unit(0.5 + 0.5 * stands * room))


def placement_score(spec: pr.PrintSpec, p: Column, c: Column, page: Column, whole: Column, seen: Column, slot: Column, side: Column, hero: Column, best: Column, w: Weights) -> Column:
    """The score of a picture in a slot, null where a hard rule rejects it.

    ``p`` has width, height, faces (array of boxes), quality, salient (a box or
    null) and score; ``c`` is its crop, ``page`` its visible salient box on the
    page, ``whole`` and ``seen`` the area of its faces and what is visible of it.
    Callers give these four as columns, which are computed once.
    """
    terms = [
        w.aspect_fit * geo.aspect_fit(pr.slot_aspect(spec, slot), p["width"] / p["height"]),
        w.saliency_retention * geo.retention(c, p["salient"]),
        w.face_area_retention * F.when(whole > 0, seen / whole).otherwise(F.lit(0.5)),
        w.face_quality * pr.face_quality(p["quality"]),
        w.hero_match * pr.hero_match(p["score"], best, hero),
        w.resolution_headroom * geo.headroom(pr.dpi(spec, p["width"], c, slot), spec.min_dpi, spec.warn_dpi),
        w.gutter_saliency * pr.fold_free(spec, page, side),
    ]
    return F.when(pr.rejects(spec, p["width"], p["faces"], c, slot, side).isNull(), reduce(lambda a, b: a + b, terms))


def permutations(spark: SparkSession, most: int = MOST) -> DataFrame:
    """``n`` and ``orders``: all permutations of 0 to n - 1 in lexicographic order, for n up to ``most``."""
    return spark.createDataFrame([(n, [list(p) for p in itertools.permutations(range(n))]) for n in range(1, most + 1)], "n int, orders array<array<int>>")


def _laid_out(slots: DataFrame) -> DataFrame:
    """Templates of up to ``MOST`` slots: ``template``, ``n``, ``slots`` in their order, ``room`` of the hero and ``orders``.

    An order has what can be told without the pictures: ``cells`` (places of its
    scores in a table of ``MOST`` slots a picture), the pictures that are read
    first and last or are in the largest slot, and ``read``, a bit for each two
    pictures of which one is read before the other.
    """
    reading = F.transform(F.sort_array(F.collect_list(F.struct((F.col("side") != "left").alias("right"), F.col("rect.x").alias("x"), F.col("rect.y").alias("y"), "slot"))), lambda s: s["slot"])
    found = slots.groupBy("template").agg(F.count("*").cast("int").alias("n"), F.sort_array(F.collect_list(F.struct("slot", "side", "rect", "hero"))).alias("slots"), reading.alias("reading"))
    found = found.withColumn("areas", F.transform("slots", lambda s: geo.area(s["rect"]))).withColumn("large", F.array_max("areas"))
    found = found.withColumn("large", F.element_at(F.filter("reading", lambda s: F.get("areas", s) >= F.col("large")), 1))
    found = found.join(F.broadcast(permutations(slots.sparkSession)), "n")  # one row for each size

    def told(order: Column) -> Column:
        read = F.transform("reading", lambda s: F.get(order, s))
        later = lambda r, i: F.slice(r, i + 2, F.size(r))
        bits = sc.once(read, lambda r: _all_bits(F.flatten(F.transform(r, lambda p, i: F.transform(later(r, i), lambda q: _bit(p, q))))))
        cells = F.transform(order, lambda p, i: p * MOST + i)
        return F.struct(order.alias("order"), cells.alias("cells"), F.get(read, F.lit(0)).alias("first"), F.get(order, F.col("large")).alias("largest"), F.element_at(read, -1).alias("last"), bits.alias("read"))

    room = dominance(F.col("areas"), F.transform("slots", lambda s: s["hero"]))
    return found.select("template", "n", "slots", room.alias("room"), F.transform("orders", told).alias("orders"))


def _bit(p: Column, q: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (p * MOST + q).cast("int"))


def _all_bits(bits: Column) -> Column:
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(b))


def best_layouts(groups: DataFrame, slots: DataFrame, spec: pr.PrintSpec, weights: Weights = Weights()) -> DataFrame:
    """The template and assignment of each group: ``group``, ``template``, ``assignment``, ``score``, ``tied``.

    ``groups`` has ``group``, ``pictures`` (array of structs: width, height, faces,
    quality, salient, focus_x, focus_y, score, tags, colour, at, event), ``previous``
    (template), ``seed``, and ``lead`` and ``tail``, places of pictures or null.
    ``slots`` has ``template``, ``slot`` (from 0), ``side``, ``rect`` and ``hero``.
    Place i of an assignment is the picture in slot i.  Assignments that keep the
    events in time come first, then those that read the lead first or give it the
    largest slot, then those that read the tail last, then the higher score.
    Groups that no template seats, and those of more than ``MOST`` pictures, have
    no row.
    """
    w = asdict(weights)
    few = slots.count() <= FEW
    side_of = lambda rows: F.broadcast(rows) if few else rows
    templates = _laid_out(slots)
    seats = templates.select("n", "template", "room", F.posexplode("slots").alias("place", "s")).select("n", "template", "room", "place", "s.side", "s.rect", "s.hero")
    # what concerns the group alone is computed once, before it meets the templates
    times = F.transform("pictures", lambda p: F.struct(p["event"].alias("event"), p["at"].alias("at")))
    early = lambda x, y: (x["event"] != y["event"]) & F.coalesce(y["at"] < x["at"], F.lit(False))
    marks = lambda test: sc.once(times, lambda each: _all_bits(F.flatten(F.transform(each, lambda x, i: F.transform(each, lambda y, j: F.when(test(early(x, y)), _bit(i, j)).otherwise(F.lit(0).cast("long")))))))
    scores = F.transform("pictures", lambda p: p["score"])
    alone = {
        "harmony": w["palette_harmony"] * palette_harmony(F.col("pictures")),
        "diversity": w["spread_diversity"] * spread_diversity(F.col("pictures")),
        "stands": standout(scores),
        "late": marks(lambda x: F.coalesce(x, F.lit(False))),
        "unknown": marks(lambda x: x.isNull()),
    }
    own = ["group", "seed", "lead", "tail", "previous", *alone]
    rows = groups.withColumn("n", F.size("pictures")).where(F.col("n") <= MOST)
    rows = rows.select("n", *own[:5], *[c.alias(k) for k, c in alone.items()], F.array_max(scores).alias("best"), F.posexplode("pictures").alias("who", "p"))
    # one row for each picture and slot, so scores are compiled; array functions would be interpreted
    used = ["width", "height", "faces", "quality", "salient", "focus_x", "focus_y", "score"]
    rows = rows.select("n", *own, "best", "who", *[F.col("p")[k].alias(f"p_{k}") for k in used])
    p, c, rect, side = {k: F.col(f"p_{k}") for k in used}, F.col("c"), F.col("rect"), F.col("side")
    cells = rows.join(side_of(seats), "n")
    # each of the three steps has a sum over faces: so Spark compiles it in short methods, the only ones that the JVM compiles in turn
    faces = lambda f: F.aggregate(p["faces"], F.lit(0.0), lambda s, face: s + f(face))
    crop = geo.choose_crop(p["width"], p["height"], pr.slot_aspect(spec, rect), p["focus_x"], p["focus_y"])
    cells = cells.select("*", crop.alias("c"), faces(geo.area).alias("whole"))
    cells = cells.select("*", geo.intersect(p["salient"], c).alias("visible"), faces(lambda f: geo.shared_area(f, c)).alias("seen"))
    variety = F.when(F.col("previous") == F.col("template"), 0.0).otherwise(1.0)
    score = placement_score(spec, p, c, F.col("page"), F.col("whole"), F.col("seen"), rect, side, F.col("hero"), F.col("best"), weights)
    cells = cells.withColumn("page", pr.in_page(F.col("visible"), c, rect))
    cells = cells.select(*own[:4], *alone, "template", "room", variety.alias("variety"), (F.col("who") * MOST + F.col("place")).alias("cell"), score.alias("score"))
    of_group = [F.first(k).alias(k) for k in ["seed", "lead", "tail", *alone, "room", "variety"]]
    tables = cells.groupBy("group", "template").agg(*of_group, *[F.max(F.when(F.col("cell") == k, F.col("score"))).alias(f"_{k}") for k in range(MOST * MOST)])
    terms = {"t0": F.col("harmony"), "t1": F.col("diversity"), "t2": w["hero_prominence"] * hero_prominence(F.col("stands"), F.col("room")), "t3": w["variety"] * F.col("variety")}
    given = F.struct(F.array(*[F.col(f"_{k}") for k in range(MOST * MOST)]).alias("table"), *[t.alias(k) for k, t in terms.items()], "late", "unknown", "lead", "tail")

    def key(g: Column, o: Column) -> Column:
        placed = F.aggregate(o["cells"], F.lit(0.0), lambda s, k: s + F.get(g["table"], k))
        score = reduce(lambda s, t: s + g[t], terms, placed)
        # a picture of another event that is read later was taken earlier
        in_time = F.when(g["late"].bitwiseAND(o["read"]) != 0, 4).when(g["unknown"].bitwiseAND(o["read"]) != 0, 0).otherwise(8)
        lead = F.when(g["lead"].isNull() | (g["lead"] == o["first"]) | (g["lead"] == o["largest"]), 2).otherwise(0)
        tail = F.when(g["tail"].isNull() | (g["tail"] == o["last"]), 1).otherwise(0)
        return F.when(score.isNotNull(), F.struct((in_time + lead + tail).alias("story"), score.alias("score")))

    tops = lambda keys, top: F.struct(top.alias("key"), F.transform(F.filter("orders", lambda o, i: F.get(keys, i) == top), lambda o: o["order"]).alias("orders"))
    best_of = sc.once(given, lambda g: sc.once(F.transform("orders", lambda o: key(g, o)), lambda keys: sc.once(F.array_max(keys), lambda top: tops(keys, top))))
    found = tables.join(side_of(templates.select(F.col("template").alias("_template"), "orders")), F.col("template") == F.col("_template"))
    found = found.select("group", "seed", F.struct("template", best_of.alias("best")).alias("found"))
    each = found.groupBy("group").agg(F.first("seed").alias("seed"), F.sort_array(F.collect_list("found")).alias("each"))
    tops = each.withColumn("key", F.array_max(F.transform("each", lambda e: e["best"]["key"]))).where("key IS NOT NULL")
    ties = F.flatten(F.transform(F.filter("each", lambda e: e["best"]["key"] == F.col("key")), lambda e: F.transform(e["best"]["orders"], lambda o: F.struct(e["template"].alias("template"), o.alias("assignment")))))
    tops = tops.select("group", "seed", F.col("key.score").alias("score"), ties.alias("ties"))
    chosen = F.get("ties", tie_break(F.col("seed"), F.size("ties")).cast("int"))
    tops = tops.select("group", chosen.alias("chosen"), "score", F.size("ties").alias("tied"))
    return tops.select("group", F.col("chosen.template").alias("template"), F.col("chosen.assignment").alias("assignment"), "score", "tied")
