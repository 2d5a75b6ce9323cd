"""Order and pace within chapters: shot roles, openers and closers, anchors, repeated layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import calm_score

#: Scene tags by what they say of a picture.
ESTABLISHING = (
    "land", "hill", "mountain", "water_body", "iceberg", "waterfall", "aurora", "glacier", "lake", "ocean", "cliff",
    "forest", "rainbow", "sunset_sunrise", "skyscraper", "haze", "beach", "shore", "coast", "desert", "canyon",
    "valley", "cityscape", "skyline", "volcano", "field",
)
PEOPLE = (
    "people", "adult", "child", "crowd",
)
DETAIL = (
    "food", "utensil", "tableware", "plate", "bowl", "drink", "drinking_glass", "baked_goods", "dessert", "bread",
    "fruit", "vegetable", "berry", "mushroom", "flower", "petunia", "moss", "spiderweb", "spider", "insect",
    "dragonfly", "arthropods", "arachnid", "sign", "billboards", "document", "art", "statue", "figurine", "toy",
    "stuffed_animals", "decoration", "bonsai", "decorative_plant", "seasonings", "herb", "spoon",
)
FACE_AREA, LEAST_FACE_AREA = 0.02, 0.005
#: Rows that a chapter needs before its order is changed.
LEAST_RUN = 4


def has_any(tags: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(F.arrays_overlap(tags, F.array(*[F.lit(n) for n in names])), F.lit(False))


def shot_role(faces: Column, face_area: Column, tags: Column) -> Column:
    """people, detail, establishing or moment; in that order where several fit, but a wide view is no detail."""
    near = (face_area >= FACE_AREA) | ((face_area >= LEAST_FACE_AREA) & has_any(tags, PEOPLE))
    wide = has_any(tags, ESTABLISHING)
    return F.when((faces > 0) & near, "people").when(has_any(tags, DETAIL) & ~wide, "detail").when(wide, "establishing").otherwise("moment")


def calm(role: Column, warmth: Column, clipped_low: Column, clipped_high: Column) -> Column:
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return calm_score(role == "establishing", unit(F.coalesce(warmth, F.lit(0.5))), unit(clipped_low + clipped_high))


def sequenced(df: DataFrame, keys: list[str], pos: str, role: str, score: str, calm: str, name: str = "seat") -> DataFrame:
    """``seat`` from 0 within each chapter of rows at ``pos`` 0, 1, ...

    In a chapter of four rows or more the best establishing shot of the first half
    opens it, and then the calmest row of the last two fifths closes it; ties go to
    the earlier opener and the later closer.  Two windows choose the rows.
    """
    group = W.partitionBy(*keys)
    n = F.count("*").over(group)
    rows = df.withColumn("_n", n)
    fits = (F.col("_n") >= LEAST_RUN) & (F.col(pos) < F.ceil(F.col("_n") / 2)) & (F.col(role) == "establishing")
    opener = F.max(F.when(fits, F.struct(F.col(score), (-F.col(pos)).alias("p"), F.col(pos).alias("at")))).over(group)["at"]
    rows = rows.withColumn("_open", opener)
    # the opener moves to the front, those before it one back
    now = F.when(F.col("_open").isNull() | (F.col(pos) > F.col("_open")), F.col(pos)).when(F.col(pos) == F.col("_open"), 0).otherwise(F.col(pos) + 1)
    rows = rows.withColumn("_now", now)
    late = (F.col("_n") >= LEAST_RUN) & (F.col("_now") >= F.col("_n") - F.ceil(F.col("_n") * 2 / 5))
    closer = F.max(F.when(late, F.struct(F.col(calm), F.col("_now").alias("at")))).over(group)["at"]
    rows = rows.withColumn("_close", closer)
    seat = F.when(F.col("_close").isNull() | (F.col("_now") < F.col("_close")), F.col("_now")).when(F.col("_now") == F.col("_close"), F.col("_n") - 1).otherwise(F.col("_now") - 1)
    return rows.withColumn(name, seat.cast("int")).drop("_n", "_open", "_now", "_close")


def anchors(df: DataFrame, keys: list[str], seat: str) -> DataFrame:
    """``lead`` and ``tail``: the ends of chapters of four rows or more."""
    n = F.count("*").over(W.partitionBy(*keys))
    return df.withColumn("lead", (n >= LEAST_RUN) & (F.col(seat) == 0)).withColumn("tail", (n >= LEAST_RUN) & (F.col(seat) == n - 1))


def strongest(df: DataFrame, keys: list[str], order: list[Column], capacity: int, keep: Column) -> DataFrame:
    """The rows that fit: those to ``keep`` first, then the best; ``order`` ends in a unique column."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy((~keep).cast("int"), *order))
    return df.withColumn("_place", place).where(F.col("_place") <= capacity).drop("_place")


def same_three(df: DataFrame, keys: list[str], pos: str, value: str) -> DataFrame:
    """``repeats``: whether a row and its two neighbours have one value (three openings of one look)."""
    order = W.partitionBy(*keys).orderBy(pos)
    before, after = F.lag(value).over(order), F.lead(value).over(order)
    return df.withColumn("repeats", F.coalesce((F.col(value) == before) & (F.col(value) == after), F.lit(False)))


def active_header(df: DataFrame, keys: list[str], pos: str, header: str) -> DataFrame:
    """``active``: the last header at or before each row."""
    up_to = W.partitionBy(*keys).orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("active", F.last(header, ignorenulls=True).over(up_to))


def event_title(name: Column, low: Column, high: Column, number: Column) -> Column:
    """A chapter's name, else its days, else its number."""
    from ..functions.scalar import date_range, first_name

    return F.coalesce(first_name(name), date_range(low, high), F.concat(F.lit("Event "), number.cast("string")))


def harmony(df: DataFrame, keys: list[str], r: str, b: str) -> DataFrame:
    """How closely a group's main colours point one way (0 to 1); 0.5 for fewer than two."""
    hue = F.atan2(F.col(b), F.col(r))
    n = F.count(F.when(F.col(r).isNotNull() & F.col(b).isNotNull(), 1))
    length = F.hypot(F.sum(F.cos(hue)) / n, F.sum(F.sin(hue)) / n)
    return df.groupBy(*keys).agg(F.when(n < 2, F.lit(0.5)).otherwise(F.least(F.lit(1.0), length)).alias("harmony"))


def focus(faces: Column, saliency: Column) -> Column:
    """The weighted centre of faces (3 * area * (0.5 + quality)) and of the salient box (area); the middle without either.

    ``faces`` is an array of structs with ``box`` (x, y, w, h) and ``quality``.
    """
    box_area = lambda b: F.greatest(F.lit(1e-6), F.when((b["w"] > 0) & (b["h"] > 0), b["w"] * b["h"]).otherwise(F.lit(0.0)))
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(0.5))))
    point = lambda w, b: F.struct(w.alias("w"), (b["x"] + b["w"] / 2).alias("x"), (b["y"] + b["h"] / 2).alias("y"))
    points = F.transform(F.coalesce(faces, F.array().cast("array<struct<box:struct<x:double,y:double,w:double,h:double>,quality:double>>")), lambda f: point(3.0 * box_area(f["box"]) * (0.5 + unit(f["quality"])), f["box"]))
    points = F.when(saliency.isNull(), points).otherwise(F.concat(points, F.array(point(box_area(saliency), saliency))))
    total = F.aggregate(points, F.lit(0.0), lambda s, p: s + p["w"])
    mean = lambda axis: F.when(total > 0, F.aggregate(points, F.lit(0.0), lambda s, p: s + p["w"] * p[axis]) / total).otherwise(F.lit(0.5))
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))
