"""Rectangles (x, y, w, h) in unit coordinates, crops and layout scores, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLACK = 1e-9


def rect(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), w.cast("double").alias("w"), h.cast("double").alias("h"))


def area(r: Column) -> Column:
    """Width times height, 0 where either isn't positive."""
    return F.when((r["w"] > 0) & (r["h"] > 0), r["w"] * r["h"]).otherwise(F.lit(0.0))


def contains(outer: Column, inner: Column) -> Column:
    return (
        (inner["x"] >= outer["x"] - SLACK)
        & (inner["y"] >= outer["y"] - SLACK)
        & (inner["x"] + inner["w"] <= outer["x"] + outer["w"] + SLACK)
        & (inner["y"] + inner["h"] <= outer["y"] + outer["h"] + SLACK)
    )


def intersect(a: Column, b: Column) -> Column:
    """The shared rectangle, null where there is none or a rectangle is unknown; least() and greatest() would pass over a null."""
    x, y = F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"])
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - x
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - y
    return F.when(a["x"].isNotNull() & b["x"].isNotNull() & (w > 0) & (h > 0), rect(x, y, w, h))


def shared_area(a: Column, b: Column) -> Column:
    return F.coalesce(area(intersect(a, b)), F.lit(0.0))


def in_frame(boxes: Column) -> Column:
    """Boxes cut to the unit frame; those outside go, those inside stay bit for bit."""
    unit = rect(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))
    inside = lambda b: (b["x"] >= 0) & (b["y"] >= 0) & (b["x"] + b["w"] <= 1) & (b["y"] + b["h"] <= 1)
    cut = F.transform(boxes, lambda b: F.when(inside(b), rect(b["x"], b["y"], b["w"], b["h"])).otherwise(intersect(b, unit)))
    return F.filter(cut, lambda b: b.isNotNull())


def fold_side(r: Column) -> Column:
    """The page of a spread that a rectangle lies on; null if it crosses the fold."""
    return F.when(r["x"] + r["w"] <= 0.5 + SLACK, F.lit("left")).when(r["x"] >= 0.5 - SLACK, F.lit("right"))


def choose_crop(width: Column, height: Column, target_aspect: Column, focus_x: Column, focus_y: Column) -> Column:
    """The largest window of an aspect, centred on the focus and kept inside the image."""
    aspect = width / height
    w = F.when(aspect > target_aspect, target_aspect / aspect).otherwise(F.lit(1.0))
    h = F.when(aspect > target_aspect, F.lit(1.0)).otherwise(aspect / target_aspect)
    at = lambda focus, size: F.greatest(F.lit(0.0), F.least(1 - size, focus - size / 2))
    return rect(at(focus_x, w), at(focus_y, h), w, h)


def aspect_fit(a: Column, b: Column) -> Column:
    return F.least(a, b) / F.greatest(a, b)


def effective_dpi(pixels: Column, share: Column, inches: Column) -> Column:
    return pixels * share / inches


def headroom(dpi: Column, least: float, warn: float) -> Column:
    """Where a resolution lies between the least allowed and the one without a warning."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (dpi - least) / (warn - least)))


def retention(crop: Column, box: Column, unknown: float = 0.5) -> Column:
    """The share of a box that a crop keeps."""
    return F.when(box.isNull() | (area(box) <= 0), F.lit(unknown)).otherwise(shared_area(crop, box) / area(box))


def gap_distance(a: Column, b: Column, saturates: float = 3600.0) -> Column:
    """Seconds between two times as 0 to 1; 0.5 where one is unknown."""
    gap = F.abs(a - b) / saturates
    return F.when(gap.isNull(), F.lit(0.5)).otherwise(F.least(F.lit(1.0), gap))  # least() passes over nulls


def colour_distance(a: Column, b: Column) -> Column:
    """Distance of two colours (r, g, b) as 0 to 1; 0.5 where one is unknown."""
    square = sum((F.pow(a[c] - b[c], F.lit(2.0)) for c in ("r", "g", "b")), F.lit(0.0))
    return F.coalesce(F.sqrt(square) / F.sqrt(F.lit(3.0)), F.lit(0.5))


def calm_score(wide: Column, warmth: Column, clipped: Column) -> Column:
    return F.lit(0.5) * F.when(wide, 1.0).otherwise(0.0) + F.lit(0.3) * warmth + F.lit(0.2) * (1 - clipped)


def warmth(palette: Column) -> Column:
    """The weighted mean of 0.5 + (red - blue) / 2, kept in 0 to 1; 0.5 without colours."""
    total = F.aggregate(palette, F.lit(0.0), lambda s, c: s + c["weight"])
    value = F.aggregate(palette, F.lit(0.0), lambda s, c: s + c["weight"] * (0.5 + (c["r"] - c["b"]) / 2))
    return F.when(total > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), value / total))).otherwise(F.lit(0.5))


def share_over(values: Column, threshold: float) -> Column:
    """The share of values over a threshold; null without values."""
    return F.when(F.size(values) > 0, F.size(F.filter(values, lambda v: v > threshold)) / F.size(values))
