"""Print geometry: trim, safe area and fold of a page, hard rules of a placement, rules of a layout.

All Column expressions. Rectangles are page-normalised structs (x, y, w, h); ``side`` is
'left' or 'right'. The fold edge has no inset: the paper goes on there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import area, contains, intersect, rect, shared_area
from .scalar import once

SLACK = 1e-9
#: Rules of layouts have more room.
ROOM = 1e-6
#: The most boxes of a layout, the least width and height of a box, and what boxes may overlap.
MOST_BOXES, LEAST_BOX, MOST_OVERLAP = 8, 0.05, 0.0005


@dataclass(frozen=True)
class PrintSpec:
    """Sizes in inches, resolutions in pixels an inch."""

    page_w: float
    page_h: float
    bleed: float
    gutter: float
    safe: float
    min_dpi: float
    warn_dpi: float
    wrap: float = 0.75

    def __post_init__(self):
        if min(self.page_w, self.page_h, self.min_dpi, self.warn_dpi) <= 0 or min(self.bleed, self.gutter, self.safe, self.wrap) < 0:
            raise ValueError("sizes and resolutions are over 0, insets not under")
        if 2 * (self.bleed + self.safe) >= min(self.page_w, self.page_h) or self.gutter + self.bleed >= self.page_w:
            raise ValueError("the insets leave nothing of the page")


def _inset(side: Column, u: float, v: float) -> Column:
    """The page less ``u`` on its outer edge and ``v`` above and below."""
    return rect(F.when(side == "left", F.lit(u)).otherwise(F.lit(0.0)), F.lit(v), F.lit(1.0 - u), F.lit(1.0 - 2 * v))


def trim_rect(spec: PrintSpec, side: Column) -> Column:
    return _inset(side, spec.bleed / spec.page_w, spec.bleed / spec.page_h)


def safe_rect(spec: PrintSpec, side: Column) -> Column:
    return _inset(side, (spec.bleed + spec.safe) / spec.page_w, (spec.bleed + spec.safe) / spec.page_h)


def gutter_band(spec: PrintSpec, side: Column) -> Column:
    """The strip along the fold that the binding takes."""
    g = spec.gutter / spec.page_w
    return rect(F.when(side == "left", F.lit(1.0 - g)).otherwise(F.lit(0.0)), F.lit(0.0), F.lit(g), F.lit(1.0))


def in_trim(spec: PrintSpec, r: Column, side: Column) -> Column:
    return contains(trim_rect(spec, side), r)


def in_safe_margin(spec: PrintSpec, r: Column, side: Column) -> Column:
    return contains(safe_rect(spec, side), r)


def clear_of_gutter(spec: PrintSpec, r: Column, side: Column) -> Column:
    g = spec.gutter / spec.page_w
    return F.when(side == "left", r["x"] + r["w"] <= 1.0 - g + SLACK).otherwise(r["x"] >= g - SLACK)


def gutter_overlap_area(spec: PrintSpec, r: Column, side: Column) -> Column:
    return shared_area(r, gutter_band(spec, side))


def bleeds_correctly(r: Column, edges: Column, side: Column) -> Column:
    """Whether every edge of ``edges`` ('left', 'right', 'top', 'bottom') reaches the paper's edge; the fold can't bleed."""
    reaches = lambda e: (
        F.when(e == "top", r["y"] <= SLACK)
        .when(e == "bottom", r["y"] + r["h"] >= 1 - SLACK)
        .when(e != side, F.lit(False))
        .when(e == "left", r["x"] <= SLACK)
        .otherwise(r["x"] + r["w"] >= 1 - SLACK)
    )
    return F.forall(edges, reaches)


def slot_aspect(spec: PrintSpec, slot: Column) -> Column:
    """Width by height of a slot on paper."""
    return slot["w"] * spec.page_w / (slot["h"] * spec.page_h)


def dpi(spec: PrintSpec, width: Column, crop: Column, slot: Column) -> Column:
    """Pixels an inch of a cropped picture in a slot; 0 where the slot has no width."""
    return F.when(slot["w"] > 0, width * crop["w"] / (slot["w"] * spec.page_w)).otherwise(F.lit(0.0))


def in_page(inner: Column, crop: Column, slot: Column) -> Column:
    """A box of the picture in coordinates of the page; null for a crop without area."""
    across, down = slot["w"] / crop["w"], slot["h"] / crop["h"]
    mapped = rect(slot["x"] + (inner["x"] - crop["x"]) * across, slot["y"] + (inner["y"] - crop["y"]) * down, inner["w"] * across, inner["h"] * down)
    return F.when((crop["w"] > 0) & (crop["h"] > 0), mapped)


def face_rejection(spec: PrintSpec, faces: Column, crop: Column, slot: Column, side: Column) -> Column:
    """What the first offending face breaks: 'clipped', 'gutter' or 'safe margin'; null if none does. Faces outside the crop don't count."""

    def broken(face: Column) -> Column:
        cut = ~contains(crop, face)
        lies = lambda page: F.when(page.isNull(), None).when(~clear_of_gutter(spec, page, side), "gutter").when(~in_safe_margin(spec, page, side), "safe margin")
        return F.when(cut & intersect(face, crop).isNotNull(), "clipped").when(cut, None).otherwise(once(in_page(face, crop, slot), lies))

    return F.try_element_at(F.filter(F.transform(faces, broken), lambda b: b.isNotNull()), F.lit(1))


def rejects(spec: PrintSpec, width: Column, faces: Column, crop: Column, slot: Column, side: Column) -> Column:
    """The first hard rule that a placement breaks, resolution before faces; null if it stands."""
    return F.when(dpi(spec, width, crop, slot) < spec.min_dpi, "resolution").otherwise(face_rejection(spec, faces, crop, slot, side))


def face_quality(quality: Column) -> Column:
    return F.when(quality.isNull(), F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), quality)))  # least() passes over nulls


def gutter_saliency(spec: PrintSpec, salient: Column, crop: Column, slot: Column, side: Column) -> Column:
    """The share of the visible salient box that stays out of the fold; 1 where there is none."""
    return fold_free(spec, in_page(intersect(salient, crop), crop, slot), side)


def fold_free(spec: PrintSpec, page: Column, side: Column) -> Column:
    """The share of a box of the page that stays out of the fold; 1 for none."""
    share = 1 - gutter_overlap_area(spec, page, side) / area(page)
    return F.coalesce(F.when(area(page) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))), F.lit(1.0))


def hero_match(score: Column, best: Column, hero: Column) -> Column:
    """A picture's score by the best of its group, in hero slots; 0.5 elsewhere or without a best."""
    return F.when(hero & (best > 0), score / best).otherwise(F.lit(0.5))


def finite(r: Column) -> Column:
    """Whether all numbers of a box are known and finite."""
    good = F.lit(True)
    for c in "xywh":
        good &= F.coalesce(~F.isnan(r[c]) & (F.abs(r[c]) != float("inf")), F.lit(False))
    return good


def findings(spec: PrintSpec, r: Column, side: Column) -> Column:
    """The print rules that a box breaks, in order: edges inside the bleed, an edge in the gutter, mostly hidden. Boxes that aren't finite break none."""
    u, v, g = spec.bleed / spec.page_w, spec.bleed / spec.page_h, spec.gutter / spec.page_w
    right, bottom = r["x"] + r["w"], r["y"] + r["h"]
    inside = lambda d, z: (d > ROOM) & (d < z - ROOM)
    outer = F.when(side == "left", r["x"]).otherwise(1 - right)
    fold = F.when(side == "left", 1 - right).otherwise(r["x"])
    low, high = F.when(side == "left", F.lit(u)).otherwise(F.lit(g)), F.when(side == "left", F.lit(1 - g)).otherwise(F.lit(1 - u))
    seen_w, seen_h = F.least(right, high) - F.greatest(r["x"], low), F.least(bottom, F.lit(1 - v)) - F.greatest(r["y"], F.lit(v))
    rules = [
        F.when(inside(outer, u), F.concat(F.lit("bleed "), side)),
        F.when(inside(r["y"], v), F.lit("bleed top")),
        F.when(inside(1 - bottom, v), F.lit("bleed bottom")),
        F.when(inside(fold, g), F.lit("gutter")),
        F.when((seen_w < LEAST_BOX - ROOM) | (seen_h < LEAST_BOX - ROOM), F.lit("hidden")),
    ]
    return F.when(finite(r), F.filter(F.array(*rules), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))


def box_problem(r: Column) -> Column:
    """What is wrong with a box at any print size: 'not finite', 'off canvas' or 'too small'; null if nothing."""
    on = (r["x"] >= -ROOM) & (r["y"] >= -ROOM) & (r["x"] + r["w"] <= 1 + ROOM) & (r["y"] + r["h"] <= 1 + ROOM)
    return F.when(~finite(r), "not finite").when(~on, "off canvas").when((r["w"] < LEAST_BOX - ROOM) | (r["h"] < LEAST_BOX - ROOM), "too small")


def overlapping(a: Column, b: Column) -> Column:
    """Whether two boxes of a page overlap by more than a hair each way."""
    both = intersect(a, b)
    return F.coalesce((both["w"] > MOST_OVERLAP + ROOM) & (both["h"] > MOST_OVERLAP + ROOM), F.lit(False))
