"""First-come sets: a row stays unless an earlier row that stays lies within a radius.

The rule is sequential, so it is followed in blocks of the order.  The first
``block`` undecided rows of every group are decided by themselves, and then all
later rows of the group, in as many tasks as they need, lose those within the
radius of a row that came to stay.  Groups of one block are done in one round; a
large group takes a round for each block of rows that nothing before rules out,
so crowded rows cost no rounds.  No task holds more than a block and a piece of
a group, and no pairs are made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as sc
from ..sources.shared import written

#: Rows that one task decides in their order, and later rows that one task compares with them.
BLOCK, PIECE = 2048, 50_000
#: The roles that a list owes, in order; places of the window behind the best pick; least percentile of a promoted row.
OWED, ROLE_WINDOW, ROLE_FLOOR = ("establishing", "people", "detail"), 2, 40


def _vectors(table: pa.Table) -> np.ndarray:
    return table["_v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _near(a: np.ndarray, b: np.ndarray, radius: float) -> np.ndarray:
    """Whether each row of ``a`` is within the radius of each of ``b``, by differences and in slices of some MB."""
    out, step = np.empty((len(a), len(b)), dtype=bool), max(1, (4 << 20) // max(1, b.size))
    for k in range(0, len(a), step):
        out[k : k + step] = np.sqrt(((a[k : k + step, None, :] - b[None, :, :]) ** 2).sum(axis=2)) <= radius
    return out


def _decide(radius: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_at")
        near, fixed = _near(v := _vectors(table), v, radius), table["_fixed"].to_numpy(zero_copy_only=False)
        stays, ruled_out = np.zeros(len(v), dtype=bool), np.zeros(len(v), dtype=bool)
        for i in range(len(v)):
            if fixed[i] or not ruled_out[i]:
                stays[i] = True
                ruled_out |= near[i]
        return pa.table({"_g": table["_g"], "_at": table["_at"], "_v": table["_v"], "_first": pa.array(stays)})

    return run


def _ruled_out(radius: float):
    def run(later: pa.Table, stay: pa.Table) -> pa.Table:
        alive = ~_near(_vectors(later), _vectors(stay), radius).any(axis=1) if later.num_rows and stay.num_rows else np.ones(later.num_rows, dtype=bool)
        alive |= later["_fixed"].to_numpy(zero_copy_only=False).astype(bool)
        return pa.table({"_g": later["_g"], "_at": later["_at"], "_v": later["_v"], "_fixed": later["_fixed"], "_alive": pa.array(alive, pa.bool_())})

    return run


def first_come(rows: DataFrame, keys: list[str], at: str, vector: str, radius: float, fixed: str | None = None, name: str = "first", block: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """``rows`` with ``name``: whether no earlier row of its group that stays is within ``radius``.

    ``at`` is a whole number, unique in a group, that gives the order.  Rows whose
    ``fixed`` is true stay whatever lies before them.  Rows without a vector stay
    and rule nothing out; vectors of different lengths are never near.
    """
    group = F.to_json(F.struct(*[F.col(k) for k in keys], F.size(vector).alias("_dim")))
    known = F.coalesce(F.size(vector) > 0, F.lit(False))
    holds = F.coalesce(F.col(fixed), F.lit(False)) if fixed else F.lit(False)
    rows = written(rows.withColumn("_g", F.when(known, group)), "rows")
    left = rows.where("_g IS NOT NULL").select("_g", F.col(at).cast("long").alias("_at"), F.col(vector).cast("array<double>").alias("_v"), holds.alias("_fixed"))
    decided = None
    while True:
        place = F.row_number().over(W.partitionBy("_g").orderBy("_at"))
        cuts = left.select("_g", "_at").withColumn("_place", place).where(F.col("_place") <= block).groupBy("_g").agg(F.max("_at").alias("_cut"))
        split = left.join(written(cuts, "cuts"), "_g")
        head = split.where("_at <= _cut").select("_g", "_at", "_v", "_fixed")
        found = written(head.groupBy("_g").applyInArrow(_decide(radius), "_g string, _at long, _v array<double>, _first boolean"), "decided")
        out = found.select("_g", "_at", "_first")
        later = split.where("_at > _cut").drop("_cut")
        count = later.count()
        if count:
            pieces = -(-count // piece)
            later = later.withColumn("_piece", F.pmod(F.xxhash64("_at"), F.lit(pieces)))
            stay = found.where("_first").select("_g", "_at", "_v").join(later.select("_g", "_piece").distinct(), "_g").select("_g", "_piece", "_v").toDF("_h", "_part", "_v")
            met = later.groupBy("_g", "_piece").cogroup(stay.groupBy("_h", "_part"))
            met = written(met.applyInArrow(_ruled_out(radius), "_g string, _at long, _v array<double>, _fixed boolean, _alive boolean"), "later")
            out = out.unionByName(met.where("NOT _alive").select("_g", "_at", F.lit(False).alias("_first")))
            left = met.where("_alive").drop("_alive")
        decided = out if decided is None else decided.unionByName(out)
        if not count:
            break
    answers = decided.select(F.col("_g").alias("_of"), F.col("_at").alias("_order"), "_first")
    joined = rows.join(answers, (F.col("_g") == F.col("_of")) & (F.col(at) == F.col("_order")), "left")
    return joined.withColumn(name, F.coalesce("_first", F.lit(True))).drop("_g", "_of", "_order", "_first")


def places_visited(rows: DataFrame, keys: list[str], at: str, lat: str, lon: str, km: float) -> DataFrame:
    """``places`` of each group: rows, in order, that are over ``km`` from every place counted before.

    Invalid places don't count.  Distances are chords of the unit sphere, so poles
    and the date line need no care.
    """
    here = rows.where(sc.valid_place(F.col(lat), F.col(lon))).select(*keys, at, F.array(*sc.unit_vector(F.col(lat), F.col(lon))).alias("_place"))
    chord = 2.0 * float(np.sin(min(km / (2 * sc.EARTH_KM), np.pi / 2)))
    seen = first_come(here, keys, at, "_place", chord)
    counts = seen.groupBy(*keys).agg(F.sum(F.col("first").cast("int")).alias("places"))
    groups, same = rows.select(*keys).distinct(), F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return groups.join(counts.select(*[F.col(k).alias(f"_{k}") for k in keys], "places"), same, "left").select(*keys, F.coalesce("places", F.lit(0)).alias("places"))


def look_alikes_last(rows: DataFrame, keys: list[str], at: str, vector: str, fixed: str, radius: float = 0.35) -> DataFrame:
    """``rows`` with ``seat`` from 0 in each group, ``included`` and ``distinct``: fixed rows, then those unlike all ahead, then look-alikes.

    ``at`` is the order before, the fixed rows first.  ``included`` counts the
    fixed rows and ``distinct`` those and the unlike ones.
    """
    found = first_come(rows, keys, at, vector, radius, fixed)
    chosen = F.coalesce(F.col(fixed), F.lit(False))
    order = W.partitionBy(*keys).orderBy((~chosen).cast("int"), (~F.col("first")).cast("int"), at)
    group = W.partitionBy(*keys)
    return (
        found.withColumn("seat", F.row_number().over(order) - 1)
        .withColumn("included", F.sum(chosen.cast("int")).over(group))
        .withColumn("distinct", F.sum((chosen | F.col("first")).cast("int")).over(group))
    )


def cover_roles(rows: DataFrame, keys: list[str], seat: str, role: str, score: str, included: str = "included", distinct: str = "distinct", name: str = "seat") -> DataFrame:
    """``rows`` with seats in which the first places of each group cover the roles it has.

    A role that is missing from the included rows, the best pick and the window
    behind it is filled by its first row further down the distinct ones whose
    ``score`` is at least ``ROLE_FLOOR``; the window keeps its best rows in front.
    Only sums by group decide, and each row then computes its own seat.
    """
    start = F.col(included) + 1
    end = F.least(start + ROLE_WINDOW, F.col(distinct))
    moves = (end > start) & (F.col(distinct) > end)
    at = F.col(seat)
    sums = []
    for k, own in enumerate(OWED):
        is_role = F.col(role) == own
        sums.append(F.max(F.when(is_role & (at < end), F.lit(1)).otherwise(F.lit(0))).alias(f"_has{k}"))
        sums.append(F.min(F.when(moves & is_role & (at >= end) & (at < F.col(distinct)) & (F.col(score) >= ROLE_FLOOR), at)).alias(f"_at{k}"))
    groups = rows.groupBy(*keys).agg(*sums, F.max(end - start).alias("_room"))
    wanted = F.filter(F.array(*[F.when(F.col(f"_has{k}") == 0, F.col(f"_at{k}")) for k in range(len(OWED))]), lambda x: x.isNotNull())
    groups = groups.select(*[F.col(k).alias(f"_{k}") for k in keys], F.slice(wanted, F.lit(1), F.greatest("_room", F.lit(0))).alias("_up"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = rows.join(groups, same)
    keep = end - F.size("_up")
    moved = F.when(F.array_contains("_up", at), keep + F.array_position("_up", at).cast("int") - 1)
    moved = moved.when((at >= keep) & (at < F.col(distinct)), at + F.size(F.filter("_up", lambda x: x > at)))
    return joined.withColumn(name, F.when(F.size("_up") > 0, F.coalesce(moved, at)).otherwise(at).cast("int")).drop("_up", *[f"_{k}" for k in keys])
