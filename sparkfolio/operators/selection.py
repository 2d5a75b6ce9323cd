"""Culling, eviction, quota allocation and tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import placed, running_sum
from .windows import winners


def cull(rows: DataFrame, cluster: str, order: list[Column], skip: Column, overrides: DataFrame, key: str) -> DataFrame:
    """One winner of each cluster, with overrides (``key``, ``state`` include or exclude).

    Rows to skip and excluded rows are out before the contest; included rows stand
    outside it and always stay.
    """
    state = overrides.select(F.col(key).alias("_key"), F.col("state").alias("_state"))
    marked = rows.join(state, F.col(key) == F.col("_key"), "left").withColumn("_state", F.coalesce("_state", F.lit("auto"))).drop("_key")
    contest = winners(marked.where((F.col("_state") == "auto") & ~F.coalesce(skip, F.lit(False))), [cluster], order)
    return contest.unionByName(marked.where("_state = 'include'")).drop("_state")


#: Fixed value: the share of clipped pixels past which a picture is badly exposed.
CLIPPED = 0.9


def survivors(rows: DataFrame, cluster: str, key: str, sharpness: str, quality: str | None, aesthetic: str, clipped: tuple[str, ...] = (), limit: float = CLIPPED) -> DataFrame:
    """``cluster`` and ``key`` of each cluster's best row.

    Well exposed rows (no share of ``clipped`` over ``limit``; unknown is none)
    come first, then the sharper, then the better face (none is the worst), then
    the more aesthetic, then the smaller ``key``.  One minimum by cluster, so a
    hot cluster is one row a task before the shuffle.
    """
    exposed = F.lit(True)
    for c in clipped:
        exposed &= F.coalesce(F.col(c) <= limit, F.lit(True))
    face = F.coalesce(F.col(quality).cast("double"), F.lit(-1.0)) if quality else F.lit(-1.0)
    best = F.struct((~exposed).alias("out"), (-F.col(sharpness)).alias("s"), (-face).alias("q"), (-F.col(aesthetic)).alias("a"), F.col(key).alias("key"))
    return rows.groupBy(cluster).agg(F.min(best)["key"].alias(key))


def evictions(entries: DataFrame, used: str, key: str, size: str, pinned: str, limit: int) -> DataFrame:
    """``evict`` for each entry: unpinned ones go, least recently used first, until the rest fits ``limit``."""
    total = entries.agg(F.sum(size)).first()[0] or 0
    loose = running_sum(entries.where(~F.col(pinned)), used, [key], F.col(size), "_up")
    gone = F.lit(total) - (F.col("_up") - F.col(size)) > limit
    kept = entries.where(F.col(pinned)).withColumn("evict", F.lit(False))
    return loose.withColumn("evict", gone).drop("_up").unionByName(kept)


def highest_averages(groups: DataFrame, key: str, weight: str, seats: int, cap: str | None = None) -> DataFrame:
    """Seats by the largest quotients weight / (1, 2, 3, ...); ties to the smaller key. A group gets at most ``cap``.

    No group wins more than its share of seats and one for each rival, so its
    quotients are listed up to the number of seats or its cap only.
    """
    most = F.lit(seats) if cap is None else F.least(F.lit(seats), F.col(cap))
    quotients = groups.where((F.col(weight) > 0) & (most > 0)).withColumn("_q", F.explode(F.sequence(F.lit(1), most.cast("int"))))
    ranked = quotients.withColumn("_v", F.col(weight) / F.col("_q")).orderBy(F.desc("_v"), key, "_q").limit(seats)
    won = ranked.groupBy(F.col(key).alias("_won")).agg(F.count("*").alias("seats"))
    return groups.join(won, F.col(key) == F.col("_won"), "left").withColumn("seats", F.coalesce("seats", F.lit(0))).drop("_won")


def median_bar(groups: DataFrame, key: str, merit: str, featured: int) -> DataFrame:
    """``tier`` of each group: under the median of merits brief, the best ``featured`` of the others featured, else normal."""
    bar = groups.agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{merit}`)")).first()[0]
    tier = F.when(F.col(merit) < F.lit(bar), "brief").when(F.col("_place") <= featured, "featured").otherwise("normal")
    ordered = placed(groups, [F.desc(merit), F.col(key)], "_place").withColumn("_place", F.col("_place") + 1)
    return ordered.withColumn("tier", tier).drop("_place")


def select_to(rows: DataFrame, included: Column, order: list[Column], target: int) -> DataFrame:
    """All included rows, and the best of the others up to ``target`` in all."""
    kept = rows.where(included)
    room = max(0, target - kept.count())
    return kept.unionByName(rows.where(~F.coalesce(included, F.lit(False))).orderBy(*order).limit(room))
