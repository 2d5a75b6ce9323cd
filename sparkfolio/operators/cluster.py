"""Near-duplicate clustering by complete linkage, and chapters by time and place.

Both need the order of a group's rows, so a group is one task's work: a connected
component of links for linkage, a run between long gaps for chapters.  Groups are
cut as small as the semantics allow before they are gathered; ``complete_clusters``
merges in rounds of all rows first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import EARTH_KM
from ..sources.shared import written
from .windows import gap_sessions


def linkage(links: list[tuple[float, int, int]], members: list[int]) -> dict[int, int]:
    """Complete linkage: links by distance, then smaller and larger node, merge two clusters if every pair across is linked; labels are the smallest members."""
    links = [(d, min(a, b), max(a, b)) for d, a, b in links]
    linked = {(a, b) for _, a, b in links}
    of = {m: [m] for m in members}
    for _, a, b in sorted(links):
        x, y = of[a], of[b]
        if x is not y and all((min(i, j), max(i, j)) in linked for i in x for j in y):
            x.extend(y)
            for m in y:
                of[m] = x
    return {m: min(of[m]) for m in members}


#: Edges that are replaced by their stars at a time.
PIECE = 1 << 20


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes that edges join, each but the smallest of its component with that one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    at, root = at.reshape(2, -1), np.arange(len(nodes))
    while True:
        x, y = root[at[0]], root[at[1]]
        low, high = np.minimum(x, y), np.maximum(x, y)
        if not (low < high).any():
            break
        np.minimum.at(root, high, low)
        while (root != (above := root[root])).any():
            root = above
    led = root != np.arange(len(nodes))
    return nodes[led], nodes[root[led]]


def _in_stars(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges ``u``, ``v`` as stars, piece by piece."""
    held, rows = [], 0
    for part in parts:
        held, rows = [*held, part], rows + len(part)
        if rows >= PIECE:
            yield pd.DataFrame(dict(zip("uv", stars(*pd.concat(held)[["u", "v"]].to_numpy().T), strict=True)))
            held, rows = [], 0
    if rows:
        yield pd.DataFrame(dict(zip("uv", stars(*pd.concat(held)[["u", "v"]].to_numpy().T), strict=True)))


def _star_forest(links: DataFrame, a: str, b: str) -> DataFrame:
    """Each node ``u`` that isn't the smallest node ``v`` that it reaches, with that one.

    Edges become stars in each task, then in each task by node, so that dense
    links are a row a node before large and small stars alternate.
    """
    least = lambda edges: edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")).withColumnRenamed("u", "_u")
    edge = lambda rows, u, v: rows.select(F.col(u).alias("u"), F.col(v).alias("v"))
    edges = edge(links, a, b).where("u != v")
    now = edges.mapInPandas(_in_stars, edges.schema).repartition("u").mapInPandas(_in_stars, edges.schema)
    now = written(now.distinct(), "edges")
    while True:
        ends = now.select(F.col("u").alias("n"), F.lit(1).alias("led")).unionByName(now.select(F.col("v").alias("n"), F.lit(0).alias("led")))
        roles = ends.groupBy("n").agg(F.sum("led").alias("up"), F.min("led").alias("least"))
        if roles.where("up > 1 OR (up = 1 AND least = 0)").isEmpty():  # every node leads or is led by one
            return now
        both = now.unionByName(edge(now, "v", "u"))
        large = edge(both.join(least(both), F.col("u") == F.col("_u")).where("v > u"), "v", "m").where("u != v").distinct()
        small = large.join(least(large), F.col("u") == F.col("_u"))
        now = written(edge(small, "u", "m").unionByName(edge(small, "v", "m")).where("u != v").distinct(), "edges")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component``, the smallest node that it reaches, of the nodes that are linked with others."""
    led = _star_forest(links, a, b)
    return led.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(led.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def connected(links: DataFrame, a: str = "a", b: str = "b", component: str = "component") -> DataFrame:
    """``links`` with ``component``, the smallest node that their nodes reach."""
    found = _star_forest(links, a, b).select(F.col("u").alias("_node"), F.col("v").alias("_least"))
    return links.join(found, F.col(a) == F.col("_node"), "left").withColumn(component, F.coalesce("_least", a)).drop("_node", "_least")


def complete_linkage(links: DataFrame, component: str = "component", a: str = "a", b: str = "b", distance: str = "distance") -> DataFrame:
    """``node`` and ``cluster`` (smallest node) for the nodes of links, within each connected component."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = linkage(list(zip(group[distance], group[a], group[b], strict=True)), sorted({*group[a], *group[b]}))
        return pd.DataFrame({"node": list(found), "cluster": list(found.values())}, dtype="int64")

    return links.groupBy(component).applyInPandas(run, "node long, cluster long")


#: Pairs of clusters that one task takes at most, as long as rounds leave fewer.
LEFT = 1 << 17


def merged_once(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round of ``complete_clusters``: merges (``gone`` into ``stays``) and the pairs ``x`` < ``y`` of clusters after them."""
    first = pairs.select(F.explode(F.array("x", "y")).alias("n"), "k").groupBy("n").agg(F.min("k").alias("k"))
    meet = first.groupBy("k").agg(F.min("n").alias("stays"), F.max("n").alias("gone")).where("stays < gone")
    merges = written(meet.select("gone", "stays"), "merges")
    into = merges.select(F.explode(F.array("gone", "stays")).alias("n"), "stays")
    for end in ("x", "y"):
        own = into.select(F.col("n").alias(f"_{end}"), F.col("stays").alias(f"_in_{end}"))
        pairs = pairs.join(own, F.col(end) == F.col(f"_{end}"), "left")
    x, y = F.coalesce("_in_x", "x"), F.coalesce("_in_y", "y")
    parts = lambda end: F.when(F.col(f"_in_{end}").isNull(), 1).otherwise(2)
    after = pairs.select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y"), "k", (parts("x") * parts("y")).alias("_parts")).where("x < y")
    after = after.groupBy("x", "y").agg(F.min("k").alias("k"), F.count("*").alias("_n"), F.first("_parts").alias("_parts"))
    return merges, written(after.where("_n = _parts").select("x", "y", "k"), "pairs")


def complete_clusters(links: DataFrame, a: str = "a", b: str = "b", distance: str = "distance") -> DataFrame:
    """``node`` and ``cluster`` as of ``complete_linkage``, without a task for each component; nodes that merge with none may be left out.

    Links (each pair once, read several times) merge by distance, then by their
    smaller and larger node.  Two clusters can merge while every pair across is
    linked, and do at the first link between them, unless either merged before.
    Merges elsewhere take such pairs away but bring no earlier link, so a pair that
    comes first at both of its clusters merges for certain, and all such pairs
    merge at a time.  Rounds go on until few pairs are left, or they get hardly
    fewer (equal distances); the rest is done in order, by connected component if
    it is large.
    """
    ends = [F.least(a, b).alias("x"), F.greatest(a, b).alias("y")]
    pairs = links.where(F.col(a) != F.col(b)).select(*ends, F.struct(F.col(distance).alias("d"), ends[0].alias("i"), ends[1].alias("j")).alias("k"))
    merges, before, left = [], None, pairs.count()
    while left > LEFT and (before is None or left < 0.9 * before):
        merged, pairs = merged_once(pairs)
        merges, before, left = [*merges, merged], left, pairs.count()
    rest = pairs.select("x", "y", "k.*")
    rest = connected(rest, "x", "y") if left > LEFT else rest.withColumn("component", F.lit(0))
    ranks = rest.groupBy("component").applyInPandas(_in_order, "node long, cluster long")
    if not merges:
        return ranks
    for merged in merges:
        ranks = ranks.unionByName(merged.select(F.col("gone").alias("node"), F.col("stays").alias("cluster")))
    return components(ranks, "node", "cluster").withColumnRenamed("component", "cluster")


def _in_order(group: pd.DataFrame) -> pd.DataFrame:
    """Complete linkage of clusters whose pairs have a first link ``d``, ``i``, ``j``."""
    group = group.sort_values(["d", "i", "j"])
    found = linkage(list(zip(range(len(group)), group["x"], group["y"], strict=True)), sorted({*group["x"], *group["y"]}))
    return pd.DataFrame({"node": list(found), "cluster": list(found.values())}, dtype="int64")


#: Limits of links: distances of close and of near vectors, and differing bits.
CLOSE, NEAR, MOST_BITS = 0.35, 0.5, 4


def near_links(pairs: DataFrame, distance: str, bits: str, close: float = CLOSE, near: float = NEAR, most_bits: int = MOST_BITS) -> DataFrame:
    """The pairs that are links: close vectors; or few differing bits and vectors that are near or unknown."""
    d, h = F.col(distance), F.col(bits)
    return pairs.where((d <= close) | ((h <= most_bits) & ((d <= near) | d.isNull())))


def _km(p, q) -> float:
    a, b, c, d = (math.radians(x) for x in (*p, *q))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * EARTH_KM * math.asin(min(1.0, math.sqrt(h)))


def place_chapters(times: list, places: list, km: float) -> list[int]:
    """Chapter numbers within a time run: a new one where a row and the next located row are both over ``km`` from the running centroid."""
    located = [i for i, p in enumerate(places) if p]
    after = dict(zip(located, [*located[1:], None], strict=True))
    now, out, total = 0, [], [0.0, 0.0, 0.0]
    for i, place in enumerate(places):
        if place:
            norm = math.sqrt(sum(t * t for t in total))
            if norm >= 1e-9:
                centre = (math.degrees(math.asin(total[2] / norm)), math.degrees(math.atan2(total[1], total[0])))
                following = after[i]
                if following is not None and _km(place, centre) > km and _km(places[following], centre) > km:
                    now, total = now + 1, [0.0, 0.0, 0.0]
            la, lo = map(math.radians, place)
            total = [total[0] + math.cos(la) * math.cos(lo), total[1] + math.cos(la) * math.sin(lo), total[2] + math.sin(la)]
        out.append(now)
    return out


def chapters(df: DataFrame, keys: list[str], time: str, lat: str, lon: str, tie: str, gap: float, km: float | None) -> DataFrame:
    """``chapter`` of each row: runs of time, cut again where the place changes for good; ``km`` None is time alone."""
    runs = gap_sessions(df, keys, time, gap, tie, "_run")
    if km is None:
        return runs.withColumnRenamed("_run", "chapter")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in runs.schema.fields)}, _part int"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([time, tie], na_position="last")
        undated = group[time].isna().all()  # these stay together
        places = [None if undated or pd.isna(a) or pd.isna(b) else (a, b) for a, b in zip(group[lat], group[lon], strict=True)]
        return group.assign(_part=place_chapters(list(group[time]), places, km))

    from pyspark.sql import Window as W

    parts = runs.groupBy(*keys, "_run").applyInPandas(run, schema)
    return parts.withColumn("chapter", F.dense_rank().over(W.partitionBy(*keys).orderBy("_run", "_part")) - 1).drop("_run", "_part")
