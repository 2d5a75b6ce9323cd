"""Connected components of a distributed edge list, by alternating large and small stars.

Every step is an aggregation and a join on node numbers; no node's neighbours
are ever gathered.  Each round's edges are written to the shared folder, so
lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _least(edges: DataFrame) -> DataFrame:
    """For each node the smallest of itself and its neighbours."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")).withColumnRenamed("u", "_u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.join(_least(both), F.col("u") == F.col("_u"))
    return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = down.join(_least(down), F.col("u") == F.col("_u"))
    own = joined.select("u", F.col("m").alias("v"))
    others = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.unionByName(others).where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) for nodes of ``edges`` (u, v; longs) that aren't the smallest themselves.

    Loops and repeated edges do no harm; an empty list gives an empty result.
    """
    spark = edges.sparkSession
    now = common.written(edges.where("u != v").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).distinct(), "edges")
    mark = None
    while now.limit(1).count():
        after = common.written(_small_star(_large_star(now)), "edges")
        common.dropped(spark, now)
        now = after
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
