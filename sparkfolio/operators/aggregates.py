"""Aggregations: modes, inequality, AUC, vector and spherical means, quantiles, palettes and tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import unit_vector


def mode(df: DataFrame, keys: list[str], value: str, prefer: Column | None = None) -> DataFrame:
    """The most frequent value of each key and its count; ties to the larger ``prefer`` (the value itself by default)."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("votes"))
    rank = F.struct("votes", (F.col(value) if prefer is None else prefer).alias("p"))
    return counts.groupBy(*keys).agg(F.max_by(value, rank).alias(value), F.max("votes").alias("votes"))


def gini(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The Gini coefficient of a group's values; 0 where they are all 0."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(value))
    ranked = df.where(F.col(value).isNotNull()).withColumn("_i", place)
    total, n = F.sum(value), F.count("*")
    return ranked.groupBy(*keys).agg(F.when(total == 0, F.lit(0.0)).otherwise(2 * F.sum(F.col("_i") * F.col(value)) / (n * total) - (n + 1) / n).alias("gini"))


def auc(df: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """The area under the ROC curve, ties one half; 0.5 where a side is empty.

    Rows are counted by score before any ordering, so ties are one row.
    """
    counts = df.groupBy(*keys, score).agg(F.sum(F.col(positive).cast("long")).alias("_p"), F.sum((~F.col(positive)).cast("long")).alias("_q"))
    below = F.coalesce(F.sum("_q").over(W.partitionBy(*keys).orderBy(score).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    wins = F.sum(F.col("_p") * (F.col("_below") + F.col("_q") / 2))
    p, q = F.sum("_p"), F.sum("_q")
    return counts.withColumn("_below", below).groupBy(*keys).agg(F.when((p > 0) & (q > 0), wins / (p * q)).otherwise(F.lit(0.5)).alias("auc"))


def vector_mean(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """The mean of each place of a group's vectors; null where lengths differ."""
    rows = df.where(F.col(vector).isNotNull())
    lengths = rows.groupBy(*keys).agg((F.min(F.size(vector)) == F.max(F.size(vector))).alias("_even"))
    means = rows.select(*keys, F.posexplode(vector).alias("_at", "_x")).groupBy(*keys, "_at").agg(F.avg(F.col("_x").cast("double")).alias("_mean"))
    gathered = means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_mean"))), lambda s: s["_mean"]).alias("_m"))
    return lengths.join(gathered, keys, "left").select(*keys, F.when(F.col("_even"), F.col("_m")).alias("mean"))


def spherical_centroid(df: DataFrame, keys: list[str], lat: str, lon: str) -> DataFrame:
    """The mean place on the sphere; null where places cancel."""
    x, y, z = unit_vector(F.col(lat), F.col(lon))
    sums = df.groupBy(*keys).agg(F.sum(x).alias("_x"), F.sum(y).alias("_y"), F.sum(z).alias("_z"))
    norm = F.sqrt(F.col("_x") ** 2 + F.col("_y") ** 2 + F.col("_z") ** 2)
    some = norm >= 1e-9
    return sums.select(*keys, F.when(some, F.degrees(F.asin(F.col("_z") / norm))).alias("lat"), F.when(some, F.degrees(F.atan2("_y", "_x"))).alias("lon"))


def nearest_rank(df: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """The value at place ``round((n - 1) * share)`` of a group's ordered values; exact, by counts of equal values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    up = F.sum("_n").over(W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    placed = counts.withColumn("_up", up).withColumn("_all", F.sum("_n").over(W.partitionBy(*keys)))
    picks = [F.min(F.when(F.col("_up") > F.round((F.col("_all") - 1) * q), F.col(value))).alias(f"p{round(q * 100)}") for q in shares]
    return placed.groupBy(*keys).agg(*picks)


def top_tags(df: DataFrame, keys: list[str], tags: Column, most: int = 10) -> DataFrame:
    """The tags on most rows of each key: ``tag``, ``n`` and ``rank``; ties to the smaller tag. A row counts a tag once."""
    counts = df.select(*keys, F.explode(F.array_distinct(tags)).alias("tag")).groupBy(*keys, "tag").agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), "tag"))
    return counts.withColumn("rank", place).where(F.col("rank") <= most)


def event_stats(df: DataFrame, keys: list[str], score: str, kept: Column, moment: str, flag: Column, best: int = 3) -> DataFrame:
    """Rows, kept rows, distinct moments, the mean of the ``best`` top scores and the share of flagged rows, for each key."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last()))
    ranked = df.withColumn("_place", place).withColumn("_kept", kept.cast("long")).withColumn("_flag", flag.cast("double"))
    return ranked.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum("_kept").alias("n_kept"),
        F.countDistinct(moment).alias("moments"),
        F.avg(F.when(F.col("_place") <= best, F.col(score))).alias("merit"),
        F.avg("_flag").alias("flag_share"),
    )


def palette(df: DataFrame, keys: list[str], r: str, g: str, b: str, most: int = 6, levels: int = 4) -> DataFrame:
    """The most frequent colour cells of each key with their mean colours and weights that sum to 1; ties to the smaller cell."""
    level = lambda c: F.least(F.lit(levels - 1), F.floor(F.col(c) * levels))
    cells = df.withColumn("cell", (level(r) * levels + level(g)) * levels + level(b)).groupBy(*keys, "cell").agg(F.count("*").alias("_n"), *[F.avg(c).alias(c) for c in (r, g, b)])
    top = cells.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_n"), "cell"))).where(F.col("rank") <= most)
    return top.withColumn("weight", F.col("_n") / F.sum("_n").over(W.partitionBy(*keys))).drop("_n")
