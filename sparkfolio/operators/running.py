"""Places, sessions, running sums and percentiles over one global order, without a task that sees all rows.

Rows are sorted in ranges and written once; a range runs its own windows, and a
row for each range (as many as the sort has partitions) tells what came before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import written


def ranged(df: DataFrame, order: list, name: str = "ranged") -> DataFrame:
    """``df`` sorted and written, with ``_range`` (in the order) and ``_at``, the place in its range from 0."""
    # the high bits of the number are the partition of the sort, the low ones the place in it
    rows = written(df.sort(*order).withColumn("_number", F.monotonically_increasing_id()), name)
    return rows.withColumn("_range", F.shiftright("_number", 33)).withColumn("_at", F.col("_number").bitwiseAND((1 << 33) - 1)).drop("_number")


def _own_range():
    return W.partitionBy("_range").orderBy("_at")


def _earlier(value: str) -> Column:
    """The sum of ``value`` over the ranges before."""
    return F.coalesce(F.sum(value).over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def _with_ranges(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(ranges.withColumnRenamed("_range", "_of")), F.col("_range") == F.col("_of")).drop("_of")


def placed(df: DataFrame, order: list, name: str = "place") -> DataFrame:
    """``df`` with the place of each row in an order, from 0."""
    rows = ranged(df, order)
    ranges = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    ranges = ranges.select("_range", _earlier("_n").alias("_before"))
    return _with_ranges(rows, ranges).withColumn(name, F.col("_before") + F.col("_at")).drop("_range", "_at", "_before")


def gap_numbers(df: DataFrame, at: str, gap: float, tie: str, name: str = "session") -> DataFrame:
    """``df`` with session numbers from 0 over one timeline: a new one after a gap strictly over ``gap``.

    Rows without a time share one session after all others, 0 where no row has one.
    """
    rows = ranged(df.where(F.col(at).isNotNull()), [at, tie])
    rows = rows.withColumn("_new", F.coalesce((F.col(at) - F.lag(at).over(_own_range()) > gap).cast("int"), F.lit(0)))
    rows = rows.withColumn("_up", F.sum("_new").over(_own_range().rowsBetween(W.unboundedPreceding, 0)))
    ranges = rows.groupBy("_range").agg(F.min(at).alias("_first"), F.max(at).alias("_last"), F.sum("_new").alias("_inside"))
    begins = F.coalesce((F.col("_first") - F.lag("_last").over(W.orderBy("_range")) > gap).cast("int"), F.lit(0))
    ranges = ranges.withColumn("_begins", begins).withColumn("_all", F.col("_inside") + F.col("_begins"))
    ranges = ranges.select("_range", (_earlier("_all") + F.col("_begins")).alias("_before"))
    out = _with_ranges(rows, ranges).withColumn(name, F.col("_before") + F.col("_up")).drop("_range", "_at", "_new", "_up", "_before")
    last = out.agg(F.max(name)).first()[0]
    loose = df.where(F.col(at).isNull()).withColumn(name, F.lit(0 if last is None else last + 1).cast("long"))
    return out.unionByName(loose)


def running_sum(df: DataFrame, order: str, then: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows up to each, by ``order`` and ``then`` (unique with it)."""
    rows = ranged(df.withColumn("_value", value), [order, *then])
    ranges = rows.groupBy("_range").agg(F.sum("_value").alias("_sum"))
    ranges = ranges.select("_range", _earlier("_sum").alias("_before"))
    rows = rows.withColumn("_inside", F.sum("_value").over(_own_range().rowsBetween(W.unboundedPreceding, 0)))
    return _with_ranges(rows, ranges).withColumn(name, F.col("_inside") + F.col("_before")).drop("_range", "_at", "_value", "_inside", "_before")


def percentile_of(df: DataFrame, column: str) -> Column:
    """A column that gives each row its ``round(100 * rows at or below / valid rows)`` in ``df``.

    Ties are equal and the largest value has 100; null and NaN have 0 and don't
    count.  Values are counted before they are sorted, so a hot value is one row.
    Of the result only the least value of each percentile is needed, 101 numbers
    at most; they become a search tree of comparisons, and no row is shuffled.
    """
    value = F.col(f"`{column}`").cast("double")
    value = F.when(~F.isnan(value), value)
    counts = running_sum(df.select(value.alias("x")).where("x IS NOT NULL").groupBy("x").agg(F.count("*").alias("n")), "x", [], F.col("n"), "up")
    total = counts.agg(F.max("up")).first()[0]
    if not total:
        return F.lit(0)
    ranks = counts.groupBy(F.round(100.0 * F.col("up") / total).cast("int").alias("rank")).agg(F.min("x").alias("x")).orderBy("rank").collect()

    def search(found: list) -> Column:
        if len(found) == 1:
            return F.lit(found[0].rank)
        half = len(found) // 2
        return F.when(value < F.lit(found[half].x), search(found[:half])).otherwise(search(found[half:]))

    return F.when(value.isNull(), F.lit(0)).otherwise(search(ranks))


def percentile_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with the percentile of each row's value as ``name``."""
    return df.withColumn(name, percentile_of(df, column))
