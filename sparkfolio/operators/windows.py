"""Sessions, anchored windows, per-group picks and other operators over ordered groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def gap_sessions(df: DataFrame, keys: list[str], time: str, gap: float, tie: str, name: str = "session") -> DataFrame:
    """A session number from 0 for each key: a new one after a gap strictly over ``gap`` (numeric time).

    Rows without a time share one session after all others, 0 where no row has one.
    """
    order = W.partitionBy(*keys).orderBy(F.col(time).asc_nulls_last(), tie)
    new = F.when(F.col(time).isNull(), F.lag(time).over(order).isNotNull()).otherwise(F.col(time) - F.lag(time).over(order) > gap)
    marked = df.withColumn("_new", F.coalesce(new, F.lit(False)).cast("int"))
    return marked.withColumn(name, F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def anchored_windows(df: DataFrame, keys: list[str], time: str, width: float, tie: str, name: str = "window") -> DataFrame:
    """A window number from 0 for each key; a window begins at a row and takes what is at most ``width`` after that row.

    A gap over ``width`` always begins a window, so rows are cut into runs there
    first, and only a run's times are folded.  Rows without a time are each a
    window of their own, after all others.
    """
    runs = gap_sessions(df.where(F.col(time).isNotNull()), keys, time, width, tie, "_run")
    times = runs.groupBy(*keys, "_run").agg(F.array_sort(F.collect_set(time)).alias("_times"))
    start = F.struct(F.filter(F.array(F.element_at("_times", 1)), lambda x: F.lit(False)).alias("at"), F.lit(None).cast(dict(df.dtypes)[time]).alias("anchor"))

    def step(state: Column, t: Column) -> Column:
        new = state["anchor"].isNull() | (t - state["anchor"] > width)
        return F.struct(F.when(new, F.concat(state["at"], F.array(t))).otherwise(state["at"]).alias("at"), F.when(new, t).otherwise(state["anchor"]).alias("anchor"))

    anchors = times.withColumn("_at", F.aggregate("_times", start, step)["at"])
    before = W.partitionBy(*keys).orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    anchors = anchors.withColumn("_before", F.coalesce(F.sum(F.size("_at")).over(before), F.lit(0))).select(*keys, "_run", "_at", "_before")
    dated = runs.join(anchors, [*keys, "_run"]).withColumn(name, F.col("_before") + F.size(F.filter("_at", lambda a: a <= F.col(time))) - 1).drop("_run", "_at", "_before")
    loose = df.where(F.col(time).isNull())
    if loose.limit(1).count():
        last = dated.groupBy(*keys).agg((F.max(name) + 1).alias("_next"))
        loose = loose.join(last, keys, "left").withColumn(name, F.coalesce("_next", F.lit(0)) + F.row_number().over(W.partitionBy(*keys).orderBy(tie)) - 1).drop("_next")
        dated = dated.unionByName(loose)
    return dated


def winners(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group; ``order`` ends in a unique column."""
    return df.withColumn("_place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def ranked_picks(df: DataFrame, keys: list[str], group: str, order: list[Column], most: int = 2, name: str = "pick") -> DataFrame:
    """At most ``most`` rows of each ``group``, numbered by key with all first picks before any second."""
    placed = df.withColumn("_round", F.row_number().over(W.partitionBy(*keys, group).orderBy(*order))).where(F.col("_round") <= most)
    return placed.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy("_round", *order))).drop("_round")


def nearest_same_bucket(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, left_id: str, right_id: str, bucket: float) -> DataFrame:
    """Each left row with the right row of the same keys and bucket that is nearest in time, either way; ties to the smaller id."""
    cut = lambda t: F.floor(F.col(t) / bucket)
    new = [c for c in right.columns if c not in keys]
    a = left.select(*keys, cut(left_time).alias("_bucket"), F.col(left_time).alias("_at"), F.struct(*left.columns).alias("_left"), F.lit(None).cast("long").alias("_id"), F.lit(None).alias("_right"))
    b = right.select(*keys, cut(right_time).alias("_bucket"), F.col(right_time).alias("_at"), F.lit(None).alias("_left"), F.col(right_id).cast("long").alias("_id"), F.struct(*new).alias("_right"))
    a, b = a.withColumn("_right", F.col("_right").cast(b.schema["_right"].dataType)), b.withColumn("_left", F.col("_left").cast(a.schema["_left"].dataType))
    rows = a.unionByName(b)
    # the last right row before each left one and the first after it: of one time the smaller id
    group, is_left = W.partitionBy(*keys, "_bucket"), F.col("_left").isNotNull()
    seen = F.when(~is_left, F.struct("_at", "_id", "_right"))
    before = F.last(seen, ignorenulls=True).over(group.orderBy("_at", is_left, F.desc("_id")).rowsBetween(W.unboundedPreceding, 0))
    after = F.last(seen, ignorenulls=True).over(group.orderBy(F.desc("_at"), is_left, F.desc("_id")).rowsBetween(W.unboundedPreceding, 0))
    found = rows.withColumn("_before", before).withColumn("_after", after).where(is_left)
    far = lambda c: F.struct(F.abs(F.col(f"{c}._at") - F.col("_at")).alias("far"), F.col(f"{c}._id").alias("id"), F.col(f"{c}._right").alias("right"))
    near = F.when(F.col("_after").isNull() | (far("_before") <= far("_after")), F.col("_before._right")).otherwise(F.col("_after._right"))
    return found.where(F.col("_before").isNotNull() | F.col("_after").isNotNull()).withColumn("_near", F.when(F.col("_before").isNull(), F.col("_after._right")).otherwise(near)).select("_left.*", *[F.col(f"_near.{c}").alias(c) for c in new])


def islands(df: DataFrame, keys: list[str], number: str, bridge: int = 1, name: str = "island") -> DataFrame:
    """Runs of numbers whose neighbours are at most ``bridge`` + 1 apart."""
    return gap_sessions(df, keys, number, bridge + 1, number, name)


def last_versions(df: DataFrame, keys: list[str], order: list[Column], keep: int = 50) -> DataFrame:
    """The newest ``keep`` versions of each key, numbered from the newest."""
    return df.withColumn("age", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("age") <= keep)


def chunks(df: DataFrame, keys: list[str], order: list[Column], size: int) -> DataFrame:
    """Rows of each group in chunks of ``size``: ``chunk`` and ``place`` from 0."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("_n", n).withColumn("chunk", F.floor(F.col("_n") / size).cast("int")).withColumn("place", F.pmod("_n", F.lit(size)).cast("int")).drop("_n")


def ordered_distinct(df: DataFrame, key: str, order: Column) -> DataFrame:
    """Each key at its first place."""
    return df.groupBy(key).agg(F.min(order).alias("first_at"))


def inversions(df: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """How often a value is under the one before it in the order."""
    before = F.lag(value).over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_down", (F.col(value) < before).cast("int")).groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.sum("_down"), F.lit(0)).alias("inversions"))
