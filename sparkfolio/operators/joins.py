"""Joins: lookups that must or may miss, prefixes, bands, differences and overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup_split(left: DataFrame, right: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Hits (inner) and misses (anti) of a lookup."""
    return left.join(right, on), left.join(right, on, "left_anti")


def lookup_or_fail(left: DataFrame, right: DataFrame, on: list[str], found: str) -> DataFrame:
    """A lookup in which a miss stops the job with the key in its message."""
    joined = left.join(right, on, "left")
    wrong = F.concat(F.lit("no match for "), F.concat_ws(",", *[F.col(c).cast("string") for c in on]))
    return joined.withColumn("_ok", F.when(F.col(found).isNull(), F.raise_error(wrong).cast("int")).otherwise(F.lit(1))).where("_ok = 1").drop("_ok")


def ordered_lookup(keys: DataFrame, array: str, right: DataFrame, on: str) -> DataFrame:
    """An array of keys as rows in its order (``pos``), each with its match."""
    each = keys.select(*[c for c in keys.columns if c != array], F.posexplode(array).alias("pos", on))
    return each.join(right, on, "left")


def state_of(scan: DataFrame, known: DataFrame, failed: DataFrame, on: str) -> DataFrame:
    """``state`` of each scanned key: known before failed before new."""
    a = known.select(F.col(on).alias("_known")).distinct()
    b = failed.select(F.col(on).alias("_failed")).distinct()
    joined = scan.join(a, F.col(on) == F.col("_known"), "left").join(b, F.col(on) == F.col("_failed"), "left")
    return joined.withColumn("state", F.when(F.col("_known").isNotNull(), "known").when(F.col("_failed").isNotNull(), "failed").otherwise("new")).drop("_known", "_failed")


def prefix_join(left: DataFrame, text: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """Rows whose text begins with a prefix: an equi-join for each length of prefix, not a loop over all pairs."""
    lengths = [r[0] for r in prefixes.select(F.char_length(prefix)).distinct().orderBy(F.char_length(prefix)).collect()]
    cut = left.withColumn("_cut", F.explode(F.array(*[F.substring(F.col(text), 1, n) for n in lengths]) if lengths else F.array().cast("array<string>")))
    fits = F.col("_cut") == F.col(prefix)
    return cut.join(prefixes, fits).drop("_cut").distinct()


#: Rows of a side in one block of the pairs of rows without a time.
BLOCK = 2048


def band_pairs(df: DataFrame, id_col: str, at: str, width: float, keep: list[str]) -> DataFrame:
    """Pairs a < b (by ``at``, then id) at most ``width`` apart: each row meets its own band and the next.

    Only two rows with a time can be too far apart: one whose ``at`` is null pairs
    with every other row, a < b by id, in blocks of both sides.
    """
    pairs = dated_pairs(df, id_col, at, width, keep)
    blocks = undated_blocks(df, id_col, at, keep, BLOCK)
    if not blocks:
        return pairs
    some, others = blocks
    some = some.select("_row", "_column", F.col(id_col).alias("_u"), *[F.col(c).alias(f"u_{c}") for c in keep])
    others = others.select("_row", "_column", F.col(id_col).alias("_o"), "_dated", *[F.col(c).alias(f"o_{c}") for c in keep])
    met = some.join(others, ["_row", "_column"]).where((F.col("_u") < F.col("_o")) | (F.col("_dated") & (F.col("_u") > F.col("_o"))))
    first = F.col("_u") < F.col("_o")
    sides = [F.when(first, F.col(x)).otherwise(F.col(y)).alias(name) for c in keep for x, y, name in ((f"u_{c}", f"o_{c}", f"a_{c}"), (f"o_{c}", f"u_{c}", f"b_{c}"))]
    ends = [F.least("_u", "_o").alias("a"), F.greatest("_u", "_o").alias("b")]
    return pairs.unionByName(met.select(*ends, *sides))


def dated_pairs(df: DataFrame, id_col: str, at: str, width: float, keep: list[str]) -> DataFrame:
    """The pairs of ``band_pairs`` of which both rows have a time."""
    left = df.select(F.col(id_col).alias("a"), F.col(at).alias("_ta"), *[F.col(c).alias(f"a_{c}") for c in keep]).withColumn("_band", F.floor(F.col("_ta") / width))
    right = df.select(F.col(id_col).alias("b"), F.col(at).alias("_tb"), *[F.col(c).alias(f"b_{c}") for c in keep]).withColumn("_own", F.floor(F.col("_tb") / width))
    later = (F.col("_tb") > F.col("_ta")) | ((F.col("_tb") == F.col("_ta")) & (F.col("b") > F.col("a")))
    banded = right.withColumn("_band", F.explode(F.array(F.col("_own"), F.col("_own") - 1))).drop("_own")
    return left.join(banded, "_band").where(later & (F.col("_tb") - F.col("_ta") <= width)).drop("_band", "_ta", "_tb")


def undated_blocks(df: DataFrame, id_col: str, at: str, keep: list[str], block: int) -> tuple[DataFrame, DataFrame] | None:
    """Rows without a time, and all rows (``_dated``), each in every block (``_row``, ``_column``) where it meets the other side; None without such rows."""
    undated, every = df.agg(F.count_if(F.col(at).isNull()), F.count("*")).first()
    if not undated:
        return None
    rows, columns = -(-undated // block), -(-every // block)
    part = lambda n: F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = [F.col(c).alias(c) for c in (id_col, *keep)]  # columns of its own, since the other side is of the same rows
    some = df.where(F.col(at).isNull()).select(*own, part(rows).alias("_row")).withColumn("_column", spread(columns))
    others = df.select(id_col, F.col(at).isNotNull().alias("_dated"), *keep, part(columns).alias("_column")).withColumn("_row", spread(rows))
    return some, others


def difference(before: DataFrame, after: DataFrame, on: list[str], values: list[str]) -> DataFrame:
    """Every key of either side with ``change``: added, deleted, changed or same; values as ``before_`` and ``after_``."""
    a = before.select(*on, *[F.col(v).alias(f"before_{v}") for v in values], F.lit(True).alias("_a"))
    b = after.select(*on, *[F.col(v).alias(f"after_{v}") for v in values], F.lit(True).alias("_b"))
    same = F.lit(True)
    for v in values:
        same &= F.col(f"before_{v}").eqNullSafe(F.col(f"after_{v}"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").when(same, "same").otherwise("changed")
    return a.join(b, on, "full_outer").withColumn("change", change).drop("_a", "_b")


def overlay(base: DataFrame, new: DataFrame, on: list[str], values: list[str]) -> DataFrame:
    """``base`` with the values of ``new`` where it has any; keys of either side."""
    b = new.select(*on, *[F.col(v).alias(f"_{v}") for v in values])
    joined = base.join(b, on, "full_outer")
    return joined.select(*on, *[F.coalesce(F.col(f"_{v}"), F.col(v)).alias(v) for v in values])


def risen(before: DataFrame, after: DataFrame, on: str, level: str, counts: Column) -> DataFrame:
    """The keys whose level counts after and didn't before; ``counts`` is a test of the column ``level``."""
    a = before.where(~counts).select(on)
    b = after.where(counts).select(on)
    return a.join(b, on)
