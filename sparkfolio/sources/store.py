"""Keyed tables on plain Parquet: upsert, delete, touch, history, manifests and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.windows import last_versions


def upserted(table: DataFrame, new: DataFrame, keys: list[str], newest: str | None = None) -> DataFrame:
    """``table`` with rows replaced or added by key; of several new rows of a key the newest counts."""
    if newest:
        order = W.partitionBy(*keys).orderBy(F.desc(newest))
        new = new.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return table.join(new.select(*keys), keys, "left_anti").select(*table.columns).unionByName(new.select(*table.columns))


def removed(table: DataFrame, gone: DataFrame, keys: list[str], pinned: DataFrame | None = None) -> DataFrame:
    """``table`` without the keys of ``gone``, but for pinned ones."""
    if pinned is not None:
        gone = gone.join(pinned.select(*keys), keys, "left_anti")
    return table.join(gone.select(*keys), keys, "left_anti")


def orphans(table: DataFrame, owner: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the owner doesn't have."""
    return table.join(owner.select(*keys), keys, "left_anti")


def touched(table: DataFrame, used: DataFrame, key: str, column: str, now: Column) -> DataFrame:
    """``column`` set to ``now`` for the keys in use."""
    marks = used.select(F.col(key).alias("_used")).distinct()
    joined = table.join(marks, F.col(key) == F.col("_used"), "left")
    return joined.withColumn(column, F.when(F.col("_used").isNotNull(), now).otherwise(F.col(column))).drop("_used")


def committed(history: DataFrame, version: DataFrame, project: str, seq: str, pointer: int | None = None, keep: int = 50) -> DataFrame:
    """A version history with one more version: later (undone) ones go, and all but the newest ``keep``."""
    if pointer is not None:
        history = history.where(F.col(seq) <= pointer)
    return last_versions(history.unionByName(version), [project], [F.desc(seq)], keep).drop("age")


def purged(projects: DataFrame, deleted_at: str, cutoff: Column) -> DataFrame:
    """Projects that aren't deleted, or were only after the cutoff."""
    return projects.where(F.col(deleted_at).isNull() | (F.col(deleted_at) > cutoff))


def export_items(pages: DataFrame) -> DataFrame:
    """A row for each placement of each page: ``number``, ``placement`` and its place ``pos``."""
    return pages.select("number", F.posexplode("placements").alias("pos", "placement"))


def written_only(items: DataFrame, written: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The items whose file was written, and how many were not."""
    return items.join(written.select(name), name, "left_semi"), items.join(written.select(name), name, "left_anti").count()


def manifest(items: DataFrame, page: str, order: str, fields: list[str]) -> DataFrame:
    """One JSON text a page: its items in order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *fields))), lambda s: F.struct(*[s[f].alias(f) for f in fields]))
    return items.groupBy(page).agg(F.to_json(F.struct(F.first(F.col(page)).alias("page"), listed.alias("items"))).alias("json"))


def first_of_path(items: DataFrame, path: str, order: str) -> DataFrame:
    """``failed`` for every item but the first of its path."""
    place = F.row_number().over(W.partitionBy(path).orderBy(order))
    return items.withColumn("failed", place > 1)


def override(states: Column, key: Column, state: Column) -> Column:
    """A map of overrides with one changed; auto removes the key."""
    rest = F.map_filter(states, lambda k, v: k != key)
    return F.when(state == "auto", rest).otherwise(F.map_concat(rest, F.create_map(key, state)))
