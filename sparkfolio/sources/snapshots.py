"""One commit over several tables: a snapshot names a version of each, and readers see all of it or nothing.

A table's version is a folder of Parquet that is written once.  A snapshot is one
small file with the folders of all tables; it is renamed into place under the
next number and never replaced, so a write that breaks off between two tables
leaves the last snapshot as it was, and of two writers that began at one snapshot
the second one is told.  A snapshot lists tables, not files: its size doesn't
grow with the data.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(Exception):
    """Another writer has committed since the snapshot that this change began at."""


class Snapshots:
    """Tables under ``root``, on any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """The snapshots there are, oldest first."""
        at, fs = self._fs(f"{self.root}/snapshots")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[1:-5]) for n in names if n.startswith("s") and n.endswith(".json"))

    def state(self, number: int | None = None) -> dict:
        """``number`` and ``tables`` (name to folder and schema) of a snapshot, the newest by default; 0 is empty."""
        known = self.numbers()
        number = max(known, default=0) if number is None else number
        if not number:
            return {"number": 0, "tables": {}}
        if number not in known:
            raise ValueError(f"there is no snapshot {number}")
        at, fs = self._fs(f"{self.root}/snapshots/s{number:012d}.json")
        stream = fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, table: str, number: int | None = None) -> DataFrame:
        """A table as a snapshot has it."""
        found = self.state(number)["tables"].get(table)
        if found is None:
            raise ValueError(f"the snapshot has no table {table}")
        return self.spark.read.schema(StructType.fromJson(found["schema"])).parquet(found["folder"])

    def commit(self, changes: dict[str, DataFrame | None], since: int | None = None) -> int:
        """Replace tables (None drops one) in one snapshot and return its number; tables not named stay.

        ``since`` is the snapshot that the change was computed from; the newest by default.
        """
        before = self.state(since)
        tables = dict(before["tables"])
        for name, df in changes.items():
            if df is None:
                tables.pop(name, None)
                continue
            folder = f"{self.root}/tables/{name}/{uuid.uuid4().hex}"
            df.write.parquet(folder)
            tables[name] = {"folder": folder, "schema": json.loads(df.schema.json())}
        after = {"number": before["number"] + 1, "tables": tables}
        draft, fs = self._fs(f"{self.root}/snapshots/.draft-{uuid.uuid4().hex}")
        fs.mkdirs(draft.getParent())
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps(after).encode()))
        stream.close()
        final, _ = self._fs(f"{self.root}/snapshots/s{after['number']:012d}.json")
        jvm = self.spark._jvm
        never = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        never[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(final), never)
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(final):
                raise Conflict(f"snapshot {after['number']} exists already") from e
            raise
        return after["number"]

    def expire(self, keep: int = 1) -> int:
        """Delete all but the newest ``keep`` snapshots and the folders that only those name; returns how many folders went.

        Folders that no snapshot names, of a write that broke off or is under way, stay.
        """
        numbers = self.numbers()
        states = {n: {t["folder"] for t in self.state(n)["tables"].values()} for n in numbers}
        kept = set().union(*(states[n] for n in numbers[-keep:])) if numbers else set()
        gone = set().union(*(states[n] for n in numbers[:-keep])) - kept if numbers[:-keep] else set()
        for n in numbers[:-keep]:  # first the names, then what they name
            at, fs = self._fs(f"{self.root}/snapshots/s{n:012d}.json")
            fs.delete(at, False)
        for folder in gone:
            at, fs = self._fs(folder)
            fs.delete(at, True)
        return len(gone)


def positioned(rows: DataFrame, keys: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """``rows`` of each owner numbered from 0 in their order."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)


def replaced(table: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """``table`` with all rows of the owners in ``new`` replaced by those of ``new``; a null owner is one of its own."""
    owners = new.select(F.col(owner).alias("_owner")).distinct()
    kept = table.join(owners, F.col(owner).eqNullSafe(F.col("_owner")), "left_anti")
    return kept.unionByName(new.select(*table.columns))


def cascaded(tables: dict[str, DataFrame], gone: DataFrame, owner: str) -> dict[str, DataFrame]:
    """Each table without the rows of the owners in ``gone``, children and owners alike; a null owner matches nothing."""
    owners = gone.select(F.col(owner).alias("_owner")).distinct()
    return {name: df.join(owners, F.col(owner) == F.col("_owner"), "left_anti") for name, df in tables.items()}


def purge(store: Snapshots, tables: list[str], projects: str, owner: str, deleted_at: str, before: Column, since: int | None = None) -> int:
    """Remove for good the projects deleted at or before a time, with all their rows in ``tables``, in one snapshot."""
    number = store.state(since)["number"]
    frames = {name: store.read(name, number) for name in [*tables, projects]}
    gone = frames[projects].where(F.col(deleted_at) <= before)
    return store.commit(cascaded(frames, gone, owner), number)
