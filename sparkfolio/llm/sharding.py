"""A table of immutable shards with size-tiered compaction and a versioned manifest.

``append`` writes an arrival as small shard files and commits a manifest that
lists them as well.  ``compact`` looks at shards by tier (powers of ``fanout``
in size): a tier that has ``fanout`` shards is merged, shards of similar size in
the order of arrival, into files of up to the target size, until no tier is
full.  A shard of the target size is never rewritten, so a byte is written about
log_fanout(target / arrival) times.

A merge is one task that reads its shards and writes one file: no shuffle, and
one job merges many bins.  Files are written under names of their own and become
part of the table only by the manifest, which is renamed into place and never
replaced: readers see whole versions, a lost executor or driver leaves at most
files that no manifest lists, and of two writers one fails and can retry.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common

TARGET_BYTES, FANOUT, BASE_BYTES = 128 << 20, 4, 1 << 20
#: Bins that one job merges.
BINS_A_JOB = 64


class Conflict(RuntimeError):
    """Another writer committed the same version first."""


class ShardedTable:
    """A table under ``path``: ``data/`` holds shards, ``manifests/`` the versions."""

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, base_bytes: int = BASE_BYTES):
        if fanout < 2:
            raise ValueError("fanout is 2 at least")
        self.spark, self.path = spark, path.rstrip("/")
        self.target, self.fanout, self.base = target_bytes, fanout, base_bytes

    # files

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _files(self, path: str) -> list[tuple[str, int]]:
        at, fs = self._at(path)
        if not fs.exists(at):
            return []
        return sorted((s.getPath().toString(), s.getLen()) for s in fs.listStatus(at) if s.isFile())

    def versions(self) -> list[int]:
        return [int(p.rsplit("/v", 1)[1][:-5]) for p, _ in self._files(f"{self.path}/manifests") if p.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, the newest if none is given; version 0 is the empty table."""
        known = self.versions()
        version = max(known, default=0) if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        if version not in known:
            raise ValueError(f"there is no version {version}")
        at, fs = self._at(f"{self.path}/manifests/v{version:012d}.json")
        stream = fs.open(at)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _commit(self, before: dict, schema: dict, shards: list[dict]) -> dict:
        after = {"version": before["version"] + 1, "schema": schema, "shards": shards}
        draft, fs = self._at(f"{self.path}/manifests/.draft-{uuid.uuid4().hex}")
        fs.mkdirs(draft.getParent())
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps(after).encode()))
        stream.close()
        final, _ = self._at(f"{self.path}/manifests/v{after['version']:012d}.json")
        jvm = self.spark._jvm
        never = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        never[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(final), never)
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(final):
                raise Conflict(f"version {after['version']} exists already") from e
            raise
        return after

    def _written(self, df: DataFrame) -> list[dict]:
        run = f"{self.path}/data/run-{uuid.uuid4().hex}"
        df.write.parquet(run)
        return [{"path": p, "bytes": n} for p, n in self._files(run) if p.endswith(".parquet")]

    # the table

    def append(self, df: DataFrame, rows_a_shard: int | None = None) -> dict:
        """Add an arrival. Each task's rows are a shard (several, with ``rows_a_shard``); an empty arrival adds no rows.

        Rows are kept as they are: nulls, repeated rows and texts of any length
        stay, whatever the columns are called.
        """
        before = self.manifest()
        schema = json.loads(df.schema.json())
        if before["schema"] and [(f["name"], f["type"]) for f in before["schema"]["fields"]] != [(f["name"], f["type"]) for f in schema["fields"]]:
            raise ValueError("the arrival's columns aren't the table's")
        if rows_a_shard:
            self.spark.conf.set("spark.sql.files.maxRecordsPerFile", rows_a_shard)
        try:
            new = self._written(df)
        finally:
            if rows_a_shard:
                self.spark.conf.unset("spark.sql.files.maxRecordsPerFile")
        return self._commit(before, before["schema"] or schema, [*before["shards"], *new])

    def read(self, version: int | None = None) -> DataFrame:
        found = self.manifest(version)
        if found["schema"] is None:
            raise ValueError("the table has no version yet")
        return self._frame(found["schema"], [s["path"] for s in found["shards"]])

    def _frame(self, schema: dict, paths: list[str]) -> DataFrame:
        kind = StructType.fromJson(schema)
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def tier(self, size: int) -> int:
        """Shards of one tier differ in size by less than a factor of ``fanout``."""
        return max(0, math.floor(math.log(max(size, 1) / self.base, self.fanout) + 1e-9))

    def plan(self, shards: list[dict]) -> list[list[dict]]:
        """The bins to merge now: neighbours in arrival of one full tier, up to the target size."""
        tiers: dict[int, list[dict]] = {}
        for s in shards:
            if s["bytes"] < self.target * 0.75:
                tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        bins = []
        for full in tiers.values():
            if len(full) < self.fanout:
                continue
            now: list[dict] = []
            for s in full:
                if now and sum(x["bytes"] for x in now) + s["bytes"] > self.target * 1.05:
                    bins.append(now)
                    now = []
                now.append(s)
            bins.append(now)
        return [b for b in bins if len(b) > 1]

    def compact(self) -> dict:
        """Merge until no tier is full; each round is a version of its own."""
        now = self.manifest()
        while bins := self.plan(now["shards"]):
            gone, made = {s["path"] for b in bins for s in b}, []
            for at in range(0, len(bins), BINS_A_JOB):
                frames = [self._frame(now["schema"], [s["path"] for s in b]).coalesce(1) for b in bins[at : at + BINS_A_JOB]]
                whole = frames[0]
                for f in frames[1:]:
                    whole = whole.union(f)
                made += self._written(whole)
            now = self._commit(now, now["schema"], [s for s in now["shards"] if s["path"] not in gone] + made)
        return now

    def vacuum(self, keep: int = 1) -> int:
        """Delete shards that only versions before the newest ``keep`` list, and those versions; returns how many shards went."""
        known = sorted(self.versions())
        old, new = known[:-keep], known[-keep:]
        live = {s["path"] for v in new for s in self.manifest(v)["shards"]}
        gone = {s["path"] for v in old for s in self.manifest(v)["shards"]} - live
        # shards first: what a crash leaves is still listed by a manifest
        for path in sorted(gone) + [f"{self.path}/manifests/v{v:012d}.json" for v in old]:
            at, fs = self._at(path)
            fs.delete(at, False)
        return len(gone)

    def sweep(self, older_ms: int = 86_400_000) -> int:
        """Delete files of ``data/`` that no manifest lists and that are ``older_ms`` old at least: left by a writer that died."""
        live = {s["path"].rsplit("/data/", 1)[1] for v in self.versions() for s in self.manifest(v)["shards"]}
        at, fs = self._at(f"{self.path}/data")
        if not fs.exists(at):
            return 0
        now, count, found = self.spark._jvm.System.currentTimeMillis(), 0, fs.listFiles(at, True)
        while found.hasNext():
            status = found.next()
            path = status.getPath()
            if path.toString().rsplit("/data/", 1)[1] not in live and now - status.getModificationTime() >= older_ms:
                fs.delete(path, False)
                count += 1
        return count


def query(spark, sf_dir: str) -> DataFrame:
    """op1: all documents through four arrivals and compaction, read back from the newest version."""
    docs = common.table(spark, sf_dir, "documents")
    store = ShardedTable(spark, f"{common.shared_dir(spark)}/sharded-{uuid.uuid4().hex}")
    arrivals = 4
    for i in range(arrivals):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)) == i))
    store.compact()
    store.vacuum()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))


ORACLE_SQL = "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents"
