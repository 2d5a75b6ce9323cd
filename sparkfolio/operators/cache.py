"""A content cache over tables: two-level lookup behind a Bloom filter, pins, and keeping to a size.

Most lookups of a first run are misses.  A Bloom filter of the known keys, built by
an aggregate and shipped only if its measured size allows, keeps those rows out of
the join's shuffle; what it lets through is joined exactly, so it changes no result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as sc
from ..sources.shared import written
from .selection import evictions

#: Bits a key and hashes of the filter (about one false positive in a hundred), and its largest size in bytes.
BITS, HASHES, MOST_BYTES = 10, 7, 32 << 20


def _places(key: Column, bits: int) -> list[Column]:
    """The bits that a key sets: two hashes, stepped."""
    first, step = F.pmod(F.xxhash64(F.lit(1), key), F.lit(bits)), F.pmod(F.xxhash64(F.lit(2), key), F.lit(bits))
    return [F.pmod(first + k * step, F.lit(bits)) for k in range(HASHES)]


def bloom_filter(keys: DataFrame, column: str, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, int] | None:
    """One row with the filter's ``words`` (64 bits each) and the number of its bits; None where it would be too large."""
    bits = max(64, -(-keys.where(F.col(column).isNotNull()).count() * BITS // 64) * 64)
    if bits // 8 > most_bytes:
        return None
    spots = keys.where(F.col(column).isNotNull()).select(F.explode(F.array(*_places(F.col(column), bits))).alias("at"))
    words = spots.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("b"))
    every = keys.sparkSession.range(bits // 64).join(F.broadcast(words), F.col("id") == F.col("word"), "left")
    row = every.groupBy().agg(F.transform(F.sort_array(F.collect_list(F.struct("id", F.coalesce("b", F.lit(0)).alias("b")))), lambda w: w["b"]).alias("words"))
    return written(row, "bloom"), bits


def might_hold(words: Column, bits: int, key: Column) -> Column:
    """False only for keys that the filter never saw."""
    tests = [F.shiftrightunsigned(F.get(words, F.floor(p / 64).cast("int")), 0).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (p % 64).cast("int"))) != 0 for p in _places(key, bits)]
    found = tests[0]
    for t in tests[1:]:
        found &= t
    return F.coalesce(found, F.lit(False))


def left_lookup(rows: DataFrame, key: str, known: DataFrame, known_key: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``rows`` left joined to ``known`` (unique ``known_key``), where rows that surely miss aren't shuffled."""
    made = bloom_filter(known, known_key, most_bytes)
    match = F.col(key) == F.col(known_key)
    if made is None:
        return rows.join(known, match, "left")
    filter_, bits = made
    tested = rows.join(F.broadcast(filter_)).withColumn("_may", might_hold(F.col("words"), bits, F.col(key))).drop("words")  # one row of at most most_bytes
    nothing = [F.lit(None).cast(t).alias(c) for c, t in known.dtypes]
    missed = tested.where(~F.col("_may")).select(*rows.columns, *nothing)
    return tested.where("_may").drop("_may").join(known, match, "left").select(*rows.columns, *known.columns).unionByName(missed)


def looked_up(files: DataFrame, stamps: DataFrame, records: DataFrame, fresh: Callable[[DataFrame], DataFrame], readable: Column, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``files`` (path, size, modified) as ``path``, ``hash``, ``error``, ``state``, ``restamp`` and the columns of ``records``, written.

    A file whose stamp is known and unchanged has the stamp's hash; ``fresh`` reads
    the others (path) and gives path, hash and error.  ``records`` has a unique
    ``hash``; its columns come with the path of the file, whatever path they were
    made from.  ``state`` is hit, miss (no record, or one that is not ``readable``)
    or failed (no hash); ``restamp`` marks files whose stamp is to be written.
    """
    old = stamps.select(F.col("path").alias("_path"), F.col("size").alias("_size"), F.col("modified").alias("_modified"), F.col("hash").alias("_hash"))
    seen = left_lookup(files.select("path", "size", "modified"), "path", old, "_path", most_bytes)
    same = (F.col("size") == F.col("_size")) & (F.col("modified") == F.col("_modified"))
    seen = written(seen.select("path", "size", "modified", F.when(same, F.col("_hash")).alias("known")), "seen")
    read = fresh(seen.where("known IS NULL").select("path")).select(F.col("path").alias("_read"), F.col("hash").alias("_new"), "error")
    hashed = seen.join(read, F.col("path") == F.col("_read"), "left")
    stamped = F.col("size").isNotNull() & F.col("modified").isNotNull()
    hashed = hashed.select("path", "size", "modified", F.coalesce("known", "_new").alias("hash"), "error", (F.col("known").isNull() & F.col("_new").isNotNull() & stamped).alias("restamp"))
    own = [c for c in records.columns if c not in ("hash", "path")]
    found = left_lookup(hashed, "hash", records.select(F.col("hash").alias("_of"), *own), "_of", most_bytes)
    state = F.when(F.col("hash").isNull(), "failed").when(F.col("_of").isNotNull() & F.coalesce(readable, F.lit(False)), "hit").otherwise("miss")
    return written(found.withColumn("state", state).drop("_of"), "lookup")


def marks(lookup: DataFrame, failed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a lookup changes among the failure marks (``key``): those to clear, and those to add with path and error."""
    keyed = lookup.where("size IS NOT NULL AND modified IS NOT NULL").withColumn("key", sc.failure_key(F.col("size"), F.col("modified")))
    clear = failed.select("key").join(keyed.where("state != 'failed'").select("key"), "key", "left_semi")
    add = keyed.where("state = 'failed'").join(failed.select("key"), "key", "left_anti").groupBy("key").agg(F.min(F.struct("path", "error")).alias("first"))
    return clear, add.select("key", "first.path", "first.error")


def under_folders(stamps: DataFrame, folders: DataFrame) -> DataFrame:
    """The stamps (path, hash) that are one of the folders or lie below it: an equi-join of every ancestor of a path."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    wanted = folders.select(F.regexp_replace("folder", "/+$", "").alias("_folder")).distinct()
    return stamps.select("path", "hash", F.explode(above).alias("_above")).join(wanted, F.col("_above") == F.col("_folder")).select("path", "hash").distinct()


def pins(live: DataFrame, photos: DataFrame, overrides: DataFrame, drafts: DataFrame, stamps: DataFrame) -> DataFrame:
    """Each ``hash`` that must stay: of live runs, of projects, of their overrides, and of drafts by override or folder.

    ``drafts`` has ``json`` texts; one that can't be read pins nothing.
    """
    draft = drafts.select(F.from_json("json", "overrides map<string,string>, folders array<string>").alias("d"))
    named = draft.select(F.explode(F.map_keys("d.overrides")).alias("hash"))
    below = under_folders(stamps, draft.select(F.explode("d.folders").alias("folder")).where("folder IS NOT NULL")).select("hash")
    sources = [live.select("hash"), photos.select("hash"), overrides.select("hash"), named, below]
    found = sources[0]
    for s in sources[1:]:
        found = found.unionByName(s)
    return found.where("hash IS NOT NULL").distinct()


def enforced(rows: DataFrame, thumbs: DataFrame, pinned: DataFrame, version: int, limit: int) -> DataFrame:
    """``hash``, ``bytes`` and ``outcome`` of each cached row (hash, bytes, last_used, version) and thumbnail (hash, bytes).

    Rows of another version are stale and go whatever the limit; a thumbnail with
    neither a current row nor a pin is an orphan and goes too.  Of the rest a hash
    is one entry, a thumbnail alone is as old as can be, and the least recently
    used go until what stays fits ``limit``; pinned ones never go.
    """
    held = pinned.select(F.col("hash").alias("_pin")).distinct()
    current = rows.where(F.col("version") == version).select("hash", "bytes", "last_used")
    pictures = thumbs.select(F.col("hash").alias("_thumb"), F.col("bytes").alias("_bytes"))
    both = current.join(pictures, F.col("hash") == F.col("_thumb"), "full_outer").withColumn("_key", F.coalesce("hash", "_thumb"))
    both = both.join(held, F.col("_key") == F.col("_pin"), "left")
    orphan = F.col("hash").isNull() & F.col("_pin").isNull()
    size = F.coalesce("bytes", F.lit(0)) + F.coalesce("_bytes", F.lit(0))
    both = written(both.select(F.col("_key").alias("hash"), size.alias("bytes"), F.coalesce("last_used", F.lit(0)).alias("last_used"), F.col("_pin").isNotNull().alias("pinned"), orphan.alias("orphan")), "entries")
    entries = evictions(both.where("NOT orphan"), "last_used", "hash", "bytes", "pinned", limit)
    out = entries.select("hash", "bytes", F.when(F.col("evict"), "evicted").otherwise("kept").alias("outcome"))
    out = out.unionByName(both.where("orphan").select("hash", "bytes", F.lit("orphan").alias("outcome")))
    return out.unionByName(rows.where(F.col("version") != version).select("hash", "bytes", F.lit("stale").alias("outcome")))
