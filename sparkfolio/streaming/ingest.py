"""Micro-batch ingest and event-time sessions with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ramp(first: int = 4, most: int = 16) -> list[int]:
    """Batch sizes that double up to the largest, which then stays."""
    out = [first]
    while out[-1] < most:
        out.append(min(most, out[-1] * 2))
    return out


def ingest(stream: DataFrame, known: Callable[[], DataFrame], key: str, work: Callable[[DataFrame], DataFrame], save: Callable[[DataFrame], None], checkpoint: str, progress: Callable[[dict], None] | None = None) -> StreamingQuery:
    """Each micro-batch: keys that are known are skipped, the others worked on and saved.

    ``save`` is an upsert by key, so a batch that runs again after a failure
    leaves the same table.  ``progress`` gets cumulative counts.
    """
    total = {"scanned": 0, "cached": 0, "saved": 0}

    def batch(df: DataFrame, epoch: int) -> None:
        df = df.dropDuplicates([key]).persist()
        fresh = df.join(known().select(key), key, "left_anti")
        done = work(fresh).persist()
        scanned, saved = df.count(), done.count()  # before saving: a write to what ``known`` reads drops the cache
        save(done)
        for name, n in (("scanned", scanned), ("cached", scanned - saved), ("saved", saved)):
            total[name] += n
        done.unpersist()
        df.unpersist()
        if progress:
            progress(dict(total))

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()


def sessions(stream: DataFrame, keys: list[str], time: str, gap: str, late: str) -> DataFrame:
    """Event-time sessions that close ``late`` after their gap; rows without a time are left out."""
    window = F.session_window(time, gap)
    return stream.where(F.col(time).isNotNull()).withWatermark(time, late).groupBy(*keys, window.alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
