"""Packed exchanges: how fingerprints of a batch of texts meet, and how answers come back.

Rows are ``(bucket, batch, kind, payload)``.  A map task packs the fingerprints
that it has for one bucket into one sorted array, after it has merged equal ones
of the batch; so a fingerprint that a third of all rows share is one entry a
batch in its bucket, never a row a document.  The bucket's task compares the
arrays and answers each batch with the numbers of the entries concerned.  A last
grouping by batch turns numbers into spans of documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .hashing import slices, text_buffer

ROWS = "bucket int, batch long, kind int, payload binary"
#: Fingerprints to compare; entry numbers as answers; the batch's documents; samples.
ENTRIES, ANSWER, DOCS, SAMPLE = 0, 1, 2, 3
SPANS = "key long, spans binary"
#: Bytes of text that are fingerprinted together.
BATCH_BYTES = 3 << 20
#: Bytes of text for each bucket.
BUCKET_BYTES = 24 << 20


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.char), len(a)))], dtype=np.int64)
    return b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def unpack(payload: bytes | memoryview) -> list[np.ndarray]:
    count = int(np.frombuffer(payload, np.int64, 1)[0])
    head = np.frombuffer(payload, np.int64, 1 + 2 * count)[1:].reshape(count, 2)
    at, out = 8 * (1 + 2 * count), []
    for char, n in head.tolist():
        kind = np.dtype(chr(char))
        out.append(np.frombuffer(payload, kind, n, at))
        at += n * kind.itemsize
    return out


def rows(found: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    b, t, k, p = zip(*found, strict=True) if found else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(t, pa.int64()), pa.array(k, pa.int32()), pa.array(p, pa.binary())], names=["bucket", "batch", "kind", "payload"])


def by_batch(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batch number, its rows in the order of keys, their bytes and offsets. Numbers are the same in every attempt of a task."""
    first = TaskContext.get().partitionId() << 32
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffer(batch.column("text"))
        for a, b in slices(offsets, most):
            part = batch.slice(a, b - a)
            part = part.take(pc.sort_indices(part.column("key")))
            yield first, part, *text_buffer(part.column("text"))
            first += 1


def dealt(frame: DataFrame, emit: Callable[..., list], schema: str = ROWS) -> DataFrame:
    """``emit(batch number, rows, bytes, offsets)`` over batches of ``key`` and ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part, data, offsets in by_batch(batches):
            if found := emit(number, part, data, offsets):
                yield rows(found)

    return common.mapped(frame, run, schema)


def to_buckets(batch: int, bucket: np.ndarray, buckets: int, *arrays: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """One packed row for each bucket that got entries; ``bucket`` is non-decreasing."""
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    return [(b, batch, ENTRIES, pack(*(a[cuts[b] : cuts[b + 1]] for a in arrays))) for b in np.flatnonzero(np.diff(cuts)).tolist()]


def answered(frame: DataFrame, reduce: Callable[[list[int], list[list[np.ndarray]]], list[tuple[int, int, int, bytes]]], buckets: int) -> DataFrame:
    """``reduce`` sees the packed entries of one bucket with their batch numbers; other rows pass.

    There are as many tasks as buckets, whatever the session's number of shuffle
    partitions, so what a task reads doesn't grow with the data.
    """

    def run(table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_numpy()
        own = np.flatnonzero(kinds == ENTRIES)
        parts = table.take(pa.array(own))
        payloads = [unpack(p.as_buffer()) for c in parts["payload"].chunks for p in c]
        found = reduce(parts["batch"].to_numpy().tolist(), payloads) if len(own) else []
        rest = table.take(pa.array(np.flatnonzero(kinds != ENTRIES)))
        return pa.concat_tables([pa.Table.from_batches([rows(found)]), rest.cast(rows([]).schema)])

    return common.grouped(frame.repartition(buckets, "bucket"), "bucket", run, ROWS)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket by the upper bits: hashes in order give buckets in order."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def spans_of(numbers: np.ndarray, starts: np.ndarray, back: int, ahead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end (within it) of the union of ``[n - back, n + ahead)``, cut at the document's ends."""
    numbers = np.unique(numbers.astype(np.int64))
    doc = np.searchsorted(starts, numbers, side="right") - 1
    low, high = np.maximum(numbers - back, starts[doc]), np.minimum(numbers + ahead, starts[doc + 1])
    return merged(doc, low - starts[doc], high - starts[doc])


def merged(doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of spans of each document; touching spans are one."""
    order = np.lexsort((low, doc))
    doc, low, high = doc[order], low[order], high[order]
    if not len(doc):
        return doc, low, high
    # a running maximum of ends that starts anew with each document
    wide = int(high.max()) + 1
    top = np.maximum.accumulate(high + doc * wide) - doc * wide
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (low[1:] > top[:-1])
    first = np.flatnonzero(new)
    return doc[first], low[first], top[np.append(first[1:], len(doc)) - 1]


def span_rows(keys: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.Table:
    """A row for each document that has spans: its key and pairs of int32."""
    docs, first = np.unique(doc, return_index=True)
    pairs = np.stack([low, high], axis=1).astype(np.int32)
    cut = np.append(first, len(doc))
    packed = [pairs[cut[i] : cut[i + 1]].tobytes() for i in range(len(docs))]
    return pa.table({"key": pa.array(keys[docs].astype(np.int64)), "spans": pa.array(packed, pa.binary())})


def returned(frame: DataFrame, back: int, ahead: int) -> DataFrame:
    """Answers by batch as spans by document: ``key``, ``spans``."""

    def run(table: pa.Table) -> pa.Table:
        got, keys, starts = [], None, None
        for kind, payload in zip(table["kind"].to_pylist(), table["payload"], strict=True):
            arrays = unpack(payload.as_buffer())
            if kind == DOCS:
                keys, starts = arrays
            elif kind == ANSWER:
                got.append(arrays[0])
        numbers = np.concatenate(got) if got else np.zeros(0, np.int64)
        return span_rows(keys, *spans_of(numbers, starts.astype(np.int64), back, ahead))

    return common.grouped(frame.where(F.col("kind").isin(ANSWER, DOCS)), "batch", run, SPANS)


def pairs(column: pa.Array) -> list[np.ndarray]:
    """Each row's spans as an array of pairs."""
    none = np.zeros((0, 2), np.int32)
    return [np.frombuffer(p.as_buffer(), np.int32).reshape(-1, 2) if p.is_valid else none for p in column]
