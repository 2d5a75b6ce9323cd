"""Removal of repeated word windows by difference-cover anchors.

A window is ``WINDOW`` consecutive words.  Two equal windows at any positions p
and q have a shift d < PERIOD at which p + d and q + d are both cover positions
modulo PERIOD (the cover's differences give every residue).  So it is enough to
hash shorter windows of ``WINDOW - PERIOD + 1`` words, at cover positions only:
any repeated window holds an aligned anchor whose hash occurs twice.  Anchors
6-bit hashes, and all but the first of equal windows are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, exchange
from .hashing import windows, word_hashes

WINDOW = 20
#: A perfect difference set, whose differences give each residue modulo 13.
PERIOD, COVER = 13, (0, 1, 3, 9)


def _anchors(window: int, buckets: int):
    reach = window - PERIOD + 1
    cover = np.zeros(PERIOD, dtype=bool)
    cover[list(COVER)] = True

    def emit(batch: int, part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> list:
        hashes, first = word_hashes(data, offsets, 1)
        count = np.diff(first)
        at = np.arange(len(hashes)) - np.repeat(first[:-1], count)
        left = np.repeat(count, count) - at
        # a document under one window long can't repeat one
        number = np.flatnonzero(cover[at % PERIOD] & (left >= reach) & (np.repeat(count, count) >= window))
        if not len(number):
            return []
        keys = windows(hashes, reach, 2)[number]
        order = np.argsort(keys, kind="stable")
        keys, number = keys[order], number[order].astype(np.uint32)
        new = np.ones(len(keys), dtype=bool)
        new[1:] = keys[1:] != keys[:-1]
        run = np.cumsum(new) - 1
        many = np.bincount(run)[run] > 1
        send = new
        out = exchange.to_buckets(batch, exchange.bucket_of(keys[send], buckets), buckets, keys[send], number[send])
        out.append((batch % buckets, batch, exchange.DOCS, exchange.pack(part.column("key").to_numpy(), first.astype(np.uint32))))
        out.append((batch % buckets, batch, exchange.ANSWER, exchange.pack(number[many])))
        return out

    return emit


def _shared(batches: list[int], payloads: list[list[np.ndarray]]) -> list:
    """The entries whose hash another batch has as well."""
    keys = np.concatenate([p[0] for p in payloads])
    number = np.concatenate([p[1] for p in payloads])
    owner = np.repeat(np.arange(len(payloads)), [len(p[0]) for p in payloads])
    order = np.argsort(keys, kind="stable")
    keys, number, owner = keys[order], number[order], owner[order]
    same = np.zeros(len(keys) + 1, dtype=bool)
    same[1:-1] = keys[1:] == keys[:-1]
    hit = same[1:] | same[:-1]
    return _to_owners(batches, owner[hit], number[hit])


def _to_owners(batches: list[int], owner: np.ndarray, number: np.ndarray) -> list:
    order = np.argsort(owner, kind="stable")
    owner, number = owner[order], number[order]
    cuts = np.searchsorted(owner, np.arange(len(batches) + 1))
    return [(0, batches[i], exchange.ANSWER, exchange.pack(number[cuts[i] : cuts[i + 1]])) for i in np.flatnonzero(np.diff(cuts)).tolist()]


def _windows(window: int, buckets: int):
    def emit(batch: int, part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> list:
        hashes, first = word_hashes(data, offsets, 1)
        number = []
        for base, end, spans in zip(first[:-1].tolist(), first[1:].tolist(), exchange.pairs(part.column("spans")), strict=True):
            number += [np.arange(base + lo, min(base + hi, end - window + 1)) for lo, hi in spans.tolist()]
        number = np.concatenate(number) if number else np.zeros(0, np.int64)
        if not len(number):
            return []
        keys = windows(hashes, window, 2)[number]
        del hashes
        more = (windows(word_hashes(data, offsets, 3)[0], window, 4)[number] >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((number, more, keys))
        keys, more, number = keys[order], more[order], number[order].astype(np.uint32)
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (more[1:] != more[:-1])
        table = part.column("key").to_numpy()
        doc = (np.searchsorted(first, number[new], side="right") - 1).astype(np.uint32)
        pos = (number[new] - first[doc]).astype(np.uint32)
        out = []
        for b, t, kind, payload in exchange.to_buckets(batch, exchange.bucket_of(keys[new], buckets), buckets, keys[new], more[new], doc, pos, number[new]):
            k, m, d, p, n = exchange.unpack(payload)
            used, d = np.unique(d, return_inverse=True)
            out.append((b, t, kind, exchange.pack(k, m, d.astype(np.uint32), p, n, table[used])))
        out.append((batch % buckets, batch, exchange.DOCS, exchange.pack(table, first.astype(np.uint32))))
        out.append((batch % buckets, batch, exchange.ANSWER, exchange.pack(number[~new])))
        return out

    return emit


def _later(batches: list[int], payloads: list[list[np.ndarray]]) -> list:
    """The entries whose window occurs in an earlier place of another batch."""
    keys, more, pos, number = (np.concatenate([p[i] for p in payloads]) for i in (0, 1, 3, 4))
    doc = np.concatenate([p[5][p[2]] for p in payloads])
    owner = np.repeat(np.arange(len(payloads)), [len(p[0]) for p in payloads])
    order = np.lexsort((pos, doc, more, keys))
    keys, more, number, owner = keys[order], more[order], number[order], owner[order]
    hit = np.zeros(len(keys), dtype=bool)
    hit[1:] = (keys[1:] == keys[:-1]) & (more[1:] == more[:-1])
    return _to_owners(batches, owner[hit], number[hit])


def repeats(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """The spans of words to remove, for documents that have any: ``key``, ``spans`` (packed pairs of int32).

    ``rows`` has ``key`` (unique, in the order in which documents count as earlier) and ``text``.
    """
    spark = rows.sparkSession
    if window < PERIOD:
        raise ValueError(f"a window holds at least {PERIOD} words")
    common.small_batches(spark)
    buckets = common.parts(spark, common.text_bytes(rows), exchange.BUCKET_BYTES)
    slim = rows.select("key", "text")
    anchors = exchange.answered(exchange.dealt(slim, _anchors(window, buckets)), _shared, buckets)
    near = common.written(exchange.returned(anchors, PERIOD - 1, 1), "anchors")
    del anchors  # else its shuffle files would stay
    common.swept(spark)
    # in the order of keys, as a merge join leaves them: a task that runs again makes the same batches
    around = slim.join(near, "key").sortWithinPartitions("key")
    wide = exchange.answered(exchange.dealt(around, _windows(window, buckets)), _later, buckets)
    out = common.written(exchange.returned(wide, 0, window), "windows")
    del around, wide
    common.dropped(spark, near)
    common.swept(spark)
    return out


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each document: ``id``, ``n_words``, ``removed`` (array of [start, end) words) and ``kept`` (text).

    A word goes if a window of ``window`` words covers it that starts earlier
    too: in a smaller id, or earlier in the same document.  Windows are judged on
    the input.  A null text has no words.  Of rows that share an id (or have
    none), the order of texts decides which is earlier; null ids come last.
    """
    rows = common.keyed(docs, id_col, text_col)
    joined = rows.join(repeats(rows, window), "key", "left").select("id", "text", "spans")
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("removed", T.ArrayType(span)), T.StructField("kept", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            for text, spans in zip(batch.column("text"), exchange.pairs(batch.column("spans")), strict=True):
                count, rest = _without(text, spans)
                counts.append(count)
                removed.append([{"start": a, "end": b} for a, b in spans.tolist()])
                kept.append(rest)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.string())], names=["id", "n_words", "removed", "kept"])

    return common.mapped(joined, run, schema)


def _without(text: pa.Scalar, spans: np.ndarray) -> tuple[int, str]:
    """Number of words, and the words outside the spans joined by one space."""
    own = text.as_py().encode().split() if text.is_valid else []
    rest, at = [], 0
    for a, b in spans.tolist():
        rest += own[at:a]
        at = b
    return len(own), b" ".join(rest + own[at:]).decode()


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated windows removed from their texts; texts that lose nothing stay as they are.

    Other columns stay, but for ``n_chars``, which follows the text where there
    is such a column.  A text that repeats as a whole becomes empty.
    """
    rows = common.keyed(docs, id_col, text_col, whole=True)
    joined = rows.join(repeats(rows, window), "key", "left").select("row", "text", "spans")
    schema = T.StructType([*joined.schema.fields[:1], T.StructField("kept", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [_without(text, spans)[1] if len(spans) else text.as_py() for text, spans in zip(batch.column("text"), exchange.pairs(batch.column("spans")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.string())], names=["row", "kept"])

    out = common.mapped(joined, run, schema)
    new = {text_col: F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """op6: every document without the 20-word windows that occur earlier."""
    out = deduplicated(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0), lambda a, s: a + s["end"] - s["start"]).cast("long")
    return out.select(F.col("id").alias("doc_id"), "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
  p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20),
  k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i : i + 19], ' ') ORDER BY doc_id, i) AS n FROM p),
  g AS (SELECT DISTINCT doc_id, i + o.range AS j FROM k, range(20) o WHERE n > 1),
  w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM d),
  s AS (SELECT w.doc_id, count(*) AS removed FROM w JOIN g ON g.doc_id = w.doc_id AND g.j = w.j GROUP BY 1),
  t AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.j) AS kept FROM w WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = w.doc_id AND g.j = w.j) GROUP BY 1)
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""
