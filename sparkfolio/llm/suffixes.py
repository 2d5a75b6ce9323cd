"""Removal of repeated byte strings by a sparse suffix array, merge-sorted in a distributed way.

Which suffixes: a window slides over k-gram hashes and the leftmost smallest one
is the anchor of the window's position.  Equal strings of ``LENGTH`` bytes have
their anchors at the same place, so every position p belongs to the suffix that
starts at its anchor, and all positions of one anchor form one *unit*.  Units
whose first ``LENGTH - SPREAD + 1`` bytes after the anchor occur nowhere else
can't be in a repeated string; a first exchange of prefix hashes drops them, as
the exchange of distinguishing prefixes does in distributed string sorting.

How they are sorted: each batch sorts its suffixes (up to ``LENGTH`` bytes, all
that matters), merges equal ones, and sends every range of the key space a
front-coded run: shared prefix length, then the rest.  A range's task merges its
runs with a loser tree that keeps for each loser the prefix it shares with the
string that beat it, so known prefixes are never compared again, and the merge
yields the common prefixes of neighbours in the suffix array for free.

What is repeated: neighbours that share the prefix form a group; within it the
strings of ``LENGTH`` bytes at each unit's positions are counted over all
occurrences, and those found twice go back to their batches.  Strings are put
together by a rolling hash, and then compared byte by byte.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, exchange
from .hashing import U64, loads, mix64, salted

LENGTH = 200
#: Bytes of the hashed k-grams, and k-grams for each choice of an anchor.
GRAM, SPREAD = 8, 128
#: Prefixes that a batch offers for the choice of range borders, and borders' sample.
OFFERED, SAMPLED = 16, 20_000
#: Bytes of whole groups whose strings are compared together.
FLUSH_BYTES = 1 << 20
UNITS = 4  # kind of the rows that keep what a batch's numbers mean


def units(data: np.ndarray, offsets: np.ndarray, length: int, spread: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, first and last position, and anchor of every unit."""
    none = np.zeros(0, np.int64)
    size = np.diff(offsets)
    if len(data) < length or not (size >= length).any():
        return none, none, none, none
    grams = loads(data)
    best = (mix64(grams) & ~U64(0xFFFFFFFF)) | np.arange(len(grams), dtype=U64)
    step = 1
    while step < spread:  # minima over windows of doubling length
        best = np.minimum(best[:-step], best[step:])
        step *= 2
    anchor = (best & U64(0xFFFFFFFF)).astype(np.int64)
    # the positions where a string of that length fits into the document
    edge = np.zeros(len(data) + 1, np.int8)
    fits = size >= length
    np.add.at(edge, offsets[:-1][fits], 1)
    np.add.at(edge, offsets[1:][fits] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(edge[:-1]))
    chosen = anchor[at]
    doc_first = np.zeros(len(data) + 1, dtype=bool)
    doc_first[offsets[:-1]] = True
    new = np.ones(len(at), dtype=bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | doc_first[at[1:]] | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    low = at[first]
    return np.searchsorted(offsets, low, side="right") - 1, low, at[last], chosen[first]


def _prefix_hash(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` bytes (8 at least) from each position on."""
    eight = loads(data)
    out = np.zeros(len(at), U64)
    for offset in [*range(0, length - 7, 8), length - 8]:
        out = mix64((out ^ eight[at + offset]) + U64(0x9E3779B97F4A7C15))
    return out


def _candidates(length: int, spread: int, buckets: int):
    prefix = length - spread + 1

    def emit(batch: int, part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> list:
        doc, _, _, anchor = units(data, offsets, length, spread)
        if not len(doc):
            return []
        keys = _prefix_hash(data, anchor, prefix)
        order = np.argsort(keys, kind="stable")
        keys, number = keys[order], order.astype(np.uint32)
        new = np.ones(len(keys), dtype=bool)
        new[1:] = keys[1:] != keys[:-1]
        run = np.cumsum(new) - 1
        many = np.bincount(run)[run] > 1
        out = exchange.to_buckets(batch, exchange.bucket_of(keys[new], buckets), buckets, keys[new], number[new])
        first = np.searchsorted(doc, np.arange(len(offsets)))
        out.append((batch % buckets, batch, exchange.DOCS, exchange.pack(part.column("key").to_numpy(), first.astype(np.uint32))))
        out.append((batch % buckets, batch, exchange.ANSWER, exchange.pack(number[many])))
        return out

    return emit


def _samples(length: int, spread: int):
    """A few suffix prefixes of each batch of candidates, chosen by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part, data, offsets in exchange.by_batch(batches):
            doc, _, _, anchor = units(data, offsets, length, spread)
            chosen = _flagged(part, doc, offsets)
            at = anchor[chosen][:: max(1, len(chosen) // OFFERED)]
            yield pa.RecordBatch.from_arrays([pa.array([data[a : a + length - spread + 1].tobytes() for a in at.tolist()], pa.binary())], names=["sample"])

    return run


def _flagged(part: pa.RecordBatch, doc: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The numbers of the units that the spans of their documents name."""
    first = np.searchsorted(doc, np.arange(len(offsets)))
    out = [np.arange(first[i] + a, first[i] + b) for i, own in enumerate(exchange.pairs(part.column("spans"))) for a, b in own.tolist()]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def front_coded(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For sorted strings: the prefix that each shares with the one before, and the joined rests."""
    shared, rests, before = [], [], b""
    for s in strings:
        n = common_prefix(before, s, 0)
        shared.append(n)
        rests.append(s[n:])
        before = s
    return np.array(shared, np.uint16), np.frombuffer(b"".join(rests), np.uint8)


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the shared prefix, given that ``known`` bytes are shared."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8 if x else n


class Run:
    """A front-coded sorted run, decoded one string at a time."""

    __slots__ = ("shared", "sizes", "rests", "at", "byte", "now", "lcp")

    def __init__(self, shared: np.ndarray, sizes: np.ndarray, rests: np.ndarray):
        self.shared, self.sizes, self.rests = shared.tolist(), sizes.tolist(), rests.tobytes()
        self.at, self.byte, self.now, self.lcp = -1, 0, b"", 0

    def advance(self) -> bool:
        """Decode the next string; ``lcp`` is what it shares with the one before in this run."""
        self.at += 1
        if self.at >= len(self.shared):
            return False
        n = self.shared[self.at]
        end = self.byte + self.sizes[self.at] - n
        self.now = self.now[:n] + self.rests[self.byte : end]
        self.byte, self.lcp = end, n
        return True


def merge(runs: list[Run]) -> Iterator[tuple[int, int, bytes, int]]:
    """Run, number in it, string, and prefix shared with the string before, in the order of all strings.

    A loser tree: each inner node holds the run that lost there and the length
    of the prefix that it shares with its winner.  A string coming up is compared
    with losers by these lengths alone, and by bytes only where they are equal,
    from that length on.
    """
    k = 1
    while k < max(len(runs), 1):
        k *= 2
    strings: list[bytes | None] = [None] * k
    for i, run in enumerate(runs):
        if run.advance():
            strings[i] = run.now
    losers, shares = [-1] * k, [0] * k

    def play(a: int, la: int, b: int, lb: int) -> tuple[int, int, int, int]:
        """Winner with the prefix it shares with the last output; loser with what it shares with the winner."""
        x, y = strings[a], strings[b]
        if x is None:
            return b, lb, a, 0
        if y is None:
            return a, la, b, 0
        if la > lb:  # the longer shares with the last output, the smaller it is
            return a, la, b, lb
        if lb > la:
            return b, lb, a, la
        n = common_prefix(x, y, la)
        if x[n:] < y[n:] or (len(x) == n == len(y) and a < b):
            return a, la, b, n
        return b, lb, a, n

    def build(node: int) -> tuple[int, int]:
        if node >= k:
            return node - k, 0
        a, la = build(2 * node)
        b, lb = build(2 * node + 1)
        winner, share, losers[node], shares[node] = play(a, la, b, lb)
        return winner, share

    winner, share = build(1) if k > 1 else (0, 0)
    while strings[winner] is not None:
        run = runs[winner]
        yield winner, run.at, strings[winner], share
        if run.advance():
            strings[winner], share = run.now, run.lcp
        else:
            strings[winner], share = None, 0
        node = (winner + k) >> 1
        while node:
            winner, share, losers[node], shares[node] = play(winner, share, losers[node], shares[node])
            node >>= 1


def _runs(length: int, spread: int, borders: list[bytes]):
    """Sorted, front-coded runs of a batch's suffixes, one for each range that gets any."""
    prefix = length - spread + 1
    ranges = len(borders) + 1

    def emit(batch: int, part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> list:
        doc, low, high, anchor = units(data, offsets, length, spread)
        chosen = _flagged(part, doc, offsets)
        if not len(chosen):
            return []
        low, high, anchor = low[chosen], high[chosen], anchor[chosen]
        whole = data.tobytes()
        # by the suffix, then by what lies before the anchor
        items = [(whole[a : h + length], whole[lo:a]) for lo, h, a in zip(low.tolist(), high.tolist(), anchor.tolist(), strict=True)]
        order = sorted(range(len(items)), key=items.__getitem__)
        entry = np.empty(len(order), np.int64)
        distinct: list[tuple[bytes, bytes]] = []
        counts: list[int] = []
        for i in order:
            if distinct and distinct[-1] == items[i]:
                counts[-1] += 1
            else:
                distinct.append(items[i])
                counts.append(1)
            entry[i] = len(distinct) - 1
        cuts = [0, *(bisect_left(distinct, (b,)) for b in borders), len(distinct)]
        out = []
        for r in range(ranges):
            a, b = cuts[r], cuts[r + 1]
            if a < b:
                part_of = distinct[a:b]
                shared, rests = front_coded([s for s, _ in part_of])
                out.append((r, batch, exchange.ENTRIES, exchange.pack(
                    shared, np.array([len(s) for s, _ in part_of], np.uint16), rests,
                    np.array([len(x) for _, x in part_of], np.uint16), np.frombuffer(b"".join(x for _, x in part_of), np.uint8),
                    np.minimum(counts[a:b], 2).astype(np.uint8), np.arange(a, b, dtype=np.uint32))))
        used, rank = np.unique(doc[chosen], return_inverse=True)
        keys = part.column("key").to_numpy()[used]
        out.append((batch % ranges, batch, UNITS, exchange.pack(keys, rank.astype(np.uint32), (low - offsets[doc[chosen]]).astype(np.uint32), entry.astype(np.uint32))))
        return out

    assert prefix >= 8
    return emit


def string_classes(data: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """A number for each place in ``at`` (rising within ``group``): equal where the ``length`` bytes from there on are, and the group.

    A rolling hash puts places together; then each is compared by bytes with the
    first of its number.  Runs of places that follow each other, whose firsts do
    too, are compared as one stretch.
    """
    odd = int(salted(5 * 7919 + 13, 1)[0]) | 1
    power = np.full(len(data) + 1, odd, U64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    prefix = np.zeros(len(data) + 1, U64)
    np.cumsum(salted(5, 256)[data] * power[1:], out=prefix[1:])
    # the sums of a later place are larger by a power: bring all to the last one
    keys = mix64((prefix[at + length] - prefix[at]) * power[len(data) - at]) ^ mix64(group.astype(U64))
    del prefix, power
    _, first, same = np.unique(keys, return_index=True, return_inverse=True)
    mine = np.flatnonzero(first[same] != np.arange(len(at)))
    if not len(mine):
        return same
    a, b = at[mine], at[first[same[mine]]]
    new = np.ones(len(mine), dtype=bool)
    new[1:] = (a[1:] != a[:-1] + 1) | (b[1:] != b[:-1] + 1) | (group[mine][1:] != group[mine][:-1])
    begin = np.flatnonzero(new)
    sizes = np.diff(np.append(begin, len(mine))) + length - 1
    wrong = np.flatnonzero(group[mine] != group[first[same[mine]]])
    for lo in range(0, len(begin), 1 << 12):
        n = sizes[lo : lo + (1 << 12)]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        own = begin[lo : lo + (1 << 12)]
        differ = data[np.repeat(a[own], n) + step] != data[np.repeat(b[own], n) + step]
        if differ.any():
            bad = np.unique(np.repeat(np.arange(lo, lo + len(n)), n)[differ])
            ends = np.append(begin, len(mine))
            wrong = np.concatenate([wrong, *(np.arange(ends[i], ends[i + 1]) for i in bad.tolist())])
    if len(wrong):  # different strings of one hash: number these by their bytes
        own: dict[tuple[int, int, bytes], int] = {}
        count = len(first)
        for i in np.flatnonzero(np.isin(same, same[mine[wrong]])).tolist():
            same[i] = own.setdefault((int(same[i]), int(group[i]), data[at[i] : at[i] + length].tobytes()), count + len(own))
    return same


def _repeated(length: int, spread: int):
    """Merge the runs of a range and find the repeated strings of their units."""
    prefix = length - spread + 1

    def strings(texts: list[bytes], group: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of some whole groups' units, and from where to where, start strings found twice."""
        weight = np.bincount(group - group[0], weights=times)[group - group[0]]
        keep = np.flatnonzero(weight > 1)  # the others stand alone
        if not len(keep):
            return keep, keep, keep
        sizes = np.array([len(texts[i]) for i in keep.tolist()], np.int64)
        data = np.frombuffer(b"".join([texts[i] for i in keep.tolist()]), np.uint8)
        places = sizes - length + 1
        which = np.repeat(np.arange(len(keep)), places)
        inner = np.arange(len(which)) - np.repeat(np.cumsum(places) - places, places)
        same = string_classes(data, (np.cumsum(sizes) - sizes)[which] + inner, group[keep][which], length)
        found = np.bincount(same, weights=times[keep][which])[same] > 1
        unit, low, high = exchange.merged(which[found], inner[found], inner[found] + 1)
        return keep[unit], low, high

    def reduce(batches: list[int], payloads: list[list[np.ndarray]]) -> list:
        lefts = []
        for p in payloads:
            lefts.append((p[4].tobytes(), [0, *np.cumsum(p[3].astype(np.int64)).tolist()], p[5].tolist()))
        got: list[tuple[np.ndarray, ...]] = []
        texts, group, times, owner, number = [], [], [], [], []
        held, open_group = 0, -1

        def flush() -> None:
            unit, low, high = strings(texts, np.array(group), np.array(times, np.int64))
            got.append((np.array(owner)[unit], np.array(number)[unit], low, high))
            for x in (texts, group, times, owner, number):
                x.clear()

        for r, i, right, share in merge([Run(p[0], p[1], p[2]) for p in payloads]):
            if share < prefix:
                open_group += 1
                if held > FLUSH_BYTES:
                    flush()
                    held = 0
            body, at, counts = lefts[r]
            texts.append(body[at[i] : at[i + 1]] + right)
            held += len(texts[-1])
            group.append(open_group)
            times.append(counts[i])
            owner.append(r)
            number.append(i)
        if texts:
            flush()
        if not got:
            return []
        own, at, low, high = (np.concatenate([g[i] for g in got]).astype(np.int64) for i in range(4))
        firsts = np.cumsum([0, *(len(p[5]) for p in payloads)])
        entry = np.concatenate([p[6] for p in payloads])[firsts[own] + at]
        order = np.argsort(own, kind="stable")
        own, entry, low, high = own[order], entry[order], low[order], high[order]
        cuts = np.searchsorted(own, np.arange(len(batches) + 1))
        return [(0, batches[b], exchange.ANSWER, exchange.pack(*(x[cuts[b] : cuts[b + 1]].astype(np.uint32) for x in (entry, low, high)))) for b in np.flatnonzero(np.diff(cuts)).tolist()]

    return reduce


def _byte_spans(length: int):
    """A batch's answers for its distinct suffixes as spans of its documents' bytes."""

    def run(table: pa.Table) -> pa.Table:
        got, mine = [], None
        for kind, payload in zip(table["kind"].to_pylist(), table["payload"], strict=True):
            arrays = exchange.unpack(payload.as_buffer())
            if kind == UNITS:
                mine = arrays
            else:
                got.append(arrays)
        keys, rank, low, entry = mine
        if not got:
            return exchange.span_rows(keys, *(np.zeros(0, np.int64),) * 3)
        answer, lo, hi = (np.concatenate([g[i] for g in got]).astype(np.int64) for i in range(3))
        order = np.argsort(answer, kind="stable")
        answer, lo, hi = answer[order], lo[order], hi[order]
        a, b = np.searchsorted(answer, entry, side="left"), np.searchsorted(answer, entry, side="right")
        unit = np.repeat(np.arange(len(entry)), b - a)
        which = np.arange(len(unit)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
        base = low[unit].astype(np.int64)
        return exchange.span_rows(keys, *exchange.merged(rank[unit].astype(np.int64), base + lo[which], base + hi[which] - 1 + length))

    return run


def repeats(rows: DataFrame, length: int = LENGTH, spread: int | None = None) -> DataFrame:
    """The spans of bytes to remove, for documents that have any: ``key``, ``spans`` (packed pairs of int32).

    ``rows`` has ``key`` (unique) and ``text``.
    """
    spark = rows.sparkSession
    if spread is None:
        spread = SPREAD
        while spread > 1 and length - spread + 1 < 2 * GRAM + 1:
            spread //= 2
    if length - spread + 1 < GRAM:
        raise ValueError(f"the length is {2 * GRAM} bytes at least")
    common.small_batches(spark)
    buckets = common.parts(spark, common.text_bytes(rows), exchange.BUCKET_BYTES)
    slim = rows.select("key", "text")
    from .substrings import _shared

    first = exchange.answered(exchange.dealt(slim, _candidates(length, spread, buckets)), _shared, buckets)
    near = common.written(exchange.returned(first, 0, 1), "prefixes")
    del first  # else its shuffle files would stay
    common.swept(spark)
    around = common.written(slim.join(near, "key"), "candidates")
    sample = common.mapped(around, _samples(length, spread), "sample binary")
    sample = sorted(r[0] for r in sample.orderBy(F.xxhash64("sample"), "sample").limit(SAMPLED).collect())
    borders = sorted({sample[len(sample) * i // buckets] for i in range(1, buckets)}) if len(sample) > buckets else []
    runs = exchange.answered(exchange.dealt(around, _runs(length, spread, borders)), _repeated(length, spread), len(borders) + 1)
    out = common.written(common.grouped(runs, "batch", _byte_spans(length), exchange.SPANS), "repeats")
    common.dropped(spark, near, around)
    del near, around, runs
    common.swept(spark)
    return out


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row for each document: ``id``, ``n_bytes``, ``removed`` (array of [start, end) bytes) and ``kept`` (binary).

    A byte goes if a string of ``length`` bytes covers it that also starts
    anywhere else, in the same document too.  Strings are judged on the input and
    never cross documents.  A null text is empty.  Rows that share an id, or have
    none, are separate documents.
    """
    rows = common.keyed(docs, id_col, text_col)
    spans = repeats(rows, length)
    joined = rows.join(spans, "key", "left").select("id", "text", "spans")
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("removed", T.ArrayType(span)), T.StructField("kept", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            for text, spans in zip(batch.column("text"), exchange.pairs(batch.column("spans")), strict=True):
                own = text.as_py().encode() if text.is_valid else b""
                counts.append(len(own))
                removed.append([{"start": a, "end": b} for a, b in spans.tolist()])
                rest, at = [], 0
                for a, b in spans.tolist():
                    rest.append(own[at:a])
                    at = b
                kept.append(b"".join([*rest, own[at:]]))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())], names=["id", "n_bytes", "removed", "kept"])

    return common.mapped(joined, run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: every document without the strings of 200 bytes that occur elsewhere too."""
    out = deduplicated(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0), lambda a, s: a + s["end"] - s["start"]).cast("long")
    return out.select(F.col("id").alias("doc_id"), "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
