"""Vectorised hashes of words and word windows over Arrow text buffers.

A batch of texts is one contiguous byte buffer plus offsets, so all its words are
hashed with a handful of numpy passes and no loop over documents.

A word's hash is a polynomial of its seven-byte pieces, led by its length, modulo
the prime 2**61 - 1: different words agree for at most (pieces + 1) of all 2**61
bases, whatever their letters.  A window's hash joins halves in a tree whose
nodes are mixed, so no pattern of repeated words makes windows agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
PRIME = (1 << 61) - 1
#: Bytes of a text that are looked at together, and pieces beyond which a word is hashed on its own.
PIECE_BYTES, LONG_WORD = 1 << 20, 16
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOW = [U64((1 << 8 * n) - 1) for n in range(8)]


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64 bits that spreads every input bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def salted(seed: int, n: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def _base(seed: int) -> int:
    return int(salted(seed * 7919 + 13, 1)[0]) % (PRIME - 2) + 2


def times(a: np.ndarray, b: int) -> np.ndarray:
    """``a * b`` modulo the prime, for ``a`` and ``b`` below it."""
    high, low = a >> U64(32), a & U64(0xFFFFFFFF)
    b_high, b_low = U64(b >> 32), U64(b & 0xFFFFFFFF)
    mid, end = high * b_low + low * b_high, low * b_low
    out = ((high * b_high) << U64(3)) + (mid >> U64(29)) + ((mid & U64((1 << 29) - 1)) << U64(32)) + (end & U64(PRIME)) + (end >> U64(61))
    return reduced(out)


def reduced(x: np.ndarray) -> np.ndarray:
    x = (x & U64(PRIME)) + (x >> U64(61))
    np.subtract(x, U64(PRIME), out=x, where=x >= U64(PRIME))
    return x


def loads(data: np.ndarray) -> np.ndarray:
    """The 8 bytes that start at each position, as one number."""
    return np.ndarray(shape=(max(len(data) - 7, 0),), dtype="<u8", buffer=np.ascontiguousarray(data), strides=(1,))


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """A hash below the prime for each range of bytes ``[start, end)``, ranges in rising order."""
    base, size = _base(seed), end - start
    out = reduced(size.astype(U64) + U64(1))
    eight = loads(np.concatenate([data, np.zeros(8, np.uint8)]))
    low = np.array(_LOW, U64)
    short = np.flatnonzero((size > 0) & (size <= 7 * LONG_WORD))
    piece = 0
    while len(short):
        left = size[short] - 7 * piece
        out[short] = reduced(times(out[short], base) + (eight[start[short] + 7 * piece] & low[np.minimum(left, 7)]))
        short = short[left > 7]
        piece += 1
    for i in np.flatnonzero(size > 7 * LONG_WORD).tolist():
        own = data[start[i] : end[i]].tobytes()
        own += bytes(-len(own) % 7)
        parts = np.zeros((len(own) // 7, 8), np.uint8)
        parts[:, :7] = np.frombuffer(own, np.uint8).reshape(-1, 7)
        h = int(out[i])
        for p in parts.view("<u8").reshape(-1).tolist():
            h = (h * base + p) % PRIME
        out[i] = h
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and per row the index of its first word (one more entry than rows).

    Bytes are looked at in pieces, so beside 8 bytes a word the memory needed
    doesn't grow with the longest text.
    """
    hashes, first, at = [], [np.zeros(1, np.int64)], 0
    count = 0
    for a, b in slices(offsets, PIECE_BYTES):
        low, high = int(offsets[a]), int(offsets[b])
        if b - a > 1 or high - low <= PIECE_BYTES:
            start, end, own = words(data[low:high], offsets[a : b + 1] - low)
            hashes.append(range_hashes(data[low:high], start, end, seed))
            first.append(own[1:] + count)
            count += len(start)
            continue
        at = low
        while at < high:  # one long text: pieces end at white space
            to = min(at + PIECE_BYTES, high)
            if to < high:
                white = np.flatnonzero(_WHITE[data[at:to]])
                while not len(white) and to < high:
                    to = min(to + PIECE_BYTES, high)
                    white = np.flatnonzero(_WHITE[data[at:to]])
                to = at + int(white[-1]) + 1 if len(white) and to < high else to
            start, end, _ = words(data[at:to], np.array([0, to - at]))
            hashes.append(range_hashes(data[at:to], start, end, seed))
            count += len(start)
            at = to
        first.append(np.array([count], np.int64))
    return np.concatenate(hashes) if hashes else np.zeros(0, U64), np.concatenate(first)


def windows(values: np.ndarray, size: int, seed: int) -> np.ndarray:
    """The hash of every ``size`` consecutive values: of ``values[i : i + size]`` at i."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    salt, odd = salted(seed * 104729 + 7, 1)[0], salted(seed * 15485863 + 3, 1)[0] | U64(1)
    level = mix64(values.astype(U64, copy=False) + salt)
    out, covered, span = None, 0, 1
    while True:
        if size & span:
            part = level[covered : covered + n]
            out = part if out is None else mix64(out * odd + part)
            covered += span
        if covered == size:
            return out
        level = mix64(level[:-span] * odd + level[span:])
        span *= 2


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets (one more than rows) of a string or binary column; null: empty."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int):
    """Row ranges of at most ``most`` bytes each (a longer text is a range of its own)."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of the words ``[^\\x20\\x09-\\x0D]+`` and, per row, the first word's index.

    The third array has one more entry than there are rows.
    """
    n = len(data)
    inside = ~_WHITE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)
