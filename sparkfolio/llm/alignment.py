"""Whether two sequences are within an edit distance, by alignment in a band.

Equal ends are cut off first.  Two cheap bounds settle most pairs: bags of hashed
symbols that differ by more than the distance rule a pair out, and an alignment
with a single shift, where it is good enough, rules it in.  Others are aligned in
a band of diagonals that doubles until it holds the distance; a column of the
band is a bit vector, so a step costs a few operations on whole numbers.
"""

from __future__ import annotations

import numpy as np

#: Bins of a bag, and the count at which a bin stops.
BINS, FULL = 128, 255


def bags(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each row (its values begin at ``first``) how many values fall into each bin; bins stop at ``FULL``."""
    rows = len(first) - 1
    out = np.empty((rows, BINS), np.uint8)
    bins = (values >> np.uint64(7)).astype(np.int64) & (BINS - 1)
    for a in range(0, rows, 2048):
        b = min(a + 2048, rows)
        own = np.repeat(np.arange(b - a) * BINS, np.diff(first[a : b + 1])) + bins[first[a] : first[b]]
        out[a:b] = np.minimum(np.bincount(own, minlength=(b - a) * BINS), FULL).reshape(-1, BINS)
    return out


def most_edits(longer: np.ndarray, alike: float) -> np.ndarray:
    """The edits that a similarity of ``alike`` allows, for the longer length."""
    return np.floor(longer * (1 - alike) + 1e-9).astype(np.int64)


def bag_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number of edits that rows of bags are apart at least."""
    over = a > b
    more = np.where(over, a - b, 0).sum(axis=1, dtype=np.int64)
    less = np.where(over, 0, b - a).sum(axis=1, dtype=np.int64)
    return np.maximum(more, less)


def one_shift(a: np.ndarray, b: np.ndarray) -> int:
    """The edits of the best alignment that is straight but for one gap: no fewer than needed."""
    n = min(len(a), len(b))
    head = np.concatenate([[0], np.cumsum(a[:n] != b[:n])])
    tail = np.concatenate([[0], np.cumsum((a[len(a) - n :] != b[len(b) - n :])[::-1])])[::-1]
    return int((head + tail).min()) + abs(len(a) - len(b))


def banded(a: list, b: list, most: int) -> bool:
    """Whether ``b`` is at most ``most`` edits from ``a``: bit vectors of the band's vertical differences.

    Bit r of a column j stands for row j - most + r.  The band's lowest cell is
    followed down its diagonal to the last row, then along that row.
    """
    m, n = len(a), len(b)
    if abs(m - n) > most:
        return False
    if max(m, n) <= most:
        return True
    places: dict = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    state: dict = {}
    whole = (1 << (2 * most + 1)) - 1
    top = 1 << (2 * most)
    up, down = whole ^ ((1 << most) - 1), 0
    value, bit = min(most, m), 0
    for j, x in enumerate(b, 1):
        low = j - most - 1  # the row (from 0) of bit 0
        match = 0
        if own := places.get(x):
            match, before, at = state.get(x, (0, low, 0))
            match >>= low - before
            while at < len(own) and own[at] <= low + 2 * most:
                if own[at] >= low:
                    match |= 1 << (own[at] - low)
                at += 1
            state[x] = match, low, at
        zero = ((((match & up) + up) ^ up) | match | down) & whole
        right, left = down | (whole ^ (zero | up)), zero & up
        if j <= m - most:
            value += not zero & top
            if value > n - m + 2 * most:  # the rest can't make up for it
                return False
            bit = top
        else:
            bit = bit >> 1 if bit else 1 << (m - j + most)
            value += bool(right & bit) - bool(left & bit)
        half = zero >> 1
        up, down = (left | (whole ^ (half | right))) & whole, half & right
    return value <= most


def within(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether two arrays are at most ``most`` edits apart."""
    if abs(len(a) - len(b)) > most:
        return False
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    head = int(other[0]) if len(other) else n
    other = np.flatnonzero(a[len(a) - n + head :][::-1] != b[len(b) - n + head :][::-1])
    tail = int(other[0]) if len(other) else n - head
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if max(len(a), len(b)) <= most or one_shift(a, b) <= most:
        return True
    x, y = a.tolist(), b.tolist()
    band = max(16, abs(len(x) - len(y)))
    while band < most:
        if banded(x, y, band):
            return True
        band *= 4
    return banded(x, y, most)
