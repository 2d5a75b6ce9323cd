"""What a set of records derives as a whole: near-duplicate clusters, events, percentiles and who is kept."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as sc
from ..sources.shared import written
from . import cluster, joins, selection
from .running import gap_numbers, percentile_of, placed
from .windows import nearest_same_bucket

#: Seconds between near-duplicates at most, between events at least, and of a day.
SPAN, EVENT_GAP, DAY = 120, 14_400, 86_400


#: Rows of a side in one block of vectors, and pairs of which distances are held at a time.
BLOCK, HELD = 4096, 1 << 20


def _flat(vectors: np.ndarray, left: bool) -> np.ndarray:
    """Vectors of a side with two places more: a product of both sides' rows is minus half their squared distance or more.

    The room is over what single precision rounds away; where squares could
    overflow the product is NaN.
    """
    squares = (vectors * vectors).sum(axis=1)
    half = np.where(squares < 1e30, -0.5 * (1 - (vectors.shape[1] + 8) * 2.0**-22) * squares, np.nan)
    more = (half, np.ones(len(half))) if left else (np.ones(len(half)), half)
    return np.column_stack([vectors, *more]).astype("float32")


def near_in_block(some: pd.DataFrame, others: pd.DataFrame, id_col: str, vector: str, bits: str, most: float, most_bits: int, close: float) -> pd.DataFrame:
    """Pairs ``a`` < ``b`` of two sides with ``distance`` and ``bits`` that can be links.

    One product of matrices tells, with room for its rounding, which vectors are
    far apart; of the others that are close or have few differing bits, distances
    are summed place by place, as ``sc.l2`` does.  Where one is unknown (a null,
    other lengths), the bits alone tell.
    """
    ids, other_ids, hashes, other_hashes = (side[c].to_numpy() for c in (id_col, bits) for side in (some, others))
    sizes = some["_size"].to_numpy(), others["_size"].to_numpy()
    hashed, other_hashed, dated = some["_hashed"].to_numpy(dtype=bool), others["_hashed"].to_numpy(dtype=bool), others["_dated"].to_numpy(dtype=bool)
    found = []
    for size in np.unique(sizes[0]):
        rows = np.flatnonzero(sizes[0] == size)
        same = np.flatnonzero(sizes[1] == size) if size >= 0 else np.array([], dtype=int)
        rest = np.setdiff1d(np.arange(len(others)), same)
        a = np.array([*some[vector].to_numpy()[rows]], dtype="float64").reshape(len(rows), size) if len(same) else None
        b = np.array([*others[vector].to_numpy()[same]], dtype="float64").reshape(len(same), size) if len(same) else None
        with np.errstate(all="ignore"):
            flat = (_flat(a, True), _flat(b, False).T) if len(same) else None
            step = max(1, HELD // len(others))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                for where, known in ((same, True), (rest, False)):
                    if not len(where):
                        continue
                    if known:
                        below = flat[0][at : at + step] @ flat[1]  # half of what the squared distance is under zero, at most
                        i, j = np.divmod(np.flatnonzero(~(below < -most * most / 2 - size * 1e-37)), len(where))
                        few = (np.bitwise_count(hashes[part[i]] ^ other_hashes[where[j]]) <= most_bits) & hashed[part[i]] & other_hashed[where[j]]
                        few |= ~(below[i, j] < -close * close / 2 - size * 1e-37)
                        i, j = i[few], j[few]
                    else:
                        i, j = np.nonzero((np.bitwise_count(hashes[part][:, None] ^ other_hashes[where][None]) <= most_bits) & hashed[part][:, None] & other_hashed[where][None])
                    u, o = ids[part[i]], other_ids[where[j]]
                    meet = (u < o) | (dated[where[j]] & (u > o))
                    i, j, u, o = i[meet], j[meet], u[meet], o[meet]
                    differ = np.where(hashed[part[i]] & other_hashed[where[j]], np.bitwise_count(hashes[part[i]] ^ other_hashes[where[j]]).astype("int32"), np.int32(1 << 20))
                    far = np.full(len(i), np.nan)
                    if known:
                        total = np.zeros(len(i))
                        for k in range(a.shape[1]):
                            total += (a[at + i, k] - b[j, k]) ** 2
                        far = np.sqrt(total)
                        stay = (far <= close) | ((differ <= most_bits) & ~np.isnan(far))  # pandas can't tell NaN from null
                        u, o, far, differ = u[stay], o[stay], far[stay], differ[stay]
                    found.append(pd.DataFrame({"a": np.minimum(u, o), "b": np.maximum(u, o), "distance": far, "bits": differ, "known": known}))
    return pd.concat(found)


def undated_pairs(rows: DataFrame, id_col: str, at: str, vector: str, bits: str, close: float, near: float, most_bits: int) -> DataFrame | None:
    """Pairs that can be links, of which a row has no time: ``a`` < ``b``, ``distance`` (null if unknown) and ``bits``; None if all rows have one."""
    known = F.col(vector).isNotNull() & ~F.coalesce(F.exists(vector, lambda x: x.isNull()), F.lit(False))
    hashes = F.coalesce(F.col(bits).cast("long"), F.lit(0).cast("long"))
    sized = rows.select(F.col(id_col).cast("long").alias(id_col), at, vector, hashes.alias(bits), F.col(bits).isNotNull().alias("_hashed"), F.when(known, F.size(vector)).otherwise(F.lit(-1)).alias("_size"))
    blocks = joins.undated_blocks(sized, id_col, at, [vector, bits, "_hashed", "_size"], BLOCK)
    if not blocks:
        return None
    some, others = (side.groupBy("_row", "_column") for side in blocks)
    most = max(close, near)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [0], "b": [0], "distance": [0.0], "bits": [0], "known": [False]})[:0]
        return near_in_block(left, right, id_col, vector, bits, most, most_bits, close)

    pairs = some.cogroup(others).applyInPandas(run, "a long, b long, distance double, bits int, known boolean")
    return pairs.select("a", "b", F.when(F.col("known"), F.col("distance")).alias("distance"), "bits")


def similar_links(rows: DataFrame, id_col: str, at: str, vector: str, bits: str, span: float = SPAN, close: float = cluster.CLOSE, near: float = cluster.NEAR, most_bits: int = cluster.MOST_BITS) -> DataFrame:
    """Links ``a`` < ``b`` with ``distance`` of near-duplicates, undated rows included; vectors may be null. The limits are those of ``cluster.near_links``."""
    pairs = joins.dated_pairs(rows, id_col, at, span, [vector, bits])
    known = F.col(f"a_{vector}").isNotNull() & F.col(f"b_{vector}").isNotNull()
    pairs = pairs.withColumn("distance", F.when(known, sc.l2(F.col(f"a_{vector}"), F.col(f"b_{vector}"))))
    pairs = pairs.select("a", "b", "distance", sc.hamming(F.col(f"a_{bits}"), F.col(f"b_{bits}")).alias("bits"))
    loose = undated_pairs(rows, id_col, at, vector, bits, close, near, most_bits)
    found = cluster.near_links(pairs.unionByName(loose) if loose else pairs, "distance", "bits", close, near, most_bits)
    # links without a distance come after all others
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.coalesce("distance", F.lit(float("inf"))).alias("distance"))


def similar_clusters(rows: DataFrame, id_col: str, at: str, vector: str, bits: str, span: float = SPAN, **limits: float) -> DataFrame:
    """``node`` and ``cluster`` (its smallest node) of the rows in clusters of which every two are linked; rows alone may be left out.

    Links merge clusters by rising distance, then by their smaller and larger
    node; so ids should be numbers in the order that breaks ties.
    """
    links = written(similar_links(rows, id_col, at, vector, bits, span, **limits), "links")
    return cluster.complete_clusters(links)


def resolved_times(rows: DataFrame, id_col: str, wall: str, offset: str) -> DataFrame:
    """``id_col``, ``utc_offset_sec`` and ``instant`` of each row.

    A row with a wall clock and no offset borrows that of the row nearest in wall
    clock on the same day, ties to the smaller id; an undated row has neither.
    The instant is the wall clock less the offset, if there is one.
    """
    dated = rows.select(F.col(id_col).alias("_i"), F.col(wall).cast("long").alias("_w"), F.col(offset).cast("long").alias("_o")).where("_w IS NOT NULL")
    known = dated.where("_o IS NOT NULL")
    borrowed = nearest_same_bucket(dated.where("_o IS NULL").select("_i", "_w"), known.select(F.col("_i").alias("_k"), F.col("_w").alias("_kw"), "_o"), [], "_w", "_kw", "_i", "_k", DAY)
    found = known.unionByName(borrowed.select("_i", "_w", "_o"))
    joined = rows.select(id_col, F.col(wall).cast("long").alias("_wall")).join(found.select("_i", F.col("_o").alias("utc_offset_sec")), F.col(id_col) == F.col("_i"), "left")
    return joined.select(id_col, "utc_offset_sec", sc.instant(F.col("_wall"), F.col("utc_offset_sec")).alias("instant"))


def finalized(rows: DataFrame, path: str = "path", at: str = "at", offset: str | None = None, vector: str = "print", bits: str = "phash", aesthetic: str = "aesthetic", sharpness: str = "sharpness", quality: str | None = None, clipped: tuple[str, ...] = (), faces: str = "faces", skip: str = "is_utility", refused: str | None = None, **limits: float) -> DataFrame:
    """``rows`` with ``near_dup_cluster``, ``event_cluster``, ``aesthetic_pct``, ``sharpness_pct``, ``face_count``, ``utc_offset_sec``, ``status`` and ``kept``.

    ``path`` is unique; its order breaks ties.  Clusters are numbered from 0 as
    their first paths come, events as their instants do.  Missing scores count as
    0.  Of each cluster the best row by ``selection.survivors`` is kept; utility
    and refused rows never are, and don't compete.  The hash column goes, since
    clients can't hold 64 bits.
    """
    base = placed(rows, [path], "_id")
    offsets = F.col(offset) if offset else F.lit(None)
    times = written(resolved_times(base.select("_id", F.col(at).alias("_wall"), offsets.cast("long").alias("_own")), "_id", "_wall", "_own"), "times")
    linked = similar_clusters(base.select("_id", vector, bits).join(times.select(F.col("_id").alias("_t"), "instant"), F.col("_id") == F.col("_t")), "_id", "instant", vector, bits, **limits)
    named = written(times.select("_id").join(linked, F.col("_id") == F.col("node"), "left").select("_id", F.coalesce("cluster", "_id").alias("_cluster")), "clusters")
    numbers = placed(named.where("_id = _cluster").select(F.col("_id").alias("_first")), ["_first"], "near_dup_cluster")
    named = named.join(numbers, F.col("_cluster") == F.col("_first")).select(F.col("_id").alias("_n"), "near_dup_cluster")
    events = gap_numbers(times, "instant", EVENT_GAP, "_id", "event_cluster").select(F.col("_id").alias("_e"), "event_cluster", "utc_offset_sec")
    out = base.join(named, F.col("_id") == F.col("_n")).join(events, F.col("_id") == F.col("_e")).drop("_n", "_e")
    for column, name in ((aesthetic, "aesthetic_pct"), (sharpness, "sharpness_pct")):
        scores = F.coalesce(F.col(column).cast("double"), F.lit(0.0)).alias("_score")
        out = out.withColumn("_score", scores).withColumn(name, percentile_of(base.select(scores), "_score")).drop("_score")
    out = written(out.withColumn("face_count", F.coalesce(F.size(faces), F.lit(0))).withColumn("status", F.lit("ok")), "derived")
    out_of_contest = F.coalesce(F.col(skip), F.lit(False)) | (F.coalesce(F.col(refused), F.lit(False)) if refused else F.lit(False))
    kept = selection.survivors(out.where(~out_of_contest), "near_dup_cluster", "_id", "sharpness_pct", quality, "aesthetic_pct", clipped)
    return out.join(kept.select(F.col("_id").alias("_kept")), F.col("_id") == F.col("_kept"), "left").withColumn("kept", F.col("_kept").isNotNull()).drop("_kept", "_id", bits)
