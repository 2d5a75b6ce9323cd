"""Approximate nearest neighbours by multi-index hashing.

Codes: principal directions of a bounded sample, turned by an iteratively
learned rotation (ITQ) so that signs lose little; ``BITS`` bits a vector.  Index:
the code is cut into ``PIECES`` substrings of about as many bits as a block's rows
need, and rows are listed by each substring's value.  Search: the radius grows
from 0.  Codes within Hamming radius r agree with the query within
floor(r / PIECES) in at least one substring (one less for those after the first
r mod PIECES + 1), so each step probes the values at one more bit from one
substring of the query, and then all codes within the next radius are known.
Those are reranked by the exact cosine of the original vectors.

When to stop is learned: of the sample's pairs at a cosine, ``CAUGHT`` lie within
some radius; a search ends at the radius that belongs to the k-th best cosine
found so far, at the latest at the one that belongs to the sample's k nearest.
Where a block holds fewer than k rows within it, the radius grows until it does,
so no query comes out short.  Near neighbours so end a search after a few lists;
among vectors that are all nearly as far apart as chance would have them, the
lists probed hold a large part of a block, and only reranking is saved.

Rows are dealt over blocks and queries over chunks, both of bounded size; a task
indexes one block and answers one chunk, so no bucket and no group of equal
vectors gathers in one task.  Every row is indexed.  A row is sent once for each
chunk and a query once for each block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common, vectors

BITS, PIECES = 64, 4
#: Rows of the sample that codes are fitted on, its rows that are asked, and the share of neighbours within a radius.
SAMPLE, ASKED, CAUGHT = 8192, 400, 0.94
BLOCK_ROWS, CHUNK_QUERIES = 65536, 32768
#: Steps of the cosine for which a radius is learned.
STEPS = 40

_COUNT = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def distances(codes: np.ndarray, code: np.uint64) -> np.ndarray:
    """Hamming distances from one code."""
    x = np.ascontiguousarray(codes ^ code).view(np.uint16).reshape(-1, 4)
    return _COUNT[x].sum(axis=1, dtype=np.int64)


@dataclass
class Coder:
    """``radius`` is the largest; ``needs`` tells the radius for each step of the cosine from 0 to 1."""

    mean: np.ndarray
    axes: np.ndarray
    radius: int
    needs: np.ndarray

    def need(self, cosine: float) -> int:
        return int(self.needs[min(max(int(cosine * STEPS), 0), STEPS)])

    def codes(self, rows: np.ndarray) -> np.ndarray:
        unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
        bits = (unit - self.mean) @ self.axes > 0
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def fit(rows: np.ndarray, k: int, caught: float = CAUGHT, rounds: int = 30) -> Coder:
    """Learn the codes' directions, rotation and radius from sample rows."""
    draw = np.random.default_rng(7)
    dims = rows.shape[1]
    if len(rows) < 2:
        return Coder(np.zeros(dims), draw.standard_normal((dims, BITS)), BITS, np.full(STEPS + 1, BITS))
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    mean = unit.mean(axis=0)
    _, turned = np.linalg.eigh((unit - mean).T @ (unit - mean))
    axes = turned[:, ::-1][:, :BITS]
    low = (unit - mean) @ axes
    rotation = np.linalg.qr(draw.standard_normal((axes.shape[1],) * 2))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(low @ rotation > 0, 1.0, -1.0).T @ low)
        rotation = (u @ v).T
    axes = axes @ rotation
    if axes.shape[1] < BITS:  # short vectors: more directions
        axes = np.hstack([axes, draw.standard_normal((dims, BITS - axes.shape[1]))])
    out = Coder(mean, axes, BITS, np.full(STEPS + 1, BITS))
    codes = out.codes(rows)
    near_far, near_cos, far = [], [], []
    for q in draw.permutation(len(rows))[:ASKED].tolist():
        cosines = unit @ unit[q]
        cosines[q] = -2
        order = np.argsort(-cosines)[: min(10 * k, len(rows) - 1)]
        apart = distances(codes[order], codes[q])
        far.append(apart[:k])
        near_far.append(apart)
        near_cos.append(cosines[order])
    out.radius = int(np.quantile(np.concatenate(far), caught, method="higher"))
    apart, step = np.concatenate(near_far), np.clip(np.concatenate(near_cos) * STEPS, 0, STEPS).astype(np.int64)
    needs = np.full(STEPS + 1, out.radius)
    for i in range(STEPS + 1):
        own = apart[step == i]
        if len(own) >= 50:
            needs[i] = min(out.radius, int(np.quantile(own, caught, method="higher")))
    needs[STEPS] = min(needs[STEPS], PIECES)  # equal vectors have equal codes
    out.needs = np.minimum.accumulate(needs)
    return out


_WIDTH = BITS // PIECES
#: The numbers of a substring by how many bits they have.
_RINGS = [np.flatnonzero(np.array([bin(i).count("1") for i in range(1 << _WIDTH)]) == n) for n in range(_WIDTH + 1)]


class Index:
    """The substrings' lists of one block."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.lists = []
        for j in range(PIECES):
            piece = ((codes >> np.uint64(_WIDTH * j)) & np.uint64((1 << _WIDTH) - 1)).astype(np.int64)
            order = np.argsort(piece, kind="stable")
            self.lists.append((order, np.searchsorted(piece[order], np.arange((1 << _WIDTH) + 1))))

    def grown(self, code: np.uint64):
        """Radius after radius, the rows that a step probes first; after it all codes within the radius have been probed."""
        seen = np.zeros(len(self.codes), dtype=bool)
        for bits in range(_WIDTH + 1):
            for j, (order, starts) in enumerate(self.lists):
                own = int(code >> np.uint64(_WIDTH * j)) & ((1 << _WIDTH) - 1)
                probe = _RINGS[bits] ^ own
                low, size = starts[probe], starts[probe + 1] - starts[probe]
                some = np.flatnonzero(size)
                low, size = low[some], size[some]
                rows = order[np.arange(size.sum()) + np.repeat(low - np.cumsum(size) + size, size)]
                rows = rows[~seen[rows]]  # a list names a row once
                seen[rows] = True
                yield PIECES * bits + j, rows


def answer(coder: Coder, ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[list, list, list]:
    """The k nearest rows of one block for each query, other than rows of its own id."""
    index = Index(coder.codes(rows))
    norms, query_norms = np.sqrt((rows * rows).sum(axis=1)), np.sqrt((queries * queries).sum(axis=1))
    out: tuple[list, list, list] = ([], [], [])
    for q, (query_id, code) in enumerate(zip(query_ids.tolist(), coder.codes(queries), strict=True)):
        found, rough, _ = _search(index, coder, rows, norms, queries[q], code, ids != query_id, k)
        if not len(found):
            continue
        if len(found) > k:
            found = found[rough >= np.partition(rough, -k)[-k] - 1e-9 * query_norms[q]]
        # sums in one order for every row: equal vectors tie exactly
        score = (rows[found] * queries[q]).sum(axis=1) / (norms[found] * query_norms[q])
        best = np.lexsort((ids[found], -score))[:k]
        out[0].extend([query_id] * len(best))
        out[1].extend(ids[found[best]].tolist())
        out[2].extend(score[best].tolist())
    return out


def _search(index: Index, coder: Coder, rows: np.ndarray, norms: np.ndarray, query: np.ndarray, code: np.uint64, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The reranked rows with their products, and how many rows were probed."""
    found, products, waiting, apart, probed = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    norm = np.sqrt((query * query).sum())
    for radius, new in index.grown(code):
        probed += len(new)
        new = new[allowed[new]]
        waiting, apart = np.concatenate([waiting, new]), np.concatenate([apart, distances(index.codes[new], code)])
        inside = apart <= radius
        if inside.any():
            some = waiting[inside]
            found, products = np.concatenate([found, some]), np.concatenate([products, rows[some] @ query / norms[some]])
            waiting, apart = waiting[~inside], apart[~inside]
        if len(found) >= k and radius >= min(coder.radius, coder.need(np.partition(products, -k)[-k] / norm)):
            break
    return found, products, probed


def nearest(df: DataFrame, query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``id`` and ``score`` (cosine) of the k nearest found for the rows that ``query`` marks.

    Null, zero and non-finite vectors, rows without an id, and vectors of a
    length unlike most take no part.  Ties go to the smaller id.  Repeated ids
    are rows of their own as candidates; a query never finds rows of its own id,
    and an id that stands for several queries is answered for its smallest row.
    An empty table gives an empty result.
    """
    spark = df.sparkSession
    if any("." in c for c in (id_col, vec_col)):  # which would be taken for fields
        df = df.withColumns({"_id": F.col(f"`{id_col}`"), "_vec": F.col(f"`{vec_col}`")})
        id_col, vec_col = "_id", "_vec"
    rows = vectors.cleaned(df, id_col, vec_col, query)
    asked = rows.where("marked").groupBy("id").agg(F.min("vec").alias("vec"))
    rows = rows.drop("marked")
    count, many = rows.count(), asked.count()
    coder = spark.sparkContext.broadcast(fit(vectors.sample(rows, SAMPLE), k))
    blocks, chunks = common.parts(spark, count, BLOCK_ROWS), common.parts(spark, many, CHUNK_QUERIES)
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("chunk", numbers(chunks))
    ask = asked.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")).withColumn("block", numbers(blocks))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            found = answer(coder.value, left["id"].to_numpy(), vectors.matrix(left["vec"]), right["id"].to_numpy(), vectors.matrix(right["vec"]), k)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    found = data.groupBy("block", "chunk").cogroup(ask.groupBy("block", "chunk")).applyInArrow(run, "query_id long, id long, score double")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: the 5 nearest vectors of every row whose id is divisible by 50."""
    found = nearest(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)
    return found.withColumnRenamed("id", "vec_id")
