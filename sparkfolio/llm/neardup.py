"""Near-duplicate embeddings: spherical k-means cells, blocked cosines within them.

Equal vectors are one row with a count from the start.  Centroids come from a
bounded sample; every vector has the cell of its nearest centroid as home and
visits every cell that can hold a partner: one within the angle of ``alike``
lies on its own centroid's side of the plane between the two centroids, and
within the cell's widest angle of its centroid.  Vectors that fail either test
by more than the angle are no link, so no link is missed, whatever the number of
cells.  A home's members are compared with all of its members and visitors by
blocked products in double precision.

Cells are cut into blocks of members and blocks of others, so a hot cell is many
tasks.  A task returns counts of links, and for connectivity a star forest of
its block, never pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, vectors
from .components import components

ALIKE = 0.9
#: Vectors a cell on average, cells that a vector takes part in at least, and most centroids (they are broadcast).
CELL, VISITS, MOST_CELLS = 4096, 1, 1024
SAMPLE = 20_000
#: Rows of a block of members and of others, and members that are multiplied at once.
MEMBERS, OTHERS, STEP = 8192, 8192, 512
#: What rounding may add to an angle or a cosine.
SLACK = 1e-7


def centroids(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids by spherical k-means; an empty cell starts anew at the row that fits worst."""
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    k = max(1, min(k, len(unit)))
    own = unit[np.random.default_rng(3).permutation(len(unit))[:k]].copy()
    for _ in range(rounds if k > 1 else 1):
        fit = unit @ own.T
        home = fit.argmax(axis=1)
        sums = np.zeros_like(own)
        np.add.at(sums, home, unit)
        size = np.linalg.norm(sums, axis=1)
        worst = iter(np.argsort(fit.max(axis=1)).tolist())
        for c in np.flatnonzero(size < 1e-12).tolist():
            sums[c] = unit[next(worst)]
        own = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return own


def linked(left: np.ndarray, right: np.ndarray, alike: float) -> np.ndarray:
    """Which pairs of rows have a cosine of ``alike`` at least."""
    norms = np.outer(np.sqrt((left * left).sum(axis=1)), np.sqrt((right * right).sum(axis=1)))
    cosine = left @ right.T / norms
    out = cosine >= alike
    for i, j in np.argwhere(np.abs(cosine - alike) < 1e-12).tolist():  # at the border: one order of summing
        out[i, j] = (left[i] * right[j]).sum() / norms[i, j] >= alike
    return out


def forest(link: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest id that they reach within the block; nodes without links are left out."""
    a, b = np.flatnonzero(link.any(axis=1)), np.flatnonzero(link.any(axis=0))
    link = link[np.ix_(a, b)]
    la, lb = left[a].copy(), right[b].copy()
    top = np.iinfo(np.int64).max
    while len(a):
        new = np.empty_like(la)
        for i in range(0, len(la), 256):
            new[i : i + 256] = np.minimum(la[i : i + 256], np.where(link[i : i + 256], lb, top).min(axis=1))
        back = lb.copy()
        for i in range(0, len(la), 256):
            back = np.minimum(back, np.where(link[i : i + 256], new[i : i + 256, None], top).min(axis=0))
        if (new == la).all() and (back == lb).all():
            break
        la, lb = new, back
    return np.concatenate([left[a], right[b]]), np.concatenate([la, lb])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = vectors.matrix(batch.column("vec")) + 0.0  # one zero
        digest = [hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in rows]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digest, pa.binary())], names=["id", "vec", "digest"])


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 2048):
            yield batch.slice(i, 2048)


def _homes(shared):
    """Home cell of each vector, and its angle to the centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            rows = vectors.matrix(batch.column("vec"))
            fit = _unit(rows) @ shared.value.T
            yield pa.RecordBatch.from_arrays([pa.array(fit.argmax(axis=1).astype(np.int32)), pa.array(np.arccos(np.clip(fit.max(axis=1), -1, 1)))], names=["cell", "angle"])

    return run


def visited(unit: np.ndarray, own: np.ndarray, widest: np.ndarray, alike: float, visits: int = VISITS) -> tuple[np.ndarray, np.ndarray]:
    """Home of each unit vector, and the cells (``own`` centroids, ``widest`` angles of their members) that can hold a partner."""
    fit = unit @ own.T
    home, at = fit.argmax(axis=1), np.arange(len(unit))
    angle = np.arccos(np.clip(alike, -1, 1))
    # a partner in cell c is no nearer to the home's centroid than to c's
    apart = np.sqrt(np.maximum(2 - 2 * own @ own.T, 0))
    reach = np.sin(angle) if angle < np.pi / 2 else 1.0
    can = fit[at, home][:, None] - fit <= reach * apart[home] + SLACK
    can &= np.arccos(np.clip(fit, -1, 1)) <= widest[None] + angle + SLACK
    can[at, home] = True
    if visits > 1:
        np.put_along_axis(can, np.argsort(-fit, axis=1, kind="stable")[:, :visits], True, axis=1)
    return home, can


def _assigned(shared, widest, alike: float, visits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            rows = vectors.matrix(batch.column("vec"))
            home, can = visited(_unit(rows), shared.value, widest.value, alike, visits)
            can[np.arange(len(rows)), home] = False
            row, cell = np.nonzero(can)
            cells = np.insert(cell, np.searchsorted(row, np.arange(len(rows))), home)  # home first
            ends = np.concatenate([[0], np.cumsum(can.sum(axis=1) + 1)])
            flat = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(cells.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], names=["rep", "vec", "n", "cells"])

    return run


def _compared(alike: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return none
        a, b = left["rep"].to_numpy(), right["rep"].to_numpy()
        rows, others, n = vectors.matrix(left["vec"]), vectors.matrix(right["vec"]), right["n"].to_numpy()
        link, links = np.empty((len(a), len(b)), bool), np.empty(len(a), np.int64)
        for i in range(0, len(a), STEP):
            link[i : i + STEP] = linked(rows[i : i + STEP], others, alike) & (a[i : i + STEP, None] != b[None, :])
            links[i : i + STEP] = link[i : i + STEP] @ n
        u, v = forest(link, a, b)
        some, edge = links > 0, u != v
        return pa.table({"u": np.concatenate([a[some], u[edge]]), "v": pa.array(np.concatenate([np.zeros(some.sum(), np.int64), v[edge]]), mask=np.arange(some.sum() + edge.sum()) < some.sum()), "links": np.concatenate([links[some], np.zeros(edge.sum(), np.int64)])})

    return run


def linked_rows(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", alike: float = ALIKE, visits: int = VISITS) -> DataFrame:
    """``id``, ``n_links``, ``component_id`` and ``kept`` for every row of ``df``.

    Vectors that are null, zero, not finite or of a length unlike most link with
    nothing and are their own component.  Equal vectors link with each other.
    Rows that share an id count as vectors of their own and get the same answer;
    a row without an id stays alone, with a null component, and is kept.
    """
    spark = df.sparkSession
    # names may hold dots
    df = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{vec_col}`").alias("_vec"))
    id_col, vec_col = "_id", "_vec"
    rows = common.written(vectors.cleaned(df, id_col, vec_col).mapInArrow(_digests, "id long, vec array<double>, digest binary"), "vectors")
    distinct = common.written(rows.groupBy("digest").agg(F.min("id").alias("rep"), F.first("vec").alias("vec"), F.count("*").alias("n")), "distinct")
    count = distinct.count()
    # the sample and the number of cells are bounded, so what is broadcast is
    own = centroids(vectors.sample(distinct.withColumnRenamed("rep", "id"), SAMPLE), min(MOST_CELLS, common.parts(spark, count, CELL))) if count else np.zeros((1, 1))
    shared = spark.sparkContext.broadcast(own)
    widest = np.full(len(own), -1.0)
    for r in distinct.select("vec").mapInArrow(_homes(shared), "cell int, angle double").groupBy("cell").agg(F.max("angle").alias("angle")).collect():
        widest[r.cell] = r.angle  # MOST_CELLS rows at most
    widest = spark.sparkContext.broadcast(widest)
    placed = common.written(distinct.select("rep", "vec", "n").mapInArrow(_assigned(shared, widest, alike, visits), "rep long, vec array<double>, n long, cells array<int>"), "cells")
    sizes = placed.select(F.posexplode("cells").alias("at", "cell")).groupBy("cell").agg(F.sum((F.col("at") == 0).cast("long")).alias("members"), F.count("*").alias("others"))
    sizes = sizes.select(F.col("cell").alias("_cell"), F.greatest(F.lit(1), F.ceil(F.col("members") / MEMBERS)).cast("int").alias("rows"), F.ceil(F.col("others") / OTHERS).cast("int").alias("columns"))
    sizes = F.broadcast(sizes)  # MOST_CELLS rows at most
    each = lambda frame: frame.select("rep", "vec", "n", F.posexplode("cells").alias("at", "cell")).join(sizes, F.col("cell") == F.col("_cell"))
    part = lambda column: F.pmod(F.xxhash64("rep"), F.col(column)).cast("int")
    spread = lambda column: F.explode(F.sequence(F.lit(0), F.col(column) - 1))
    members = each(placed).where("at = 0").withColumn("row", part("rows")).withColumn("column", spread("columns")).select("cell", "row", "column", "rep", "vec")
    others = each(common.again(placed)).withColumn("column", part("columns")).withColumn("row", spread("rows")).select("cell", "row", "column", "rep", "vec", "n")
    keys = ["cell", "row", "column"]
    found = common.written(members.groupBy(*keys).cogroup(others.groupBy(*keys)).applyInArrow(_compared(alike), "u long, v long, links long"), "links")
    links = found.where("v IS NULL").groupBy("u").agg(F.sum("links").alias("links")).withColumnRenamed("u", "_rep")
    joined = components(found.where("v IS NOT NULL").select("u", "v")).withColumnRenamed("node", "_node")
    reps = distinct.select("digest", "rep", "n").join(links, F.col("rep") == F.col("_rep"), "left").join(joined, F.col("rep") == F.col("_node"), "left")
    reps = reps.select("digest", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    # an id that several vectors share takes their most links and smallest component
    answers = rows.select("id", "digest").join(reps, "digest").groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    every = df.select(F.col(id_col).cast("long").alias("_id"))
    out = every.join(answers, F.col("_id") == F.col("id"), "left").withColumn("component_id", F.coalesce("component_id", "_id"))
    return out.select(F.col("_id").alias("id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "component_id", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: every vector's links, component and whether it stays."""
    return linked_rows(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).withColumnRenamed("id", "vec_id")


ORACLE_SQL = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
  r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
  n AS (SELECT a, count(*) AS n FROM l GROUP BY a), c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
  SELECT vec_id, coalesce(n, 0) AS n_links, m AS component_id, vec_id = m AS kept FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id"""
