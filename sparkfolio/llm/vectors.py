"""What search and near-duplicates of embeddings share: which vectors count, and bounded samples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: Column) -> Column:
    """Whether a vector takes part: not null, finite throughout, not all zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vec.isNotNull() & ~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


def cleaned(df: DataFrame, id_col: str, vec_col: str, mark: Column | None = None) -> DataFrame:
    """``id`` and ``vec`` (array<double>) of the rows that take part; with ``mark`` also ``marked``.

    Vectors of another length than most (the smaller length on ties) can't be
    compared and take no part, nor do rows without an id.
    """
    kept = [F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")]
    if mark is not None:
        kept.append(F.coalesce(mark, F.lit(False)).alias("marked"))
    rows = df.select(*kept)
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vec")))
    common = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vec") == (common["n"] if common else 0))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of lists of one length as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 1))


def sample(rows: DataFrame, most: int) -> np.ndarray:
    """The vectors of at most ``most`` rows: those of the smallest id hash."""
    got = rows.orderBy(F.xxhash64("id"), "id").limit(most).select("vec").toArrow()
    return matrix(got["vec"])
