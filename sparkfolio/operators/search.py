"""Keyword search over arrays of words, and substring search over names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def terms(query: str) -> list[str]:
    """The distinct words of a query in their order; a plural s of longer words goes."""
    found = [w[:-1] if len(w) > 3 and w.endswith("s") else w for w in re.split(r"[^a-z0-9]+", query.lower()) if w]
    return list(dict.fromkeys(found))


def keyword_search(df: DataFrame, query: str, words: Column, then: list[Column], limit: int) -> DataFrame:
    """The rows that have most of the query's terms, ``score`` of them; ``then`` orders ties and ends in a unique column."""
    asked = terms(query)
    if not asked:
        return df.withColumn("score", F.lit(0)).limit(0)
    score = F.size(F.array_intersect(F.array(*[F.lit(t) for t in asked]), words))
    return df.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), *then).limit(limit)


def name_search(df: DataFrame, query: str, name: str, folders: str | None = None) -> DataFrame:
    """Rows whose name, or one of whose folders, holds the text in any case."""
    text = query.strip().lower()
    hit = F.lower(F.col(name)).contains(text)
    if folders:
        hit |= F.exists(folders, lambda f: F.lower(f).contains(text))
    return df.where(hit)
