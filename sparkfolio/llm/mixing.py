"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document of a source should be copied ``target / source size`` times on
average.  The whole part is certain; the fractions are rounded together: two
documents play a duel, in which one passes mass (words) to the other until one
of them is at 0 or 1, and the undecided one plays the next document.  Mass is
counted in words, so every duel keeps the words of the mix exactly, and the
direction is drawn so that each document's expectation stays its fraction.

Duels run as a reduction tree: a fold within blocks of about ``BLOCK``
documents, largest first so that what is left over is small, then a fold over
the blocks' residuals, and so on until one residual for each source remains; it
goes to the nearer side, so a source's words are off by half of that document
at most.  Blocks are dealt by a hash, so a hot source is as many blocks as it
needs.  All draws are hashes of ``seed``, the tree's level and the two keys:
reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Documents of one fold on average.  Folds copy their list, so this stays small.
BLOCK = 64
#: Most that a source may be repeated, as a multiple of its size.
MOST = 3.0
WEIGHTS = (1.0, 2.0, 3.0)
WORD = r"[^\x20\x09-\x0D]+"


def draw(seed: int, *parts: Column) -> Column:
    """A reproducible number in [0, 1) from 52 bits of a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 12) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``sizes`` (source, source_size; one row a source) with ``weight`` and ``target``.

    The weights repeat over sources in code point order, null last.  A target is
    ``min(most * size, level * weight)``.  The level starts at all words over all
    weights; sources whose cap lies below it are capped and what they leave is
    shared again by weight, until none is above its cap.  Each round is one sum
    over the sources.  Places come from a sort in ranges and the ranges' counts,
    so no task sees all sources.
    """
    count = len(weights)
    table = F.array(*[F.lit(float(w)) for w in weights])
    ordered = common.placed(sizes.select("source", "source_size"), [F.col("source").asc_nulls_last()], "sources")
    rows = ordered.select("source", "source_size", F.element_at(table, (F.col("_place") % count + 1).cast("int")).alias("weight"))
    rows = common.written(rows.withColumn("_cap", F.lit(float(most)) * F.col("source_size")), "weights")
    total, share = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    level = total / share if share else 0.0
    while True:
        over = F.col("_cap") < F.lit(level) * F.col("weight")
        capped, rest = rows.agg(F.sum(F.when(over, F.col("_cap"))), F.sum(F.when(~over, F.col("weight")))).first()
        if not rest:  # every cap holds
            return rows.select("source", "source_size", "weight", F.col("_cap").alias("target"))
        new = (total - (capped or 0.0)) / rest
        if new <= level:
            break
        level = new
    return rows.select("source", "source_size", "weight", F.least(F.col("_cap"), F.lit(level) * F.col("weight")).alias("target"))


def _fold(seed: int, level: int) -> Column:
    """One block's duels: the decided documents and the one left over."""

    def duel(state: Column, new: Column) -> Column:
        old = state["left"]
        # words that can pass to the old one, and from it
        gain = F.least((1 - old["p"]) * old["size"], new["p"] * new["size"])
        loss = F.least(old["p"] * old["size"], (1 - new["p"]) * new["size"])
        rises = draw(seed + level, old["key"], new["key"]) * (gain + loss) < loss
        item = lambda who, p: F.struct(who["key"].alias("key"), p.cast("double").alias("p"), who["size"].alias("size"))
        zero, one = F.lit(0.0), F.lit(1.0)
        fills = (1 - old["p"]) * old["size"] <= new["p"] * new["size"]
        empties = old["p"] * old["size"] <= (1 - new["p"]) * new["size"]
        decided = F.when(rises, F.when(fills, item(old, one)).otherwise(item(new, zero))).otherwise(F.when(empties, item(old, zero)).otherwise(item(new, one)))
        up, down = old["p"] + gain / old["size"], old["p"] - loss / old["size"]
        new_up, new_down = new["p"] + loss / new["size"], new["p"] - gain / new["size"]
        left = F.when(rises, F.when(fills, item(new, new_down)).otherwise(item(old, up))).otherwise(F.when(empties, item(new, new_up)).otherwise(item(old, down)))
        return F.struct(F.concat(state["done"], F.array(decided)).alias("done"), left.alias("left"))

    head = F.element_at("_items", 1)
    first = F.struct(head["key"].alias("key"), head["p"].alias("p"), head["size"].alias("size"))
    rest = F.slice("_items", 2, F.size("_items"))
    start = F.struct(F.filter(F.array(first), lambda x: F.lit(False)).alias("done"), first.alias("left"))
    return F.aggregate(rest, start, duel)


def rounded(rows: DataFrame, group: str, key: str, p: str, size: str, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """Round the fractions ``p`` (0 < p < 1) of each ``group`` together; ``size`` is over 0 and ``key`` unique.

    Returns ``_key`` and ``_up`` (0 or 1); sums of ``p * size`` in a group are
    kept to within one row's size.  Each level of the tree shuffles one narrow
    row for a document or residual, and each has ``block`` times fewer rows.
    """
    pending = rows.select(F.col(group).alias("g"), F.col(key).alias("key"), F.col(p).cast("double").alias("p"), F.col(size).cast("double").alias("size"))
    counts = common.written(pending.groupBy("g").agg(F.count("*").alias("_n")).select(F.col("g").alias("_g"), "_n"), "groups")
    largest = counts.agg(F.max("_n")).first()[0] or 0
    levels = max(1, math.ceil(math.log(max(largest, 2)) / math.log(block / 2)))
    out = None
    for level in range(levels):
        last = level == levels - 1
        if last:
            pending = pending.withColumn("_block", F.lit(0).cast("long"))
        else:
            blocks = F.greatest(F.lit(1), F.ceil(F.col("_n") / float(block / 2) / float(block / 2) ** level)).cast("long")
            pending = pending.join(counts, F.col("g").eqNullSafe(F.col("_g")))
            pending = pending.withColumn("_block", F.pmod(F.xxhash64(F.lit(seed + level), "key"), blocks))
        gathered = pending.groupBy("g", "_block").agg(F.sort_array(F.collect_list(F.struct("size", "key", "p")), asc=False).alias("_items"))
        folded = common.written(gathered.select("g", _fold(seed, level).alias("f")), "rounding")
        decided = folded.select(F.explode("f.done").alias("d")).select(F.col("d.key").alias("_key"), F.col("d.p").cast("int").alias("_up"))
        out = decided if out is None else out.unionByName(decided)
        left = folded.select("g", F.col("f.left.key").alias("key"), F.col("f.left.p").alias("p"), F.col("f.left.size").alias("size"))
        settled = (F.col("p") <= 1e-9) | (F.col("p") >= 1 - 1e-9)
        # what is integral up to rounding errors is decided; the last residual of a source goes to the nearer side
        up = (F.col("p") >= 0.5).cast("int")
        out = out.unionByName((left if last else left.where(settled)).select(F.col("key").alias("_key"), up.alias("_up")))
        pending = left.where(~settled)
    return out


def mixed(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 0) -> DataFrame:
    """``docs`` with the columns of a mix, prefixed ``mix_``: size, source_size, target, copies, taken.

    The prefix gets underscores in front while a column of ``docs`` has such a name.

    ``copies`` (0 to ``ceil(most)``) tells how often the document is taken.  Null
    texts have no words; documents of no words take no part in the rounding and
    keep the whole copies of their source.  A null source is a source, after all
    others.  Repeated rows and null ids are separate documents, in the order of
    their content, so reruns agree however rows are dealt.  An empty table gives
    an empty result.
    """
    words = F.coalesce(F.regexp_count(F.col(f"`{text_col}`").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(whole, F.col(f"`{id_col}`").alias("_key"), F.col(f"`{source_col}`").alias("source"), words.alias("size"))
    clash = docs.groupBy(F.col(f"`{id_col}`").alias("i")).count().where("count > 1 OR i IS NULL").limit(1).count()
    if clash:  # rows are told apart by a number in the order of id, source and content, fixed in a written copy
        content = [F.col("_key").asc_nulls_last(), F.col("source").asc_nulls_last(), "size", F.xxhash64("_row"), F.sha2(F.col(f"_row.`{text_col}`").cast("string"), 256)]
        rows = common.written(common.placed(rows, content, "sorted").drop("_key").withColumnRenamed("_place", "_key"), "numbered")
    slim = common.written(rows.select("_key", "source", "size"), "sizes")  # words are counted once
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = common.written(source_targets(sizes, weights, most), "targets")
    named = targets.select(F.col("source").alias("_source"), "source_size", "target")
    small = targets.limit(100_001).count() <= 100_000  # one narrow row a source; joined by shuffle beyond
    named = F.broadcast(named) if small else named
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    near = F.round(rate)
    rate = F.when(F.abs(rate - near) < 1e-9, near).otherwise(rate)
    rated = slim.join(named, F.col("source").eqNullSafe(F.col("_source")), "left").withColumn("_rate", rate)
    play = rated.withColumn("p", F.col("_rate") - F.floor("_rate")).where((F.col("p") > 0) & (F.col("size") > 0))
    ups = rounded(play, "source", "_key", "p", "size", seed).withColumnRenamed("_key", "_up_key")
    copies = (F.floor("_rate") + F.coalesce("_up", F.lit(0))).cast("int")
    named_out = {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "copies": copies, "taken": copies * F.col("size")}
    decided = rated.join(ups, F.col("_key") == F.col("_up_key"), "left").select(F.col("_key").alias("_own"), *[c.alias(f"mix_{n}") for n, c in named_out.items()])
    names = [f"mix_{n}" for n in named_out]
    prefix = "mix_"
    while {prefix + n for n in named_out} & {c.lower() for c in docs.columns}:
        prefix = "_" + prefix
    return rows.select("_row", "_key").join(decided, F.col("_key") == F.col("_own")).select("_row", *names).select("_row.*", *[F.col(f"mix_{n}").alias(prefix + n) for n in named_out])


def repeated(mix: DataFrame, columns: list[str]) -> DataFrame:
    """The documents of a mix, each as often as it is taken."""
    copies = F.col(mix.columns[-2])
    return mix.where(copies > 0).select(*columns, F.explode(F.sequence(F.lit(1), copies)).alias(common.free("_copy", columns))).select(*columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: all documents mixed to weights 1, 2, 3 over the sources."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = mixed(docs.select("doc_id", "source", "text"))
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").cast("long").alias("taken"))
