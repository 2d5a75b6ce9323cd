"""An append-only ledger of commits, undos and redos, replayed to each project's timeline.

A project's timeline is a run of numbered states and a pointer.  A commit cuts
the states after the pointer, adds one and keeps the newest ``cap``; undo and
redo move the pointer while there is a state that way.  The rule is sequential
within a project, so each partition is sorted and read once with three numbers
of state, whatever the length of a project's ledger; all else are joins and sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States that a timeline keeps, and what an action can be.
CAP = 50
COMMIT, UNDO, REDO = "commit", "undo", "redo"


def replayed(actions: DataFrame, project: str, order: list[str], action: str, cap: int = CAP) -> DataFrame:
    """``actions`` with ``seq``, the pointer after each, ``low`` and ``high``, the states kept then, and ``moved``.

    ``order`` is unique in a project.  State 0 is what was there before the first
    commit; until then undo and redo do nothing and the numbers are null.  Any
    other action does nothing.
    """
    names = actions.columns
    rows = actions.select(F.struct(*names).alias("_row"), F.to_json(F.struct(project)).alias("_p"), F.col(action).cast("string").alias("_a"), *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)])
    keys = [f"_o{k}" for k in range(len(order))]
    rows = rows.repartition("_p").sortWithinPartitions("_p", *keys)
    kinds = dict(rows.select("_row").dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = seq = low = high = None
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for who, what in zip(batch.column("_p").to_pylist(), batch.column("_a").to_pylist(), strict=True):
                if who != now:
                    now, seq, low, high = who, None, None, None
                moved = True
                if what == COMMIT:
                    seq = (seq or 0) + 1
                    high, low = seq, max(low or 0, seq - cap + 1)
                elif what == UNDO and seq is not None and seq > low:
                    seq -= 1
                elif what == REDO and seq is not None and seq < high:
                    seq += 1
                else:
                    moved = False
                for column, value in zip(out, (seq, low, high, moved), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), *[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.bool_())], ["_row", "seq", "low", "high", "moved"])

    found = rows.mapInArrow(run, f"_row {kinds['_row']}, seq long, low long, high long, moved boolean")
    return found.select(*[F.col("_row")[c].alias(c) for c in names], "seq", "low", "high", "moved")


def timelines(replay: DataFrame, project: str, order: list[str], action: str, label: str) -> tuple[DataFrame, DataFrame]:
    """The pointer of each project (``seq``, ``low``, ``high``) and its states (``seq``, ``label``) after a replay.

    A state is the last commit of its number; the state before all commits has an
    empty label.
    """
    at = F.struct(*order)
    ends = replay.groupBy(project).agg(F.max_by(F.struct("seq", "low", "high"), at).alias("end")).select(project, "end.*")
    commits = replay.where(F.col(action) == COMMIT).groupBy(project, "seq").agg(F.max_by(label, at).alias("label"))
    first = ends.where("seq IS NOT NULL").select(project, F.lit(0).cast("long").alias("seq"), F.lit("").alias("label"))
    kept = ends.select(F.col(project).alias("_p"), "low", "high")
    states = commits.unionByName(first).join(kept, F.col(project).eqNullSafe(F.col("_p")) & F.col("seq").between(F.col("low"), F.col("high")))
    return ends, states.select(project, "seq", "label")


def status(ends: DataFrame, states: DataFrame, project: str) -> DataFrame:
    """``undo`` and ``redo`` of each project: the label of the edit that each would take back or do again, or null.

    The label of the state at the pointer names the edit that undo takes back, if
    the state before it is still kept.
    """
    near = states.select(F.col(project).alias("_p"), F.col("seq").alias("_s"), "label")
    joined = ends.join(near, F.col(project).eqNullSafe(F.col("_p")) & F.col("_s").between(F.col("seq") - 1, F.col("seq") + 1), "left")
    at = lambda d: F.max(F.when(F.col("_s") == F.col("seq") + d, F.col("label")))
    return joined.groupBy(project, "seq", "low", "high").agg(F.when(at(-1).isNotNull(), at(0)).alias("undo"), at(1).alias("redo"))
