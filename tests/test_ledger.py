"""The ledger against a timeline that is kept step by step."""

import random

import pytest

from sparkfolio.sources import ledger


def timeline(actions, cap):
    """States by number, the pointer, and the pointer after each action."""
    states, seq, after = {}, None, []
    for what, label in actions:
        if what == "commit":
            if seq is None:
                states, seq = {0: ""}, 0
            states = {k: v for k, v in states.items() if k <= seq}
            seq += 1
            states[seq] = label
            states = {k: v for k, v in states.items() if k > seq - cap}
        elif seq is not None and what in ("undo", "redo"):
            to = seq + (1 if what == "redo" else -1)
            seq = to if to in states else seq
        after.append(seq)
    return states, seq, after


@pytest.mark.parametrize("cap", [50, 3, 1])
def test_replay(spark, cap):
    draw = random.Random(cap)
    logs = {p: [(draw.choice(["commit", "commit", "undo", "undo", "redo", "open", None]), f"e{p}-{i}") for i in range(draw.randint(0, 60))] for p in [*range(12), None]}
    logs[100] = [("undo", "x"), ("redo", "y")]  # never edited
    rows = [(p, i, what, label) for p, log in logs.items() for i, (what, label) in enumerate(log)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "project int, at int, action string, label string").repartition(3)
    replay = ledger.replayed(df, "project", ["at"], "action", cap)
    assert replay.columns == [*df.columns, "seq", "low", "high", "moved"]
    got = {(r.project, r.at): r.seq for r in replay.collect()}
    ends, states = ledger.timelines(replay, "project", ["at"], "action", "label")
    kept = {}
    for r in states.collect():
        kept.setdefault(r.project, {})[r.seq] = r.label
    offers = {r.project: (r.seq, r.undo, r.redo) for r in ledger.status(ends, states, "project").collect()}
    for p, log in logs.items():
        if not log:
            continue
        want, seq, after = timeline(log, cap)
        assert [got[p, i] for i in range(len(log))] == after
        assert kept.get(p, {}) == want
        assert offers[p] == (seq, want.get(seq) if seq is not None and seq - 1 in want else None, want.get(seq + 1) if seq is not None else None)
    assert ledger.replayed(df.limit(0), "project", ["at"], "action").collect() == []
