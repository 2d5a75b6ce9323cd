"""Plans of one book: suggested tiers, photo quotas and groups for its slots.

A plan depends on all of a book's events in turn, and a book has a bounded number
of pages, so a plan is one small task: ``per_book`` runs these functions on
grouped rows, one group a book, any number of books in parallel.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cache
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Weights, floors and thresholds of tiers.
TIERS = ("featured", "normal", "brief", "skipped")
WEIGHT = {"featured": 2.0, "normal": 1.0, "brief": 0.5, "skipped": 0.0}
W_ENGAGEMENT, W_QUALITY, W_NOVELTY = 0.4, 0.4, 0.2
UTILITY_SKIP, FEATURED_MARGIN, NORMAL_SHARE, SIMILAR_BELOW, NOVELTY_KM = 0.8, 1.3, 0.6, 0.3, 2.0
A_SPREAD = 4


@dataclass(frozen=True)
class Slots:
    """The photo numbers that a book's slots can take: a right page first, spreads, a left page last."""

    count: int
    right: tuple[int, ...]
    spread: tuple[int, ...]
    left: tuple[int, ...]

    @classmethod
    def of_pages(cls, pages: int, spread: list[int], half: int) -> Slots:
        single = tuple(range(1, max(1, half) + 1))
        return cls(max(0, pages - 2) // 2 + 2, single, tuple(sorted({s for s in spread if s >= 2})), single)

    def sizes(self, i: int) -> tuple[int, ...]:
        return self.right if i == 0 else self.left if i == self.count - 1 else self.spread

    def bounds(self, i: int) -> tuple[int, int]:
        own = self.sizes(i)
        return (min(own), max(own)) if own else (0, 0)

    @property
    def most(self) -> int:
        return sum(self.bounds(i)[1] for i in range(self.count))

    @property
    def target(self) -> int:
        """Photos that a book aims at: full single pages, four a spread."""
        return sum(self.bounds(i)[1] if i in (0, self.count - 1) else min(A_SPREAD, self.bounds(i)[1]) for i in range(self.count))


def recommended_pages(keepers: int, spread: list[int]) -> int:
    return 20 if keepers <= Slots.of_pages(20, spread, max(spread, default=1)).most else 40


@dataclass
class Event:
    """What planning knows of an event; ``tier`` and ``why`` are its results."""

    event: int
    moments: int = 0
    keepers: int = 0
    quality: float = 0.0
    utility: float = 0.0
    undated: bool = False
    place: tuple[float, float] | None = None
    tags: frozenset[str] = frozenset()
    tier: str = "normal"
    why: str = ""
    merit: float = 0.0
    chosen: bool = False
    distinct: int = 0
    included: int = 0
    available: int = 0


def _likeness(rows: pd.DataFrame) -> np.ndarray:
    """How alike each two events are: the nearer in place or the more tags they share."""
    from .cluster import _km

    out = np.zeros((len(rows), len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        places, tags = rows["place"].iloc[[i, j]], rows["tags"].iloc[[i, j]]
        every = frozenset.union(*tags)
        near = 1 - min(1.0, _km(*places) / NOVELTY_KM) if all(places) else 0.0
        out[i, j] = out[j, i] = max(near, len(frozenset.intersection(*tags)) / len(every) if every else 0.0)
    return out


def suggested(events: list[Event], slots: Slots) -> list[Event]:
    """Events with tier, reason and merit.

    Rules decide first: utility, nothing kept, no date among dated ones.  The
    others compete.  Their base is engagement (moments, on a log scale of the
    largest) and quality; merit adds novelty, the distance from the most alike
    event of higher base.  The best of them fill the room that slots leave for
    normal events; a sixth of that room may be featured, where merit stands out
    from the median of the rest of the room.  Ties go to the smaller event.
    """
    if not events:
        return []
    rows = pd.DataFrame([vars(e) for e in events])
    undated = rows["undated"].astype(bool)
    ruled = [rows["utility"] > UTILITY_SKIP, rows["keepers"] == 0, undated & bool((~undated).any())]
    rows["tier"] = np.select(ruled, ["skipped", "skipped", "brief"], "")
    rows["why"] = np.select(ruled, ["utility", "nothing kept", "undated"], "")
    rows["merit"] = 0.0
    free = rows[rows["tier"] == ""].copy()
    if len(free):
        moments = np.log1p(free["moments"].astype(float))
        free["base"] = (W_ENGAGEMENT * moments / (moments.max() or 1.0) + W_QUALITY * free["quality"]) * (1 - free["utility"])
        free = free.sort_values(["base", "event"], ascending=[False, True])
        free["novelty"] = 1 - np.tril(_likeness(free), -1).max(axis=1)  # against those of higher base only
        free["by_base"] = np.arange(len(free))
        free["merit"] = free["base"] + W_NOVELTY * free["novelty"] * (1 - free["utility"])
        free = free.sort_values(["merit", "event"], ascending=[False, True])
        room = min(len(free), math.floor(slots.count * NORMAL_SHARE))
        most = max(1, room // 6)
        inside, rest = np.arange(len(free)) < room, free["merit"].iloc[most:room]
        stands = inside & (free["merit"] >= FEATURED_MARGIN * rest.median()).to_numpy() if len(rest) else np.zeros(len(free), bool)
        stands &= np.cumsum(stands) <= most
        known = (free["novelty"] < SIMILAR_BELOW) & (free["by_base"] < room)
        free["tier"] = np.select([stands, inside], ["featured", "normal"], "brief")
        free["why"] = np.select([stands, inside, known], ["standout", "ranked", "similar"], "out of room")
        rows.loc[free.index, ["tier", "why", "merit"]] = free[["tier", "why", "merit"]]
    by_event = {e.event: e for e in events}
    return [replace(by_event[r.event], tier=r.tier, why=r.why, merit=float(r.merit)) for r in rows.sort_values("event").itertuples()]


@dataclass
class Budget:
    quota: dict[int, int] = field(default_factory=dict)
    floors: dict[int, int] = field(default_factory=dict)
    overflow: tuple[int, int] | None = None
    events: list[Event] = field(default_factory=list)


def budget(events: list[Event], target: int, floor: dict[str, int], brief_cap: int) -> Budget:
    """Photos for each event: floors by tier, then largest quotients of weight * sqrt(moments).

    Suggested tiers give way where floors don't fit (the least merit first, only
    where that frees a photo), and the best suggested brief event rises where
    nobody can take one more.  Different pictures go before look-alikes.
    """
    plan = {e.event: replace(e) for e in events}
    owed = lambda e, tier: max(min(floor.get(tier, 0), e.distinct), e.included)
    excess = sum(owed(e, e.tier) for e in plan.values()) - target
    for tier, under in zip(TIERS, TIERS[1:], strict=False):
        for e in sorted(plan.values(), key=lambda e: (e.merit, -e.event)):
            freed = owed(e, tier) - owed(e, under)
            if excess > 0 and e.tier == tier and not e.chosen and freed > 0:
                e.tier, e.why, excess = under, "demoted", excess - freed
    floors, overflow = {k: owed(e, e.tier) for k, e in plan.items()}, None
    if (needed := sum(floors.values())) > target:
        overflow = (needed, target)
        floors = {k: max(e.included, min(1, e.available) if e.tier != "skipped" else 0) for k, e in plan.items()}
    quota, left = dict(floors), target - sum(floors.values())
    for limit in ("distinct", "available"):
        bid = lambda e: (-WEIGHT[e.tier] * math.sqrt(e.moments) / (quota[e.event] + 1), e.event)
        takes = lambda e: e.tier != "skipped" and quota[e.event] < getattr(e, limit) and (e.tier != "brief" or quota[e.event] < brief_cap)  # noqa: B023, E731
        queue = [bid(e) for e in plan.values() if takes(e)]
        heapq.heapify(queue)
        while left > 0:
            if queue:
                e = plan[heapq.heappop(queue)[1]]
                quota[e.event] += 1
                left -= 1
            else:
                waiting = [e for e in plan.values() if not e.chosen and e.tier == "brief" and getattr(e, limit) > quota[e.event]]
                if not waiting:
                    break
                e = min(waiting, key=lambda e: (-e.merit, e.event))
                e.tier, e.why = "normal", "filled"
            if takes(e):
                heapq.heappush(queue, bid(e))
    return Budget(quota, floors, overflow, [plan[k] for k in sorted(plan)])


def _chapter_bounds(slots: Slots, chapter: int, chapters: int, full: bool) -> list[tuple[int, int]]:
    """Bounds of 1, 2, ... slots for a chapter: the book's first ones, its last ones if it is full, else spreads."""
    spread = (min(slots.spread), max(slots.spread)) if slots.spread else (0, 0)
    if chapter == 0:
        return [slots.bounds(i) for i in range(slots.count)]
    if chapter == chapters - 1 and full:
        return [slots.bounds(i) for i in reversed(range(slots.count))]
    return [spread] * slots.count


def slot_range(slots: Slots, counts: list[int], full: bool) -> tuple[list[int], list[int]]:
    """For each chapter the fewest slots that hold its photos and the most that they fill."""
    fewest, most = [], []
    for j, count in enumerate(counts):
        bounds = _chapter_bounds(slots, j, len(counts), full)
        enough = [k for k, total in enumerate(accumulate(hi for _, hi in bounds), start=1) if total >= count]
        fewest.append(0 if not count else enough[0] if enough else slots.count)
        filled = 0
        for total in accumulate(lo for lo, _ in bounds):
            if total > count:
                break
            filled += 1
        most.append(filled)
    return fewest, most


def carried(chapters: dict[int, list], least: int, brief: set[int]) -> dict[int, list]:
    """Chapters too small for a spread, and brief ones, pass their photos on to the next; what is left goes back."""
    if least <= 1 and not brief:
        return chapters
    out, carry = {}, []
    for key in sorted(chapters):
        own = [*chapters[key], *carry]
        if len(own) < least or key in brief:
            carry = own
        else:
            out[key], carry = own, []
    if carry:
        if out:
            out[max(out)] = [*out[max(out)], *carry]
        else:
            out = {min(chapters): carry}
    return out


def seated(chapters: dict[int, list], slots: Slots) -> dict[int, list]:
    """Chapters, neighbours merged where the slots ask for it.

    Goal, in this order: as few slots as possible are needed beyond those there
    are; with photos enough for all slots, as few as possible stay blank; as many
    chapters as possible stay; merged chapters are small (by the sum of squares);
    merges come early.  A table over the chapters so far, the slots they need and
    the slots they fill holds the best way to cut them into runs.
    """
    keys, n = sorted(chapters), len(chapters)
    if not n:
        return {}
    sizes = [0, *accumulate(len(chapters[k]) for k in keys)]
    fills_all = sizes[-1] >= sum(slots.bounds(i)[0] for i in range(slots.count))

    @cache
    def span(count: int, first: bool, last: bool) -> tuple[int, int]:
        """Fewest slots that hold the photos of one run, and most that they fill."""
        at, of = (0, 1) if first else (1, 2) if last else (1, 3)
        few, many = slot_range(slots, [count if i == at else 0 for i in range(of)], True)
        return few[at], many[at]

    late = lambda cuts: [-c for c in cuts]
    best: list[dict[tuple[int, int], tuple[int, int, list[int]]]] = [{} for _ in range(n + 1)]
    best[0][0, 0] = 0, 0, []
    for i in range(n):
        for (need, fill), (merges, squares, cuts) in best[i].items():
            for j in range(i + 1, n + 1):
                few, many = span(sizes[j] - sizes[i], i == 0, j == n)
                state = need + few, min(fill + many, slots.count)
                way = merges + j - i - 1, squares + (sizes[j] - sizes[i]) ** 2, late([*late(cuts), j])
                if state not in best[j] or way < best[j][state]:
                    best[j][state] = way
    cost = lambda state: (max(0, state[0] - slots.count), slots.count - state[1] if fills_all else 0, *best[n][state])
    cuts = [0, *late(best[n][min(best[n], key=cost)][2])]
    return {keys[a]: [x for k in keys[a:b] for x in chapters[k]] for a, b in zip(cuts, cuts[1:], strict=False)}


def apportioned(counts: list[int], slots: Slots) -> list[int]:
    """Slots for each chapter, as a ranking of all seats that chapters could take.

    A chapter's first seat goes before any second one, seats within its need
    before seats beyond, then the larger quotient of photos by seats, then the
    earlier chapter.  A chapter bids for as many seats as it can fill.
    """
    if not counts:
        return []
    full = sum(slot_range(slots, counts, True)[1]) >= slots.count
    needs, caps = slot_range(slots, counts, full)
    bids = sorted((k > 1, k > 1 and k > needs[i], -counts[i] / k, i) for i, cap in enumerate(caps) for k in range(1, cap + 1))
    taken = Counter(i for *_, i in bids[: slots.count])
    return [taken[i] for i in range(len(counts))]


def sums(sizes: list[int], most: int) -> list[bool]:
    """Which numbers up to ``most`` are sums of the sizes."""
    out = [True] + [False] * most
    for n in range(1, most + 1):
        out[n] = any(s <= n and out[n - s] for s in sizes if s > 0)
    return out


def group_sizes(count: int, allowance: int, start: int, slots: Slots) -> list[int]:
    """How many of a chapter's photos each of its slots takes, from slot ``start`` on; 0 leaves a slot blank.

    A table over slots, from the last one back, and photos left: the fewest blank
    slots, then the fewest photos that no slot takes, then the most even sizes
    (least sum of squares), then larger sizes and blanks as late as can be.
    """
    best = [(0, left, 0, ()) for left in range(count + 1)]
    for number in reversed(range(start, start + allowance)):
        sizes = [s for s in slots.sizes(number) if s > 0]
        table = []
        for left in range(count + 1):
            blank, over, uneven, rest = best[left]
            ways = [(blank + 1, over, uneven, (0, *rest))]
            for s in sizes:
                if s <= left:
                    blank, over, uneven, rest = best[left - s]
                    ways.append((blank, over, uneven + s * s, (-s, *rest)))
            table.append(min(ways))
        best = table
    found = [-s for s in best[count][3]]
    while found and not found[-1]:
        found.pop()
    return found


def packed(chapters: dict[int, list], slots: Slots, brief: set[int] = frozenset()) -> list[tuple[int, int, list]]:
    """Slot number, chapter and photos of each group; photos are in the order in which they are given."""
    if not chapters:
        return []
    chapters = seated(carried(chapters, min(slots.spread, default=1), set(brief)), slots)
    out: list[tuple[int, int, list]] = []
    number = 0
    for (key, photos), allowance in zip(chapters.items(), apportioned([len(v) for v in chapters.values()], slots), strict=True):
        at = 0
        for size in group_sizes(len(photos), allowance, number, slots):
            if size:
                out.append((number, key, photos[at : at + size]))
            number, at = number + 1, at + size
    return out


def per_book(rows: DataFrame, book: str, plan: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A plan for each book's rows."""
    return rows.groupBy(book).applyInPandas(plan, schema)


def packed_books(rows: DataFrame, book: str, chapter: str, order: str, photo: str, pages: int, spread: list[int], half: int) -> DataFrame:
    """``slot``, ``chapter`` and ``place`` of each photo of each book; photos that no slot takes have no row."""
    slots = Slots.of_pages(pages, spread, half)

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([order, photo])
        chapters = {int(k): list(v) for k, v in group.groupby(chapter)[photo]}
        found = [(group[book].iloc[0], slot, key, place, p) for slot, key, photos in packed(chapters, slots) for place, p in enumerate(photos)]
        return pd.DataFrame(found, columns=["book", "slot", "chapter", "place", "photo"])

    return per_book(rows, book, plan, "book long, slot int, chapter long, place int, photo long")
