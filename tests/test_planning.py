import itertools
import random

import pytest
from pyspark.sql import functions as F

from sparkfolio.operators import planning as p

SIZES = [2, 3, 4, 6]


def test_capacity():
    slots = p.Slots.of_pages(20, SIZES, 3)
    assert (slots.count, slots.most, slots.target) == (11, 3 + 9 * 6 + 3, 3 + 9 * 4 + 3)
    assert p.recommended_pages(66, SIZES) == 20
    assert p.recommended_pages(67, SIZES) == 40


def test_suggested_tiers():
    slots = p.Slots.of_pages(20, SIZES, 3)
    events = [p.Event(0, 10, 5, 0.9), p.Event(1, 3, 5, 0.2), p.Event(2, 1, 0, 0.5), p.Event(3, 9, 9, 0.9, utility=0.9), p.Event(4, 2, 2, 0.1, undated=True), p.Event(5, 2, 2, 0.2)]
    got = {e.event: (e.tier, e.why) for e in p.suggested(events, slots)}
    assert got == {0: ("featured", "standout"), 1: ("normal", "ranked"), 2: ("skipped", "nothing kept"), 3: ("skipped", "utility"), 4: ("brief", "undated"), 5: ("normal", "ranked")}


def test_budget_gives_quotients_and_floors():
    events = [p.Event(0, moments=16, tier="featured", distinct=20, available=20), p.Event(1, moments=4, tier="normal", distinct=20, available=20), p.Event(2, moments=1, tier="brief", distinct=5, available=5)]
    floor = {"featured": 4, "normal": 2, "brief": 1}
    got = p.budget(events, 17, floor, 1)
    assert got.quota == {0: 13, 1: 3, 2: 1}
    assert got.overflow is None
    tight = p.budget(events, 5, floor, 1)
    assert [e.tier for e in tight.events] == ["normal", "normal", "brief"]
    assert sum(tight.quota.values()) == 5
    own = p.budget([p.replace(e, chosen=True) for e in events], 5, floor, 1)
    assert own.overflow == (7, 5)
    few = p.budget([p.Event(0, moments=1, tier="brief", distinct=2, available=4)], 9, floor, 1)
    assert (few.quota, few.events[0].tier) == ({0: 4}, "normal")


@pytest.mark.parametrize(("sizes", "n", "want"), [([2, 3], 1, False), ([2, 3], 7, True), ([4, 6], 9, False), ([], 0, True)])
def test_sums(sizes, n, want):
    assert p.sums(sizes, n)[n] is want


def test_packing_places_every_photo():
    for pages in (20, 40):
        slots = p.Slots.of_pages(pages, SIZES, 3)
        for n in range(1, slots.most + 1):
            for parts in (1, 2, 5):
                chapters = {c: list(range(c, n, parts)) for c in range(min(parts, n))}
                groups = p.packed(chapters, slots)
                for slot, _, photos in groups:
                    assert len(photos) in slots.sizes(slot)
                if parts == 1 and n >= 30 and pages == 20:
                    assert sum(len(g[2]) for g in groups) == n
                assert len({x for g in groups for x in g[2]}) == sum(len(g[2]) for g in groups)


def test_seating_keeps_the_most_chapters_that_slots_hold():
    draw = random.Random(3)
    for _ in range(60):
        slots = p.Slots.of_pages(draw.choice([8, 12]), SIZES, 3)
        chapters = {i: [i] * draw.randint(1, 9) for i in range(draw.randint(1, 7))}
        got = p.seated(chapters, slots)
        assert [x for k in sorted(got) for x in got[k]] == [x for k in sorted(chapters) for x in chapters[k]]
        fills_all = sum(map(len, chapters.values())) >= sum(slots.bounds(i)[0] for i in range(slots.count))

        def cost(counts):
            few, many = p.slot_range(slots, counts, True)  # noqa: B023
            return max(0, sum(few) - slots.count), max(0, slots.count - sum(many)) if fills_all else 0, -len(counts), sum(c * c for c in counts)  # noqa: B023

        cuts = [c for n in range(len(chapters)) for c in itertools.combinations(range(1, len(chapters)), n)]
        ways = [[sum(len(chapters[i]) for i in range(a, b)) for a, b in itertools.pairwise([0, *c, len(chapters)])] for c in cuts]
        assert cost([len(v) for v in got.values()]) == min(map(cost, ways))


def test_seats_follow_the_quotients():
    slots = p.Slots.of_pages(20, SIZES, 3)
    for counts in ([30, 10, 4], [1, 1, 40], [5] * 9, [2] * 15):
        got = p.apportioned(counts, slots)
        few, many = p.slot_range(slots, counts, sum(p.slot_range(slots, counts, True)[1]) >= slots.count)
        assert sum(got) <= slots.count
        assert all(g <= m for g, m in zip(got, many, strict=True))
        if sum(got) < slots.count:
            assert got == many
        for i, j in itertools.permutations(range(len(counts)), 2):  # nobody beyond its need outbids one within
            if got[i] < min(few[i], many[i]) and got[j] > 1:
                assert got[j] <= few[j]


def test_small_chapters_are_carried():
    assert p.carried({0: [1], 1: [2, 3], 2: [4]}, 2, set()) == {1: [2, 3, 1, 4]}
    assert p.carried({0: [1]}, 2, set()) == {0: [1]}
    assert p.carried({0: [1, 2], 1: [3, 4]}, 2, {0}) == {1: [3, 4, 1, 2]}


def test_books_in_parallel(spark):
    rows = spark.range(120).select((F.col("id") % 3).alias("book"), (F.col("id") % 7).alias("chapter"), F.col("id").alias("t"), F.col("id").alias("photo"))
    got = p.packed_books(rows, "book", "chapter", "t", "photo", 20, SIZES, 3)
    assert got.select("photo").distinct().count() == got.count() >= 100
    assert got.groupBy("book", "slot").count().count() <= 33


def test_group_sizes_against_all_ways():
    for pages, spread, half in ((6, [1, 2, 4], 1), (8, [2, 3], 2), (4, [3, 5], 1)):
        slots = p.Slots.of_pages(pages, spread, half)
        for start, allowance in itertools.product(range(slots.count), range(1, slots.count + 1)):
            if start + allowance > slots.count:
                continue
            for count in range(9):
                ways = itertools.product(*[[0, *[s for s in slots.sizes(i) if s > 0]] for i in range(start, start + allowance)])
                cost = lambda w, count=count: (w.count(0), count - sum(w), sum(s * s for s in w), [-s for s in w])
                best = list(min((w for w in ways if sum(w) <= count), key=cost))
                while best and not best[-1]:
                    best.pop()
                assert p.group_sizes(count, allowance, start, slots) == best
