import pytest
from compare import same
from conftest import SMALL

from sparkfolio.plans import queries as plans


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_matches_sql(spark, duck, name):
    same(plans.QUERIES[name](spark, SMALL), duck, plans.ORACLES[name])


def test_complete_linkage_links_every_pair(spark):
    links = {(r.a, r.b) for r in plans.near_links(spark, SMALL).collect()}
    clusters = {}
    for r in plans.complete_linkage(spark, SMALL).collect():
        clusters.setdefault(r.cluster, []).append(r.node)
    assert clusters
    for members in clusters.values():
        members.sort()
        assert all((a, b) in links for i, a in enumerate(members) for b in members[i + 1 :])


def test_complete_linkage_takes_all_links(spark, duck):
    rows = duck.execute("""SELECT a.vec_id, b.vec_id, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d
        FROM embeddings a JOIN embeddings b ON b.vec_id > a.vec_id AND b.vec_id - a.vec_id <= 120 WHERE d <= 1.19 ORDER BY d, 1, 2""").fetchall()
    linked, of = {(a, b) for a, b, _ in rows}, {x: {x} for a, b, _ in rows for x in (a, b)}
    for a, b, _ in rows:
        if of[a] is not of[b] and all((min(x, y), max(x, y)) in linked for x in of[a] for y in of[b]):
            both = of[a] | of[b]
            of.update(dict.fromkeys(both, both))
    got = {r.node: r.cluster for r in plans.complete_linkage(spark, SMALL).collect()}
    assert got == {x: min(m) for x, m in of.items()}


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
