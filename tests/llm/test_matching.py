import math

import pytest

from loomstone.llm import matching as m

WORK = "entity_id long, title string, first_author_last string, year string, venue string, s string"
SEEN = "sighting_id long, source_name string, title string, first_author_last string, year string, venue string, w string"


@pytest.mark.parametrize(
    "a,b,same",
    [
        ("Adaptive Scoping for Tool-Calling Systems", "ADAPTIVE SCOPING FOR TOOL-CALLING SYS.", True),
        ("Adaptive Scoping for Tool-Calling Systems", "Adaptive Scoping Systems for Tool-Caling", True),
        ("Adaptive Scoping for Peer Caches: A Field Study", "Adaptive Scoping for Peer Caches (preprint)", True),
        ("Adaptive Scoping for Peer Caches", "Adaptive Scoping for Pee...", True),
        ("Adaptive Scoping for Peer Caches", "Adaptive Scoping for Sensor Networks", False),
        ("Adaptive Scoping for Peer Caches", "Adaptive Scoping for Peer Caches: Part Two", False),
        ("Adaptive Scoping for Peer Caches", "Adaptive Scoping for Peer Caches (second edition)", False),
        ("Adaptive Scoping for Peer Caches", "Adaptive Scoping for Peer Caches Revisited", False),
    ],
)
def test_titles(a, b, same):
    cost, apart = m.title_cost(a, b)
    assert (apart == 0) == same and (not same or cost < 4)


def test_sightings_find_their_work(spark):
    works = [
        (1, "Adaptive Budgeting for County Rosters", "Elsuladquist", "2014", "Transactions on Auditable Software", ""),
        (2, "Adaptive Budgeting for County Rosters: Part Two", "Elsuladquist", "2018", None, ""),
        (3, "Adaptive Budgeting for Sealed Archives", "Elsuladquist", "2014", None, ""),
        (4, "Private Recall in Long Conversations", None, None, "Review of Evidence", ""),
        (5, None, "Nobody", None, None, ""),
    ]
    seen = [
        (10, "a", "adaptive budgeing for county rosters", "Elsuladquits", "2015", "TAS", "clash"),
        (10, "a", "adaptive budgeing for county rosters", "Elsuladquits", "2015", "TAS", "clash"),
        (11, "b", "Adaptive Budgeting for County Rosters: Part Two", "Elsuladquist, A.", "2018", None, ""),
        (12, "b", "Adaptive Budgeting for County Rosters", "Elsuladquist", "2009", None, ""),
        (13, None, "Private Recall in Long Conversations.", None, None, None, ""),
        (14, "a", None, None, None, None, ""),
        (15, "a", "word " * 20_000, "Elsuladquist", "2014", None, ""),
    ]
    got = m.match(spark.createDataFrame(works, WORK), spark.createDataFrame(seen, SEEN)).collect()
    assert {x.sighting_id: x.entity_id for x in got} == {10: 1, 11: 2, 12: None, 13: 4, 14: None, 15: None}
    assert len(got) == 6 and all(0 <= x.confidence <= 1 for x in got)


def edges_of(spark, works, seen):
    rows = m.candidate_edges(spark.createDataFrame(works, WORK), m.records(spark.createDataFrame(seen, SEEN)))
    return {(x.r, x.w): x.odds for x in rows.collect()}


def test_blocking_loses_no_pair_it_promises(spark):
    works = [(i, f"Scoping of {w} ledgers in {v} stores", "Marlowe", "2014", None, "") for i, (w, v) in enumerate((a, b) for a in ("red", "blue", "green", "amber") for b in ("cold", "warm", "north"))]
    seen = [(100 + w[0], "a", w[1].upper(), "Marlow", "2014", None, "") for w in works]
    edges = edges_of(spark, works, seen)
    assert {(100 + i, i) for i in range(12)} <= set(edges) and len(edges) > 12  # rivals are edges too
    assert all(edges[100 + i, i] > max([o for (r, w), o in edges.items() if r == 100 + i and w != i]) for i in range(12))
    got = m.match(spark.createDataFrame(works, WORK), spark.createDataFrame(seen, SEEN)).collect()
    assert {(x.sighting_id, x.entity_id) for x in got} == {(100 + i, i) for i in range(12)}


def test_hashes_less_one_letter():
    import random

    r = random.Random(1)
    for _ in range(200):
        a = "".join(r.choice("abc") for _ in range(r.randrange(0, 12)))
        forms = {a} | {a[:i] + a[i + 1 :] for i in range(len(a))}
        assert len(m.less_one(a)) == len(forms)
        assert all(m.less_one(f)[0:0] == [] and set(m.less_one(f)) & set(m.less_one(a)) for f in forms)
    assert len(m.less_one("".join(r.choice("abcdefgh") for _ in range(5_000)))) > 4_000


EDGES = "r long, source string, w long, odds double"


def brute(edges, price):
    """Marginals over all ways to give each record a work or none."""
    import itertools
    from collections import Counter

    rs = sorted({e[0] for e in edges})
    weights, total = {}, 0.0
    for pick in itertools.product(*[[None, *[e for e in edges if e[0] == r]] for r in rs]):
        used = [e for e in pick if e]
        n = Counter((e[1], e[2]) for e in used)
        p = math.exp(sum(e[3] for e in used) - price * sum(k > 1 for k in n.values()))
        total += p
        for e in used:
            weights[e[0], e[2]] = weights.get((e[0], e[2]), 0.0) + p
    return {k: v / total for k, v in weights.items()}


def test_beliefs_on_trees_are_exact(spark):
    for price in (0.0, 1.5, 6.0):
        edges = [(1, "a", 10, 1.0), (1, "a", 11, 0.0), (2, "a", 10, 2.0), (3, "a", 10, -1.0), (4, "b", 12, 2.0), (5, "a", 11, 1.0)]
        got = {(x.r, x.w): x.belief for x in m.propagate(spark.createDataFrame(edges, EDGES), price).collect()}
        want = brute(edges, price)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-3 for k in want), (price, got, want)


def test_propagation_decides_where_single_scores_err(spark):
    # Record 1 looks a little more like work 10, which record 2 surely reports.
    edges = spark.createDataFrame([(1, "a", 10, 2.0), (1, "a", 11, 1.6), (2, "a", 10, 7.0), (3, "b", 10, 2.0), (3, "b", 11, 1.6)], EDGES)
    alone = {x.r: x.entity_id for x in m.decided(m.propagate(edges, 0.0)).collect()}
    together = {x.r: x.entity_id for x in m.decided(m.propagate(edges, 3.0)).collect()}
    assert alone == {1: 10, 2: 10, 3: 10} and together == {1: 11, 2: 10, 3: 10}


def test_empty(spark):
    works, seen = spark.createDataFrame([], WORK), spark.createDataFrame([], SEEN)
    assert m.match(works, seen).count() == 0
    one = spark.createDataFrame([(1, "a", "x y z", "q", "2000", "v", "")], SEEN)
    assert [tuple(x) for x in m.match(works, one).collect()] == [(1, None, 1.0)]
