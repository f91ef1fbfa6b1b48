"""Strong components, cycle edges and waves of random graphs against plain reachability."""

from __future__ import annotations

import random

import pytest

from riskloom.operators import graph
from riskloom.operators.numbering import dense_names, numbered
from riskloom.operators.tables import cut


def reach(edges):
    out = {a: {b for x, b in edges if x == a} for a in {n for e in edges for n in e}}
    while True:
        more = {a: bs | {c for b in bs for c in out[b]} for a, bs in out.items()}
        if more == out:
            return out
        out = more


def rows(df):
    return {tuple(r) for r in df.collect()}


#: A ring with a tail; two rings with edges between them both ways apart; a dense random graph; a sparse one; a long path; loops only.
GRAPHS = {
    "ring": [(k, (k + 1) % 9) for k in range(9)] + [(3, 20), (20, 21)],
    "two rings": [(1, 2), (2, 3), (3, 1), (3, 10), (1, 11), (10, 11), (11, 12), (12, 10), (12, 30), (30, 31), (31, 30), (5, 5)],
    "dense": [(a, b) for a, b in ((random.Random(k).randrange(25), random.Random(-k - 1).randrange(25)) for k in range(90))],
    "sparse": [(random.Random(k).randrange(60), random.Random(k + 500).randrange(60)) for k in range(70)],
    "path": [(k + 1, k) for k in range(20)],
    "loops": [(1, 1), (2, 2)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components_and_waves(spark, name):
    edges = GRAPHS[name]
    df = spark.createDataFrame(edges, "src long, dst long")
    seen = reach([e for e in edges if e[0] != e[1]] or [(0, -1)])
    cycle = {a: min(b for b in seen[a] if a in seen[b]) for a in seen if a in seen[a]}
    assert rows(graph.strong_components(df)) == set(cycle.items())
    gone = {(a, b) for a, b in edges if a < b and a in cycle and cycle.get(b) == cycle[a]}
    if name == "two rings":
        assert rows(graph.cycle_edges(df)) == gone and rows(graph.break_cycles(df)) == {e for e in edges if e[0] != e[1]} - gone
    nodes = {n for e in edges for n in e} | {99}
    left = {e for e in edges if e[0] != e[1]} - gone
    wave = dict.fromkeys(nodes, 0)
    for _ in nodes:
        wave = {n: max((wave[b] + 1 for a, b in left if a == n), default=0) for n in nodes}
    acyclic = spark.createDataFrame(sorted(left), "src long, dst long")
    found = graph.waves(spark.createDataFrame([(n,) for n in nodes], "id long"), acyclic)
    assert rows(found) == set(wave.items())


def test_waves_of_a_cycle(spark):
    edges = [(1, 2), (2, 3), (3, 1)]
    with pytest.raises(ValueError, match="cycle"):
        graph.waves(spark.createDataFrame([(1,), (2,), (3,)], "id long"), spark.createDataFrame(edges, "src long, dst long"))


def test_order_numbers(spark):
    values = [(random.Random(k).randrange(50), k) for k in range(500)]
    df = spark.createDataFrame(values, "a long, b long").repartition(7)
    assert sorted((r.position, r.a, r.b) for r in numbered(df, ["a", "b"], cut).collect()) == [(k, a, b) for k, (a, b) in enumerate(sorted(values), 1)]
    names = {r.a: r.name for r in dense_names(df.select("a"), cut).collect()}
    assert sorted(names.values()) == list(range(1, len({a for a, _ in values}) + 1)) and set(names) == {a for a, _ in values}
    assert numbered(df.filter("false"), ["a"], cut).count() == 0
