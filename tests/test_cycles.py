"""Nodes on directed cycles against brute force, and rounds that grow with the logarithm of a chain's length."""

import random

import pytest

from attesta.operators import graph


def on_cycles(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    found = set()
    for start in out:
        seen, todo = set(), [start]
        while todo:
            for b in out.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        if start in seen:
            found.add(start)
    return found


def graphs():
    rnd = random.Random(5)
    yield [(rnd.randrange(60), rnd.randrange(60)) for _ in range(75)]
    yield [(rnd.randrange(40), rnd.randrange(40)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(9)] + [(109, 3), (5, 100), (200, 201), (201, 202), (202, 200), (201, 300), (7, 7)]
    # two rings joined by a run, a ring entered by a tail, a node of two runs back to itself
    yield [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 6), (6, 5), (20, 21), (21, 22), (22, 21), (30, 31), (31, 30), (30, 32), (32, 33), (33, 30), (None, 0), (40, None)]


@pytest.mark.parametrize("edges", list(graphs()))
def test_on_cycles(spark, edges):
    want = on_cycles([e for e in edges if None not in e])
    assert sorted(r.node for r in graph.on_cycles(spark.createDataFrame(edges, "src int, dst int")).collect()) == sorted(want)


def test_long_chains(spark, monkeypatch):
    """A chain of 200 and rings of 90 and of 3 take a few dozen tables, not one for each pair of ends."""
    written, settled = [], graph._settled
    monkeypatch.setattr(graph, "_settled", lambda df: written.append(1) or settled(df))
    edges = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000 + (i + 1) % 90) for i in range(90)] + [(2000, 2001), (2001, 2002), (2002, 2000)]
    found = [r.node for r in graph.on_cycles(spark.createDataFrame(edges, "src int, dst int")).collect()]
    assert sorted(found) == [*range(1000, 1090), 2000, 2001, 2002]
    assert len(written) < 40
    assert graph.on_cycles(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_nodes_of_several_fields(spark):
    edges = spark.createDataFrame([("a", i, j) for i, j in [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)]] + [("b", 1, 2), ("b", 2, 4)], "ledger string, i int, j int").selectExpr("struct(ledger, i AS claim) AS src", "struct(ledger, j AS claim) AS dst")
    assert sorted(tuple(r.node) for r in graph.on_cycles(edges).collect()) == [("a", 1), ("a", 2), ("a", 3)]
