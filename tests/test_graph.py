import random

import pytest

from lodeshift.operators import graph
from lodeshift.operators.graph import connected_components


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def test_components_match_union_find(spark):
    r = random.Random(3)
    chain = list(range(1000, 1040))
    r.shuffle(chain)
    edges = [(r.randrange(120), r.randrange(120)) for _ in range(70)] + list(zip(chain, chain[1:])) + [(7, 7), (None, 1), (500, None), (900, 901), (900, 901)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute(edges)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("few", [0, 200_000])
def test_few_edges_take_two_jobs_and_equal_the_rounds(spark, monkeypatch, few):
    cuts, cut = [], graph.cut
    monkeypatch.setattr(graph, "FEW", few)
    monkeypatch.setattr(graph, "cut", lambda df: cuts.append(1) or cut(df))
    edges = [("é", "b"), ("b", "zz"), ("\U0001f600", "\uffee"), ("q", "q"), (None, "b"), ("y", None)] + [(f"n{i}", f"n{i + 1}") for i in range(100, 140)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == brute(edges)
    assert (len(cuts) == 2) == (few > 0)
