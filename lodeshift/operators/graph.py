"""Connected components of an edge list, by rounds of label passing with pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeshift.session import cut, is_bounded

FEW = 200_000  # edges that one task joins at once; beyond, labels are passed in rounds
MOST_ROUNDS = 60  # label distance halves at least each round; a guard against endless loops, not a cap on components


def _united(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, component) of the edges (a, b) of one task, by union-find."""
    parent: dict = {}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pd.DataFrame({"node": nodes, "component": [find(x) for x in nodes]})


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; the component is named by its smallest node.

    Edges with a NULL end are left out, self-loops give single nodes, direction and repeats don't matter; no edges
    give no rows. Each round passes the smallest label to all neighbours and then to the labels' own labels, so the
    number of rounds grows with the logarithm of a component's diameter. Both steps aggregate before the shuffle; a
    node with very many neighbours sends one partial minimum a task. Up to ``FEW`` edges are joined by one task instead: the
    rounds' many small jobs cost the driver more memory than such edges take.
    """
    known = cut(edges.where(F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull()).select(F.col(f"`{a}`").alias("a"), F.col(f"`{b}`").alias("b")).distinct())
    return components_of(known, is_bounded(known, FEW))


def components_of(known: DataFrame, few: bool) -> DataFrame:
    """As ``connected_components``, of edges (a, b) that are materialised, distinct and without NULL; ``few``: at most ``FEW``."""
    kinds = {kind for _, kind in known.dtypes}
    if len(kinds) == 1 and kinds <= {"string", "bigint", "int"} and few:
        kind = kinds.pop()
        return cut(known.coalesce(1).mapInPandas(_united, f"node {kind}, component {kind}"))
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")), F.struct("a", F.col("a").alias("b")), F.struct(F.col("b").alias("a"), "b")))
    both = cut(known.select(ends.alias("e")).select("e.a", "e.b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")))
    for _ in range(MOST_ROUNDS):
        of_a = labels.select(F.col("node").alias("a"), F.col("component").alias("la"))
        of_b = labels.select(F.col("node").alias("b"), F.col("component").alias("lb"))
        told = F.explode(F.array(F.struct(F.col("b").alias("node"), F.col("la").alias("low")), F.struct(F.col("lb").alias("node"), F.col("la").alias("low"))))
        low = cut(both.join(of_a, "a").join(of_b, "b").where("la <= lb").select(told.alias("t")).groupBy("t.node").agg(F.min("t.low").alias("low")))
        further = low.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        fresh = cut(low.join(further, "low", "left").select("node", F.least("low", "lower").alias("component")))
        moved = fresh.join(labels.select("node", F.col("component").alias("old")), "node").where("component <> old").limit(1).count()
        labels = fresh
        if not moved:
            return labels
    raise RuntimeError("labels did not settle")
