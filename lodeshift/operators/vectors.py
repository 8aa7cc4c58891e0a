"""Vectors: cosine, exact top-k of a stated query set in blocks, votes of neighbours, two-means."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeshift.session import is_bounded, shuffle_width

BLOCK = 2048  # vectors that meet as one matrix
FEW = 20_000  # queries that are broadcast; 10 MB at 64 numbers each


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def cosine(a, b) -> Column:
    """Cosine of two arrays; NULL where one has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _blocks(vectors: DataFrame, key: str, vector: str, name: str) -> DataFrame:
    """Vectors packed into blocks of at most about ``BLOCK``, by hash of the key."""
    n = vectors.count()
    parts = max(1, -(-n // BLOCK))
    block = F.pmod(F.xxhash64(key), F.lit(parts)).alias("b")
    return vectors.where(F.col(vector).isNotNull()).groupBy(block).agg(F.collect_list(F.struct(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))).alias(name)).drop("b")


def top_neighbours(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(query, neighbour, cosine, rank): the exact k nearest others of every query, smaller keys first on ties.

    Queries and vectors meet block by block, each pair of blocks one matrix product that keeps k rows a query; the
    final ranking sees k rows a query and block. NULL vectors and those of no length are left out.
    """
    kind = dict(vectors.dtypes)[key]
    q = _blocks(queries, key, vector, "q")
    x = _blocks(vectors, key, vector, "x")
    # Few queries go to every block of vectors; many meet them through a shuffle, block by block.
    pairs = x.crossJoin(F.broadcast(q)) if is_bounded(queries, FEW) else x.crossJoin(q).repartition(shuffle_width(vectors.sparkSession))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for qs, xs in zip(pdf["q"], pdf["x"]):
                qi, xi = np.array([r["id"] for r in qs]), np.array([r["id"] for r in xs])
                a, b = np.stack([r["v"] for r in qs]), np.stack([r["v"] for r in xs])
                la, lb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    s = (a @ b.T) / la[:, None] / lb[None, :]
                s = np.where(np.isfinite(s), s, -2.0)
                s[qi[:, None] == xi[None, :]] = -2.0
                order = np.argsort(xi, kind="stable")
                near = order[np.argsort(-np.round(s[:, order], 9), axis=1, kind="stable")[:, :k]]
                rows = np.repeat(np.arange(len(qi)), near.shape[1])
                flat = near.ravel()
                out = pd.DataFrame({"query": qi[rows], "neighbour": xi[flat], "cosine": s[rows, flat]})
                yield out[out["cosine"] > -2.0]

    part = pairs.mapInPandas(meet, f"query {kind}, neighbour {kind}, cosine double")
    w = Window.partitionBy("query").orderBy(F.desc(F.round("cosine", 9)), "neighbour")
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vote(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """(query, label, weight): the label with the largest sum of inverse distances, the smaller on ties."""
    w = neighbours.join(labels, "neighbour").groupBy("query", "label").agg(F.round(F.sum(1.0 / F.greatest(1.0 - F.col("cosine"), F.lit(1e-9))), 6).alias("weight"))
    return w.groupBy("query").agg(F.min_by(F.struct("label", "weight"), F.struct(-F.col("weight"), "label")).alias("b")).select("query", "b.label", "b.weight")


def two_means(vectors: DataFrame, by: str, key: str, vector: str) -> DataFrame:
    """(by, key, cluster, distance): two clusters of each small group, from its two farthest first members, in key order.

    For groups such as one candidate's phrases; one task holds a group.
    """
    types = dict(vectors.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key).reset_index(drop=True)
        x = np.stack(pdf[vector].map(np.asarray)).astype(float)
        centres = np.stack([x[0], x[((x - x[0]) ** 2).sum(1).argmax()]])
        for _ in range(50):
            gap = ((x[:, None] - centres[None]) ** 2).sum(2)
            label = gap.argmin(1)
            fresh = np.stack([x[label == i].mean(0) if (label == i).any() else centres[i] for i in (0, 1)])
            if np.allclose(fresh, centres):
                break
            centres = fresh
        far = np.sqrt(((x - centres[label]) ** 2).sum(1))
        return pd.DataFrame({by: pdf[by], key: pdf[key], "cluster": label.astype("int32"), "distance": np.round(far, 6)})

    return vectors.where(F.col(vector).isNotNull()).select(by, key, vector).groupBy(by).applyInPandas(run, f"{by} {types[by]}, {key} {types[key]}, cluster int, distance double")
