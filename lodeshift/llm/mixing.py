"""Mixing sources to target shares of the tokens by the cube method.

Every document gets an expected number of copies, the same for all of its source; the whole part is taken for sure, the
fraction is an inclusion probability. The flight phase of the cube method moves the fractions through the null space of
the balancing constraints (tokens and documents of the source) until they are 0 or 1, block by block; the few that
remain open in each block meet in a next, smaller round, until one block is left, whose last few are landed by chance.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeshift.session import cut, shuffle_width

BLOCK = 20_000  # documents that fly together in one task
ROWS = 3  # balancing constraints, hence at most so many documents stay open in a block
_EPS = 1e-9


def flight(pi: np.ndarray, x: np.ndarray, r: np.random.Generator) -> np.ndarray:
    """The flight phase: probabilities moved to 0 or 1 but for at most as many as there are constraints.

    ``x`` has a row per unit and a column per constraint; sums of x * pi / pi0 are kept, so expectations are kept.
    Works on windows of constraints + 1 open units, as in the fast flight.
    """
    a = x / np.where(pi > 0, pi, 1.0)[:, None]
    width = x.shape[1] + 1
    null = _cross if width == 3 else _null
    units, out = a.tolist(), pi.astype(float).tolist()
    todo = [int(i) for i in r.permutation(len(pi)) if _EPS < pi[i] < 1 - _EPS]
    chance = r.random(len(todo)).tolist()  # every step settles one unit at least
    window, at = todo[:width], width
    while len(window) == width:
        u = null([units[i] for i in window])
        up = down = float("inf")
        for i, v in zip(window, u):
            p = out[i]
            if v > 0:
                up, down = min(up, (1 - p) / v), min(down, p / v)
            elif v < 0:
                up, down = min(up, -p / v), min(down, (p - 1) / v)
        step = up if chance.pop() < down / (up + down) else -down
        rest = []
        for i, v in zip(window, u):
            p = out[i] + step * v
            out[i] = 0.0 if p < _EPS else 1.0 if p > 1 - _EPS else p
            if 0 < out[i] < 1:
                rest.append(i)
        fill = width - len(rest)
        window = rest + todo[at : at + fill]
        at += fill
    return np.array(out)


def _cross(a: list[list[float]]) -> list[float]:
    """As ``_null`` for three units and two constraints: the cross product of the constraints."""
    (a0, b0), (a1, b1), (a2, b2) = a
    u = [a1 * b2 - a2 * b1, a2 * b0 - a0 * b2, a0 * b1 - a1 * b0]
    top = max(map(abs, u))
    return [v / top for v in u] if top > 1e-12 * max(abs(a0 * b1), abs(a1 * b2), abs(a2 * b0), 1e-300) else _null(a)


def _null(a: list[list[float]]) -> list[float]:
    """A vector u with a.T @ u = 0, for one unit more than there are constraints."""
    u = np.linalg.svd(np.array(a).T, full_matrices=True)[2][-1]
    return (u / np.abs(u).max()).tolist()


def landing(pi: np.ndarray, r: np.random.Generator) -> np.ndarray:
    """What is still open is drawn in one systematic pass, which keeps the expected number."""
    open_ = np.flatnonzero((pi > 0) & (pi < 1))
    total, start = np.cumsum(pi[open_]), r.random()
    out = pi.copy()
    out[open_] = np.diff(np.floor(np.concatenate([[0.0], total]) + start))
    return out


def plan_mix(totals: pd.DataFrame, targets: pd.DataFrame) -> pd.DataFrame:
    """The copies each source needs: (source, target_share, max_repeats, docs, tokens, copies).

    The mix is as large as it can be with every source at its share of those that have documents and none used more
    often than allowed: a source without tokens can't be mixed in, its share goes to the others in proportion.
    """
    t = targets.merge(totals, on="source", how="left").fillna({"docs": 0, "tokens": 0})
    t["copies"] = 0.0
    live = (t.tokens > 0) & (t.target_share > 0) & (t.max_repeats > 0)
    if live.any():
        share = t.target_share[live] / t.target_share[live].sum()
        size = (t.tokens[live] * t.max_repeats[live] / share).min()
        t.loc[live, "copies"] = np.minimum(size * share / t.tokens[live], t.max_repeats[live].astype(float))
    return t


def balanced_mix(docs: DataFrame, targets: DataFrame, seed: int = 17) -> DataFrame:
    """(doc_id, source, tokens, copies) of the documents in the mix, each at least once and at most ``max_repeats`` times.

    ``docs`` has doc_id, source, tokens; ``targets`` is the fixed table source, target_share, max_repeats. Documents
    without source or target are not used, nor are those without tokens (NULL, empty texts): they add nothing. Equal
    ids are taken as one document each. Empty tables give no rows. The sources' totals are aggregated first, one row a
    source; a source of any size flies in blocks of ``BLOCK`` documents, so a hot source is no single task.
    """
    spark = docs.sparkSession
    used = cut(docs.where("doc_id is not null and source is not null and tokens > 0").select("doc_id", "source", "tokens"))
    totals = used.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
    wanted = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    known = totals.join(F.broadcast(wanted.select("source")), "source")  # at most as many rows as the fixed table of targets
    plan = plan_mix(known.toPandas(), wanted.toPandas())
    plan = plan[plan.copies > 0]
    if not len(plan):
        return used.limit(0).withColumn("copies", F.lit(1))
    rates = spark.createDataFrame([(s, float(c)) for s, c in zip(plan.source, plan.copies)], "source string, rate double")
    shared = used.join(F.broadcast(rates), "source").withColumn("sure", F.floor(F.col("rate") + 1e-9).cast("int")).withColumn("pi", F.greatest(F.col("rate") - F.col("sure"), F.lit(0.0)))
    sizes = {s: n for s, n in zip(plan.source, plan.docs)}
    most = max(1, int(-(-max(sizes.values()) // BLOCK)))
    counts = spark.createDataFrame([(s, int(-(-n // BLOCK))) for s, n in sizes.items()], "source string, blocks int")
    open_ = cut(
        shared.where("pi > 0").join(F.broadcast(counts), "source")
        .withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks")).cast("int")).withColumn("p", F.col("pi"))
        .select("doc_id", "source", "tokens", "sure", "pi", "p", "block")
    )
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, source string, tokens long, sure int, pi double, p double, block int"

    def fly(last: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("doc_id", kind="stable").reset_index(drop=True)
            r = np.random.default_rng([seed, int(pdf["block"][0]), len(pdf)])
            # Constraints in the units of their means, so that none outweighs the others.
            x = np.column_stack([pdf["pi"] * pdf["tokens"] / max(pdf["tokens"].mean(), 1), pdf["pi"]])
            start = pdf["p"].to_numpy()
            pi = flight(start, x * (start / pdf["pi"].to_numpy())[:, None], r)
            pdf["p"] = landing(pi, r) if last else pi
            return pdf[["doc_id", "source", "tokens", "sure", "pi", "p", "block"]]

        return run

    settled = []
    while True:
        last = most == 1
        flown = cut(open_.repartition(shuffle_width(spark), "source", "block").groupBy("source", "block").applyInPandas(fly(last), schema))
        settled.append(flown.where("p = 0 or p = 1"))
        if last:
            break
        most = -(-most * ROWS // BLOCK)  # what stays open is a few documents a block
        open_ = cut(flown.where("p > 0 and p < 1").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(most)).cast("int")))
    drawn = settled[0]
    for more in settled[1:]:
        drawn = drawn.unionByName(more)
    sure = shared.where("pi = 0").select("doc_id", "source", "tokens", F.col("sure").alias("copies"))
    mixed = drawn.select("doc_id", "source", "tokens", (F.col("sure") + F.col("p").cast("int")).alias("copies")).unionByName(sure)
    return mixed.where("copies > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, docs, tokens, max_copies) of every source with a target; 0 where it gave nothing."""
    by = mixed.groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("max_copies"))
    total = by.agg(F.sum("tokens").alias("all"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return targets.where("source is not null").select("source", "target_share").join(by, "source", "left").crossJoin(F.broadcast(total)).select(
        "source", "target_share", F.round(zero("tokens") / F.greatest(F.coalesce("all", F.lit(0)), F.lit(1)), 6).alias("actual_share"), zero("docs").alias("docs"), zero("tokens").alias("tokens"), zero("max_copies").alias("max_copies")
    )
