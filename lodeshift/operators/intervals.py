"""Overlapping and gapped intervals: continuous periods per entity and the gaps between them.

Rows are range-sorted over the whole table by (entity, start), so an entity of any size spreads over as many
partitions as its rows need. Each partition is summed up in one row (its last entity, that entity's largest end and
its last break); the summaries, one per partition and so bounded by the partition count, are combined as prefixes,
and a rescan carries each partition's inherited state to label the islands. Every period and gap is put out by
exactly one partition: no window by entity, no shuffle after the sort.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeshift.session import cut, shuffle_width

NONE = -(2**62)


def _segments(pdf: pd.DataFrame, entity, high: int):
    """Per row: whether an entity begins, and the largest end before it within the entity (NONE at its beginning)."""
    names, start, end = pdf["entity"].to_numpy(), pdf["start"].to_numpy("int64"), pdf["end"].to_numpy("int64")
    new = np.empty(len(names), bool)
    new[0] = entity is None or names[0] != entity
    new[1:] = names[1:] != names[:-1]
    segment = np.cumsum(new)
    # A running maximum that restarts with each segment: ends are ranked, segments shift the ranks.
    values, rank = np.unique(np.append(end, NONE if entity is None else high), return_inverse=True)
    width = len(values) + 1
    lead = rank[-1] + 1 if not new[0] else 0
    shifted = np.append(segment[0] * width + lead, segment * width + rank[:-1] + 1)
    run = np.maximum.accumulate(shifted)
    before = np.where(new, NONE, values[np.maximum(run[:-1] - segment * width - 1, 0)])
    return names, start, end, new, before


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    first = last = None
    high, opened = NONE, NONE
    for pdf in batches:
        if not len(pdf):
            continue
        names, start, end, new, before = _segments(pdf, last, high)
        first = names[0] if first is None else first
        at = np.flatnonzero(new)
        tail = at[-1] if len(at) else 0
        if len(at):
            high = NONE
        last = names[-1]
        # A step so large that no end reaches it marks the beginning of an entity, whatever comes before.
        broken = np.flatnonzero((start[tail:] > before[tail:] + 1) | new[tail:])
        if len(broken):
            opened = start[tail + broken[-1]]
        high = max(high, int(end[tail:].max()))
    if first is not None:
        yield pd.DataFrame({"pid": [TaskContext.get().partitionId()], "first": [first], "last": [last], "high": [high], "opened": [opened]})


def _carry(rows: list) -> dict[int, tuple]:
    """For each partition: the state it inherits, (entity, largest end, begin of the open island), and the entity that follows it."""
    rows = sorted(rows, key=lambda r: r["pid"])
    state, out = (None, NONE, NONE), {}
    for i, r in enumerate(rows):
        follows = rows[i + 1]["first"] if i + 1 < len(rows) else None
        inherits = state[0] is not None and state[0] == r["first"]  # else that entity ended with the partition before
        out[r["pid"]] = (*(state if inherits else (None, NONE, NONE)), follows)
        same = state[0] is not None and state[0] == r["last"]  # sorted: then the whole partition is this entity
        high, opened = (state[1], state[2]) if same else (NONE, NONE)
        state = (r["last"], max(high, r["high"]), r["opened"] if not same or r["opened"] > high + 1 else opened)
    return out


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, adjacent: int = 1) -> DataFrame:
    """Continuous periods and gaps of integer intervals, inclusive at both ends: (*keys, kind, from, to).

    ``kind`` is ``period`` or ``gap``; neighbours at a distance of ``adjacent`` join (1: touching, 0: only
    overlapping). Rows with a NULL key, start or end, and reversed rows, belong to nothing and are left out; repeated
    rows change nothing; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    spark = df.sparkSession
    clean = df.select(
        F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]).alias("_key"),
        F.col(f"`{start}`").cast("long").alias("start"),
        F.col(f"`{end}`").cast("long").alias("end"),
        *[F.col(f"`{k}`").alias(f"_n{i}") for i, k in enumerate(keys)],
    ).where(" and ".join(["start is not null", "end is not null", "start <= end", *(f"_n{i} is not null" for i in range(len(keys)))]))
    one = F.to_json("_key").alias("entity")  # a single sortable key, decoded at the end
    ordered = cut(
        clean.select(one, "start", (F.col("end") + F.lit(adjacent - 1)).alias("end"))
        .groupBy("entity", "start").agg(F.max("end").alias("end"))
        .repartitionByRange(shuffle_width(spark), "entity", "start")
        .sortWithinPartitions("entity", "start")
    )
    summaries = ordered.mapInPandas(_summaries, "pid int, first string, last string, high long, opened long").collect()
    carry = spark.sparkContext.broadcast(_carry(summaries))
    shift = adjacent - 1

    def rescan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = carry.value.get(TaskContext.get().partitionId())
        if state is None:
            return
        entity, high, opened, follows = state
        for pdf in batches:
            if not len(pdf):
                continue
            names, begin, finish, new, before = _segments(pdf, entity, high)
            broken = new | (begin > before + 1)
            at = np.flatnonzero(broken)
            inside = np.maximum.accumulate(np.where(broken, np.arange(len(names)), -1))
            # Largest end of the island so far: within an entity ends before a break never exceed the break.
            owner = np.append([entity], names[at])
            froms = np.append([opened], begin[at])
            runs = np.maximum(before, NONE)
            head = int(max(finish[inside < 0].max(initial=NONE), high if entity is not None else NONE))
            highs = [head]
            if len(at):
                highs.extend(np.maximum.reduceat(finish, at).tolist())
            highs = np.array(highs, dtype="int64")
            # The islands that a break closes; the last one stays open.
            done = slice(0, len(at))
            keep = np.array([o is not None for o in owner[done]], bool)
            yield pd.DataFrame({"entity": owner[done][keep], "kind": "period", "from": froms[done][keep], "to": highs[done][keep] - shift})
            gaps = at[~new[at]]
            yield pd.DataFrame({"entity": names[gaps], "kind": "gap", "from": runs[gaps] + 1 - shift, "to": begin[gaps] - 1})
            entity, opened, high = owner[-1], int(froms[-1]), int(highs[-1])
        if entity is not None and entity != follows:
            yield pd.DataFrame({"entity": [entity], "kind": ["period"], "from": [opened], "to": [high - shift]})

    found = ordered.mapInPandas(rescan, "entity string, kind string, from long, to long")
    types = dict(clean.dtypes)
    key = F.from_json("entity", types["_key"])
    return found.select(*[key[f"k{i}"].alias(k) for i, k in enumerate(keys)], "kind", "from", "to").where("kind = 'period' or `from` <= `to`")
