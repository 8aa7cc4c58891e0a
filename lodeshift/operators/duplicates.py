"""Exact and near duplicates: content hashes, SimHash fingerprints, banded joins, contact identity."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeshift.operators.graph import connected_components
from lodeshift.session import cut

RADIUS = 3  # bits
_EDGES = (0, 13, 26, 39, 52, 64)  # five blocks of bits: fingerprints at most three bits apart are equal in two of them
COVERED_BYTES = 131072  # bytes of a content that its fingerprint covers (fixed value)


def exact_classes(df: DataFrame, key: str, hash_of: str) -> DataFrame:
    """(class_id, members, representative) of equal hashes with two members or more; the smallest key represents."""
    return df.where(F.col(hash_of).isNotNull()).groupBy(F.col(hash_of).alias("class_id")).agg(F.count("*").alias("members"), F.min(key).alias("representative")).where("members > 1")


def simhash(df: DataFrame, key: str, content: str) -> DataFrame:
    """(key, fingerprint): 64-bit SimHash over 4-byte chunks; a bit is set where more chunks have it than not.

    NULL or shorter contents have the fingerprint 0. Only the first ``COVERED_BYTES`` bytes count, as the definition says.
    """
    kind = dict(df.dtypes)[key]
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for raw in pdf["content"]:
                data = bytes(raw or b"")[:COVERED_BYTES]
                chunks = [data[i : i + 4] for i in range(0, len(data) - 3, 4)]
                if not chunks:
                    out.append(0)
                    continue
                names, counts = np.unique(np.array(chunks, dtype="S4"), return_counts=True)
                hashes = np.array([int.from_bytes(hashlib.blake2b(bytes(c).ljust(4, b"\0"), digest_size=8).digest(), "big") for c in names], dtype=np.uint64)
                bits = (hashes[:, None] & weights) != 0
                votes = (np.where(bits, 1, -1) * counts[:, None]).sum(0)
                out.append(int(np.where(votes > 0, weights, np.uint64(0)).sum(dtype=np.uint64).astype(np.int64)))
            yield pd.DataFrame({"key": pdf["key"], "fingerprint": pd.Series(out, dtype="int64")})

    return df.select(F.col(key).alias("key"), F.col(content).cast("binary").alias("content")).mapInPandas(run, f"key {kind}, fingerprint long")


def near_pairs(prints: DataFrame, key: str, fingerprint: str, radius: int = RADIUS) -> DataFrame:
    """(a, b, distance) of classes of equal fingerprints whose distance is 1 to ``radius``; a and b are fingerprints.

    Copies are one class and are not expanded. Two classes at the distance agree in at least two of five blocks of bits,
    so the equal join on the ten pairs of blocks, keys of about 25 bits, loses no pair and meets few strangers.
    """
    assert 0 < radius <= RADIUS
    classes = prints.where(F.col(fingerprint).isNotNull()).select(F.col(fingerprint).alias("f")).distinct()
    blocks = [(1 << high) - (1 << low) for low, high in zip(_EDGES, _EDGES[1:])]
    masks = [x | y for x, y in combinations(blocks, 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = cut(classes.select("f", F.posexplode(F.array(*[F.col("f").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("i", "v")))
    left, right = keys.select(F.col("f").alias("a"), "i", "v"), keys.select(F.col("f").alias("b"), "i", "v")
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    return left.join(right, ["i", "v"]).where("a < b").withColumn("distance", distance).where(F.col("distance") <= radius).select("a", "b", "distance").distinct()


def near_classes(prints: DataFrame, key: str, fingerprint: str, radius: int = RADIUS) -> DataFrame:
    """(key, class_id, links): one row per document with the class of its near duplicates and its number of near classes."""
    pairs = cut(near_pairs(prints, key, fingerprint, radius))
    comp = connected_components(pairs.select("a", "b"))
    degree = pairs.select(F.explode(F.array("a", "b")).alias("f")).groupBy("f").agg(F.count("*").alias("links"))
    docs = prints.select(F.col(key).alias("key"), F.col(fingerprint).alias("f"))
    return docs.join(comp.withColumnRenamed("node", "f"), "f", "left").join(degree, "f", "left").select("key", F.coalesce("component", "f").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def contact_key(name, emails, phones):
    """One key of a person: name in small letters, sorted addresses, digits of the numbers."""
    digits = F.array_sort(F.transform(phones, lambda p: F.regexp_replace(p, "[^0-9]", "")))
    return F.concat_ws("|", F.lower(F.coalesce(name, F.lit(""))), F.array_join(F.array_sort(F.transform(emails, lambda e: F.lower(e))), ","), F.array_join(digits, ","))
