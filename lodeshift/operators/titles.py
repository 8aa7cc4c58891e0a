"""Titles to families and seniorities, and how near two titles are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeshift.functions import refdata as R


def clean_title(title):
    """Lower case; punctuation, roman numerals and digits become blanks."""
    t = F.regexp_replace(F.lower(F.trim(title)), r"[^a-z0-9+# ]", " ")
    t = F.regexp_replace(t, r"\b(i{1,3}|iv|v|vi{1,3}|ix|x)\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\b[0-9]+\b", " "), r"\s+", " "))


def normalise_titles(titles: DataFrame, column: str = "title") -> DataFrame:
    """(title, cleaned, family, seniority) of each distinct title; family NULL where none is recognised.

    A whole-title pattern decides; else inflated words give a family and ``senior``, the highest seniority word wins and
    the longest family word shows the family (the first in order on ties). Reference data are literal maps and arrays
    in the plan, so distinct titles pass in one projection; blank and NULL titles have no family.
    """
    seniority = {s: i for i, s in enumerate(R.SENIORITY)}
    pairs = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    family_of, level_of = pairs({t: f for t, f, _ in R.TITLES}), pairs({t: s for t, _, s in R.TITLES})
    inflated, index = pairs(R.INFLATION), pairs(seniority)
    words = F.array(*[F.struct(F.lit(len(k)).alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("k"), F.lit(f).alias("f")) for f, k, i in R.keywords()])
    levels = F.array(*[F.lit(s) for s in R.SENIORITY])
    base = titles.select(F.col(column).alias("title")).where(r"title is not null and title rlike '\\S'").distinct().withColumn("cleaned", clean_title(F.col("title")))
    base = base.withColumn("tokens", F.split("cleaned", " "))
    puffed = F.filter(F.transform("tokens", lambda t: inflated[t]), lambda f: f.isNotNull())
    top = F.array_max(F.filter(F.transform("tokens", lambda t: index[t]), lambda i: i.isNotNull()))
    base = base.withColumn("puffed", puffed).withColumn("top", top)
    seen = F.array_max(F.filter(words, lambda w: F.contains(F.col("cleaned"), w["k"])))
    start = F.when(F.size("puffed") > 0, F.lit(seniority["senior"]))
    level = F.greatest(start, F.col("top"))
    family = F.coalesce(family_of[F.col("cleaned")], F.get("puffed", F.lit(0)), seen["f"])
    grade = F.coalesce(level_of[F.col("cleaned")], F.get(levels, level), F.lit("mid"))
    return base.select("title", "cleaned", family.alias("family"), F.when(family.isNotNull(), grade).alias("seniority"))


def title_similarity(pairs: DataFrame) -> DataFrame:
    """Adds similarity to (family, other): 1.0 equal, 0.55 next to each other either way, else 0.15; 0 where one is NULL."""
    near = pairs.sparkSession.createDataFrame(R.adjacency(), "family string, other string").withColumn("near", F.lit(True))
    joined = pairs.join(F.broadcast(near), ["family", "other"], "left")
    value = F.when(F.col("family").isNull() | F.col("other").isNull(), 0.0).when(F.col("family") == F.col("other"), 1.0).when(F.col("near"), 0.55).otherwise(0.15)
    return joined.withColumn("similarity", value).drop("near")


def seniority_index(column):
    return F.create_map(*[F.lit(x) for i, s in enumerate(R.SENIORITY) for x in (s, i)])[column]
