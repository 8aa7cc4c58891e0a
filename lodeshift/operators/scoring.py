"""Evidence, the ten dimensions, the composite and the ranking, over long tables keyed by job and candidate.

Evidence meets the requirements by equal joins of names (never by a product of both), maxima are taken by partial
aggregates before any shuffle, and every dimension gives (candidate_id, dimension, value), so that composites and
statistics are group-bys over one table. Candidates without rows get the defined value, not a missing row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeshift.functions import factors as X
from lodeshift.operators.intervals import merge_intervals
from lodeshift.session import cut, is_bounded, shuffle_width, stored


def match_evidence(evidence: DataFrame, wanted: DataFrame) -> DataFrame:
    """Evidence (candidate_id, raw, parent, last_used, kind) that meets a wanted skill (skill): exact, or as child of it.

    Two equal joins on names; NULL names meet nothing.
    """
    exact = evidence.select("candidate_id", F.col("raw").alias("skill"), "last_used", "kind", F.lit("exact").alias("route"))
    child = evidence.where("parent is not null and parent <> raw").select("candidate_id", F.col("parent").alias("skill"), "last_used", "kind", F.lit("child").alias("route"))
    return exact.unionByName(child).join(F.broadcast(wanted.select("skill").distinct()), "skill")


def best_match(matched: DataFrame, now: Column, timeless: Column | None = None) -> DataFrame:
    """The best factor per candidate and skill: (candidate_id, skill, m, best_recency)."""
    half = F.lit(X.HALF_LIFE) if timeless is None else F.when(timeless, X.HALF_LIFE_TIMELESS).otherwise(X.HALF_LIFE)
    rec = X.recency(X.years_since(F.col("last_used"), now), half, X.RECENCY_FLOOR)
    m = X.lookup(F.col("route"), X.MATCH) * X.lookup(F.col("kind"), X.PROFICIENCY, 0.40) * rec
    return matched.groupBy("candidate_id", "skill").agg(F.max(m).alias("m"), F.max(rec).alias("best_recency"))


def coverage(candidates: DataFrame, best: DataFrame, wanted: DataFrame, empty: float | None) -> DataFrame:
    """(candidate_id, value): weighted share of the wanted (skill, weight) that is met, 0 to 100; unmet weight counts.

    ``empty`` is the value where nothing is wanted. The weights' sum is one row, so met weights are summed alone.
    """
    total = wanted.agg(F.sum("weight").alias("total"))
    met = best.join(F.broadcast(wanted), "skill").groupBy("candidate_id").agg(F.sum(F.col("weight") * F.col("m")).alias("met"))
    value = F.when(F.col("total").isNull() | (F.col("total") == 0), F.lit(empty).cast("double")).otherwise(F.lit(100.0) * F.coalesce("met", F.lit(0.0)) / F.col("total"))
    return candidates.select("candidate_id").join(met, "candidate_id", "left").crossJoin(F.broadcast(total)).select("candidate_id", F.round(value, 6).alias("value"))


def top_recency(candidates: DataFrame, best: DataFrame, wanted: DataFrame, top: int = 3) -> DataFrame:
    """(candidate_id, value): mean best recency over the ``top`` wanted skills by weight, missing ones as 0."""
    first = wanted.orderBy(F.desc("weight"), "skill").limit(top)
    n = first.agg(F.count("*").alias("n"))
    met = best.join(F.broadcast(first), "skill").groupBy("candidate_id").agg(F.sum("best_recency").alias("met"))
    value = F.when(F.col("n") == 0, F.lit(None).cast("double")).otherwise(F.lit(100.0) * F.coalesce("met", F.lit(0.0)) / F.col("n"))
    return candidates.select("candidate_id").join(met, "candidate_id", "left").crossJoin(F.broadcast(n)).select("candidate_id", F.round(value, 6).alias("value"))


def relevant_years(roles: DataFrame) -> DataFrame:
    """(candidate_id, years): each covered month counts its largest relevance times its largest duration factor.

    ``roles`` has s, e (dates), relevance, factor; reversed or NULL ones don't count. A role spreads over its months,
    which a career bounds; the months meet by a hash aggregate with partial maxima.
    """
    month = F.explode(F.sequence(X.months_of(F.col("s")), X.months_of(F.col("e")))).alias("month")
    spread = roles.where("s is not null and e is not null and s <= e").select("candidate_id", "relevance", "factor", month)
    by_month = spread.groupBy("candidate_id", "month").agg(F.max("relevance").alias("r"), F.max("factor").alias("f"))
    return by_month.groupBy("candidate_id").agg((F.sum(F.col("r") * F.col("f")) / 12.0).alias("years"))


def covered_months(roles: DataFrame) -> DataFrame:
    """(candidate_id, months) covered by any role: the lengths of its continuous periods, a career spread over partitions."""
    span = roles.where("s is not null and e is not null and s <= e").select("candidate_id", X.months_of(F.col("s")).alias("a"), X.months_of(F.col("e")).alias("b"))
    periods = merge_intervals(span, ["candidate_id"], "a", "b").where("kind = 'period'")
    return periods.groupBy("candidate_id").agg(F.sum(F.col("to") - F.col("from") + 1).alias("months"))


def composite(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """(candidate_id, base): each active dimension's weighted term rounded to 2 places, weights of NULL ones redistributed.

    ``scores`` is (candidate_id, dimension, value), ``weights`` (dimension, weight). One shuffle by candidate: the
    active dimensions of a candidate, ten at most, travel as one array.
    """
    active = scores.join(F.broadcast(weights), "dimension").where("value is not null and weight > 0")
    one = active.groupBy("candidate_id").agg(F.sum("weight").alias("total"), F.collect_list(F.struct("weight", "value")).alias("terms"))
    terms = F.aggregate(F.col("terms"), F.lit(0.0), lambda acc, t: acc + F.round(t["weight"] * t["value"] / F.col("total"), 2))
    return scores.select("candidate_id").distinct().join(one, "candidate_id", "left").select("candidate_id", F.round(F.coalesce(terms, F.lit(0.0)), 2).alias("base"))


# Penalties by finding, and their cap.
PENALTIES = {"HIDDEN_TEXT": 25.0, "PROMPT_INJECTION": 25.0, "KEYWORD_STUFFING": 10.0}
PENALTY_CAP = 25.0


def penalised(base: DataFrame, findings: DataFrame) -> DataFrame:
    """(candidate_id, base, penalty, composite, band): penalties add up to the cap, the rest stays within 0 and 100."""
    taken = findings.groupBy("candidate_id").agg(F.round(F.least(F.lit(PENALTY_CAP), F.sum(X.lookup(F.col("code"), PENALTIES))), 2).alias("penalty"))
    penalty = F.coalesce("penalty", F.lit(0.0))
    score = X.clip(F.round(F.col("base") - penalty, 2), 0.0, 100.0)
    return base.join(taken, "candidate_id", "left").select("candidate_id", "base", penalty.alias("penalty"), score.alias("composite"), X.band(score).alias("band"))


def rank(cards: DataFrame, threshold: float, top: int | None = None, job: str = "job_id") -> DataFrame:
    """Adds rank and selected: by composite, S1, S4, confidence downwards (NULL as 0), then candidate_id.

    Cards are range-sorted by job and order over all partitions, so a job of any size is no single task; a rank is the
    place within its partition behind the counts of the partitions before, one row a partition and job. The sorted
    cards are kept with their places in the checkpoint folder, compressed, so that counts and places are of the same
    partitions.
    """
    spark = cards.sparkSession
    down = lambda c: F.desc(F.coalesce(F.col(c), F.lit(0.0)))
    order = [F.col(job), down("composite"), down("s1"), down("s4"), down("confidence"), F.col("candidate_id")]
    kept = cards.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    placed = stored(kept.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = placed.groupBy(job, "_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(job).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = cut(counts.select(F.col(job).alias("_job"), F.col("_part").alias("_p"), (before - F.col("_first")).alias("_shift")))
    starts = F.broadcast(starts) if is_bounded(starts, 100_000) else starts
    ranked = placed.join(starts, F.col(job).eqNullSafe(F.col("_job")) & (F.col("_part") == F.col("_p"))).withColumn("rank", (F.col("_place") + F.col("_shift") + 1).cast("int"))
    chosen = F.col("eligible") & (F.col("composite") >= threshold)
    return ranked.drop("_part", "_place", "_job", "_p", "_shift").withColumn("selected", chosen & (F.col("rank") <= top) if top is not None else chosen)
