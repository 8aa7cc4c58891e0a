"""Group statistics of selections: rates, ratios, intervals, exact tests, leave-one-out means; redaction of identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL = 30  # groups below this many members are marked


def group_impact(cards: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """(group, n, selected, rate, ratio, reference, small): selection rates against the group with the highest rate.

    ``cards`` has candidate_id, composite, selected; chosen is who is selected or reaches the threshold. Who has no group
    doesn't count. The per-group counts, as many rows as groups, meet the reference in one row.
    """
    chosen = F.coalesce(F.col("selected"), F.lit(False)) | (F.col("composite") >= threshold)
    by = cards.join(groups, "candidate_id").groupBy("group").agg(F.count("*").alias("n"), F.sum(chosen.cast("int")).alias("selected")).withColumn("rate", F.col("selected") / F.col("n"))
    best = by.agg(F.min(F.struct(-F.col("rate"), F.col("group"), F.col("n"), F.col("selected"))).alias("r")).select(F.col("r.group").alias("reference"), (-F.col("r.col1")).alias("top"), F.col("r.n").alias("ref_n"), F.col("r.selected").alias("ref_selected"))
    ratio = F.when(F.col("top") > 0, F.col("rate") / F.col("top"))
    return by.crossJoin(F.broadcast(best)).select("group", "n", "selected", "rate", ratio.alias("ratio"), "reference", "ref_n", "ref_selected", (F.col("n") < SMALL).alias("small"))


def ratio_interval(selected: Column, n: Column, ref_selected: Column, ref_n: Column) -> tuple[Column, Column]:
    """95 % interval of the ratio of two rates on the log scale; half counts are added where a cell is 0 or full."""
    edge = (selected == 0) | (selected == n) | (ref_selected == 0) | (ref_selected == ref_n)
    half, whole = F.when(edge, 0.5).otherwise(0.0), F.when(edge, 1.0).otherwise(0.0)
    tg, tr = n + whole, ref_n + whole
    p1, p2 = (selected + half) / tg, (ref_selected + half) / tr
    se = F.sqrt((1 - p1) / (tg * p1) + (1 - p2) / (tr * p2))
    none = (n == 0) | (ref_n == 0) | (ref_selected == 0)
    low, high = F.ln(p1 / p2) - 1.96 * se, F.ln(p1 / p2) + 1.96 * se
    return F.when(~none, F.exp(F.greatest(low, F.lit(-700.0)))), F.when(~none, F.exp(F.least(high, F.lit(700.0))))


def fisher_exact(tables: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, p_value) of 2x2 tables with cells a, b, c, d, two-sided; 1 without variation, NULL without a row margin.

    The tables with the margins are a sequence exploded from the row, as far as forty standard deviations from the middle:
    beyond, a probability is below 1e-300 and adds nothing to a double. So the sequence grows with the root of the size.
    """
    whole = tables.select(*keys, "a", "b", "c", "d", (F.col("a") + F.col("b")).alias("r1"), (F.col("c") + F.col("d")).alias("r2"), (F.col("a") + F.col("c")).alias("c1"))
    n, r1, r2, c1 = (F.col("r1") + F.col("r2")).cast("double"), F.col("r1").cast("double"), F.col("r2").cast("double"), F.col("c1").cast("double")
    middle, reach = r1 * c1 / n, 40.0 * F.sqrt(r1 * r2 * c1 * (n - c1) / (n * n * F.greatest(n - 1.0, F.lit(1.0)))) + 40.0
    low = F.greatest(F.lit(0).cast("long"), F.col("c1") - F.col("r2"), F.floor(middle - reach))
    x = F.explode(F.sequence(low, F.least(F.col("r1"), F.col("c1"), F.ceil(middle + reach)))).alias("x")
    spread = whole.where("r1 > 0 and r2 > 0 and c1 > 0 and c1 < r1 + r2").select(*keys, "a", "r1", "r2", "c1", x)

    def log_choose(n: Column, k: Column) -> Column:
        return log_factorial(n) - log_factorial(k) - log_factorial(n - k)

    logp = log_choose(F.col("r1"), F.col("x")) + log_choose(F.col("r2"), F.col("c1") - F.col("x")) - log_choose(F.col("r1") + F.col("r2"), F.col("c1"))
    seen = log_choose(F.col("r1"), F.col("a")) + log_choose(F.col("r2"), F.col("c1") - F.col("a")) - log_choose(F.col("r1") + F.col("r2"), F.col("c1"))
    p = spread.withColumn("p", F.exp(logp)).withColumn("o", F.exp(seen)).where("p <= o * (1 + 1e-9)").groupBy(*keys).agg(F.sum("p").alias("p_value"))
    value = F.when((F.col("r1") == 0) | (F.col("r2") == 0), F.lit(None).cast("double")).when((F.col("c1") == 0) | (F.col("c1") == F.col("r1") + F.col("r2")), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.col("p_value")))
    return whole.join(p, keys, "left").select(*keys, value.alias("p_value"))


def log_factorial(n: Column) -> Column:
    """ln n!: summed up to 20, by Stirling's series (error below 1e-12) beyond."""
    x = n.cast("double") + 1.0
    series = (x - 0.5) * F.ln(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0))) - 1 / (1680 * F.pow(x, F.lit(7.0)))
    small = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(20)), F.lit(1)).cast("int")), F.lit(0.0), lambda acc, k: acc + F.ln(k.cast("double")))
    return F.when(n <= 20, small).otherwise(series)


def leave_one_out(scores: DataFrame, weights: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, dropped, mean_composite): mean renormalised composite of each group with one dimension left out."""
    active = scores.join(F.broadcast(weights), "dimension").where("value is not null and weight > 0").select("candidate_id", "dimension", "weight", "value")
    names = weights.select(F.col("dimension").alias("dropped"))
    kept = active.crossJoin(F.broadcast(names)).where("dimension <> dropped")
    one = kept.groupBy("candidate_id", "dropped").agg((F.sum(F.col("weight") * F.col("value")) / F.sum("weight")).alias("composite"))
    everyone = scores.select("candidate_id").distinct().join(groups, "candidate_id").crossJoin(F.broadcast(names))
    return everyone.join(one, ["candidate_id", "dropped"], "left").groupBy("group", "dropped").agg(F.round(F.avg(F.coalesce("composite", F.lit(0.0))), 6).alias("mean_composite"))


def scrub(text: Column, names: Column) -> Column:
    """Replaces each (key, value) of an array of structs in the text, longest keys first, literally."""
    ordered = F.reverse(F.array_sort(F.transform(names, lambda n: F.struct(F.length(n["key"]).alias("size"), n["key"].alias("key"), n["value"].alias("value")))))
    return F.aggregate(ordered, text, lambda acc, n: F.when(n["size"] > 0, F.replace(acc, n["key"], n["value"])).otherwise(acc))
