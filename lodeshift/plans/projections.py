"""The driver's tables seen as candidates, roles, evidence, requirements and score cards, in Spark and as SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeshift.functions import factors as X
from lodeshift.session import table

NOW = "2001-12-01"
REQUIRED = [("red widget", 5.0), ("small ring", 5.0), ("blue bolt", 4.0), ("large gear", 3.0), ("ring", 2.0)]
PREFERRED = [("hot rod", 3.0), ("cold plate", 1.0)]
TITLE = "Senior Data Engineer"
TITLES = {"1-URGENT": "Senior Data Engineer", "2-HIGH": "Data Analyst", "3-MEDIUM": "Junior Software Engineer", "4-NOT SPECIFIED": "Product Manager", "5-LOW": "Rockstar Developer"}
MIN_YEARS, TARGET_YEARS = 2, 5


def now():
    return F.to_date(F.lit(NOW))


def candidate_id(column: str):
    return F.concat(F.lit("c_"), F.lpad(F.col(column).cast("string"), 8, "0"))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    nation = F.broadcast(table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("domain")))  # 25 rows at any scale
    return table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        candidate_id("c_custkey").alias("candidate_id"), F.col("c_custkey").alias("k"), F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("group"), "domain"
    )


def roles(spark: SparkSession, d: str) -> DataFrame:
    start = F.to_date("o_orderdate")
    months = (F.lit(1) + F.col("o_orderkey") % 12).cast("int")
    title, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, v in TITLES.items():
        title = F.when(F.col("o_orderpriority") == k, v).otherwise(title)
    for k, v in (("F", "full_time"), ("O", "contract"), ("P", "internship")):
        kind = F.when(F.col("o_orderstatus") == k, v).otherwise(kind)
    return table(spark, d, "orders").select(
        candidate_id("o_custkey").alias("candidate_id"), F.col("o_orderkey").alias("role_id"), start.alias("s"), F.least(F.add_months(start, months), now()).alias("e"), title.alias("title"), kind.alias("employment_type")
    )


def evidence(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag").isin("A", "R"), "narrated").otherwise("listed")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.to_date("l_shipdate").alias("last_used"), kind.alias("kind"), F.col("l_quantity").cast("int").alias("mentions"))
    parts = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("raw"), F.element_at(F.split("p_name", " "), -1).alias("parent"))
    orders = table(spark, d, "orders").select("o_orderkey", candidate_id("o_custkey").alias("candidate_id"))
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("candidate_id", "raw", "parent", "last_used", "kind", "mentions")


def matched(spark: SparkSession, d: str, rows: list[tuple[str, float]]) -> DataFrame:
    """(candidate_id, skill, route, last_used, kind): the evidence that meets a wanted skill, exactly or as its child.

    The few wanted names pick the parts first, with their routes; lines meet those parts once, and orders come last.
    """
    names = [s for s, _ in rows]
    raw, parent = F.col("p_name"), F.element_at(F.split("p_name", " "), -1)
    ways = F.array(F.struct(raw.alias("skill"), F.lit("exact").alias("route")), F.struct(F.when(parent != raw, parent).alias("skill"), F.lit("child").alias("route")))
    parts = table(spark, d, "part").where(raw.isin(*names) | parent.isin(*names)).select("p_partkey", F.explode(F.filter(ways, lambda x: x["skill"].isin(*names))).alias("x")).select("p_partkey", "x.skill", "x.route")
    kind = F.when(F.col("l_returnflag").isin("A", "R"), "narrated").otherwise("listed")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.to_date("l_shipdate").alias("last_used"), kind.alias("kind"))
    orders = table(spark, d, "orders").select("o_orderkey", candidate_id("o_custkey").alias("candidate_id"))
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("candidate_id", "skill", "route", "last_used", "kind")


def wanted(spark: SparkSession, rows: list[tuple[str, float]]) -> DataFrame:
    return spark.createDataFrame(rows, "skill string, weight double")


def weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(X.WEIGHTS.items()), "dimension string, weight double")


def score_table(spark: SparkSession, d: str) -> DataFrame:
    """Long sub-scores of every candidate, derived from its key; one dimension NULL for every 17th."""
    c = candidates(spark, d).select("candidate_id", "k")
    dims = F.array(*[F.struct(F.lit(name).alias("dimension"), F.lit(i).alias("i")) for i, name in enumerate(X.WEIGHTS)])
    long = c.select("candidate_id", "k", F.explode(dims).alias("x")).select("candidate_id", "k", "x.dimension", "x.i")
    value = ((F.col("k") * (F.col("i") * 7 + 13) + F.col("i") * 31) % 1009) / 10.09
    gone = (F.col("k") % 17 == 0) & (F.col("i") == F.col("k") % 10)
    return long.select("candidate_id", "k", "dimension", F.when(~gone, F.round(value, 6)).alias("value"))


def findings(spark: SparkSession, d: str) -> DataFrame:
    c = candidates(spark, d).select("candidate_id", "k")
    return c.where("k % 11 = 0").select("candidate_id", F.lit("KEYWORD_STUFFING").alias("code")).unionByName(c.where("k % 23 = 0").select("candidate_id", F.lit("HIDDEN_TEXT").alias("code")))


_titles = " ".join(f"when '{k}' then '{v}'" for k, v in TITLES.items())
_values = lambda rows: ", ".join(f"('{s}', {w}e0)" for s, w in rows)
CAND = "cand as (select 'c_'||lpad(cast(c_custkey as varchar),8,'0') candidate_id, c_custkey k, c_name full_name, c_mktsegment grp, n_name as domain from customer join nation on c_nationkey=n_nationkey)"
ROLES = f"""roles as (select 'c_'||lpad(cast(o_custkey as varchar),8,'0') candidate_id, o_orderkey role_id, cast(o_orderdate as date) s,
  least(cast(cast(o_orderdate as date) + to_months(cast(1+o_orderkey%12 as int)) as date), date '{NOW}') e, case o_orderpriority {_titles} end title,
  case o_orderstatus when 'F' then 'full_time' when 'O' then 'contract' when 'P' then 'internship' end employment_type from orders)"""
EVID = """evid as (select 'c_'||lpad(cast(o_custkey as varchar),8,'0') candidate_id, p_name raw, split_part(p_name,' ',-1) parent, cast(l_shipdate as date) last_used,
  case when l_returnflag in ('A','R') then 'narrated' else 'listed' end kind from lineitem join part on l_partkey=p_partkey join orders on l_orderkey=o_orderkey)"""
WANT = f"want(skill,weight) as (values {_values(REQUIRED)})"
PREF = f"want(skill,weight) as (values {_values(PREFERRED)})"
BEST = f"""hit as (select e.candidate_id, w.skill, case when e.raw=w.skill then 1e0 else 0.9e0 end f, case e.kind when 'narrated' then 0.8e0 else 0.55e0 end p, e.last_used from evid e join want w on e.raw=w.skill or (e.parent=w.skill and e.parent<>e.raw)),
best as (select candidate_id, skill, max(f*p*greatest(0.5e0, least(1e0, exp(-ln(2e0)*(greatest((year(date '{NOW}')*12+month(date '{NOW}'))-(year(last_used)*12+month(last_used)),0)/12e0)/4e0)))) m,
  max(greatest(0.5e0, least(1e0, exp(-ln(2e0)*(greatest((year(date '{NOW}')*12+month(date '{NOW}'))-(year(last_used)*12+month(last_used)),0)/12e0)/4e0)))) best_recency from hit group by 1,2)"""
_dims = ", ".join(f"('{n}',{i},{w}e0)" for i, (n, w) in enumerate(X.WEIGHTS.items()))
SCORES = f"""dims(dimension,i,weight) as (values {_dims}), scores as (select candidate_id, k, dimension, weight, case when not (k%17=0 and i=k%10) then round(((k*(i*7+13)+i*31)%1009)/10.09e0,6) end as value from cand cross join dims)"""
COMPOSITE = """act as (select candidate_id, sum(weight) total from scores where value is not null and weight>0 group by 1),
base as (select s.candidate_id, round(coalesce(sum(case when value is not null then round(weight*value/total,2) end),0),2) base from scores s left join act a on a.candidate_id=s.candidate_id group by 1),
pen as (select candidate_id, least(25e0, (case when k%11=0 then 10e0 else 0 end)+(case when k%23=0 then 25e0 else 0 end)) penalty from cand),
comp as (select b.candidate_id, base, penalty, greatest(0e0, least(100e0, round(base-penalty,2))) composite from base b join pen p on p.candidate_id=b.candidate_id)"""
BAND = "case when composite>=85 then 'exceptional' when composite>=70 then 'strong' when composite>=55 then 'moderate' when composite>=40 then 'weak' else 'not_a_match' end"
