"""Queries of evidence, dimensions, composite, ranking and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeshift.functions import factors as X
from lodeshift.operators import scoring as S
from lodeshift.operators import titles as T
from lodeshift.plans import projections as P
from lodeshift.plans.registry import query

THRESHOLD = 40.0
SELECT_AT = 55.0


@query("""with r(route) as (values ('exact'),('alias'),('child'),('parent'),('fuzzy'),('transferable'),('none')), p(kind) as (values ('applied_long'),('applied_short'),('narrated'),('listed'),('mentioned')), y(years) as (values (0e0),(1.5e0),(4e0),(12e0))
select route, kind, years, round((case route when 'exact' then 1e0 when 'alias' then 1e0 when 'child' then 0.9e0 when 'parent' then 0.7e0 when 'fuzzy' then 0.85e0 when 'transferable' then 0.5e0 else 0e0 end)
 *(case kind when 'applied_long' then 1e0 when 'applied_short' then 0.85e0 when 'narrated' then 0.8e0 when 'listed' then 0.55e0 else 0.4e0 end)*greatest(0.5e0,least(1e0,pow(2e0,-years/4e0))),6) m from r cross join p cross join y""")
def evd_factors(spark: SparkSession, d: str) -> DataFrame:
    row = spark.range(1).select(
        F.explode(F.array(*map(F.lit, [*X.MATCH, "none"]))).alias("route"), F.array(*map(F.lit, X.PROFICIENCY)).alias("kinds")
    ).select("route", F.explode("kinds").alias("kind"), F.array(*map(F.lit, (0.0, 1.5, 4.0, 12.0))).alias("y")).select("route", "kind", F.explode("y").alias("years"))
    m = X.lookup(F.col("route"), X.MATCH) * X.lookup(F.col("kind"), X.PROFICIENCY) * X.recency(F.col("years"), X.HALF_LIFE, X.RECENCY_FLOOR)
    return row.select("route", "kind", "years", F.round(m, 6).alias("m"))


@query(f"""with {P.EVID}, {P.WANT}, {P.BEST} select candidate_id, skill, round(m,6) m, round(best_recency,6) best_recency from best""")
def evd_best_match(spark: SparkSession, d: str) -> DataFrame:
    best = S.best_match(P.matched(spark, d, P.REQUIRED), P.now())
    return best.select("candidate_id", "skill", F.round("m", 6).alias("m"), F.round("best_recency", 6).alias("best_recency"))


@query(f"""with {P.WANT}, cand as (select distinct p_name name from part),
n as (select skill, name, regexp_replace(lower(skill),'[^a-z0-9+#]','','g') a, regexp_replace(lower(name),'[^a-z0-9+#]','','g') b, list_distinct(regexp_extract_all(lower(skill),'[a-z0-9]+')) ta, list_distinct(regexp_extract_all(lower(name),'[a-z0-9]+')) tb from want cross join cand)
select * from (select skill, name, case when a='' or b='' then null when a=b then 1e0 when length(a)>=4 and length(b)>=4 and (contains(b,a) or contains(a,b)) then 0.85e0
 when len(list_intersect(ta,tb))/len(ta)::double >= (case when len(ta)<=2 then 1e0 when len(ta)=3 then 2e0/3e0 else 0.75e0 end) then 0.55e0 end score from n) where score is not null""")
def evd_keyword_match(spark: SparkSession, d: str) -> DataFrame:
    return keyword_matches(P.wanted(spark, P.REQUIRED).select("skill"), P.table(spark, d, "part").select(F.col("p_name").alias("name")).distinct())


# Words that don't count for an overlap of phrases.
KEYWORD_STOP = "the a an and or in on at with of to for as is are such like including".split()


def keyword_matches(wanted: DataFrame, names: DataFrame) -> DataFrame:
    """(skill, name, score): 1 equal but for marks, 0.85 one within the other, 0.55 enough words in common.

    The wanted skills are one job's few rows, held in an array beside each name; names pass once, no pair list is shuffled.
    """
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9+#]", "")
    words = lambda c: F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1)), F.array(*map(F.lit, KEYWORD_STOP)))
    asked = wanted.agg(F.collect_set("skill").alias("asked"))
    pair = names.where("name is not null").crossJoin(F.broadcast(asked)).select("name", F.explode("asked").alias("skill"))
    a, b, ta, tb = plain(F.col("skill")), plain(F.col("name")), words(F.col("skill")), words(F.col("name"))
    share = F.size(F.array_intersect(ta, tb)) / F.size(ta)
    enough = F.when(F.size(ta) <= 2, 1.0).when(F.size(ta) == 3, 2.0 / 3.0).otherwise(0.75)
    inside = (F.length(a) >= 4) & (F.length(b) >= 4) & (F.contains(b, a) | F.contains(a, b))
    score = F.when((a == "") | (b == ""), F.lit(None).cast("double")).when(a == b, 1.0).when(inside, 0.85).when((F.size(ta) > 0) & (share >= enough), 0.55)
    return pair.select("skill", "name", score.alias("score")).where("score is not null")


def _coverage_sql(want: str, empty: str) -> str:
    return f"""with {P.CAND}, {P.EVID}, {want}, {P.BEST}, met as (select candidate_id, sum(weight*m) met from best join want using(skill) group by 1), t as (select sum(weight) total from want)
select c.candidate_id, round(case when total is null or total=0 then {empty} else 100e0*coalesce(met,0)/total end,6) as value from cand c left join met using(candidate_id) cross join t"""


@query(_coverage_sql(P.WANT, "100e0"))
def s1_required(spark: SparkSession, d: str) -> DataFrame:
    w = P.wanted(spark, P.REQUIRED)
    return S.coverage(P.candidates(spark, d), S.best_match(P.matched(spark, d, P.REQUIRED), P.now()), w, 100.0)


@query(_coverage_sql(P.PREF, "null"))
def s2_preferred(spark: SparkSession, d: str) -> DataFrame:
    w = P.wanted(spark, P.PREFERRED)
    return S.coverage(P.candidates(spark, d), S.best_match(P.matched(spark, d, P.PREFERRED), P.now()), w, None)


@query(f"""with {P.CAND}, {P.EVID}, {P.WANT}, {P.BEST}, top as (select skill from want order by weight desc, skill limit 3), met as (select candidate_id, sum(best_recency) met from best join top using(skill) group by 1)
select c.candidate_id, round(100e0*coalesce(met,0)/3,6) as value from cand c left join met using(candidate_id)""")
def s8_skill_recency(spark: SparkSession, d: str) -> DataFrame:
    w = P.wanted(spark, P.REQUIRED)
    return S.top_recency(P.candidates(spark, d), S.best_match(P.matched(spark, d, P.REQUIRED), P.now()), w)


# The five titles of the projection as the taxonomy reads them, for the SQL twins.
_TITLE_SQL = """tt(title,family,seniority,sim,gap) as (values ('Senior Data Engineer','data_engineering','senior',1e0,0),('Data Analyst','analytics','mid',0.55e0,-1),('Junior Software Engineer','software_engineering','junior',0.55e0,-3),
('Product Manager','product_management','mid',0.15e0,-1),('Rockstar Developer','software_engineering','senior',0.55e0,0))"""


def rated_titles(spark: SparkSession, d: str) -> DataFrame:
    """(title, family, seniority, similarity, gap) of the roles' titles against the job's."""
    target = T.normalise_titles(spark.createDataFrame([(P.TITLE,)], "title string")).first()
    seen = T.normalise_titles(P.roles(spark, d).select("title").distinct()).withColumn("other", F.lit(target["family"]))
    gap = F.coalesce(T.seniority_index(F.col("seniority")) - T.seniority_index(F.lit(target["seniority"])), F.lit(0))
    return T.title_similarity(seen).select("title", "cleaned", "family", "seniority", "similarity", gap.alias("gap"))


@query(f"""with {P.CAND}, {P.ROLES}, {P.WANT}, {_TITLE_SQL}, ov as (select l_orderkey role_id, count(distinct p_name)/{len(P.REQUIRED)}e0 o from lineitem join part on l_partkey=p_partkey where p_name in (select skill from want) group by 1), rel as (select candidate_id, s, e, greatest(0e0,least(1e0,0.35e0*sim+0.45e0*coalesce(o,0)+0.2e0*(case when family='data_engineering' then 1e0 else 0.2e0 end))) relevance, case when employment_type='internship' then 0.5e0 else 1e0 end f from roles join tt using(title) left join ov using(role_id) where s<=e),
mon as (select candidate_id, unnest(generate_series(year(s)*12+month(s)-1, year(e)*12+month(e)-1)) m, relevance, f from rel), bm as (select candidate_id, m, max(relevance) r, max(f) f from mon group by 1,2), y as (select candidate_id, sum(r*f)/12e0 n from bm group by 1)
select c.candidate_id, round(coalesce(n,0)+1e-9,4) as years, round(1e-9+case when coalesce(n,0)<1 then 40e0*coalesce(n,0) when n<2 then 40e0+30e0*(n-1) when n<=5 then 70e0+30e0*(n-2)/3e0 else 100e0 end,4) as value from cand c left join y using(candidate_id)""")
def s4_experience(spark: SparkSession, d: str) -> DataFrame:
    rated = P.roles(spark, d).join(F.broadcast(rated_titles(spark, d)), "title")
    # The share of the required skills that a role shows: parts of those names on the lines of its order.
    names = [skill for skill, _ in P.REQUIRED]
    shown = P.table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(P.table(spark, d, "part").where(F.col("p_name").isin(*names)).select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    overlap = shown.groupBy(F.col("l_orderkey").alias("role_id")).agg((F.count_distinct("p_name") / len(names)).alias("overlap"))
    rated = rated.join(overlap, "role_id", "left")
    domain = F.when(F.col("family") == "data_engineering", 1.0).otherwise(0.2)
    relevance = X.clip(0.35 * F.col("similarity") + 0.45 * F.coalesce("overlap", F.lit(0.0)) + 0.20 * domain, 0.0, 1.0)
    factor = F.when(F.col("employment_type") == "internship", 0.5).otherwise(1.0)
    years = S.relevant_years(rated.select("candidate_id", "s", "e", relevance.alias("relevance"), factor.alias("factor")))
    n = F.coalesce("years", F.lit(0.0))
    value = X.years_score(n, F.lit(float(P.MIN_YEARS)), F.lit(float(P.TARGET_YEARS)))
    return P.candidates(spark, d).select("candidate_id").join(years, "candidate_id", "left").select("candidate_id", F.round(n + 1e-9, 4).alias("years"), F.round(value + 1e-9, 4).alias("value"))


_REC6 = f"case when date_diff('day', e, date '{P.NOW}')<=0 then 1e0 else greatest(0.55e0, exp(-ln(2e0)*(date_diff('day', e, date '{P.NOW}')/365.2425e0)/6e0)) end"


def role_recency():
    years = X.years_by_days(F.col("e"), P.now())
    return F.when(years <= 0, 1.0).otherwise(X.recency(years, 6.0, 0.55))


@query(f"""with {P.CAND}, {P.ROLES}, {_TITLE_SQL}, b as (select candidate_id, max(sim*(case when gap<=-3 then 0.45e0 when gap=-2 then 0.7e0 when gap in (-1,0) then 1e0 when gap=1 then 0.95e0 else 0.85e0 end)*{_REC6}) best from roles join tt using(title) group by 1)
select c.candidate_id, round(100e0*coalesce(best,0),2) as value from cand c left join b using(candidate_id)""")
def s5_title(spark: SparkSession, d: str) -> DataFrame:
    rated = P.roles(spark, d).join(F.broadcast(rated_titles(spark, d)), "title")
    best = rated.groupBy("candidate_id").agg(F.max(F.col("similarity") * X.seniority_factor(F.col("gap")) * role_recency()).alias("best"))
    return P.candidates(spark, d).select("candidate_id").join(best, "candidate_id", "left").select("candidate_id", F.round(100.0 * F.coalesce("best", F.lit(0.0)), 2).alias("value"))


@query(f"""with {P.CAND}, {P.ROLES}, {_TITLE_SQL}, b as (select candidate_id, max((case when family='engineering' then 1e0 when contains('engineering',family) or contains(family,'engineering') then 0.6e0 else 0.2e0 end)*{_REC6}) best from roles join tt using(title) group by 1)
select c.candidate_id, round(100e0*greatest(coalesce(best,0.2e0),0.2e0),2) as value from cand c left join b using(candidate_id)""")
def s6_domain(spark: SparkSession, d: str) -> DataFrame:
    target = F.lit("engineering")
    rated = P.roles(spark, d).join(F.broadcast(rated_titles(spark, d)), "title")
    own = F.lower(F.coalesce("family", "title", F.lit("")))
    match = F.when(own == target, 1.0).when(F.contains(target, own) | F.contains(own, target), 0.6).otherwise(0.2)
    best = rated.groupBy("candidate_id").agg(F.max(match * role_recency()).alias("best"))
    return P.candidates(spark, d).select("candidate_id").join(best, "candidate_id", "left").select("candidate_id", F.round(100.0 * F.greatest(F.coalesce("best", F.lit(0.2)), F.lit(0.2)), 2).alias("value"))


# Ordinals of degrees.
DEGREES = {"high_school": 1, "high school": 1, "ged": 1, "associate": 2, "associates": 2, "bachelor": 3, "bachelors": 3, "undergraduate": 3, "bs": 3, "ba": 3, "bsc": 3, "btech": 3, "be": 3, "bca": 3, "master": 4, "masters": 4, "mba": 4, "mca": 4, "msc": 4, "ms": 4, "mtech": 4, "ma": 4, "doctorate": 5, "phd": 5, "doctoral": 5}
_DEG = " ".join(f"when '{k}' then {v}" for k, v in DEGREES.items())
_LEVEL = f"case replace(replace(lower(trim(degree_level)),'.',''),'''','') {_DEG} else 0 end"


@query(f"""with e as (select candidate_id, coalesce(max({_LEVEL}),0) lvl, coalesce(bool_or(field='informatics'),false) fit, count(field)>0 has from education where candidate_id is not null group by 1), c as (select distinct candidate_id from resumes where candidate_id is not null)
select candidate_id, round(100e0*(0.6e0*(case when coalesce(lvl,0)>=3 and coalesce(fit,false) then 1e0 when coalesce(lvl,0)>=3 and coalesce(has,false) then 0.8e0 else greatest(0.2e0,least(1e0,coalesce(lvl,0)/3e0)) end)+0.4e0),2) as value from c left join e using(candidate_id)""")
def s7_education(spark: SparkSession, d: str) -> DataFrame:
    """Education against a bachelor's degree in informatics; no certificates asked for, so their part is full."""
    level = F.coalesce(F.create_map(*[F.lit(x) for kv in DEGREES.items() for x in kv])[F.regexp_replace(F.lower(F.trim("degree_level")), "[.']", "")], F.lit(0))
    by = P.table(spark, d, "education").where("candidate_id is not null").groupBy("candidate_id").agg(F.max(level).alias("lvl"), F.coalesce(F.bool_or(F.col("field") == "informatics"), F.lit(False)).alias("fit"), (F.count("field") > 0).alias("has"))
    lvl, fit, has = F.coalesce("lvl", F.lit(0)), F.coalesce("fit", F.lit(False)), F.coalesce("has", F.lit(False))
    edu = F.when((lvl >= 3) & fit, 1.0).when((lvl >= 3) & has, 0.8).otherwise(X.clip(lvl / 3.0, 0.2, 1.0))
    people = P.table(spark, d, "resumes").where("candidate_id is not null").select("candidate_id").distinct()
    return people.join(by, "candidate_id", "left").select("candidate_id", F.round(100.0 * (0.6 * edu + 0.4), 2).alias("value"))


def certificate_match(certs: DataFrame, required: DataFrame, today) -> DataFrame:
    """(candidate_id, share): weighted share of required certificates (name, weight) held; expired 0.40, pending 0.50."""
    status = F.lower(F.trim("status"))
    factor = F.when(status.isin("in-progress", "candidate", "pending"), 0.50).when(F.col("expires") < today, 0.40).otherwise(1.0)
    total = required.agg(F.sum("weight").alias("total"))
    held = certs.select("candidate_id", F.lower(F.trim("name")).alias("name"), factor.alias("f")).join(F.broadcast(required), "name").groupBy("candidate_id", "name").agg(F.max(F.col("weight") * F.col("f")).alias("w"))
    return held.groupBy("candidate_id").agg(F.sum("w").alias("w")).crossJoin(F.broadcast(total)).select("candidate_id", F.round(X.clip(F.col("w") / F.col("total"), 0.0, 1.0), 6).alias("share"))


_CERTS = "c as (select 'c_'||lpad(cast(c_custkey as varchar),8,'0') candidate_id, case c_custkey%3 when 0 then 'Kernel Cert' when 1 then 'cloud cert ' else 'other' end nm, case when c_custkey%4=0 then date '2001-01-01' else date '2002-06-01' end expires, case when c_custkey%7=0 then 'Pending' else 'held' end status from customer)"


@query(f"""with {_CERTS}, r(nm,weight) as (values ('kernel cert',2e0),('cloud cert',1e0)) select candidate_id, round(max(weight*(case when lower(status) in ('in-progress','candidate','pending') then 0.5e0 when expires<date '{P.NOW}' then 0.4e0 else 1e0 end))/3e0,6) share from c join r on lower(trim(c.nm))=r.nm group by 1""")
def s7_certificates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    certs = P.table(spark, d, "customer").select(
        P.candidate_id("c_custkey").alias("candidate_id"), F.when(k % 3 == 0, "Kernel Cert").when(k % 3 == 1, "cloud cert ").otherwise("other").alias("name"),
        F.when(k % 4 == 0, F.to_date(F.lit("2001-01-01"))).otherwise(F.to_date(F.lit("2002-06-01"))).alias("expires"), F.when(k % 7 == 0, "Pending").otherwise("held").alias("status"),
    )
    return certificate_match(certs, spark.createDataFrame([("kernel cert", 2.0), ("cloud cert", 1.0)], "name string, weight double"), P.now())


# Ordinals of seniority words in the order in which they are looked for.
TRAJECTORY = (("intern", 0), ("entry", 1), ("junior", 1), ("associate", 2), ("mid", 2), ("senior", 3), ("lead", 3), ("staff", 4), ("principal", 5), ("director", 5), ("vp", 6), ("executive", 7), ("c-level", 7))
_TRAJ = " ".join(f"when contains(lower(title),'{w}') then {n}" for w, n in TRAJECTORY)


@query(f"""with {P.CAND}, {P.ROLES}, o as (select *, case {_TRAJ} else 2 end lvl, (year(e)-year(s))*12+month(e)-month(s) as months from roles), r as (select candidate_id, count(*) n, arg_min(lvl, (s, role_id)) first_lvl, arg_max(lvl, (s, role_id)) last_lvl from o where e >= date '{P.NOW}' - interval 72 month group by 1),
t as (select candidate_id, cast(floor(quantile_cont(months,0.5)) as int) med from o where employment_type not in ('contract','freelance') and months>0 group by 1)
select c.candidate_id, round(100e0*(0.5e0*(case when coalesce(n,0)<2 then 0.7e0 when last_lvl>first_lvl then 1e0 when last_lvl=first_lvl then 0.7e0 else 0.4e0 end)+0.5e0*(case when med>=24 then 1e0 when med>=12 then 0.75e0 else 0.45e0 end)),2) as value from cand c left join r using(candidate_id) left join t using(candidate_id)""")
def s9_trajectory(spark: SparkSession, d: str) -> DataFrame:
    level = F.lit(2)
    for word, n in reversed(TRAJECTORY):
        level = F.when(F.contains(F.lower("title"), F.lit(word)), n).otherwise(level)
    months = (F.year("e") - F.year("s")) * 12 + F.month("e") - F.month("s")
    r = P.roles(spark, d).withColumn("lvl", level).withColumn("months", months)
    order = F.struct(F.coalesce("s", F.to_date(F.lit("0001-01-01"))), "role_id")
    recent, settled = F.col("e") >= F.add_months(P.now(), -72), (~F.col("employment_type").isin("contract", "freelance")) & (F.col("months") > 0)
    by = r.groupBy("candidate_id").agg(F.sum(recent.cast("int")).alias("n"), F.min_by("lvl", F.when(recent, order)).alias("first_lvl"), F.max_by("lvl", F.when(recent, order)).alias("last_lvl"), F.floor(F.percentile(F.when(settled, F.col("months")), 0.5)).alias("med"))
    path = F.when(F.coalesce("n", F.lit(0)) < 2, 0.7).when(F.col("last_lvl") > F.col("first_lvl"), 1.0).when(F.col("last_lvl") == F.col("first_lvl"), 0.7).otherwise(0.4)
    stay = F.when(F.col("med") >= 24, 1.0).when(F.col("med") >= 12, 0.75).otherwise(0.45)
    return P.candidates(spark, d).select("candidate_id").join(by, "candidate_id", "left").select("candidate_id", F.round(100.0 * (0.5 * path + 0.5 * stay), 2).alias("value"))


@query("""with r as (select candidate_id, count(*)>0 has, count(*) filter (not regexp_matches(coalesce(start_date,''),'[12][0-9]{3}')) bad, count(*) n from experience where candidate_id is not null group by 1), e as (select candidate_id, true has from education where candidate_id is not null group by 1),
s as (select candidate_id, bool_or(regexp_matches(coalesce(skills,''),'\\S')) has from resumes where candidate_id is not null group by 1)
select s.candidate_id, 100e0 - 15e0*least(2, (case when r.has is null then 1 else 0 end)+(case when e.has is null then 1 else 0 end)+(case when s.has then 0 else 1 end)) - (case when coalesce(bad,0) > 0.25e0*coalesce(n,0) and n>0 then 15e0 else 0e0 end) as value from s left join r using(candidate_id) left join e using(candidate_id)""")
def s10_parseability(spark: SparkSession, d: str) -> DataFrame:
    have = lambda t: P.table(spark, d, t).where("candidate_id is not null")
    roles = have("experience").groupBy("candidate_id").agg(F.count("*").alias("n"), F.sum((~F.coalesce("start_date", F.lit("")).rlike("[12][0-9]{3}")).cast("int")).alias("bad"))
    schools = have("education").select("candidate_id", F.lit(1).alias("school")).distinct()
    skills = have("resumes").groupBy("candidate_id").agg(F.bool_or(F.coalesce("skills", F.lit("")).rlike(r"\S")).alias("listed"))
    missing = F.col("n").isNull().cast("int") + F.col("school").isNull().cast("int") + (~F.col("listed")).cast("int")
    undated = F.coalesce(F.col("bad") > 0.25 * F.col("n"), F.lit(False))
    return skills.join(roles, "candidate_id", "left").join(schools, "candidate_id", "left").select("candidate_id", (100.0 - 15.0 * F.least(missing, F.lit(2)) - F.when(undated, 15.0).otherwise(0.0)).alias("value"))


def cards(spark: SparkSession, d: str) -> DataFrame:
    """(job_id, candidate_id, base, penalty, composite, band, s1, s4, confidence, eligible) of every candidate."""
    scores = P.score_table(spark, d)
    comp = S.penalised(S.composite(scores, P.weights(spark)), P.findings(spark, d))
    wide = scores.groupBy("candidate_id", "k").agg(*[F.max(F.when(F.col("dimension") == n, F.col("value"))).alias(n.lower()) for n in ("S1", "S4")])
    conf = F.round((F.col("k") % 101) / 100.0, 6)
    return comp.join(wide, "candidate_id").select(F.lit("j1").alias("job_id"), "candidate_id", "k", "base", "penalty", "composite", "band", "s1", "s4", conf.alias("confidence"), (F.col("k") % 13 != 0).alias("eligible"))


_CARDS = f"""{P.CAND}, {P.SCORES}, {P.COMPOSITE}, wide as (select candidate_id, k, max(case when dimension='S1' then value end) s1, max(case when dimension='S4' then value end) s4 from scores group by 1,2),
cards as (select 'j1' job_id, c.candidate_id, k, base, penalty, composite, {P.BAND} band, s1, s4, round((k%101)/100e0,6) confidence, k%13<>0 eligible from comp c join wide w on w.candidate_id=c.candidate_id),
ranked as (select *, row_number() over (partition by job_id order by composite desc, coalesce(s1,0) desc, coalesce(s4,0) desc, coalesce(confidence,0) desc, candidate_id) rank, eligible and composite>={SELECT_AT}e0 selected from cards)"""


@query(f"with {P.CAND}, {P.SCORES}, {P.COMPOSITE} select candidate_id, base, penalty, composite, {P.BAND} band from comp")
def agg_composite(spark: SparkSession, d: str) -> DataFrame:
    return S.penalised(S.composite(P.score_table(spark, d), P.weights(spark)), P.findings(spark, d))


@query(f"""with {P.CAND}, {P.SCORES}, ev as (select candidate_id, dimension, (k+length(dimension)*3+n)%5 a, n%3 b, n from scores cross join (values (1),(2),(3)) t(n) where value is not null and (k+n)%3=0),
den as (select candidate_id, count(distinct (a,b,dimension)) spans from ev group by 1), act as (select candidate_id, k, count(value) n from scores group by 1,2)
select candidate_id, round(greatest(0e0,least(1e0,0.3e0*((k%11)/10e0)+0.25e0*(case when k%5=0 then (k%7)/6e0 else 1e0 end)+0.25e0*(case when n=0 then 0e0 else least(1e0,coalesce(spans,0)/n::double) end)+0.2e0)),6) confidence from act left join den using(candidate_id)""")
def agg_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Completeness, extraction quality, distinct cited spans per active dimension, and full agreement offline."""
    scores = P.score_table(spark, d)
    n = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("n")
    cited = scores.where("value is not null").select("candidate_id", "k", "dimension", n).where("(k + n) % 3 = 0")
    span = F.struct(((F.col("k") + F.length("dimension") * 3 + F.col("n")) % 5).alias("a"), (F.col("n") % 3).alias("b"), "dimension")
    density = cited.groupBy("candidate_id").agg(F.count_distinct(span).alias("spans"))
    active = scores.groupBy("candidate_id", "k").agg(F.count("value").alias("n"))
    quality = F.when(F.col("k") % 5 == 0, (F.col("k") % 7) / 6.0).otherwise(1.0)
    dense = F.when(F.col("n") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.coalesce("spans", F.lit(0)) / F.col("n")))
    value = X.clip(0.3 * ((F.col("k") % 11) / 10.0) + 0.25 * quality + 0.25 * dense + 0.2, 0.0, 1.0)
    return active.join(density, "candidate_id", "left").select("candidate_id", F.round(value, 6).alias("confidence"))


@query(f"with {_CARDS} select candidate_id, composite, rank, selected from ranked")
def agg_rank_select(spark: SparkSession, d: str) -> DataFrame:
    return S.rank(cards(spark, d), SELECT_AT).select("candidate_id", "composite", "rank", "selected")


@query(f"with {_CARDS} select count(*) candidates, sum(selected::int) selected, sum((not eligible)::int) excluded, round(avg(selected::int),6) selected_share, round(avg((not eligible)::int),6) excluded_share, avg(selected::int)>0.4 high_selection, avg((not eligible)::int)>0.6 high_exclusion, round(quantile_cont(composite,0.1),6) p10, round(quantile_cont(composite,0.9),6) p90 from ranked")
def agg_manifest(spark: SparkSession, d: str) -> DataFrame:
    sel, out = (F.col("eligible") & (F.col("composite") >= SELECT_AT)).cast("int"), (~F.col("eligible")).cast("int")
    return cards(spark, d).agg(
        F.count("*").alias("candidates"), F.sum(sel).alias("selected"), F.sum(out).alias("excluded"), F.round(F.avg(sel), 6).alias("selected_share"), F.round(F.avg(out), 6).alias("excluded_share"),
        (F.avg(sel) > 0.4).alias("high_selection"), (F.avg(out) > 0.6).alias("high_exclusion"), F.round(F.percentile("composite", 0.1), 6).alias("p10"), F.round(F.percentile("composite", 0.9), 6).alias("p90"),
    )


@query(f"with {_CARDS} select band, count(*) n, sum(selected::int) selected from ranked group by 1")
def agg_audit_bands(spark: SparkSession, d: str) -> DataFrame:
    sel = (F.col("eligible") & (F.col("composite") >= SELECT_AT)).cast("int")
    return cards(spark, d).groupBy("band").agg(F.count("*").alias("n"), F.sum(sel).alias("selected"))


@query(f"""with {P.CAND}, v as (select candidate_id, 'KO_'||lpad(cast(r as varchar),2,'0') rule, case (k+r)%5 when 0 then 'FAIL' when 1 then 'UNVERIFIED' else 'PASS' end verdict from cand cross join (values (0),(1),(2)) t(r))
select candidate_id, bool_and(verdict<>'FAIL') eligible, sum((verdict='UNVERIFIED')::int) unverified from v group by 1""")
def agg_knockouts(spark: SparkSession, d: str) -> DataFrame:
    return verdicts(spark, d).groupBy("candidate_id").agg(F.bool_and(F.col("verdict") != "FAIL").alias("eligible"), F.sum((F.col("verdict") == "UNVERIFIED").cast("int")).alias("unverified"))


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    r = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("r")
    x = (F.col("k") + F.col("r")) % 5
    return P.candidates(spark, d).select("candidate_id", "k", r).select("candidate_id", F.format_string("KO_%02d", "r").alias("rule"), F.when(x == 0, "FAIL").when(x == 1, "UNVERIFIED").otherwise("PASS").alias("verdict"))


@query(f"""with {P.CAND}, v as (select candidate_id, 'KO_'||lpad(cast(r as varchar),2,'0') rule, case (k+r)%5 when 0 then 'FAIL' when 1 then 'UNVERIFIED' else 'PASS' end verdict from cand cross join (values (0),(1),(2)) t(r))
select rule, count(*) filter (verdict='PASS') pass, count(*) filter (verdict='FAIL') fail, count(*) filter (verdict='UNVERIFIED') unverified, round(avg((verdict='FAIL')::int),6) excluded_share from v group by 1""")
def snk_knockout_pivot(spark: SparkSession, d: str) -> DataFrame:
    wide = verdicts(spark, d).groupBy("rule").pivot("verdict", ["PASS", "FAIL", "UNVERIFIED"]).count().na.fill(0)
    return wide.select("rule", F.col("PASS").alias("pass"), F.col("FAIL").alias("fail"), F.col("UNVERIFIED").alias("unverified"), F.round(F.col("FAIL") / (F.col("PASS") + F.col("FAIL") + F.col("UNVERIFIED")), 6).alias("excluded_share"))


@query(f"with {_CARDS}, b as (select unnest(range(10)) bin) select bin::int bin, count(candidate_id) n from b left join cards on least(floor(composite/10),9)=bin group by 1")
def snk_histogram(spark: SparkSession, d: str) -> DataFrame:
    counts = cards(spark, d).groupBy(F.least(F.floor(F.col("composite") / 10), F.lit(9)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return spark.range(10).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"with {P.CAND}, {P.SCORES} select candidate_id, dimension, value from scores where value is not null")
def snk_dimensions_long(spark: SparkSession, d: str) -> DataFrame:
    """Wide cards melted into one row per dimension, NULL ones left out."""
    names = list(X.WEIGHTS)
    wide = P.score_table(spark, d).groupBy("candidate_id").pivot("dimension", names).agg(F.max("value"))
    return wide.unpivot(["candidate_id"], names, "dimension", "value").where("value is not null")


_money = lambda c: f"coalesce(cast(cast(round({c},2) as decimal(10,2)) as varchar),'')"


@query(f"with {_CARDS} select rank, candidate_id, {_money('composite')} composite, band, {_money('s1')} s1, {_money('s4')} s4, {_money('confidence')} confidence, case when eligible then 'true' else 'false' end eligible, case when selected then 'true' else 'false' end selected from ranked")
def snk_scores(spark: SparkSession, d: str) -> DataFrame:
    """The frame of the score file: two decimals, true and false, blank for NULL."""
    money = lambda c: F.coalesce(F.round(c, 2).cast("decimal(10,2)").cast("string"), F.lit("")).alias(c)
    r = S.rank(cards(spark, d), SELECT_AT)
    return r.select("rank", "candidate_id", money("composite"), "band", money("s1"), money("s4"), money("confidence"), F.col("eligible").cast("string").alias("eligible"), F.col("selected").cast("string").alias("selected"))


@query(f"""with {P.CAND}, {P.EVID}, {P.WANT}, {P.BEST}, g as (select c.candidate_id, w.skill, w.weight, m from cand c cross join want w left join best b on b.candidate_id=c.candidate_id and b.skill=w.skill)
select candidate_id, coalesce(array_to_string(list(skill||'='||cast(cast(round(m,2) as decimal(10,2)) as varchar) order by m desc, skill) filter (m is not null),';'),'') matched,
 coalesce(array_to_string(list(skill||'(w='||cast(cast(weight as int) as varchar)||')' order by weight desc, skill) filter (m is null),';'),'') missing from g group by 1""")
def agg_explain(spark: SparkSession, d: str) -> DataFrame:
    """Matched skills, best first, and missing ones, heaviest first, as text.

    Only matches are shuffled; what is missing is the wanted list less them.
    """
    w = P.wanted(spark, P.REQUIRED)
    best = S.best_match(P.matched(spark, d, P.REQUIRED), P.now()).groupBy("candidate_id").agg(F.collect_list(F.struct((-F.col("m")).alias("o"), "skill", "m")).alias("hits"))
    everything = F.array(*[F.struct(F.lit(-x).alias("o"), F.lit(s).alias("skill"), F.lit(int(x)).alias("w")) for s, x in P.REQUIRED])
    hits = F.coalesce("hits", F.array().cast("array<struct<o:double,skill:string,m:double>>"))
    matched = F.array_join(F.transform(F.array_sort(hits), lambda h: F.concat(h["skill"], F.lit("="), F.round(h["m"], 2).cast("decimal(10,2)").cast("string"))), ";")
    gone = F.filter(F.array_sort(everything), lambda e: ~F.exists(hits, lambda h: h["skill"] == e["skill"]))
    missing = F.array_join(F.transform(gone, lambda e: F.concat(e["skill"], F.lit("(w="), e["w"].cast("string"), F.lit(")"))), ";")
    return P.candidates(spark, d).select("candidate_id").join(best, "candidate_id", "left").select("candidate_id", matched.alias("matched"), missing.alias("missing"))


@query(f"""with {P.CAND}, {P.EVID}, {P.WANT}, {P.BEST}, met as (select candidate_id, sum(weight*m) met, count(*) n from best join want using(skill) group by 1), t as (select sum(weight) total from want),
s as (select c.candidate_id, round(100e0*coalesce(met,0)/total,2) composite, coalesce(n,0) n from cand c left join met using(candidate_id) cross join t)
select candidate_id, composite, n skills, {P.BAND} band, row_number() over (order by composite desc, candidate_id) rank, composite>={THRESHOLD}e0 selected from s""")
def flagship_shortlist(spark: SparkSession, d: str) -> DataFrame:
    """Evidence to shortlist in one plan: joins, best match per skill, weighted coverage, band, rank, selection."""
    w = P.wanted(spark, P.REQUIRED)
    best = S.best_match(P.matched(spark, d, P.REQUIRED), P.now())
    met = best.join(F.broadcast(w), "skill").groupBy("candidate_id").agg(F.sum(F.col("weight") * F.col("m")).alias("met"), F.count("*").alias("skills"))
    score = F.round(100.0 * F.coalesce("met", F.lit(0.0)) / sum(x for _, x in P.REQUIRED), 2)
    cards_ = P.candidates(spark, d).select("candidate_id").join(met, "candidate_id", "left").select(F.lit("j1").alias("job_id"), "candidate_id", score.alias("composite"), F.coalesce("skills", F.lit(0)).alias("skills"))
    zero = F.lit(0.0)
    ranked = S.rank(cards_.withColumn("s1", zero).withColumn("s4", zero).withColumn("confidence", zero).withColumn("eligible", F.lit(True)), THRESHOLD)
    return ranked.select("candidate_id", "composite", "skills", X.band(F.col("composite")).alias("band"), "rank", "selected")
