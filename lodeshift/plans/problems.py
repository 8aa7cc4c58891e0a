"""The queries of the general problems: intervals (p1) and packed fields (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeshift.functions.dates import MONTHS, PRESENT, typed_month, yyyymm
from lodeshift.operators.intervals import merge_intervals
from lodeshift.operators.packed import split_packed
from lodeshift.plans.registry import query
from lodeshift.session import fixed_rows, latest, table

NOW = 202608


def month_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The month intervals of both origins as (origin, candidate_id, s, e) in month indexes."""
    def index(year: str, month: str):
        return F.when(F.col(month).between(1, 12) & (F.col(year) > 0), F.col(year) * 12 + F.col(month) - 1)

    given = table(spark, sf_dir, "intervals").select(
        F.lit("intervals").alias("origin"), "candidate_id", index("start_year", "start_month").alias("s"), index("end_year", "end_month").alias("e")
    )
    typed = table(spark, sf_dir, "experience").select(
        F.lit("experience").alias("origin"), "candidate_id", typed_month(F.col("start_date"), NOW).alias("s"), typed_month(F.col("end_date"), NOW).alias("e")
    )
    return given.unionByName(typed)


_MONTHS = " ".join(f"when '{k}' then {v}" for k, v in MONTHS.items())
_PRESENT = ",".join("'" + w.replace("'", "''") + "'" for w in PRESENT)
_WORD = r"^(?:(\d{1,2})(?:st|nd|rd|th|er)?[. ] ?(?:de |of )?)?([\p{L}]+)[.,]?(?: de[l]?)? ?''?(\d{4}|\d{2})$"


def _month_sql(c: str) -> str:
    """A typed date as month index, for the SQL twin."""
    t = rf"regexp_replace(regexp_replace(regexp_replace(lower({c}),'\s+',' ','g'),'^[ ()\[\]{{}}]+',''),'[ ()\[\]{{}}]+$','')"
    part = lambda p, g: rf"try_cast(regexp_extract(t,'{p}',{g}) as int)"
    iso_day, iso_month, short, dotted = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$", r"^(\d{4})[-/.](\d{1,2})$", r"^(\d{1,2}) ?[-/.] ?(\d{4})$", r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})$"
    year = f"(case when {part(_WORD, 3)}<50 then 2000+{part(_WORD, 3)} when {part(_WORD, 3)}<100 then 1900+{part(_WORD, 3)} else {part(_WORD, 3)} end)"
    name = f"(case regexp_extract(t,'{_WORD}',2) {_MONTHS} end)"
    days = lambda y, m: f"day(last_day(make_date({y}::bigint,{m}::bigint,1::bigint)))"

    def index(y: str, m: str, d: str | None = None) -> str:
        return f"case when {m} between 1 and 12 and {y}>0 then case when {'true' if d is None else f'{d} between 1 and {days(y, m)}'} then {y}*12+{m}-1 end end"

    return f"""(select case when t in ({_PRESENT}) then {NOW // 100 * 12 + NOW % 100 - 1} when regexp_matches(t,'^\\d{{4}}$') then case when cast(t as int)>0 then cast(t as int)*12 end
 when regexp_matches(t,'{iso_day}') then {index(part(iso_day, 1), part(iso_day, 2), part(iso_day, 3))} when regexp_matches(t,'{iso_month}') then {index(part(iso_month, 1), part(iso_month, 2))}
 when regexp_matches(t,'{short}') then {index(part(short, 2), part(short, 1))} when regexp_matches(t,'{dotted}') then {index(part(dotted, 3), part(dotted, 2), part(dotted, 1))}
 when regexp_matches(t,'{_WORD}') then case when {part(_WORD, 1)} is null then {index(year, name)} else {index(year, name, part(_WORD, 1))} end end from (select {t} t))"""


@query(f"""with i as (select 'intervals' origin, candidate_id, case when start_month between 1 and 12 and start_year>0 then start_year*12+start_month-1 end s, case when end_month between 1 and 12 and end_year>0 then end_year*12+end_month-1 end e from intervals
union all select 'experience', candidate_id, {_month_sql('start_date')}, {_month_sql('end_date')} from experience), v as (select distinct * from i where s<=e and candidate_id is not null),
m as (select *, max(e) over (partition by origin, candidate_id order by s, e rows between unbounded preceding and 1 preceding) pe from v), n as (select *, sum((pe is null or s>pe+1)::int) over (partition by origin, candidate_id order by s, e rows unbounded preceding) isl from m),
p as (select origin, candidate_id, isl, min(s) a, max(e) b from n group by 1,2,3), g as (select *, lead(a) over (partition by origin, candidate_id order by isl) na from p)
select origin, candidate_id, 'period' kind, (a//12*100+a%12+1)::int from_month, (b//12*100+b%12+1)::int to_month from p union all select origin, candidate_id, 'gap', ((b+1)//12*100+(b+1)%12+1)::int, ((na-1)//12*100+(na-1)%12+1)::int from g where na is not null""")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = merge_intervals(month_intervals(spark, sf_dir), ["origin", "candidate_id"], "s", "e")
    return merged.select("origin", "candidate_id", "kind", yyyymm(F.col("from")).alias("from_month"), yyyymm(F.col("to")).alias("to_month"))


def known_skills(spark: SparkSession, sf_dir: str) -> list[str]:
    """Canonical names and aliases of the fixed reference list of skills."""
    names = table(spark, sf_dir, "ontology_skills").select(F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n"))
    return [r["n"] for r in fixed_rows(names.where("n is not null").distinct())]


@query()
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = known_skills(spark, sf_dir)
    fields = latest(table(spark, sf_dir, "resumes"), "candidate_id", "skills")
    lines = latest(table(spark, sf_dir, "line_blocks"), "block_id", "text")
    return (
        split_packed(fields, "candidate_id", "skills", known).withColumn("origin", F.lit("resumes"))
        .unionByName(split_packed(lines, "block_id", "text", known, only_lists=True).withColumn("origin", F.lit("line_blocks")))
        .select("origin", "row_key", "item_no", "item")
    )
