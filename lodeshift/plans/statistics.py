"""Queries of group statistics, redaction, dates and careers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeshift.functions import dates as D
from lodeshift.functions import factors as X
from lodeshift.operators import fairness as A
from lodeshift.operators.intervals import merge_intervals
from lodeshift.operators.scoring import covered_months
from lodeshift.plans import projections as P
from lodeshift.plans.registry import query
from lodeshift.plans.scoring import _CARDS, SELECT_AT, cards

_GROUPS = f"""{_CARDS}, g as (select c.grp, count(*) n, sum((selected or composite>={SELECT_AT}e0)::int) selected from ranked r join cand c using(candidate_id) group by 1), gr as (select *, selected/n::double rate from g),
top as (select grp reference, rate top, n ref_n, selected ref_selected from gr order by rate desc, grp limit 1)"""


def _impact(spark: SparkSession, d: str) -> DataFrame:
    c = cards(spark, d).select("candidate_id", "composite", (F.col("eligible") & (F.col("composite") >= SELECT_AT)).alias("selected"))
    return A.group_impact(c, P.candidates(spark, d).select("candidate_id", "group"), SELECT_AT)


@query(f'with {_GROUPS} select grp as "group", n, selected, round(rate,6) rate, round(rate/nullif(top,0),6) ratio, reference, n<30 small from gr cross join top')
def fai_impact(spark: SparkSession, d: str) -> DataFrame:
    return _impact(spark, d).select("group", "n", "selected", F.round("rate", 6).alias("rate"), F.round("ratio", 6).alias("ratio"), "reference", "small")


@query(f"""with {_GROUPS}, x as (select grp, selected=0 or selected=n or ref_selected=0 or ref_selected=ref_n edge, n=0 or ref_n=0 or ref_selected=0 no, selected s, n, ref_selected rs, ref_n rn from gr cross join top),
y as (select grp, no, n+(case when edge then 1e0 else 0e0 end) tg, rn+(case when edge then 1e0 else 0e0 end) tr, (s+(case when edge then 0.5e0 else 0e0 end))/(n+(case when edge then 1e0 else 0e0 end)) p1, (rs+(case when edge then 0.5e0 else 0e0 end))/(rn+(case when edge then 1e0 else 0e0 end)) p2 from x)
select grp as "group", round(case when not no then exp(ln(p1/p2)-1.96e0*sqrt((1-p1)/(tg*p1)+(1-p2)/(tr*p2))) end,6) low, round(case when not no then exp(ln(p1/p2)+1.96e0*sqrt((1-p1)/(tg*p1)+(1-p2)/(tr*p2))) end,6) high from y""")
def fai_ratio_ci(spark: SparkSession, d: str) -> DataFrame:
    low, high = A.ratio_interval(F.col("selected"), F.col("n"), F.col("ref_selected"), F.col("ref_n"))
    return _impact(spark, d).select("group", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(f"""with {_GROUPS}, t as (select grp, selected a, n-selected b, ref_selected c, ref_n-ref_selected d, n r1, ref_n r2, selected+ref_selected c1 from gr cross join top),
x as (select grp, a, r1, r2, c1, unnest(generate_series(greatest(0::bigint,(c1-r2)::bigint), least(r1,c1)::bigint)) x from t),
p as (select *, lgamma(r1+1)-lgamma(x+1)-lgamma(r1-x+1)+lgamma(r2+1)-lgamma(c1-x+1)-lgamma(r2-c1+x+1)-lgamma(r1+r2+1)+lgamma(c1+1)+lgamma(r1+r2-c1+1) lp, lgamma(r1+1)-lgamma(a+1)-lgamma(r1-a+1)+lgamma(r2+1)-lgamma(c1-a+1)-lgamma(r2-c1+a+1)-lgamma(r1+r2+1)+lgamma(c1+1)+lgamma(r1+r2-c1+1) lo from x)
select grp as "group", round(least(1e0,sum(exp(lp)) filter (exp(lp)<=exp(lo)*(1+1e-9))),6) p_value from p group by 1""")
def fai_fisher(spark: SparkSession, d: str) -> DataFrame:
    t = _impact(spark, d).select("group", F.col("selected").alias("a"), (F.col("n") - F.col("selected")).alias("b"), F.col("ref_selected").alias("c"), (F.col("ref_n") - F.col("ref_selected")).alias("d"))
    return A.fisher_exact(t, ["group"]).select("group", F.round("p_value", 6).alias("p_value"))


@query(f"""with {P.CAND}, {P.SCORES}, o as (select s.candidate_id, x.dimension dropped, sum(case when s.dimension<>x.dimension and value is not null then s.weight*value end)/sum(case when s.dimension<>x.dimension and value is not null then s.weight end) c from scores s cross join dims x group by 1,2)
select grp as "group", dropped, round(avg(coalesce(c,0)),6) mean_composite from o join cand using(candidate_id) group by 1,2""")
def fai_leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    return A.leave_one_out(P.score_table(spark, d).select("candidate_id", "dimension", "value"), P.weights(spark), P.candidates(spark, d).select("candidate_id", "group"))


@query(f"""with {P.CAND}, {P.SCORES} select grp as "group", dimension, round(avg(value),6) mean from scores join cand using(candidate_id) group by 1,2""")
def fai_means(spark: SparkSession, d: str) -> DataFrame:
    s = P.score_table(spark, d).select("candidate_id", "dimension", "value")
    return s.join(P.candidates(spark, d).select("candidate_id", "group"), "candidate_id").groupBy("group", "dimension").agg(F.round(F.avg("value"), 6).alias("mean"))


@query("""with r as (select candidate_id, arg_max(struct_pack(n:=full_name,m:=email,p:=phone,s:=summary,f:=path), (coalesce(loaded_at, timestamptz '0001-01-01'), coalesce(full_name,''))) x from resumes group by 1)
select candidate_id, null::varchar full_name, null::varchar email, null::varchar phone, 'candidate/'||candidate_id path, regexp_replace(coalesce(x.s,''),'[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}','[EMAIL]','g') summary from r""")
def fai_redact(spark: SparkSession, d: str) -> DataFrame:
    """Identities blanked, the path replaced, addresses in the summary masked."""
    from lodeshift.session import latest

    r = latest(P.table(spark, d, "resumes"), "candidate_id", "full_name", "email", "phone", "summary", "path")
    none = F.lit(None).cast("string")
    masked = F.regexp_replace(F.coalesce("summary", F.lit("")), r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]")
    return r.select("candidate_id", none.alias("full_name"), none.alias("email"), none.alias("phone"), F.concat(F.lit("candidate/"), "candidate_id").alias("path"), masked.alias("summary"))


@query("""select distinct candidate_id, key, value from (select candidate_id, unnest(['full_name','email','phone','path']) key, unnest([full_name,email,phone,path]) value from resumes) where value is not null""")
def fai_reident_map(spark: SparkSession, d: str) -> DataFrame:
    r = P.table(spark, d, "resumes").select("candidate_id", "full_name", "email", "phone", "path").distinct()
    return r.unpivot(["candidate_id"], ["full_name", "email", "phone", "path"], "key", "value").where("value is not null").distinct()


@query(f"""with {P.CAND} select candidate_id, replace(replace('Note on '||full_name||' of '||domain||'.', full_name, '[NAME]'), domain, '[PLACE]') as text from cand""")
def fai_scrub(spark: SparkSession, d: str) -> DataFrame:
    note = F.concat(F.lit("Note on "), "full_name", F.lit(" of "), "domain", F.lit("."))
    names = F.array(F.struct(F.col("full_name").alias("key"), F.lit("[NAME]").alias("value")), F.struct(F.col("domain").alias("key"), F.lit("[PLACE]").alias("value")))
    return P.candidates(spark, d).select("candidate_id", A.scrub(note, names).alias("text"))


@query("""with g as (select candidate_id, min(cast(nullif(regexp_extract(graduation_date,'([12][0-9]{3})',1),'') as int)) graduated from education where candidate_id is not null group by 1), r as (select candidate_id, min(cast(nullif(regexp_extract(start_date,'([12][0-9]{3})',1),'') as int)) began from experience where candidate_id is not null group by 1)
select candidate_id, graduated, began, began-graduated gap from g join r using(candidate_id)""")
def fai_grad_interval(spark: SparkSession, d: str) -> DataFrame:
    year = lambda c: F.min(F.regexp_extract(c, "([12][0-9]{3})", 1).try_cast("int"))
    g = P.table(spark, d, "education").where("candidate_id is not null").groupBy("candidate_id").agg(year("graduation_date").alias("graduated"))
    r = P.table(spark, d, "experience").where("candidate_id is not null").groupBy("candidate_id").agg(year("start_date").alias("began"))
    return g.join(r, "candidate_id").select("candidate_id", "graduated", "began", (F.col("began") - F.col("graduated")).alias("gap"))


def parse_date(text, today: str):
    """(value, precision) of a typed date as the English rules read it: a present word, YYYY, MM/YYYY or MM-YYYY,
    Mon YYYY (two-digit years pivot at 50), D Mon YYYY; else both NULL."""
    return F.transform(F.array(F.regexp_replace(F.regexp_replace(F.trim(text), r"^[()\[\]{}\s]+", ""), r"[()\[\]{}\s]+$", "")), lambda t: _read_english(t, today))[0]


def _read_english(t, today: str):
    low, names = F.lower(t), D.month_map(D.ENGLISH_MONTHS)
    num = lambda p, g: F.regexp_extract(t, p, g).try_cast("int")
    short, word, day = r"^(\d{1,2})[-/](\d{4})$", r"^([a-zA-Z.]+)\s+(\d{2,4})$", r"^(\d{1,2})\s+([a-zA-Z.]+)\s+(\d{2,4})$"
    out = lambda y, m, d, p: F.struct(F.format_string("%04d-%02d-%02d", y, m, d).alias("value"), F.lit(p).alias("precision"))
    mon = lambda p, g: names[F.regexp_replace(F.lower(F.regexp_extract(t, p, g)), r"\.+$", "")]
    y1, y2 = D.full_year(num(word, 2)), D.full_year(num(day, 3))
    one = F.lit(1)
    return (
        F.when(low.isin(*D.ENGLISH_PRESENT), F.struct(F.lit(today).alias("value"), F.lit("present").alias("precision")))
        .when(t.rlike(r"^\d{4}$"), out(t.try_cast("int"), one, one, "year"))
        .when(t.rlike(short), F.when(num(short, 1).between(1, 12), out(num(short, 2), num(short, 1), one, "month")))
        .when(t.rlike(word), F.when(mon(word, 1).isNotNull(), out(y1, mon(word, 1), one, "month")))
        .when(t.rlike(day), F.when(mon(day, 2).isNotNull() & num(day, 1).between(1, D._month_days(y2, mon(day, 2))), out(y2, mon(day, 2), num(day, 1), "day")))
    )


_MON = " ".join(f"when '{k}' then {v}" for k, v in D.ENGLISH_MONTHS.items())
_YEAR = lambda y: f"(case when {y}<50 then {y}+2000 when {y}<100 then {y}+1900 else {y} end)"
_PARSE = rf"""t1 as (select raw, regexp_replace(regexp_replace(trim(raw),'^[()\[\]{{}}\s]+',''),'[()\[\]{{}}\s]+$','') t from src),
t2 as (select *, lower(t) l, case rtrim(lower(regexp_extract(t,'^([a-zA-Z.]+)\s+(\d{{2,4}})$',1)),'.') {_MON} end m1, try_cast(regexp_extract(t,'^([a-zA-Z.]+)\s+(\d{{2,4}})$',2) as int) y1,
 case rtrim(lower(regexp_extract(t,'^(\d{{1,2}})\s+([a-zA-Z.]+)\s+(\d{{2,4}})$',2)),'.') {_MON} end m2, try_cast(regexp_extract(t,'^(\d{{1,2}})\s+([a-zA-Z.]+)\s+(\d{{2,4}})$',1) as int) d2, try_cast(regexp_extract(t,'^(\d{{1,2}})\s+([a-zA-Z.]+)\s+(\d{{2,4}})$',3) as int) y2,
 try_cast(regexp_extract(t,'^(\d{{1,2}})[-/](\d{{4}})$',1) as int) m3, try_cast(regexp_extract(t,'^(\d{{1,2}})[-/](\d{{4}})$',2) as int) y3 from t1),
parsed as (select raw, case when l in ('present','current','now','till date','today','ongoing') then '2026-08-29' when regexp_matches(t,'^\d{{4}}$') then t||'-01-01' when m3 between 1 and 12 then printf('%04d-%02d-01',y3,m3)
 when m1 is not null then printf('%04d-%02d-01',{_YEAR('y1')},m1) when m2 is not null and d2 between 1 and day(last_day(make_date({_YEAR('y2')}::bigint,m2::bigint,1::bigint))) then printf('%04d-%02d-%02d',{_YEAR('y2')},m2,d2) end as value,
 case when l in ('present','current','now','till date','today','ongoing') then 'present' when regexp_matches(t,'^\d{{4}}$') then 'year' when m3 between 1 and 12 then 'month' when m1 is not null then 'month'
 when m2 is not null and d2 between 1 and day(last_day(make_date({_YEAR('y2')}::bigint,m2::bigint,1::bigint))) then 'day' end as precision from t2)"""


@query(f"with src as (select distinct start_date raw from experience where start_date is not null union select distinct end_date from experience where end_date is not null), {_PARSE} select raw, value, precision from parsed")
def dat_parse(spark: SparkSession, d: str) -> DataFrame:
    e = P.table(spark, d, "experience")
    raw = e.select(F.col("start_date").alias("raw")).union(e.select("end_date")).where("raw is not null").distinct()
    x = parse_date(F.col("raw"), "2026-08-29")
    return raw.select("raw", x.alias("x")).select("raw", "x.value", "x.precision")


def split_range(text):
    """(start, end) at the first kind of separator that occurs: hyphen, dashes, then words; end NULL without one."""
    kinds = (r"\s*-\s*", r"\s*–\s*", r"\s*—\s*", r"\s*―\s*", " to ", " through ")
    out = F.struct(F.trim(text).alias("start"), F.lit(None).cast("string").alias("end"))
    for k in reversed(kinds):
        parts = F.split(text, k, 2)
        out = F.when(text.rlike(k), F.struct(F.trim(parts[0]).alias("start"), F.trim(parts[1]).alias("end"))).otherwise(out)
    return out


@query(r"""with src as (select distinct start_date||' – '||end_date raw from experience where start_date is not null and end_date is not null union select distinct start_date||' to '||end_date from experience where start_date is not null and end_date is not null),
s as (select raw, case when contains(raw,'-') then regexp_extract(raw,'^([^-]*?)\s*-\s*(.*)$',1) when contains(raw,'–') then regexp_extract(raw,'^([^–]*?)\s*–\s*(.*)$',1) when contains(raw,' to ') then split_part(raw,' to ',1) else raw end a,
 case when contains(raw,'-') then regexp_extract(raw,'^([^-]*?)\s*-\s*(.*)$',2) when contains(raw,'–') then regexp_extract(raw,'^([^–]*?)\s*–\s*(.*)$',2) when contains(raw,' to ') then raw[strpos(raw,' to ')+4:] end b from src)
select raw, trim(a) as "start", trim(b) as "end" from s""")
def dat_range(spark: SparkSession, d: str) -> DataFrame:
    e = P.table(spark, d, "experience").where("start_date is not null and end_date is not null")
    raw = e.select(F.concat("start_date", F.lit(" – "), "end_date").alias("raw")).union(e.select(F.concat("start_date", F.lit(" to "), "end_date"))).distinct()
    return raw.select("raw", split_range(F.col("raw")).alias("x")).select("raw", "x.start", "x.end")


@query(f"with {P.ROLES} select role_id, greatest(0,(year(e)*12+month(e))-(year(s)*12+month(s))+1) as months from roles")
def dat_month_range(spark: SparkSession, d: str) -> DataFrame:
    return P.roles(spark, d).select("role_id", F.greatest(F.lit(0), X.months_of(F.coalesce("e", P.now())) - X.months_of(F.col("s")) + 1).alias("months"))


@query(f"with {P.ROLES}, m as (select distinct candidate_id, unnest(generate_series(year(s)*12+month(s)-1, year(e)*12+month(e)-1)) m from roles where s<=e) select candidate_id, count(*) as months from m group by 1")
def dat_calendar_union(spark: SparkSession, d: str) -> DataFrame:
    return covered_months(P.roles(spark, d))


@query(f"""with {P.ROLES}, m as (select distinct candidate_id, unnest(generate_series(year(s)*12+month(s)-1, year(e)*12+month(e)-1)) m from roles where s<=e), u as (select candidate_id, count(*) total from m group by 1),
t as (select candidate_id, count(*) n, list_sort(list((year(e)*12+month(e))-(year(s)*12+month(s))+1) filter (s<=e)) ts from roles group by 1) select candidate_id, total total_months, n role_count, ts[len(ts)//2+1] median_tenure from t join u using(candidate_id)""")
def dat_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Covered months, number of roles, and the upper median of tenures."""
    r = P.roles(spark, d)
    months = F.when(F.col("s") <= F.col("e"), X.months_of(F.col("e")) - X.months_of(F.col("s")) + 1)
    by = r.groupBy("candidate_id").agg(F.count("*").alias("role_count"), F.sort_array(F.collect_list(months)).alias("ts"))
    return by.join(covered_months(r), "candidate_id").select("candidate_id", F.col("months").alias("total_months"), "role_count", F.get("ts", F.floor(F.size("ts") / 2).cast("int")).alias("median_tenure"))


@query(f"""with {P.ROLES}, x as (select *, max(e) over (partition by candidate_id order by s, role_id rows between unbounded preceding and 1 preceding) pe from roles) select candidate_id, role_id, date_diff('month', date_trunc('month',pe), date_trunc('month',s)) gap_months from x where date_diff('month', date_trunc('month',pe), date_trunc('month',s))>1""")
def dat_role_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Gaps of more than a month before a role: reported, never scored. The role behind a gap is the first that starts in the
    month after it; both meet by an equal join, no window over a career."""
    roles = P.roles(spark, d).select("candidate_id", "role_id", "s", X.months_of(F.col("s")).alias("a"), X.months_of(F.col("e")).alias("b"))
    gaps = merge_intervals(roles, ["candidate_id"], "a", "b").where("kind = 'gap'").select("candidate_id", (F.col("to") + 1).alias("a"), (F.col("to") - F.col("from") + 2).cast("int").alias("gap_months"))
    behind = roles.where("a <= b").join(gaps, ["candidate_id", "a"])
    return behind.groupBy("candidate_id", "a", "gap_months").agg(F.min_by("role_id", F.struct("s", "role_id")).alias("role_id")).select("candidate_id", "role_id", "gap_months")
