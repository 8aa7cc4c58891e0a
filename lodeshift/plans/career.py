"""Evidence of skills from the tables of mentions and entries, its routes to wanted skills, and the chunks of both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeshift.functions import factors as X
from lodeshift.plans import projections as P
from lodeshift.plans import requirements as J
from lodeshift.plans.names import _ALIAS, alias_table
from lodeshift.plans.registry import query
from lodeshift.session import latest

TODAY = "2026-08-29"
_ENTRY = "en as (select entry_id, arg_max(candidate_id, o) candidate_id, arg_max(bullets, o) bullets, arg_max(end_date, o) end_date from (select *, (coalesce(loaded_at, timestamptz '0001-01-01'), candidate_id, bullets, end_date) o from experience where candidate_id is not null) group by 1)"
_INDEX = rf"""{_ALIAS}, {_ENTRY}, w as (select entry_id, candidate_id, try_cast(nullif(regexp_extract(end_date,'((?:19|20)[0-9]{{2}})',1),'')||'-01-01' as date) last_used, unnest(regexp_extract_all(lower(array_to_string(bullets,' ')),'[a-z0-9+#-]+')) k from en where bullets is not null),
entry as (select candidate_id, canonical, k as raw, max(coalesce(last_used, date '{TODAY}')) last_used from w join al using(k) group by 1,2,3),
said as (select candidate_id, coalesce(s.canonical, al.canonical) canonical, lower(trim(raw)) as raw from skill_matches s left join al on al.k=lower(trim(raw)) where candidate_id is not null and regexp_matches(coalesce(raw,''),'\S') group by 1,2,3),
both_ as (select distinct candidate_id, canonical, 1 b from entry),
idx as (select 'mention' source, candidate_id, canonical, raw, case when b is null then 'listed' else 'narrated' end kind, null::date last_used from said left join both_ using(candidate_id, canonical) where canonical is not null union all select 'entry', candidate_id, canonical, raw, 'narrated', last_used from entry)"""


def entries(spark: SparkSession, d: str) -> DataFrame:
    """(candidate_id, canonical, raw, last_used): one-word names of skills in the bullets of careers, with their last year."""
    e = latest(P.table(spark, d, "experience").where("candidate_id is not null"), "entry_id", "candidate_id", "bullets", "end_date").where("bullets is not null")
    year = F.nullif(F.regexp_extract(F.coalesce("end_date", F.lit("")), "((?:19|20)[0-9]{2})", 1), F.lit(""))
    used = F.coalesce(F.concat(year, F.lit("-01-01")).try_cast("date"), F.to_date(F.lit(TODAY)))
    words = e.select("candidate_id", used.alias("last_used"), F.explode(F.regexp_extract_all(F.lower(F.array_join("bullets", " ")), F.lit("([a-z0-9+#-]+)"), 1)).alias("k"))
    names = F.broadcast(alias_table(P.table(spark, d, "ontology_skills")).select("k", "canonical"))  # the fixed reference list
    return words.join(names, "k").groupBy("candidate_id", "canonical", F.col("k").alias("raw")).agg(F.max("last_used").alias("last_used"))


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """(candidate_id, canonical, raw) of the typed skills; canonical as given, else by the reference list, else NULL."""
    names = F.broadcast(alias_table(P.table(spark, d, "ontology_skills")).select("k", F.col("canonical").alias("listed")))
    typed = P.table(spark, d, "skill_matches").where("candidate_id is not null").where(F.col("raw").rlike(r"\S")).select("candidate_id", "canonical", F.lower(F.trim("raw")).alias("k"))
    return typed.join(names, "k", "left").select("candidate_id", F.coalesce("canonical", "listed").alias("canonical"), F.col("k").alias("raw")).distinct()


def evidence_index(spark: SparkSession, d: str) -> DataFrame:
    """(source, candidate_id, canonical, raw, kind, last_used): mentions and entries by the skill they show. A mention counts
    as narrated where an entry shows its skill, too, else as listed."""
    entry = entries(spark, d)
    shown = entry.select("candidate_id", "canonical", F.lit(1).alias("b")).distinct()
    said = mentions(spark, d).where("canonical is not null").join(shown, ["candidate_id", "canonical"], "left")
    said = said.select(F.lit("mention").alias("source"), "candidate_id", "canonical", "raw", F.when(F.col("b").isNull(), "listed").otherwise("narrated").alias("kind"), F.lit(None).cast("date").alias("last_used"))
    return said.unionByName(entry.select(F.lit("entry").alias("source"), "candidate_id", "canonical", "raw", F.lit("narrated").alias("kind"), "last_used"))


@query(f"with {_INDEX} select source, candidate_id, canonical, raw, kind, last_used::varchar last_used from idx")
def evd_index(spark: SparkSession, d: str) -> DataFrame:
    return evidence_index(spark, d).withColumn("last_used", F.col("last_used").cast("string"))


_ROUTES = "rt as (select canonical c, canonical t, 'exact' route from ontology_skills union select canonical, unnest(parents), 'child' from ontology_skills union select canonical, unnest(children), 'parent' from ontology_skills)"
_FACTOR = "(case route when 'exact' then 1e0 when 'child' then 0.9e0 else 0.7e0 end)*(case kind when 'narrated' then 0.8e0 else 0.55e0 end)"
_DECAY = f"case when last_used is null then 1e0 else greatest(0.5e0, least(1e0, exp(-ln(2e0)*(greatest((year(date '{TODAY}')*12+month(date '{TODAY}'))-(year(last_used)*12+month(last_used)),0)/12e0)/(case when timeless then 12e0 else 4e0 end)))) end"


def routes(ontology: DataFrame) -> DataFrame:
    """(canonical, skill, route): what a shown skill counts for: itself, its parents as their child, its children as their parent."""
    own = ontology.select("canonical", F.col("canonical").alias("skill"), F.lit("exact").alias("route"))
    up = ontology.select("canonical", F.explode("parents").alias("skill"), F.lit("child").alias("route"))
    down = ontology.select("canonical", F.explode("children").alias("skill"), F.lit("parent").alias("route"))
    return own.unionByName(up).unionByName(down).distinct()


@query(f"""with {_INDEX}, {_ROUTES}, tl as (select canonical t, coalesce(timeless,false) timeless from ontology_skills), m as (select candidate_id, rt.t skill, source, idx.kind, route, {_FACTOR}*{_DECAY} m, {_DECAY} r from idx join rt on rt.c=idx.canonical left join tl on tl.t=rt.t)
select candidate_id, skill, round(max(m),6) m, round(max(r),6) best_recency, count(*) pieces, count(distinct source) sources from m group by 1,2""")
def evd_collected(spark: SparkSession, d: str) -> DataFrame:
    """The best evidence of every candidate for every skill of the reference list, by all routes and from all sources; timeless
    skills fade slower, an undated piece counts as of now. Equal joins with fixed lists, then one aggregate."""
    ontology = P.table(spark, d, "ontology_skills")
    ways = F.broadcast(routes(ontology).join(ontology.select(F.col("canonical").alias("skill"), F.coalesce("timeless", F.lit(False)).alias("timeless")), "skill", "left"))
    fade = X.recency(X.years_since(F.col("last_used"), F.to_date(F.lit(TODAY))), F.when(F.coalesce("timeless", F.lit(False)), X.HALF_LIFE_TIMELESS).otherwise(X.HALF_LIFE), X.RECENCY_FLOOR)
    m = X.lookup(F.col("route"), X.MATCH) * X.lookup(F.col("kind"), X.PROFICIENCY, 0.40) * fade
    hits = evidence_index(spark, d).join(ways, "canonical")
    return hits.groupBy("candidate_id", "skill").agg(F.round(F.max(m), 6).alias("m"), F.round(F.max(fade), 6).alias("best_recency"), F.count("*").alias("pieces"), F.count_distinct("source").alias("sources"))


_KEY = r"regexp_replace(lower({0}),'[^a-z0-9+#]','','g')"


@query(rf"""with {_INDEX}, raws as (select candidate_id, raw, case when min(o)=0 then 'mention' else 'entry' end source from (select candidate_id, raw, 0 o from said union all select candidate_id, raw, 1 from entry) group by 1,2), names as (select distinct canonical skill, {_KEY.format('canonical')} a from ontology_skills)
select candidate_id, skill, raw, source, 'exact' route from raws join names on {_KEY.format('raw')}=a where a<>''""")
def evd_keyword_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Phrases of a candidate that are the name of a skill but for marks and case, each phrase by the first source that has it."""
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9+#]", "")
    raws = mentions(spark, d).select("candidate_id", "raw", F.lit(0).alias("o")).unionByName(entries(spark, d).select("candidate_id", "raw", F.lit(1).alias("o"))).groupBy("candidate_id", "raw").agg(F.min("o").alias("o"))
    names = F.broadcast(P.table(spark, d, "ontology_skills").select(F.col("canonical").alias("skill"), bare("canonical").alias("a")).where("a <> ''").distinct())
    hits = raws.withColumn("a", bare("raw")).join(names, "a")
    return hits.select("candidate_id", "skill", "raw", F.when(F.col("o") == 0, "mention").otherwise("entry").alias("source"), F.lit("exact").alias("route"))


_RS = "rs as (select candidate_id, arg_max(summary, (coalesce(loaded_at, timestamptz '0001-01-01'), summary)) summary from resumes where candidate_id is not null group by 1)"


@query(rf"""with {_ENTRY}, {_RS}, {J._JL}, {J._NAMES}, {J._WEIGHED}, b as (select candidate_id, entry_id, unnest(range(1,len(bullets)+1)) i, unnest(bullets) t from en)
select 'resume' side, candidate_id as owner, 'experience:'||entry_id||':'||i origin, 1 weight, length(t) n from b where regexp_matches(coalesce(t,''),'\S') union all select 'resume', candidate_id, 'summary', 1, length(summary) from rs where regexp_matches(coalesce(summary,''),'\S')
union all select 'job', doc_id::varchar, section||':'||skill, weight, length(skill) from weighed union all select 'job', doc_id::varchar, 'responsibility:'||line, 3, length(regexp_replace(t,'{J.LIST_MARK}','')) from s where section='responsibilities' and k is null and t<>''""")
def s3_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of text that are compared by meaning: bullets and summaries on one side, responsibilities and named skills
    with their weights on the other."""
    e = latest(P.table(spark, d, "experience").where("candidate_id is not null"), "entry_id", "candidate_id", "bullets", "end_date")
    said = F.coalesce("t", F.lit("")).rlike(r"\S")
    bullets = e.select("candidate_id", "entry_id", F.posexplode("bullets").alias("i", "t")).where(said)
    summary = latest(P.table(spark, d, "resumes").where("candidate_id is not null"), "candidate_id", "summary").select("candidate_id", F.col("summary").alias("t")).where(said)
    jobs = J.jobs(spark, d)
    named = J.job_skills(jobs).select("doc_id", "section", "skill", F.when(F.col("section") == "preferred", 2).otherwise(J.weigh(F.col("item"))).alias("weight"))
    duties = J.sectioned(jobs).where("section = 'responsibilities' and k is null and t <> ''")
    row = lambda df, side, owner, origin, weight, text: df.select(F.lit(side).alias("side"), F.col(owner).cast("string").alias("owner"), origin.alias("origin"), weight.cast("int").alias("weight"), F.length(text).alias("n"))
    text = lambda c: F.col(c).cast("string")
    return (
        row(bullets, "resume", "candidate_id", F.concat(F.lit("experience:"), text("entry_id"), F.lit(":"), (F.col("i") + 1).cast("string")), F.lit(1), F.col("t"))
        .unionByName(row(summary, "resume", "candidate_id", F.lit("summary"), F.lit(1), F.col("t")))
        .unionByName(row(named, "job", "doc_id", F.concat_ws(":", "section", "skill"), F.col("weight"), F.col("skill")))
        .unionByName(row(duties, "job", "doc_id", F.concat(F.lit("responsibility:"), text("line")), F.lit(3), F.regexp_replace("t", J.LIST_MARK, "")))
    )
