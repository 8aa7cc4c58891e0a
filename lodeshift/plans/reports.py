"""Frames of the reports: the score file, score cards as JSON, the derivation and the short explanation of a score, audit
records."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeshift.functions import factors as X
from lodeshift.operators import scoring as S
from lodeshift.plans import projections as P
from lodeshift.plans import scoring as C
from lodeshift.plans.registry import SQL, query

DIMENSIONS = list(X.WEIGHTS)
TOP = 3  # matches and gaps that an explanation names
MOST_WORDS = 120
JOB_HASH = hashlib.sha256(json.dumps({"required": P.REQUIRED, "preferred": P.PREFERRED, "title": P.TITLE}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def full_cards(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate's card: rank, composite, band, sub-scores s1 to s10, matched and missing skills in order, relevant years,
    flags. Candidates without a value keep NULL there."""
    ranked = S.rank(C.cards(spark, d), C.SELECT_AT).select("candidate_id", "rank", "composite", "band", "selected", "eligible", "confidence")
    wide = P.score_table(spark, d).groupBy("candidate_id").agg(*[F.max(F.when(F.col("dimension") == n, F.col("value"))).alias(n.lower()) for n in DIMENSIONS])
    split = lambda c: F.filter(F.split(c, ";", -1), lambda x: x != "").alias(c)
    skills = C.agg_explain(spark, d).select("candidate_id", split("matched"), split("missing"))
    years = C.s4_experience(spark, d).select("candidate_id", "years")
    flags = P.findings(spark, d).groupBy("candidate_id").agg(F.sort_array(F.collect_set("code")).alias("flags"))
    names = P.candidates(spark, d).select("candidate_id", F.col("full_name").alias("name"))
    out = ranked.join(names, "candidate_id").join(wide, "candidate_id").join(skills, "candidate_id").join(years, "candidate_id").join(flags, "candidate_id", "left")
    return out.withColumn("flags", F.coalesce("flags", F.array().cast("array<string>")))


_WIDE = "wd as (select candidate_id, " + ", ".join(f"max(case when dimension='{n}' then value end) {n.lower()}" for n in DIMENSIONS) + " from scores group by 1)"
_FULL = f"""{C._CARDS}, {_WIDE}, ex as ({SQL['agg_explain']}), yr as (select candidate_id, years from ({SQL['s4_experience']})),
fl as (select candidate_id, list_filter([case when k%23=0 then 'HIDDEN_TEXT' end, case when k%11=0 then 'KEYWORD_STUFFING' end], lambda x: x is not null) flags from cand),
full_ as (select r.candidate_id, rank, composite, band, selected, eligible, confidence, full_name as name, {', '.join(f'wd.{n.lower()}' for n in DIMENSIONS)}, list_filter(string_split(matched,';'), lambda x: x<>'') matched, list_filter(string_split(missing,';'), lambda x: x<>'') missing, years, flags
 from ranked r join cand using(candidate_id) join wd using(candidate_id) join ex using(candidate_id) join yr using(candidate_id) join fl using(candidate_id))"""
_CRITERION = "regexp_replace(x,'[=(].*$','')"
_TOP3 = lambda c: f"coalesce(nullif(array_to_string(list_transform({c}[1:{TOP}], lambda x: {_CRITERION}),', '),''),'none')"
_TENTH, _TWO = (lambda c, n=n: f"cast(cast(round({c},{n}) as decimal(10,{n})) as varchar)" for n in (1, 2))
_EXPLAIN = f"'Composite '||{_TENTH('composite')}||' ('||band||'). Strongest matches: '||{_TOP3('matched')}||'. Key gaps: '||{_TOP3('missing')}||'. Flags: '||coalesce(nullif(array_to_string(flags,', '),''),'none')||'.'"


def fixed(c, places: int):
    """A number as text with so many places; NULL stays NULL."""
    return F.round(c, places).cast(f"decimal(10,{places})").cast("string")


def explanation(cards: DataFrame):
    """A few sentences on a card: composite, the strongest matches, the heaviest gaps, flags; ``MOST_WORDS`` words at most."""
    named = lambda c: F.coalesce(F.nullif(F.array_join(F.transform(F.slice(c, 1, TOP), lambda x: F.regexp_replace(x, "[=(].*$", "")), ", "), F.lit("")), F.lit("none"))
    flags = F.coalesce(F.nullif(F.array_join("flags", ", "), F.lit("")), F.lit("none"))
    text = F.concat(F.lit("Composite "), fixed(F.col("composite"), 1), F.lit(" ("), "band", F.lit("). Strongest matches: "), named("matched"), F.lit(". Key gaps: "), named("missing"), F.lit(". Flags: "), flags, F.lit("."))
    words = F.split(text, " ")
    return cards.withColumn("explanation", F.when(F.size(words) > MOST_WORDS, F.concat(F.array_join(F.slice(words, 1, MOST_WORDS), " "), F.lit("..."))).otherwise(text))


@query(f"with {_FULL} select candidate_id, {_EXPLAIN} explanation from full_")
def agg_explanation(spark: SparkSession, d: str) -> DataFrame:
    return explanation(full_cards(spark, d)).select("candidate_id", "explanation")


_BLANK = lambda c: f"coalesce({_TWO(c)},'')"


@query(f"""with {_FULL} select rank::varchar as rank, candidate_id, '' as file, name, {_BLANK('composite')} composite, band, case when selected then 'true' else 'false' end selected, case when eligible then 'true' else 'false' end eligible, {_BLANK('confidence')} confidence, {', '.join(_BLANK(n.lower()) + f' as "{n}"' for n in DIMENSIONS)},
array_to_string(matched,';') matched_required, array_to_string(missing,';') missing_required, {_BLANK('years')} relevant_years, array_to_string(flags,';') flags, array_to_string(list_transform(flags, lambda x: 'PENALTY_'||x),';') reason_codes, {_EXPLAIN} explanation from full_""")
def snk_score_file(spark: SparkSession, d: str) -> DataFrame:
    """The 25 columns of the score file, all as text: two places, true and false, blank for NULL."""
    c = explanation(full_cards(spark, d))
    two = lambda name: F.coalesce(fixed(F.col(name), 2), F.lit(""))
    return c.select(
        F.col("rank").cast("string").alias("rank"), "candidate_id", F.lit("").alias("file"), "name", two("composite").alias("composite"), "band", F.col("selected").cast("string").alias("selected"), F.col("eligible").cast("string").alias("eligible"), two("confidence").alias("confidence"),
        *[two(n.lower()).alias(n) for n in DIMENSIONS], F.array_join("matched", ";").alias("matched_required"), F.array_join("missing", ";").alias("missing_required"), two("years").alias("relevant_years"),
        F.array_join("flags", ";").alias("flags"), F.array_join(F.transform("flags", lambda x: F.concat(F.lit("PENALTY_"), x)), ";").alias("reason_codes"), "explanation",
    )


_PY = "case when {0} then 'True' else 'False' end"


@query(f"""with {_FULL} select candidate_id, array_to_string(list_concat(['Candidate: '||candidate_id, 'Composite: '||{_TWO('composite')}, 'Band: '||band, 'Rank: '||rank, 'Selected: '||{_PY.format('selected')}, 'Eligible: '||{_PY.format('eligible')}, 'Confidence: '||cast(cast(round(confidence,4) as decimal(10,4)) as varchar), 'Sub-scores:',
{', '.join(f"'  {n}: '||coalesce({_TWO(n.lower())},'n/a')" for n in DIMENSIONS)}, 'Matches:'], list_transform(matched, lambda x: '  - '||{_CRITERION}), ['Gaps:'], list_transform(missing, lambda x: '  - '||{_CRITERION}), case when len(flags)>0 then ['Flags: '||array_to_string(flags,', ')] else []::varchar[] end, ['', {_EXPLAIN}]), chr(10)) as derivation from full_""")
def snk_derivation(spark: SparkSession, d: str) -> DataFrame:
    """How a score came about, as text of several lines."""
    line = lambda label, value: F.concat(F.lit(label), value)
    truth = lambda c: F.when(F.col(c), "True").otherwise("False")
    items = lambda c: F.transform(c, lambda x: F.concat(F.lit("  - "), F.regexp_replace(x, "[=(].*$", "")))
    head = F.array(
        line("Candidate: ", F.col("candidate_id")), line("Composite: ", fixed(F.col("composite"), 2)), line("Band: ", F.col("band")), line("Rank: ", F.col("rank").cast("string")), line("Selected: ", truth("selected")), line("Eligible: ", truth("eligible")),
        line("Confidence: ", fixed(F.col("confidence"), 4)), F.lit("Sub-scores:"), *[line(f"  {n}: ", F.coalesce(fixed(F.col(n.lower()), 2), F.lit("n/a"))) for n in DIMENSIONS], F.lit("Matches:"),
    )
    flags = F.when(F.size("flags") > 0, F.array(line("Flags: ", F.array_join("flags", ", ")))).otherwise(F.array().cast("array<string>"))
    whole = F.concat(head, items("matched"), F.array(F.lit("Gaps:")), items("missing"), flags, F.array(F.lit(""), F.col("explanation")))
    return explanation(full_cards(spark, d)).select("candidate_id", F.array_join(whole, "\n").alias("derivation"))


def audit_records(cards: DataFrame, run_id: str, job_hash: str) -> DataFrame:
    """(candidate_id, record): one JSON record per card, for the audit file or a file per candidate."""
    scores = F.struct(*[F.col(n.lower()).alias(n) for n in DIMENSIONS])
    verdict = F.struct("selected", "eligible", "rank")
    record = F.struct(F.lit(run_id).alias("run_id"), "candidate_id", F.lit(job_hash).alias("jobspec_hash"), scores.alias("sub_scores"), "matched", F.col("missing").alias("gaps"), "flags", verdict.alias("selection_verdict"), "composite", "band", "confidence")
    return cards.select("candidate_id", F.to_json(record, {"ignoreNullFields": "false"}).alias("record"))


@query(f"""with {_FULL} select candidate_id, '{JOB_HASH}' as jobspec_hash, rank, selected, {_TWO('composite')} composite, len(matched) matched, len(missing) gaps, {_BLANK('s3')} s3 from full_""")
def snk_audit(spark: SparkSession, d: str) -> DataFrame:
    """The audit records written as JSON and read again, with the hash of the requirements."""
    r = audit_records(full_cards(spark, d), "r1", JOB_HASH)
    schema = "jobspec_hash string, selection_verdict struct<selected boolean, rank int>, composite double, matched array<string>, gaps array<string>, sub_scores struct<S3 double>"
    x = r.select("candidate_id", F.from_json("record", schema).alias("x"))
    return x.select("candidate_id", "x.jobspec_hash", "x.selection_verdict.rank", "x.selection_verdict.selected", fixed(F.col("x.composite"), 2).alias("composite"), F.size("x.matched").alias("matched"), F.size("x.gaps").alias("gaps"), F.coalesce(fixed(F.col("x.sub_scores.S3"), 2), F.lit("")).alias("s3"))
