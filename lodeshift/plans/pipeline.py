"""Documents and job descriptions to a ranked shortlist: every step a lazy frame keyed by job and document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeshift.functions import factors as X
from lodeshift.operators import scoring as S
from lodeshift.operators import titles as T
from lodeshift.plans.requirements import LIST_MARK, sectioned, skill_names, weigh, years_asked
from lodeshift.plans.statistics import parse_date, split_range
from lodeshift.plans.text import _INJ, is_heading, section_kind
from lodeshift.session import cut, is_bounded, shuffle_width, stored

RUN_DATE = "2026-08-29"


def compile_jobs(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(skills, needs) of job descriptions (job_id, text): (job_id, kind, skill, weight) and (job_id, title, min_years, target_years)."""
    lines = sectioned(jobs.select(F.col("job_id").alias("doc_id"), "text")).where("k is null and t <> ''")
    item = F.regexp_replace("t", LIST_MARK, "")
    pieces = lines.where("section in ('required', 'preferred')").select("doc_id", "section", weigh(item).alias("w"), F.explode(skill_names(item)).alias("skill"))
    skills = pieces.select(F.col("doc_id").alias("job_id"), F.col("section").alias("kind"), "skill", F.when(F.col("section") == "preferred", 2).otherwise(F.col("w")).cast("double").alias("weight"))
    skills = skills.groupBy("job_id", "kind", "skill").agg(F.max("weight").alias("weight"))
    asked, ideal = years_asked(F.col("text"))
    least = F.coalesce(asked, F.lit(0))
    target = F.coalesce(ideal, F.when(least > 0, least + 3).otherwise(0))
    needs = jobs.select("job_id", F.trim(F.regexp_extract(F.regexp_replace("text", r"^\s+", ""), r"^([^\r\n]*)", 1)).alias("title"), least.cast("double").alias("min_years"), target.cast("double").alias("target_years"))
    return skills, needs


LONGEST_NAME = 5  # words in the name of a skill, as the compiler makes them
NAMED = "abcdefghijklmnopqrstuvwxyz0123456789+#/.-"  # listed, for Java looks up single characters at once but tries ranges one by one


def structure(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profiles, roles, lines) of (candidate_id, text): which sections there are and instructions found; dated roles; the
    lines outside headings with the role they stand under (its line, 0 for none) and whether they list."""
    lines = documents.select("candidate_id", F.posexplode(F.split(F.regexp_replace("text", "\r", ""), "\n", -1)).alias("i", "t")).select("candidate_id", (F.col("i") + 1).alias("line"), F.trim("t").alias("t")).where("t <> ''")
    dated = F.contains("t", F.lit("|")) & F.col("t").rlike("(?:19|20)[0-9]{2}")
    headed = lines.withColumn("header", dated).withColumn("k", F.when(is_heading(F.col("t")) & ~F.contains("t", F.lit("|")), section_kind(F.col("t"))))
    order = Window.partitionBy("candidate_id").orderBy("line")
    placed = headed.withColumn("section", F.last("k", ignorenulls=True).over(order)).withColumn("last", F.last(F.when(F.col("header") | F.col("k").isNotNull(), F.struct("line", "header")), ignorenulls=True).over(order)).where("k is null")
    listed = F.coalesce((F.col("section") == "skills") | (F.size(F.split("t", "[,;|•]")) >= 4), F.lit(False))
    body = stored(placed.select("candidate_id", "section", "t", "line", "header", F.when(F.col("last.header"), F.col("last.line")).otherwise(0).alias("role"), listed.alias("listed")))
    each = body.groupBy("candidate_id", "section").agg(F.sum(F.regexp_count("t", F.lit(_INJ))).alias("n"))  # a set over lines would sort their texts
    profiles = each.groupBy("candidate_id").agg(F.collect_set("section").alias("sections"), F.sum("n").alias("injected"))
    parts = F.split("t", r"\s*\|\s*")
    header = body.where("header").select("candidate_id", F.col("line").alias("role"), F.get(parts, F.lit(1)).alias("title"), split_range(F.element_at(parts, -1)).alias("r"))
    a, b = parse_date(F.col("r.start"), RUN_DATE)["value"], parse_date(F.col("r.end"), RUN_DATE)["value"]
    roles = header.select("candidate_id", "role", "title", F.to_date(a).alias("s"), F.to_date(F.coalesce(b, F.lit(RUN_DATE))).alias("e"))
    return profiles, roles, body.select("candidate_id", "role", "listed", "t")


def named_skills(lines: DataFrame, skills: DataFrame) -> DataFrame:
    """(candidate_id, role, listed, skill): which of the wanted names stand in which lines, as whole words.

    Names meet lines by an equal join, on their first word if all names can be held, else on all runs of up to
    ``LONGEST_NAME`` words of a line: texts never meet jobs.
    """
    words = F.split(F.trim(F.regexp_replace(F.lower("t"), f"[^{NAMED}]+|[.]+(?= |$)", " ")), " +")
    said, names = lines.select("candidate_id", "role", "listed", words.alias("w")), skills.select("skill").distinct()
    if is_bounded(names, 100_000):
        parts = F.split("skill", " ")
        first = names.select("skill", F.get(parts, F.lit(0)).alias("word"), F.size(parts).alias("n")).where(F.col("n") <= LONGEST_NAME)
        row = F.arrays_zip(*[F.slice("w", i + 1, F.size("w")).alias(f"w{i}") for i in range(LONGEST_NAME)])
        met = said.select("candidate_id", "role", "listed", F.explode(row).alias("x")).withColumn("word", F.col("x.w0")).join(F.broadcast(first), "word")
        run = F.concat_ws(" ", "word", *[F.when(F.col("n") > i, F.col(f"x.w{i}")) for i in range(1, LONGEST_NAME)])
        return met.where(run == F.col("skill")).select("candidate_id", "role", "listed", "skill").distinct()
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(LONGEST_NAME)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, n), " "))))
    return said.select("candidate_id", "role", "listed", F.explode(F.array_distinct(runs)).alias("skill")).join(names, "skill").select("candidate_id", "role", "listed", "skill").distinct()


def _total(kind: str):
    return F.aggregate(F.filter("asks", lambda x: x["kind"] == kind), F.lit(0.0), lambda acc, x: acc + x["weight"])


def job_profiles(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(profiles, members): what jobs (job_id, text) ask for, each different set once under its smallest job, and (profile, job_id).

    ``base`` names the first profile that is equal but for the skills' names: without a skill found they score alike.
    """
    one = jobs.where("job_id is not null").groupBy("job_id").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("text"))
    skills, needs = compile_jobs(one)
    asks = skills.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("kind", "skill", "weight"))).alias("asks"))
    targets = T.normalise_titles(needs.select("title")).select("title", F.col("family").alias("other"), F.col("seniority").alias("wanted"))
    own = ["min_years", "target_years", "other", "wanted", "asks"]
    whole = needs.join(asks, "job_id", "left").join(targets, "title", "left").withColumn("asks", F.coalesce("asks", F.array().cast("array<struct<kind:string,skill:string,weight:double>>")))
    whole = cut(whole.select("job_id", *own, F.to_json(F.struct(*own)).alias("key")))
    names = F.array_sort(F.transform(F.filter("asks", lambda x: x["kind"] == "required"), lambda x: x["skill"]))
    each = whole.groupBy("key").agg(F.min("job_id").alias("profile"), *[F.first(c).alias(c) for c in own]).withColumns({"names": names, "total": _total("required"), "liked": _total("preferred")})
    each = each.withColumn("kin", F.to_json(F.struct(*own[:4], F.col("total") > 0, F.col("liked") > 0)))
    kin = each.groupBy("kin").agg(F.min("profile").alias("base"))
    profiles = cut(each.join(kin, "kin").drop("kin"))
    return profiles.drop("key"), whole.select("key", "job_id").join(profiles.select("key", "profile"), "key").select("profile", "job_id")


def _careers(met: DataFrame, by: list[str]) -> DataFrame:
    """(*by, years, fit) of roles (*by, family, seniority, s, e) beside a job's other, wanted and the overlap of skills."""
    met = T.title_similarity(met)
    relevance = X.clip(0.35 * F.col("similarity") + 0.45 * F.col("overlap") + 0.20, 0.0, 1.0)  # no domain is asked for: its term is full
    years = S.relevant_years(met.select(F.struct(*by).alias("candidate_id"), "s", "e", relevance.alias("relevance"), F.lit(1.0).alias("factor")))
    years = years.select(*[F.col(f"candidate_id.{c}").alias(c) for c in by], "years")
    gap = F.coalesce(T.seniority_index(F.col("seniority")) - T.seniority_index(F.col("wanted")), F.lit(0))
    age = X.years_by_days(F.col("e"), F.to_date(F.lit(RUN_DATE)))
    fit = met.groupBy(*by).agg(F.max(F.col("similarity") * X.seniority_factor(gap) * F.when(age <= 0, 1.0).otherwise(X.recency(age, 6.0, 0.55))).alias("fit"))
    return years.join(fit, by)


def _scored(rows: DataFrame, met, liked) -> DataFrame:
    """Adds s1, s4 and the composite to rows that have a profile's needs, a candidate's lost and flagged, years and fit;
    ``met`` and ``liked`` are the weights met of the required and the preferred skills."""
    share = lambda part, whole, empty: F.when(F.col(whole) > 0, F.round(100.0 * part / F.col(whole), 6)).otherwise(F.lit(empty).cast("double"))
    s4 = X.years_score(F.coalesce("years", F.lit(0.0)), F.col("min_years"), F.col("target_years"))
    s5, s10 = 100.0 * F.coalesce("fit", F.lit(0.0)), 100.0 - 15.0 * F.least("lost", F.lit(2))
    wide = rows.withColumns({"s1": share(met, "total", 100.0), "s2": share(liked, "liked", None), "s4": s4, "s5": s5, "s10": s10})
    names = {k: v for k, v in X.WEIGHTS.items() if k in ("S1", "S2", "S4", "S5", "S10")}
    active = sum((F.when(F.col(n.lower()).isNotNull(), w).otherwise(0.0) for n, w in names.items()), F.lit(0.0))
    score = sum((F.coalesce(F.round(F.lit(w) * F.col(n.lower()) / F.col("active"), 2), F.lit(0.0)) for n, w in names.items()), F.lit(0.0))
    penalty = F.when(F.col("flagged"), S.PENALTIES["PROMPT_INJECTION"]).otherwise(0.0)
    return wide.withColumn("active", active).withColumn("composite", X.clip(F.round(score - penalty, 2), 0.0, 100.0))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if is_bounded(df, 100_000) else df


FEW, CHUNK = 8, 500  # jobs of a profile whose rows are written where they were sorted; jobs that meet a row at once


def _for_jobs(ranked: DataFrame, names: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of ranked profiles, finished once and given to every job of the profile.

    A profile may have most of the jobs, and its rows lie together, as they were sorted. Those of profiles with more than
    ``FEW`` jobs are spread over all partitions before they are multiplied.
    """
    spark = ranked.sparkSession
    sizes = members.groupBy("profile").agg(F.count("*").alias("n"))
    some = F.pmod(F.xxhash64("job_id"), F.ceil(F.col("n") / CHUNK)).alias("some")
    chunks = cut(members.join(sizes, "profile").groupBy("profile", "n", some).agg(F.collect_list("job_id").alias("jobs")))
    none = F.array().cast("array<string>")
    missing = F.array_except("names", F.coalesce("found", none)).alias("missing")
    flags = F.when(F.col("flagged"), F.array(F.lit("PROMPT_INJECTION"))).otherwise(none).alias("flags")
    row = ["rank", "candidate_id", "composite", "band", "selected", "missing", "flags"]

    def given(rows: DataFrame, jobs: DataFrame) -> DataFrame:
        whole = rows.join(_small(names), "profile").select("profile", "rank", "candidate_id", "composite", X.band(F.col("composite")).alias("band"), "selected", missing, flags)
        return whole.join(_small(jobs.select("profile", "jobs")), "profile").select(F.explode("jobs").alias("job_id"), *row)

    narrow = ranked.select("profile", "rank", "candidate_id", "composite", "selected", "found", "flagged")
    few, many = chunks.where(F.col("n") <= FEW), chunks.where(F.col("n") > FEW)
    spread = narrow.join(_small(many.select("profile").distinct()), "profile").repartition(shuffle_width(spark), "profile", "candidate_id")
    return given(narrow, few).unionByName(given(spread, many))


def shortlist(documents: DataFrame, jobs: DataFrame, threshold: float = 70.0, top: int | None = None) -> DataFrame:
    """(job_id, rank, candidate_id, composite, band, selected, missing, flags) of every candidate for every job.

    ``documents`` is (candidate_id, text), ``jobs`` (job_id, text). NULL and blank documents score 0 where text counts;
    repeated ids count once, by their longest text. Dimensions that the texts can't show are left out and their weight
    goes to the others. Every pair of a job and a candidate is a row of the result, but only the last step makes it: jobs
    that ask for the same are ranked once, as a profile; candidates in whom a profile finds no skill are scored by
    their sections and career alone, equal ones once; what is sorted of a pair are its scores and the skills found.
    """
    docs = documents.where("candidate_id is not null").groupBy("candidate_id").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("text"))
    profiles, members = job_profiles(jobs)
    few = _small(profiles.drop("asks"))
    sections, roles, lines = structure(docs.where(r"text rlike '\\S'"))
    none = F.array().cast("array<string>")
    # Roles with the families of their titles; candidates with what scores without a skill, equal ones as one kind.
    held = roles.where("s is not null and s <= e").join(T.normalise_titles(roles.select("title").distinct()), "title", "left").select("candidate_id", "role", "family", "seniority", "s", "e")
    careers = held.groupBy("candidate_id").agg(F.sort_array(F.collect_set(F.struct("family", "seniority", "s", "e"))).alias("career"))
    lost = F.size(F.array_except(F.array(F.lit("experience"), F.lit("skills"), F.lit("education")), F.coalesce("sections", none)))
    full = docs.select("candidate_id").join(sections, "candidate_id", "left").join(careers, "candidate_id", "left")
    full = full.select("candidate_id", lost.alias("lost"), F.coalesce(F.col("injected") > 0, F.lit(False)).alias("flagged"), "career")
    full = stored(full.withColumn("like", F.sha2(F.to_json(F.struct("lost", "flagged", "career")), 256)))
    kinds = cut(full.groupBy("like").agg(*[F.first(c).alias(c) for c in ("lost", "flagged", "career")]).withColumn("kind", F.monotonically_increasing_id()))
    bases = profiles.where("profile = base").select("base", "min_years", "target_years", "other", "wanted", "total", "liked")
    beside = kinds.crossJoin(_small(bases))
    dated = beside.select("base", "kind", "other", "wanted", F.when(F.col("total") > 0, 0.0).otherwise(1.0).alias("overlap"), F.explode("career").alias("r")).select("base", "kind", "other", "wanted", "overlap", "r.*")
    plain = stored(_scored(beside.drop("career").join(_careers(dated, ["base", "kind"]), ["base", "kind"], "left"), F.lit(0.0), F.lit(0.0)).select("base", "kind", "composite", "s1", "s4"))
    # Pairs with a skill found: the names met, on the candidate's partition.
    wanted = profiles.select("profile", F.explode("asks").alias("a")).select("profile", "a.kind", "a.skill", "a.weight")
    hits = cut(named_skills(lines, wanted)).repartition(shuffle_width(docs.sparkSession), "candidate_id")
    m = F.when(F.col("listed"), X.PROFICIENCY["listed"]).otherwise(X.PROFICIENCY["narrated"])
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    gained = F.col("weight") * F.col("m")
    met = hits.groupBy("candidate_id", "skill").agg(F.max(m).alias("m")).join(_small(wanted), "skill").groupBy("candidate_id", "profile")
    met = stored(met.agg(F.coalesce(F.sum(of("required", gained)), F.lit(0.0)).alias("met"), F.coalesce(F.sum(of("preferred", gained)), F.lit(0.0)).alias("likes"), F.collect_set(of("required", F.col("skill"))).alias("found")))
    shown = hits.where("role > 0").select("candidate_id", "role", "skill").distinct().join(_small(wanted.where("kind = 'required'").select("profile", "skill")), "skill").groupBy("candidate_id", "profile", "role").agg(F.count("*").alias("shown"))
    overlap = F.when(F.size("names") == 0, 1.0).otherwise(F.coalesce("shown", F.lit(0)) / F.size("names"))
    dated = met.select("candidate_id", "profile").join(held, "candidate_id").join(few, "profile").join(shown, ["candidate_id", "profile", "role"], "left").withColumn("overlap", overlap)
    found = met.join(full.select("candidate_id", "lost", "flagged"), "candidate_id").join(few, "profile").join(_careers(dated, ["profile", "candidate_id"]), ["profile", "candidate_id"], "left")
    found = _scored(found, F.col("met"), F.col("likes")).groupBy("candidate_id").agg(F.map_from_entries(F.collect_list(F.struct("profile", F.struct("composite", "s1", "s4", "found")))).alias("special"))
    # All pairs, narrow: a profile's own score of a candidate, else that of the kind.
    many = stored(full.join(kinds.select("like", "kind"), "like").join(found, "candidate_id", "left").select("candidate_id", "kind", "flagged", "special"))
    pairs = many.crossJoin(_small(profiles.select("profile", "base"))).withColumn("x", F.col("special")[F.col("profile")]).join(_small(plain), ["base", "kind"])
    own = lambda c: F.when(F.col("x").isNotNull(), F.col(f"x.{c}")).otherwise(F.col(c)).alias(c)
    cards = pairs.select("profile", "candidate_id", "flagged", own("composite"), own("s1"), own("s4"), F.col("x.found").alias("found"), F.lit(1.0).alias("confidence"), F.lit(True).alias("eligible"))
    return _for_jobs(S.rank(cards, threshold, top, "profile"), profiles.select("profile", "names"), members)
