"""Queries of canonical names: skills, titles and employers against reference data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeshift.functions import refdata as R
from lodeshift.operators import titles as T
from lodeshift.plans import projections as P
from lodeshift.plans.registry import query
from lodeshift.session import fixed_rows

_ALIAS = "a as (select lower(canonical) k, canonical, 'exact' tier, 0 o from ontology_skills union all select lower(unnest(aliases)), canonical, 'alias', 1 from ontology_skills), al as (select k, arg_min(canonical,(o,canonical)) canonical, arg_min(tier,(o,canonical)) tier from a group by 1)"


def alias_table(ontology: DataFrame) -> DataFrame:
    """(k, canonical, tier): every spelling once, canonical names before aliases."""
    exact = ontology.select(F.lower("canonical").alias("k"), "canonical", F.lit("exact").alias("tier"), F.lit(0).alias("o"))
    other = ontology.select(F.explode(F.transform("aliases", lambda x: F.lower(x))).alias("k"), "canonical", F.lit("alias").alias("tier"), F.lit(1).alias("o"))
    best = F.struct("o", "canonical")
    return exact.unionByName(other).groupBy("k").agg(F.min_by("canonical", best).alias("canonical"), F.min_by("tier", best).alias("tier"))


def canonicalise(raw: DataFrame, column: str, ontology: DataFrame) -> DataFrame:
    """(raw, canonical, tier) of each distinct value: as typed, then without marks; NULL where neither is known.

    Two equal joins with the fixed reference list; only what the first leaves open reaches the second.
    """
    table = F.broadcast(alias_table(ontology))
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.lower("raw"), "[^a-z0-9+# ]", " "), r"\s+", " "))
    values = raw.where(F.col(column).rlike(r"\S")).select(F.col(column).alias("raw")).distinct()
    first = values.withColumn("k", F.lower(F.trim("raw"))).join(table, "k", "left")
    second = first.where("canonical is null").select("raw", bare.alias("k")).join(table.withColumn("tier", F.lit("stripped")), "k", "left")
    return first.where("canonical is not null").select("raw", "canonical", "tier").unionByName(second.select("raw", "canonical", F.when(F.col("canonical").isNotNull(), F.col("tier")).alias("tier")))


_CANON = rf"{_ALIAS}, v as (select distinct raw from skill_matches where regexp_matches(raw,'\S')), f as (select raw, al.canonical, al.tier from v left join al on al.k=lower(trim(raw))), g as (select raw, coalesce(f.canonical, b.canonical) canonical, case when f.canonical is not null then f.tier when b.canonical is not null then 'stripped' end tier from f left join al b on f.canonical is null and b.k=trim(regexp_replace(regexp_replace(lower(raw),'[^a-z0-9+# ]',' ','g'),'\s+',' ','g')))"


@query(f"with {_CANON} select * from g")
def ont_exact_alias(spark: SparkSession, d: str) -> DataFrame:
    return canonicalise(P.table(spark, d, "skill_matches"), "raw", P.table(spark, d, "ontology_skills"))


@query(f"with {_CANON} select raw, count(*) n from skill_matches where raw in (select raw from g where canonical is null) group by 1")
def ont_unmapped(spark: SparkSession, d: str) -> DataFrame:
    values = P.table(spark, d, "skill_matches").where(F.col("raw").rlike(r"\S"))
    known = canonicalise(values, "raw", P.table(spark, d, "ontology_skills")).where("canonical is not null")
    return values.groupBy("raw").agg(F.count("*").alias("n")).join(known, "raw", "left_anti")


@query("""with e as (select canonical a, unnest(children) b, 'child' r from ontology_skills union all select canonical, unnest(parents), 'parent' from ontology_skills) select a.canonical target, b.canonical candidate, case when a.canonical=b.canonical then 'exact' when exists (select 1 from e where e.a=a.canonical and e.b=b.canonical and r='child') then 'child' else 'parent' end relation from ontology_skills a join ontology_skills b on a.canonical=b.canonical or exists (select 1 from e where e.a=a.canonical and e.b=b.canonical)""")
def ont_relation(spark: SparkSession, d: str) -> DataFrame:
    """(target, candidate, relation): how the candidate stands to the target, exact before child before parent."""
    o = P.table(spark, d, "ontology_skills")
    edges = [o.select(F.col("canonical").alias("target"), F.col("canonical").alias("candidate"), F.lit("exact").alias("relation"), F.lit(0).alias("o"))]
    for i, (c, name) in enumerate((("children", "child"), ("parents", "parent")), 1):
        edges.append(o.select(F.col("canonical").alias("target"), F.explode(c).alias("candidate"), F.lit(name).alias("relation"), F.lit(i).alias("o")))
    e = edges[0].unionByName(edges[1]).unionByName(edges[2])
    known = e.join(F.broadcast(o.select(F.col("canonical").alias("candidate")).distinct()), "candidate", "left_semi")
    return known.groupBy("target", "candidate").agg(F.min_by("relation", "o").alias("relation"))


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * longest common subsequence / both lengths."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            keep = row[j]
            row[j] = last + 1 if x == y else max(row[j], row[j - 1])
            last = keep
    return 200.0 * row[-1] / (len(a) + len(b))


@query()
def ont_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """(raw, canonical, ratio) of values that no exact tier knows: the best name of a ratio of 92 or more, first on ties.

    Names whose letters rule out the ratio are not compared; the reference list is fixed and goes with the function.
    """
    o = P.table(spark, d, "ontology_skills")
    names = sorted(r["canonical"] for r in fixed_rows(o.select("canonical").distinct()))
    rest = canonicalise(P.table(spark, d, "skill_matches"), "raw", o).where("canonical is null").select("raw")

    # Letters that only one of two texts has are edits whatever their order: a bound that rules most names out at once.
    letters = sorted({c for n in names for c in n})
    place = {c: i for i, c in enumerate(letters)}

    def counted(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(letters) + 1), "int32")
        for i, t in enumerate(texts):
            for c in t:
                out[i, place.get(c, len(letters))] += 1
        return out

    have, sizes = counted(names), np.array([len(n) for n in names])

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            typed = [raw.lower().strip() for raw in pdf["raw"]]
            for raw, t, mine in zip(pdf["raw"], typed, counted(typed)):
                top = (0.0, None)
                fits = np.abs(have - mine).sum(1) <= 0.08 * (sizes + len(t)) + 1e-9
                for n in (names[i] for i in np.flatnonzero(fits)):
                    if (r := indel_ratio(t, n)) > top[0]:
                        top = (r, n)
                if top[0] >= 92.0:
                    rows.append((raw, top[1], round(top[0], 4)))
            if rows:
                yield pd.DataFrame(rows, columns=["raw", "canonical", "ratio"])

    return rest.mapInPandas(best, "raw string, canonical string, ratio double")


_q = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
@query()
def ont_cascade(spark: SparkSession, d: str) -> DataFrame:
    """(raw, canonical, tier) of every distinct value: exact names, aliases, the same without marks, then the fuzzy tier for what
    those leave; NULL where none knows it."""
    exact = canonicalise(P.table(spark, d, "skill_matches"), "raw", P.table(spark, d, "ontology_skills"))
    fuzzy = ont_fuzzy(spark, d).select("raw", F.col("canonical").alias("near"))
    both = exact.join(fuzzy, "raw", "left")
    return both.select("raw", F.coalesce("canonical", "near").alias("canonical"), F.when(F.col("canonical").isNotNull(), F.col("tier")).when(F.col("near").isNotNull(), "fuzzy").alias("tier"))


_TT = rf"""pat(t,f,s) as (values {_q(R.TITLES)}), kw(f,w,o) as (values {_q(R.keywords())}), inf(w,f) as (values {_q(R.INFLATION.items())}), sen(s,i) as (values {_q([(s, i) for i, s in enumerate(R.SENIORITY)])}),
v as (select distinct title from experience where regexp_matches(title,'\S') union select distinct title from roles), c as (select title, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(title)),'[^a-z0-9+# ]',' ','g'),'\b(i{{1,3}}|iv|v|vi{{1,3}}|ix|x)\b',' ','g'),'\b[0-9]+\b',' ','g'),'\s+',' ','g')) cleaned from v),
tk as (select title, unnest(string_split(cleaned,' ')) w, unnest(range(len(string_split(cleaned,' ')))) p from c), iv as (select title, arg_min(f,p) f from tk join inf using(w) group by 1), sv as (select title, max(i) i from tk join sen on sen.s=tk.w group by 1), kv as (select title, arg_min(f,(-length(w),o)) f from c join kw on contains(cleaned,w) group by 1),
n as (select c.title, cleaned, coalesce(pat.f, iv.f, kv.f) as family, coalesce(pat.s, (select s from sen where sen.i=greatest(case when iv.f is not null then 4 end, sv.i)), 'mid') sl from c left join pat on pat.t=cleaned left join iv on iv.title=c.title left join sv on sv.title=c.title left join kv on kv.title=c.title)"""


@query(f"with {P.ROLES}, {_TT} select title, cleaned, family, case when family is not null then sl end seniority from n")
def ont_title_family(spark: SparkSession, d: str) -> DataFrame:
    typed = P.table(spark, d, "experience").select("title").union(P.roles(spark, d).select("title"))
    return T.normalise_titles(typed)


@query(f"with f(f) as (values {_q([(f,) for f in R.KEYWORDS])}), adj(a,b) as (values {_q(R.adjacency())}) select x.f as family, y.f as other, case when x.f=y.f then 1e0 when exists (select 1 from adj where a=x.f and b=y.f) then 0.55e0 else 0.15e0 end similarity from f x cross join f y")
def ont_title_similarity(spark: SparkSession, d: str) -> DataFrame:
    f = spark.createDataFrame([(x,) for x in R.KEYWORDS], "family string")
    return T.title_similarity(f.crossJoin(f.withColumnRenamed("family", "other"))).select("family", "other", "similarity")


def normalise_employers(names: DataFrame, column: str, aliases: dict[str, str], suffixes: list[str]) -> DataFrame:
    """(raw, employer): the longest alias, as words, stands for the whole; legal forms leave; NULL if nothing is left.

    Aliases and forms are fixed lists in the plan; each distinct name passes once.
    """
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim("raw")), r"[^\p{L}\p{N}. ]", " "), r"\s+", " "))
    v = names.where(F.col(column).rlike(r"\S")).select(F.col(column).alias("raw")).distinct().withColumn("c", clean)
    table = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(c).alias("c")) for a, c in sorted(aliases.items(), key=lambda kv: (-len(kv[0]), kv[0]))])
    padded = F.concat(F.lit(" "), "c", F.lit(" "))
    hit = F.get(F.filter(table, lambda t: F.contains(padded, F.concat(F.lit(" "), t["a"], F.lit(" ")))), F.lit(0))
    whole = F.coalesce(hit["c"], F.col("c"))
    kept = F.array_join(F.filter(F.split(whole, " "), lambda w: ~w.isin(*suffixes)), " ")
    return v.select("raw", F.nullif(kept, F.lit("")).alias("employer"))


_SFX = "[" + ",".join(f"'{s}'" for s in R.LEGAL_FORMS) + "]"


@query(rf"""with al(a,c) as (values {_q(R.EMPLOYER_ALIASES.items())}), v as (select distinct employer raw from experience where regexp_matches(employer,'\S') union values ('Google Inc.'),('IBM Corp'),('Group Holdings'),('AWS Team')), k as (select raw, trim(regexp_replace(regexp_replace(lower(trim(raw)),'[^\p{{L}}\p{{N}}. ]',' ','g'),'\s+',' ','g')) x from v),
h as (select raw, x, (select arg_min(c,(-length(a),a)) from al where contains(' '||x||' ',' '||a||' ')) c from k) select raw, nullif(array_to_string(list_filter(string_split(coalesce(c,x),' '), lambda w: not list_contains({_SFX}, w)),' '),'') employer from h""")
def ont_employer(spark: SparkSession, d: str) -> DataFrame:
    typed = P.table(spark, d, "experience").select(F.col("employer").alias("n")).union(spark.createDataFrame([("Google Inc.",), ("IBM Corp",), ("Group Holdings",), ("AWS Team",)], "n string"))
    return normalise_employers(typed, "n", R.EMPLOYER_ALIASES, R.LEGAL_FORMS)
