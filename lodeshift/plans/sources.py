"""Queries of scans, guards, hashes, duplicates and bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeshift.operators import duplicates as U
from lodeshift.operators.graph import connected_components
from lodeshift.plans import projections as P
from lodeshift.plans.registry import query
from lodeshift.session import cut
from lodeshift.sources import files
from lodeshift.sources.files import document_id, html_to_text


@query("""select doc_id, case when text is null or text='' then null else 'c_'||substr(sha256(text),1,8) end candidate_id, case when text is null or text='' then null else sha256(text) end sha, coalesce(strlen(text),0) bytes,
case when coalesce(text,'')='' then 'EMPTY' when strlen(text)>10000 then 'TOO_LARGE' when doc_kind='interview_note' then 'UNSUPPORTED' end reason from documents""")
def src_manifest_ids(spark: SparkSession, d: str) -> DataFrame:
    docs = P.table(spark, d, "documents").select("doc_id", "text", "doc_kind")
    sha = F.when(F.coalesce("text", F.lit("")) != "", F.sha2("text", 256))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    reason = F.when(F.coalesce("text", F.lit("")) == "", "EMPTY").when(size > 10000, "TOO_LARGE").when(F.col("doc_kind") == "interview_note", "UNSUPPORTED")
    return docs.select("doc_id", document_id(sha).alias("candidate_id"), sha.alias("sha"), size.alias("bytes"), reason.alias("reason"))


@query(r"""select distinct path, case lower(regexp_extract(path,'\.([A-Za-z0-9]+)$',1)) when 'pdf' then 'application/pdf' when 'docx' then 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' when 'doc' then 'application/msword' when 'rtf' then 'application/rtf' when 'txt' then 'text/plain' when 'md' then 'text/markdown' when 'html' then 'text/html' end as kind,
regexp_matches(path,'^inbox/(.*/)?[^/]*\.pdf$') matched from resumes where path is not null""")
def src_glob_match(spark: SparkSession, d: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for kv in files.MEDIA.items() for x in kv])[F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))]
    return P.table(spark, d, "resumes").where("path is not null").select("path").distinct().select("path", kind.alias("kind"), files.matches(F.col("path"), ("inbox/**/*.pdf",)).alias("matched"))


@query("""with l(name) as (values ('JD1'),('jd2'),('JD3'),('RESUMESJD1'),('resumesjd2'),('ResumesJD9'),('notes')) select a.name job, b.name resumes from l a join l b on upper('RESUMES'||a.name)=upper(b.name) where upper(a.name) like 'JD%'""")
def src_bundle_pairing(spark: SparkSession, d: str) -> DataFrame:
    listing = spark.createDataFrame([(x,) for x in ("JD1", "jd2", "JD3", "RESUMESJD1", "resumesjd2", "ResumesJD9", "notes")], "name string")
    return pair_bundles(listing, listing)


def pair_bundles(jobs: DataFrame, folders: DataFrame) -> DataFrame:
    """(job, resumes): job files and the folders that carry their name, whatever the case."""
    j = jobs.where(F.upper("name").startswith("JD")).select(F.col("name").alias("job"), F.upper(F.concat(F.lit("RESUMES"), "name")).alias("k"))
    return j.join(folders.select(F.col("name").alias("resumes"), F.upper("name").alias("k")), "k").select("job", "resumes")


@query("select sha256(text) class_id, count(*) members, min(doc_id) representative from documents where text is not null group by 1 having count(*)>1")
def dup_exact_clusters(spark: SparkSession, d: str) -> DataFrame:
    return U.exact_classes(P.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h")), "doc_id", "h")


@query("select sha256(text) class_id, arg_max(doc_id, (length(text), coalesce(received_at, timestamp '0001-01-01'), -doc_id)) representative from documents where text is not null group by 1")
def dup_representative(spark: SparkSession, d: str) -> DataFrame:
    """The member of each class that stands for it: most complete, latest, then the smallest id."""
    docs = P.table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("class_id"), F.length("text").alias("n"), F.coalesce(F.col("received_at").cast("timestamp"), F.lit("0001-01-01").cast("timestamp")).alias("at"))
    return docs.groupBy("class_id").agg(F.max_by("doc_id", F.struct("n", "at", -F.col("doc_id"))).alias("representative"))


def sign_prints(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints from the signs of embeddings, with copies at 1 to 4 bits: (id, f)."""
    e = P.table(spark, d, "embeddings").select("vec_id", "embedding")
    # Bits 0 to 62; the sign bit of a long stays clear.
    f = F.aggregate(F.sequence(F.lit(0), F.lit(62)), F.lit(0).cast("long"), lambda acc, i: acc * 2 + F.when(F.get("embedding", i) > 0, 1).otherwise(0))
    base = e.select("vec_id", f.alias("f"))
    masks = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m).cast("long").alias("m")) for k, m in enumerate((0, 1, 3, 7, 15))])
    x = base.select("vec_id", "f", F.explode(masks).alias("c")).where("c.k = 0 or vec_id % 10 = 0")
    return x.select((F.col("vec_id") * 10 + F.col("c.k")).alias("id"), F.col("f").bitwiseXOR(F.col("c.m")).alias("f"))


_PRINTS = """b as (select vec_id, list_reduce(list_prepend(0::bigint, list_transform(range(63), lambda i: case when embedding[i+1]>0 then 1::bigint else 0::bigint end)), lambda a, c: a*2+c) f from embeddings),
prints as (select vec_id*10+k id, xor(f, m) f from b cross join (values (0,0::bigint),(1,1::bigint),(2,3::bigint),(3,7::bigint),(4,15::bigint)) t(k,m) where k=0 or vec_id%10=0)"""


@query(f"with {_PRINTS}, c as (select distinct f from prints) select x.f a, y.f b, bit_count(xor(x.f,y.f))::int distance from c x join c y on x.f<y.f and bit_count(xor(x.f,y.f))<=3")
def dup_near_pairs_banded(spark: SparkSession, d: str) -> DataFrame:
    return U.near_pairs(sign_prints(spark, d), "id", "f")


@query(f"""with recursive {_PRINTS}, c as (select distinct f from prints), e as (select x.f a, y.f b from c x join c y on x.f<>y.f and bit_count(xor(x.f,y.f))<=3), r(f,root) as (select f, f from c union select e.b, r.root from r join e on e.a=r.f),
k as (select f, min(root) class_id from r group by 1), g as (select a f, count(*) links from e group by 1) select id as key, class_id, coalesce(links,0) links from prints join k using(f) left join g using(f)""")
def dup_near_classes(spark: SparkSession, d: str) -> DataFrame:
    return U.near_classes(sign_prints(spark, d), "id", "f")


@query()
def dup_near_documents(spark: SparkSession, d: str) -> DataFrame:
    """(key, class_id, links) of every document by the SimHash of its text. As the definition says, texts that are NULL or
    shorter than a chunk have the fingerprint 0 and are one class."""
    prints = cut(U.simhash(P.table(spark, d, "documents"), "doc_id", "text"))  # read twice
    return U.near_classes(prints, "key", "fingerprint")


@query()
def dup_simhash(spark: SparkSession, d: str) -> DataFrame:
    return U.simhash(P.table(spark, d, "documents"), "doc_id", "text")


_EDGES = "e0 as (select distinct candidate_id c, lower(email) m from resumes where email is not null and candidate_id is not null), e1 as (select c a, min(c) over (partition by m) b from e0)"


@query(f"with recursive {_EDGES}, e as (select a,b from e1 union select b,a from e1), r(n,root) as (select a,a from e union select e.b, r.root from r join e on e.a=r.n) select n as node, min(root) component from r group by 1")
def dup_components(spark: SparkSession, d: str) -> DataFrame:
    """Résumés that share an address, transitively; each address links its members to its smallest, never all pairs."""
    e = P.table(spark, d, "resumes").where("email is not null and candidate_id is not null").select(F.col("candidate_id").alias("a"), F.lower("email").alias("m")).distinct()
    low = e.groupBy("m").agg(F.min("a").alias("b"))
    return connected_components(e.join(low, "m").select("a", "b"))


@query("""with p as (select distinct candidate_id, lower(coalesce(full_name,''))||'|'||lower(coalesce(email,''))||'|'||regexp_replace(coalesce(phone,''),'[^0-9]','','g') k, full_name, email, phone from resumes), g as (select k, count(distinct candidate_id) members, min(candidate_id) representative from p where k<>'||' group by 1 having count(distinct candidate_id)>1) select * from g""")
def dup_contact_identity(spark: SparkSession, d: str) -> DataFrame:
    one = lambda c: F.filter(F.array(c), lambda x: x.isNotNull())
    k = U.contact_key(F.col("full_name"), one("email"), one("phone"))
    by = P.table(spark, d, "resumes").select("candidate_id", k.alias("k")).distinct().where("k <> '||'").groupBy("k").agg(F.count("*").alias("members"), F.min("candidate_id").alias("representative"))
    return by.where("members > 1").select("k", "members", "representative")


@query()
def ext_html_text(spark: SparkSession, d: str) -> DataFrame:
    page = F.concat(F.lit("<html><head><title>"), F.coalesce("doc_kind", F.lit("")), F.lit("</title><style>p {x:y}</style></head><body><p>"), F.regexp_replace("text", "<", "&lt;"), F.lit("</p><script>var a;</script></body></html>"))
    return P.table(spark, d, "documents").where("text is not null").select("doc_id", html_to_text(page).alias("text"))


@query("""select time_bucket(interval '5 minutes', ts) as start, time_bucket(interval '5 minutes', ts)+interval '5 minutes' as "end", event_type, count(*) n, round(sum(value),6) total from events group by 1,2,3""")
def evt_windows(spark: SparkSession, d: str) -> DataFrame:
    """The windows of the streaming operator over the events as a batch."""
    from lodeshift.streaming.scoring import event_windows

    w = event_windows(P.table(spark, d, "events"))
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n", "total")


@query()
def run_shortlist(spark: SparkSession, d: str) -> DataFrame:
    """The whole pipeline: all résumés among the documents, against the texts whose id is divisible by 100 and two written jobs."""
    from lodeshift.plans.pipeline import shortlist
    from lodeshift.plans.requirements import LITERAL

    docs = P.table(spark, d, "documents").where("doc_kind = 'resume'").select(F.col("doc_id").cast("string").alias("candidate_id"), "text")
    asked = P.table(spark, d, "documents").where("doc_id % 100 = 0 and text is not null").select(F.col("doc_id").cast("string").alias("job_id"), "text")
    jobs = asked.unionByName(spark.createDataFrame([(str(i), t) for i, t in LITERAL], "job_id string, text string"))
    return shortlist(docs, jobs, 40.0)


@query("""with r as (select case when coalesce(text,'')='' then 'EMPTY' when strlen(text)>10000 then 'TOO_LARGE' when doc_kind='interview_note' then 'UNSUPPORTED' end code from documents) select 'ingest' stage, code, count(*) n from r where code is not null group by 1,2""")
def snk_errors(spark: SparkSession, d: str) -> DataFrame:
    """Rejects by stage and code, as the error file lists them."""
    return src_manifest_ids(spark, d).where("reason is not null").groupBy(F.lit("ingest").alias("stage"), F.col("reason").alias("code")).agg(F.count("*").alias("n"))


@query(r"""with r as (select distinct candidate_id, full_name from resumes where full_name is not null) select candidate_id, full_name, candidate_id||'_'||regexp_replace(regexp_replace(full_name,'[^\p{L}\p{N}_.-]+','_','g'),'^[._]+|[._]+$','','g') as file from r""")
def snk_copy_names(spark: SparkSession, d: str) -> DataFrame:
    r = P.table(spark, d, "resumes").where("full_name is not null").select("candidate_id", "full_name").distinct()
    return r.select("candidate_id", "full_name", F.concat("candidate_id", F.lit("_"), files.safe_name(F.col("full_name"))).alias("file"))
