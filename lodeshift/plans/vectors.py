"""Queries over embeddings: neighbours, votes, best pairs, two-means, semantic scores with pool calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeshift.functions.factors import clip
from lodeshift.operators import vectors as V
from lodeshift.plans import projections as P
from lodeshift.plans.registry import query

TOP = 5
LOW, HIGH, POOL = 0.25, 0.70, 30  # fixed values: anchors, and the pool that is large enough to calibrate on

_E = "e as (select vec_id, label, embedding::double[] v from embeddings where embedding is not null)"
_NEAR = f"{_E}, n as (select q.vec_id query, x.vec_id neighbour, x.label, list_cosine_similarity(q.v, x.v) c from e q join e x on q.vec_id<>x.vec_id where q.vec_id%100=0), r as (select *, row_number() over (partition by query order by round(c,9) desc, neighbour) rank from n)"


def _near(spark: SparkSession, d: str) -> DataFrame:
    e = P.table(spark, d, "embeddings").select("vec_id", "embedding")
    return V.top_neighbours(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", TOP)


@query(f"with {_NEAR} select query, neighbour, rank::int rank, round(c,5) cosine from r where rank<={TOP}")
def vec_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).select("query", "neighbour", "rank", F.round("cosine", 5).alias("cosine"))


@query(f"with {_NEAR}, w as (select query, label, round(sum(1/greatest(1-c,1e-9)),6) weight from r where rank<={TOP} group by 1,2) select query, arg_min(label,(-weight,label)) as label, round(max(weight),4) weight from w group by 1")
def vec_knn_vote(spark: SparkSession, d: str) -> DataFrame:
    labels = P.table(spark, d, "embeddings").select(F.col("vec_id").alias("neighbour"), "label")
    return V.vote(_near(spark, d), labels).select("query", "label", F.round("weight", 4).alias("weight"))


_CHUNKS = f"{_E}, j as (select label, min(vec_id) vec_id from e group by 1), jd as (select e.label, e.vec_id, e.v, 1+e.label%5 weight from e join j using(vec_id)), c as (select vec_id%40 candidate, vec_id, v from e), s as (select candidate, jd.label, jd.vec_id jid, jd.weight, c.vec_id, list_cosine_similarity(jd.v,c.v) sim from jd join c on jd.vec_id<>c.vec_id)"


def _similar(spark: SparkSession, d: str) -> DataFrame:
    """(candidate, label, jid, weight, vec_id, sim): candidates' chunks against the job's few chunks, held beside each row."""
    e = P.table(spark, d, "embeddings").where("embedding is not null")
    first = e.groupBy("label").agg(F.min("vec_id").alias("jid"), F.min_by("embedding", "vec_id").alias("jv")).select("label", "jid", "jv", (F.lit(1) + F.col("label") % 5).alias("weight"))
    chunks = e.select((F.col("vec_id") % 40).alias("candidate"), "vec_id", F.col("embedding").alias("v"))
    pairs = chunks.crossJoin(F.broadcast(first)).where("jid <> vec_id")  # one row a label on the broadcast side
    return pairs.select("candidate", "label", "jid", "weight", "vec_id", V.cosine(F.col("jv"), F.col("v")).alias("sim"))


@query(f"with {_CHUNKS} select candidate, arg_min(jid,(-round(sim,9),jid,vec_id)) jd_chunk, arg_min(vec_id,(-round(sim,9),jid,vec_id)) chunk, round(max(sim),5) cosine from s group by 1")
def vec_best_pair(spark: SparkSession, d: str) -> DataFrame:
    order = F.struct(-F.round("sim", 9), "jid", "vec_id")
    by = _similar(spark, d).groupBy("candidate").agg(F.min_by("jid", order).alias("jd_chunk"), F.min_by("vec_id", order).alias("chunk"), F.max("sim").alias("m"))
    return by.select("candidate", "jd_chunk", "chunk", F.round("m", 5).alias("cosine"))


@query()
def vec_kmeans2(spark: SparkSession, d: str) -> DataFrame:
    e = P.table(spark, d, "embeddings").select((F.col("vec_id") % 97).alias("owner"), "vec_id", "embedding")
    return V.two_means(e, "owner", "vec_id", "embedding")


_RAW = f"{_CHUNKS}, b as (select candidate, label, weight, max(sim) m from s group by 1,2,3), raw as (select candidate, sum(weight*m)/sum(weight) as raw from b group by 1)"


def _raw(spark: SparkSession, d: str) -> DataFrame:
    best = _similar(spark, d).groupBy("candidate", "label", "weight").agg(F.max("sim").alias("m"))
    return best.groupBy("candidate").agg((F.sum(F.col("weight") * F.col("m")) / F.sum("weight")).alias("raw"))


@query(f"with {_RAW}, p as (select count(*) n, quantile_cont(raw,0.1) lo, quantile_cont(raw,0.9) hi from raw) select candidate, round(raw,5) as raw, round(greatest(0e0,least(1e0,(raw-(case when n>={POOL} then lo else {LOW}e0 end))/greatest((case when n>={POOL} then hi else {HIGH}e0 end)-(case when n>={POOL} then lo else {LOW}e0 end),0.05e0))),4) calibrated from raw cross join p")
def s3_pool_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Raw similarity stretched between the pool's 10th and 90th percentiles, or fixed anchors for a small pool."""
    raw = _raw(spark, d)
    p = raw.agg(F.count("*").alias("n"), F.percentile("raw", 0.1).alias("lo"), F.percentile("raw", 0.9).alias("hi"))
    lo, hi = F.when(F.col("n") >= POOL, F.col("lo")).otherwise(LOW), F.when(F.col("n") >= POOL, F.col("hi")).otherwise(HIGH)
    value = clip((F.col("raw") - lo) / F.greatest(hi - lo, F.lit(0.05)), 0.0, 1.0)
    return raw.crossJoin(F.broadcast(p)).select("candidate", F.round("raw", 5).alias("raw"), F.round(value, 4).alias("calibrated"))


@query(f"with {_RAW} select candidate, round(100e0*greatest(0e0,least(1e0,(raw-{LOW}e0)/{HIGH - LOW}e0)),3) as value from raw")
def s3_semantic(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d).select("candidate", F.round(100.0 * clip((F.col("raw") - LOW) / (HIGH - LOW), 0.0, 1.0), 3).alias("value"))
