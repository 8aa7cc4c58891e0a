"""Streams beyond the batch queries: files scored as they arrive against stored job descriptions, windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeshift.plans.pipeline import shortlist


def score_arrivals(documents: DataFrame, jobs: DataFrame, folder: str, checkpoint: str, threshold: float = 70.0):
    """A streaming query that scores each micro-batch of (candidate_id, text) and appends the cards, by batch.

    Ranks hold within a batch; the global rank comes from the stored cards, by ``rank_stored``.
    """

    def score(batch: DataFrame, number: int) -> None:
        shortlist(batch, jobs, threshold).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return documents.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rank_stored(spark: SparkSession, folder: str) -> DataFrame:
    """(job_id, candidate_id, composite, rank) over all stored batches; a candidate's latest batch counts."""
    from pyspark.sql import Window

    cards = spark.read.parquet(f"{folder}/*")
    newest = cards.groupBy("job_id", "candidate_id").agg(F.max_by("composite", "batch").alias("composite")) if "batch" in cards.columns else cards
    return newest.withColumn("rank", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("composite"), "candidate_id")))


def event_windows(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, end, event_type, n, total) of tumbling windows over (ts, event_type, value), late rows up to the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    by = timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return by.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", F.round("total", 6).alias("total"))
