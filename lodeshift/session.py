"""Session helpers: cutting lineage in the cluster's shared folder, sizing of shuffles."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder of ``spark.checkpoint.dir``. Only a session on one machine may do without; on a cluster a folder that
    its executors don't share would fail or lose data, so there its absence is an error."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(named or "file://" + os.path.join(tempfile.gettempdir(), "lodeshift-checkpoints"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder; later reads don't recompute it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """As ``cut``, with the number of rows, which the same job counts."""
    from pyspark.sql import functions as F

    seen = Observation()
    return cut(df.observe(seen, F.count(F.lit(1)).alias("rows"))), seen.get["rows"]


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, but as a compressed columnar table in the shared folder: for wide or wordy frames."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_bounded(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than it needs to tell."""
    return df.limit(rows + 1).count() <= rows


def fixed_rows(df: DataFrame, most: int = 100_000) -> list:
    """The rows of a reference list, brought to the driver; an error if it is larger than ``most``, for then it is none."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a reference list of more than {most} rows: {df.columns}")
    return rows


def latest(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row per ``key``: the last delivery (NULL times count as earliest). Partial aggregates, no window."""
    from pyspark.sql import functions as F

    top = F.max(F.struct("loaded_at", *columns)).alias("_top")
    return df.groupBy(key).agg(top).select(key, *[f"_top.{c}" for c in columns])
