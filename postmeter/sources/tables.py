"""Cleaned posts and small results kept as Parquet tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the shared place the session names.

    That is ``spark.checkpoint.dir``, or else the checkpoint folder of the context.
    There is no fallback: a folder of one machine would lose data on a cluster.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/postmeter/{spark.sparkContext.applicationId}"


def drop_table(spark: SparkSession, path: str) -> bool:
    """Delete a kept table; true if it was there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    return target.getFileSystem(conf).delete(target, True)


def write_clean(df: DataFrame, path: str, by_day: bool = False, mode: str = "errorifexists") -> None:
    """Write cleaned posts.

    ``by_day`` makes a folder per day, which pays when queries pick days and
    each day fills files.  Rows are brought together per day first; the
    rebalance splits a day that holds much of the data.
    """
    if not by_day:
        df.write.mode(mode).parquet(path)
        return
    daily = df.withColumn("day", F.to_date("date")).hint("rebalance", F.col("day"))
    daily.write.mode(mode).partitionBy("day").parquet(path)


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def keep_clean(
    df: DataFrame, name: str = "clean_posts", by_day: bool = False, path: str | None = None
) -> DataFrame:
    """Clean once, then read the columns each metric needs.

    Unlike a cache, the table survives the loss of executors and is read with
    column pruning.  Without ``path`` every call writes a table of its own below
    ``shared_dir``; ``drop_table`` removes one that is no longer read.
    """
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    write_clean(df, path, by_day)
    return read_clean(spark, path)
