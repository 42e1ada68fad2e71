"""The request log as a dated parquet table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def enrich(log: DataFrame) -> DataFrame:
    """Defaults that the log needs before it is stored."""
    return log.withColumn("credit_cost", F.coalesce("credit_cost", F.lit(0))).withColumn("method", F.upper("method"))


def write_request_log(log: DataFrame, path: str, mode: str = "append") -> None:
    """One folder per day: retention drops folders and time filters prune them."""
    enrich(log).withColumn("log_date", F.to_date("ts")).repartition("log_date", F.pmod(F.hash("id"), F.lit(16))).write.mode(mode).partitionBy("log_date").parquet(path)


def read_request_log(spark: SparkSession, path: str, since=None, newest: int | None = None) -> DataFrame:
    log = spark.read.parquet(path)
    if since is not None:
        log = log.where((F.col("log_date") >= F.to_date(F.lit(since))) & (F.col("ts") >= F.lit(since)))
    log = log.drop("log_date")
    return log.orderBy(F.desc("ts"), F.desc("id")).limit(newest) if newest is not None else log
