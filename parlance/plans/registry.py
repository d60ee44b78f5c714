"""Where the queries register, and the tables that they share.

The tables stand in for the library's own: conversations are transcripts (times follow from text lengths), events are speaker
intervals, progress, login and rate-limit streams, embeddings are index vectors, customer, orders and lineitem are users, jobs and records.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, idx, speaker, text, start, end) from conversations."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    rows = t(spark, sf_dir, "conversations").withColumn("end", F.sum(F.length("text")).over(by) / F.lit(15.0))
    return rows.select(F.col("conv_id").alias("job_id"), F.col("turn").alias("idx"), F.col("role").alias("speaker"), "text", F.lag("end", 1, 0.0).over(by).alias("start"), "end")


SEG = """seg0 AS (SELECT *, (sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn))::DOUBLE / 15.0::DOUBLE AS e FROM conversations),
seg AS (SELECT conv_id AS job_id, turn AS idx, role AS speaker, text, coalesce(lag(e) OVER (PARTITION BY conv_id ORDER BY turn), 0.0) AS s, e FROM seg0)"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, ord, start, end, speaker): events of a user as speaker intervals within the hour."""
    rows = t(spark, sf_dir, "events").where(F.col("value").isNotNull())
    at = F.pmod(F.unix_seconds(F.col("ts").cast("timestamp")), F.lit(300)).cast("double")
    return rows.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("ord"), at.alias("start"), (at + F.pmod("event_id", F.lit(7))).alias("end"), F.col("event_type").alias("speaker"))


IVL = "ivl AS (SELECT user_id AS job_id, event_id AS ord, (floor(epoch(ts))::BIGINT % 300)::DOUBLE AS s, (floor(epoch(ts))::BIGINT % 300)::DOUBLE + event_id % 7 AS e, event_type AS speaker FROM events WHERE value IS NOT NULL)"
