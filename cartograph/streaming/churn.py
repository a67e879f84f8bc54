"""Churn as a stream: commits touching files, deduplicated and counted in windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_churn(events: DataFrame, files: int = 64) -> DataFrame:
    """path, commit_sha, author_email, committed_at of an event table; events of a user bucket touch one file."""
    return events.select(
        F.format_string("src/bucket_%02d.rs", F.pmod("user_id", F.lit(files)).cast("int")).alias("path"), F.col("event_id").cast("string").alias("commit_sha"),
        F.col("user_id").cast("string").alias("author_email"), F.col("ts").cast("timestamp").alias("committed_at"),
    )


def read_events(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def distinct_commits(churn: DataFrame, late: str = "1 day") -> DataFrame:
    """Each (path, commit) once; state older than the watermark is dropped."""
    return churn.withWatermark("committed_at", late).dropDuplicatesWithinWatermark(["path", "commit_sha"])


def churn_windows(churn: DataFrame, width: str = "7 days", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """window_start, path, commits: rows for windows that the watermark has passed (append) or all (batch)."""
    w = F.window("committed_at", width, slide) if slide else F.window("committed_at", width)
    n = churn.withWatermark("committed_at", late).groupBy(w.alias("w"), "path").agg(F.count("*").alias("commits"))
    return n.select(F.col("w.start").alias("window_start"), "path", "commits")
