"""Commit churn and changed files from git, as DataFrames."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartograph.schema import CHURN

FORMAT = "%x00%H|%ae|%ct"  # a zero byte begins each record


def parse_log(records: DataFrame, files: DataFrame) -> DataFrame:
    """Churn rows of log records, each a header line and the paths of its commit; only indexed paths are kept."""
    part = F.split(F.substring_index("record", "\n", 1), r"\|")
    rows = records.where("record <> ''").select(
        F.explode(F.split("record", "\n")).alias("path"), part[0].alias("commit_sha"), F.get(part, 1).alias("author_email"), F.try_to_number(F.get(part, 2), F.lit("9999999999999")).cast("long").alias("committed_at")
    )
    return rows.dropDuplicates(["path", "commit_sha"]).join(files.select("path"), "path", "left_semi")


def churn(spark: SparkSession, root: str, files: DataFrame, days: int = 90) -> DataFrame:
    """The churn of a repository's last days; empty where git fails."""
    done = subprocess.run(["git", "-C", root, "log", f"--since={days} days ago", f"--format={FORMAT}", "--name-only"], capture_output=True, text=True, check=False)
    if done.returncode:
        return spark.createDataFrame([], CHURN)
    return parse_log(spark.createDataFrame([(r,) for r in done.stdout.split("\0")], "record string"), files)


def changed(spark: SparkSession, root: str, ref: str) -> DataFrame:
    """path: files that differ from a commit; empty outside a repository."""
    done = subprocess.run(["git", "-C", root, "diff", "--name-only", ref], capture_output=True, text=True, check=False)
    if done.returncode and "not a git repository" not in done.stderr.lower():
        raise ValueError(done.stderr.strip())
    return spark.createDataFrame([(x,) for x in done.stdout.split("\n") if x and not done.returncode], "path string")
