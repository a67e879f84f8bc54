"""Session helpers: shared scratch tables and session defaults.

Intermediate results that are read more than once, or that would grow the lineage of a
loop, are written as Parquet tables below the folder named in ``spark.checkpoint.dir``.
Every executor and the driver can read them, so a lost executor costs only its running
tasks. The folder is read from the session; a temporary one is set only where the setting is missing and the
session runs on one machine. On a cluster a missing setting is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("cartograph")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cartograph-"))
    return spark.sparkContext.getCheckpointDir()


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> bool:
    """Deletes a file or folder of any file system that Spark knows."""
    target, fs = _file_system(spark, path)
    return fs.delete(target, True)


def _new_path(spark: SparkSession) -> str:
    path = f"{shared_dir(spark)}/spool-{uuid.uuid4().hex}"
    target, fs = _file_system(spark, path)
    fs.deleteOnExit(target)
    return path


def spool(df: DataFrame, *partition_by: str) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and returns a scan of it.

    The scan has no lineage before the table. The table is deleted by drop_spool(), or else when the JVM ends.
    """
    spark = df.sparkSession
    path = _new_path(spark)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spool_path = path
    return out


def spool_sorted(df: DataFrame, *key: str) -> DataFrame:
    """Like spool(), in buckets by hash of the key, each sorted by it: joins and groups by the key need no shuffle.

    The number of buckets is spark.sql.shuffle.partitions, so a table that was grouped by the key is written as it lies.
    """
    spark = df.sparkSession
    path, name = _new_path(spark), f"sorted_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, *key).sortBy(*key).saveAsTable(name)
    out = spark.table(name)
    out.schema  # noqa: B018 - resolved now; the files stay when the name goes
    spark.sql(f"DROP TABLE {name}")
    out._spool_path = path
    return out


def drop_spool(df: DataFrame) -> None:
    """Deletes a table written by spool() once nothing lazy reads it any more."""
    if path := getattr(df, "_spool_path", None):
        remove(df.sparkSession, path)


def spooled(df: DataFrame) -> bool:
    """Whether a table written by spool() still lies where it was written."""
    target, fs = _file_system(df.sparkSession, df._spool_path)
    return fs.exists(target)
