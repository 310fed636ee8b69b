"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROWS_IN_TASK = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a session within one process gets a temporary folder; executors elsewhere couldn't see one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="noticeflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def tasks_for(rows: int, per: int = ROWS_IN_TASK) -> int:
    """How many tasks, and so files, a table of so many narrow rows is worth, whatever the session's number of shuffle partitions."""
    return max(1, -(-rows // per))


def materialise(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back: it is computed once, its lineage ends, and a lost executor costs nothing.

    ``rows``: how many narrow rows it may have, so that a small table isn't scattered over as many files as there are shuffle partitions. The marker of a
    finished job is left out, as nobody else looks for these tables.
    """
    path = work_dir(df.sparkSession, label)
    df = df if rows is None else df.repartition(tasks_for(rows))
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the table that materialise() wrote for a frame, once nothing that is still to be computed reads it."""
    spark = df.sparkSession
    folders = {path.rsplit("/", 1)[0] for path in df.inputFiles()}
    root = shared_dir(spark).split(":", 1)[-1].lstrip("/")
    for folder in folders:
        if folder.split(":", 1)[-1].lstrip("/").startswith(root + "/"):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished queries: it does once the driver's collectors have found that nothing refers to them, which they may not for long."""
    gc.collect()
    spark._jvm.System.gc()
