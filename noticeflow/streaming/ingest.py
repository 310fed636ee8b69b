"""Incremental ingestion of landed announcement files with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from noticeflow.operators import dedup
from noticeflow.schema import ANNOUNCEMENT
from noticeflow.storage import tasks_for

#: Parts of the table of upsert(), by a hash of the key.
BUCKETS = 64
#: Rows of a batch that a task of upsert() sorts: a batch isn't planned anew by its sizes, so the number of its tasks must follow its rows.
TASK_ROWS = 250_000


def announcements(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of the JSON-lines files of a folder, each file once."""
    source = spark.readStream.schema(ANNOUNCEMENT).option("maxFilesPerTrigger", files_per_trigger)
    return source.json(path).withColumn("landed", F.col("_metadata.file_modification_time"))


def append(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append what has landed since the last run to a partitioned table, then stop."""
    return stream.writeStream.format("parquet").partitionBy("source").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, base: str, schema: T.StructType, before: int | None = None, buckets: DataFrame | None = None) -> DataFrame:
    """The table that upsert() keeps below ``base``: each bucket's files of its latest batch (of those before a number), of all buckets or some."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(base).select(
        F.regexp_extract("path", r"/batch=(\d+)/", 1).cast("int").alias("batch"), F.regexp_extract("path", r"/bucket=(\d+)/", 1).cast("int").alias("bucket")
    )
    if before is not None:
        found = found.where(F.col("batch") < before)
    if buckets is not None:
        found = found.join(F.broadcast(buckets), "bucket")
    latest = found.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()  # BUCKETS rows at most
    paths = [f"{base}/batch={r.batch}/bucket={r.bucket}" for r in latest]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert(stream: DataFrame, base: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep the latest row of every key: a batch rewrites the buckets, by a hash of the key, that its rows fall into, and leaves the others as they are.

    What a batch writes is named by its number and made from earlier numbers only, so a batch that is repeated after a failure writes the same again. Files of
    a bucket that a later batch has rewritten are kept until somebody deletes them: readers by current() never look at them.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64("source", "source_id"), F.lit(buckets)).cast("int"))
        if number:
            touched = rows.select("bucket").distinct()
            rows = rows.unionByName(current(spark, base, batch.schema, number, touched).withColumn("bucket", F.pmod(F.xxhash64("source", "source_id"), F.lit(buckets)).cast("int")))
        tasks = max(tasks_for(rows.count(), TASK_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
        rows = rows.repartition(tasks, "source", "source_id")
        kept = dedup.keep_last(rows.withColumn("seen", F.coalesce("crawled_at", F.lit(""))), ["source", "source_id"], ["landed", "seen"]).drop("seen")
        kept.write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/batch={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_day(stream: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Announcements by source and day of collection, with a watermark for late files."""
    timed = stream.withColumn("at", F.try_to_timestamp("crawled_at")).withWatermark("at", lateness)
    return timed.groupBy(F.window("at", "1 day").alias("day"), "source").agg(F.count("*").alias("n"))
