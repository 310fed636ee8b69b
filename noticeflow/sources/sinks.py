"""Sinks. Spark's committer makes a write visible as a whole or not at all; a path that is being read is never overwritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.operators import diff
from noticeflow.sources.attachments import text_with_note
from noticeflow.storage import materialise


def write_announcements(rows: DataFrame, path: str, form: str = "json") -> None:
    """Announcements as JSON lines (or another format), without the columns that only ordered them."""
    rows.drop("page", "pos").write.mode("overwrite").format(form).save(path)


def write_diff(compared: DataFrame, path: str, form: str = "json") -> DataFrame:
    """Rows to review below ``path``/review and gone ones below ``path``/gone, from one computation; returns the summary."""
    done = materialise(compared, "diff")
    diff.review(done).write.mode("overwrite").format(form).save(f"{path}/review")
    diff.gone(done).write.mode("overwrite").format(form).save(f"{path}/gone")
    return diff.summary(done)


def detail_text() -> Column:
    """A detail as text: its address, hash, version and attachments as header lines, then the body."""
    names = F.array_join(F.transform("attachments", lambda a: F.coalesce(a["filename"], F.lit(""))), ", ")
    head = [F.concat(F.lit(label), F.coalesce(value.cast("string"), F.lit(""))) for label, value in (("", F.col("url")), ("CONTENT_HASH ", F.col("content_hash")), ("HASH_VERSION ", F.col("hash_version")), ("ATTACHMENTS ", names))]
    return F.concat_ws("\n", *head, F.lit(""), F.col("body"))


def write_details(details: DataFrame, path: str) -> None:
    details.select("source", "source_id", detail_text().alias("text")).write.mode("overwrite").partitionBy("source").parquet(path)


def write_extracted(files: DataFrame, path: str) -> None:
    """Extraction results: texts of successes, and markers, without any text, of failures."""
    done = materialise(files, "extracted")
    done.where("result.ok").select("path", text_with_note(F.col("result")).alias("text"), "result.reason").write.mode("overwrite").parquet(f"{path}/texts")
    done.where("not result.ok").select("path", "result.ok", "result.reason").write.mode("overwrite").json(f"{path}/failed")
