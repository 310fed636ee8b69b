"""Announcements of one programme in several sources. They are grouped and never deleted: which one stands for the group is for a reader to decide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.functions import text as X
from noticeflow.operators.components import groups_by_keys

KEY = ["source", "source_id"]


def match_keys(announcements: DataFrame) -> DataFrame:
    """row and the keys by which announcements are the same: agency and number; address, or the portal's number wherever it stands; title, agency and period."""
    filled = lambda c: X.empty_to_null(X.squeeze(F.col(c)))
    all_of = lambda *cs: F.when(F.array_contains(F.transform(F.array(*cs), lambda c: c.isNull()), True), None).otherwise(F.to_json(F.array(*cs)))
    number = F.coalesce(*(X.empty_to_null(F.regexp_extract(c, r"(PBLN_\d+)", 1)) for c in ("source_id", "announce_no", "canonical_url")))
    return announcements.select(
        F.to_json(F.array(*KEY)).alias("row"),
        all_of(filled("agency"), filled("announce_no")).alias("by_number"),
        F.coalesce(number, filled("canonical_url")).alias("by_address"),
        all_of(filled("title"), filled("agency"), filled("apply_start"), filled("apply_end")).alias("by_content"),
    )


def same_programmes(announcements: DataFrame) -> DataFrame:
    """source, source_id, programme (the smallest row of the group) and size of the group."""
    groups = groups_by_keys(match_keys(announcements), "row", ["by_number", "by_address", "by_content"])
    sizes = groups.groupBy("component").agg(F.count("*").alias("size"))
    parts = F.from_json("row", "array<string>")
    return groups.join(sizes, "component").select(parts[0].alias("source"), parts[1].alias("source_id"), F.col("component").alias("programme"), "size")
