"""Merging verified details into a listing: one join for all details, whatever their number.

Hash versions differ by source, deliberately: ``RULES`` says what a merge does to the version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["source", "source_id"]
#: Versions of the hash formulas.
BODY_VERSION, WITH_FILES_VERSION = 2, 3


def version_with_hash(new: Column, digest: Column, old: Column) -> Column:
    """The new version, and none without a hash."""
    return F.when(digest.isNotNull(), F.coalesce(new, F.lit(BODY_VERSION)))


def version_always(new: Column, digest: Column, old: Column) -> Column:
    """The new version, also without a hash."""
    return F.coalesce(new, F.lit(BODY_VERSION))


def version_untouched(new: Column, digest: Column, old: Column) -> Column:
    return old


RULES = {"sbiz24": version_with_hash, "sbiz24_combine": version_with_hash, "bizinfo": version_with_hash, "fanfandaero": version_always, "seoulshinbo": version_always, "gov24": version_untouched}


def upsert(listing: DataFrame, details: DataFrame) -> DataFrame:
    """The listing with hash, version and attachments of its details.

    ``details`` has source, source_id, content_hash and, as needed, hash_version, attachments, attachments_complete, raw (merged into the row's) and namespace
    (rows of the key match only if their raw.pbancGubun is it). Its keys must be unique. Every listing row of a key is updated, all others stay as they are.
    """
    extra = {"hash_version": "int", "attachments": listing.schema["attachments"].dataType, "attachments_complete": "boolean", "raw": "map<string,string>", "namespace": "string"}
    have = set(details.columns)
    d = details.select(*KEY, F.col("content_hash").alias("d_content_hash"), *((F.col(c) if c in have else F.lit(None)).cast(t).alias(f"d_{c}") for c, t in extra.items()), F.lit(True).alias("d_found"))
    joined = listing.join(d, KEY, "left")
    space = F.col("d_namespace")
    found = F.coalesce(F.col("d_found"), F.lit(False)) & (space.isNull() | F.coalesce(F.col("raw")["pbancGubun"] == space, F.lit(False)))
    version = F.col("hash_version")
    for source, rule in RULES.items():
        version = F.when(F.col("source") == source, rule(F.col("d_hash_version"), F.col("d_content_hash"), F.col("hash_version"))).otherwise(version)
    own_raw = F.coalesce("raw", F.create_map().cast("map<string,string>"))
    more = F.coalesce("d_raw", F.create_map().cast("map<string,string>"))
    changed = {
        "content_hash": F.col("d_content_hash"),
        "hash_version": version,
        "attachments": F.coalesce("d_attachments", "attachments"),
        "attachments_complete": F.coalesce("d_attachments_complete", "attachments_complete"),
        "raw": F.map_concat(F.map_filter(own_raw, lambda k, _: ~F.map_contains_key(more, k)), more),
    }
    return joined.select(*(F.when(found, changed[c]).otherwise(F.col(c)).cast(listing.schema[c].dataType).alias(c) if c in changed else F.col(c) for c in listing.columns))


def unmatched(listing: DataFrame, details: DataFrame) -> DataFrame:
    """Details whose announcement isn't in the listing."""
    return details.join(listing.select(*KEY), KEY, "left_anti")


def enriched(listing: DataFrame, judged: DataFrame) -> DataFrame:
    """The listing with what a reader found out: primary_type, and raw (such as the terms of loans), merged into the row's.

    ``judged`` has source, source_id, primary_type, raw; its keys must be unique. What it leaves null stays as it was, and so do rows that it doesn't have.
    """
    d = judged.select(*KEY, F.col("primary_type").alias("d_type"), F.col("raw").alias("d_raw"))
    none = F.create_map().cast("map<string,string>")
    own, more = F.coalesce("raw", none), F.coalesce("d_raw", none)
    merged = F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key(more, k)), more)
    changed = {"primary_type": F.coalesce("d_type", "primary_type"), "raw": F.when(F.col("d_raw").isNull(), F.col("raw")).otherwise(merged)}
    return listing.join(d, KEY, "left").select(*(changed[c].alias(c) if c in changed else F.col(c) for c in listing.columns))


def lookup(listing: DataFrame, source: str, source_id: str) -> DataFrame:
    return listing.where((F.col("source") == source) & (F.col("source_id").cast("string") == source_id)).limit(1)


def accepted_details(listing: DataFrame, requests: DataFrame, answers: DataFrame) -> DataFrame:
    """requests (source_id) with the reason that refuses them, or null: the namespace must have details, and the answer must be of the request.

    ``answers`` has source_id (requested), returned_id and title, as the detail pages have them.
    """
    from noticeflow.functions import text as X

    rows = requests.join(listing.select("source_id", F.col("title").alias("list_title"), "raw", F.lit(True).alias("listed")), "source_id", "left").join(answers, "source_id", "left")
    space, kind = F.col("raw")["pbancGubun"], F.col("raw")["bizType"]
    reason = (
        F.when(F.col("listed").isNull(), "no listing row")
        .when(~F.coalesce(space.isin("A", "D"), F.lit(False)), "namespace without details")
        .when(kind == "대출상품", "contradictory kind")
        .when(~F.coalesce(F.col("returned_id") == F.col("source_id"), F.lit(False)), "answer of another id")
        .when(X.clean(F.col("title")) != X.clean(F.col("list_title")), "answer of another title")
    )
    return rows.select("source_id", reason.alias("refused"))
