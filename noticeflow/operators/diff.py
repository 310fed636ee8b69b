"""Comparison of two survey snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["source", "source_id"]
#: Compared fields in their order, kinds, and what a change of formula is called.
FIELDS = ("title", "status", "apply_start", "apply_end", "agency")
KINDS = ("NEW", "CHANGED", "NEEDS_REHASH", "UNCHANGED", "GONE")
FORMULA_CHANGE = "hash_version(산식 전환 — 1회 상세 재검증)"
#: Short names of sources on the command line.
ALIASES = {"fanfan": "fanfandaero", "ssb": "seoulshinbo"}


def filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def changed_fields(old: str, new: str) -> Column:
    """Names of the fields that differ, in order; null and empty are equal. Hashes count only if both exist and follow one formula.

    ``old`` and ``new`` are prefixes of column names.
    """
    plain = [F.when(~F.nullif(F.col(old + f), F.lit("")).eqNullSafe(F.nullif(F.col(new + f), F.lit(""))), f) for f in FIELDS]
    both = filled(F.col(f"{old}content_hash")) & filled(F.col(f"{new}content_hash"))
    same_formula = F.col(f"{old}hash_version").eqNullSafe(F.col(f"{new}hash_version"))
    hashes = F.when(both & same_formula & (F.col(f"{old}content_hash") != F.col(f"{new}content_hash")), "content_hash")
    found = F.array_compact(F.array(*plain, hashes))
    return F.when((F.size(found) == 0) & both & ~same_formula, F.array(F.lit(FORMULA_CHANGE))).otherwise(found)


def side(snapshot: DataFrame, prefix: str) -> DataFrame:
    """Key, compared columns, a mark that the key is there, and the whole record, which is dropped before the join where nobody asks for it."""
    compared_ = [F.col(c).alias(prefix + c) for c in (*FIELDS, "content_hash", "hash_version")]
    return snapshot.select(*KEY, *compared_, F.lit(True).alias(prefix + "found"), F.struct(*snapshot.columns).alias(prefix + "record"))


def compare(old: DataFrame, new: DataFrame, invalidate: bool = False, incremental: Sequence[str] = ()) -> DataFrame:
    """source, source_id, kind, changed_fields, record of every key of either snapshot.

    A key of the old one only is GONE if its source has been surveyed again, and not incrementally; other missing keys have no kind and no row. With
    ``invalidate`` every key of the new one is NEW. Keys must be unique in each snapshot. One shuffle of each snapshot; the sources are a handful.
    """
    surveyed = new.select("source").distinct().withColumn("surveyed", F.lit(True))
    both = side(old, "o_").join(side(new, "n_"), KEY, "full_outer").join(surveyed, "source", "left")
    before, now = F.col("o_found").isNotNull(), F.col("n_found").isNotNull()
    fresh = now & (~before | F.lit(invalidate))
    fields = F.when(now & ~fresh, changed_fields("o_", "n_")).otherwise(F.array().cast("array<string>"))
    skipped = [ALIASES.get(s, s) for s in incremental]
    gone = F.coalesce(F.col("surveyed"), F.lit(False)) & (~F.col("source").isin(*skipped) if skipped else F.lit(True))
    kind = (
        F.when(~now, F.when(gone, "GONE"))
        .when(fresh, "NEW")
        .when(F.size("fields") > 0, "CHANGED")
        .when(filled(F.col("o_content_hash")) & ~filled(F.col("n_content_hash")), "NEEDS_REHASH")
        .otherwise("UNCHANGED")
    )
    rows = both.withColumn("fields", fields).withColumn("kind", kind).where("kind is not null")
    return rows.select(*KEY, "kind", F.col("fields").alias("changed_fields"), F.coalesce("n_record", "o_record").alias("record"))


def missing_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sources of the old snapshot that the new one hasn't surveyed."""
    return old.select("source").distinct().join(new.select("source").distinct(), "source", "left_anti")


def summary(compared: DataFrame) -> DataFrame:
    """kind, n for all kinds, also those without rows."""
    zero = compared.sparkSession.createDataFrame([(k,) for k in KINDS], "kind string")
    return zero.join(compared.groupBy("kind").agg(F.count("*").alias("n")), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


def review(compared: DataFrame) -> DataFrame:
    """Rows to be looked at: kind, diff_status, changed_fields, record."""
    return written(compared.where(F.col("kind").isin("NEW", "CHANGED", "NEEDS_REHASH")))


def gone(compared: DataFrame) -> DataFrame:
    return written(compared.where("kind = 'GONE'"))


def written(rows: DataFrame) -> DataFrame:
    return rows.select("kind", F.col("kind").alias("diff_status"), "changed_fields", "record")


def carried_over(compared: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Earlier verdicts of unchanged announcements, with ``recheck`` for those that are looked at again all the same: loans and confirmed ones."""
    same = compared.where("kind = 'UNCHANGED'").select(*KEY)
    return same.join(verdicts, KEY).withColumn("recheck", F.coalesce((F.col("primary_type") == "loan") | (F.col("verdict") == "확인됨"), F.lit(False)))
