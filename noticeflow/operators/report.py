"""Manifests, rule checks and the ordered list of a survey's report. Verdicts come as a table; nothing here judges free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.functions import text as X
from noticeflow.operators import coverage as C

KEY = ["source", "source_id"]
#: The five verdicts and the order of types.
VERDICTS = ("확인됨", "조건부", "확인 필요", "신청 불가", "사업전환 후보")
CONFIRMED = VERDICTS[0]
TYPES = ("grant", "loan", "advisory")


def screening_gap(collected: DataFrame, screened: DataFrame) -> DataFrame:
    """Collected announcements that nobody has screened."""
    return collected.select(*KEY).join(screened.select(*KEY), KEY, "left_anti")


def manifest(collected: DataFrame, screened: DataFrame, outcomes: DataFrame) -> DataFrame:
    """For each source its outcome and counts: collected, screened, candidate, detail_verified. Joined by source after aggregation, so sources stay apart."""
    rows = collected.select(*KEY, "content_hash").join(screened.select(*KEY, "screening"), KEY, "left")
    counts = rows.groupBy("source").agg(
        F.count("*").alias("collected"),
        F.count("screening").alias("screened"),
        F.count_if(F.col("screening") == "candidate").alias("candidate"),
        F.count_if((F.col("screening") == "candidate") & F.col("content_hash").isNotNull()).alias("detail_verified"),
    )
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("collected", "screened", "candidate", "detail_verified")]
    status = F.when(F.coalesce("screened", F.lit(0)) == F.coalesce("collected", F.lit(0)), C.SUCCESS).otherwise(C.PARTIAL)
    return outcomes.join(counts, "source", "full_outer").select("source", F.coalesce("collection_status", F.lit(C.FAILED)).alias("collection_status"), status.alias("screening_status"), *filled)


def manifest_errors(manifest_: DataFrame) -> DataFrame:
    """Rows whose counts can't be right or whose statuses are unknown, and partial sources that claim to be complete."""
    known = [C.SUCCESS, C.PARTIAL, C.FAILED, C.MANUAL]
    bad = (F.col("screened") > F.col("collected")) | (F.col("candidate") > F.col("screened")) | (F.col("detail_verified") > F.col("candidate"))
    bad = bad | ((F.col("screened") < F.col("collected")) & (F.col("screening_status") == C.SUCCESS))
    return manifest_.where(bad | ~F.coalesce(F.col("collection_status").isin(known) & F.col("screening_status").isin(known), F.lit(False)))


def verdict_errors(announcements: DataFrame, verdicts: DataFrame) -> DataFrame:
    """source, source_id, rule: verdicts that break a rule. One row for each rule broken."""
    once = verdicts.groupBy(*KEY).agg(F.count("*").alias("times"), F.min("verdict").alias("verdict"))
    rows = once.join(announcements.select(*KEY, "status", "attachments_complete", "primary_type", "raw"), KEY, "left")
    loan_fields = [F.coalesce(F.col("raw")[k], F.lit("")) == "" for k in ("loan_limit", "loan_rate", "loan_term", "loan_office")]
    some_missing = loan_fields[0]
    for c in loan_fields[1:]:
        some_missing = some_missing | c
    rules = {
        "one verdict": F.col("times") != 1,
        "known verdict": ~F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False)),
        "unread attachment": (F.col("verdict") == CONFIRMED) & ~F.coalesce("attachments_complete", F.lit(False)),
        "unknown status": (F.col("verdict") == CONFIRMED) & (F.col("status") == X.UNKNOWN),
        "loan terms": (F.col("primary_type") == "loan") & some_missing,
    }
    broken = F.array_compact(F.array(*(F.when(condition, F.lit(name)) for name, condition in rules.items())))
    return rows.select(*KEY, F.explode(broken).alias("rule"))


def status_rank() -> Column:
    """Dated announcements come first, then those until the money is spent, always open ones, and planned rounds."""
    return F.when(F.col("end_date").isNotNull(), 0).when(F.col("status") == X.SPENT, 1).when(F.col("status") == X.ALWAYS, 2).when(F.col("status") == X.PLANNED, 3).otherwise(4)


def type_rank() -> Column:
    rank = F.lit(len(TYPES))
    for i, name in enumerate(TYPES):
        rank = F.when(F.col("primary_type") == name, i).otherwise(rank)
    return rank


def verdict_rank() -> Column:
    rank = F.lit(len(VERDICTS))
    for i, name in enumerate(VERDICTS):
        rank = F.when(F.col("verdict") == name, i).otherwise(rank)
    return rank


def ordered_by_type(judged: DataFrame) -> DataFrame:
    """Announcements with their verdicts in sections by type, inside by verdict, in the order of TYPES and VERDICTS; others come last."""
    return judged.orderBy(type_rank(), verdict_rank(), "source", "source_id")


def deadline_list(announcements: DataFrame, as_of: Column, conditions: str | None = None) -> DataFrame:
    """Announcements with days_left, section and the columns of their order; sort by section, rank, end_date, source, source_id.

    Always-open services of the open API have a section of their own. Rows with exactly one condition left (a count column) are a section of their own too.
    """
    rows = announcements.withColumn("end_date", X.as_date(F.col("apply_end")))
    service = (F.col("source") == "gov24") & (F.col("status") == X.ALWAYS)
    section = F.when(service, "services")
    if conditions:
        section = section.when(F.col(conditions) == 1, "conditional")
    return rows.withColumn("section", section.otherwise("deadlines")).withColumn("rank", status_rank()).withColumn("days_left", F.datediff("end_date", as_of))


def ordered(listed: DataFrame) -> DataFrame:
    return listed.orderBy("section", "rank", F.col("end_date").asc_nulls_last(), "source", "source_id")


def needs_detail(announcements: DataFrame) -> DataFrame:
    """Announcements whose status only a detail page can tell."""
    return announcements.where(F.col("status") == X.UNKNOWN)


def small_business_status(certificate: Column, statutory_average: Column, headcount: Column, recent_only: Column) -> Column:
    """Legal status by what is known: a valid certificate, else the statutory average with headcount, else a proxy that must be checked."""
    return F.when(certificate, "confirmed").when(statutory_average & headcount, "confirmed").when(recent_only, "needs_check").otherwise("unknown")


def sources_for(province: Column, registry: DataFrame) -> DataFrame:
    """The registry's rows (province, source, automatic) for a profile's province."""
    return registry.where(F.col("province") == province)


def type_counts(announcements: DataFrame, verdicts: DataFrame) -> DataFrame:
    return announcements.join(verdicts.select(*KEY, "verdict"), KEY).groupBy("primary_type", "verdict").agg(F.count("*").alias("n"))
