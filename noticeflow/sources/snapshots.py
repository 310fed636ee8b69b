"""Survey snapshots: directories of JSON-lines files, and the profile that verdicts depend on."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.schema import ANNOUNCEMENT

#: Working files that a survey folder may hold besides the collected ones, and the profile fields that verdicts depend on.
SKIP_FILES = ("screening.jsonl", "new_items.jsonl")
SKIP_PREFIXES = ("screen", "verdicts", "judge_input", "merged", "new_items")
PROFILE_FIELDS = (
    "entity_type", "business_status", "closure_date", "industry_text", "industry_code_candidates", "employee_count_as_of", "sales_period",
    "registration_date", "regular_employee_count", "headcount", "sbiz_certificate", "sbiz_certificate_valid_until", "sales_band", "sales_basis",
    "sales_vs_industry_threshold", "threshold_industry_code", "sales_threshold_as_of", "province", "district", "hq_district", "owner_age_band",
    "owner_gender", "needs",
)


class SnapshotError(ValueError):
    """A snapshot that must not be compared."""


def collected_file(name: Column) -> Column:
    """Whether a file name is that of collected rows."""
    other = name.isin(*SKIP_FILES)
    for prefix in SKIP_PREFIXES:
        other = other | name.startswith(prefix)
    return ~other


def read_snapshot(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """Announcements of all collected files of a folder. Rows of diff results and of screening files are left out."""
    extra = T.StructType([*ANNOUNCEMENT.fields, T.StructField("kind", T.StringType()), T.StructField("record", T.StringType()), T.StructField("screening", T.StringType())])
    rows = spark.read.schema(extra).json(f"{path}/{pattern}").where(collected_file(F.col("_metadata.file_name")))
    rows = rows.where(~(F.col("kind").isNotNull() & F.col("record").isNotNull()) & ~(F.col("screening").isNotNull() & F.col("title").isNull()))
    return rows.select(*ANNOUNCEMENT.names)


def violations(snapshot: DataFrame) -> DataFrame:
    """(source, source_id, problem, n): rows without a key and keys that occur more than once. One pre-aggregated pass."""
    key = F.coalesce("source_id", F.lit(""))
    missing = (F.coalesce("source", F.lit("")) == "") | key.isin("", "None")
    counted = snapshot.groupBy("source", "source_id", missing.alias("missing")).agg(F.count("*").alias("n"))
    return counted.where("missing or n > 1").select("source", "source_id", F.when(F.col("missing"), "missing key").otherwise("repeated key").alias("problem"), "n")


def checked(snapshot: DataFrame) -> DataFrame:
    """The snapshot itself, if its keys are complete and unique; else an error."""
    found = violations(snapshot).take(5)
    if found:
        raise SnapshotError("; ".join(f"{r.problem}: {r.source}/{r.source_id}" for r in found))
    return snapshot


def parse_profile(text: str) -> dict[str, str]:
    """Front matter as flat fields: values end at '#', and continuation lines are joined by ' | '."""
    if not text.startswith("---"):
        return {}
    fields: dict[str, str] = {}
    name = None
    for line in text.split("---", 2)[1].splitlines():
        own = re.match(r"(?![ \-#])([^:]*):(.*)", line)
        if own:
            name = own[1].strip()
            fields[name] = own[2].split("#")[0].strip()
        elif name and line[:1] in (" ", "-") and (more := line.strip().split("#")[0].strip()):
            fields[name] = f"{fields[name]} | {more}".strip(" |")
    return fields


def fingerprint(fields: dict[str, str]) -> str:
    known = {k: fields.get(k) for k in PROFILE_FIELDS}
    return hashlib.sha256(json.dumps(known, ensure_ascii=False, sort_keys=True).encode()).hexdigest()[:16]


def carry_over_invalid(old_profile: str | None, new_profile: str | None) -> bool:
    """Whether earlier verdicts stop being valid: one profile only, one without fields that matter, or different ones. None at all: they stay valid."""
    if (old_profile is None) != (new_profile is None):
        return True
    if old_profile is None:
        return False
    old, new = parse_profile(old_profile), parse_profile(new_profile)
    return not any(map(old.get, PROFILE_FIELDS)) or not any(map(new.get, PROFILE_FIELDS)) or fingerprint(old) != fingerprint(new)
