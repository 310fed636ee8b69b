"""Keep rules for repeated announcements.

Both are one aggregate, not windows: partial results are combined before the shuffle, so a key that repeats very often costs no more than another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the first row; ``order`` must be total within a key."""
    values, place = others(rows, keys), F.struct(*order)
    kept = rows.groupBy(*keys).agg(F.min_by(F.struct(*values), place).alias("__row"))
    return kept.select(*(F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in rows.columns))


def keep_last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the last row's values, at the first row's place."""
    values, place = [c for c in others(rows, keys) if c not in order], F.struct(*order)
    last = F.max_by(F.struct(*values), place) if values else F.lit(None)
    kept = rows.groupBy(*keys).agg(last.alias("__row"), F.min(place).alias("__first"))
    return kept.select(*(F.col(c) if c in keys else F.col(f"{'__first' if c in order else '__row'}.{c}").alias(c) for c in rows.columns))


def others(rows: DataFrame, keys: list[str]) -> list[str]:
    return [c for c in rows.columns if c not in keys]
