"""Which pages of a listing count: stop rules as predicates on page numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DATE = r"^\d{4}-\d{2}-\d{2}$"


def page_facts(rows: DataFrame, keys: list[str], posted: Column | None = None, since: str | None = None) -> DataFrame:
    """page, parsed, fresh (rows of keys that no earlier page has), old (whether all fresh rows were posted before ``since``).

    One posted date that can't be read makes ``old`` false for its page: it can't be known then.
    """
    posted = F.lit(None).cast("string") if posted is None else posted
    early = F.coalesce(posted.rlike(DATE) & (posted < F.lit(since)), F.lit(False))
    first = rows.select("page", *keys, early.alias("early")).groupBy(*keys).agg(F.min(F.struct("page", "early")).alias("f"))
    fresh = first.groupBy(F.col("f.page").alias("page")).agg(F.count("*").alias("fresh"), F.every(F.col("f.early")).alias("old"))
    parsed = rows.groupBy("page").agg(F.count("*").alias("parsed"))
    return parsed.join(fresh, "page", "left").select("page", "parsed", F.coalesce("fresh", F.lit(0)).alias("fresh"), F.coalesce("old", F.lit(False)).alias("old"))


def last_page_that_counts(facts: DataFrame, max_pages: int | None = None) -> int | None:
    """The page after which a listing ends: the first without a fresh row, or of old rows only, or the cap; None if there is none."""
    stop = facts.where("fresh = 0 or old").agg(F.min("page")).first()[0]
    stops = [p for p in (stop, max_pages) if p is not None]
    return min(stops) if stops else None


def until_stop(rows: DataFrame, keys: list[str], posted: Column | None = None, since: str | None = None, max_pages: int | None = None) -> DataFrame:
    """The rows of pages up to the stop. Older rows of those pages stay."""
    stop = last_page_that_counts(page_facts(rows, keys, posted, since), max_pages)
    return rows if stop is None else rows.where(F.col("page") <= stop)


def thin_pages(facts: DataFrame, expected: int) -> DataFrame:
    """Pages, but for the last, with less than half of the expected rows."""
    last = facts.agg(F.max("page")).first()[0]
    return facts.where((F.col("page") < F.lit(last)) & (F.col("parsed") < F.lit(expected / 2)))
