"""How complete a collection is: rows announced, received, unique and missing, and what follows for each kind of listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The outcomes of a collection and their exit codes.
SUCCESS, PARTIAL, FAILED, MANUAL, INACTIVE = "success", "partial", "failed", "manual", "inactive"
EXIT = {SUCCESS: 0, PARTIAL: 2, FAILED: 2, MANUAL: 3, INACTIVE: 4}


def counted(rows: DataFrame, group: list[str], key: str) -> DataFrame:
    """fetched, collected (distinct keys) and duplicates of each group."""
    counts = rows.groupBy(*group).agg(F.count("*").alias("fetched"), F.countDistinct(key).alias("collected"))
    return counts.withColumn("duplicates", F.col("fetched") - F.col("collected"))


def chain(*cases: tuple[Column, str]) -> Column:
    """The outcome of the first case that holds, else success; an unknown condition doesn't hold."""
    out = F.lit(SUCCESS)
    for condition, outcome in reversed(cases):
        out = F.when(F.coalesce(condition, F.lit(False)), outcome).otherwise(out)
    return out


def list_outcome(total: Column, fetched: Column, collected: Column, capped: bool = False) -> Column:
    """Lists that announce their rows: nothing is a failure; too few received is partial, and so are duplicates that may hide missing rows."""
    full = [] if capped else [(fetched < total, PARTIAL), ((fetched > collected) & (collected < total), PARTIAL)]
    return chain((F.coalesce(total == 0, F.lit(True)) | (collected == 0), FAILED), *full)


def or_manual(blocked: Column, outcome: Column) -> Column:
    """A page that withholds its content asks for a look by hand, whatever else was collected."""
    return F.when(F.coalesce(blocked, F.lit(False)), MANUAL).otherwise(outcome)


def worst(coverage: DataFrame) -> DataFrame:
    """outcome, exit_code of several collections as one: the first of failed, manual, partial and inactive that one of them has, else success."""
    order = [FAILED, MANUAL, PARTIAL, INACTIVE, SUCCESS]
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("outcome"))
    row = coverage.agg(F.element_at(F.array(*map(F.lit, order)), F.coalesce(F.min(rank), F.lit(1)).cast("int")).alias("outcome"))
    return row.withColumn("exit_code", exit_code(F.col("outcome")))


def portal_outcome(expected_pages: Column, pages: Column, expected: Column, collected: Column, capped: bool = False) -> Column:
    """The portal's table: all pages and exactly the announced number; an unknown number is never complete."""
    full = [] if capped else [(pages < expected_pages, PARTIAL), (collected != expected, PARTIAL), (expected.isNull(), PARTIAL)]
    return chain((F.coalesce(expected_pages == 0, F.lit(True)) | (collected == 0), FAILED), *full)


def board_outcome(total: Column, collected: Column, first_page_rows: Column, interrupted: Column, since: str | None = None, capped: bool = False) -> Column:
    """A board that announces its posts; the number counts only if no cutoff or cap ended the collection."""
    full = [] if since or capped else [(collected < total, PARTIAL)]
    return chain((F.coalesce(first_page_rows == 0, F.lit(True)), PARTIAL), (interrupted, PARTIAL), *full)


def thin_outcome(thin: Column, first_page_rows: Column, interrupted: Column) -> Column:
    """A board that announces nothing: pages with too few rows show that rows were missed."""
    return chain((F.coalesce(first_page_rows == 0, F.lit(True)), FAILED), (interrupted | (thin > 0), PARTIAL))


def api_outcome(total: Column, fetched: Column, collected: Column, first_page_rows: Column, first_row_known: Column, filtered: bool = False, capped: bool = False) -> Column:
    """The open API: received rows count before any filter, unique ones only without a filter."""
    full = [] if capped else [(fetched < total, PARTIAL)] + ([] if filtered else [(collected < total, PARTIAL)])
    return chain((total.isNull() | (total == 0), FAILED), (first_page_rows == 0, FAILED), (~first_row_known, FAILED), *full)


def exit_code(outcome: Column) -> Column:
    code = F.lit(None).cast("int")
    for name, n in EXIT.items():
        code = F.when(outcome == name, n).otherwise(code)
    return code
