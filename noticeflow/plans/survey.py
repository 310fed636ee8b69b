"""End-to-end plans: landed pages to listings with their coverage, details to merged listings, and two snapshots to a diff.

Pages are a folder's path, or a frame as the readers of ``sources.listings`` give it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow import schema as S
from noticeflow.functions import identity, links, urls
from noticeflow.functions import pages as P
from noticeflow.functions import text as X
from noticeflow.operators import coverage as C
from noticeflow.operators import dedup, diff, paging
from noticeflow.operators.upsert import WITH_FILES_VERSION, BODY_VERSION, upsert
from noticeflow.sources import listings as L
from noticeflow.sources import snapshots
from noticeflow.sources.attachments import complete
from noticeflow.storage import materialise

KEY = ["source", "source_id"]
ORDER = ["page", "pos"]


@dataclass
class Listing:
    """Announcements of one source (with page and pos) and its coverage: one row with counts and outcome."""

    rows: DataFrame
    coverage: DataFrame


def outcome_row(spark: SparkSession, source: str, **values) -> DataFrame:
    """source, outcome and exit_code from counts; ``outcome`` is a function of the counts as columns."""
    outcome = values.pop("outcome")
    row = spark.range(1).select(F.lit(source).alias("source"), *(F.lit(v).cast("boolean" if isinstance(v, bool) else "long").alias(k) for k, v in values.items()))
    row = row.withColumn("outcome", outcome)
    return row.withColumn("exit_code", C.exit_code(F.col("outcome")))


def json_pages(spark: SparkSession, pages: DataFrame | str, schema) -> DataFrame:
    return L.read_json_pages(spark, pages, schema) if isinstance(pages, str) else pages


def html_pages(spark: SparkSession, pages: DataFrame | str) -> tuple[DataFrame, bool, int | None]:
    """Pages up to the first that withholds its content, whether there is one (what follows it was never asked for), and the number of the first page."""
    pages = L.read_html_pages(spark, pages) if isinstance(pages, str) else pages
    found = pages.agg(F.min(F.when(X.blocked_page(F.col("body")), F.col("page"))).alias("blocked"), F.min("page").alias("first")).first()
    return (pages, False, found.first) if found.blocked is None else (pages.where(F.col("page") < F.lit(found.blocked)), True, found.first)


def first_page_rows(pages: DataFrame, rows: DataFrame) -> int:
    """How many rows the first landed page gave; none at all is a sign that the site has changed."""
    first = pages.agg(F.min("page")).first()[0]
    return rows.where(F.col("page") == F.lit(first)).count()


def capped(rows: DataFrame, max_pages: int | None) -> DataFrame:
    """The first pages of a listing, whatever numbers they have."""
    if not max_pages:
        return rows
    last = rows.select("page").distinct().orderBy("page").limit(max_pages).agg(F.max("page")).first()[0]
    return rows.where(F.col("page") <= F.lit(last))


def sbiz(spark: SparkSession, path: DataFrame | str, mode: str, as_of: Column, crawled_at: Column, max_pages: int | None = None) -> Listing:
    """The JSON list in one mode: repeated rows keep the first; the announced total is the first page's."""
    pages = capped(json_pages(spark, path, S.LIST_PAGE), max_pages)
    rows = materialise(L.sbiz_notices(pages, mode, as_of, crawled_at), "rows")
    counts = rows.agg(F.count("*").alias("fetched"), F.countDistinct("source_id").alias("collected")).first()
    total = pages.agg(F.min_by("data.default.total", "page")).first()[0]
    cover = outcome_row(spark, mode, total=total, fetched=counts.fetched, collected=counts.collected, duplicates=counts.fetched - counts.collected, outcome=C.list_outcome(F.col("total"), F.col("fetched"), F.col("collected"), bool(max_pages)))
    return Listing(dedup.keep_first(rows, KEY, ORDER), cover)


def sbiz_all(spark: SparkSession, pbanc: DataFrame | str, combine: DataFrame | str, as_of: Column, crawled_at: Column, max_pages: int | None = None) -> Listing:
    """Both modes in one listing; its coverage has a row for each mode, and coverage.worst() is the outcome of both."""
    modes = [sbiz(spark, pbanc, "pbanc", as_of, crawled_at, max_pages), sbiz(spark, combine, "combine", as_of, crawled_at, max_pages)]
    return Listing(modes[0].rows.unionByName(modes[1].rows), modes[0].coverage.unionByName(modes[1].coverage))


def bizinfo(spark: SparkSession, path: DataFrame | str, as_of: Column, crawled_at: Column, max_pages: int | None = None) -> Listing:
    """The portal's table: repeated rows keep the last values, and pages count up to the first without a new row."""
    pages, blocked, first_page = html_pages(spark, path)  # only the first page is searched for counts
    counts_of = pages.where(F.col("page") == F.lit(first_page)).select("page", P.last_page(F.col("body")).alias("last"), P.announced_total(F.col("body")).alias("total"))
    first = counts_of.agg(F.min_by(F.struct("last", "total"), "page").alias("f")).first().f
    rows = materialise(L.bizinfo_notices(pages, as_of, crawled_at), "rows")
    cap = min(first.last, max_pages) if max_pages and first else max_pages
    kept = paging.until_stop(rows, ["source_id"], max_pages=cap)
    counts = kept.agg(F.countDistinct("source_id").alias("collected"), F.countDistinct("page").alias("pages")).first()
    outcome = C.portal_outcome(F.col("expected_pages"), F.col("pages"), F.col("expected"), F.col("collected"), bool(max_pages and first and cap < first.last))
    outcome = C.or_manual(F.lit(blocked), outcome)
    cover = outcome_row(spark, "bizinfo", expected_pages=first and first.last, pages=counts.pages, expected=first and first.total, collected=counts.collected, outcome=outcome)
    return Listing(dedup.keep_last(kept, KEY, ORDER), cover)


def fanfan(spark: SparkSession, programmes: DataFrame | str, board: DataFrame | str, as_of: Column, crawled_at: Column, since: str | None = None, max_pages: int | None = None) -> Listing:
    """Programmes of all years and the notice board; the board may end at a cutoff date."""
    yearly = L.fanfan_notices(json_pages(spark, programmes, S.YEAR_PAGE), as_of, crawled_at)
    # The first answer repeats within itself keep the last, later years don't replace what is there.
    first_page = yearly.agg(F.min("page")).first()[0]
    own = dedup.keep_last(yearly.where(F.col("page") == F.lit(first_page)), KEY, ORDER)
    years = dedup.keep_first(own.unionByName(yearly.where(F.col("page") > F.lit(first_page))), KEY, ORDER)
    pages, blocked, _ = html_pages(spark, board)
    posts = materialise(L.fanfan_board(pages, crawled_at), "posts")
    kept = dedup.keep_first(paging.until_stop(posts, ["source_id"], F.col("raw")["posted"], since, max_pages), KEY, ORDER)
    total = pages.agg(F.min_by(P.board_total(F.col("body")), "page")).first()[0]
    outcome = C.or_manual(F.lit(blocked), C.board_outcome(F.col("total"), F.col("collected"), F.col("first_rows"), F.lit(False), since, bool(max_pages)))
    cover = outcome_row(spark, "fanfandaero", total=total, collected=kept.count(), first_rows=first_page_rows(pages, posts), outcome=outcome)
    return Listing(years.unionByName(kept), cover)


def ssb(spark: SparkSession, board: DataFrame | str, crawled_at: Column, since: str | None = None, max_pages: int | None = None, expected: int = 10) -> Listing:
    pages, blocked, _ = html_pages(spark, board)
    posts = materialise(L.ssb_board(pages, crawled_at), "posts")
    kept = paging.until_stop(posts, ["source_id"], F.col("raw")["posted"], since, max_pages)
    facts = paging.page_facts(kept, ["source_id"])
    thin, rows = paging.thin_pages(facts, expected).count(), dedup.keep_first(kept, KEY, ORDER)
    outcome = C.or_manual(F.lit(blocked), C.thin_outcome(F.col("thin"), F.col("first_rows"), F.lit(False)))
    cover = outcome_row(spark, "seoulshinbo", thin=thin, first_rows=first_page_rows(pages, posts), collected=rows.count(), outcome=outcome)
    return Listing(rows, cover)


def gov24(spark: SparkSession, path: DataFrame | str, as_of: Column, crawled_at: Column, needle: str | None = None, max_pages: int | None = None) -> Listing:
    """The open API: filtered first, then repeated rows keep the last values; coverage counts what came before the filter.

    The source needs a key, so a survey without one has no answers: it is inactive, not failed.
    """
    pages = capped(json_pages(spark, path, S.API_PAGE), max_pages)
    rows = L.gov24_services(pages, as_of, crawled_at, needle)
    kept = dedup.keep_last(rows, KEY, ORDER)
    known = L.gov24_services(pages, as_of, crawled_at).where("pos = 0").agg(F.min("page")).first()[0]
    facts = pages.agg(F.min("page").alias("first"), F.sum(F.size("data")).alias("fetched"), F.min_by("totalCount", "page").alias("total"), F.min_by(F.size("data"), "page").alias("first_rows")).first()
    outcome = C.api_outcome(F.col("total"), F.col("fetched"), F.col("collected"), F.col("first_rows"), F.col("known"), bool(needle), bool(max_pages))
    outcome = F.lit(C.INACTIVE) if facts.first is None else outcome
    cover = outcome_row(spark, "gov24", total=facts.total, fetched=facts.fetched, collected=kept.count(), first_rows=facts.first_rows, known=bool(known is not None and known == facts.first), outcome=outcome)
    return Listing(kept, cover)


def portal_details(pages: DataFrame) -> DataFrame:
    """Details of the portal's pages (source_id, body): pages that aren't of the requested announcement are refused, with attachments as links."""
    own = identity.is_page_of(F.col("body"), "bizinfo", F.col("source_id"))
    found = P.portal_links(F.col("body"), L.BIZINFO)
    text = P.portal_body(F.col("body"))
    rows = pages.select("source_id", own.alias("accepted"), text.alias("text"), found.alias("links"))
    return rows.select(F.lit("bizinfo").alias("source"), "source_id", "accepted", "text", "links", X.body_hash(F.col("text")).alias("content_hash"), F.lit(BODY_VERSION).alias("hash_version"), (F.size("links") == 0).alias("attachments_complete"))


def board_details(pages: DataFrame, source: str) -> DataFrame:
    """As portal_details(), for a board; ids are compared by their number."""
    number = F.regexp_extract("source_id", r"^\w+-0*(\d+)$", 1)
    own = identity.is_page_of(F.col("body"), source, number)
    rows = pages.select("source_id", own.alias("accepted"), P.board_body(F.col("body"), source).alias("text"), links.board_links(F.col("body"), source, number).alias("links"))
    return rows.select(F.lit(source).alias("source"), "source_id", "accepted", "text", "links", (F.size("links") == 0).alias("attachments_complete"), X.body_hash(F.col("text")).alias("content_hash"), F.lit(BODY_VERSION).alias("hash_version"))


def with_attachments(details: DataFrame, attachments: DataFrame, portal: bool = True) -> DataFrame:
    """Details with their attachments (source_id, attachment struct and, if known, pos), in order of pos: complete ones get the hash of body and files.

    Incomplete ones keep the hash of the body alone if ``portal``, and lose it otherwise, where the formula always covers the files.
    """
    files = attachments.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(*(c for c in ("pos", "attachment") if c in attachments.columns)))), lambda x: x["attachment"]).alias("attachments"))
    rows = details.drop("attachments", "attachments_complete").join(files, "source_id", "left")
    rows = rows.withColumn("attachments", F.coalesce("attachments", F.array().cast(files.schema["attachments"].dataType))).withColumn("attachments_complete", complete(F.col("attachments")))
    hashes = F.array_compact(F.transform("attachments", lambda a: a["sha256"]))
    whole = X.body_and_files_hash(F.col("text"), hashes)
    if portal:
        both = F.col("attachments_complete") & (F.size("attachments") > 0)
        return rows.withColumn("content_hash", F.when(both, whole).otherwise(F.col("content_hash"))).withColumn("hash_version", F.when(both, WITH_FILES_VERSION).otherwise(F.col("hash_version")))
    return rows.withColumn("content_hash", F.when(F.col("attachments_complete"), whole))


def merge(listing: DataFrame, details: DataFrame) -> DataFrame:
    """The listing with its accepted details."""
    return upsert(listing, details.where("accepted"))


def compare_surveys(spark: SparkSession, old: str, new: str, old_profile: str | None = None, new_profile: str | None = None, incremental: Sequence[str] = ()) -> DataFrame:
    """The diff of two snapshot folders; profiles are given as texts."""
    before, after = (snapshots.checked(materialise(snapshots.read_snapshot(spark, path), "snapshot")) for path in (old, new))  # parsed once
    if after.isEmpty():
        raise snapshots.SnapshotError("the new snapshot is empty")
    return diff.compare(before, after, snapshots.carry_over_invalid(old_profile, new_profile), incremental)


def allowed_details(requests: DataFrame, url: str, domains: Sequence[str], disallowed: Sequence[str] = ()) -> DataFrame:
    """Requests whose address may be fetched: https, on an allowed host, on no disallowed path."""
    return requests.where(urls.host_allowed(F.col(url), domains) & urls.robots_allowed(F.col(url), disallowed))
