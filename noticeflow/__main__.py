"""Command line: collect a landed listing, compare two surveys, or extract attachments.

    python -m noticeflow list SOURCE LANDED... --out PATH --as-of DATE [--since DATE] [--max-pages N] [--filter-target WORD]
    python -m noticeflow detail SOURCE LISTING PAGES --out PATH
    python -m noticeflow diff OLD NEW --out PATH [--old-profile FILE] [--new-profile FILE] [--incremental-sources A,B]
    python -m noticeflow extract FILES --out PATH

Exit codes: 0 success, 1 unusable snapshots, 2 partial or failed, 3 withheld by the site, 4 inactive.
"""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timedelta, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from noticeflow import session
from noticeflow.functions.text import blocked_page
from noticeflow.operators import coverage, upsert
from noticeflow.plans import survey
from noticeflow.schema import ANNOUNCEMENT
from noticeflow.sources import attachments, sinks
from noticeflow.sources.snapshots import SnapshotError
from noticeflow.storage import materialise

KST = timezone(timedelta(hours=9))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="noticeflow", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)
    one = commands.add_parser("list")
    one.add_argument("source", choices=["pbanc", "combine", "all", "bizinfo", "fanfandaero", "seoulshinbo", "gov24"])
    one.add_argument("landed", nargs="+", help="folders of landed pages; all: pbanc, then combine; fanfandaero: programmes, then board")
    one.add_argument("--as-of", default=datetime.now(KST).date().isoformat())
    one.add_argument("--since")
    one.add_argument("--max-pages", type=int)
    one.add_argument("--filter-target")
    two = commands.add_parser("diff")
    two.add_argument("old")
    two.add_argument("new")
    two.add_argument("--old-profile")
    two.add_argument("--new-profile")
    two.add_argument("--incremental-sources", default="")
    three = commands.add_parser("extract")
    three.add_argument("files")
    four = commands.add_parser("detail")
    four.add_argument("source", choices=["bizinfo", "fanfandaero", "seoulshinbo"])
    four.add_argument("listing", help="announcements as list writes them")
    four.add_argument("pages", help="folder of landed detail pages, each named by its announcement's id")
    for command in (one, two, three, four):
        command.add_argument("--out", required=True)
    return top


def collect(spark: SparkSession, a: argparse.Namespace) -> int:
    day, now = F.lit(a.as_of).cast("date"), F.lit(datetime.now(KST).strftime("%Y-%m-%dT%H:%M:%S+09:00"))
    made = {
        "pbanc": lambda: survey.sbiz(spark, a.landed[0], "pbanc", day, now, a.max_pages),
        "combine": lambda: survey.sbiz(spark, a.landed[0], "combine", day, now, a.max_pages),
        "all": lambda: survey.sbiz_all(spark, a.landed[0], a.landed[-1], day, now, a.max_pages),
        "bizinfo": lambda: survey.bizinfo(spark, a.landed[0], day, now, a.max_pages),
        "fanfandaero": lambda: survey.fanfan(spark, a.landed[0], a.landed[-1], day, now, a.since, a.max_pages),
        "seoulshinbo": lambda: survey.ssb(spark, a.landed[0], now, a.since, a.max_pages),
        "gov24": lambda: survey.gov24(spark, a.landed[0], day, now, a.filter_target, a.max_pages),
    }[a.source]()
    sinks.write_announcements(made.rows, a.out)
    for found in made.coverage.collect():  # a row for each mode or source
        print(" ".join(f"{k.upper()} {v}" for k, v in found.asDict().items()), file=sys.stderr)
    return coverage.worst(made.coverage).first().exit_code


def detail(spark: SparkSession, a: argparse.Namespace) -> int:
    """Merge landed detail pages into a listing. Pages that withhold their content ask for a look by hand; refused pages leave their announcement as it was."""
    listing = spark.read.schema(ANNOUNCEMENT).json(a.listing)
    name = F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "")
    pages = materialise(spark.read.text(a.pages, wholetext=True).select(name.alias("source_id"), F.col("value").alias("body")), "pages")
    blocked = blocked_page(F.col("body"))
    shown = pages.where(~blocked)
    details = materialise(survey.portal_details(shown) if a.source == "bizinfo" else survey.board_details(shown, a.source), "details")
    survey.merge(listing, details).write.mode("overwrite").json(a.out)
    counts = details.agg(F.count("*").alias("pages"), F.count_if("accepted").alias("accepted")).first()
    lost = upsert.unmatched(listing, details).count()
    withheld = pages.where(blocked).count()
    print(f"PAGES {counts.pages} ACCEPTED {counts.accepted} NOT_FOUND {lost} WITHHELD {withheld}", file=sys.stderr)
    return 3 if withheld else 2 if counts.accepted < counts.pages or lost else 0


def compare(spark: SparkSession, a: argparse.Namespace) -> int:
    profiles = [open(p, encoding="utf-8").read() if p else None for p in (a.old_profile, a.new_profile)]
    try:
        compared = survey.compare_surveys(spark, a.old, a.new, *profiles, incremental=[s.strip() for s in a.incremental_sources.split(",") if s.strip()])
    except SnapshotError as e:
        print(f"ERROR {e}", file=sys.stderr)
        return 1
    print("SUMMARY " + " ".join(f"{r.kind} {r.n}" for r in sinks.write_diff(compared, a.out).collect()), file=sys.stderr)
    return 0


def extract(spark: SparkSession, a: argparse.Namespace) -> int:
    files = attachments.read_files(spark, a.files)
    results = files.select("path", attachments.extracted(F.col("name"), F.col("content")).alias("result"))
    sinks.write_extracted(results, a.out)
    return 2 if not spark.read.schema("path string, ok boolean, reason string").json(f"{a.out}/failed").isEmpty() else 0


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    return {"list": collect, "detail": detail, "diff": compare, "extract": extract}[a.command](spark or session.build(), a)


if __name__ == "__main__":
    sys.exit(main())
