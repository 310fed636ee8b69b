"""Parts of HTML pages: bodies, counts, page numbers and attachment links, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeflow.functions import text as X

#: Where bodies begin and end, by site. The first start pattern that occurs counts, and the earliest end after it.
PORTAL_STARTS = (r'<div[^>]+class="[^"]*view_cont[^"]*"', r'<div[^>]+id="print_area"')
PORTAL_ENDS = (r'<div[^>]+id="footer"', r"<footer\b", r'<div[^>]+class="[^"]*footer', r'<div[^>]+class="[^"]*btn_area', r'<div[^>]+class="[^"]*paging', "목록으로|이전글|다음글")
BOARD_STARTS = {"fanfandaero": r'<div[^>]+class="[^"]*contents[^"]*"', "seoulshinbo": r'<div[^>]+class="[^"]*sub_cont_wrap[^"]*"'}
BOARD_ENDS = (r'<div[^>]+id="footer"', r"<footer\b", r'<div[^>]+class="[^"]*footer', "다음글|이전글")

#: Labels and view counts in a board's body; how listings give counts, page links, totals and files.
LABEL, VIEWS = "^(?:조회수?|등록일|작성일)$", r"(?U)^\d{1,7}$"
WHOLE_TAB = (r'분야\((\d[\d,]*)\) 공고보기"[^>]{0,120}id="hashAll"', r'id="hashAll"[^>]{0,200}?분야\((\d[\d,]*)\)')
ANY_TAB = r"분야\((\d[\d,]*)\) 공고보기"
LINKED_PAGE = r"cpage=(\d+)"
BOARD_TOTAL = r'totalRecordCount\s*=\s*"(\d+)"'
PORTAL_FILE = 'href="(/cmm/fms/[^"]+|/uploads/[^"]+)"'


def places(c: Column, patterns: Sequence[str]) -> Column:
    """Positions, from 1, of those patterns that occur, in their order."""
    return F.filter(F.array(*(F.regexp_instr(c, F.lit(p)) for p in patterns)), lambda at: at > 0)


def slice_between(c: Column, starts: Sequence[str], ends: Sequence[str]) -> Column:
    """From the first start pattern (else from the beginning) to the earliest end pattern (else to the end). Each pattern is searched once."""

    def until(part: Column) -> Column:
        return F.substring(part, F.lit(1), F.coalesce(F.array_min(places(part, ends)) - 1, F.length(part)))

    return X.let(F.substring(c, F.coalesce(F.get(places(c, starts), F.lit(0)), F.lit(1)), F.length(c)), until)


def portal_body(c: Column) -> Column:
    return X.strip_tags_lines(slice_between(c, PORTAL_STARTS, PORTAL_ENDS))


def body_lines(c: Column) -> Column:
    """Lines without blank ones and labels of varying values; of the first three, lines of digits alone are view counts and go too."""
    lines = F.split(c, X.LINE_END)
    kept = F.filter(lines, lambda x: (X.strip_space(x) != "") & ~X.strip_space(x).rlike(LABEL))
    return F.array_join(F.filter(kept, lambda x, i: ~((i < 3) & X.strip_space(x).rlike(VIEWS))), "\n")


def board_body(c: Column, source: str) -> Column:
    return body_lines(X.strip_tags_lines(slice_between(c, [BOARD_STARTS[source]], BOARD_ENDS)))


def count_of(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).try_cast("long")


def announced_total(c: Column) -> Column:
    """The count that a listing announces for all fields: by its tab in either attribute order, else the largest of all tabs."""
    all_counts = F.regexp_extract_all(c, F.lit(ANY_TAB), 1)
    return F.coalesce(*(count_of(X.empty_to_null(F.regexp_extract(c, p, 1))) for p in WHOLE_TAB), F.array_max(F.transform(all_counts, count_of)))


def last_page(c: Column) -> Column:
    """The largest linked page number; 0 if no page is linked, which is a sign of failure."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit(LINKED_PAGE), 1), lambda x: x.try_cast("int"))), F.lit(0))


def board_total(c: Column) -> Column:
    return X.empty_to_null(F.regexp_extract(c, BOARD_TOTAL, 1)).try_cast("long")


def file_link(url: Column, filename: Column) -> Column:
    return F.struct(url.alias("url"), filename.alias("filename"))


def hrefs(c: Column) -> Column:
    """array<string> of the addresses that a page links to in double quotes, in order, as they are written."""
    return F.regexp_extract_all(c, F.lit('href="([^"]*)"'), 1)


def title_of(c: Column) -> Column:
    """A page's title, white space squeezed; empty without one."""
    return X.squeeze(F.regexp_extract(c, r"(?s)<title[^>]*>(.*?)</title>", 1))


def portal_links(c: Column, base: str) -> Column:
    """array<struct<url, filename>> of a portal page's attachment links, in order; links may be escaped."""
    found = F.split(X.unescape(F.array_join(F.regexp_extract_all(c, F.lit(PORTAL_FILE), 1), "\n")), "\n")
    named = F.transform(F.filter(found, lambda u: u != ""), lambda u: file_link(F.concat(F.lit(base), u), F.substring_index(F.substring_index(u, "/", -1), "?", 1)))
    return named
