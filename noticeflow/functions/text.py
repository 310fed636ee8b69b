"""Scalar functions on text, dates, periods and statuses, as column expressions.

Entities are decoded by an Arrow UDF, as Spark has no expression for it; all else is built-in. White space and digits are Unicode-aware.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Python's str methods see it.
SPACE = r"(?U)[\s\x1c-\x1f]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

#: The statuses of an announcement.
OPEN, CLOSED, ALWAYS, SPENT, PLANNED, UNKNOWN = "접수중", "마감", "상시", "예산소진", "회차예정", "불명"
STATUSES = (OPEN, CLOSED, ALWAYS, SPENT, PLANNED, UNKNOWN)


@F.pandas_udf(T.StringType())
def unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: html.unescape(t) if t and "&" in t else t)


#: Character references that a semicolon closes.
REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][0-9A-Za-z]*);")


@F.pandas_udf(T.StringType())
def unescape_closed(texts: pd.Series) -> pd.Series:
    """As unescape(), but a reference that no semicolon closes (a cut '&amp', say) stays as it is written."""
    one = lambda m: html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0]
    return texts.map(lambda t: REFERENCE.sub(one, t) if t and "&" in t else t)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """A function of a value that is computed once a row, however often the function uses it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def strip_space(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def clean(c: Column) -> Column:
    """Entities decoded and white space squeezed; null is empty."""
    return squeeze(unescape(F.coalesce(c, F.lit(""))))


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip_tags_inline(c: Column, decode: Callable[[Column], Column] = unescape) -> Column:
    """Tags as spaces, entities decoded, white space squeezed."""
    return squeeze(decode(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " ")))


def tags_to_lines(c: Column) -> Column:
    """Scripts and styles dropped and other tags as line ends, before entities are decoded."""
    return F.regexp_replace(F.regexp_replace(c, r"(?s)<script.*?</script>|<style.*?</style>", ""), "<[^>]+>", "\n")


#: Fixed value: what stands between two line ends that become one.
BLANK_LINES = r"(?U)\n(?:[\s\x1c-\x1f]*\n)+"


def join_blank_lines(c: Column) -> Column:
    return F.regexp_replace(c, BLANK_LINES, "\n")


def strip_tags_lines(c: Column) -> Column:
    """Text of HTML by lines, without blank ones between."""
    return join_blank_lines(unescape(tags_to_lines(c)))


def iso(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", year, F.lpad(month.cast("int").cast("string"), 2, "0"), F.lpad(day.cast("int").cast("string"), 2, "0"))


#: Dates with a year of four and of two digits.
FOUR, TWO = r"(?U)\d{4}[.\-/\s]+\d{1,2}[.\-/\s]+\d{1,2}", r"(?U)\d{2}[.\-/]\d{1,2}[.\-/]\d{1,2}"


def norm_date(c: Column, cleaned: bool = False) -> Column:
    """The first date with a year of four, else of two digits, as YYYY-MM-DD; else the cleaned text itself. One search a shape."""

    def dated(found: Column, century: str) -> Column:
        return let(F.split(found, r"(?U)[.\-/\s]+"), lambda p: iso(F.concat(F.lit(century), p[0]), p[1], p[2]))

    def of(text: Column) -> Column:
        short = let(F.regexp_extract(text, TWO, 0), lambda d: F.when(d == "", text).otherwise(dated(d, "20")))
        return let(F.regexp_extract(text, FOUR, 0), lambda d: F.when(d == "", short).otherwise(dated(d, "")))

    return let(c if cleaned else clean(c), of)


def split_period(c: Column, cleaned: bool = False) -> Column:
    """struct<start, end> of 'a ~ b'; anything else is an end without a start. The halves and the whole are cleaned together."""
    if not cleaned:
        c = F.coalesce(c, F.lit(""))
    texts_ = F.concat(F.split(c, "[~∼]"), F.array(c))
    if not cleaned:
        texts_ = F.transform(F.split(unescape(F.array_join(texts_, "\u0000")), "\u0000"), squeeze)

    def of(parts: Column) -> Column:
        two = F.size(parts) == 3
        start = F.when(two, norm_date(F.get(parts, F.lit(0)), True)).otherwise("")
        return F.struct(start.alias("start"), norm_date(F.when(two, F.get(parts, F.lit(1))).otherwise(F.element_at(parts, -1)), True).alias("end"))

    return let(texts_, of)


def halves(c: Column) -> Column:
    """struct<start, end> of the first two parts around '~', trimmed but not normalised; null without '~'."""
    parts = F.split(c, "~")
    two = c.contains("~")
    return F.struct(*(F.when(two, empty_to_null(strip_space(F.get(parts, F.lit(i))))).alias(name) for i, name in enumerate(("start", "end"))))


def as_date(c: Column) -> Column:
    """The date that the first ten characters give, or null."""
    return F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-M-d")).cast("date")


def open_until(end: Column, as_of: Column) -> Column:
    return F.when(end >= as_of, OPEN).otherwise(CLOSED)


def status_by_end(end: Column, as_of: Column) -> Column:
    """Status from an end date: open to the end of that day, unknown without a valid date. ``as_of`` is the date of the survey."""
    date = as_date(end)
    return F.when(date.isNull(), UNKNOWN).otherwise(open_until(date, as_of))


def status_by_code(code: Column, end: Column, period: Column, as_of: Column) -> Column:
    """Status from a site's code, else from an end date, else from the second half of a period."""
    code = F.coalesce(code, F.lit(""))
    parts = F.split(period, "~")
    late = F.coalesce(empty_to_null(end), F.when(F.size(parts) == 2, strip_space(F.get(parts, F.lit(1)))))
    return (
        F.when(code.isin("Y", "신청가능"), OPEN)
        .when(code.isin("N", "신청불가", "마감"), CLOSED)
        .when(code.contains("상시"), ALWAYS)
        .when(code.rlike("예산|소진"), SPENT)
        .when(code.contains("예정"), PLANNED)
        .otherwise(status_by_end(late, as_of))
    )


def status_by_deadline(c: Column, as_of: Column) -> Column:
    """struct<status, end> of a free-text deadline: only what is certain is decided."""
    c = strip_space(F.coalesce(c, F.lit("")))
    last = r"(?U)(\d{4})[.\-/년\s]*(\d{1,2})[.\-/월\s]*(\d{1,2})[일.]?\s*(?:까지|마감)?\s*$"
    end = F.when(c.rlike(last), iso(*(F.regexp_extract(c, last, i) for i in (1, 2, 3))))
    always = c.rlike("상시|연중|수시")
    date = F.when(~always, as_date(end))
    return F.struct(
        F.when(always, ALWAYS).when(date.isNull(), UNKNOWN).otherwise(open_until(date, as_of)).alias("status"),
        F.when(date.isNotNull(), end).alias("end"),
    )


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor empty, trimmed; blanks alone count as filled."""
    return strip_space(F.coalesce(*(empty_to_null(c) for c in columns)))


def split_tags(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip_space), lambda t: t != "")


def one_tag(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(c))


def join_filled(*columns: Column, by: str = " / ") -> Column:
    return F.array_join(F.filter(F.array(*columns), lambda x: x.isNotNull() & (x != "")), by)


def without_nulls(**values: Column) -> Column:
    """A map of the values that aren't null."""
    entries = [x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]
    return F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull())


def body_hash(body: Column) -> Column:
    return F.sha2(body, 256)


def body_and_files_hash(body: Column, hashes: Column) -> Column:
    """Hash of a body and its attachments' hashes in any order."""
    return F.sha2(F.concat(body, F.lit("\n"), F.array_join(F.array_sort(hashes), "\n")), 256)


def blocked_page(body: Column) -> Column:
    """Whether a page says that it is withheld, within its first 4,000 characters."""
    return F.lower(F.substring(body, 1, 4000)).rlike("captcha|로그인이 필요|접근이 차단|비정상적인 접근")
