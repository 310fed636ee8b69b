"""Addresses and file names. Host tests are expressions; what needs percent-decoding is an Arrow UDF."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Sequence
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Percent-decodings of a path that are followed before it is refused.
DECODINGS = 6
#: Characters that file names keep.
NAME_OTHERS = r"(?U)[^\w.\-가-힣()\[\] ]"


def https_host(url: Column) -> Column:
    """Lower-case host of an https address, else null."""
    return F.when(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))) == "https", F.lower(F.try_parse_url(url, F.lit("HOST"))))


def host_is(host: Column, domain: str) -> Column:
    return (host == domain) | host.endswith("." + domain)


def host_allowed(url: Column, domains: Sequence[str]) -> Column:
    """Whether an address is https and on one of the domains or below it."""
    allowed, host = F.lit(False), https_host(url)
    for domain in domains:
        allowed = allowed | host_is(host, domain)
    return F.coalesce(allowed, F.lit(False))


def detail_target(url: Column) -> Column:
    """struct<source, source_id> that a board's detail address names; nulls where it names none."""
    host = https_host(url)

    def numbered(prefix: str, *patterns: str) -> Column:
        number = F.coalesce(*(F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in patterns))
        return F.concat(F.lit(prefix), number)

    fanfan, ssb = host_is(host, "fanfandaero.kr"), host_is(host, "seoulshinbo.co.kr")
    either = (r"nttId=(\d+)", r"sprtBizCd=(\d+)")
    return F.struct(
        F.when(fanfan, "fanfandaero").when(ssb, "seoulshinbo").alias("source"),
        F.when(fanfan, F.when(url.contains("nttId="), numbered("ntc-", *either)).otherwise(numbered("biz-", *either))).when(ssb, numbered("ntc-", r"/bbs/view/(\d+)\.do")).alias("source_id"),
    )


def path_forms(path: str) -> list[str] | None:
    """Every form of a path that a server might act on; None if it can't be decoded for certain."""
    forms = []
    for _ in range(DECODINGS):
        if re.search(r"%(?![0-9A-Fa-f]{2})", path):
            return None
        forms.append(path)
        try:
            decoded = unquote(path, errors="strict")
        except UnicodeDecodeError:
            return None
        if decoded == path:
            normal = [posixpath.normpath(f) for f in forms]
            return forms + normal + ["/" + f.lstrip("/") if f.startswith("/") else f for f in forms + normal]
        path = decoded
    return None


def path_allowed(url: str | None, prefixes: Sequence[str]) -> bool:
    """Whether no form of an address's path begins with a disallowed prefix; doubt refuses."""
    if not prefixes:
        return True
    try:
        forms = path_forms(urlsplit(url or "").path)
    except ValueError:
        return False
    return forms is not None and not any(f.startswith(p) for f in forms for p in prefixes)


def robots_allowed(url: Column, prefixes: Sequence[str]) -> Column:
    prefixes = tuple(prefixes)

    @F.pandas_udf(T.BooleanType())
    def test(urls: pd.Series) -> pd.Series:
        return urls.map(lambda u: path_allowed(u, prefixes))

    return test(url)


@F.pandas_udf(T.StringType())
def unquoted(names: pd.Series) -> pd.Series:
    """Percent-encoding undone; nulls stay."""
    return names.map(lambda n: n if n is None else unquote(n))


def fix_mojibake(name: Column) -> Column:
    """UTF-8 that was read as Latin-1, and percent-encoding, undone. Only texts with a percent sign are sent to Python."""

    read = F.encode(name, "ISO-8859-1").cast("string")
    repaired = F.when(F.is_valid_utf8(read), read).otherwise(name)
    whole = F.when(F.length(name) == F.octet_length(name), name).when(name.rlike(r"^[\x00-\xff]*\z"), repaired).otherwise(name)
    return F.coalesce(unquoted(F.when(whole.contains("%"), whole)), whole)


def base_name(name: Column) -> Column:
    """The last part of a path of either style, with other characters replaced, of 120 characters at most."""
    last = F.substring_index(F.replace(F.coalesce(name, F.lit("")), F.lit("\\"), F.lit("/")), "/", -1)
    return F.substring(F.regexp_replace(last, NAME_OTHERS, "_"), 1, 120)


def safe_filename(name: Column, index: Column) -> Column:
    """'NN_name' that is safe to store under."""
    base = base_name(name)
    digits = index.cast("string")
    number = F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)
    return F.concat(number, F.lit("_"), F.when(base == "", "attach").otherwise(base))


def safe_filename_by_id(file_id: Column, name: Column) -> Column:
    base = base_name(name)
    return F.when(base == "", file_id).otherwise(F.concat(F.substring(file_id, 1, 8), F.lit("_"), base))


def file_key(c: Column) -> Column:
    """A key as a file name: other characters as underscores, of 80 characters at most."""
    return F.substring(F.regexp_replace(c, r"(?U)\W+", "_"), 1, 80)


def encode_key(key: str) -> str:
    """A service key in percent-encoding, which it may already be in."""
    from urllib.parse import quote

    return key if "%" in key else quote(key, safe="")


def redact(message: Column, key: str) -> Column:
    """A message without a key in any of its encodings."""
    from urllib.parse import quote, quote_plus

    for form in sorted({key, encode_key(key), quote(key, safe=""), quote_plus(key)} - {""}, key=len, reverse=True):
        message = F.replace(message, F.lit(form), F.lit("[REDACTED]"))
    return message
