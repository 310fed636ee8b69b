"""Attachment links of the two boards, with the names that their pages give elsewhere."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from urllib.parse import unquote_plus

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.schema import struct, texts

LINKS = T.ArrayType(struct(**texts("url", "filename")))
#: How the boards write links and names.
FANFAN_LINK = re.compile(r'https://fanfandaero\.kr/download\.do\?fileName=[^"&\\\s]+')
FANFAN_NAME = re.compile(r'fileName=([^"&]+)[^"]*"\s*,\s*"\d+"\s*,\s*"([^"]+)"')
SSB_LINK = re.compile(r"common\.download\(\s*\d+\s*,\s*'([a-f0-9-]+)'")
SSB_TAG_END = re.compile(r"""\)"[^>]*>""")
SSB_SPAN = re.compile(r"\s*<span[^>]*>([^<]+)")
SSB_ICON = re.compile(r'alt=""\s*>(?=[^<])')
SSB_TEXT = re.compile(r"\s*([^<]+)")
SSB_FILE = "https://www.seoulshinbo.co.kr/download/{post}/{serial}.do?mng_cd=STRY9788"


def tidy(name: str) -> str:
    return " ".join(html.unescape(name).split())


def tail(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def fanfan_links(page: str) -> list[tuple[str, str]]:
    """Addresses in order of appearance, once each. A viewer's call names the files whose address ends as its path does; the last such call counts."""
    links = dict.fromkeys(map(html.unescape, FANFAN_LINK.findall(page)))
    called = [(tail(html.unescape(path)), tidy(name)) for path, name in FANFAN_NAME.findall(page)]
    return [(url, next((name for end, name in reversed(called) if url.endswith(end)), tail(url))) for url in links]


def ssb_links(page: str, post: str) -> list[tuple[str, str]]:
    """Files in order of appearance, once each, named by the text beside the link or else by their serial.

    The text is that of the span that one of the serial's calls begins, else what follows the next icon after the first call that ends its tag.
    """
    spans, ends = {}, {}
    for call in SSB_LINK.finditer(page):
        serial = call[1]
        spans.setdefault(serial, None)
        if spans[serial] is None and (end := SSB_TAG_END.match(page, call.end())):
            ends.setdefault(serial, end.end())
            span = SSB_SPAN.match(page, end.end())
            spans[serial] = span and span[1]
    icons = list(SSB_ICON.finditer(page)) if None in spans.values() else []
    starts = [icon.start() for icon in icons]
    out = []
    for serial, name in spans.items():
        if name is None and serial in ends and (i := bisect_left(starts, ends[serial])) < len(icons):
            name = SSB_TEXT.match(page, icons[i].end())[1]
        out.append((SSB_FILE.format(post=post, serial=serial), serial if name is None else unquote_plus(tidy(name))))
    return out


def board_links(page: Column, source: str, number: Column) -> Column:
    """array<struct<url, filename>> of a board's page; ``number`` is the post's."""

    @F.pandas_udf(LINKS)
    def run(pages: pd.Series, numbers: pd.Series) -> pd.Series:
        made = [fanfan_links(p or "") if source == "fanfandaero" else ssb_links(p or "", n or "") for p, n in zip(pages, numbers)]
        return pd.Series([[{"url": u, "filename": f} for u, f in links] for links in made])

    return run(page, number)
