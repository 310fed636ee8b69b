"""Which announcement a page says it is: ids that scripts declare and elements carry.

Only what a browser would run or parse counts: text in comments, strings, regular expressions, other scripts or anchors doesn't. A declaration of a form that
isn't known makes the answer null, so that the caller refuses the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRING = re.compile(r"""'(?:\\[\s\S]|[^'\\])*(?:'|\Z)|"(?:\\[\s\S]|[^"\\])*(?:"|\Z)|`(?:\\[\s\S]|[^`\\])*(?:`|\Z)""")
COMMENT = re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)")
REGEX = re.compile(r"/(?:\\[\s\S]|\[(?:\\[\s\S]|[^\]\\\n])*\]?|[^/\\\[\n])*(?:/|(?=\n)|\Z)")
NAME = re.compile(r"(?:[^\W\d]|\$)(?:\w|\$)*")
ASSIGN = re.compile(r"[ \t]*=(?![=>])")
#: The characters after which a slash begins a regular expression, and the forms of declarations that are known.
BEFORE_REGEX = frozenset("(,=:[!&|?{};+-*%<>~^")
DECLARE = frozenset(("var", "let", "const"))
ADDRESS = re.compile(r"""location\.origin\s*\+\s*location\.pathname\s*\+\s*(['"])\?pblancId=(PBLN_\d+)\1""")
NUMBER = re.compile(r"""(['"]?)(\d+)\1""")

#: Pages of plain tags, which any parser reads alike (attributes in double quotes, nothing that changes how what follows is read), and their links.
PLAIN = re.compile(r"""(?:[^<]++|</?(?!(?:script|style|textarea|title|xmp|iframe|noembed|noframes|noscript|plaintext)\b)[a-z][a-z0-9]*+(?:[ \t\n]++[a-z][a-z0-9-]*+="[^"<>]*+")*+[ \t\n]*+/?>)*+""", re.I | re.A)
LINK = re.compile(r"<link(?=[ \t\n/>])[^<>]*>", re.I | re.A)
ATTRIBUTE = re.compile(r'[ \t\n]([a-z][a-z0-9-]*)="([^"]*)"', re.I | re.A)
VIEW = re.compile(r"/view/0*(\d+)\.do")


def tokens(code: str, at: int = 0) -> Iterator[tuple[str, str, int]]:
    """(kind, text, end) of a script's tokens; kinds are string, comment, regex, name, space and sign."""
    before = ""
    while at < len(code):
        c = code[at]
        if c in "'\"`":
            kind, m = "string", STRING.match(code, at)
        elif m := COMMENT.match(code, at):
            kind = "comment"
        elif c == "/" and (not before or before in BEFORE_REGEX):
            kind, m = "regex", REGEX.match(code, at)
        elif m := NAME.match(code, at):
            kind = "name"
        else:
            kind, m = "space" if c.isspace() else "sign", None
        end = m.end() if m else at + 1
        yield kind, code[at:end], end
        if kind not in ("comment", "space"):
            before = {"string": "'", "regex": "/"}.get(kind, code[end - 1])
        at = end


def declared(code: str, name: str) -> Iterator[str]:
    """What is assigned to a variable where it is declared: up to the semicolon, without comments and regular expressions."""
    at, ready, after_dot = 0, False, False
    while at < len(code):
        for kind, text, end in tokens(code, at):
            if kind in ("comment", "space"):
                continue
            if kind == "name" and text == name and ready and not after_dot and (m := ASSIGN.match(code, end)):
                value = []
                for kind_, part, stop in tokens(code, m.end()):
                    at = stop
                    if kind_ == "sign" and part == ";":
                        at = stop - 1
                        break
                    if kind_ not in ("comment", "regex"):
                        value.append(part)
                else:
                    at = len(code)
                yield "".join(value).strip()
                ready = after_dot = False
                break
            ready = kind == "name" and text in DECLARE
            after_dot = kind == "sign" and text == "."
        else:
            return


class Marks(HTMLParser):
    """Texts of scripts, and the ids that canonical links and id fields carry."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.scripts: list[str] = []
        self.views: set[int] = set()
        self.fields: set[int] = set()
        self.inside = False

    def handle_starttag(self, tag, attrs):
        of = {k.lower(): v or "" for k, v in attrs}
        if tag == "script":
            self.inside = True
            self.scripts.append("")
        elif tag == "link" and of.get("rel", "").lower() == "canonical" and (m := VIEW.search(of.get("href", ""))):
            self.views.add(int(m[1]))
        elif tag == "input" and of.get("name") == "nttId" and of.get("value", "").strip().isdigit():
            self.fields.add(int(of["value"].strip()))

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "script"

    def handle_data(self, data):
        if self.inside:
            self.scripts[-1] += data

    def close_scripts(self) -> list[str]:
        return self.scripts[:-1] if self.inside else self.scripts


def marks(page: str | None) -> Marks:
    found = Marks()
    try:
        found.feed(page or "")
    except (AssertionError, ValueError):
        return Marks()  # a page that can't be parsed says nothing
    return found


def plain_views(page: str) -> set[int] | None:
    """What marks() finds as ``views``, for a page of plain tags; None for any other."""
    if not PLAIN.fullmatch(page):
        return None
    views = set()
    for link in LINK.findall(page):
        if "&" in link:
            return None
        of = {k.lower(): v for k, v in ATTRIBUTE.findall(link)}
        if of.get("rel", "").lower() == "canonical" and (m := VIEW.search(of.get("href", ""))):
            views.add(int(m[1]))
    return views


def script_ids(scripts: list[str], name: str, form: re.Pattern) -> set[str] | None:
    """Ids of a variable's declarations in all scripts, each on its own; None if one has another form."""
    ids = set()
    for script in scripts:
        for value in declared(script, name):
            m = form.fullmatch(value)
            if not m:
                return None
            ids.add(m[2])
    return ids


def page_ids(page: str | None, source: str) -> list[str] | None:
    """The ids that a page of a source gives itself, sorted; None if a declaration can't be understood."""
    if source == "seoulshinbo" and (views := plain_views(page or "")) is not None:
        return sorted(map(str, views))
    found = marks(page)
    if source == "bizinfo":
        ids = script_ids(found.close_scripts(), "altUrl", ADDRESS)
        return None if ids is None else sorted(ids)
    if source == "seoulshinbo":
        return sorted(map(str, found.views))
    numbers = script_ids(found.close_scripts(), "nttId", NUMBER)
    return None if numbers is None else sorted({str(int(n)) for n in numbers} | set(map(str, found.fields)))


def self_ids(page: Column, source: str) -> Column:
    """array<string> of the ids that a page gives itself, or null."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def ids(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: page_ids(p, source))

    return ids(page)


def is_page_of(page: Column, source: str, requested: Column) -> Column:
    """Whether a page says that it is the requested announcement and no other; doubt refuses."""
    return F.coalesce(self_ids(page, source) == F.array(requested.cast("string")), F.lit(False))
