"""Secret scans: keyword prefilter, anchored expressions near hits, embedded checksums.

An Aho-Corasick automaton finds all keywords of all kinds in one pass over the text with A-Z lower-cased. Expressions are then matched only at the places the
hits name, never searched for, so a text without keywords costs one pass. Tokens that carry a checksum of their own are reported only if it is right.
Runs of hex digits have no keyword; their filter is a look at every HEX_LEAST-th character, which any long enough run must cover.

Kinds: ``assign``, ``access`` and ``hex`` are the base kinds, leftmost and non-overlapping within a kind as a search from left to right gives them.
The method adds ``github`` and ``npm`` (six base-62 digits of CRC-32 over the rest), ``iban`` (remainder 97) and ``card`` (Luhn) after a keyword.
What follows a number may look like more of it, so shorter ends are tried too: for an IBAN first the length of its country, for a card from the longest down.
Offsets count code points; ends are exclusive.

Edge cases: a null text is empty and has no spans; overlapping spans of different kinds are all reported, ties of start in the order of kinds. Long texts are
scanned whole; repeated rows and null ids are rows like others; extra columns are ignored, and kept by redact(); an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from hashlib import sha256

from pyspark.sql import DataFrame

from noticeflow.llm.common import map_arrow

#: The kinds in their order, the base expressions and the least lengths.
KINDS = ("assign", "access", "hex", "github", "npm", "iban", "card")
BASE = KINDS[:3]
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
GITHUB = re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
NPM = re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
IBAN = re.compile(r"iban[ :=]{1,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", re.IGNORECASE | re.ASCII)
CARD = re.compile(r"card(?: number| no\.?)?[ :=#]{1,3}([0-9](?:[ -]?[0-9]){12,18})(?![0-9])", re.IGNORECASE | re.ASCII)
KEYWORDS = {k: "assign" for k in ("password", "passwd", "secret", "token", "apikey", "api_key")} | {"akia": "access", "npm_": "npm", "iban": "iban", "card": "card"} | {f"gh{c}_": "github" for c in "pousr"}
#: Lengths of IBANs by country; other countries may have any.
IBAN_LENGTHS = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.split()
}
IBAN_LEAST, CARD_LEAST = 15, 13
DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX_DIGITS = frozenset("0123456789abcdef")


def crc62(body: str) -> str:
    """CRC-32 of a token's body as six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = DIGITS62[r] + out
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def parts(number: str, marks: str) -> list[tuple[int, str]]:
    """(end, characters without marks) of a number and of its beginnings that end before a mark, longest first."""
    ends = [len(number), *(i for i in range(len(number) - 1, 0, -1) if number[i] in marks)]
    return [(end, "".join(c for c in number[:end] if c not in marks)) for end in ends]


def lower_ascii(text: str) -> str:
    """A-Z in lower case and nothing else, so that offsets stay."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


class Scanner:
    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            self.automaton.add_word(word, (kind, len(word)))
        self.automaton.make_automaton()
        self.matchers = {"assign": self.assign, "access": self.access, "github": self.checked(GITHUB), "npm": self.checked(NPM), "iban": self.iban, "card": self.card}

    @staticmethod
    def assign(text: str, at: int):
        m = ASSIGN.match(text, at)
        return m and (m.start(), m.end(), len(m[1]) >= ASSIGN_LEAST)

    @staticmethod
    def access(text: str, at: int):
        m = ACCESS.match(text, at)
        return m and (m.start(), m.end(), m.end() - m.start() >= ACCESS_LEAST)

    @staticmethod
    def checked(pattern: re.Pattern):
        def match(text: str, at: int):
            m = pattern.match(text, at)
            return m and (m.start(), m.end(), crc62(m[1]) == m[2])

        return match

    @staticmethod
    def iban(text: str, at: int):
        """None if no end has a right checksum: what a wrong number seems to cover may hold the next keyword."""
        if not (m := IBAN.match(text, at)):
            return None
        ends = [(end, body.upper()) for end, body in parts(m[1], " ")]
        length = IBAN_LENGTHS.get(ends[0][1][:2])
        tried = [e for e in ends if len(e[1]) == length] + (ends[:1] if length else [e for e in ends if len(e[1]) >= IBAN_LEAST])
        return next(((m.start(1), m.start(1) + end, True) for end, body in tried if mod97(body)), None)

    @staticmethod
    def card(text: str, at: int):
        if not (m := CARD.match(text, at)):
            return None
        return next(((m.start(1), m.start(1) + end, True) for end, body in parts(m[1], " -") if len(body) >= CARD_LEAST and luhn(body)), None)

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) of all findings, by start, then kind."""
        if not text:
            return []
        found, hits = [], {}
        for end, (kind, length) in self.automaton.iter(lower_ascii(text)):
            hits.setdefault(kind, []).append(end - length + 1)
        for kind, starts in hits.items():
            free, match = 0, self.matchers[kind]
            for at in sorted(starts):
                if at >= free and (m := match(text, at)):
                    free = m[1]
                    if m[2]:
                        found.append((kind, m[0], m[1]))
        found += [("hex", a, b) for a, b in hex_runs(text)]
        found.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
        return found


def hex_runs(text: str) -> list[tuple[int, int]]:
    """Maximal runs of at least HEX_LEAST lower-case hex digits: such a run covers a probed position, from which it is followed both ways."""
    out, probe, done = [], HEX_LEAST - 1, 0
    for i, c in enumerate(text[probe::HEX_LEAST]):
        if c in HEX_DIGITS and (at := probe + i * HEX_LEAST) >= done:
            start = at
            while start > done and text[start - 1] in HEX_DIGITS:
                start -= 1
            done = HEX.match(text, at).end()
            if done - start >= HEX_LEAST:
                out.append((start, done))
    return out


def written(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


SPANS = "array<struct<kind: string, start: int, end: int>>"


def find(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, spans: all findings of every text."""

    def make():
        scan = Scanner().spans
        return lambda cols: {key: cols[key], "spans": [[dict(zip(("kind", "start", "end"), s)) for s in scan(x)] for x in cols[text]]}

    return map_arrow(docs.select(key, text), f"{key} {dict(docs.dtypes)[key]}, spans {SPANS}", make)


def digests(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Counts by base kind, the digest of the base spans and all spans as text."""

    def make():
        scan = Scanner().spans

        def apply(cols):
            out = {key: cols[key]} | {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
            for x in cols[text]:
                spans = scan(x)
                base = [s for s in spans if s[0] in BASE]
                for kind in BASE:
                    out[f"n_{kind}"].append(sum(s[0] == kind for s in base))
                out["base_sha256"].append(sha256(written(base).encode()).hexdigest())
                out["spans"].append(written(spans))
            return out

        return apply

    return map_arrow(docs.select(key, text), f"{key} {dict(docs.dtypes)[key]}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", make)


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """The documents with every finding replaced by a mark; all columns stay, and texts without findings don't change.

    A column n_chars of whole numbers counts the new text; one of another type is another thing of that name and stays as it is. Null texts stay null.
    """
    schema = docs.schema
    counted = "n_chars" in schema.fieldNames() and schema["n_chars"].dataType.typeName() in ("integer", "long")
    where = schema.fieldNames().index(text)

    def run(batches):
        import pyarrow as pa

        scan = Scanner().spans
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                values = [masked(x, scan(x), mark) if x else x for x in part.column(where).to_pylist()]
                columns = list(part.columns)
                columns[where] = pa.array(values, type=part.schema.field(where).type)
                if counted:
                    i = part.schema.get_field_index("n_chars")
                    columns[i] = pa.array([n if x is None or x == old else len(x) for n, x, old in zip(columns[i].to_pylist(), values, part.column(where).to_pylist())], type=columns[i].type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, schema)


def masked(text: str, spans, mark: str) -> str:
    """A text with its spans, joined where they overlap, replaced."""
    out, done = [], 0
    for _, start, end in spans:
        if end > done:
            if start >= done:
                out += [text[done:start], mark]
            done = end
    return "".join([*out, text[done:]])
