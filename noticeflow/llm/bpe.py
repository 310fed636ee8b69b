"""BPE encoding and decoding with a contiguous rank array.

A word is held as a list of part ids beside a list of the merge ranks of adjacent parts. Each step scans the ranks for the minimum, deletes the boundary
there and refreshes the two neighbouring ranks. Words beyond LONG bytes use a heap of the same ranks instead, since scanning grows with the square.

Words are what the byte-level pattern yields. A document is cut at those spaces that are followed by a non-space: the pattern never matches across such a
place except with the space as first character, so the chunks between can be encoded apart. Chunks are cached as their ids' bytes, in a cache of bounded size.

Edge cases: a null or empty text has no ids and decodes to an empty text. The special token's string in a text becomes its id, as the library does by default.
"""

from __future__ import annotations

import heapq
import json
import sys
from array import array
from functools import cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from noticeflow.llm.common import map_arrow

#: Fixed value: how byte-level vocabularies of this family split a text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG = 200
NO_MERGE = 1 << 60
#: Most chunks that a worker caches (about 80 MB).
CACHED = 300_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def byte_characters() -> dict[str, int]:
    """The printable characters that stand for bytes in such vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class LeadingSpace(Exception):
    """A space before white space, where a text must not be cut."""


class ChunkCache(dict):
    """Ids of chunks (without their leading space) as little-endian unsigned 32-bit bytes."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace():
            raise LeadingSpace
        if len(self) >= CACHED:
            self.clear()
        ids = self.encode(" " + chunk)
        self[chunk] = ids
        return ids


class Bpe:
    """Encoder and decoder for one vocabulary, given as the content of its JSON file."""

    def __init__(self, content: str):
        spec = json.loads(content)
        vocab, of = spec["model"]["vocab"], byte_characters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [b""] * size
        for text, i in vocab.items():
            self.token[i] = text.encode() if text in self.special else bytes(of[c] for c in text)
        for text, i in self.special.items():
            self.token[i] = text.encode()
        self.first = [0] * 256
        for i, text in enumerate(self.token):
            if len(text) == 1:
                self.first[text[0]] = i
        #: (left id << 20 | right id) -> rank << 20 | merged id, so that one number carries both and compares by rank.
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left] << 20 | vocab[right]] = rank << 20 | vocab[left + right]
        self.words: dict[str, bytes] = {}
        self.chunks = ChunkCache(self.plain)
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes_table = table_of(self.token)
        self.digit_table = table_of([b"%d," % i for i in range(size)])

    def word(self, text: str) -> bytes:
        """Ids of one word of the pattern, as bytes."""
        found = self.words.get(text)
        if found is None:
            raw = text.encode("utf-8", "surrogatepass")
            parts = list(map(self.first.__getitem__, raw))
            if len(parts) > 1:
                parts = self.scan(parts) if len(parts) <= LONG else self.heap(parts)
            found = as_bytes(parts)
            if len(raw) <= 64:
                if len(self.words) >= CACHED:
                    self.words.clear()
                self.words[text] = found
        return found

    def scan(self, parts: list[int]) -> list[int]:
        rank_of = self.merges.get
        ranks = [rank_of(a << 20 | b, NO_MERGE) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_MERGE:
                break
            i = ranks.index(least)
            parts[i] = least & 0xFFFFF
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of(parts[i] << 20 | parts[i + 1], NO_MERGE)
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] << 20 | parts[i], NO_MERGE)
        return parts

    def heap(self, parts: list[int]) -> list[int]:
        """The same merges for long words: live parts are linked, and outdated heap entries are skipped."""
        rank_of, n = self.merges.get, len(parts)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = [(r, i) for i in range(n - 1) if (r := rank_of(parts[i] << 20 | parts[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            j = after[i]
            if parts[i] < 0 or j < 0 or rank_of(parts[i] << 20 | parts[j]) != rank:
                continue
            parts[i], parts[j], after[i] = rank & 0xFFFFF, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (r := rank_of(parts[i] << 20 | parts[after[i]])) is not None:
                    heapq.heappush(queue, (r, i))
            if before[i] >= 0 and (r := rank_of(parts[before[i]] << 20 | parts[i])) is not None:
                heapq.heappush(queue, (r, before[i]))
        return [p for p in parts if p >= 0]

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens, as bytes, word by word."""
        if text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):
            return self.word(text)
        return b"".join(map(self.word, self.find(text)))

    def chunked(self, text: str) -> bytes:
        """As plain(), over cached chunks."""
        chunks = text.split(" ")
        try:
            return self.plain(chunks[0]) + b"".join(map(self.chunks.__getitem__, chunks[1:]))
        except LeadingSpace:
            return self.careful(chunks)

    def careful(self, chunks: list[str]) -> bytes:
        """Chunks that are empty or begin with white space belong to the one before them."""
        whole, out = [chunks[0]], []
        for c in chunks[1:]:
            if c and not c[0].isspace():
                out.append(" ".join(whole))
                whole = [c]
            else:
                whole.append(c)
        out.append(" ".join(whole))
        return self.plain(out[0]) + b"".join(self.chunks[c] if " " not in c else self.plain(" " + c) for c in out[1:])

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text as unsigned 32-bit numbers."""
        if not text:
            return np.empty(0, "<u4")
        if self.cut is None or not any(s in text for s in self.special):
            return np.frombuffer(self.chunked(text), "<u4")
        parts = [np.array([self.special[p]], "<u4").tobytes() if p in self.special else self.chunked(p) for p in self.cut.split(text) if p]
        return np.frombuffer(b"".join(parts), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids; those of whole texts are valid UTF-8."""
        return expand(self.bytes_table, ids)

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids as decimal numbers, joined by commas."""
        return expand(self.digit_table, ids)[:-1]


def table_of(items: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(x) for x in items], np.int64)
    return np.frombuffer(b"".join(items), np.uint8), np.cumsum(lengths) - lengths, lengths


def expand(table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, block: int = 1 << 18) -> bytes:
    """Concatenate the table's items of the ids, in blocks of bounded size."""
    data, starts, lengths = table
    out = []
    for at in range(0, len(ids), block):
        part = ids[at : at + block]
        n = lengths[part]
        ends = np.cumsum(n)
        shift = np.repeat(starts[part] - (ends - n), n)
        shift += np.arange(len(shift))
        out.append(data[shift].tobytes())
    return b"".join(out)


def as_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class LibraryBpe(Bpe):
    """The same ids, where another operator only needs them: words that aren't cached go to a library's encoder for rank files.

    That encoder merges by the ranks of tokens, which is the same if the merges are in the order of the ids they make; otherwise scan() stays.
    """

    def __init__(self, content: str):
        import tiktoken

        super().__init__(content)
        made = [v & 0xFFFFF for v in self.merges.values()]
        ranks = {text: i for i, text in enumerate(self.token) if text.decode("utf-8", "replace") not in self.special}
        if made == sorted(made) and len(ranks) == len(made) + 256:
            self.library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.chunks = ChunkCache(self.plain)
        else:
            self.library = None

    def plain(self, text: str) -> bytes:
        # Long texts without a place to cut stay here: the library's expressions may run out of stack on them.
        return as_bytes(self.library.encode_ordinary(text)) if self.library and len(text) <= 1000 else super().plain(text)


_LOADED: dict[tuple, Bpe] = {}


def load(content: str, kind: type[Bpe] = Bpe) -> Bpe:
    """An encoder that a Python worker keeps for its later tasks."""
    key = (kind, hash(content))
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = kind(content)
    return _LOADED[key]


def read_vocabulary(path: str | None = None) -> str:
    with open(path or default_vocabulary(), encoding="utf-8") as f:
        return f.read()


def encode_decode(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """Encode every text and decode it again: columns key, ids array<int>, decoded string. Null keys and texts stay rows (null text: no ids, empty)."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))  # a fixed file of 1.5 MB

    def make():
        bpe = load(shared.value)

        def apply(cols):
            ids = [bpe.encode(x) for x in cols[text]]
            return {key: cols[key], "ids": [x.astype("i4") for x in ids], "decoded": [bpe.decode(x).decode("utf-8", "replace") for x in ids]}

        return apply

    kind = dict(docs.dtypes)[key]
    return map_arrow(docs.select(key, text), f"{key} {kind}, ids array<int>, decoded string", make)


def digests(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """The round trip of encode_decode() as digests, made where the ids are: key, n_tokens, ids_sha256, decoded_sha256."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def make():
        from hashlib import sha256

        bpe = load(shared.value)

        def apply(cols):
            out = {key: cols[key], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for x in cols[text]:
                ids = bpe.encode(x)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(sha256(bpe.decimals(ids)).hexdigest())
                out["decoded_sha256"].append(sha256(bpe.decode(ids)).hexdigest())
            return out

        return apply

    kind = dict(docs.dtypes)[key]
    return map_arrow(docs.select(key, text), f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", make)
