"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Best-fit decreasing takes the pieces by falling length and puts each into the tightest open bin that holds it. Lengths are whole numbers up to the
capacity, so the decisions depend only on how many pieces have each length: plan() replays the algorithm on that histogram, at most ``capacity`` counts,
with a segment tree over the remaining capacities that finds the tightest non-empty one in logarithmic time. Pieces of one length that meet a run of bins
of one remaining capacity are placed together, as the algorithm would place them one after another. The plan is a list of runs; a piece finds its bin by its
length and its number among the pieces of that length, so no group of pieces is ever gathered in one task.

Edge cases: a null text counts as empty; every document ends with the end token, so an empty one is a piece of length 1. Repeated rows and null ids are pieces
of their own; rows that agree in all that is compared get distinct places in any order, and ties of length go by key. A long text is cut into pieces of the
capacity; extra columns are ignored; an empty table has no pieces. Words of up to 1000 characters that aren't cached are encoded by a library, longer ones by
``bpe``, which gives the same ids without the library's limits (the tests compare them).
"""

from __future__ import annotations

import bisect
import zlib
from collections import deque
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm import bpe
from noticeflow.llm.common import RESULT_ROWS, gapless_rank, map_arrow, materialise, salt_count, tasks_for

CAPACITY = 1024
END = 2


class CapacityTree:
    """Segment tree over remaining capacities: which is the smallest, from a given one on, that some open bin has."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.leaves)

    def set(self, at: int, full: bool) -> None:
        at += self.leaves
        self.any[at] = full
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity >= least that is set: climb from its leaf until a right sibling has one, then go down to the left."""
        at = least + self.leaves
        if self.any[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def plan(histogram: Iterable[tuple[int, int]], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first number, first bin, pieces a bin, offset in the bin) of best-fit decreasing over (length, count) pairs.

    The piece with number k of a length, in the run that begins at number a, goes to bin first + (k - a) // per_bin, at offset + (k - a) % per_bin * length.
    """
    tree, bins = CapacityTree(capacity), [deque() for _ in range(capacity + 1)]
    runs, opened = [], 0

    def leave(room: int, first: int, count: int) -> None:
        if room and count:
            if bins[room] and bins[room][-1][0] + bins[room][-1][1] == first:
                bins[room][-1][1] += count
            else:
                bins[room].append([first, count])
            tree.set(room, True)

    for length, count in sorted(histogram, reverse=True):
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of length {length} for bins of {capacity}")
        done = 0
        while done < count:
            room = tree.tightest(length)
            if room is None:
                room, first, free = capacity, opened, -(-(count - done) // (capacity // length))
                opened += free
            else:
                first, free = bins[room].popleft()
                tree.set(room, bool(bins[room]))
            each = room // length
            used, rest = divmod(min(count - done, free * each), each)
            runs.append((length, done, first, each, capacity - room))
            done += used * each + rest
            leave(room - each * length, first, used)
            if rest:
                leave(room - rest * length, first + used, 1)
            if free > used + bool(rest):
                bins[room].appendleft([first + used + bool(rest), free - used - bool(rest)])
                tree.set(room, True)
    return runs


def pieces(docs: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end: int = END, vocabulary: str | None = None) -> DataFrame:
    """Tokenise, append the end token and cut: key, piece, start, length, ids_crc32. Only the first piece may be shorter than the capacity if there are several."""
    shared = docs.sparkSession.sparkContext.broadcast(bpe.read_vocabulary(vocabulary))  # a fixed file of 1.5 MB
    last = np.array([end], "<u4").tobytes()

    def make():
        coder = bpe.load(shared.value, bpe.LibraryBpe)

        def apply(cols):
            out = {k: [] for k in (key, "piece", "start", "length", "ids_crc32")}
            for k, x in zip(cols[key], cols[text]):
                ids = coder.encode(x).tobytes() + last
                n = len(ids) // 4
                for piece, stop in enumerate(range((n - 1) % capacity + 1, n + 1, capacity)):
                    start = max(0, stop - capacity) if piece else 0
                    for name, value in zip(out, (k, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop]))):
                        out[name].append(value)
            return out

        return apply

    kind = dict(docs.dtypes)[key]
    return map_arrow(docs.select(key, text), f"{key} {kind}, piece int, start long, length long, ids_crc32 long", make)


def place(cut: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces. ``cut`` is read three times, so it should be a written table."""
    counts = [(int(n), int(c)) for n, c in cut.groupBy("length").count().collect()]  # at most ``capacity`` rows
    runs = plan(counts, capacity)
    total = sum(c for _, c in counts)
    ranked = gapless_rank(cut, ["length"], [key, "piece", "ids_crc32"], "number", salt_count(total)).coalesce(tasks_for(total, RESULT_ROWS))
    by_length: dict[int, list] = {}
    for run in runs:
        by_length.setdefault(run[0], []).append(run[1:])
    firsts = {n: [r[0] for r in rs] for n, rs in by_length.items()}
    # The runs depend on the histogram of lengths alone: a few for each of at most ``capacity`` lengths, however many pieces there are.
    shared = cut.sparkSession.sparkContext.broadcast((by_length, firsts))
    names = [key, "piece", "start", "length", "ids_crc32"]

    def make():
        of, starts = shared.value

        def apply(cols):
            sequence, offset = [], []
            for n, k in zip(cols["length"], cols["number"]):
                first, bin_, each, at = of[n][bisect.bisect_right(starts[n], k) - 1]
                row, place_ = divmod(k - first, each)
                sequence.append(bin_ + row)
                offset.append(at + place_ * n)
            return {k: cols[k] for k in names} | {"sequence_id": sequence, "offset": offset}

        return apply

    kind = dict(cut.dtypes)[key]
    return map_arrow(ranked.select(*names, "number"), f"{key} {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", make, rows=1 << 14)


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end: int = END, vocabulary: str | None = None) -> DataFrame:
    """Pack all documents: one row a piece, with its sequence and its place there. Texts are tokenised once; the pieces' table is small (no ids)."""
    return place(materialise(pieces(docs, text, key, capacity, end, vocabulary), "pieces"), key, capacity)
