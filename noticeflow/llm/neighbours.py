"""Nearest neighbours by score-aware anisotropic quantisation, four-bit table scans and exact reranking.

Euclidean nearness is an inner product: the nearest x to q has the largest q.x - |x|^2 / 2, and the norm is kept exactly. Vectors are product-quantised with
16 centres for every two dimensions, so two subspaces share a byte. Codes and centres are chosen for the score-aware loss, in which the part of the residual
that is parallel to the vector weighs ``eta`` times the orthogonal part, since it is what changes large inner products. A scan adds up, for each byte of a
block's codes, a table of 256 partial products of the query; each block's best rows are reranked by their exact distances in double precision, and so are all
further rows whose score, with MARGIN times the largest error seen among the reranked ones, reaches the k-th best: how many are reranked follows the data, so a
crowd of nearly equal vectors is told apart exactly.

Rows lie in cells around coarse centres, and a query looks at the cells whose centres are nearest: as many as find RECALL of the nearest neighbours of sampled
rows among the sample, so the share of the table that is scanned follows the data and not its size. Centres, quantiser and that number are fitted on a bounded
sample (``FIT`` rows by a hash of the id); every row is indexed. A cell's rows are cut into slices and its queries into parts of bounded size, and each slice
meets each part once, in a task that holds the part and streams the slice: a cell that holds a third of all rows is many slices.

Edge cases: vectors that are null, zero, of another dimension than most, or hold null or non-finite components take no part, nor do null ids. Equal distances
go to the smaller id, also when more rows tie than a block reranks. Rows with the query's own id are never its neighbours; of other ids that repeat, each row is
a neighbour of its own. A query row that repeats gets a list of its own each time. Fewer candidates than ``k``: all that were looked at. An empty table, or one
without queries, gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.llm.common import RESULT_ROWS, discard, materialise, tasks_for
from noticeflow.llm.training import SPACE

FIT = 16384
NEIGHBOURS = 10
RERANK = 128
MARGIN = 1.25
#: Rows that are scored at once, and score cells at once.
BLOCK, SCORES = 4096, 1 << 19
#: Rows in a slice of a cell, and queries in a part.
SLICE, PART = 1 << 16, 1 << 13
CENTRES = 16
#: At most so many cells, and the share of sampled neighbours that looking at some of them must find.
CELLS, RECALL = 1024, 0.98
#: The inner products that matter are those of vectors within this cosine of the query.
THRESHOLD = 0.2
SEED = 7


@dataclass
class Quantiser:
    """Centres (subspace, 16, 2) and the mean length that scaled the fit."""

    centres: np.ndarray
    dim: int

    def pad(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, 2 * len(self.centres) - x.shape[1])))

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Packed codes of vectors: even subspaces in the lower, odd ones in the upper four bits."""
        codes, _ = assign(self.pad(x.astype(np.float64)), self.centres, sweeps, self.dim)
        return (codes[:, 0::2] | codes[:, 1::2] << 4).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each query and each byte of a code, the partial products with its 256 values."""
        dots = np.einsum("qsd,scd->qsc", self.pad(q.astype(np.float64)).reshape(len(q), -1, 2), self.centres)
        return (dots[:, 0::2, None, :] + dots[:, 1::2, :, None]).reshape(len(q), -1, 256).astype(np.float32)


def eta(dim: int) -> float:
    """Weight of the parallel residual: (d - 1) t^2 / (1 - t^2) for a threshold t, which is raised in few dimensions, where larger cosines are common: 2 at least."""
    squared = max(THRESHOLD**2, 2 / (dim + 1)) if dim > 1 else 0.5
    return max(2.0, (dim - 1) * squared / (1 - squared))


def assign(x: np.ndarray, centres: np.ndarray, sweeps: int, dim: int, codes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Codes by coordinate descent on |r|^2 + (eta - 1) (r.u)^2, where r is the residual and u the vector's direction; and r.u."""
    norms = np.sqrt((x * x).sum(axis=1))
    u, weight = x / norms[:, None], eta(dim) - 1
    m, rows, squares = len(centres), np.arange(len(x)), (centres * centres).sum(axis=2)

    def apart(s: int) -> np.ndarray:
        """Squared distances to the centres of a subspace, but for a part's own square."""
        return squares[s] - 2 * (x[:, 2 * s : 2 * s + 2] @ centres[s].T)

    if codes is None:
        codes = np.stack([apart(s).argmin(axis=1) for s in range(m)], axis=1)
    chosen = centres[np.arange(m), codes].reshape(len(x), -1)
    along = ((x - chosen) * u).sum(axis=1)
    for _ in range(sweeps):
        for s in range(m):
            direction = u[:, 2 * s : 2 * s + 2]
            own = (x[:, 2 * s : 2 * s + 2] * direction).sum(axis=1)[:, None] - direction @ centres[s].T
            rest = along - own[rows, codes[:, s]]
            loss = own + rest[:, None]
            loss *= loss
            loss *= weight
            loss += apart(s)
            codes[:, s] = loss.argmin(axis=1)
            along = rest + own[rows, codes[:, s]]
    return codes, along


def fit(x: np.ndarray, rounds: int = 6, seed: int = SEED) -> Quantiser:
    """Alternate codes and centres; a centre is the solution of its members' two by two normal equations."""
    dim = x.shape[1]
    x = np.pad(x.astype(np.float64), ((0, 0), (0, -dim % 4)))
    m, rng = x.shape[1] // 2, np.random.default_rng(seed)
    centres = np.stack([x[rng.integers(0, len(x), CENTRES), 2 * s : 2 * s + 2] for s in range(m)])
    norms = np.sqrt((x * x).sum(axis=1))
    u, weight, codes = x / norms[:, None], eta(dim) - 1, None
    for _ in range(rounds):
        codes, along = assign(x, centres, 1, dim, codes)
        for s in range(m):
            part, direction = x[:, 2 * s : 2 * s + 2], u[:, 2 * s : 2 * s + 2]
            own = ((part - centres[s][codes[:, s]]) * direction).sum(axis=1)
            rest = along - own
            outer = direction[:, :, None] * direction[:, None, :]
            target = part + weight * direction * ((direction * part).sum(axis=1) + rest)[:, None]
            for c in range(CENTRES):
                at = codes[:, s] == c
                if at.any():
                    centres[s, c] = np.linalg.solve(np.eye(2) * at.sum() + weight * outer[at].sum(axis=0), target[at].sum(axis=0))
            along = rest + ((part - centres[s][codes[:, s]]) * direction).sum(axis=1)
    return Quantiser(centres, dim)


def usable(vector: str, dim: int) -> Column:
    """Whether a vector takes part."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(x.isNotNull() & (F.size(x) == dim) & finite & F.exists(x, lambda v: v != 0), F.lit(False))


@dataclass
class Cells:
    """Coarse centres, their members' mean squared distances, and at how many of the cells with the nearest members to be expected a query looks."""

    centres: np.ndarray
    spread: np.ndarray
    probes: int

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to the centres, but for a vector's own square."""
        return (self.centres * self.centres).sum(axis=1) - 2 * (x @ self.centres.T)

    def own(self, x: np.ndarray) -> np.ndarray:
        """The cell of each vector: that of the nearest centre."""
        return np.concatenate([self.distances(x[at : at + 2048].astype(np.float64)).argmin(axis=1) for at in range(0, len(x), 2048)])

    def looked_at(self, x: np.ndarray) -> np.ndarray:
        """The cells that queries look at, by the expected squared distance of a member."""
        return np.argsort(self.distances(x.astype(np.float64)) + self.spread, axis=1, kind="stable")[:, : self.probes]


def fit_cells(x: np.ndarray, rows: int, k: int, seed: int = SEED) -> Cells:
    """Centres by Lloyd's steps over a sample of a table of so many rows; probes by the sample's own nearest neighbours."""
    x, rng = x.astype(np.float64), np.random.default_rng(seed)
    count = max(1, min(CELLS, len(x) // 8, int(rows**0.5 / 4)))
    cells = Cells(x[rng.choice(len(x), count, replace=False)], np.zeros(count), count)
    for _ in range(8):
        own = cells.own(x)
        sums, members = np.zeros_like(cells.centres), np.bincount(own, minlength=count)
        np.add.at(sums, own, x)
        cells.centres = np.where(members[:, None] > 0, sums / np.maximum(members, 1)[:, None], cells.centres)
    own, asked = cells.own(x), rng.choice(len(x), min(512, len(x)), replace=False)
    members = np.bincount(own, minlength=count)
    cells.spread = np.bincount(own, ((x - cells.centres[own]) ** 2).sum(axis=1), minlength=count) / np.maximum(members, 1)
    half, found = (x * x).sum(axis=1) / 2, []
    for at in asked:
        score = x @ x[at] - half
        score[at] = -np.inf
        near = best_rows(score, min(k, len(x) - 1))
        place = np.empty(count, np.int64)
        place[cells.looked_at(x[at][None])[0]] = np.arange(count)
        found.append(place[own[near]])
    share = np.cumsum(np.bincount(np.concatenate(found), minlength=count)) / max(1, sum(map(len, found)))
    cells.probes = int(min(count, np.searchsorted(share, RECALL) + 1)) if len(x) > 1 else count
    return cells


def matrix(column: pa.Array, rows: int, type_: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(type_).reshape(rows, -1)


def index(vectors: DataFrame, quantiser: Quantiser, cells: Cells, key: str, vector: str, probes: bool = False) -> DataFrame:
    """key, cell, codes, vector (bytes in the vectors' own precision) of all rows; with ``probes``, the cells that queries look at instead of cell and codes."""
    shared = vectors.sparkSession.sparkContext.broadcast((quantiser, cells))  # 16 centres for every two dimensions, and CELLS centres
    type_ = np.float64 if "double" in dict(vectors.dtypes)[vector] else np.float32

    def run(batches):
        quantiser, cells = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = matrix(part.column(1), part.num_rows, type_)
                raw = pa.array([v.tobytes() for v in x], pa.binary())
                if probes:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(cells.looked_at(x)), pa.list_(pa.int32())), raw], names=[key, "cells", "vector"])
                else:
                    codes = pa.array([c.tobytes() for c in quantiser.encode(x)], pa.binary())
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cells.own(x), pa.int32()), codes, raw], names=[key, "cell", "codes", "vector"])

    return vectors.select(key, vector).mapInArrow(run, f"{key} long, cells array<int>, vector binary" if probes else f"{key} long, cell int, codes binary, vector binary")


def best_rows(scores: np.ndarray, count: int) -> np.ndarray:
    """Positions of the largest scores."""
    return np.arange(len(scores)) if len(scores) <= count else np.argpartition(-scores, count - 1)[:count]


class Best:
    """The k nearest rows found for each query of a part."""

    def __init__(self, quantiser: Quantiser, rows: np.ndarray, own: np.ndarray, x: np.ndarray, k: int, rerank: int):
        self.quantiser, self.rows, self.own, self.x, self.k, self.rerank = quantiser, rows, own, x.astype(np.float64), k, max(rerank, k) + 1
        self.distance, self.key = np.full((len(own), k), np.inf), np.full((len(own), k), np.iinfo(np.int64).max)
        self.length = (self.x * self.x).sum(axis=1)

    def measure(self, at: np.ndarray, found: np.ndarray, names: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Exact distances of queries ``at`` to the rows found for each, which are merged into the best ones."""
        distance = np.sqrt(((x[found] - self.x[at][:, None, :]) ** 2).sum(axis=2))
        self.merge(at, distance, names[found])
        return distance

    def merge(self, at: np.ndarray, distance: np.ndarray, names: np.ndarray) -> None:
        """Take rows at these distances among the best ones of queries ``at``."""
        other = names != self.own[at][:, None]
        near = np.concatenate([self.distance[at], np.where(other, distance, np.inf)], axis=1)
        which = np.concatenate([self.key[at], np.where(other, names, np.iinfo(np.int64).max)], axis=1)
        first = np.lexsort((which, near), axis=-1)[:, : self.k]
        self.distance[at], self.key[at] = np.take_along_axis(near, first, 1), np.take_along_axis(which, first, 1)

    def measure_pairs(self, at: np.ndarray, rows: np.ndarray, names: np.ndarray, x: np.ndarray) -> None:
        """Exact distances of queries to one row each; those that may be among a query's best, ties included, are merged."""
        for start in range(0, len(at), 1 << 14):
            query, row = at[start : start + (1 << 14)], rows[start : start + (1 << 14)]
            distance = np.sqrt(((x[row] - self.x[query]) ** 2).sum(axis=1))
            good = np.flatnonzero(distance <= self.distance[query, -1])
            own, first = np.unique(query[good], return_index=True)
            for q, mine in zip(own, np.split(good, first[1:])):
                self.merge(np.array([q]), distance[mine][None], names[row[mine]][None])

    def scan(self, names: np.ndarray, codes: np.ndarray, x: np.ndarray) -> None:
        """Score a block of rows by their codes, rerank the best, and all further rows that the error seen among those can't rule out."""
        n, half = len(names), ((x * x).sum(axis=1) / 2).astype(np.float32)
        step = max(1, min(64, SCORES // n))
        for start in range(0, len(self.own), step):
            at = np.arange(start, min(start + step, len(self.own)))
            if n <= self.rerank:
                self.measure(at, np.broadcast_to(np.arange(n), (len(at), n)), names, x)
                continue
            # The queries' products lie side by side, so that a row's byte reads those of all queries at once.
            tables = np.ascontiguousarray(self.quantiser.tables(self.x[at]).transpose(1, 2, 0))
            sums = np.repeat(-half[:, None], len(at), axis=1)
            part = np.empty_like(sums)
            for table, own in zip(tables, codes):
                sums += np.take(table, own, axis=0, out=part, mode="clip")
            score = np.ascontiguousarray(sums.T)
            found = np.argpartition(-score, self.rerank - 1, axis=1)[:, : self.rerank]
            distance = self.measure(at, found, names, x)
            seen = np.take_along_axis(score, found, 1)
            error = np.abs((self.length[at][:, None] - distance * distance) / 2 - seen).max(axis=1)
            more = score >= ((self.length[at] - self.distance[at, -1] ** 2) / 2 - MARGIN * error)[:, None]
            np.put_along_axis(more, found, False, 1)
            i, rest = np.nonzero(more)
            self.measure_pairs(at[i], rest, names, x)

    def found(self, key: str) -> pa.RecordBatch:
        good = np.isfinite(self.distance)
        repeated = good.sum(axis=1)
        columns = [np.repeat(self.rows, repeated), np.repeat(self.own, repeated), self.key[good], self.distance[good]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["row", "query_id", key, "score"])


def meetings(indexed: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """Slices of rows beside parts of queries: cell, slice, part, row (null for rows of the table, which come last), key, codes, vector."""
    probed = asked.select("row", key, "vector", F.explode("cells").alias("cell"))
    sizes = indexed.groupBy("cell").agg(F.count("*").alias("rows")).join(probed.groupBy("cell").agg(F.count("*").alias("queries")), "cell")
    sizes = materialise(sizes.select("cell", F.ceil(F.col("rows") / SLICE).cast("int").alias("slices"), F.ceil(F.col("queries") / PART).cast("int").alias("parts")), "cells", CELLS)
    sizes = F.broadcast(sizes)  # CELLS rows at most
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = indexed.join(sizes, "cell").withColumn("slice", F.pmod(F.xxhash64(key, "vector"), F.col("slices")).cast("int")).withColumn("part", copies("parts"))
    queries = probed.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).withColumn("slice", copies("slices"))
    columns = ["cell", "slice", "part", "row", key, "codes", "vector"]
    both = queries.withColumn("codes", F.lit(None).cast("binary")).select(columns).unionByName(rows.withColumn("row", F.lit(None).cast("long")).select(columns))
    return both.repartition("cell", "slice", "part").sortWithinPartitions("cell", "slice", "part", F.col("row").isNull())


def scan(met: DataFrame, quantiser: Quantiser, k: int, rerank: int, key: str, type_: type) -> DataFrame:
    """row, query_id, key, score: the k best rows of each slice for every query that meets it."""
    shared = met.sparkSession.sparkContext.broadcast(quantiser)

    def run(batches):
        now, queries, best = None, [], None

        def vectors(raw):
            return np.frombuffer(b"".join(raw), type_).reshape(len(raw), -1)

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                groups = np.stack([part.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
                asks = part.column(3).is_valid().to_numpy(zero_copy_only=False)
                cuts = np.flatnonzero((groups[1:] != groups[:-1]).any(axis=1) | (asks[1:] != asks[:-1])) + 1
                for first, last in zip([0, *cuts], [*cuts, part.num_rows]):
                    if now != (group := tuple(groups[first])):
                        if best is not None:
                            yield best.found(key)
                        now, queries, best = group, [], None
                    own = part.slice(first, last - first)
                    names = own.column(4).to_numpy(zero_copy_only=False)
                    x = vectors(own.column(6).to_pylist())
                    if asks[first]:
                        queries.append((own.column(3).to_numpy(zero_copy_only=False).astype(np.int64), names, x))
                    elif queries:
                        best = best or Best(shared.value, *map(np.concatenate, zip(*queries)), k, rerank)
                        codes = np.frombuffer(b"".join(own.column(5).to_pylist()), np.uint8).reshape(len(names), -1)
                        best.scan(names, np.ascontiguousarray(codes.T), x.astype(np.float64))
        if best is not None:
            yield best.found(key)

    return met.select("cell", "slice", "part", "row", key, "codes", "vector").mapInArrow(run, f"row long, query_id long, {key} long, score double")


def search(vectors: DataFrame, query: Column, k: int = NEIGHBOURS, key: str = "vec_id", vector: str = "embedding", rerank: int = RERANK, fit_rows: int = FIT) -> DataFrame:
    """query_id, rank, key, score: the k nearest rows found for every row where ``query`` holds."""
    spark = vectors.sparkSession
    type_ = np.float64 if "double" in dict(vectors.dtypes)[vector] else np.float32
    vectors = vectors.select(F.col(key).cast("long").alias(key), vector).where(F.col(key).isNotNull())
    dims = vectors.where(F.size(vector) > 0).groupBy(F.size(vector).alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    nothing = spark.createDataFrame([], f"query_id long, rank int, {key} long, score double")
    if not dims:
        return nothing
    good = vectors.where(usable(vector, dims[0].dim))
    draw = F.pmod(F.xxhash64(F.lit(SEED), F.col(key)), F.lit(SPACE)) < int(SPACE * min(1.0, fit_rows / dims[0].n))
    sample = good.where(draw).limit(2 * fit_rows).toArrow()
    if sample.num_rows == 0:
        sample = good.limit(fit_rows).toArrow()
    if sample.num_rows == 0:
        return nothing
    order = np.argsort(sample.column(0).to_numpy(), kind="stable")
    drawn = matrix(sample.column(1).combine_chunks(), sample.num_rows, type_)[order]
    quantiser, cells = fit(drawn), fit_cells(drawn, dims[0].n, k)
    queries = index(good.where(query), quantiser, cells, key, vector, probes=True)
    asked = materialise(queries.withColumn("row", F.monotonically_increasing_id()), "queries")  # written, so that a row keeps its number
    if asked.isEmpty():
        return nothing
    indexed = materialise(index(good, quantiser, cells, key, vector), "index")
    found = materialise(scan(meetings(indexed, asked, key), quantiser, k, rerank, key, type_), "neighbours")
    for done in (asked, indexed):
        discard(done)
    rank = F.row_number().over(Window.partitionBy("row").orderBy("score", key))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", key, "score")
    return ranked.coalesce(tasks_for(found.count(), RESULT_ROWS))
