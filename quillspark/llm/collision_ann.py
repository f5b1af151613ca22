"""Approximate nearest neighbours by collision-counting hashing.

Vectors are stored in blocks of bounded size. A block projects its vectors on some random lines (one hash function each) and
keeps each projection as a sorted array. A query's windows are centred on its own projections; virtual rehashing widens them
by a constant ratio round by round, and a vector that lies in at least a set share of the windows is verified by its exact
inner product. A block's search ends when a vector as far as the k-th best verified would have collided often enough with the
probability asked for, or when all vectors are verified. The largest inner product becomes the least distance by one more
component, as usual for vectors of unequal norms.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

LINES, FIRST_WIDTH, RATIO, SHARE, REACH = 48, 1.1, 1.12, 0.75, 0.87
#: Vectors of a block and queries of a chunk that meet in a task, and queries whose windows are looked up at once.
BLOCK, CHUNK, BATCH = 32768, 16384, 64


@lru_cache(maxsize=4096)
def _passes(chance: float, lines: int, need: int) -> float:
    """How probable at least ``need`` of ``lines`` independent collisions are."""
    return sum(math.comb(lines, i) * chance**i * (1 - chance) ** (lines - i) for i in range(need, lines + 1))


class Block:
    """The index of some vectors: distinct ones are projected, equal ones share their place."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, top_norm: float, k: int, lines: int = LINES, seed: int = 7):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
        raw = vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
        _, first, inverse = np.unique(raw, return_index=True, return_inverse=True)
        self.vectors, self.k, self.top_norm = vectors[first], k, top_norm
        self.single = self.vectors.astype(np.float32)
        by_vector = np.argsort(inverse, kind="stable")
        starts = np.searchsorted(inverse[by_vector], np.arange(len(first)))
        # of equal vectors only the k + 1 smallest ids can be among a query's nearest, its own left out
        self.members = [np.unique(ids[by_vector[s:e]])[: k + 1] for s, e in zip(starts, [*starts[1:], len(ids)], strict=True)]
        #: ids may come more than once, with other vectors
        self.spare = len(ids) - len(np.unique(ids))
        scaled = self.vectors / top_norm
        lift = np.sqrt(np.maximum(0.0, 1.0 - (scaled * scaled).sum(1)))
        self.axes = np.random.default_rng(seed).standard_normal((lines, vectors.shape[1] + 1))
        projected = self.axes @ np.concatenate([scaled, lift[:, None]], 1).T
        self.at = np.argsort(projected, axis=1, kind="stable")
        self.sorted = np.take_along_axis(projected, self.at, 1)

    def search(self, queries: np.ndarray, own: list[int]) -> Iterator[tuple[list[int], list[float], int]]:
        """For each query ids and inner products of the k nearest found, nearest first, and how many distinct vectors were verified."""
        for lo in range(0, len(queries), BATCH):
            yield from self._search(queries[lo : lo + BATCH], own[lo : lo + BATCH])

    def _search(self, queries: np.ndarray, own: list[int]) -> Iterator[tuple[list[int], list[float], int]]:
        n, lines, k = len(self.vectors), len(self.at), self.k
        norms = np.linalg.norm(queries, axis=1)
        centres = self.axes[:, :-1] @ (queries / norms[:, None]).T
        need = max(1, math.ceil(SHARE * lines))
        least = min(n, k + 1 + self.spare)
        widths: list[float] = []
        bounds: list[list[list[int]]] = []

        def reached(step: int) -> list[list[int]]:
            # where the windows of a round begin and end, for all queries of the batch: first their starts by line, then their ends
            if step == len(bounds):
                widths.append(FIRST_WIDTH * RATIO**step)
                ends = [self.sorted[j].searchsorted(centres[j] + side) for side in (-widths[-1], widths[-1]) for j in range(lines)]
                bounds.append(np.stack(ends, 1).tolist())
            return bounds[step]

        for q, (query, norm) in enumerate(zip(queries, norms.tolist(), strict=True)):
            single = query.astype(np.float32)
            # collisions are counted from above: how many windows a vector lies outside of; a line holds each vector once
            open_ = np.ones(n, dtype=bool)
            found: list[np.ndarray] = []
            scores: list[np.ndarray] = []
            best = np.empty(0, dtype=np.float32)
            done = step = 0
            while True:
                at = reached(step)[q]
                if step == 0:
                    outside = np.bincount(np.concatenate([part for j, line in enumerate(self.at) for part in (line[: at[j]], line[at[lines + j] :])]), minlength=n)
                else:
                    outside -= np.bincount(np.concatenate([part for j, line in enumerate(self.at) for part in (line[at[j] : last[j]], line[last[lines + j] : at[lines + j]])]), minlength=n)
                last = at
                fresh = np.flatnonzero((outside <= lines - need) & open_)
                if len(fresh):
                    open_[fresh] = False
                    found.append(fresh)
                    scores.append(self.single.take(fresh, 0) @ single)
                    best = np.concatenate([best, scores[-1]])
                    if len(best) > least:
                        best = np.partition(best, len(best) - least)[-least:]
                    done += len(fresh)
                if done == n:
                    break
                if done >= least:
                    far = math.sqrt(max(2 - 2 * float(best.min()) / (norm * self.top_norm), 1e-12))
                    if _passes(round(math.erf(widths[step] / far / math.sqrt(2)), 3), lines, need) >= REACH:
                        break
                step += 1
            # single precision chooses, double precision ranks: what may round into the k nearest is kept
            slack = 1e-5 * norm * self.top_norm
            kth = float(best.min()) - slack if done >= least else -np.inf
            near = np.concatenate(found)[np.concatenate(scores) >= kth]
            exact = np.einsum("ij,j->i", self.vectors[near], query)
            nearest: dict[int, float] = {}
            for s, v in sorted((-float(s), int(v)) for i, s in zip(near, exact, strict=True) for v in self.members[i] if v != own[q]):
                nearest.setdefault(v, -s)
                if len(nearest) == k:
                    break
            yield list(nearest), list(nearest.values()), done


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), -1)


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", block: int = BLOCK, chunk: int = CHUNK
) -> DataFrame:
    """For each query its k nearest rows of vectors by inner product: query_id, rank (from 1), id_column, score.

    Both frames have id_column and vector_column. Equal scores are ordered by the smaller id; a query's own id is no
    candidate. Vectors that are null, empty, zero, or hold a null or non-finite component take no part on either side, nor do
    null ids. Only vectors of the same number of components are compared. A repeated id is one candidate with its best score;
    a repeated query id asks with the least of its vectors. With fewer candidates than k all are returned. Other columns
    aren't read; empty tables give an empty result.

    Every vector is indexed, in blocks of about ``block`` vectors dealt by hash; the queries come in chunks of at most about
    ``chunk``, and each block meets each chunk in one task, so that a task's memory is bounded by the two sizes. A block is
    indexed once for each chunk; with few blocks there are more chunks, so that all cores have work. How the queries
    are cut into chunks doesn't change what is found.
    """
    cores = max(1, vectors.sparkSession.sparkContext.defaultParallelism)
    fine = f"`{vector_column}` IS NOT NULL AND size(`{vector_column}`) > 0 AND forall(`{vector_column}`, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(`{vector_column}`, x -> x <> 0)"

    def valid(df: DataFrame) -> DataFrame:
        return df.where(f"`{id_column}` IS NOT NULL").where(fine).select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v")).withColumn("dim", F.size("v"))

    base = saved(valid(vectors))
    asked = saved(valid(queries).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    shape = base.groupBy("dim").agg(F.count("*").alias("n"), F.max(norm).alias("top"))
    sizes = asked.groupBy("dim").agg(F.count("*").alias("m"))
    # how many blocks and chunks, for each number of components
    grid = F.broadcast(shape.join(sizes, "dim").select("dim", "top", F.ceil(F.col("n") / block).cast("int").alias("blocks"), F.greatest(F.ceil(F.col("m") / chunk), F.least(F.ceil(F.lit(2 * cores) / F.ceil(F.col("n") / block)), F.ceil(F.col("m") / BATCH))).cast("int").alias("chunks")))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = base.join(grid, "dim").select("dim", "top", "id", "v", F.pmod(F.xxhash64("id", "v"), F.col("blocks")).cast("int").alias("block"), every("chunks").alias("chunk"))
    right = asked.join(grid, "dim").select("dim", "id", "v", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"), every("blocks").alias("block"))

    def search(stored: pa.Table, questions: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if stored.num_rows and questions.num_rows:
            index = Block(stored["id"].to_numpy(), _matrix(stored["v"]), float(stored["top"][0].as_py()), k)
            asking = questions["id"].to_pylist()
            for q, (ids, scores, _) in zip(asking, index.search(_matrix(questions["v"]), asking), strict=True):
                out[0].extend([q] * len(ids))
                out[1].extend(ids)
                out[2].extend(scores)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "id", "score"])

    keys = ["dim", "block", "chunk"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, id long, score double")
    # some blocks' best: k rows for each query and block
    return (
        found.groupBy("query_id", "id")
        .agg(F.max("score").alias("score"))
        .selectExpr("query_id", "CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank", f"id AS `{id_column}`", "score")
        .where(F.col("rank") <= k)
    )
