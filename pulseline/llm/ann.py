"""Nearest neighbours by inner product with collision-counting hashing.

Inner product search becomes distance search: candidates get one more coordinate that brings
them to the same length, queries get zero there and that length too. Every hash function is one random projection; a
block of candidates keeps its projections as sorted arrays. A query looks at a window around its own
projection in every array, and virtual rehashing widens the windows step by step. A candidate that lies in enough windows has
collided often enough and is verified with its exact inner product.

A point at distance d falls into a window of half width w with the probability that a normal variable of deviation d
does, so w decides how surely a point is found. A query stops widening once a candidate as near as its k-th best so far
would have been found with the odds ``FOUND``; nearer ones are found more surely. This rule is the same for
tables of any size; where no vector is much nearer than the others, windows are wide and many are verified.

Every query first searches one block, whose k-th best bounds the windows in all others. Blocks have a bounded size and are separate tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulseline.llm.common import each_of, matrix, stored

#: Projections (at most 255, for collisions are counted in bytes), and those in which a candidate must collide.
PROJECTIONS, COLLISIONS = 64, 56
#: Odds with which a candidate as near as the k-th best has enough collisions when a query stops.
FOUND = 0.9
#: Half width of the first window in typical distances, and the most by which a step widens it.
FIRST, GROWTH = 0.6, 1.4
#: Candidates and queries of a block, on average.
BLOCK, QUERIES = 8192, 1024


def reach(projections: int = PROJECTIONS, collisions: int = COLLISIONS, found: float = FOUND) -> float:
    """Half width of a window, in distances, that gives enough collisions with the odds ``found``."""

    def odds(width: float) -> float:
        p = math.erf(width / math.sqrt(2))
        return sum(
            math.comb(projections, i) * p**i * (1 - p) ** (projections - i)
            for i in range(collisions, projections + 1)
        )

    low, high = 0.0, 10.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if odds(middle) < found else (low, middle)
    return high


class Block:
    """Sorted projections of one block of candidates."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float, seed: int = 7):
        self.ids, self.vectors = ids, vectors
        self.longest, self.reach = longest, reach()
        self.repeated = len(np.unique(ids)) < len(ids)
        draw = np.random.default_rng(seed)
        self.lines = draw.standard_normal((vectors.shape[1] + 1, PROJECTIONS))
        rest = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(axis=1), 0.0))
        shadow = np.c_[vectors, rest] @ self.lines
        order = np.argsort(shadow, axis=0, kind="stable")
        self.sorted = np.asfortranarray(np.take_along_axis(shadow, order, axis=0))
        # The place of each candidate in each sorted array: it is in a window if its place is.
        kind = np.uint16 if len(ids) < 1 << 16 else np.uint32
        self.places = np.empty((PROJECTIONS, len(ids)), kind)
        every = np.arange(len(ids), dtype=kind)
        for j in range(PROJECTIONS):
            self.places[j, order[:, j]] = every

    def _collided(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Candidates in enough of the windows of places from low to high (not included)."""
        kind = self.places.dtype.type
        inside = (self.places - low.astype(kind)[:, None]) < (high - low).astype(kind)[:, None]
        count = np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8)
        return np.flatnonzero(count >= COLLISIONS)

    def search(
        self, queries: np.ndarray, k: int, bounds: np.ndarray | None = None
    ) -> list[np.ndarray]:
        """Places of the verified candidates of each query, nearest first, at most k.

        ``bounds`` are scores that k candidates elsewhere reach.
        """
        n, longest = len(self.ids), self.longest
        # A query's length does not change the order.
        size = np.maximum(np.linalg.norm(queries, axis=1), 1e-300)
        at = np.c_[queries * (longest / size)[:, None], np.zeros(len(queries))] @ self.lines
        bounds = np.full(len(queries), -np.inf) if bounds is None else bounds
        # With a bound the window that ends the search is known from the start.
        away = np.sqrt(np.maximum(0.0, 2 * longest * (longest - bounds / size)))
        half = np.where(np.isfinite(bounds), self.reach * away, FIRST * math.sqrt(2) * longest)
        found: list[np.ndarray] = [np.empty(0, np.int64)] * len(queries)
        active = np.arange(len(queries))
        low = np.empty((len(queries), PROJECTIONS), np.int64)
        high = low.copy()
        while len(active):
            for j in range(PROJECTIONS):
                line, here = self.sorted[:, j], at[active, j]
                low[active, j] = np.searchsorted(line, here - half[active])
                high[active, j] = np.searchsorted(line, here + half[active], side="right")
            still = []
            for q in active:
                chosen = self._collided(low[q], high[q])
                score = self.vectors.take(chosen, axis=0) @ queries[q]
                found[q] = self._best(chosen, score, k)
                if (high[q] - low[q] == n).all():
                    continue
                # The k-th best score so far, here or elsewhere, and its distance.
                last = bounds[q]
                if len(found[q]) == k:
                    last = max(last, float(self.vectors[found[q][-1]] @ queries[q]))
                wide = half[q] * GROWTH
                if last > -np.inf:
                    away = math.sqrt(max(0.0, 2 * longest * (longest - last / size[q])))
                    if half[q] >= self.reach * away:
                        continue
                    wide = min(wide, self.reach * away)
                half[q] = wide
                still.append(q)
            active = np.array(still, np.int64)
        return found

    def _best(self, chosen: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
        if len(chosen) > 4 * k and not self.repeated:
            # All that reach the k-th best score, ties included.
            some = score >= np.partition(score, len(score) - k)[len(score) - k]
            chosen, score = chosen[some], score[some]
        chosen = chosen[np.lexsort((self.ids[chosen], -score))]
        if self.repeated:
            _, first = np.unique(self.ids[chosen], return_index=True)
            chosen = chosen[np.sort(first)]
        return chosen[:k]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector in double precision; null, zero and non-finite vectors are left out."""
    v = F.col("vector")
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")
    )
    bad = F.exists(
        v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    )
    some = F.exists(v, lambda x: x != 0)
    return rows.filter(F.col("id").isNotNull() & v.isNotNull() & ~bad & some)


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_col: str = "vec_id",
) -> DataFrame:
    """The k nearest candidates of every query: query_id, rank (from 1), vec_id, score.

    Score is the inner product in double precision, ties go to the smaller id, a query's own id is
    no candidate. Fewer rows come where there are fewer candidates. Null, empty, zero and
    non-finite vectors take no part, nor do null ids; candidates of another length than the
    query's share no measure with it and are skipped. A repeated row counts as one candidate:
    its best score stands. Rows of queries that share an id are one query: a candidate's score is the best of
    theirs. Empty tables give no rows. Other columns are ignored.
    """
    rows = usable(vectors, id_col, vector_col)
    rows = rows.withColumn("length", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)))
    rows = stored(rows, "vectors")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest")).first()
    if not facts.n:
        return vectors.sparkSession.createDataFrame([], RESULT)
    asked = usable(queries, query_col, vector_col)
    blocks = max(1, round(facts.n / BLOCK))
    groups = max(1, round(asked.count() / QUERIES))
    longest = float(facts.longest)
    # Blocks are dealt by the row's place, so repeated ids do not gather in one.
    places = F.xxhash64(F.monotonically_increasing_id())
    candidates = rows.select(
        "id", "vector", F.size("vector").alias("dim"), F.pmod(places, F.lit(blocks)).alias("block")
    )
    group = F.pmod(F.xxhash64("id"), F.lit(groups)).alias("group")
    asked = asked.select("id", "vector", F.size("vector").alias("dim"), group)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            dims = right.column("dim").to_numpy()
            for dim in np.unique(left.column("dim").to_numpy()).tolist():
                have = right.filter(pa.array(dims == dim))
                want = left.filter(pa.array(left.column("dim").to_numpy() == dim))
                if not len(have):
                    continue
                order = np.argsort(have.column("id").to_numpy(), kind="stable")
                vectors = matrix(have, "vector", dim)[order]
                block = Block(have.column("id").to_numpy()[order], vectors, longest)
                ids, wants = want.column("id").to_numpy(), matrix(want, "vector", dim)
                bounds = want.column("bound").to_numpy().astype(float)
                # One more, for the query itself may be among them.
                for q, near in enumerate(block.search(wants, k + 1, bounds)):
                    near = near[block.ids[near] != ids[q]]
                    # Summed as written, so the same pair has the same score in any block.
                    score = (block.vectors[near] * wants[q]).cumsum(axis=1)[:, -1]
                    out.append((np.full(len(near), ids[q]), block.ids[near], score))
        parts = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0)] * 3
        kinds = (pa.int64(), pa.int64(), pa.float64())
        arrays = [pa.array(p, t, from_pandas=False) for p, t in zip(parts, kinds)]
        return pa.Table.from_arrays(arrays, ["query_id", "vec_id", "score"])

    def searched(some: DataFrame, have: DataFrame) -> DataFrame:
        """Each query's best in the blocks that it has."""
        by = ["block", "group"]
        near = some.groupBy(*by).cogroup(have.groupBy(*by)).applyInArrow(run, NEAR)
        best = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return best.withColumn("rank", place).filter(F.col("rank") <= k)

    # Queries that have met one block know a score that k candidates reach.
    dealt = candidates.withColumn("group", each_of(groups))
    bound = F.lit(float("-inf")).alias("bound")
    if blocks > 1:
        home = F.pmod(F.col("group"), F.lit(blocks)).alias("block")
        first = searched(asked.select("*", home, bound), _homes(candidates, groups, blocks))
        first = first.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
        # Just below: the score was summed in another order.
        lower = F.col("bound") - F.abs("bound") * 1e-9
        asked = asked.join(stored(first, "bounds"), "id", "left")
        asked = asked.withColumn("bound", F.coalesce(lower, F.lit(float("-inf"))))
    else:
        asked = asked.select("*", bound)
    # Every query visits every block: one copy of it per block, in groups of bounded size.
    found = searched(asked.withColumn("block", each_of(blocks)), dealt)
    return found.select("query_id", "rank", "vec_id", "score")


def _homes(candidates: DataFrame, groups: int, blocks: int) -> DataFrame:
    """The candidates of each block once for every group of queries that starts with it."""
    mine = F.sequence(F.col("block"), F.lit(groups - 1).cast("long"), F.lit(blocks).cast("long"))
    none = F.array().cast("array<bigint>")
    mine = F.when(F.col("block") < groups, mine).otherwise(none)
    return candidates.withColumn("group", F.explode(mine))


NEAR = "query_id long, vec_id long, score double"
RESULT = "query_id long, rank int, vec_id long, score double"
