"""Hard negatives by Fagin's threshold algorithm over integer vectors.

Candidates are dealt into blocks; a block keeps one list of its candidates per dimension, sorted by that component. An
anchor reads every list from the end where its own component makes the products large, the same
number of places in all lists. A candidate met in any list is scored at random access by its whole vector. What
has not been met scores at most the threshold, the anchor's product with the components at the places
reached. Reading stops once the threshold is strictly below what is still asked for, so that ties are all
met: for positives the k-th best score, for negatives the k-th best score in each positive's window of
scores, or the window's lower end while it holds fewer than k.

Every anchor meets every block, in tasks of one block and one group of anchors; the best of a block
are few, and their best over all blocks are the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulseline.llm.common import each_of, matrix, prepare, stored

#: Candidates of a block and anchors of a group, on average.
BLOCK, ANCHORS = 8192, 512
#: Places read from every list in the first step; each further step doubles the depth.
FIRST = 8
#: Vector components are multiplied by this and rounded down.
SCALE = 256


class Lists:
    """One block of candidates, by id, with its lists by component, in rising and in falling order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, labels: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.labels = ids[by_id], labels[by_id]
        self.vectors = np.ascontiguousarray(vectors[by_id])
        rising = np.ascontiguousarray(np.argsort(self.vectors, axis=0, kind="stable").T.astype(np.int32))
        self.lists = np.stack([rising, rising[:, ::-1]])
        self.values = np.stack([np.take_along_axis(self.vectors.T, x, axis=1) for x in self.lists])
        self.dims = np.arange(vectors.shape[1])

    def access(self, anchor: np.ndarray):
        """Steps of sorted access: the places met so far, their scores, and the threshold."""
        n = len(self.ids)
        side = (anchor > 0).astype(np.intp)
        met, scores = np.zeros(n, bool), np.zeros(n, np.int64)
        low, high = 0, min(n, FIRST)
        while True:
            now = np.zeros(n, bool)
            now[self._read(side, low, high)] = True
            new = np.flatnonzero(now & ~met)
            scores[new] = self.vectors[new] @ anchor
            met[new] = True
            threshold = int(self.values[side, self.dims, high - 1] @ anchor)
            yield met, scores, threshold
            if high == n or met.all():
                return
            low, high = high, min(n, 2 * high)

    def _read(self, side: np.ndarray, low: int, high: int) -> np.ndarray:
        part = self.lists[:, :, low:high]
        return np.concatenate([part[0][side == 0].ravel(), part[1][side == 1].ravel()])

    def positives(self, anchor_id: int, anchor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best candidates but the anchor itself, ties to the smaller id."""
        others = self.ids != anchor_id
        for met, scores, threshold in self.access(anchor):
            found = np.flatnonzero(met & others)
            if len(found) >= k and threshold < np.partition(scores[found], len(found) - k)[len(found) - k]:
                break
        best = found[np.argsort(-scores[found], kind="stable")[:k]]
        return best, scores[best]

    def negatives(
        self, anchor: np.ndarray, label: int, windows: list[int], k: int, low: int, high: int
    ) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each positive's score the places and scores of the k best in its window, of other labels."""
        others = self.labels != label
        least = min(low * w for w in windows)
        for met, scores, threshold in self.access(anchor):
            percent = 100 * scores
            some = np.flatnonzero(met & others & (percent >= least))
            out, open_ = [], False
            for w in windows:
                inside = some[(percent[some] >= low * w) & (percent[some] <= high * w)]
                best = inside[np.argsort(-scores[inside], kind="stable")[:k]]
                out.append((best, scores[best]))
                # Nothing unseen reaches the window, or the last place in it.
                last = 100 * int(scores[best[-1]]) if len(best) == k else low * w
                open_ |= 100 * threshold >= last
            if not open_:
                break
        return out


def scaled(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label and integer vector of the rows that take part; one row for each id."""
    v = F.col("v")
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("long").alias("label"),
        F.col(vector_col).cast("array<double>").alias("v"),
    )
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & ~bad)
    rows = rows.withColumn("v", F.transform(v, lambda x: F.floor(x * float(SCALE)))).filter(F.size("v") > 0)
    one = rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("one"))
    return one.select("id", "one.label", "one.v", F.size("one.v").alias("dim"))


def _run(body, names: list[str]):
    """A function of two cogrouped tables (anchors, candidates) that calls ``body`` per dimension."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(left) and len(right):
            dims = right.column("dim").to_numpy()
            for dim in np.unique(left.column("dim").to_numpy()).tolist():
                have = right.filter(pa.array(dims == dim))
                want = left.filter(pa.array(left.column("dim").to_numpy() == dim))
                if len(have):
                    ids, labels = have.column("id").to_numpy(), have.column("label").to_numpy()
                    lists = Lists(ids, matrix(have, "v", dim), labels)
                    out += body(lists, want, matrix(want, "v", dim))
        columns = list(zip(*out)) or [[]] * len(names)
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return run


def _schema(names: list[str]) -> str:
    return ", ".join(f"{n} long" for n in names)


def hard_negatives(
    vectors: DataFrame,
    anchors: DataFrame,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components are multiplied by 256 and rounded down; scores are integer inner products with the anchor, higher ones
    first, ties by the smaller id. An anchor's positives are its first rows of the same label but its own; the negatives of each are the
    first rows of other labels whose score is between ``low`` and ``high`` per cent of the positive's.

    Rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part. Rows
    that share an id count as one, that of the smallest label and vector. Vectors of different
    lengths share no score and do not meet. Zero vectors take part. Fewer rows come where there are
    fewer candidates, none for an anchor alone in its label; a negative positive score leaves an empty window. Empty tables give no rows. Scores are
    exact while products and their sums fit 64 bits. Other columns are ignored.
    """
    spark = prepare(vectors.sparkSession)
    rows = stored(scaled(vectors, id_col, vector_col, label_col), "scaled")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], RESULT)
    wanted = anchors.select(F.col(id_col).cast("long").alias("id")).distinct()
    asked = stored(rows.join(wanted, "id", "left_semi"), "anchors")
    blocks, groups = max(1, round(n / BLOCK)), max(1, round(asked.count() / ANCHORS))
    place = F.pmod(F.xxhash64("id"), F.lit(blocks))
    group = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups))
    asked = asked.withColumn("group", group)
    have = rows.withColumn("block", place).withColumn("group", each_of(groups))

    def nearest(lists: Lists, want: pa.Table, wants: np.ndarray) -> list[tuple]:
        out = []
        for anchor, v in zip(want.column("id").to_pylist(), wants):
            best, scores = lists.positives(anchor, v, positives)
            out += [(anchor, i, s) for i, s in zip(lists.ids[best].tolist(), scores.tolist())]
        return out

    # A label's rows are dealt like all rows, so a hot label is spread over all blocks.
    by, names = ["label", "block", "group"], ["anchor_id", "positive_id", "positive_score"]
    met = (
        asked.withColumn("block", each_of(blocks))
        .groupBy(*by)
        .cogroup(have.groupBy(*by))
        .applyInArrow(_run(nearest, names), _schema(names))
    )
    order = W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    met = met.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
    best = met.groupBy("anchor_id").agg(
        F.collect_list("positive_id").alias("ids"), F.collect_list("positive_score").alias("scores")
    )
    windows = stored(asked.join(best, F.col("id") == F.col("anchor_id")).drop("anchor_id"), "windows")

    def hardest(lists: Lists, want: pa.Table, wants: np.ndarray) -> list[tuple]:
        out = []
        columns = (want.column(c).to_pylist() for c in ("id", "label", "ids", "scores"))
        for anchor, label, ids, scores, v in zip(*columns, wants):
            found = lists.negatives(v, label, scores, negatives, low, high)
            for one, score, (best, near) in zip(ids, scores, found):
                places = zip(lists.ids[best].tolist(), near.tolist())
                out += [(anchor, one, i, score, s) for i, s in places]
        return out

    by = ["block", "group"]
    names = ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]
    hard = (
        windows.withColumn("block", each_of(blocks))
        .groupBy(*by)
        .cogroup(have.groupBy(*by))
        .applyInArrow(_run(hardest, names), _schema(names))
    )
    order = W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    hard = hard.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return hard.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


RESULT = (
    "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
    "negative_score long"
)
