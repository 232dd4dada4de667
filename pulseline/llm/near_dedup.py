"""Near-duplicate documents from bottom-k sketches of word shingles.

One hash function maps shingles to numbers; a document's sketch is the k smallest. Documents with the
same shingle set are one class. Inverted lists of the sketch values give candidates: two sketches that
must share t values share one among the rarest (size - t + 1) values of each, so only these
enter the lists, and shingles of passages that many documents share stay out. The sketch of two
sketches' union estimates the similarity and filters; the full shingle sets of what is left decide.

Lists are not expanded into pairs. First every class is held against a few members of its lists, and the
links found are joined into components; two members of one component need no comparison any
more, since the result is the components. This is repeated with other members for the lists that still
hold several components. The lists left are bundled by one member that they choose alike, so that a group of near copies is one
bundle and not a list for each value it shares, and what is not in a bundle's main component is compared with all of it,
in blocks.

Full sets are needed of the members of lists only. They are kept in buckets by document, so that pairs go to
them and not they to the pairs; per pair one set moves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pulseline.llm import common
from pulseline.llm.common import bucketed, forget, packed, shuffles_dropped, unpacked, whole_row

#: Sketch size, and the values that sketches of linked documents share at least: 51 are expected at
#: a similarity of 0.8, with a deviation of 3.2, so fewer than 34 come three times in ten million links.
SKETCH, SHARED = 64, 34
#: Estimates of pairs with a chosen member that are this far below the threshold still go to the exact test
#: (4 deviations); pairs lost here are met again in the blocks.
MARGIN = 0.2
#: Members of a list that all others are held against, round by round. In a group of which
#: 40 % of all pairs are linked, 3 + 6 members leave one in a hundred for the blocks.
STARS = (3, 6)
#: Members of a bundle on either side of one comparison, and the sketch for that: smaller sets are compared whole,
#: larger ones may be estimated so many deviations below the threshold.
BLOCK, FINE, DEVIATIONS = 2048, 512, 5.5
#: Pairs, columns of the table of frequent values, and pairs of owners of rare ones in one step of it;
#: a value is frequent from so many sets on.
STEP_PAIRS, STEP_VALUES, STEP_RARE, OFTEN = 10_000, 4096, 4_000_000, 64
#: Words whose hashes a worker keeps.
HELD_WORDS = 400_000

_STEP = np.uint64(0x9E3779B97F4A7C15)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the work folder and read back; what was shuffled for it is gone by then."""
    with shuffles_dropped(df.sparkSession):
        return common.stored(df, name)


class Shingler:
    """Sorted distinct 63-bit hashes of a text's word shingles."""

    def __init__(self, size: int):
        self.size = size
        self._memo: dict[bytes, int] = {}

    def hashes(self, text: str | None) -> np.ndarray:
        # bytes.lower() and bytes.split() know ASCII letters and blanks only.
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.int64)
        memo = self._memo
        if len(memo) > HELD_WORDS:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = xxhash.xxh3_64_intdigest(w)
        each = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        size = min(self.size, len(each))
        n = len(each) - size + 1
        mark = np.full(n, size, np.uint64)
        for i in range(size):
            mark = (mark ^ each[i : i + n]) * _STEP
            mark ^= mark >> np.uint64(32)
        mark *= _STEP
        return np.unique((mark >> np.uint64(1)).astype(np.int64))


def profiles(docs: DataFrame, words: int, sketch: int) -> DataFrame:
    """doc_id, n_shingles, set_hash (of the whole set) and sketch of every row (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            sets = [shingler.hashes(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([s[:sketch] for s in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "set_hash", "sketch"],
            )

    schema = "doc_id long, n_shingles long, set_hash binary, sketch array<long>"
    return docs.mapInArrow(run, schema)


def prefix_postings(classes: DataFrame, sketch: int, shared: int, similarity: float) -> DataFrame:
    """value, rep and n of the sketch values that enter the lists, from classes (rep, n, sketch).

    Values of one class only lead nowhere but fill up its rare places, so they are counted, not
    kept; nor is a class in a list in which no other one is of a size that fits. Sets whose partners all have full sketches must share
    their exact overlap.
    """
    each = classes.select("rep", "n", F.explode("sketch").alias("value"))
    count = each.groupBy("value").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    many = each.join(count, "value")
    kept = F.least(F.col("n"), F.lit(sketch))
    needed = F.when(
        F.col("n") <= int(similarity * sketch), F.ceil(F.col("n") * similarity)
    ).otherwise(shared)
    ranked = many.groupBy("rep", "n").agg(
        F.array_sort(F.collect_list(F.struct("times", "value"))).alias("values")
    )
    # Every class has at most ``sketch`` values here, so the list is bounded.
    length = kept - needed + 1 - (kept - F.size("values"))
    ranked = ranked.withColumn("values", F.slice("values", 1, F.greatest(length, F.lit(0)).cast("int")))
    lists = ranked.select("rep", "n", F.explode("values").alias("v")).select("v.value", "rep", "n")
    # Sizes that fit one another are in the same class of sizes or in neighbouring ones.
    size = F.floor(F.log("n") / (math.log(1 / similarity) + 1e-9))
    each = lists.withColumn("size", F.explode(F.array(size, size + 1)))
    met = each.groupBy("value", "size").agg(F.count(F.lit(1)).alias("met")).filter("met > 1")
    return each.join(met, ["value", "size"], "left_semi").select("value", "rep", "n").distinct()


def estimate(a: str, b: str, sketch: int):
    """Similarity of two sets from the sketch of their sketches' union."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, sketch)
    both = F.array_intersect(union, F.array_intersect(a, b))
    return F.size(both) / F.size(union)


def labelled(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Lists with their members' components, those that hold a single component left out."""
    if labels is None:
        rows = lists.withColumn("label", F.col("rep"))
    else:
        known = labels.select(F.col("node").alias("rep"), "label")
        rows = lists.join(known, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    ends = rows.groupBy("value").agg(F.min("label").alias("_low"), F.max("label").alias("_high"))
    return rows.join(ends.filter("_low <> _high").select("value"), "value", "left_semi")


def star_pairs(lists: DataFrame, members: int, first: int, similarity: float) -> DataFrame:
    """Each class (a) with the best of every choice of one member of its lists (b).

    ``lists`` have labels. The choices are by hashes numbered from ``first``, of the member alone, so that
    the lists of a group choose the same; the best is the one that meets in most lists. Members
    of the same component are no pair, nor are sets of too different sizes.
    """
    choices = [
        F.min_by(F.struct("rep", "label", "n"), F.xxhash64("rep", F.lit(i))).alias(f"c{i}")
        for i in range(first, first + members)
    ]
    chosen = lists.groupBy("value").agg(*choices)
    each = F.array(
        *[
            F.struct(F.lit(i).alias("kind"), F.col(f"c{i}").alias("to"))
            for i in range(first, first + members)
        ]
    )
    held = lists.join(chosen.select("value", each.alias("each")), "value").select(
        "rep", "label", "n", F.explode("each").alias("e")
    )
    sizes = F.least("n", "e.to.n") * 100 >= F.greatest("n", "e.to.n") * round(100 * similarity)
    held = held.filter("label <> e.to.label").filter(sizes)
    counted = held.groupBy("rep", F.col("e.kind").alias("kind"), F.col("e.to.rep").alias("to")).agg(
        F.count(F.lit(1)).alias("overlap")
    )
    best = counted.groupBy("rep", "kind").agg(F.max_by("to", F.struct("overlap", "to")).alias("to"))
    return best.select(F.col("rep").alias("a"), F.col("to").alias("b")).distinct()


def decided(pairs: DataFrame, sets: DataFrame, fits, name: str, first: int | None = None) -> DataFrame:
    """The distinct pairs (a, b) that fit by the full sets ``_a`` and ``_b`` of both, or the ``first`` values of them.

    A pair goes to the bucket of ``a``; from there the set goes on to ``b``, which may be in any number of
    pairs: that join has no bucket in it, so a hot partition of it can be split. The copies of the sets are deleted
    when the pairs are written.
    """
    values = F.col("set") if first is None else F.slice("set", 1, first)
    one = sets.select(F.col("doc_id").alias("a"), values.alias("_a"))
    ends = pairs.select(F.col("b").alias("doc_id")).distinct()
    two = stored(sets.join(ends, "doc_id", "left_semi").select(F.col("doc_id").alias("b"), values.alias("_b")), "ends")
    found = pairs.join(one, "a").join(two, "b").filter(fits)
    found = stored(found.select("a", "b").distinct(), name)
    forget(two)
    return found


def likely(pairs: DataFrame, sets: DataFrame, sketch: int, floor: float) -> DataFrame:
    """The pairs (a, b) whose estimate reaches the floor."""
    return decided(pairs, sets, estimate("_a", "_b", sketch) >= floor, "pairs", sketch)


def shingle_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """doc_id and full shingle set of the documents whose id is in ``ids`` (rep), in buckets by doc_id."""
    keys = ids.select(F.col("rep").alias("_id")).distinct()
    # The side of the ids is the one to be hashed; texts are neither sorted nor held.
    rows = packed(docs.select("doc_id", "text").filter("doc_id is not null"))
    rows = rows.join(keys.hint("shuffle_hash"), F.col("doc_id") == F.col("_id"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            sets = [shingler.hashes(t) for t in unpacked(batch.column("packed"))]
            arrays = [batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "set"])

    with shuffles_dropped(docs.sparkSession):
        return bucketed(rows.mapInArrow(run, "doc_id long, set array<long>"), "sets", "doc_id")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of document ids whose full shingle sets are similar enough."""
    both = F.size(F.array_intersect("_a", "_b"))
    percent = round(100 * similarity)
    fits = both * 100 >= (F.size("_a") + F.size("_b") - both) * percent
    return decided(pairs, sets, fits, "verified")


def oriented(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b), each with the end that is in fewer pairs as ``a``.

    No id is then the first of more pairs than the root of twice their number.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("_end")).groupBy("_end").count()
    for end in ("a", "b"):
        count = ends.select(F.col("_end").alias(end), F.col("count").alias(f"_{end}"))
        pairs = pairs.join(count, end)
    straight = (F.col("_a") < F.col("_b")) | ((F.col("_a") == F.col("_b")) & (F.col("a") < F.col("b")))
    one, two = F.when(straight, F.col("a")), F.when(straight, F.col("b"))
    return pairs.select(one.otherwise(F.col("b")).alias("a"), two.otherwise(F.col("a")).alias("b"))


def _follow(point: DataFrame) -> DataFrame:
    """Pointers (node, to) moved on to where their ends point; ``moved`` if that is elsewhere."""
    ahead = point.select(F.col("node").alias("_n"), F.col("to").alias("_t"))
    both = point.join(ahead, F.col("to") == F.col("_n"))
    return both.select("node", F.col("_t").alias("to"), (F.col("_t") != F.col("to")).alias("moved"))


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """node and label (the smallest node reachable) of all nodes of links (a, b).

    With ``known`` labels the links join what these have joined, and all their nodes are returned too. Every round points each node to its smallest neighbour, follows the pointers to their ends and
    contracts the links; the number of rounds grows with the logarithm of the nodes. Rounds are
    written to the shared folder, so nothing long is ever recomputed.
    """
    edges = links.select("a", "b").filter("a <> b")
    labels = known
    if known is not None:
        for end in ("a", "b"):
            step = known.select(F.col("node").alias("_n"), "label")
            edges = edges.join(step, F.col(end) == F.col("_n"), "left")
            edges = edges.withColumn(end, F.coalesce("label", end)).drop("_n", "label")
    edges = stored(edges.filter("a <> b").distinct(), "links")
    while not edges.isEmpty():
        ends = edges.select("a", "b").union(edges.select("b", "a"))
        point = ends.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to"))
        point = stored(point.select(F.col("a").alias("node"), "to"), "pointers")
        while True:
            # Two doublings a job: four steps along the pointers.
            ahead = _follow(_follow(point))
            point = stored(ahead, "pointers")
            if point.filter("moved").isEmpty():
                break
        step = point.select(F.col("node").alias("_n"), "to")
        if labels is None:
            labels = point.select("node", F.col("to").alias("label"))
        else:
            labels = (
                labels.join(step, F.col("label") == F.col("_n"), "full")
                .select(F.coalesce("node", "_n").alias("node"), F.coalesce("to", "label").alias("label"))
            )
            # A node that had no label may be the label of others.
            labels = labels.groupBy("node").agg(F.min("label").alias("label"))
        labels = stored(labels, "labels")
        one = point.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        two = point.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        edges = edges.join(one, "a").join(two, "b").filter("ta <> tb")
        edges = stored(edges.select(F.col("ta").alias("a"), F.col("tb").alias("b")).distinct(), "links")
    if labels is None:
        labels = links.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0)
    return labels


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Number of values that every left and every right set share.

    Frequent values are columns of a table whose halves are multiplied; for the others their few pairs
    of owners are counted.
    """
    shape = (len(left), len(right))
    sizes = [len(x) for x in left], [len(x) for x in right]
    values, place, times = np.unique(
        np.concatenate([*left, *right]), return_inverse=True, return_counts=True
    )
    split = sum(sizes[0])
    owners = [np.repeat(np.arange(n), k) for n, k in zip(shape, sizes)]
    places = [place[:split], place[split:]]
    out = np.zeros(shape, np.float32)
    often = times >= OFTEN
    column = np.cumsum(often) - 1
    for start in range(0, int(often.sum()), STEP_VALUES):
        tables = []
        for n, owner, at in zip(shape, owners, places):
            part = often[at] & (column[at] >= start) & (column[at] < start + STEP_VALUES)
            table = np.zeros((n, STEP_VALUES), np.float32)
            table[owner[part], column[at[part]] - start] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    # Owners of each other value on the right stand together.
    rare = [~often[at] & (times[at] > 1) for at in places]
    order = np.argsort(places[1][rare[1]], kind="stable")
    there, at = owners[1][rare[1]][order], places[1][rare[1]][order]
    mine, wanted = owners[0][rare[0]], places[0][rare[0]]
    first = np.searchsorted(at, wanted, side="left")
    count = np.searchsorted(at, wanted, side="right") - first
    ends = np.cumsum(count)
    for low in range(0, int(ends[-1]) if len(ends) else 0, STEP_RARE):
        i = np.searchsorted(ends, low, side="right")
        j = np.searchsorted(ends, low + STEP_RARE, side="right") + 1
        some = count[i:j]
        inside = np.arange(int(some.sum())) - np.repeat(np.cumsum(some) - some, some)
        met = inside + np.repeat(ends[i:j] - some, some)
        met = (met >= low) & (met < low + STEP_RARE)
        pair = np.repeat(mine[i:j], some) * shape[1] + there[np.repeat(first[i:j], some) + inside]
        out += np.bincount(pair[met], minlength=shape[0] * shape[1]).reshape(shape)
    return out


def _estimates(a: np.ndarray, b: np.ndarray, sketch: int) -> np.ndarray:
    """Similarities of padded sketches row by row, from the sketch of their union."""
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    again = np.zeros(both.shape, bool)
    again[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] < _PAD)
    rank = np.cumsum(~again & (both < _PAD), axis=1)
    shared = (again & (rank <= sketch)).sum(axis=1)
    return shared / np.minimum(sketch, np.maximum(1, rank[:, -1]))


_PAD = np.iinfo(np.int32).max


def bundles(lists: DataFrame) -> DataFrame:
    """Lists with labels as bundles: bundle, rep, n, label, members, main, others.

    Lists that choose the same member by its hash are one bundle. ``main`` is the label of most members, ``others`` the number
    of members with another one; bundles without are left out.
    """
    chosen = lists.groupBy("value").agg(F.min_by("rep", F.xxhash64("rep", F.lit(0))).alias("bundle"))
    rows = lists.join(chosen, "value").groupBy("bundle", "rep").agg(
        F.any_value("n").alias("n"), F.any_value("label").alias("label")
    )
    rows = stored(rows, "bundles")
    labels = rows.groupBy("bundle", "label").agg(F.count(F.lit(1)).alias("times"))
    facts = labels.groupBy("bundle").agg(
        F.sum("times").alias("members"),
        F.max_by("label", F.struct("times", "label")).alias("main"),
        (F.sum("times") - F.max("times")).alias("others"),
    )
    return rows.join(facts.filter("others > 0"), "bundle")


def open_pairs(
    lists: DataFrame, sets: DataFrame, similarity: float, sketch: int, shared: int
) -> DataFrame:
    """Pairs (a, b) of one list, of different components, whose sizes and estimate fit.

    Sets of up to ``FINE`` shingles are compared whole, by the upper 31 bits of their hashes; larger ones by
    their ``FINE`` smallest, with a margin. The exact test follows. Members of a bundle outside its main component are cut into
    blocks by a hash, and so are all its members; every two blocks of the two kinds meet in a task of their own, so a hot bundle is
    spread over many tasks and its main component moves once where the others are few. A pair that
    meets in several bundles is looked at in the smallest of them only.
    """
    rows = stored(bundles(lists), "bundled")
    order = F.array_sort(F.collect_list(F.struct("members", "bundle")))
    # As many as the sketch has values, at most.
    own = rows.groupBy("rep").agg(F.transform(order, lambda x: x["bundle"]).alias("every"))
    hashed = F.xxhash64("rep", "bundle")
    others, members = (F.ceil(F.col(c) / BLOCK) for c in ("others", "members"))
    count = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    is_other = F.col("label") != F.col("main")
    # As one of the others against all blocks, and as one of all against all blocks of others.
    one = F.transform(
        F.when(is_other, count(members)).otherwise(F.array().cast("array<bigint>")),
        lambda j: F.struct(F.lit(True).alias("left"), F.pmod(hashed, others).alias("i"), j.alias("j")),
    )
    all_ = F.transform(
        count(others),
        lambda i: F.struct(F.lit(False).alias("left"), i.alias("i"), F.pmod(hashed, members).alias("j")),
    )
    # The bundles before this one.
    before = F.slice("every", 1, F.array_position("every", F.col("bundle")).cast("int") - 1)
    placed = rows.withColumn("side", F.explode(F.concat(one, all_))).withColumn("other", is_other)

    def with_sketch(cells: DataFrame, first: int) -> DataFrame:
        smallest = F.transform(F.slice("set", 1, first), lambda x: F.shiftright(x, 32).cast("int"))
        return cells.join(sets.select(F.col("doc_id").alias("rep"), smallest.alias("sketch")), "rep")

    placed = with_sketch(placed.join(own, "rep"), sketch).select(
        "bundle", "side.i", "side.j", "side.left", "rep", "n", "label", "other", before.alias("before"), "sketch"
    )
    kept = [f for f in placed.schema if f.name != "sketch"]

    def rough(cell: pa.Table) -> pa.Table:
        cell_ = _Cell(cell, similarity)
        i, j, _ = cell_.rough(sketch, shared)
        return cell.take(pa.array(np.concatenate([i, j]))).select([f.name for f in kept])

    # What no member of its cell resembles by the small sketch goes no further.
    schema = StructType(kept)
    near = stored(placed.groupBy("bundle", "i", "j").applyInArrow(rough, schema), "cells")

    def run(cell: pa.Table) -> pa.Table:
        a, b = _Cell(cell, similarity).alike(sketch, shared)
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    found = with_sketch(near, FINE).groupBy("bundle", "i", "j").applyInArrow(run, "a long, b long")
    return oriented(stored(found.filter("a <> b").distinct(), "found"))


class _Cell:
    """Two blocks of a bundle: the members on the left, of which all are others, and on the right."""

    def __init__(self, cell: pa.Table, similarity: float):
        self.cell, self.similarity = cell, similarity
        self.rep, self.n = cell.column("rep").to_numpy(), cell.column("n").to_numpy()
        label = cell.column("label").to_numpy()
        left = cell.column("left").to_numpy(zero_copy_only=False)
        other = cell.column("other").to_numpy(zero_copy_only=False)
        self.i, self.j = i, j = np.flatnonzero(left), np.flatnonzero(~left)
        fits = label[i][:, None] != label[j][None, :]
        fits &= np.minimum(self.n[i][:, None], self.n[j]) >= similarity * self._larger()
        # Two of the others meet twice.
        fits &= ~other[j][None, :] | (self.rep[i][:, None] < self.rep[j][None, :])
        self._keep(fits)
        if len(self.i):
            before = self._lists("before")
            self._keep(self.fits & (_overlaps(*before) == 0))

    def _keep(self, fits: np.ndarray) -> None:
        """Only members with a partner stay."""
        rows, columns = fits.any(axis=1), fits.any(axis=0)
        self.i, self.j, self.fits = self.i[rows], self.j[columns], fits[np.ix_(rows, columns)]

    def _larger(self) -> np.ndarray:
        return np.maximum(self.n[self.i][:, None], self.n[self.j])

    def _lists(self, column: str, first: int | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
        values = self.cell.column(column).combine_chunks()
        flat, ends = values.values.to_numpy(), values.offsets.to_numpy()
        one = lambda k: np.unique(flat[ends[k] : ends[k + 1]][:first])
        return [one(k) for k in self.i.tolist()], [one(k) for k in self.j.tolist()]

    def rough(self, sketch: int, shared: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Members on either side, and which pairs share enough of the small sketch."""
        if len(self.i):
            larger = self._larger()
            least = np.where(larger <= sketch, self.similarity * larger - 1, shared)
            self._keep(self.fits & (_overlaps(*self._lists("sketch", sketch)) >= least))
        return self.i, self.j, self.fits

    def alike(self, sketch: int, shared: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pairs that stay, the smaller first, by whole small sets or fine sketches."""
        self.rough(sketch, shared)
        if not len(self.i):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        n, rep, similarity = self.n, self.rep, self.similarity
        floor = similarity - DEVIATIONS * (similarity * (1 - similarity) / FINE) ** 0.5
        larger, sketches = self._larger(), self._lists("sketch")
        both = _overlaps(*sketches)
        # Two hashes may agree in their upper bits by chance, once in many sets.
        whole = both + 1 >= similarity * (n[self.i][:, None] + n[self.j] - both)
        fits = self.fits & np.where(larger <= FINE, whole, both >= floor * np.minimum(FINE, larger))
        x, y = np.nonzero(fits)
        good = np.maximum(n[self.i[x]], n[self.j[y]]) <= FINE
        rest = np.flatnonzero(~good)
        for start in range(0, len(rest), STEP_PAIRS):
            at = rest[start : start + STEP_PAIRS]
            padded = np.full((2, len(at), FINE), _PAD, np.int32)
            for side, ends in enumerate((x[at], y[at])):
                for row, k in enumerate(ends.tolist()):
                    padded[side, row, : len(sketches[side][k])] = sketches[side][k]
            good[at] = _estimates(padded[0], padded[1], FINE) >= floor
        x, y = rep[self.i[x]][good], rep[self.j[y]][good]
        return np.minimum(x, y), np.maximum(x, y)


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    similarity: float = 0.8,
    sketch: int = SKETCH,
    shared: int = SHARED,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Components of near-duplicate documents: doc_id, n_shingles, component_id, kept.

    Words are what stands between ASCII blanks, A-Z in lower case; a shingle is ``words`` words in a
    row, a text with fewer is one shingle. Documents are linked if their sets' intersection is at
    least ``similarity`` of their union; ``component_id`` is the smallest id reachable, ``kept`` says that it
    is the document's own. A null, empty or blank text has no shingles and is linked with
    nothing. A null id is linked with nothing: its component and ``kept`` are null. Rows that share
    an id are one document with several texts; each row is returned. An empty table gives no rows;
    other columns are ignored.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    every = stored(profiles(rows, words, sketch), "profiles")
    some = every.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = some.groupBy("set_hash").agg(
        F.min("doc_id").alias("rep"),
        F.any_value("n_shingles").alias("n"),
        F.any_value("sketch").alias("sketch"),
    )
    sketched = stored(classes, "classes")
    lists = stored(prefix_postings(sketched, sketch, shared, similarity), "lists")
    # Sketches are used up; the rest is small.
    classes = stored(sketched.drop("sketch"), "classes")
    some = stored(every.drop("sketch"), "documents")
    forget(sketched)
    forget(every)
    every = some
    some = every.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    floor = similarity - MARGIN
    sets = shingle_sets(rows, lists, words)
    # A document with several texts joins their classes.
    member = some.join(classes.select("set_hash", "rep"), "set_hash").select("doc_id", "rep")
    joined = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("_high"))
    joined = joined.filter("a <> _high").select("doc_id", "a").join(member.distinct(), "doc_id")
    links = stored(joined.select("a", F.col("rep").alias("b")), "links")
    labels = components(links)
    left = stored(labelled(lists, labels), "open")
    for turn, members in enumerate([*STARS, None]):
        if left.isEmpty():
            break
        if members is None:
            pairs = stored(open_pairs(left, sets, similarity, sketch, shared), "pairs")
        else:
            stars = stored(star_pairs(left, members, sum(STARS[:turn]), similarity), "stars")
            pairs = likely(stars, sets, sketch, floor)
        more = verified(pairs, sets, similarity)
        if not more.isEmpty():
            # Components that are known already shrink to their label.
            labels = components(more, labels)
            if members is not None:
                left = stored(labelled(lists, labels), "open")
    found = classes.select("set_hash", "rep").join(
        labels.select(F.col("node").alias("rep"), "label"), "rep", "left"
    )
    found = found.select("set_hash", F.coalesce("label", "rep").alias("_component"))
    result = every.select("doc_id", "n_shingles", "set_hash").join(found, "set_hash", "left")
    alone = F.col("n_shingles") == 0
    component = F.when(
        F.col("doc_id").isNotNull(), F.when(alone, F.col("doc_id")).otherwise(F.col("_component"))
    )
    result = result.select("doc_id", "n_shingles", component.alias("component_id"))
    return result.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The input's rows without those of documents that are near-duplicates of a smaller id.

    Rows that share an id are one document; one of them stays. Rows with a null id all stay.
    """
    found = stored(near_duplicates(docs, id_col=id_col, **options), "near")
    # The input's columns in one, so that no name can clash.
    rows = docs.select(whole_row(docs), F.col(id_col).cast("long").alias("id"))
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    left = rows.join(gone.hint("shuffle_hash"), F.col("id") == F.col("gone"), "left_anti")
    again = found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1")
    if not again.isEmpty():
        many = F.col("id") == F.col("doc_id")
        once = left.join(again, many, "left_semi").dropDuplicates(["id"])
        left = left.join(again, many, "left_anti").unionByName(once)
    return left.select("row.*")
