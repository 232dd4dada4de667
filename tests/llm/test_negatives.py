"""Hard negatives against all scores, and how far the threshold algorithm reads."""

import numpy as np
import pandas as pd
import pytest

from pulseline.llm import negatives
from pulseline.llm.negatives import Lists, hard_negatives
from pulseline.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(ids, vectors, labels, anchors, low=80, high=100, k=5):
    """Rows as ``hard_negatives`` returns them, from all scores."""
    v = np.floor(np.asarray(vectors, float) * 256).astype(np.int64)
    out = []
    for a in anchors:
        at = int(np.flatnonzero(ids == a)[0])
        scores = v @ v[at]
        order = np.lexsort((ids, -scores))
        same = [i for i in order if labels[i] == labels[at] and i != at][:k]
        for p in same:
            inside = [
                i
                for i in order
                if labels[i] != labels[at] and low * scores[p] <= 100 * scores[i] <= high * scores[p]
            ]
            for rank, i in enumerate(inside[:k], 1):
                out.append((a, ids[p], rank, ids[i], scores[p], scores[i]))
    return sorted(tuple(map(int, r)) for r in out)


def run(spark, ids, vectors, labels, anchors, **options):
    rows = [(int(i), [float(x) for x in v], int(y)) for i, v, y in zip(ids, vectors, labels)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = hard_negatives(df, df.filter(df.vec_id.isin([int(a) for a in anchors])), **options)
    return sorted(tuple(r) for r in got.collect())


def test_given_vectors(spark):
    given = pd.read_parquet("/root/testdata/sf0.1/embeddings.parquet").sort_values("vec_id")
    ids, labels = given.vec_id.to_numpy(), given.label.to_numpy()
    labels = np.where(ids % 7 == 0, (labels + 1) % 10, labels)
    got = sorted(tuple(r) for r in QUERIES["op12_negatives"](spark, "/root/testdata/sf0.1").collect())
    assert got == plain(ids, np.stack(given.embedding), labels, ids[ids % 100 == 0])


def test_several_blocks_and_a_hot_label(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 100)
    monkeypatch.setattr(negatives, "ANCHORS", 8)
    draw = np.random.default_rng(5)
    ids, labels = np.arange(900), np.where(draw.random(900) < 0.4, 0, draw.integers(1, 5, 900))
    vectors = draw.standard_normal((900, 12)).astype(np.float32)
    anchors = ids[ids % 30 == 0]
    want = plain(ids, vectors, labels, anchors)
    assert want and run(spark, ids, vectors, labels, anchors) == want
    assert run(spark, ids, vectors, labels, anchors, low=50, high=90) == plain(
        ids, vectors, labels, anchors, 50, 90
    )


def test_ties_and_equal_vectors(spark):
    ids, labels = np.arange(60), np.arange(60) % 2
    vectors = np.ones((60, 3), np.float32)
    vectors[40:] = 0.5
    anchors = [0, 41]
    got = run(spark, ids, vectors, labels, anchors)
    assert got == plain(ids, vectors, labels, anchors)
    assert [r[1] for r in got if r[0] == 0 and r[2] == 1] == [2, 4, 6, 8, 10]


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [1.0 + i / 64, -0.5, 0.0], i % 2) for i in range(1, 30)]
    bad = [
        (100, None, 1),
        (101, [1.0, None, 0.0], 1),
        (102, [nan, 1.0, 0.0], 0),
        (103, [inf, 1.0, 0.0], 0),
        (104, [9.0, 9.0, 9.0], None),
        (None, [9.0, 9.0, 9.0], 1),
        (105, [], 1),
        (106, [9.0, 9.0], 1),
        (107, [0.0, 0.0, 0.0], 1),
    ]
    extra = "id label_ v dim block group scores ids anchor_id rank place one"
    df = spark.createDataFrame(good + good[:4] + bad, SCHEMA)
    for c in extra.split():
        df = df.withColumn(c, df.vec_id.cast("string"))
    anchors = df.filter("vec_id in (4, 9, 100, 102, 104, 106, 107)")
    got = sorted(tuple(r) for r in hard_negatives(df, anchors).collect())
    kept = [*good, (107, [0.0, 0.0, 0.0], 1)]
    ids, vectors, labels = (np.array(x) for x in zip(*kept))
    assert got == plain(ids, vectors, labels, [4, 9, 107])
    none = df.limit(0)
    assert hard_negatives(none, none).count() == 0 and hard_negatives(df, none).count() == 0
    assert hard_negatives(none, none).columns == hard_negatives(df, anchors).columns


@pytest.mark.parametrize("seed", range(3))
def test_reading_stops_early_where_scores_fall_fast(seed):
    draw = np.random.default_rng(seed)
    n = 4000
    # One dimension decides, so the threshold falls with it.
    vectors = np.c_[draw.integers(0, 100_000, n), draw.integers(0, 10, (n, 3))]
    lists = Lists(np.arange(n), vectors, draw.integers(0, 3, n))
    anchor = np.array([100, 1, -1, 1])
    best, scores = lists.positives(-1, anchor, 5)
    all_scores = vectors @ anchor
    assert scores.tolist() == np.sort(all_scores)[::-1][:5].tolist()
    met = next(int(met.sum()) for met, _, threshold in lists.access(anchor) if threshold < scores[-1])
    assert 5 <= met < n / 10


def test_threshold_bounds_what_is_not_met():
    draw = np.random.default_rng(1)
    vectors = draw.integers(-50, 50, (300, 6))
    lists = Lists(np.arange(300), vectors, np.zeros(300, int))
    for _ in range(20):
        anchor = draw.integers(-50, 50, 6)
        for met, scores, threshold in lists.access(anchor):
            assert (scores[met] == (vectors @ anchor)[met]).all()
            assert met.all() or (vectors[~met] @ anchor).max() <= threshold
