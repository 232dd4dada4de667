"""First-seen upsert, windows from panes and pages by rank."""

import random
import re

import pytest
from conftest import DAY_START, rows
from pyspark.sql import functions as F

from pulseline.operators import paging, rollups
from pulseline.schema import ACTIVITY_SCHEMA
from pulseline.streaming import panes, seen

DAY = 86400
BUCKETS = 4


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _table(tmp_path, name):
    return name, str(tmp_path / name)


def _visits(act, *spec):
    return act(*[dict(user_cookie=u, hostname=h, timestamp=DAY_START + d * DAY) for u, h, d in spec])


def test_a_batch_appends_only_what_is_new(spark, act, tmp_path):
    name, path = _table(tmp_path, "seen_new")

    def append(*spec):
        before = seen.open_table(spark, name, path, BUCKETS).collect()
        seen.append_unseen(_visits(act, *spec), name, path, BUCKETS)
        after = [tuple(r) for r in seen.open_table(spark, name, path, BUCKETS).collect()]
        for r in before:
            after.remove(tuple(r))
        return sorted(after)

    first = (("u1", "a", 1), ("u1", "a", 3), ("u2", "a", 1), ("", "a", 2), ("u1", "b", 4))
    assert append(*first) == [("", "a", 20240117), ("u1", "a", 20240116), ("u1", "b", 20240119), ("u2", "a", 20240116)]
    assert append(*first) == []  # a replay
    assert append(("u1", "a", 9), ("u3", "a", 9)) == [("u3", "a", 20240124)]
    assert append(("u1", "b", 2)) == [("u1", "b", 20240117)]  # a late event with an earlier day
    assert append(("u1", "b", 3)) == []
    assert append() == []
    want = [("", "a", 20240117), ("u1", "a", 20240116), ("u1", "b", 20240117), ("u2", "a", 20240116), ("u3", "a", 20240124)]
    assert rows(seen.read_seen(spark, name, path, BUCKETS)) == want
    new_name, new_path = _table(tmp_path, "seen_folded")
    seen.compact(spark, name, path, new_name, new_path, BUCKETS)
    assert rows(spark.read.parquet(new_path)) == want
    # Another session's catalog does not know the table; its files are enough.
    spark.sql(f"DROP TABLE {new_name}")
    seen.append_unseen(_visits(act, ("u1", "a", 5), ("u4", "a", 5)), new_name, new_path, BUCKETS)
    assert rows(seen.read_seen(spark, new_name, new_path, BUCKETS)) == [*want, ("u4", "a", 20240120)]


def test_the_base_is_not_moved(spark, act, tmp_path):
    name, path = _table(tmp_path, "seen_plan")
    seen.append_unseen(_visits(act, ("u1", "a", 1)), name, path, BUCKETS)
    table = seen.open_table(spark, name, path, BUCKETS)
    text = plan(seen.unseen(_visits(act, ("u1", "a", 2)), table, BUCKETS))
    lines = text.splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    at = next(i for i, line in enumerate(lines) if "Scan parquet" in line and name in line)
    assert "Bucketed: true" in lines[at]
    join = max(i for i in range(at) if "Join" in lines[i])
    assert "ShuffledHashJoin" in lines[join] and "BuildLeft" in lines[join]
    above, level = [], depth(lines[at])
    for i in range(at - 1, join, -1):
        if depth(lines[i]) < level:
            above.append(lines[i])
            level = depth(lines[i])
    assert not any("Exchange" in line for line in above)
    assert "Exchange" not in plan(seen.read_seen(spark, name, path, BUCKETS))


def test_windows_from_panes(spark, act, tmp_path):
    rng = random.Random(2)
    spec = [
        dict(timestamp=DAY_START + rng.randrange(9000), user_cookie=rng.choice(("", "u1", "u2", "u3")), is_bot=int(rng.random() < 0.2))
        for _ in range(150)
    ] + [dict(timestamp=DAY_START + 50_000, user_cookie="u1"), dict(timestamp=DAY_START + 50_000, user_cookie="u1")]
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for part in (spec[:70], spec[70:]):
        act(*part).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ACTIVITY_SCHEMA).parquet(source)
        panes.keep_panes(stream, path, checkpoint, interval=None).awaitTermination()
    hits, users = {}, {}
    for r in spec:
        if not r.get("is_bot"):
            minute = r["timestamp"] // 60 * 60
            for start in range(minute - 4 * 60, minute + 1, 60):
                hits[start] = hits.get(start, 0) + 1
                users.setdefault(start, set()).add(r["user_cookie"])
    kept = panes.read_panes(spark, path)
    assert dict(rows(panes.sliding_hits(kept, 5))) == hits
    assert dict(rows(panes.sliding_users(kept, 5))) == {s: len(u) for s, u in users.items()}
    one = panes.sliding_users(kept, 1)
    assert rows(one) == rows(kept.groupBy("minute").agg(F.count("*")))
    none = kept.filter("minute < 0")
    assert panes.sliding_hits(none, 5).count() == panes.sliding_users(none, 5).count() == 0
    # No event is copied before it is a pane.
    text = plan(panes.panes(act(*spec)))
    assert "Expand" not in text and "Generate" not in text


@pytest.mark.parametrize("hot", [False, True])
def test_pages_by_rank(spark, hot):
    data = [(0 if hot else i * 37 % 101, None if i % 7 == 0 else f"k{i * 13 % 400:03d}", i % 3, i) for i in range(400)]
    df = spark.createDataFrame(data, "a int, b string, range int, RANGE_ int").repartition(5)
    order = [F.desc("a"), F.asc_nulls_last("b"), "RANGE_"]
    ranks = paging.ranked(df, order, ranges=8)
    assert ranks.total == 400 and len(ranks.counts) > 4 and max(n for _, n in ranks.counts) < 200
    want = [tuple(r) for r in df.orderBy(*order).collect()]
    for offset, limit in ((0, 10), (5, 400), (199, 7), (390, 50), (50, 0), (400, 5), (1000, 5)):
        page = paging.ranked_page(ranks, limit, offset)
        assert page.columns == df.columns
        assert [tuple(r) for r in page.collect()] == want[offset : offset + limit]
    # Only the ranges of the page are read.
    ends = [sum(n for _, n in ranks.counts[: i + 1]) for i in range(len(ranks.counts))]
    holds = next(r for (r, _), end in zip(ranks.counts, ends) if end > 200)
    text = plan(paging.ranked_page(ranks, 1, 200))
    assert re.search(rf"PartitionFilters: \[[^]]*\({ranks.range_name}#\d+ = {holds}\)\]", text)


def test_no_rows_no_pages(spark):
    ranks = paging.ranked(spark.createDataFrame([], "a int"), ["a"], ranges=4)
    assert ranks.total == 0
    assert paging.ranked_page(ranks, 5).count() == 0
