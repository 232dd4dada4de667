"""Exact live slots over restarts and expiry, the alert table, bitmap and theta states, the single parse."""

import datetime

import pandas as pd
import pytest
from conftest import DAY_START, rows
from pyspark import TaskContext
from pyspark.sql import functions as F

from pulseline.functions.timefn import slot_start
from pulseline.operators import rollups
from pulseline.plans import registry
from pulseline.schema import ACTIVITY_SCHEMA
from pulseline.session import stored
from pulseline.sources import alert_table, ingest, testdata
from pulseline.streaming import jobs, live


def _events(act, spec):
    return act(*[dict(timestamp=DAY_START + s, hostname=h, user_cookie=u, is_bot=b) for s, h, u, b in spec])


def test_open_slots_over_a_restart_and_expiry(spark, act, tmp_path):
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))

    def feed(*spec):
        _events(act, spec).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ACTIVITY_SCHEMA).parquet(source)
        live.keep_users(stream, path, checkpoint, interval=None, parts=2).awaitTermination()
        got = live.read_users(spark, path)
        return {(r.slot_start - DAY_START, r.hostname): r.active_users for r in got.collect()}

    first = feed((5, "a", "u1", 0), (9, "a", "u1", 0), (20, "a", "u2", 0), (30, "b", "u1", 0), (40, "a", "bot", 1))
    assert first == {(0, "a"): 2, (0, "b"): 1}
    # A restart knows whom it has seen; a user counts again in the next slot.
    second = feed((50, "a", "u1", 0), (60, "a", "u3", 0), (700, "a", "u1", 0))
    assert second == {(0, "a"): 3, (0, "b"): 1, (600, "a"): 1}
    # Hours later the first slots are closed: their state is gone and late rows change nothing.
    feed((20_000, "c", "u9", 0))
    third = feed((70, "a", "u8", 0), (20_100, "c", "u9", 0))
    assert third == second | {(19_800, "c"): 1}
    state = spark.read.format("statestore").option("stateVarName", "seen").load(checkpoint)
    held = {r.cookie for r in state.select(F.col("user_map_key.user_cookie").alias("cookie")).collect()} if (
        "user_map_key" in state.columns
    ) else None
    assert held in (None, {"u9"})
    assert live.read_users(spark, path, since=DAY_START + 600).count() == 2


def test_lists_go_on_over_a_restart_and_are_cleared(spark, act, tmp_path):
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))

    def feed(*spec):
        _events(act, spec).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ACTIVITY_SCHEMA).parquet(source)
        live.keep_users(stream, path, checkpoint, interval=None, parts=1).awaitTermination()
        state = spark.read.format("statestore").option("stateVarName", "seen").load(checkpoint)
        return sorted(tuple(r[0]) for r in state.select("list_element").collect())

    slot = DAY_START
    assert feed((5, "a", "u1", 0), (6, "a", "u1", 0)) == [(slot, '{"a": ["u1"]}')]
    # Only what is new is added; a batch without anything new adds nothing.
    both = [(slot, '{"a": ["u1"]}'), (slot, '{"a": ["u2"]}'), (slot + 600, '{"a": ["u1"]}')]
    assert feed((7, "a", "u1", 0), (8, "a", "u2", 0), (601, "a", "u1", 0)) == both
    assert feed((9, "a", "u1", 0), (602, "a", "u1", 0)) == both
    assert feed((20_000, "c", "u9", 0)) == [(slot + 19_800, '{"c": ["u9"]}')]


def test_few_files_do_not_make_few_tasks(spark, tmp_path):
    def tasks(frames):
        for df in frames:
            yield pd.DataFrame({"id": df.id, "task": TaskContext.get().partitionId()})

    path = str(tmp_path / "out")
    jobs.write_batch(spark.range(400, numPartitions=4).mapInPandas(tasks, "id bigint, task int"), path, 0, files=1)
    got = spark.read.parquet(path)
    assert got.select("task").distinct().count() == 4
    assert len(got.inputFiles()) == 1 and sorted(r.id for r in got.collect()) == list(range(400))


def test_partitions_of_the_state(spark, act, tmp_path):
    source = str(tmp_path / "in")
    _events(act, [(i * 300, "ab"[i % 2], f"u{i % 7}", 0) for i in range(60)]).write.parquet(source)
    before, got = spark.conf.get(live.SHUFFLE), []
    for n in (None, 3):
        path, checkpoint = (str(tmp_path / f"{x}{n}") for x in ("out", "checkpoint"))
        stream = spark.readStream.schema(ACTIVITY_SCHEMA).parquet(source)
        live.keep_users(stream, path, checkpoint, interval=None, partitions=n).awaitTermination()
        held = spark.read.format("state-metadata").load(checkpoint).first().numPartitions
        assert (held, spark.conf.get(live.SHUFFLE)) == (n or int(before), before)
        got.append(rows(live.read_users(spark, path)))
    assert got[0] == got[1] and sum(users for _, _, users in got[0]) == 60


def test_batches_in_order_have_several_files(spark, tmp_path):
    day, given = datetime.datetime(2024, 1, 15), str(tmp_path / "events.parquet")
    schema = testdata.SCHEMAS["events"]
    # Files follow one another in time, so a batch has rows of some tasks only; many events share a second.
    for f in range(8):
        at = [day + datetime.timedelta(minutes=40 * f if i % 2 else 40 * f + i) for i in range(12)]
        part = [(f * 12 + i, ts, f * 5 + i, "view", 0.0, '{"k": 3}') for i, ts in enumerate(at)]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(given)
    pages = [(i, f"http://h{i % 3}.example.com/{i}", "") for i in range(10)]
    spark.createDataFrame(pages, testdata.SCHEMAS["pages"]).write.parquet(str(tmp_path / "pages.parquet"))

    t = registry.Tables(spark, str(tmp_path))
    t.dir = lambda name: str(tmp_path / f"made-{name}")
    registry._in_order(t, 3)
    files = sorted((tmp_path / "made-events").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    n = len(files) // 3
    assert n > 1 and len(files) == 3 * n
    batches = [spark.read.schema(schema).parquet(*map(str, files[i * n : (i + 1) * n])) for i in range(3)]
    ids = [{r.event_id for r in b.collect()} for b in batches]
    assert sum(map(len, ids)) == 96 and set().union(*ids) == set(range(96))
    ends = [b.agg(F.min("ts"), F.max("ts")).first() for b in batches]
    assert ends[0][1] < ends[1][0] and ends[1][1] < ends[2][0]

    people = t.ua.filter("is_bot = 0").groupBy(slot_start("timestamp").alias("slot_start"), "hostname")
    want = people.agg(F.countDistinct("user_cookie").alias("active_users"))
    assert rows(registry.QUERIES["stream_open_slots"](spark, str(tmp_path))) == rows(want)


def _alerts(spark, *found):
    schema = "ip string, threat_type string, timestamp bigint"
    names = {f.name for f in alert_table.ALERT_SCHEMA}
    df = spark.createDataFrame(list(found), schema)
    missing = [f for f in alert_table.ALERT_SCHEMA if f.name not in df.columns]
    assert {"ip", "threat_type", "timestamp"} <= names
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})


def test_alert_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "alerts")
    assert alert_table.read_alerts(spark, path).count() == 0
    read = lambda: rows(alert_table.read_alerts(spark, path), "ip", "timestamp")
    alert_table.add_alerts(_alerts(spark, ("1.1.1.1", "x", 1), ("2.2.2.2", "x", 2), ("1.1.1.1", "y", 3)), path)
    alert_table.dismiss(spark.createDataFrame([("1.1.1.1",), ("9.9.9.9",), (None,)], "ip string"), path)
    assert read() == [("2.2.2.2", 2)]
    # Later alerts of a dismissed address show.
    alert_table.add_alerts(_alerts(spark, ("1.1.1.1", "x", 4)), path)
    before = [("1.1.1.1", 4), ("2.2.2.2", 2)]
    assert read() == before
    # A change that fails before it is named changes nothing, and its number is used again.
    with monkeypatch.context() as m:
        m.setattr(alert_table, "CHANGE_LIST", "seq bigint, no such type")
        with pytest.raises(Exception):
            alert_table.dismiss(spark.createDataFrame([("2.2.2.2",)], "ip string"), path)
    assert read() == before
    alert_table.compact(spark, path)
    assert read() == before
    alert_table.dismiss(spark.createDataFrame([("2.2.2.2",)], "ip string"), path)
    assert read() == [("1.1.1.1", 4)]
    alert_table.compact(spark, path)
    alert_table.add_alerts(_alerts(spark, ("2.2.2.2", "z", 5)), path)
    assert read() == [("1.1.1.1", 4), ("2.2.2.2", 5)]


def test_bitmap_and_theta_states(spark, act):
    day = 86400
    spec = [(d * day + i, "h", f"u{(i * 7 + d * 3) % 40}", int(i % 9 == 0)) for d in range(12) for i in range(25)]
    ua = _events(act, spec)
    numbers = stored(rollups.cookie_numbers(ua), "numbers")
    states = rollups.bitmap_states(ua, numbers).cache()
    by_day = {}
    for s, _, u, bot in spec:
        if not bot:
            by_day.setdefault(s // day, set()).add(u)
    assert rollups.bitmap_users(states).first().users == len(set().union(*by_day.values()))
    got = {r.date_num - 20240115: r.users for r in rollups.bitmap_users(states, by=["date_num"]).collect()}
    assert got == {d: len(u) for d, u in by_day.items()}
    new = rollups.new_against_before(rollups.user_sets(ua), days=3).collect()
    want = {d: (len(u), len(u - set().union(*(by_day[x] for x in range(max(0, d - 3), d))))) for d, u in by_day.items()}
    assert {r.date_num - 20240115: (r.users, r.new_users) for r in new} == want


def test_messages_are_parsed_once(spark):
    df = spark.createDataFrame([('{"id": 1}',)], "value string")
    good, _ = ingest.normalize_events(df)
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 or plan.count("JsonToStructs") == 1


@pytest.mark.parametrize(
    "given, want",
    [
        ("7", 7), ('"7"', 7), ("7.9", 7), ('"7.9"', None), ("1e3", 1000), ('"x"', None), ("null", 0),
        ('""', None), ("true", None), ("-3", -3), ("12345678901234567890123", None), ("[1]", None),
    ],
)
def test_numbers_in_messages(spark, given, want):
    df = spark.createDataFrame([(f'{{"timestamp": {given}, "url": "u"}}',)], "value string")
    good, bad = ingest.normalize_events(df)
    assert [r.timestamp for r in good.collect()] == ([] if want is None else [want])
    assert [r.reason for r in bad.collect()] == (["bad number"] if want is None else [])


class _Held:
    """A handle whose list or map state is counted by calls."""

    def __init__(self):
        self.calls, self.held, self.timers = 0, [], []

    def getListState(self, name, *schemas):
        return self

    getMapState = getListState

    def _call(self, value=None):
        self.calls += 1
        return value

    def get(self):
        return self._call(iter(self.held))

    def appendList(self, values):
        self._call(self.held.extend(values))

    def containsKey(self, key):
        return self._call(key in self.held)

    def updateValue(self, key, value):
        self._call(self.held.append(key))

    def registerTimer(self, at):
        self.timers.append(at)


def test_calls_to_the_state_do_not_grow_with_the_users():
    calls = {}
    for users in (3, 300):
        handle, one = _Held(), live.SlotUsers(3600)
        one.init(handle)

        def feed(spec):
            df = pd.DataFrame(spec, columns=["slot_start", "hostname", "user_cookie"])
            # A key's rows may come in several pieces.
            got = [tuple(r) for out in one.handleInputRows((3600, 0), iter([df[::2], df[1::2]]), None) for r in out.to_numpy()]
            return sorted(got)

        spec = [(slot, host, f"u{i}") for slot in (3600, 4200) for host in ("", "b") for i in range(users)]
        assert feed(spec) == [(slot, host, users) for slot in (3600, 4200) for host in ("", "b")]
        assert feed(spec) == []
        assert feed([*spec, (4200, "b", "\ud800\""), (4200, "b", ""), (4800, "b", "u1")]) == [(4200, "b", 2), (4800, "b", 1)]
        assert feed([(4200, "b", "\ud800\""), (4200, "c", "u1")]) == [(4200, "c", 1)]
        assert set(handle.timers) == {7_200_000}
        calls[users] = handle.calls
    assert calls[3] == calls[300]
