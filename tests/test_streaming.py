"""Streams give the batch result, however the input is cut, restarted or replayed."""

import random
import re

import pytest
from conftest import DAY_START, rows
from pyspark.sql import functions as F

from pulseline.operators import ips, rollups
from pulseline.schema import ACTIVITY_SCHEMA
from pulseline.sources import ingest
from pulseline.streaming import jobs


@pytest.fixture
def events(act):
    rng = random.Random(3)
    out = []
    for i in range(120):
        ts = DAY_START + i * 997
        out.append(
            dict(
                id=i, timestamp=ts, user_cookie=f"u{rng.randrange(9)}", hostname=rng.choice("ab"),
                session_id=f"s{rng.randrange(20)}", is_bot=int(rng.random() < 0.2), url=rng.choice("xyz"),
                ip_user=f"10.0.0.{rng.randrange(5)}",
            )
        )
    return act(*out).orderBy("timestamp")


def write_files(df, path, n, shuffled=False):
    """The rows in ``n`` files with ascending names, in time order or mixed."""
    data = df.collect()
    if shuffled:
        random.Random(5).shuffle(data)
    size = -(-len(data) // n)
    for i in range(n):
        part = df.sparkSession.createDataFrame(data[i * size : (i + 1) * size], ACTIVITY_SCHEMA)
        part.coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, per_trigger=1):
    return spark.readStream.schema(ACTIVITY_SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(path)


@pytest.mark.parametrize("files,shuffled", [(1, False), (4, False), (4, True)])
def test_kept_tables_equal_batch(spark, events, tmp_path, files, shuffled):
    source = str(tmp_path / "in")
    write_files(events, source, files, shuffled)
    dirs = {k: (str(tmp_path / k), str(tmp_path / f"{k}-cp")) for k in ("slots", "loads", "first")}
    for keep, kind in ((jobs.keep_slots, "slots"), (jobs.keep_rollup, "loads"), (jobs.keep_first_seen, "first")):
        keep(stream(spark, source), *dirs[kind], interval=None).awaitTermination()
    assert rows(jobs.read_slots(spark, dirs["slots"][0])) == rows(rollups.slot_keys(events))
    got = rollups.rollup_from_loads(jobs.read_loads(spark, dirs["loads"][0]))
    assert rows(got) == rows(rollups.daily_rollup(events))
    assert rows(jobs.read_first_seen(spark, dirs["first"][0])) == rows(rollups.first_seen(events))


def test_restart_continues_from_the_checkpoint(spark, events, tmp_path):
    source, path, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    early, late = events.filter("id < 50"), events.filter("id >= 50")
    write_files(early, source, 2)
    jobs.append_activity(stream(spark, source), path, cp, interval=None).awaitTermination()
    write_files(late, source, 2)
    for _ in range(2):
        jobs.append_activity(stream(spark, source), path, cp, interval=None).awaitTermination()
    names = ACTIVITY_SCHEMA.fieldNames()
    assert rows(spark.read.parquet(path), *names) == rows(events, *names)


def test_replayed_batch_replaces_itself(spark, events, tmp_path):
    source, path, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    write_files(events, source, 3)
    jobs.keep_rollup(stream(spark, source), path, cp, interval=None).awaitTermination()
    # Forget that the last batch was finished: the restart runs it again.
    (tmp_path / "cp" / "commits" / "2").unlink()
    for crc in (tmp_path / "cp" / "commits").glob(".2.crc"):
        crc.unlink()
    jobs.keep_rollup(stream(spark, source), path, cp, interval=None).awaitTermination()
    got = rollups.rollup_from_loads(jobs.read_loads(spark, path))
    assert rows(got) == rows(rollups.daily_rollup(events))


def test_compaction_keeps_the_result(spark, events, tmp_path):
    source, path, cp, base1, base2 = (str(tmp_path / n) for n in ("in", "out", "cp", "b1", "b2"))
    write_files(events, source, 4)
    jobs.keep_rollup(stream(spark, source), path, cp, interval=None).awaitTermination()
    want = rows(rollups.daily_rollup(events))
    jobs.compact(spark, path, base1, 1, rollups.merge_page_loads)
    assert rows(rollups.rollup_from_loads(jobs.read_loads(spark, path, base1))) == want
    jobs.compact(spark, path, base2, 2, rollups.merge_page_loads, base1)
    assert rows(rollups.rollup_from_loads(jobs.read_loads(spark, path, base2))) == want


def test_slots_and_first_seen_compact(spark, events, tmp_path):
    source = str(tmp_path / "in")
    write_files(events, source, 4)
    for keep, read, fold, want in (
        (jobs.keep_slots, jobs.read_slots, lambda df: df.distinct(), rollups.slot_keys(events)),
        (jobs.keep_first_seen, jobs.read_first_seen, rollups.merge_first_seen, rollups.first_seen(events)),
    ):
        path, cp, base = (str(tmp_path / f"{keep.__name__}-{n}") for n in ("out", "cp", "base"))
        keep(stream(spark, source), path, cp, interval=None, files=1).awaitTermination()
        jobs.compact(spark, path, base, 2, fold)
        assert rows(read(spark, path, base)) == rows(want)
        for batch in range(4):
            folder = tmp_path / f"{keep.__name__}-out" / f"batch_id={batch}"
            assert len(list(folder.glob("*.parquet"))) == 1


def test_sketch_states_survive_compaction(spark, events, tmp_path):
    source, path, cp, base = (str(tmp_path / n) for n in ("in", "out", "cp", "b"))
    write_files(events, source, 3)
    jobs.keep_rollup(stream(spark, source), path, cp, interval=None, approx=True).awaitTermination()
    jobs.compact(spark, path, base, 1, rollups.compact_states)
    got = rollups.merge_states(jobs.read_states(spark, path, base))
    names = ["date_num", "hostname", "users", "views", "sessions", "bot_sessions", "bot_hits", "stay_seconds"]
    assert rows(got, *names) == rows(rollups.daily_rollup(events), *names)


def test_late_rows_go_to_their_own_table(spark, act, tmp_path):
    source, path, late, cp = (str(tmp_path / n) for n in ("in", "out", "late", "cp"))
    newest = DAY_START + 10 * 86400
    df = act(dict(timestamp=newest), dict(timestamp=newest - 172800), dict(timestamp=newest - 172801))
    df.coalesce(1).write.parquet(source)
    jobs.keep_rollup(stream(spark, source), path, cp, interval=None, late_path=late).awaitTermination()
    assert spark.read.parquet(path).count() == 2
    assert rows(spark.read.parquet(late), "timestamp") == [(newest - 172801,)]


def test_closed_slots_are_exact_and_the_open_one_waits(spark, act, tmp_path):
    source, path, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    start = DAY_START
    df = act(
        dict(timestamp=start, user_cookie="a"),
        dict(timestamp=start + 1, user_cookie="a"),
        dict(timestamp=start + 2, user_cookie="b"),
        dict(timestamp=start + 700, user_cookie="a"),
        dict(timestamp=start + 600 + 2400, user_cookie="c"),
    )
    write_files(df, source, 2)
    writer = jobs.closed_slots(stream(spark, source)).writeStream.format("parquet").option("path", path)
    writer.option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.read.parquet(path).selectExpr("unix_timestamp(slot.start)", "active_users")) == [(start, 2)]


def test_live_slots_log_ends_at_the_batch_value(spark, events, tmp_path):
    source, cp = str(tmp_path / "in"), str(tmp_path / "cp")
    write_files(events, source, 4)
    query = (
        jobs.live_slots(stream(spark, source)).writeStream.outputMode("update").format("memory")
        .queryName("live").option("checkpointLocation", cp).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    last = spark.sql(
        "SELECT unix_timestamp(slot.start) AS slot_start, hostname, max(active_users) AS active_users "
        "FROM live GROUP BY 1, 2"
    )
    assert rows(last) == rows(rollups.online_slots(events))


def test_messages_to_tables(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text('{"id": 1, "date_num": 20240115}\n{"id": \n')
    (source / "b.json").write_text('{"id": "x"}\n{"id": 2}\n')
    good, bad, cp = (str(tmp_path / n) for n in ("good", "bad", "cp"))
    messages = ingest.read_activity_stream(spark, path=str(source), max_per_trigger=1)
    jobs.ingest_messages(messages, good, bad, cp, interval=None).awaitTermination()
    assert rows(spark.read.parquet(good), "id", "date_num") == [(1, 20240115), (2, 0)]
    assert spark.read.parquet(bad).count() == 2


def test_abuse_watch_writes_alerts(spark, events, tmp_path):
    source, path, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    write_files(events, source, 1)
    limits_off = ips.IpThresholds(hosts=0)
    want = rows(jobs.abuse_check(events, DAY_START + 119 * 997, limits_off), "ip")
    assert want
    jobs.watch_abuse(
        stream(spark, source), lambda: events, path, cp, interval=None, limits=limits_off
    ).awaitTermination()
    assert rows(spark.read.parquet(path), "ip") == want


def test_a_replay_without_rows_leaves_nothing(spark, act, tmp_path):
    path = str(tmp_path / "out")
    one = act(dict(id=1))
    jobs.write_batch(one, path, 0)
    jobs.write_batch(act(dict(id=2, timestamp=DAY_START + 86400)), path, 1)
    jobs.write_batch(one.filter("id = 9"), path, 0)
    assert rows(spark.read.schema(ACTIVITY_SCHEMA).parquet(path), "id") == [(2,)]


def test_base_is_split_by_day_and_knows_its_table(spark, events, tmp_path):
    source, path, cp, base = (str(tmp_path / n) for n in ("in", "out", "cp", "base"))
    write_files(events, source, 3)
    jobs.keep_rollup(stream(spark, source), path, cp, interval=None).awaitTermination()
    jobs.compact(spark, path, base, 1, rollups.merge_page_loads)
    day = rows(events, "date_num")[0][0]
    plan = jobs.read_loads(spark, path, base).filter(F.col("date_num") == day)
    text = plan._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"PartitionFilters: \[([^\]]*)\]", text)
    assert len(scans) == 2 and all("date_num" in scan for scan in scans)
    with pytest.raises(ValueError, match="not from"):
        jobs.read_loads(spark, str(tmp_path / "in"), base)
    first_path, first_base = str(tmp_path / "first"), str(tmp_path / "first-base")
    jobs.keep_first_seen(
        stream(spark, source), first_path, cp + "2", interval=None
    ).awaitTermination()
    jobs.compact(spark, first_path, first_base, 2, rollups.merge_first_seen)
    new = jobs.settled_first_seen(spark, first_base, day, day)
    assert "PartitionFilters: [isnotnull(first_date_num" in new._jdf.queryExecution().executedPlan().toString()
    assert rows(new) == rows(rollups.first_seen(events).filter(F.col("first_date_num") == day))


def test_heartbeats_get_the_servers_part(spark):
    request = dict(
        session_id="s", user_cookie=None, url="http://www.a.example/p", hostname="www.a.example",
        referer=None, browser="Googlebot/2.1", is_bot=0, cf_connecting_ip="", x_forwarded_for="1.2.3.4, 5.6.7.8",
        remote_addr="127.0.0.1", received_at=1705248000,
    )
    schema = (
        "session_id string, user_cookie string, url string, hostname string, referer string, browser string, "
        "is_bot int, cf_connecting_ip string, x_forwarded_for string, remote_addr string, received_at long"
    )
    got = jobs.heartbeats(spark.createDataFrame([request], schema)).first()
    assert (got.id, got.ip_user, got.is_bot, got.date_num) == (1705248000000, "1.2.3.4", 1, 20240115)
    assert (got.user_cookie, got.referer, got.domain) == ("", "", "a.example")


def test_settling_closed_days_can_be_repeated(spark, events, tmp_path):
    path, table = str(tmp_path / "batches"), str(tmp_path / "table")
    for i in range(3):
        jobs.write_batch(events.filter(F.col("id") % 3 == i), path, i)
    for _ in range(2):
        jobs.settle_activity(spark, path, table, 0, 99991231)
    names = ACTIVITY_SCHEMA.fieldNames()
    assert rows(spark.read.parquet(table), *names) == rows(events, *names)
    files = list((tmp_path / "table").glob("date_num=*/*.parquet"))
    assert len(files) <= 4 * len(set(f.parent for f in files))
