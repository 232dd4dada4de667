"""The abuse check from the state of addresses equals the check over the whole window."""

import random

import pandas as pd
from conftest import DAY_START, rows
from pyspark.sql import functions as F

from pulseline.operators import ips
from pulseline.schema import ACTIVITY_SCHEMA
from pulseline.streaming import addresses, jobs

NOON = DAY_START + 43200
LIMITS = ips.IpThresholds(hosts=1, cookies=2, shared_agent_ips=99)
COLUMNS = ("ip", "verdict", "score", "threat_type", "reason", "timestamp")


def _watch(spark, folder, limits=LIMITS, parts=3):
    source, path, checkpoint = (str(folder / x) for x in ("in", "out", "checkpoint"))

    def feed(df):
        df.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ACTIVITY_SCHEMA).parquet(source)
        addresses.watch_addresses(
            stream, path, checkpoint, interval=None, limits=limits, parts=parts, files=1
        ).awaitTermination()
        alerts = addresses.read_alerts(spark, path)
        visits = spark.read.schema(f"{addresses.VISITS}, {jobs.BATCH} bigint").parquet(f"{path}/visits")
        visits = visits.filter(F.col(jobs.BATCH) == visits.agg(F.max(jobs.BATCH)).first()[0])
        return alerts, visits, checkpoint

    return feed


def test_alerts_equal_the_check_over_the_window(spark, act, tmp_path):
    rng = random.Random(11)
    feed, seen, done = _watch(spark, tmp_path), [], set()
    for batch in range(4):
        start = NOON + batch * 3000
        part = [
            dict(
                timestamp=start + rng.randrange(2000), ip_user=f"10.0.0.{rng.choice((batch, batch + 1, 9, 9, 9))}",
                hostname=rng.choice("abc"), url=rng.choice(("/p", "/q", "/wp-admin")), referer=rng.choice(("", "r")),
                user_cookie=rng.choice(("", "u1", "u2", "u3")), browser=rng.choice(("Chrome", "curl")),
            )
            for _ in range(40)
        ]
        part.append(dict(part[0]))  # a repeated event counts twice
        seen += part
        alerts, visits, _ = feed(act(*part))
        as_of, touched = max(r["timestamp"] for r in part), {r["ip_user"] for r in part}
        want = jobs.abuse_check(act(*seen), as_of, LIMITS).filter(F.col("ip").isin(sorted(touched)))
        got = [r for r in rows(alerts, *COLUMNS) if r not in done]
        assert got == rows(want, *COLUMNS) and got
        done |= set(got)
        # Only the batch's addresses are given out, once per event of the window and its first minute.
        given = visits.agg(F.sum("hits"), F.collect_set("ip_user"), F.min("timestamp")).first()
        assert set(given[1]) == touched
        held = [r for r in seen if r["ip_user"] in touched and r["timestamp"] > as_of - 7200]
        assert len(held) <= given[0] <= len([r for r in seen if r["ip_user"] in touched])


def test_events_of_many_frames_are_folded_together():
    """A long history comes in small frames; what lies behind in all of them together goes no further."""
    rng = random.Random(3)
    blank = dict.fromkeys(ips.VISIT, "") | {"is_bot": 0}
    events = [dict(blank, ip_user=f"10.0.0.{i % 5}", timestamp=NOON + i * 60) for i in range(1000)]
    rng.shuffle(events)
    names = ["ip_user", *addresses.FIELDS]
    frames = [pd.DataFrame(events[i : i + 4])[names] for i in range(0, 1000, 4)]
    out = pd.concat(addresses._folded(2, 7200)(iter([frames[0][:0], *frames, frames[0][:0]])))
    kept = out[out["hits"] > 0]
    newest = {f"10.0.0.{i % 5}": NOON + i * 60 for i in range(1000)}
    want = [(e["ip_user"], e["timestamp"]) for e in events if e["timestamp"] > newest[e["ip_user"]] - 7200]
    assert sorted(zip(kept["ip_user"], kept["timestamp"])) == sorted(want)
    wanted = out[out["hits"] == 0]
    assert sorted(zip(wanted["ip_user"], wanted["part"], wanted["timestamp"])) == sorted((a, p, t) for a, t in newest.items() for p in (0, 1))
    assert list(addresses._folded(2, 7200)(iter([frames[0][:0]]))) == []


def test_state_is_dropped_by_timers_and_days_do_not_mix(spark, act, tmp_path):
    feed = _watch(spark, tmp_path)
    feed(act(*[dict(timestamp=NOON + i, ip_user="10.0.0.1", hostname=h) for i, h in enumerate("abc")]))
    later = DAY_START + 86400 + 60  # a minute after midnight: yesterday is not in the window
    feed(act(dict(timestamp=DAY_START + 86340, ip_user="10.0.0.2", hostname="a")))
    alerts, visits, checkpoint = feed(act(*[dict(timestamp=later, ip_user="10.0.0.2", hostname=h) for h in "bc"]))
    assert visits.agg(F.sum("hits")).first()[0] == 3
    found = {(r.ip, r.reason) for r in alerts.collect()}
    assert found == {("10.0.0.1", "distinct_hostnames=3"), ("10.0.0.2", "distinct_hostnames=2")}
    state = spark.read.format("statestore").option("stateVarName", "minutes").load(checkpoint)
    held = {r[0] for r in state.select("key.ip_user").collect()}
    assert held == {"10.0.0.2"}


def test_shared_agents_are_counted_over_batches(spark, act, tmp_path):
    limits = ips.IpThresholds(shared_agent_ips=3)
    feed = _watch(spark, tmp_path, limits)
    one = lambda i, at: dict(timestamp=NOON + at, ip_user=f"10.0.0.{i}", browser="Agent", referer="r")
    feed(act(one(1, 0), one(2, 1)))
    alerts, _, _ = feed(act(one(1, 600), one(3, 601)))
    assert {(r.ip, r.threat_type) for r in alerts.collect()} == {("10.0.0.1", "Shared Agent"), ("10.0.0.3", "Shared Agent")}
    # Three hours later the others are out of the window.
    alerts, _, _ = feed(act(one(4, 11_400)))
    assert alerts.filter("ip = '10.0.0.4'").count() == 0


def test_empty_batches_and_nulls(spark, act, tmp_path):
    feed = _watch(spark, tmp_path)
    null = dict.fromkeys(("hostname", "url", "referer", "browser", "user_cookie", "is_bot", "timestamp"))
    frame = act(dict(ip_user="10.0.0.1", hostname="a"), dict(ip_user="10.0.0.1", hostname="b"))
    some = frame.withColumns({c: F.lit(None).cast(ACTIVITY_SCHEMA[c].dataType) for c in null if c != "timestamp"})
    none = frame.withColumn("timestamp", F.lit(None).cast("bigint"))
    alerts, visits, _ = feed(frame.unionByName(some).unionByName(none))
    assert visits.agg(F.sum("hits")).first()[0] == 4
    assert [r.reason for r in alerts.collect()] == ["distinct_hostnames=3"]
