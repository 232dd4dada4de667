"""The abuse check kept up to date: only the addresses of a micro-batch are profiled.

State holds the visits of every address as a ring of minutes. A key is an address and one part of its visits, by hash,
so a busy address is spread over several keys. Every task first folds its events to visits per second and tells
all parts of the addresses it met that they are wanted; these give out the minutes they hold. An event-time timer per minute
drops it when no window can reach it any more. Events behind the watermark are left out.

What a batch costs follows from its own events and the window of its own addresses, not from the traffic of the window.
Profiles, rules and alerts are those of ``ips``, run on the visits given out.
"""

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from pulseline.functions.timefn import LOCAL_TZ, local_date_num
from pulseline.operators import ips
from pulseline.operators.alerts import to_alerts
from pulseline.operators.rollups import SLOT_LOOKBACK
from pulseline.session import stored
from pulseline.streaming.jobs import BATCH, _each_batch, write_batch
from pulseline.streaming.live import ROCKS, STORE

#: Keys that share the visits of an address.
PARTS = 8
MINUTE = 60
#: Events that a task folds at once.
CHUNK = 200_000
VISITS = (
    "ip_user string, user_cookie string, hostname string, url string, browser string, "
    "referer string, is_bot int, timestamp bigint, hits bigint"
)
FOLDED = f"{VISITS}, part int, event_time timestamp"
#: What a visit is folded by within its minute.
FIELDS = [*ips.VISIT, "timestamp"]
HELD = Row("ip_user", *FIELDS, "hits")
TEXTS = ["ip_user", "user_cookie", "hostname", "url", "browser", "referer"]


def _folded(parts: int, reach: int):
    """Events of an Arrow batch as visits per second, and a row without hits for each part of an address.

    Events that lie ``reach`` seconds and more behind a later one of their address are in no window to come.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in _chunks(frames):
            newest = df.groupby("ip_user")["timestamp"].transform("max")
            df = df[df["timestamp"] > newest - reach]
            rows = df.groupby(["ip_user", *FIELDS], as_index=False, dropna=False).size()
            rows = rows.rename(columns={"size": "hits"})
            spread = pd.util.hash_pandas_object(rows[["user_cookie", "url"]], index=False)
            rows["part"] = (spread % parts).astype("int32")
            newest = rows.groupby("ip_user", as_index=False)["timestamp"].max()
            wanted = newest.merge(pd.DataFrame({"part": range(parts)}), how="cross")
            wanted["part"] = wanted["part"].astype("int32")
            wanted = wanted.assign(hits=0, is_bot=0, **dict.fromkeys(TEXTS[1:], ""))
            out = pd.concat([rows, wanted], ignore_index=True)
            out["event_time"] = pd.to_datetime(out["timestamp"], unit="s", utc=True)
            yield out[[c.split()[0] for c in FOLDED.split(", ")]]

    return fold


def _chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames put together to ``CHUNK`` rows and more: the more rows, the more of an address fold or lie behind."""
    some, n = [], 0
    for df in frames:
        if not df.empty:
            some.append(df)
            n += len(df)
        if n >= CHUNK:
            yield pd.concat(some, ignore_index=True)
            some, n = [], 0
    if some:
        yield pd.concat(some, ignore_index=True)


class AddressVisits(StatefulProcessor):
    """Adds the batch's visits to the minutes of a key and gives out all that its window holds."""

    def __init__(self, window: int, reach: int):
        self.window, self.reach = window, reach

    def init(self, handle) -> None:
        self.handle = handle
        self.minutes = handle.getMapState("minutes", "minute bigint", "visits string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new: dict[int, dict[tuple, int]] = {}
        newest = 0
        for row in rows:
            newest = max(newest, row["timestamp"])
            if hits := row["hits"]:
                visit = tuple(row[c] for c in FIELDS)
                minute = new.setdefault(visit[-1] - visit[-1] % MINUTE, {})
                minute[visit] = minute.get(visit, 0) + hits
        new = {minute: visits for minute, visits in new.items() if minute > newest - self.reach}
        for minute, visits in new.items():
            if self.minutes.containsKey((minute,)):
                for *visit, hits in json.loads(self.minutes.getValue((minute,))[0]):
                    visits[tuple(visit)] = visits.get(tuple(visit), 0) + hits
            else:
                self.handle.registerTimer(self._end(minute) * 1000)
            packed = json.dumps([[*visit, hits] for visit, hits in visits.items()])
            self.minutes.updateValue((minute,), (packed,))
        for (minute,), (packed,) in self.minutes.iterator():
            if minute > newest - self.window - MINUTE:
                yield from (HELD(key[0], *visit) for visit in json.loads(packed))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        minute = expiredTimerInfo.getExpiryTimeInMs() // 1000 - self._end(0)
        self.minutes.removeKey((minute,))
        return iter(())

    def _end(self, minute: int) -> int:
        return minute + MINUTE + self.window

    def close(self) -> None:
        pass


def window_visits(
    stream: DataFrame, window: int = ips.RECENT_SECONDS, parts: int = PARTS
) -> DataFrame:
    """Visits per second, in the trailing ``window``, of every address that the micro-batch has an event of.

    Null texts count as empty, rows without a time not at all. A row is kept as long as a window can reach it that ends no
    more than the watermark's delay before the newest event of its address.
    """
    reach = window + SLOT_LOOKBACK + MINUTE
    texts = {c: F.coalesce(c, F.lit("")) for c in TEXTS}
    events = stream.filter("timestamp IS NOT NULL").withColumns(texts)
    events = events.withColumn("is_bot", F.coalesce("is_bot", F.lit(0)))
    folded = events.select("ip_user", *FIELDS).mapInPandas(_folded(parts, reach), FOLDED)
    folded = folded.withWatermark("event_time", f"{SLOT_LOOKBACK} seconds")
    # Most keys have a few rows only, too few for a data frame each.
    return folded.groupBy("ip_user", "part").transformWithState(
        AddressVisits(window, reach), VISITS, "Update", "EventTime"
    )


def profiles(visits: DataFrame, as_of, window: int = ips.RECENT_SECONDS, tz: str = LOCAL_TZ) -> DataFrame:
    """Profiles of the addresses from the visits given out, over the freshest window up to ``as_of``."""
    per = ("window_rank",)
    rows = visits.withColumn("date_num", local_date_num("timestamp", tz))
    rows = ips.recent_activity(rows, as_of, window, tz)
    folded = rows.groupBy(*per, "ip_user", *ips.VISIT).agg(
        F.sum("hits").alias("hits"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
    )
    return ips.profile_of_visits(folded, per)


def watch_addresses(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    interval: str | None = "2 hours",
    limits: ips.IpThresholds = ips.IpThresholds(),
    window: int = ips.RECENT_SECONDS,
    parts: int = PARTS,
    tz: str = LOCAL_TZ,
    files: int | None = None,
) -> StreamingQuery:
    """Alerts of every micro-batch on the addresses it has events of, as of their newest event.

    Below ``path``, each batch has a folder of ``visits`` given out, ``agents`` (the agent an address had when it was
    profiled) and ``alerts``; a replay replaces them. Agents shared by many addresses are counted over those that had an
    event in the window, whichever batch it was in. Folders of ``visits`` are not read again, those of ``agents``
    not after the window.
    """
    spark, conf = stream.sparkSession, stream.sparkSession.conf
    per = ("window_rank",)

    def work(df: DataFrame, batch_id: int) -> None:
        write_batch(df, f"{path}/visits", batch_id, files)  # the state is stepped once
        visits = spark.read.schema(VISITS).parquet(f"{path}/visits/{BATCH}={batch_id}")
        as_of = visits.agg(F.max("timestamp")).first()[0]
        if as_of is None:
            return
        profile = stored(profiles(visits, as_of, window, tz), "profile")
        seen = profile.select("ip_user", "user_agent", "last_ts")
        write_batch(seen, f"{path}/agents", batch_id, files)
        rank = profile.agg(F.min("window_rank")).first()[0]
        shared = _shared(spark, path, batch_id, as_of - window, limits).withColumn("window_rank", F.lit(rank))
        threats = ips.ip_threats(profile, limits, per, shared)
        write_batch(to_alerts(threats, F.lit(as_of)), f"{path}/alerts", batch_id, files)

    before = conf.get(STORE)
    conf.set(STORE, ROCKS)  # map state and timers live there
    try:
        return _each_batch(window_visits(stream, window, parts), checkpoint, interval, work)
    finally:
        conf.set(STORE, before)


def _shared(spark: SparkSession, path: str, batch_id: int, since: int, limits: ips.IpThresholds) -> DataFrame:
    """Agents that many addresses of the window have in common, by the last profile of each address."""
    log = spark.read.schema(f"ip_user string, user_agent string, last_ts bigint, {BATCH} bigint")
    rows = log.parquet(f"{path}/agents").filter((F.col("last_ts") >= since) & (F.col(BATCH) <= batch_id))
    last = F.max(F.struct(BATCH, "last_ts", "user_agent"))["user_agent"].alias("user_agent")
    return ips.shared_agents(rows.groupBy("ip_user").agg(last), limits.shared_agent_ips, per=())


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """The alerts of all batches so far, with the batch that raised them."""
    return spark.read.parquet(f"{path}/alerts")
