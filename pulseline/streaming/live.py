"""Exact users of open slots and minutes, kept in state until the slot has closed.

A key of the state is a period of slots and one part of its users, by hash, so a busy slot or host is spread over several
keys. Its list holds, per slot and micro-batch, the (host, cookie) that were new then, packed; one that is new adds one to the
change log, which readers sum up. The list is read and added to as a whole, once for each batch that has rows of its key.
An event-time timer at the end of the period clears the list: behind the watermark no event of it can come.
"""

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from pulseline.functions.timefn import slot_start
from pulseline.operators.filters import humans
from pulseline.operators.rollups import SLOT_LOOKBACK
from pulseline.streaming.jobs import BATCH, _each_batch, write_batch

SLOT_SECONDS = 600
#: Seconds of slots that share a key, and keys that share the users of a slot.
PERIOD, PARTS = 3600, 8
CHANGES = "slot_start bigint, hostname string, new_users bigint"
STORE = "spark.sql.streaming.stateStore.providerClass"
SHUFFLE = "spark.sql.shuffle.partitions"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SlotUsers(StatefulProcessor):
    """Emits, for every batch, how many users each slot and host has that were not seen before."""

    def __init__(self, period: int):
        self.period = period

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "slot_start bigint, users string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        columns = ("slot_start", "hostname", "user_cookie")
        # Cookies by slot and host.
        met: dict[int, dict[str, set[str]]] = {}
        for df in rows:
            for slot, host, cookie in zip(*(df[c].tolist() for c in columns)):
                met.setdefault(slot, {}).setdefault(host, set()).add(cookie)
        for slot, users in self.seen.get():
            if hosts := met.get(slot):
                for host, cookies in json.loads(users).items():
                    if host in hosts:
                        hosts[host].difference_update(cookies)
        met = {slot: {h: c for h, c in hosts.items() if c} for slot, hosts in met.items()}
        packed = [(s, json.dumps({h: list(c) for h, c in hosts.items()})) for s, hosts in met.items() if hosts]
        if packed:
            self.seen.appendList(packed)
        self.handle.registerTimer((int(key[0]) + self.period) * 1000)
        yield _rows({(s, host): len(c) for s, hosts in met.items() for host, c in hosts.items()})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        yield _rows({})

    def close(self) -> None:
        pass


def _rows(new: dict[tuple[int, str], int]) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "slot_start": pd.Series([slot for slot, _ in new], dtype="int64"),
            "hostname": pd.Series([host for _, host in new], dtype=object),
            "new_users": pd.Series(list(new.values()), dtype="int64"),
        }
    )


def user_changes(
    stream: DataFrame,
    seconds: int = SLOT_SECONDS,
    by_host: bool = True,
    period: int = PERIOD,
    parts: int = PARTS,
) -> DataFrame:
    """The change log of exact human users per slot and host (or per slot, with an empty host).

    Sparse traffic wants long periods and few parts, busy traffic the opposite: a key is kept for a period and the
    watermark's delay, and its list is read in every batch that has rows of it.
    """
    if period % seconds:
        raise ValueError("a period holds whole slots")
    host = F.col("hostname") if by_host else F.lit("")
    rows = (
        humans(stream)
        .withColumn("event_time", F.timestamp_seconds("timestamp"))
        .withWatermark("event_time", f"{SLOT_LOOKBACK} seconds")
        .select(
            "event_time",
            slot_start("timestamp", seconds).alias("slot_start"),
            F.coalesce(host, F.lit("")).alias("hostname"),
            F.coalesce("user_cookie", F.lit("")).alias("user_cookie"),
        )
    )
    rows = rows.withColumn("part", F.pmod(F.xxhash64("hostname", "user_cookie"), F.lit(parts)))
    rows = rows.withColumn("period_start", F.col("slot_start") - F.pmod("slot_start", F.lit(period)))
    return rows.groupBy("period_start", "part").transformWithStateInPandas(
        SlotUsers(period), CHANGES, "Update", "EventTime"
    )


def keep_users(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    interval: str | None = "30 seconds",
    seconds: int = SLOT_SECONDS,
    by_host: bool = True,
    files: int | None = 1,
    partitions: int | None = None,
    **spread: int,
) -> StreamingQuery:
    """Write the change log, one folder per micro-batch, which a replay replaces as a whole.

    ``partitions`` are those of the state, the session's shuffle partitions if not given; a checkpoint keeps its first
    number. Every batch starts a worker for each and commits it, rows or not, so few keys want few.
    ``spread`` holds ``period`` and ``parts`` of ``user_changes``.
    """
    conf = stream.sparkSession.conf
    before = {name: conf.get(name) for name in (STORE, SHUFFLE)}
    conf.set(STORE, ROCKS)  # map state and timers live there
    try:
        if partitions is not None:
            conf.set(SHUFFLE, partitions)
        changes = user_changes(stream, seconds, by_host, **spread)
        return _each_batch(
            changes, checkpoint, interval, lambda df, batch: write_batch(df, path, batch, files)
        )
    finally:
        for name, value in before.items():
            conf.set(name, value)


def read_users(spark: SparkSession, path: str, since: int | None = None) -> DataFrame:
    """Exact users per slot and host of all batches so far; only slots from ``since`` on, if given."""
    log = spark.read.schema(f"{CHANGES}, {BATCH} bigint").parquet(path)
    if since is not None:
        log = log.filter(F.col("slot_start") >= since)
    return log.groupBy("slot_start", "hostname").agg(F.sum("new_users").alias("active_users"))
