"""Structured Streaming jobs that keep the activity table and its derived tables.

Jobs write one folder per micro-batch and replace that folder when the batch is replayed,
so a lost executor or a restart never counts rows twice. Readers merge the batches.
A table and its checkpoint belong together: use a new table path with a new checkpoint.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulseline.operators import ips, rollups
from pulseline.operators.alerts import to_alerts
from pulseline.operators.rollups import ROLLUP_HORIZON, SLOT_LOOKBACK
from pulseline.schema import ACTIVITY_SCHEMA, HEARTBEAT_SCHEMA
from pulseline.session import stored
from pulseline.sources.ingest import (
    APPEND_INTERVAL,
    enrich_time,
    mark_bots,
    normalize_events,
    resolve_ip,
)
from pulseline.sources.tables import write_activity

SLOT_WINDOW = "10 minutes"
WATERMARK = f"{SLOT_LOOKBACK} seconds"
BATCH = "batch_id"
#: Columns by which base tables are split into folders.
DAYS = ("date_num", "first_date_num")
#: Beside a base table: the last batch that it covers.
MANIFEST = "_manifest"


def _trigger(writer, interval: str | None):
    """Run every ``interval``, or once over what is there when it is None."""
    if interval is None:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=interval)


def write_batch(df: DataFrame, path: str, batch_id: int, files: int | None = None) -> None:
    """Write a micro-batch into a folder of its own, which replaces an earlier attempt as a whole.

    Below it rows are split by day if they have one, so that readers of a day skip the others.
    An earlier attempt leaves nothing behind, not even days that this one has no row of.
    ``files`` bounds the files per folder; small frequent batches want a small number. Rows are dealt to them
    once they are made: coalescing would run all the work of the batch, state included, in as few tasks.
    """
    df = df if files is None else df.repartition(files)
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    if "date_num" in df.columns:
        writer = writer.partitionBy("date_num")
    writer.parquet(f"{path}/{BATCH}={batch_id}")


def day_column(df: DataFrame) -> str | None:
    """The column that a table is split by, if it has one."""
    return next((c for c in DAYS if c in df.columns), None)


def _each_batch(
    stream: DataFrame, checkpoint: str, interval: str | None, work: Callable[[DataFrame, int], None]
) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return _trigger(writer, interval).start()


def keep_table(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    state: Callable[[DataFrame], DataFrame],
    interval: str | None = None,
    files: int | None = None,
) -> StreamingQuery:
    """Append the state of every micro-batch, e.g. ``rollups.page_loads``."""

    def work(df: DataFrame, batch_id: int) -> None:
        write_batch(state(df), path, batch_id, files)

    return _each_batch(stream, checkpoint, interval, work)


def append_activity(
    stream: DataFrame, path: str, checkpoint: str, interval: str | None = APPEND_INTERVAL
) -> StreamingQuery:
    """Typed activity rows appended exactly once, one folder per day.

    Readers of ``path`` see what the stream has committed there and nothing else, so batch
    loads belong to another path.
    """
    writer = (
        stream.writeStream.format("parquet")
        .partitionBy("date_num")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    return _trigger(writer, interval).start()


def ingest_messages(
    messages: DataFrame,
    good_path: str,
    bad_path: str,
    checkpoint: str,
    interval: str | None = APPEND_INTERVAL,
) -> StreamingQuery:
    """JSON messages to an activity table, refused messages to a second table.

    Crawlers are flagged by their user agent, whatever the sender says. Each table's batch is
    replaced as a whole on a replay. A batch's messages are read once for both tables.
    """

    def work(df: DataFrame, batch_id: int) -> None:
        df = df.persist()
        try:
            good, bad = normalize_events(df)
            write_batch(mark_bots(good), good_path, batch_id)
            write_batch(bad, bad_path, batch_id)
        finally:
            df.unpersist()

    return _each_batch(messages, checkpoint, interval, work)


def heartbeats(requests: DataFrame) -> DataFrame:
    """Activity rows from requests: the heartbeat's fields, address headers and receive time.

    The server's part of a heartbeat: client address, crawler flag, times, and the host's domain.
    """
    texts = {
        f.name: F.coalesce(F.col(f.name).cast("string"), F.lit(""))
        for f in HEARTBEAT_SCHEMA
        if f.name != "is_bot"
    }
    rows = enrich_time(mark_bots(resolve_ip(requests.withColumns(texts))))
    rows = rows.withColumn("domain", F.regexp_replace("hostname", r"^(www|m|blog)\.", ""))
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in ACTIVITY_SCHEMA])


def ingest_heartbeats(
    requests: DataFrame, path: str, checkpoint: str, interval: str | None = APPEND_INTERVAL
) -> StreamingQuery:
    """A stream of heartbeat requests to the activity table, one folder per micro-batch."""

    def work(df: DataFrame, batch_id: int) -> None:
        write_batch(heartbeats(df), path, batch_id)

    return _each_batch(requests, checkpoint, interval, work)


def settle_activity(spark: SparkSession, path: str, table_path: str, first: int, last: int) -> None:
    """Rewrite the batches of the closed days ``first`` .. ``last`` into the clustered table.

    Streams leave small unsorted files; this job, run once a day, replaces the days' folders of
    ``table_path`` by a few files sorted by host and time. Run again it gives the same table.
    """
    rows = spark.read.parquet(path).drop(BATCH)
    rows = rows.filter(F.col("date_num").between(first, last))
    write_activity(rows, table_path, mode="overwrite")


def keep_slots(
    stream, path, checkpoint, interval="30 seconds", approx=False, files=None
) -> StreamingQuery:
    """Online-slot keys (or sketch states) of every micro-batch."""
    state = rollups.slot_states if approx else rollups.slot_keys
    return keep_table(stream, path, checkpoint, state, interval, files)


def read_slots(spark: SparkSession, path: str, base_path: str | None = None) -> DataFrame:
    """Distinct (slot, host, cookie) of a base table and the batches after it."""
    return _with_base(spark, path, base_path).drop(BATCH).distinct()


def keep_rollup(
    stream, path, checkpoint, interval="120 seconds", approx=False, late_path=None, files=None
) -> StreamingQuery:
    """Page loads (or sketch states) of every micro-batch, the mergeable daily rollup.

    Late rows merge like any other. With ``late_path``, rows more than the rollup horizon
    behind the newest row of their batch go to that table instead.
    """
    state = rollups.rollup_states if approx else rollups.page_loads
    if late_path is None:
        return keep_table(stream, path, checkpoint, state, interval, files)

    def work(df: DataFrame, batch_id: int) -> None:
        df = df.persist()
        try:
            oldest = df.select(F.max("timestamp") - ROLLUP_HORIZON).scalar()
            write_batch(state(df.filter(F.col("timestamp") >= oldest)), path, batch_id, files)
            write_batch(df.filter(F.col("timestamp") < oldest), late_path, batch_id, files)
        finally:
            df.unpersist()

    return _each_batch(stream, checkpoint, interval, work)


def read_loads(spark: SparkSession, path: str, base_path: str | None = None) -> DataFrame:
    """Merged page loads of a base table and the batches after it."""
    return rollups.merge_page_loads(_with_base(spark, path, base_path))


def read_states(spark: SparkSession, path: str, base_path: str | None = None) -> DataFrame:
    """Sketch states of a base table and the batches after it, still to be merged."""
    return _with_base(spark, path, base_path).drop(BATCH)


def _with_base(spark: SparkSession, path: str, base_path: str | None) -> DataFrame:
    """Rows of the base and of the batches behind it; the base has no batch number."""
    batches = spark.read.parquet(path)
    if base_path is None:
        return batches
    covered = spark.read.parquet(f"{base_path}/{MANIFEST}").first()
    if covered.table != path:
        raise ValueError(f"{base_path} was folded from {covered.table}, not from {path}")
    base = spark.read.parquet(base_path).withColumn(BATCH, F.lit(None).cast("bigint"))
    later = batches.filter(F.col(BATCH) > covered.batch)
    return later.withColumn(BATCH, F.col(BATCH).cast("bigint")).unionByName(base)


def compact(
    spark: SparkSession,
    path: str,
    new_base: str,
    up_to: int,
    fold: Callable[[DataFrame], DataFrame],
    base_path: str | None = None,
) -> None:
    """Fold the batches up to ``up_to`` and an earlier base into a new base table.

    ``fold`` merges states: ``merge_page_loads``, ``compact_states``, ``merge_first_seen``, or
    ``DataFrame.distinct`` for slot keys. A base with days is split by day and clustered, so a
    report of one day reads one folder of it. A manifest beside it says which table and
    batches it covers; it is written last, so a base without one is unfinished. The old base and the
    batches stay readable until the caller switches over; the folded batches may then be deleted.
    """
    rows = _with_base(spark, path, base_path)
    rows = fold(rows.filter(F.coalesce(BATCH, F.lit(up_to)) <= up_to).drop(BATCH))
    if day := day_column(rows):
        keys = [day, *(c for c in ("hostname",) if c in rows.columns)]
        rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
        rows.write.mode("error").partitionBy(day).parquet(new_base)
    else:
        rows.write.mode("error").parquet(new_base)
    covers = spark.createDataFrame([(path, up_to)], "table string, batch bigint")
    covers.coalesce(1).write.mode("error").parquet(f"{new_base}/{MANIFEST}")


def settled_first_seen(spark: SparkSession, base_path: str, first: int, last: int) -> DataFrame:
    """New (cookie, host) of the days ``first`` .. ``last`` from a base of settled minima.

    The compaction has made the base distinct, so the days' folders are the answer as they are.
    """
    return spark.read.parquet(base_path).filter(F.col("first_date_num").between(first, last))


def keep_first_seen(
    stream, path, checkpoint, interval="120 seconds", files=None
) -> StreamingQuery:
    """First local day per (cookie, host) of every micro-batch."""
    return keep_table(stream, path, checkpoint, rollups.first_seen, interval, files)


def read_first_seen(spark: SparkSession, path: str, base_path: str | None = None) -> DataFrame:
    """First local day per (cookie, host) over a base table and the batches after it."""
    return rollups.merge_first_seen(_with_base(spark, path, base_path).drop(BATCH))


def _human_slots(stream: DataFrame, size: str) -> DataFrame:
    return (
        stream.filter("is_bot = 0")
        .withColumn("event_time", F.timestamp_seconds("timestamp"))
        .withWatermark("event_time", WATERMARK)
        .withColumn("slot", F.window("event_time", size))
    )


def live_slots(stream: DataFrame) -> DataFrame:
    """Approximate users per open ten-minute slot and host, for update mode.

    The output is a change log: a later row for a slot and host replaces the earlier one.
    """
    return _human_slots(stream, SLOT_WINDOW).groupBy("slot", "hostname").agg(
        F.approx_count_distinct("user_cookie").alias("active_users")
    )


def closed_slots(stream: DataFrame) -> DataFrame:
    """Exact users per slot and host, emitted when the slot has closed, for append mode."""
    return (
        _human_slots(stream, SLOT_WINDOW)
        .select("slot", "hostname", "user_cookie")
        .dropDuplicates(["slot", "hostname", "user_cookie"])
        .groupBy("slot", "hostname")
        .agg(F.count("*").alias("active_users"))
    )


def minute_users(stream: DataFrame) -> DataFrame:
    """Approximate users per minute; the peak is their maximum at read."""
    return _human_slots(stream, "1 minute").groupBy("slot").agg(
        F.approx_count_distinct("user_cookie").alias("users")
    )


def abuse_check(
    activity: DataFrame, as_of, limits: ips.IpThresholds = ips.IpThresholds()
) -> DataFrame:
    """Alert documents for the freshest window of the activity table."""
    profile = ips.ip_profile(ips.recent_activity(activity, as_of), ("window_rank",))
    threats = ips.ip_threats(stored(profile, "profile"), limits, ("window_rank",))
    return to_alerts(threats, as_of)


def watch_abuse(
    stream: DataFrame,
    read_table: Callable[[], DataFrame],
    path: str,
    checkpoint: str,
    interval: str | None = "2 hours",
    limits: ips.IpThresholds = ips.IpThresholds(),
) -> StreamingQuery:
    """Run the abuse check after every micro-batch, as of the newest event in it."""

    def work(df: DataFrame, batch_id: int) -> None:
        as_of = df.select(F.max("timestamp")).scalar()
        write_batch(abuse_check(read_table(), as_of, limits), path, batch_id)

    return _each_batch(stream, checkpoint, interval, work)
