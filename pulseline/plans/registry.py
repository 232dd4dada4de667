"""Named queries over the test tables: one entry per operator."""

import os
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseline.functions.text import ATTACK_PATTERN, SENSITIVE_PATTERN
from pulseline.operators import (
    alerts,
    clusters,
    filters,
    ips,
    journeys,
    paging,
    periods,
    realtime,
    referers,
    rollups,
    sessions,
    summary,
    trends,
)
from pulseline.session import configure, stored, work_dir
from pulseline.sources import alert_table, export, ingest, ip_index, tables, testdata
from pulseline.streaming import addresses, jobs, live, panes, seen

DAY = 20240115
WEEK = (20240108, 20240114)
HOUR = 13
MINUTES = 1440
CLUSTER_LIMITS = clusters.ClusterThresholds(ips=3, sensitive_requests=1)
REFERER_LISTS = referers.RefererLists(high_traffic=2)
DISMISSED = ["203.0.113.9", "10.0.0.0"]

SEEN_BUCKETS = 16

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


class Tables:
    """The activity model and the base tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = configure(spark), sf_dir

    @cached_property
    def ua(self) -> DataFrame:
        return testdata.activity(self.spark, self.sf_dir)

    def days(self, first: int, last: int) -> DataFrame:
        """Activity of a day range; the bound reaches the event scan."""
        ua = testdata.activity(self.spark, self.sf_dir, first, last)
        return filters.between_days(ua, first, last)

    @cached_property
    def first(self) -> DataFrame:
        return rollups.first_seen(self.ua)

    @property
    def as_of(self):
        """The newest event second, from the event times alone."""
        return self.table("events").select(F.unix_timestamp(F.max("ts"))).scalar()

    def busiest_host(self):
        hits = _hits(self.ua, "hostname")
        return paging.top_n(hits, 1, [F.desc("hits"), "hostname"]).select("hostname").scalar()

    def table(self, name: str) -> DataFrame:
        return testdata.table(self.spark, self.sf_dir, name)

    def threats(self) -> DataFrame:
        """Verdicts on a stored profile, which the shared-agent rule reads a second time."""
        return ips.ip_threats(stored(ips.ip_profile(self.ua), "profile"))

    def alert_rows(self) -> DataFrame:
        at = F.unix_timestamp(F.col("date_num").cast("string"), "yyyyMMdd")
        return alerts.to_alerts(self.threats(), at)

    def dir(self, name: str) -> str:
        return work_dir(self.spark, name)


def report(fn):
    """Register a query written against ``Tables``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Tables(spark, sf_dir))

    QUERIES[fn.__name__] = run
    return fn


# Sources, ingest, sinks


@report
def activity(t):
    return t.ua


@report
def row_count(t):
    return tables.row_count(t.ua)


@report
def normalized_events(t):
    return ingest.normalize_events(testdata.raw_messages(t.spark, t.sf_dir))[0]


@report
def refused_messages(t):
    return ingest.normalize_events(testdata.raw_messages(t.spark, t.sf_dir))[1]


@report
def enriched_time(t):
    log = testdata.request_log(t.spark, t.sf_dir).drop("id")
    return ingest.enrich_time(log).select("id", "timestamp", "date_num", "created_at")


@report
def client_ip(t):
    log = testdata.request_log(t.spark, t.sf_dir)
    return ingest.resolve_ip(log).select("id", "ip_user")


@report
def bot_flags(t):
    return ingest.mark_bots(t.ua.drop("is_bot")).groupBy("browser", "is_bot").agg(
        F.count("*").alias("hits")
    )


@report
def legacy_events(t):
    messages = testdata.legacy_messages(t.spark, t.sf_dir)
    good, _ = ingest.normalize_legacy(messages, 1704067200)
    seconds = {c: F.unix_timestamp(c) for c in ("timestamp", "created_at")}
    return good.withColumns(seconds)


@report
def activity_table(t):
    """Write the partitioned table and read it back."""
    path = t.dir("activity")
    tables.write_activity(t.ua, path)
    return tables.read_activity(t.spark, path)


@report
def csv_export(t):
    path = t.dir("csv")
    rows = ips.riskiest(ips.ip_profile(t.ua)).select(
        "date_num", "ip_user", "total_requests", "user_agent", "sample_referer", "rps"
    )
    export.export_csv(rows, path, short=["user_agent", "sample_referer"])
    back = t.spark.read.schema(rows.schema).option("header", True).option("escape", '"').csv(path)
    return back.fillna("")


@report
def csv_export_paths(t):
    path = t.dir("csv")
    rows = journeys.journeys(t.ua)
    export.export_csv(rows, path, short=["ua_short"], paths=["path"])
    back = t.spark.read.schema(rows.schema).option("header", True).option("escape", '"').csv(path)
    return back.fillna("")


@report
def json_export(t):
    path = t.dir("json")
    rows = summary.session_summary_by_host(t.ua)
    export.export_json(rows, path)
    return t.spark.read.schema(rows.schema).json(path)


@report
def loaded_verdicts(t):
    path = t.dir("reports")
    testdata.write_reports(t.threats(), path)
    day = F.regexp_extract("report", r"date_num=(\d+)", 1).cast("int")
    return tables.load_verdicts(t.spark, path).withColumn("date_num", day).drop("report", "line_no")


@report
def loaded_alerts(t):
    path = t.dir("alerts")
    testdata.write_alert_documents(t.alert_rows(), path)
    return tables.load_alerts(t.spark, path)


# Maintained tables


@report
def online_slots(t):
    return rollups.online_slots(t.ua)


@report
def online_slots_refresh(t):
    return rollups.online_slots(t.ua, t.as_of, MINUTES * 60)


@report
def daily_rollup(t):
    return rollups.daily_rollup(t.ua)


@report
def touched_dates(t):
    return rollups.touched_dates(t.ua, t.as_of)


@report
def refresh_rollup(t):
    return rollups.refresh_rollup(t.ua, t.as_of)


@report
def first_seen(t):
    return t.first


@report
def daily_rollup_sketch(t):
    """Sketch states merged per day and host."""
    return rollups.merge_states(rollups.rollup_states(t.ua))


@report
def daily_rollup_sketch_by_day(t):
    """Host states merged into day totals without reading the activity again."""
    states = rollups.rollup_states(t.ua)
    return rollups.merge_states(rollups.compact_states(states), by=["date_num"])


@report
def monthly_users_bitmap(t):
    """Exact users per month from the days' bitmaps alone."""
    numbers = stored(rollups.cookie_numbers(t.ua), "numbers")
    states = rollups.bitmap_states(t.ua, numbers).withColumn("month", F.floor(F.col("date_num") / 100))
    return rollups.bitmap_users(states, by=["month"])


@report
def daily_new_users_sketch_error(t):
    """New users against the week before, exact, and whether the day sketches give them within five percent."""
    seen = filters.humans(t.ua).select("date_num", "user_cookie").distinct()
    day = F.datediff(F.to_date(F.col("date_num").cast("string"), "yyyyMMdd"), F.lit("1970-01-01"))
    before = F.lag(day).over(Window.partitionBy("user_cookie").orderBy("date_num"))
    fresh = seen.withColumn("fresh", F.coalesce(day - before > 7, F.lit(True)))
    exact = fresh.groupBy("date_num").agg(F.count_if("fresh").alias("new_users"))
    found = rollups.new_against_before(rollups.user_sets(t.ua)).withColumnRenamed("new_users", "near")
    close = F.abs(F.col("near") - F.col("new_users")) <= F.greatest(F.lit(1.0), 0.05 * F.col("users"))
    return exact.join(found, "date_num").select("date_num", "new_users", close.cast("int").alias("close"))


@report
def daily_rollup_sketch_error(t):
    """Merged sketches against exact counts: sums equal, distincts within five percent."""
    exact = rollups.daily_rollup(t.ua, by=["date_num"])
    merged = rollups.merge_states(rollups.rollup_states(t.ua), by=["date_num"])
    close = {
        f"{k}_close": (
            F.abs(F.col(f"m.{k}") - F.col(f"e.{k}")) <= F.greatest(F.lit(1.0), 0.05 * F.col(f"e.{k}"))
        ).cast("int")
        for k in ("users", "views", "sessions", "bot_sessions")
    }
    return (
        exact.alias("e")
        .join(merged.alias("m"), "date_num")
        .select("date_num", F.col("m.bot_hits"), F.col("m.stay_seconds"), *[c.alias(n) for n, c in close.items()])
    )


@report
def online_slots_sketch(t):
    return rollups.merge_states(rollups.slot_states(t.ua), by=["slot_start", "hostname"])


# Filters and predicates


def _hits(df, *by):
    return df.groupBy(*by).agg(F.count("*").alias("hits"))


@report
def day_filter(t):
    return _hits(filters.on_day(t.days(DAY, DAY), DAY), "date_num", "hostname")


@report
def day_list_filter(t):
    return _hits(filters.on_days(t.ua, periods.days_needed([DAY])), "date_num", "hostname")


@report
def day_range_filter(t):
    return _hits(filters.between_days(t.days(*WEEK), *WEEK), "date_num", "hostname")


@report
def host_filter(t):
    return _hits(filters.for_host(t.ua, t.busiest_host()), "date_num", "hostname")


@report
def ip_search(t):
    return _hits(filters.ip_contains(t.ua, " 10.0.0.1"), "ip_user")


@report
def ip_search_index(t):
    """The same search from the trigram index."""
    path = t.dir("index")
    ip_index.write_index(t.ua, path)
    found = ip_index.search(t.spark, path, " 10.0.0.1")
    return found.groupBy("ip_user").agg(F.sum("hits").alias("hits"))


@report
def time_range_filter(t):
    end = t.as_of - F.lit(86400)
    return _hits(filters.time_range(t.ua, end - F.lit(3 * 86400), end), "date_num", "hostname")


@report
def hour_cutoff(t):
    return _hits(filters.until_hour(t.ua, HOUR), "date_num")


@report
def human_page_hits(t):
    return _hits(filters.with_url(filters.humans(t.ua)), "date_num", "url")


@report
def direct_hits(t):
    return _hits(filters.without_referer(t.ua), "date_num", "hostname")


@report
def sensitive_hits(t):
    return _hits(filters.matching(t.ua, "url", SENSITIVE_PATTERN), "date_num", "url")


@report
def attack_hits(t):
    return _hits(filters.matching(t.ua, "url", ATTACK_PATTERN), "date_num", "url")


# Daily and weekly reports


@report
def summary_grand_total(t):
    return summary.summary_grand_total(t.ua, t.first)


@report
def summary_by_host(t):
    return summary.summary_by_host(t.ua, t.first)


@report
def summary_page(t):
    return summary.summary_page(t.days(DAY, DAY), t.first, DAY, limit=10, offset=10)


@report
def summary_grand_total_approx(t):
    return summary.summary_grand_total(t.ua, t.first, approx=True)


@report
def summary_by_host_sketch(t):
    """The host summary from sketch states instead of the activity."""
    return summary.summarize_hosts(rollups.merge_states(rollups.rollup_states(t.ua)), t.first)


@report
def session_detail(t):
    return sessions.session_detail(t.ua)


@report
def session_page(t):
    return sessions.session_page(t.days(DAY, DAY), DAY, ip="10.0", limit=50, offset=20)


@report
def session_page_deep(t):
    """The page in the middle of all sessions of all days, by rank."""
    order = [F.desc("last_ts"), F.desc("session_id"), F.desc("user_cookie"), F.desc("date_num")]
    ranks = paging.ranked(sessions.session_detail(t.ua), order)
    rows = paging.ranked_page(ranks, limit=50, offset=ranks.total // 2)
    return rows.withColumn("total_count", F.lit(ranks.total).cast("bigint"))


@report
def session_page_after(t):
    cursor = (1705330000, "s", "")
    return sessions.session_page_after(t.days(DAY, DAY), DAY, cursor, limit=50)


@report
def online_by_host(t):
    return realtime.online_by_host(rollups.slot_keys(t.ua), t.as_of, MINUTES)


@report
def online_by_host_sketch(t):
    return realtime.online_by_host(rollups.slot_states(t.ua), t.as_of, MINUTES)


@report
def online_page(t):
    return realtime.online_page(rollups.slot_keys(t.ua), t.as_of, MINUTES, limit=20)


@report
def period_totals(t):
    return summary.period_totals(t.ua)


@report
def period_totals_one_day(t):
    """The report of one day and host; days without traffic are zero."""
    return summary.period_totals(t.ua, days=[20240104], host=t.busiest_host())


@report
def period_totals_same_hour(t):
    return summary.period_totals_same_hour(t.ua, HOUR)


@report
def period_change(t):
    return periods.period_change(rollups.daily_rollup(t.ua, names=["users", "views", "bot_sessions"]))


@report
def period_change_total(t):
    totals = rollups.daily_rollup(t.ua, by=["date_num"], names=["users", "views", "bot_sessions"])
    return periods.period_change(totals, by=())


@report
def top_hosts(t):
    return trends.top_hosts(t.ua)


@report
def top_sources_domain(t):
    return trends.top_sources_domain(t.ua)


@report
def top_pages(t):
    return trends.top_pages(t.ua)


@report
def top_ips(t):
    return trends.top_ips(t.ua)


@report
def hourly_trend(t):
    return trends.hourly_trend(t.ua)


@report
def peak_hour(t):
    return trends.peak_hour(t.ua)


@report
def device_breakdown(t):
    return trends.device_breakdown(t.ua)


@report
def engagement(t):
    return sessions.engagement(t.ua)


@report
def traffic_label(t):
    rollup = rollups.daily_rollup(t.ua, names=["users"])
    return periods.traffic_label(rollup, threshold=5)


@report
def daily_report_totals(t):
    return summary.daily_report_totals(t.ua, t.first)


@report
def daily_top_sources_raw(t):
    return trends.daily_top_sources_raw(t.ua)


@report
def daily_top_pages(t):
    return trends.daily_top_pages(t.ua)


@report
def daily_bounce(t):
    return trends.daily_bounce(t.ua)


@report
def daily_top_hosts(t):
    return trends.daily_top_hosts(t.ua)


@report
def weekly_by_host(t):
    return summary.weekly_by_host(t.ua, t.first)


@report
def weekly_grand_total(t):
    return summary.weekly_grand_total(t.ua, t.first)


@report
def range_by_host(t):
    return summary.range_by_host(t.days(*WEEK), t.first, *WEEK)


@report
def range_grand_total(t):
    return summary.range_grand_total(t.days(*WEEK), t.first, *WEEK)


@report
def window_stats(t):
    return realtime.window_stats(t.ua, t.as_of, MINUTES)


@report
def window_devices(t):
    return realtime.window_devices(t.ua, t.as_of, MINUTES)


@report
def realtime_by_host(t):
    return realtime.realtime_by_host(t.ua, t.as_of, MINUTES)


@report
def realtime_total(t):
    return realtime.realtime_total(t.ua, t.as_of, MINUTES)


@report
def session_summary_by_host(t):
    return summary.session_summary_by_host(t.ua)


# Threats and alerts


@report
def ip_profile(t):
    return ips.ip_profile(t.ua)


@report
def ip_profile_top(t):
    return ips.riskiest(ips.ip_profile(t.ua), n=100)


@report
def ip_profile_recent(t):
    return ips.ip_profile_recent(t.ua, t.as_of)


@report
def ip_threats(t):
    return t.threats()


@report
def journeys_all_days(t):
    return journeys.journeys(t.ua)


@report
def journeys_one_day(t):
    return journeys.journeys(t.days(DAY, DAY), days=[DAY])


@report
def page_moves(t):
    return journeys.page_moves(t.ua)


@report
def journey_threats(t):
    return journeys.journey_threats(t.ua)


@report
def url_clusters(t):
    return clusters.url_clusters(t.ua)


@report
def url_cluster_threats(t):
    return clusters.url_cluster_threats(clusters.url_clusters(t.ua), CLUSTER_LIMITS)


@report
def referer_targets(t):
    return referers.referer_targets(t.ua)


@report
def referer_profile(t):
    return referers.referer_profile(t.ua, t.table("pages"))


@report
def referer_threats(t):
    return referers.referer_threats(referers.referer_profile(t.ua, t.table("pages")), REFERER_LISTS)


@report
def alerts_dedupe(t):
    return alerts.alerts_dedupe(t.threats(), order=["date_num"])


@report
def alerts_search(t):
    return alerts.alerts_search(t.alert_rows(), "ATTACK")


@report
def alerts_page(t):
    return alerts.alerts_page(t.alert_rows(), "scan", limit=20, offset=20)


@report
def alerts_dismiss(t):
    return alerts.alerts_dismiss(t.alert_rows(), DISMISSED)


@report
def alerts_dismiss_table(t):
    rows = t.alert_rows()
    return alerts.alerts_dismiss(rows, rows.filter("threat_type = 'Multi-host Scan'"))


@report
def alerts_table(t):
    """Alerts of two loads with a dismissal between them, folded, dismissed from again, and read."""
    path, rows = t.dir("alerts"), stored(t.alert_rows(), "rows")
    early = F.unix_timestamp(F.lit(str(DAY)), "yyyyMMdd")
    alert_table.add_alerts(rows.filter(F.col("timestamp") < early), path)
    alert_table.dismiss(t.spark.createDataFrame([(ip,) for ip in DISMISSED], "ip string"), path)
    alert_table.add_alerts(rows.filter(F.col("timestamp") >= early), path)
    alert_table.compact(t.spark, path)
    alert_table.dismiss(rows.filter("threat_type = 'Multi-host Scan'"), path)
    return alert_table.read_alerts(t.spark, path)


@report
def blocklist(t):
    return alerts.blocklist(t.threats())


# Streams: run over everything that is there, then read the tables they keep


def _streamed(t: Tables) -> DataFrame:
    """The activity stream of the event files."""
    events = t.spark.readStream.schema(t.table("events").schema).parquet(f"{t.sf_dir}/events*.parquet")
    return testdata.to_activity(events, t.table("pages"))


def _in_files(t: Tables, files: int) -> DataFrame:
    """The activity stream in one micro-batch per file."""
    source, events = t.dir("events"), t.table("events")
    events.repartition(files).write.parquet(source)
    stream = t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1)
    return testdata.to_activity(stream.parquet(source), t.table("pages"))


def _in_order(t: Tables, batches: int) -> DataFrame:
    """The activity stream in micro-batches that follow one another in time.

    Every batch has the same number of files, so that many tasks write and read them.
    """
    source, events = t.dir("events"), t.table("events")
    files = min(t.spark.sparkContext.defaultParallelism, events.rdd.getNumPartitions())
    shares = [i / batches for i in range(1, batches)]
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = [None, *events.agg(F.percentile_approx(at, shares)).first()[0], None]
    for n, (low, high) in enumerate(zip(cuts, cuts[1:]), 1):
        inside = (F.lit(True) if low is None else at > low) & (F.lit(True) if high is None else at <= high)
        events.filter(inside).coalesce(files).write.mode("append").parquet(source)
        # A task without rows writes no file; with too few, a batch would take some of the next.
        while len(t.spark.read.schema(events.schema).parquet(source).inputFiles()) < n * files:
            events.limit(0).write.mode("append").parquet(source)
    stream = t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files)
    return testdata.to_activity(stream.parquet(source), t.table("pages"))


@report
def stream_activity(t):
    path, checkpoint = t.dir("activity"), t.dir("checkpoint")
    jobs.append_activity(_streamed(t), path, checkpoint, interval=None).awaitTermination()
    return tables.read_activity(t.spark, path)


@report
def stream_messages(t):
    """JSON message files through parsing into the activity table."""
    source, good, bad = t.dir("messages"), t.dir("good"), t.dir("bad")
    testdata.raw_messages(t.spark, t.sf_dir).write.text(source)
    messages = ingest.read_activity_stream(t.spark, path=source, max_per_trigger=4)
    jobs.ingest_messages(messages, good, bad, t.dir("checkpoint"), interval=None).awaitTermination()
    return t.spark.read.parquet(good).drop(jobs.BATCH)


@report
def stream_heartbeats(t):
    """Heartbeat requests of several micro-batches into the activity table."""
    source, path = t.dir("requests"), t.dir("activity")
    requests = testdata.heartbeat_requests(t.spark, t.sf_dir)
    requests.repartition(4).write.parquet(source)
    stream = t.spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 1)
    jobs.ingest_heartbeats(
        stream.parquet(source), path, t.dir("checkpoint"), interval=None
    ).awaitTermination()
    return t.spark.read.parquet(path).drop(jobs.BATCH)


@report
def stream_settled_activity(t):
    """Streamed batches rewritten into the clustered table, day by day."""
    path, table = t.dir("batches"), t.dir("activity")
    jobs.keep_table(
        _in_files(t, 4), path, t.dir("checkpoint"), lambda df: df, interval=None
    ).awaitTermination()
    jobs.settle_activity(t.spark, path, table, 0, DAY)
    jobs.settle_activity(t.spark, path, table, DAY + 1, 99991231)
    return tables.read_activity(t.spark, table)


@report
def stream_online_slots(t):
    path = t.dir("slots")
    jobs.keep_slots(_streamed(t), path, t.dir("checkpoint"), interval=None).awaitTermination()
    return jobs.read_slots(t.spark, path).groupBy("slot_start", "hostname").agg(
        F.count("*").alias("active_users")
    )


@report
def stream_closed_slots(t):
    path = t.dir("closed")
    slots = jobs.closed_slots(_streamed(t)).select(
        F.unix_timestamp("slot.start").alias("slot_start"), "hostname", "active_users"
    )
    writer = slots.writeStream.format("parquet").option("path", path)
    writer = writer.option("checkpointLocation", t.dir("checkpoint")).outputMode("append")
    writer.trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema("slot_start bigint, hostname string, active_users bigint").parquet(path)


@report
def stream_daily_rollup(t):
    path = t.dir("loads")
    jobs.keep_rollup(_streamed(t), path, t.dir("checkpoint"), interval=None).awaitTermination()
    return rollups.rollup_from_loads(jobs.read_loads(t.spark, path))


@report
def stream_summary_by_host(t):
    """The host summary from the two streamed tables alone."""
    loads, first = t.dir("loads"), t.dir("first")
    jobs.keep_rollup(_streamed(t), loads, t.dir("checkpoint"), interval=None).awaitTermination()
    jobs.keep_first_seen(_streamed(t), first, t.dir("checkpoint"), interval=None).awaitTermination()
    rollup = rollups.rollup_from_loads(jobs.read_loads(t.spark, loads))
    return summary.summarize_hosts(rollup, jobs.read_first_seen(t.spark, first))


@report
def stream_daily_rollup_sketch(t):
    path = t.dir("states")
    jobs.keep_rollup(_streamed(t), path, t.dir("checkpoint"), interval=None, approx=True).awaitTermination()
    return rollups.merge_states(jobs.read_states(t.spark, path))


@report
def stream_first_seen(t):
    path = t.dir("first")
    jobs.keep_first_seen(_streamed(t), path, t.dir("checkpoint"), interval=None).awaitTermination()
    return jobs.read_first_seen(t.spark, path)


@report
def stream_first_seen_upsert(t):
    """First-seen days from a bucketed table that several micro-batches add their new pairs to."""
    path, name = t.dir("seen"), f"seen_{os.urandom(6).hex()}"
    seen.keep_seen(
        _in_files(t, 3), name, path, t.dir("checkpoint"), interval=None, buckets=SEEN_BUCKETS
    ).awaitTermination()
    return seen.read_seen(t.spark, name, path, SEEN_BUCKETS)


@report
def stream_rollup_compacted(t):
    """The rollup from a base of two folded batches, split by day, and two open ones."""
    path, base = t.dir("loads"), t.dir("base")
    jobs.keep_rollup(_in_files(t, 4), path, t.dir("checkpoint"), interval=None).awaitTermination()
    jobs.compact(t.spark, path, base, 1, rollups.merge_page_loads)
    return rollups.rollup_from_loads(jobs.read_loads(t.spark, path, base))


@report
def stream_first_seen_compacted(t):
    """First-seen days of one week from the settled base alone."""
    path, base = t.dir("first"), t.dir("base")
    jobs.keep_first_seen(
        _in_files(t, 4), path, t.dir("checkpoint"), interval=None
    ).awaitTermination()
    jobs.compact(t.spark, path, base, 3, rollups.merge_first_seen)
    return jobs.settled_first_seen(t.spark, base, *WEEK)


def _changes(t: Tables, stream: DataFrame) -> DataFrame:
    """The change log of an update-mode aggregate, as a table."""
    path = t.dir("changes")
    writer = stream.writeStream.outputMode("update").option("checkpointLocation", t.dir("checkpoint"))
    writer = writer.foreachBatch(lambda df, batch_id: jobs.write_batch(df, path, batch_id))
    writer.trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(path)


@report
def stream_live_slots(t):
    """Approximate live slots: the last change of every slot and host."""
    log = _changes(t, jobs.live_slots(_streamed(t)))
    last = F.max(F.struct(jobs.BATCH, "active_users"))["active_users"]
    return log.groupBy(F.unix_timestamp("slot.start").alias("slot_start"), "hostname").agg(
        last.alias("active_users")
    )


@report
def stream_open_slots(t):
    """Exact users of every slot from state with timers, over several micro-batches."""
    path, tasks = t.dir("open"), 2 * t.spark.sparkContext.defaultParallelism
    live.keep_users(
        _in_order(t, 3), path, t.dir("checkpoint"), interval=None, partitions=tasks, period=86400, parts=2
    ).awaitTermination()
    return live.read_users(t.spark, path)


@report
def stream_minute_peak(t):
    """Users of the busiest minute of all, exact."""
    path = t.dir("minutes")
    live.keep_users(
        _streamed(t), path, t.dir("checkpoint"), None, seconds=60, by_host=False, period=86400, parts=2
    ).awaitTermination()
    return live.read_users(t.spark, path).agg(F.max("active_users").alias("peak"))


@report
def stream_minute_peak_approx(t):
    """Busiest minute of all, from sketches."""
    return _changes(t, jobs.minute_users(_streamed(t))).agg(F.max("users").alias("peak"))


def _panes(t: Tables) -> DataFrame:
    path = t.dir("panes")
    panes.keep_panes(_in_files(t, 3), path, t.dir("checkpoint"), interval=None).awaitTermination()
    return panes.read_panes(t.spark, path)


@report
def stream_sliding_hits(t):
    return panes.sliding_hits(_panes(t), minutes=30)


@report
def stream_sliding_users(t):
    return panes.sliding_users(_panes(t), minutes=30)


@report
def stream_abuse_alerts(t):
    path = t.dir("alerts")
    jobs.watch_abuse(_streamed(t), lambda: t.ua, path, t.dir("checkpoint"), interval=None).awaitTermination()
    return t.spark.read.parquet(path).drop(jobs.BATCH)


@report
def stream_abuse_by_address(t):
    """Alerts from the state of the addresses of the batch."""
    path = t.dir("watched")
    addresses.watch_addresses(_streamed(t), path, t.dir("checkpoint"), interval=None, parts=2).awaitTermination()
    return addresses.read_alerts(t.spark, path).drop(jobs.BATCH)
