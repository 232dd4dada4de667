"""Daily, weekly and per-host summaries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseline.functions import aggs
from pulseline.functions.timefn import LOCAL_TZ, date_num, local_date_num, to_day
from pulseline.operators.filters import between_days, for_host, humans, on_day, on_days, until_hour
from pulseline.operators.paging import page, top_n, with_total
from pulseline.operators.periods import compare_days, days_needed
from pulseline.operators.rollups import daily_rollup

# A session longer than this many seconds does not count as a stay.
MAX_STAY = 7200

TOTALS = ["users", "views", "bot_sessions"]


def new_users(first: DataFrame) -> DataFrame:
    """Distinct cookies per day on which they were first seen on some host."""
    return first.groupBy(F.col("first_date_num").alias("date_num")).agg(
        aggs.uniq("user_cookie").alias("new_users")
    )


def new_users_by_host(first: DataFrame) -> DataFrame:
    """Cookies per (day, host) of their first visit to the host."""
    return first.groupBy(F.col("first_date_num").alias("date_num"), "hostname").agg(
        F.count("*").alias("new_users")
    )


def _with_new(df: DataFrame, new: DataFrame, on) -> DataFrame:
    return df.join(new, on, "left").withColumn(
        "new_users", F.coalesce("new_users", F.lit(0))
    )


def summarize_days(rollup: DataFrame, first: DataFrame) -> DataFrame:
    """Day totals from a rollup by day, exact or merged from sketch states."""
    return _with_new(rollup.select("date_num", *TOTALS), new_users(first), "date_num")


def summarize_hosts(rollup: DataFrame, first: DataFrame) -> DataFrame:
    """Host summary from a rollup by day and host, exact or merged from sketch states."""
    stay = F.coalesce(F.round(aggs.ratio("stay_seconds", "sessions")), F.lit(0.0)).cast("bigint")
    keys = ["date_num", "hostname"]
    base = rollup.select(*keys, *TOTALS, stay.alias("avg_stay"))
    return _with_new(base, new_users_by_host(first), keys)


def summary_grand_total(ua: DataFrame, first: DataFrame, approx: bool = False) -> DataFrame:
    """Users, views, bot sessions and new users per day."""
    return summarize_days(daily_rollup(ua, ["date_num"], TOTALS, approx), first)


def summary_by_host(ua: DataFrame, first: DataFrame, approx: bool = False) -> DataFrame:
    """Per day and host: users, views, new users, average stay, bot sessions."""
    names = [*TOTALS, "stay_seconds", "sessions"]
    return summarize_hosts(daily_rollup(ua, names=names, approx=approx), first)


def summary_page(ua: DataFrame, first: DataFrame, day: int, limit: int = 20, offset: int = 0) -> DataFrame:
    """One page of a day's hosts, most users first, with the number of hosts."""
    today = on_day(ua, day)
    rows = summary_by_host(today, first.filter(F.col("first_date_num") == day))
    hosts = today.select("hostname").distinct()
    return with_total(page(rows, [F.desc("users"), "hostname"], limit, offset), hosts, limit=limit)


def _slice(ua: DataFrame, days) -> DataFrame:
    return ua if days is None else on_days(ua, days_needed(days))


def period_totals(ua: DataFrame, days=None, host=None) -> DataFrame:
    """Users, views and bot sessions of each report day, the day before and a week before."""
    rows = for_host(_slice(ua, days), host)
    return compare_days(daily_rollup(rows, ["date_num"], TOTALS), TOTALS, days=days)


def period_totals_same_hour(ua: DataFrame, hour: int, days=None, host=None) -> DataFrame:
    """All-traffic totals of the two earlier days up to a local hour.

    ``views`` counts distinct page loads, ``hits`` heartbeats.
    """
    rows = until_hour(for_host(_slice(ua, days), host), hour)
    metrics = ["users", "hits", "views", "bot_sessions"]
    totals = daily_rollup(rows, ["date_num"], metrics, with_bots=True)
    return compare_days(totals, metrics, days=days).filter("day_offset < 0")


def session_stays(ua: DataFrame) -> DataFrame:
    """Length and heartbeats of every session per day."""
    return ua.groupBy("date_num", "session_id").agg(
        (F.max("timestamp") - F.min("timestamp")).alias("stay"), F.count("*").alias("hits")
    )


def average_stay(ua: DataFrame) -> DataFrame:
    """Mean human stay per day over sessions of more than 0 and less than 7,200 seconds."""
    return (
        session_stays(humans(ua))
        .filter((F.col("stay") > 0) & (F.col("stay") < MAX_STAY))
        .groupBy("date_num")
        .agg(F.avg("stay").cast("bigint").alias("avg_stay"))
    )


def daily_report_totals(ua: DataFrame, first: DataFrame, days=None) -> DataFrame:
    """Report totals of each day, the day before and a week before.

    A day without human users reports zero everywhere, whatever its bots did.
    """
    rows = _slice(ua, days)
    metrics = TOTALS + ["new_users", "avg_stay"]
    totals = summary_grand_total(rows, first).join(average_stay(rows), "date_num", "left")
    has_users = F.col("users") > 0
    zeroed = {m: F.when(has_users, F.coalesce(m, F.lit(0))).otherwise(0) for m in metrics}
    return compare_days(totals.withColumns(zeroed), metrics, days=days)


def week_start(num) -> F.Column:
    """Monday of the week of a yyyymmdd column, as yyyymmdd."""
    return date_num(F.to_date(F.date_trunc("week", to_day(num))))


def _by_week(ua: DataFrame, first: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (
        ua.withColumn("week", week_start("date_num")),
        first.withColumn("week", week_start("first_date_num")),
    )


def _by_range(ua: DataFrame, first: DataFrame, start: int, end: int) -> tuple[DataFrame, DataFrame]:
    in_range = F.col("first_date_num").between(start, end)
    return (
        between_days(ua, start, end).withColumn("week", F.lit(start)),
        first.filter(in_range).withColumn("week", F.lit(start)),
    )


def _period_by_host(ua: DataFrame, first: DataFrame) -> DataFrame:
    totals = daily_rollup(ua, ["week", "hostname"], ["users", "views"])
    newcomers = first.select("week", "user_cookie").distinct()
    new = (
        ua.select("week", "hostname", "user_cookie")
        .distinct()
        .join(newcomers, ["week", "user_cookie"], "left_semi")
        .groupBy("week", "hostname")
        .agg(F.count("*").alias("new_users"))
    )
    return _with_new(totals, new, ["week", "hostname"])


def weekly_by_host(ua: DataFrame, first: DataFrame) -> DataFrame:
    """Users, views and new users per host for every Monday-to-Sunday week.

    New on a host: active there, and first seen on any host, in the same week.
    """
    return _period_by_host(*_by_week(ua, first))


def weekly_grand_total(ua: DataFrame, first: DataFrame) -> DataFrame:
    """Users, views and new users of every Monday-to-Sunday week."""
    ua, first = _by_week(ua, first)
    totals = daily_rollup(ua, ["week"], ["users", "views"])
    new = first.groupBy("week").agg(aggs.uniq("user_cookie").alias("new_users"))
    return _with_new(totals, new, "week")


def range_by_host(ua: DataFrame, first: DataFrame, start: int, end: int, n: int = 5000) -> DataFrame:
    """The hosts with most users over a day range."""
    rows = _period_by_host(*_by_range(ua, first, start, end)).drop("week")
    return top_n(rows, n, [F.desc("users"), "hostname"])


def range_grand_total(ua: DataFrame, first: DataFrame, start: int, end: int) -> DataFrame:
    """One row: users, views and new users over a day range."""
    totals = daily_rollup(between_days(ua, start, end), [], ["users", "views"])
    new = first.filter(F.col("first_date_num").between(start, end))
    return totals.withColumn("new_users", new.select(aggs.uniq("user_cookie")).scalar())


def host_sessions(ua: DataFrame) -> DataFrame:
    """First and last second of each (session, cookie, host) over the whole history."""
    return ua.groupBy("session_id", "user_cookie", "hostname").agg(
        F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts")
    )


def session_summary_by_host(ua: DataFrame, tz: str = LOCAL_TZ) -> DataFrame:
    """Users, sessions, new users and mean session length per start day and host.

    A cookie is new on the day its first session on the host starts, so new users are
    counted from one row per (cookie, host) instead of joining it back to the sessions.
    """
    sessions = host_sessions(ua).withColumn("date_num", local_date_num("first_ts", tz))
    base = sessions.groupBy("date_num", "hostname").agg(
        aggs.uniq("user_cookie").alias("users"),
        F.count("*").alias("sessions"),
        aggs.round_at(F.avg(F.col("last_ts") - F.col("first_ts")), 4).alias("avg_stay"),
    )
    first = ua.groupBy("user_cookie", "hostname").agg(F.min("timestamp").alias("first_ts"))
    new = first.groupBy(local_date_num("first_ts", tz).alias("date_num"), "hostname").agg(
        F.count("*").alias("new_users")
    )
    return _with_new(base, new, ["date_num", "hostname"])
