"""Session detail and engagement."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseline.functions import aggs
from pulseline.operators.filters import ip_contains, on_day
from pulseline.operators.paging import page, page_after, with_total
from pulseline.operators.summary import session_stays

SESSION_KEYS = ["session_id", "user_cookie", "date_num"]


def session_detail(ua: DataFrame, ip: str | None = None) -> DataFrame:
    """One row per session, cookie and day: latest page, first attributes, times."""
    sample = ["referer", "browser", "is_bot", "ip_user", "domain"]
    loads = aggs.fold(ip_contains(ua, ip), *SESSION_KEYS, "hostname", "url", *sample)
    return (
        loads.groupBy(*SESSION_KEYS)
        .agg(
            aggs.last_of("hostname", "url").alias("last"),
            aggs.first_of(*sample).alias("first"),
            F.min("first_ts").alias("first_ts"),
            F.max("last_ts").alias("last_ts"),
        )
        .select(
            *SESSION_KEYS,
            "last.hostname",
            "last.url",
            "first.referer",
            "first.browser",
            "first.is_bot",
            "first.ip_user",
            "first.domain",
            "first_ts",
            "last_ts",
            (F.col("last_ts") - F.col("first_ts")).alias("stay_duration"),
        )
    )


def _sessions(ua: DataFrame, day: int, ip: str | None) -> DataFrame:
    return ip_contains(on_day(ua, day), ip).select(*SESSION_KEYS).distinct()


def session_page(ua: DataFrame, day: int, ip: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of a day's sessions, newest first, with the number of sessions."""
    rows = session_detail(on_day(ua, day), ip)
    order = [F.desc("last_ts"), F.desc("session_id"), F.desc("user_cookie")]
    return with_total(page(rows, order, limit, offset), _sessions(ua, day, ip), "total_count", limit)


def session_page_after(ua: DataFrame, day: int, cursor, ip: str | None = None, limit: int = 50) -> DataFrame:
    """The page behind ``cursor``, the (last_ts, session_id, user_cookie) of the last row shown."""
    rows = session_detail(on_day(ua, day), ip)
    return page_after(rows, ["last_ts", "session_id", "user_cookie"], cursor, limit)


def engagement(ua: DataFrame) -> DataFrame:
    """Average stay and bounce rate per day over all traffic."""
    return session_stays(ua).groupBy("date_num").agg(
        aggs.round_at(aggs.avg_or_zero("stay"), 1).alias("avg_duration"),
        bounce_rate().alias("bounce_rate"),
    )


def bounce_rate() -> F.Column:
    """Percentage of sessions with a single heartbeat."""
    return aggs.round_at(100 * F.count_if(F.col("hits") == 1) / F.count("*"), 1)
