"""Top lists, hourly trend and devices, each per day of the input."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseline.functions import aggs
from pulseline.functions.text import DIRECT_SOURCE, blank, device_of, host_of
from pulseline.functions.timefn import LOCAL_TZ, local_hour
from pulseline.operators.filters import humans, with_url
from pulseline.operators.paging import top_n
from pulseline.operators.rollups import daily_rollup
from pulseline.operators.sessions import bounce_rate
from pulseline.operators.summary import session_stays

DAY = ["date_num"]


def _top(df: DataFrame, n: int, metric: str, key: str) -> DataFrame:
    return top_n(df, n, [F.desc(metric), key], per=DAY)


def top_hosts(ua: DataFrame, n: int = 5) -> DataFrame:
    return _top(daily_rollup(ua, names=["users", "views", "bot_sessions"]), n, "users", "hostname")


def _sources(ua: DataFrame, source, approx: bool = False) -> DataFrame:
    return ua.groupBy(*DAY, source.alias("source")).agg(
        aggs.uniq("session_id", approx=approx).alias("sessions")
    )


def top_sources_domain(ua: DataFrame, n: int = 3, approx: bool = False) -> DataFrame:
    """Referring hosts by distinct sessions."""
    source = F.when(blank("referer"), DIRECT_SOURCE).otherwise(host_of("referer"))
    return _top(_sources(ua, source, approx), n, "sessions", "source")


def _hits(ua: DataFrame, key: str) -> DataFrame:
    return ua.groupBy(*DAY, key).agg(F.count("*").alias("hits"))


def top_pages(ua: DataFrame, n: int = 3) -> DataFrame:
    return _top(_hits(ua, "url"), n, "hits", "url")


def top_ips(ua: DataFrame, n: int = 10) -> DataFrame:
    return _top(_hits(ua, "ip_user"), n, "hits", "ip_user")


def hourly_trend(ua: DataFrame, tz: str = LOCAL_TZ, approx: bool = False) -> DataFrame:
    """Distinct users per local hour."""
    return ua.groupBy(*DAY, local_hour("timestamp", tz).alias("hour")).agg(
        aggs.uniq("user_cookie", approx=approx).alias("users")
    )


def peak_hour(ua: DataFrame, tz: str = LOCAL_TZ) -> DataFrame:
    """The hour with most users; the earliest one on a tie."""
    best = F.max(F.struct("users", (-F.col("hour")).alias("minus_hour")))
    return (
        hourly_trend(ua, tz)
        .groupBy(*DAY)
        .agg(best.alias("best"))
        .select(*DAY, (-F.col("best.minus_hour")).alias("hour"), "best.users")
    )


def device_breakdown(
    ua: DataFrame, by: str = "session_id", per=("date_num",), approx: bool = False
) -> DataFrame:
    """Distinct sessions (or cookies) on mobile and desktop."""
    return ua.groupBy(*per, device_of("browser").alias("device")).agg(
        aggs.uniq(by, approx=approx).alias("visitors")
    )


def daily_top_sources_raw(ua: DataFrame, n: int = 3) -> DataFrame:
    """Full referers of human traffic by distinct sessions."""
    source = F.when(blank("referer"), DIRECT_SOURCE).otherwise(F.col("referer"))
    return _top(_sources(humans(ua), source), n, "sessions", "source")


def daily_top_pages(ua: DataFrame, n: int = 3) -> DataFrame:
    return _top(_hits(with_url(humans(ua)), "url"), n, "hits", "url")


def daily_bounce(ua: DataFrame) -> DataFrame:
    return session_stays(humans(ua)).groupBy(*DAY).agg(bounce_rate().alias("bounce_rate"))


def daily_top_hosts(ua: DataFrame, n: int = 5) -> DataFrame:
    return _top(daily_rollup(ua, names=["users"]), n, "users", "hostname")
