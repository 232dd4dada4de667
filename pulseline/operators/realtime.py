"""Online users and trailing-window statistics at an explicit ``as_of`` second."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseline.functions import aggs
from pulseline.functions.timefn import as_column, slot_start
from pulseline.operators.filters import humans, trailing
from pulseline.operators.paging import page, top_n, with_total
from pulseline.operators.rollups import merge_states
from pulseline.operators.summary import MAX_STAY
from pulseline.operators.trends import device_breakdown

# Window lengths of the live views.
ONLINE_SLOTS_MINUTES = 30
ONLINE_NOW_SECONDS = 120
MINUTE = 60


def recent_slots(slots: DataFrame, as_of, minutes: int = ONLINE_SLOTS_MINUTES) -> DataFrame:
    """Slot rows that start in the last ``minutes``."""
    as_of = as_column(as_of)
    start = F.col("slot_start")
    return slots.filter((start >= as_of - F.lit(minutes * MINUTE)) & (start <= as_of))


def online_by_host(slots: DataFrame, as_of, minutes: int = ONLINE_SLOTS_MINUTES) -> DataFrame:
    """Users per host over the recent slots.

    ``slots`` holds distinct (slot, host, cookie) rows, or sketch states per slot and host.
    """
    recent = recent_slots(slots, as_of, minutes)
    if "active_users_state" in slots.columns:
        return merge_states(recent, by=["hostname"])
    return recent.groupBy("hostname").agg(aggs.uniq("user_cookie").alias("active_users"))


def online_page(slots: DataFrame, as_of, minutes: int = ONLINE_SLOTS_MINUTES, limit: int = 20, offset: int = 0) -> DataFrame:
    rows = online_by_host(slots, as_of, minutes)
    found = page(rows, [F.desc("active_users"), "hostname"], limit, offset)
    return with_total(found, rows.select("hostname"), limit=limit)


def _window(ua: DataFrame, as_of, minutes: int) -> DataFrame:
    return humans(trailing(ua, as_of, minutes * MINUTE))


def window_stats(ua: DataFrame, as_of, minutes: int = 30) -> DataFrame:
    """One row: hits, users, new and online users, busiest minute, mean stay.

    New users were absent from the preceding window of the same length. Presence in
    the windows is folded into one row per cookie, so no anti join is needed.
    """
    as_of = as_column(as_of)
    span = minutes * MINUTE
    current = F.col("timestamp") >= as_of - F.lit(span)
    before = ~current & (F.col("timestamp") >= as_of - F.lit(2 * span))
    visitors = (
        humans(trailing(ua, as_of, max(2 * span, ONLINE_NOW_SECONDS)))
        .groupBy("user_cookie")
        .agg(
            F.count_if(current).alias("hits"),
            F.max(before).alias("before"),
            F.max(F.col("timestamp") >= as_of - F.lit(ONLINE_NOW_SECONDS)).alias("online"),
        )
    )
    here = F.col("hits") > 0
    main = visitors.agg(
        F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"),
        F.count_if(here).alias("users"),
        F.count_if(here & ~F.col("before")).alias("new_users"),
        F.count_if("online").alias("online"),
    )
    now = _window(ua, as_of, minutes)
    peak = (
        now.groupBy(slot_start("timestamp", MINUTE).alias("minute"))
        .agg(aggs.uniq("user_cookie").alias("users"))
        .select(F.coalesce(F.max("users"), F.lit(0)))
    )
    stay = (
        now.groupBy("session_id")
        .agg((F.max("timestamp") - F.min("timestamp")).alias("stay"))
        .filter((F.col("stay") > 0) & (F.col("stay") < MAX_STAY))
        .select(aggs.avg_or_zero("stay").cast("bigint"))
    )
    return main.withColumns({"peak": peak.scalar(), "avg_stay": stay.scalar()})


def window_devices(ua: DataFrame, as_of, minutes: int = 30) -> DataFrame:
    return device_breakdown(_window(ua, as_of, minutes), by="user_cookie", per=())


def realtime_by_host(
    ua: DataFrame, as_of, minutes: int = 30, n: int = 100, approx: bool = False
) -> DataFrame:
    rows = _window(ua, as_of, minutes).groupBy("hostname").agg(
        aggs.uniq("user_cookie", approx=approx).alias("active_users"), F.count("*").alias("hits")
    )
    return top_n(rows, n, [F.desc("active_users"), "hostname"])


def realtime_total(ua: DataFrame, as_of, minutes: int = 30, approx: bool = False) -> DataFrame:
    return _window(ua, as_of, minutes).agg(
        aggs.uniq("user_cookie", approx=approx).alias("active_users")
    )
