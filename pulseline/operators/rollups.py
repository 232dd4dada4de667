"""Maintained tables: page loads, daily rollup, online slots, first-seen dates.

Each table comes as exact keys that merge by union and re-aggregation, or as sketch states
that merge with ``hll_union_agg``. Both can be rebuilt, appended or replayed.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseline.functions import aggs
from pulseline.functions.timefn import slot_start, to_day
from pulseline.operators.filters import humans, trailing

# Look-back horizons in seconds and the stay credited per heartbeat.
SLOT_LOOKBACK = 2400
ROLLUP_HORIZON = 172800
HEARTBEAT_STAY = 10

PAGE_LOAD_KEYS = ["date_num", "hostname", "session_id", "url", "user_cookie", "is_bot"]


def page_loads(ua: DataFrame) -> DataFrame:
    """One row per day, host, session, URL, cookie and bot flag.

    A page sends a heartbeat every few seconds; with map-side partial sums they collapse to
    a fraction of the rows. This is the exact mergeable state of the daily rollup.
    """
    return ua.groupBy(*PAGE_LOAD_KEYS).agg(F.count("*").alias("hits"))


def merge_page_loads(loads: DataFrame) -> DataFrame:
    """Union of several page-load states back to one row per key."""
    return loads.groupBy(*PAGE_LOAD_KEYS).agg(F.sum("hits").alias("hits"))


MEASURES = ["users", "views", "sessions", "bot_sessions", "bot_hits", "stay_seconds"]


def _sums() -> list:
    return [F.sum(c).alias(c) for c in ("hits", "bot_hits", "stay_seconds")]


def _approx_rollup(loads: DataFrame, by) -> DataFrame:
    bot = F.col("is_bot") == 1
    return loads.groupBy(*by).agg(
        aggs.uniq("visitor", approx=True).alias("users"),
        aggs.uniq("session_id", "url", approx=True).alias("views"),
        aggs.uniq("session_id", approx=True).alias("sessions"),
        aggs.uniq_if(bot, "session_id", approx=True).alias("bot_sessions"),
        *_sums(),
    )


def _exact_rollup(loads: DataFrame, by) -> DataFrame:
    """Distincts counted level by level: (session, URL) pairs, then sessions, then totals.

    Pairs nest in sessions, so one pass over two grouping sets, pairs and visitors, replaces
    one copy of every row per distinct count. All buffers have fixed width and a busy host
    is spread over its pairs and visitors.
    """
    pair = ["session_id", "url"]
    finest = loads.groupingSets([[*by, *pair], [*by, "visitor"]], *by, *pair, "visitor").agg(
        F.grouping("session_id").alias("is_visitor"), F.max("is_bot").alias("is_bot"), *_sums()
    )
    visitor = F.col("is_visitor") == 1
    key = F.when(visitor, F.col("visitor")).otherwise(F.col("session_id"))
    keys = (
        finest.filter(~visitor | F.col("visitor").isNotNull())
        .groupBy(*by, "is_visitor", key.alias("key"))
        .agg(F.count("*").alias("pairs"), F.max("is_bot").alias("is_bot"), *_sums())
    )

    def over_sessions(name: str):
        return F.sum(F.when(~visitor, F.col(name)).otherwise(0))

    return keys.groupBy(*by).agg(
        F.count_if(visitor).alias("users"),
        over_sessions("pairs").alias("views"),
        F.count_if(~visitor).alias("sessions"),
        F.count_if(~visitor & (F.col("is_bot") == 1)).alias("bot_sessions"),
        *[over_sessions(c).alias(c) for c in ("hits", "bot_hits", "stay_seconds")],
    )


def rollup_from_loads(
    loads: DataFrame,
    by=("date_num", "hostname"),
    names=None,
    approx: bool = False,
    with_bots: bool = False,
) -> DataFrame:
    """The rollup measures over rows with ``hits``: page loads, merged or not.

    ``users`` leaves bots out unless ``with_bots``.
    """
    names = list(names or MEASURES)
    human = F.col("is_bot") == 0
    visitor = F.col("user_cookie") if with_bots else F.when(human, F.col("user_cookie"))
    if names == ["users"] and not approx:
        return loads.groupBy(*by).agg(aggs.uniq(visitor).alias("users"))
    rows = loads.withColumns(
        {
            "visitor": visitor,
            "bot_hits": F.when(human, 0).otherwise(F.col("hits")),
            "stay_seconds": F.when(human, F.col("hits") * HEARTBEAT_STAY).otherwise(0),
        }
    )
    rollup = _approx_rollup if approx else _exact_rollup
    return rollup(rows, list(by)).select(*by, *names)


def daily_rollup(
    ua: DataFrame,
    by=("date_num", "hostname"),
    names=None,
    approx: bool = False,
    with_bots: bool = False,
) -> DataFrame:
    """Users, views, sessions, bot sessions, bot hits and stay per day and host.

    ``names`` selects measures; ``hits`` counts all heartbeats.
    """
    return rollup_from_loads(ua.withColumn("hits", F.lit(1)), by, names, approx, with_bots)


def touched_dates(ua: DataFrame, as_of, horizon: int = ROLLUP_HORIZON) -> DataFrame:
    """Days with events in the last ``horizon`` seconds."""
    return trailing(ua, as_of, horizon).select("date_num").distinct()


def refresh_rollup(ua: DataFrame, as_of, horizon: int = ROLLUP_HORIZON) -> DataFrame:
    """The rollup of every touched day, over all events of the day.

    The touched days are broadcast, since a shuffle of the events by day would put a whole day into one
    task: there are at most horizon / 86,400 + 2 of them, and a horizon beyond a century is refused.
    """
    if not 0 <= horizon <= 36600 * 86400:
        raise ValueError("the horizon is at most a century")
    days = touched_dates(ua, as_of, horizon)
    return daily_rollup(ua.join(F.broadcast(days), "date_num", "left_semi"))


def rollup_states(ua: DataFrame) -> DataFrame:
    """Sketch states of the daily rollup; rows with equal keys merge at read."""
    human = F.col("is_bot") == 0
    return ua.groupBy("date_num", "hostname").agg(
        aggs.sketch("user_cookie", human).alias("users_state"),
        aggs.sketch(F.concat_ws("\n", "session_id", "url")).alias("views_state"),
        aggs.sketch("session_id").alias("sessions_state"),
        aggs.sketch("session_id", ~human).alias("bot_sessions_state"),
        F.sum("is_bot").cast("bigint").alias("bot_hits"),
        F.sum(F.when(human, HEARTBEAT_STAY).otherwise(0)).cast("bigint").alias("stay_seconds"),
    )


def merge_states(states: DataFrame, by=("date_num", "hostname")) -> DataFrame:
    """Read a state table: distincts from merged sketches, sums added up."""
    kinds = [c.removesuffix("_state") for c in states.columns if c.endswith("_state")]
    sums = [c for c in ("bot_hits", "stay_seconds") if c in states.columns]
    return states.groupBy(*by).agg(
        *[aggs.sketch_count(f"{k}_state").alias(k) for k in kinds],
        *[F.sum(c).alias(c) for c in sums],
    )


def compact_states(states: DataFrame, by=("date_num", "hostname")) -> DataFrame:
    """Fold state rows with equal keys into one state row."""
    kinds = [c for c in states.columns if c.endswith("_state")]
    sums = [c for c in ("bot_hits", "stay_seconds") if c in states.columns]
    return states.groupBy(*by).agg(
        *[F.hll_union_agg(c).alias(c) for c in kinds], *[F.sum(c).alias(c) for c in sums]
    )


def cookie_numbers(ua: DataFrame) -> DataFrame:
    """A number for every human cookie, the dictionary of the bitmap states.

    Numbers are unique and dense within each task, as bitmaps want them; store the result, for another run numbers anew.
    """
    cookies = humans(ua).select("user_cookie").distinct()
    return cookies.withColumn("number", F.monotonically_increasing_id())


def bitmap_states(ua: DataFrame, numbers: DataFrame, by=("date_num",)) -> DataFrame:
    """Exact mergeable users: one bitmap of 32,768 cookies for each group and range of numbers."""
    pairs = humans(ua).select(*by, "user_cookie").distinct().join(numbers, "user_cookie")
    place = F.bitmap_bit_position("number")
    return pairs.groupBy(*by, F.bitmap_bucket_number("number").alias("bucket")).agg(
        F.bitmap_construct_agg(place).alias("users_map")
    )


def bitmap_users(states: DataFrame, by=()) -> DataFrame:
    """Exact distinct users of any groups of the states, from the bitmaps alone."""
    merged = states.groupBy(*by, "bucket").agg(F.bitmap_or_agg("users_map").alias("users_map"))
    return merged.groupBy(*by).agg(F.sum(F.bitmap_count("users_map")).alias("users"))


def user_sets(ua: DataFrame, by=("date_num",)) -> DataFrame:
    """Theta sketches of the human cookies, which can be subtracted and intersected as well as merged."""
    return humans(ua).groupBy(*by).agg(F.theta_sketch_agg("user_cookie").alias("users_set"))


def new_against_before(sets: DataFrame, days: int = 7) -> DataFrame:
    """Per day its users, and those that the ``days`` days before did not have, estimated from day sketches alone.

    Each day's sketch goes to the days behind it that it counts against, a fixed number, so there is no
    join of days. A day without events has no row.
    """
    day = F.datediff(F.to_date(F.col("date_num").cast("string"), "yyyyMMdd"), F.lit("1970-01-01"))
    sent = sets.withColumn("day", day).withColumn("ahead", F.explode(F.sequence(F.lit(0), F.lit(days))))
    merged = sent.groupBy((F.col("day") + F.col("ahead")).alias("day")).agg(
        F.max(F.when(F.col("ahead") == 0, F.col("date_num"))).alias("date_num"),
        F.theta_union_agg(F.when(F.col("ahead") == 0, F.col("users_set"))).alias("own"),
        F.theta_union_agg(F.when(F.col("ahead") > 0, F.col("users_set"))).alias("before"),
    )
    return merged.filter("date_num IS NOT NULL").select(
        "date_num",
        F.theta_sketch_estimate("own").alias("users"),
        F.theta_sketch_estimate(F.theta_difference("own", "before")).alias("new_users"),
    )


def slot_keys(ua: DataFrame, as_of=None, lookback: int | None = None) -> DataFrame:
    """Distinct human (slot, host, cookie): the exact state of the online slots.

    With ``as_of``, only the last ``lookback`` seconds, as a periodic refresh does.
    """
    rows = humans(ua)
    if as_of is not None:
        rows = trailing(rows, as_of, lookback or SLOT_LOOKBACK)
    return rows.select(
        slot_start("timestamp").alias("slot_start"), "hostname", "user_cookie"
    ).distinct()


def online_slots(ua: DataFrame, as_of=None, lookback: int | None = None) -> DataFrame:
    """Distinct users per ten-minute slot and host."""
    return (
        slot_keys(ua, as_of, lookback)
        .groupBy("slot_start", "hostname")
        .agg(F.count("*").alias("active_users"))
    )


def slot_states(ua: DataFrame) -> DataFrame:
    """Sketch states of the online slots."""
    return (
        humans(ua)
        .groupBy(slot_start("timestamp").alias("slot_start"), "hostname")
        .agg(aggs.sketch("user_cookie").alias("active_users_state"))
    )


def first_seen(ua: DataFrame) -> DataFrame:
    """First local day of every (cookie, host)."""
    return ua.groupBy("user_cookie", "hostname").agg(F.min("date_num").alias("first_date_num"))


def merge_first_seen(*parts: DataFrame) -> DataFrame:
    """Minimum over several first-seen tables, e.g. the table and a new batch."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("user_cookie", "hostname").agg(
        F.min("first_date_num").alias("first_date_num")
    )


def first_seen_dates(first: DataFrame) -> DataFrame:
    return first.withColumn("first_date", to_day("first_date_num"))
