"""Visitor journeys: ordered paths and behaviour rules."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseline.functions import aggs
from pulseline.functions.text import any_word, clip
from pulseline.operators.paging import top_n

# Path format and the behaviour rules.
PATH_SEPARATOR = " -> "
PATH_LENGTH = 500
AGENT_LENGTH = 50
JOURNEY_ROWS = 100
MIN_STEPS = 2
FAST_STEPS = 3
FAST_SECONDS = 2
LOOP_REPEATS = 3
HUNTING_WORDS = ["login", "admin"]

# The separator alone fills PATH_LENGTH after this many steps, so later steps cannot
# appear in the clipped path.
PATH_STEPS = PATH_LENGTH // len(PATH_SEPARATOR) + 3
BUCKET_SECONDS = 60

VISITOR = ["date_num", "user_cookie"]


def journey_stats(ua: DataFrame) -> DataFrame:
    """Steps, duration and first attributes per day and cookie."""
    return (
        aggs.fold(ua, *VISITOR, "ip_user", "browser", "url")
        .groupBy(*VISITOR)
        .agg(
            F.sum("hits").alias("steps"),
            aggs.span().alias("duration"),
            aggs.first_of("ip_user", "browser", "url").alias("first"),
        )
        .select(
            *VISITOR,
            F.col("first.ip_user").alias("ip"),
            F.substring("first.browser", 1, AGENT_LENGTH).alias("ua_short"),
            "steps",
            "duration",
            F.col("first.url").alias("first_url"),
        )
    )


def journeys(ua: DataFrame, n: int = JOURNEY_ROWS, days=None) -> DataFrame:
    """The fastest journeys of two or more steps, per day, with their clipped path.

    The ``n`` journeys of a day are chosen first. Their own events are joined by their real size (a
    run-time broadcast when they are few), then cut to the steps that can show in a path.
    """
    if days is not None:
        ua = ua.filter(F.col("date_num").isin(list(days)))
    chosen = top_n(
        journey_stats(ua).filter(F.col("steps") >= MIN_STEPS).drop("first_url"),
        n,
        ["duration", "user_cookie"],
        per=["date_num"],
    )
    order = ["timestamp", "id", "url"]
    events = ua.select(*VISITOR, *order)
    steps = top_n(events.join(chosen, VISITOR), PATH_STEPS, order, per=VISITOR)

    in_order = F.array_sort(F.collect_list(F.struct(*order)))
    path = F.array_join(F.transform(in_order, lambda s: s["url"]), PATH_SEPARATOR)
    return steps.groupBy(*VISITOR, "ip", "ua_short", "steps", "duration").agg(
        clip(path, PATH_LENGTH, "...").alias("path")
    )


def page_moves(ua: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """How often each (day, cookie) moved from one URL to another.

    Repeated heartbeats on a page are no move. The order is followed inside short time
    buckets, and across them through the first and last URL of each bucket, so even a
    cookie with most of the traffic is never sorted in one task. Both parts start from
    the same shuffle by bucket.
    """
    order = ["timestamp", "id", "url"]
    bucket = (F.col("timestamp") - F.pmod("timestamp", F.lit(bucket_seconds))).alias("bucket")
    events = ua.select(*VISITOR, bucket, *order)

    inside = Window.partitionBy(*VISITOR, "bucket").orderBy(*order)
    walked = events.withColumns(
        {"from_url": F.lag("url").over(inside), "next_url": F.lead("url").over(inside)}
    )
    within = walked.select(*VISITOR, "from_url", F.col("url").alias("to_url"))
    starts, stops = F.col("from_url").isNull(), F.col("next_url").isNull()
    ends = (
        walked.filter(starts | stops)
        .groupBy(*VISITOR, "bucket")
        .agg(
            F.max(F.when(starts, F.col("url"))).alias("first_url"),
            F.max(F.when(stops, F.col("url"))).alias("last_url"),
        )
    )
    across = Window.partitionBy(*VISITOR).orderBy("bucket")
    between = ends.withColumn("from_url", F.lag("last_url").over(across)).select(
        *VISITOR, "from_url", F.col("first_url").alias("to_url")
    )
    return (
        within.unionByName(between)
        .filter("from_url IS NOT NULL AND from_url <> to_url")
        .groupBy(*VISITOR, "from_url", "to_url")
        .agg(F.count("*").alias("moves"))
    )


def journey_threats(ua: DataFrame) -> DataFrame:
    """Journeys no person makes: machine speed, loops, or starting at a login page."""
    loops = page_moves(ua).groupBy(*VISITOR).agg(F.max("moves").alias("max_moves"))
    rows = journey_stats(ua).join(loops, VISITOR, "left")
    flags = {
        "machine_speed": (F.col("steps") > FAST_STEPS) & (F.col("duration") < FAST_SECONDS),
        "looping": F.coalesce(F.col("max_moves") >= LOOP_REPEATS, F.lit(False)),
        "direct_hunting": any_word("first_url", HUNTING_WORDS),
    }
    rows = rows.withColumns({name: cond.cast("int") for name, cond in flags.items()})
    hits = F.col("machine_speed") + F.col("looping") + F.col("direct_hunting")
    return (
        rows.filter(hits > 0)
        .withColumn("verdict", F.when(hits > 1, "Critical").otherwise("Suspicious"))
        .select(*VISITOR, "ip", "steps", "duration", *flags, "verdict")
    )
