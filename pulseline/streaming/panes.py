"""Trailing windows from one-minute panes.

A micro-batch leaves a row per minute and cookie; no event is copied. At read a minute's hits go to the windows that hold
it, and a cookie goes to each window once: from a minute it reaches back only as far as the minute it was seen in before.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulseline.functions.timefn import slot_start
from pulseline.operators.filters import humans
from pulseline.streaming.jobs import BATCH, keep_table

MINUTE = 60


def panes(ua: DataFrame) -> DataFrame:
    """Human hits per minute and cookie."""
    return (
        humans(ua)
        .groupBy(slot_start("timestamp", MINUTE).alias("minute"), F.coalesce("user_cookie", F.lit("")).alias("user_cookie"))
        .agg(F.count("*").alias("hits"))
    )


def keep_panes(
    stream: DataFrame, path: str, checkpoint: str, interval: str | None = "30 seconds", files: int | None = None
) -> StreamingQuery:
    """The panes of every micro-batch, one folder each, which a replay replaces as a whole."""
    return keep_table(stream, path, checkpoint, panes, interval, files)


def read_panes(spark: SparkSession, path: str) -> DataFrame:
    """Panes of all batches, merged."""
    schema = f"minute bigint, user_cookie string, hits bigint, {BATCH} bigint"
    rows = spark.read.schema(schema).parquet(path)
    return rows.groupBy("minute", "user_cookie").agg(F.sum("hits").alias("hits"))


def _windows(first, last):
    return F.explode(F.sequence(first, last, F.lit(MINUTE).cast("bigint"))).alias("slot_start")


def sliding_hits(panes: DataFrame, minutes: int = 30) -> DataFrame:
    """Hits per window of so many minutes, sliding by one; a window without hits has no row."""
    reach = F.lit((minutes - 1) * MINUTE)
    per_minute = panes.groupBy("minute").agg(F.sum("hits").alias("hits"))
    sent = per_minute.select(_windows(F.col("minute") - reach, F.col("minute")), "hits")
    return sent.groupBy("slot_start").agg(F.sum("hits").alias("hits"))


def sliding_users(panes: DataFrame, minutes: int = 30) -> DataFrame:
    """Exact users per window of so many minutes, sliding by one, from merged panes.

    A cookie seen in minute m, and last before that in minute p, is new to the windows that start after p, so no window
    counts it twice and there is no distinct over windows. Even the busiest cookie has one row per minute.
    """
    before = F.lag("minute").over(Window.partitionBy("user_cookie").orderBy("minute"))
    start = F.col("minute") - F.lit((minutes - 1) * MINUTE)
    start = F.greatest(start, F.coalesce("before", start - MINUTE) + MINUTE)
    rows = panes.select("minute", "user_cookie").withColumn("before", before)
    sent = rows.groupBy(start.alias("from"), F.col("minute").alias("to")).agg(F.count("*").alias("users"))
    sent = sent.select(_windows(F.col("from"), F.col("to")), "users")
    return sent.groupBy("slot_start").agg(F.sum("users").alias("users"))
