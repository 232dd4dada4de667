"""Comparison of a day with the day before and the same day of the week before."""

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseline.functions.aggs import round_at
from pulseline.functions.timefn import shift_day

# Day offsets of a report and the audience threshold.
OFFSETS = [0, -1, -7]
EXCELLENT_USERS = 500000


def day_plus(day: int, days: int) -> int:
    d = date(day // 10000, day // 100 % 100, day % 100) + timedelta(days=days)
    return d.year * 10000 + d.month * 100 + d.day


def days_needed(days) -> list[int]:
    """All days a report on ``days`` reads."""
    return sorted({day_plus(d, o) for d in days for o in OFFSETS})


def _wide(totals: DataFrame, metrics, by, days) -> DataFrame:
    """One row per report day: each metric at each offset, missing days as zero.

    Every total is sent to the report days it serves and summed there, so the
    comparison needs one aggregation and no self joins.
    """
    spread = totals.withColumn("day_offset", F.explode(F.array(*[F.lit(o) for o in OFFSETS])))
    spread = spread.withColumn("report_day", shift_day("date_num", -F.col("day_offset")))
    cells = [
        F.coalesce(F.sum(F.when(F.col("day_offset") == o, F.col(m))), F.lit(0)).alias(f"{m}_{-o}")
        for m in metrics
        for o in OFFSETS
    ]
    if days is None:
        here = F.max(F.col("day_offset") == 0).alias("_here")
        wide = spread.groupBy("report_day", *by).agg(here, *cells)
        return wide.filter("_here").drop("_here")
    spine = totals.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(d) for d in days])).alias("report_day")
    )
    spread = spread.filter(F.col("report_day").isin(list(days)))
    return spine.join(spread, "report_day", "left").groupBy("report_day", *by).agg(*cells)


def compare_days(totals: DataFrame, metrics, by=(), days=None) -> DataFrame:
    """Long form: one row per report day, offset and ``by``, zero-filled.

    ``days`` lists the report days; by default every day that has totals is one.
    """
    rows = F.array(
        *[
            F.struct(
                F.lit(o).alias("day_offset"),
                *[F.col(f"{m}_{-o}").alias(m) for m in metrics],
            )
            for o in OFFSETS
        ]
    )
    return (
        _wide(totals, metrics, by, days)
        .select("report_day", *by, F.explode(rows).alias("r"))
        .select("report_day", *by, "r.*")
        .withColumn("date_num", shift_day("report_day", F.col("day_offset")))
    )


def percent_change(now: Column, before: Column) -> Column:
    """Change in percent with one decimal; null when there was nothing before."""
    return F.when(before != 0, round_at(100 * (now - before) / before, 1))


def period_change(rollup: DataFrame, metrics=("users", "views", "bot_sessions"), by=("hostname",)) -> DataFrame:
    """Change of each metric against the previous day and week, per day and ``by``.

    With nothing to compare to, ``report_*`` says 'N/A' or '+100%' and ``daily_*`` '0%' or
    '+100%': the two report styles differ on an empty pair. Likewise an unchanged value
    points down in the report style and up in the daily style.
    """
    cells = [
        F.struct(
            F.lit(m).alias("metric"),
            *[F.col(f"{m}_{-o}").alias(n) for o, n in zip(OFFSETS, ("value", "prev_day", "prev_week"))],
        )
        for m in metrics
    ]
    long = (
        _wide(rollup, metrics, by, None)
        .select(F.col("report_day").alias("date_num"), *by, F.explode(F.array(*cells)).alias("c"))
        .select("date_num", *by, "c.*")
    )
    out = {}
    for span in ("day", "week"):
        now, before = F.col("value"), F.col(f"prev_{span}")
        grew = F.when(now > 0, "+100%")
        empty = before == 0
        out[f"pct_{span}"] = percent_change(now, before)
        out[f"report_{span}"] = F.when(empty, grew.otherwise("N/A")).when(now > before, "up").otherwise("down")
        out[f"daily_{span}"] = F.when(empty, grew.otherwise("0%")).when(now >= before, "up").otherwise("down")
    return long.withColumns(out)


def traffic_label(rollup: DataFrame, threshold: int = EXCELLENT_USERS) -> DataFrame:
    """Audience label of every rollup row."""
    return rollup.withColumn(
        "label", F.when(F.col("users") > threshold, "Excellent").otherwise("Low")
    )
