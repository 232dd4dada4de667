"""Alert list: deduplicate verdicts, search, page, dismiss, block list."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseline.functions.net import ipv6_network64, is_ipv4
from pulseline.functions.text import clip
from pulseline.functions.timefn import as_column
from pulseline.operators.filters import search
from pulseline.operators.paging import page, top_n, with_total
from pulseline.schema import VERDICT_COLUMNS

# Alert verdicts by priority, display defaults and clip length.
PRIORITY = {"suspicious": 1, "critical": 2}
MISSING = {
    "country": "UNK",
    "isp": "Unknown",
    "threat_type": "Unknown",
    "reason": "N/A",
    "solution": "Check logs manually",
}
REASON_TEXT = (80, "...")
SEARCH_COLUMNS = ["ip", "country", "isp", "threat_type"]
BLOCK_COMMENT = "Blocked via Security Dashboard"


def alerts_dedupe(verdicts: DataFrame, order=("line_no",), per=()) -> DataFrame:
    """The most severe verdict per address; the first one among equals.

    ``order`` ranks equal verdicts, ``per`` adds grouping columns such as the report.
    """
    level = F.lower("verdict")
    priority = F.lit(0)
    for name, rank in PRIORITY.items():
        priority = F.when(level == name, rank).otherwise(priority)
    rows = verdicts.withColumn("priority", priority).filter("priority > 0")
    best = top_n(rows, 1, [F.desc("priority"), *order], per=[*per, "ip"])
    shown = {
        c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))
        for c, default in MISSING.items()
        if c in verdicts.columns
    }
    return best.withColumns(shown)


def to_alerts(verdicts: DataFrame, timestamp) -> DataFrame:
    """Alert documents from verdict rows; fields a verdict lacks stay null."""
    ts = as_column(timestamp).cast("bigint")
    have = set(verdicts.columns)
    fields = [
        (F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in VERDICT_COLUMNS
    ]
    return verdicts.select(
        *fields,
        F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        ts.alias("timestamp"),
    )


def _shown(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("reason_display", clip("reason", *REASON_TEXT))


def alerts_search(alerts: DataFrame, text: str | None = None) -> DataFrame:
    return _shown(search(alerts, text, SEARCH_COLUMNS))


def alerts_page(alerts: DataFrame, text: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """One page of the matching alerts, newest first, with the number of alerts and pages."""
    found = search(alerts, text, SEARCH_COLUMNS)
    order = [F.desc(F.coalesce("timestamp", F.lit(0))), "ip", "threat_type", "reason"]
    return with_total(_shown(page(found, order, limit, offset)), found, limit=limit)


def alerts_dismiss(alerts: DataFrame, ips) -> DataFrame:
    """Alerts without those of the given addresses (a list, or a table with an ``ip`` column)."""
    if isinstance(ips, DataFrame):
        return alerts.join(ips.select("ip").distinct(), "ip", "left_anti")
    return alerts.filter(F.col("ip").isNull() | ~F.col("ip").isin(list(ips)))


def blocklist(alerts: DataFrame, comment: str = BLOCK_COMMENT) -> DataFrame:
    """Valid addresses to block: IPv4 as they are, IPv6 as their /64 network."""
    addresses = alerts.select("ip").distinct()
    v4 = addresses.filter(is_ipv4("ip")).select(F.lit(4).alias("version"), "ip")
    v6 = (
        addresses.filter(~is_ipv4("ip"))
        .select(F.lit(6).alias("version"), ipv6_network64("ip").alias("ip"))
        .filter("ip IS NOT NULL")
        .distinct()
    )
    return v4.unionByName(v6).withColumn("comment", F.lit(comment))
