"""The activity model on top of the ``events`` and ``pages`` tables.

Every event becomes one heartbeat: a user cycles through ten pages of the whole page
table and arrives from one of a hundred others, so hosts, addresses and pages grow
with the tables.
"""

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseline.functions.text import BOT_KEYWORDS, host_of
from pulseline.functions.timefn import LOCAL_TZ
from pulseline.schema import ACTIVITY_SCHEMA
from pulseline.session import configure

# User agents by user_id % 8.
USER_AGENTS = [
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/120.0 Safari/537.36",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) AppleWebKit/605.1.15 Safari/604.1",
    "Mozilla/5.0 (Linux; Android 14; Pixel 8) AppleWebKit/537.36 Chrome/120.0 Safari/537.36",
    "Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)",
    "python-requests/2.31.0",
    "Mozilla/5.0 (iPad; CPU OS 17_0 like Mac OS X) AppleWebKit/605.1.15 Safari/604.1",
    "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 HeadlessChrome/120.0 Safari/537.36",
    "curl/8.4.0",
]
LOCAL_OFFSET_HOURS = 8


def _utc_start(day: int) -> datetime:
    local = date(day // 10000, day // 100 % 100, day % 100)
    return datetime(local.year, local.month, local.day) - timedelta(hours=LOCAL_OFFSET_HOURS)


# Columns of the two base tables, stated so that no footer is read for them.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "pages": "page_id bigint, url string, html string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def events_between(events: DataFrame, first_day: int | None, last_day: int | None) -> DataFrame:
    """Events of a local-day range, as a bound on ``ts`` that reaches the scan."""
    if first_day:
        start = _utc_start(first_day)
        events = events.filter(F.col("ts") >= F.lit(str(start)).cast("timestamp_ntz"))
    if last_day:
        end = _utc_start(last_day) + timedelta(days=1)
        events = events.filter(F.col("ts") < F.lit(str(end)).cast("timestamp_ntz"))
    return events


def _sql_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_AGENT_IS_BOT = ", ".join(
    f"int(lower('{agent}') RLIKE '{'|'.join(BOT_KEYWORDS)}')" for agent in USER_AGENTS
)

# The mapping by output column. ``user_id % 8`` selects from arrays of constants, which
# the optimizer folds once.
ACTIVITY_COLUMNS = [
    "event_id AS id",
    "concat('s', user_id, '-', timestamp div 14400) AS session_id",
    "coalesce(host, '') AS hostname",
    """CASE WHEN event_type = 'error' AND k % 5 = 0 THEN concat(coalesce(page_url, ''), '/wp-admin')
            WHEN event_type = 'error' AND k % 5 = 1 THEN concat(coalesce(page_url, ''), '?q=UNION%20select')
            ELSE coalesce(page_url, '') END AS url""",
    """CASE WHEN event_type = 'signup' THEN ''
            WHEN k = 13 THEN 'not a url'
            WHEN k = 14 THEN 'http://best-casino.example.net/x'
            ELSE coalesce(from_url, '') END AS referer""",
    f"element_at(array({_sql_list(USER_AGENTS)}), int(user_id % 8 + 1)) AS browser",
    f"element_at(array({_AGENT_IS_BOT}), int(user_id % 8 + 1)) AS is_bot",
    "CASE WHEN user_id % 8 = 7 THEN '' ELSE concat('u', user_id) END AS user_cookie",
    """CASE WHEN user_id % 5 = 1 THEN '203.0.113.9'
            WHEN user_id % 7 = 0 THEN concat('2001:db8:0:', user_id % 4, '::', user_id div 14)
            ELSE concat('10.', user_id div 187500 % 250, '.', user_id div 750 % 250, '.', user_id div 3 % 250)
       END AS ip_user""",
    "timestamp",
    f"""int(date_format(from_utc_timestamp(timestamp_seconds(timestamp), '{LOCAL_TZ}'), 'yyyyMMdd'))
       AS date_num""",
    "coalesce(bare_host, '') AS domain",
    "timestamp AS created_at",
]


def to_activity(events: DataFrame, pages: DataFrame) -> DataFrame:
    """Activity rows from event rows (batch or stream) and the page table."""
    n_pages = pages.select(F.count("*")).scalar()
    user, k = F.col("user_id"), F.get_json_object("props", "$.k").cast("bigint")
    base = events.select(
        "event_id",
        "user_id",
        "event_type",
        k.alias("k"),
        F.unix_timestamp("ts").alias("timestamp"),
        F.pmod(user * 7 + k % 10, n_pages).alias("page"),
        F.pmod(user * 3 + k + 17, n_pages).alias("from_page"),
    )
    host = host_of("url")
    seen = pages.select(
        F.col("page_id").alias("page"),
        F.col("url").alias("page_url"),
        host.alias("host"),
        F.regexp_replace(host, r"^(www|m|blog)\.", "").alias("bare_host"),
    )
    # One row per id, known to the optimizer: it drops this join when no referer is read.
    source = pages.groupBy(F.col("page_id").alias("from_page")).agg(F.min("url").alias("from_url"))
    joined = base.join(seen, "page", "left").join(source, "from_page", "left")
    return joined.selectExpr(*ACTIVITY_COLUMNS)


def activity(
    spark: SparkSession,
    sf_dir: str,
    first_day: int | None = None,
    last_day: int | None = None,
) -> DataFrame:
    configure(spark)
    events = events_between(table(spark, sf_dir, "events"), first_day, last_day)
    return to_activity(events.drop("value"), table(spark, sf_dir, "pages"))


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heartbeat messages as JSON text; some are cut, mistyped, null, incomplete or trailed by text."""
    ua = activity(spark, sf_dir)
    kind = F.col("id") % 50
    # Some senders do not flag crawlers.
    ua = ua.withColumn("is_bot", F.when(kind == 6, 0).otherwise(F.col("is_bot")))
    whole = F.to_json(F.struct(*ACTIVITY_SCHEMA.fieldNames()))
    return ua.select(
        F.when(kind == 0, F.concat(F.lit('{"id": '), F.col("id"), F.lit(', "url": "')))
        .when(kind == 1, F.concat(F.lit('{"id": "x'), F.col("id"), F.lit('"}')))
        .when(kind == 2, F.concat(F.lit('{"id": '), F.col("id"), F.lit(', "url": null, "is_bot": null, "timestamp": null}')))
        .when(kind == 3, F.concat(F.lit('{"id": "'), F.col("id"), F.lit('", "hostname": "h", "is_bot": true}')))
        .when(kind == 4, F.concat(F.lit('{"id": '), F.col("id"), F.lit(', "url": "u"} junk')))
        .when(kind == 5, F.concat(F.lit('{"id": "'), F.col("id"), F.lit('.9"}')))
        .otherwise(whole)
        .alias("value")
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with the address headers a proxy would pass on."""
    ua = activity(spark, sf_dir)
    kind = F.col("id") % 4
    return ua.select(
        "id",
        "browser",
        F.when(kind == 0, F.col("ip_user")).when(kind == 1, "").alias("cf_connecting_ip"),
        F.when(kind <= 1, "192.0.2.1")
        .when(kind == 2, F.concat(F.lit(" "), F.col("ip_user"), F.lit(" , 198.51.100.7")))
        .alias("x_forwarded_for"),
        F.lit("127.0.0.1").alias("remote_addr"),
        F.col("timestamp").alias("received_at"),
    )


def heartbeat_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heartbeats as they reach the server; no browser flags itself as a crawler."""
    ua = activity(spark, sf_dir)
    kind = F.col("id") % 4
    return ua.select(
        "session_id",
        "user_cookie",
        "url",
        "hostname",
        F.when(F.col("referer") != "", F.col("referer")).alias("referer"),
        "browser",
        F.lit(0).alias("is_bot"),
        F.when(kind == 0, F.col("ip_user")).when(kind == 1, "").alias("cf_connecting_ip"),
        F.when(kind == 1, F.concat("ip_user", F.lit(", 198.51.100.7"))).alias("x_forwarded_for"),
        F.when(kind >= 2, F.col("ip_user")).otherwise("127.0.0.1").alias("remote_addr"),
        F.col("timestamp").alias("received_at"),
    )


def legacy_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide events of the older format as JSON text; every tenth has no times."""
    ua = activity(spark, sf_dir)
    timed = F.col("id") % 10 != 0
    message = F.struct(
        "id",
        "ip_user",
        "browser",
        "referer",
        (F.col("id") % 300).alias("stay_duration"),
        "hostname",
        "url",
        "user_cookie",
        F.when(timed, F.col("timestamp")).alias("timestamp"),
        "is_bot",
        "date_num",
        F.col("timestamp").alias("timestamp_int"),
        (F.col("id") % 7).alias("domain_id"),
        "domain",
        F.when(timed, F.col("created_at")).alias("created_at"),
    )
    return ua.select(F.to_json(message).alias("value"))


def write_reports(threats: DataFrame, path: str, parts: int = 4) -> None:
    """Fenced verdict reports, up to ``parts`` per day, each with a header and a template row that means nothing.

    Addresses are dealt by hash, so no task writes and no reader parses a whole day at once. Reasons are quoted and go
    over two lines; forty columns that nobody reads come first.
    """
    cells = ["verdict", "score", "ip", "country", "isp", "threat_type", "reason", "solution"]
    quoted = F.concat(F.lit('"'), F.col("reason"), F.lit(',\nchecked"'))
    unread = 40
    values = {"country": F.lit("US"), "isp": F.lit("Example Net"), "reason": quoted}
    line = F.concat_ws(",", F.lit("," * (unread - 1)), *[values.get(c, F.col(c).cast("string")) for c in cells])
    report = F.pmod(F.xxhash64("ip"), F.lit(parts)).alias("report")
    rows = threats.select("date_num", report, F.lit(2).alias("part"), "ip", line.alias("value"))
    frame = F.array(
        F.struct(F.lit(0).alias("part"), F.lit("```csv").alias("value")),
        F.struct(F.lit(1).alias("part"), F.lit(",".join(f"x{i}" for i in range(unread)) + ", verdict , score," + ",".join(cells[2:])).alias("value")),
        F.struct(F.lit(3).alias("part"), F.lit("," * unread + "Critical,99,<IP>,US,X,<threat_type>,r,s").alias("value")),
        F.struct(F.lit(4).alias("part"), F.lit("```").alias("value")),
    )
    frames = rows.select("date_num", "report").distinct().select("date_num", "report", F.explode(frame).alias("f"))
    frames = frames.select("date_num", "report", "f.part", F.lit("").alias("ip"), "f.value")
    (
        rows.unionByName(frames)
        .repartition("date_num", "report")
        .sortWithinPartitions("date_num", "report", "part", "ip")
        .select("date_num", "report", "value")
        .write.partitionBy("date_num", "report")
        .text(path)
    )


def write_alert_documents(alerts: DataFrame, path: str) -> None:
    """Alert documents as JSON lines with broken lines for every critical one.

    The second kind of broken line is a whole document with text behind it.
    """
    whole = alerts.select("verdict", F.to_json(F.struct(*alerts.columns)).alias("value"))
    critical = whole.filter("verdict = 'Critical'")
    broken = critical.withColumn("value", F.lit('{"ip": '))
    trailing = critical.withColumn("value", F.concat("value", F.lit(" junk")))
    whole.unionByName(broken).unionByName(trailing).select("value").write.text(path)
