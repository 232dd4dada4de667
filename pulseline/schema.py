"""Table and message schemas of the activity model."""

from pyspark.sql import types as T

# Field names and types of the heartbeat and table formats.
HEARTBEAT_SCHEMA = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("user_cookie", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("hostname", T.StringType()),
        T.StructField("referer", T.StringType()),
        T.StructField("browser", T.StringType()),
        T.StructField("is_bot", T.IntegerType()),
    ]
)

ACTIVITY_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("hostname", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("referer", T.StringType()),
        T.StructField("browser", T.StringType()),
        T.StructField("is_bot", T.IntegerType()),
        T.StructField("user_cookie", T.StringType()),
        T.StructField("ip_user", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("date_num", T.IntegerType()),
        T.StructField("domain", T.StringType()),
        T.StructField("created_at", T.LongType()),
    ]
)

LEGACY_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("ip_user", T.StringType()),
        T.StructField("browser", T.StringType()),
        T.StructField("referer", T.StringType()),
        T.StructField("stay_duration", T.LongType()),
        T.StructField("hostname", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("user_cookie", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("is_bot", T.IntegerType()),
        T.StructField("date_num", T.IntegerType()),
        T.StructField("timestamp_int", T.LongType()),
        T.StructField("domain_id", T.LongType()),
        T.StructField("label_id", T.LongType()),
        T.StructField("is_updated_label", T.IntegerType()),
        T.StructField("domain", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

VERDICT_COLUMNS = [
    "verdict",
    "score",
    "ip",
    "country",
    "isp",
    "threat_type",
    "reason",
    "solution",
]

ALERT_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in VERDICT_COLUMNS]
    + [
        T.StructField("created_at", T.StringType()),
        T.StructField("timestamp", T.LongType()),
    ]
)
