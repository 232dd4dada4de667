"""Heartbeat ingest: read, normalise and enrich messages before they are appended."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseline.functions.text import bot_flag
from pulseline.functions.timefn import LOCAL_TZ, as_column, local_date_num
from pulseline.schema import ACTIVITY_SCHEMA, LEGACY_SCHEMA

# Topic name and batch interval of the ingest path.
ACTIVITY_TOPIC = "user-activity"
APPEND_INTERVAL = "2 seconds"

FALSY = ["", "0", "0.0", "false", "null", "[]", "{}"]


def read_activity_stream(
    spark: SparkSession,
    path: str | None = None,
    brokers: str | None = None,
    topic: str = ACTIVITY_TOPIC,
    max_per_trigger: int | None = None,
    **options,
) -> DataFrame:
    """JSON messages as a stream with one ``value`` text column.

    ``brokers`` selects Kafka from the earliest offset (the checkpoint then keeps
    the group's offsets); ``path`` reads JSON lines from files. ``max_per_trigger`` bounds a
    micro-batch, in messages or files.
    """
    reader = spark.readStream.options(**options)
    if brokers:
        reader = (
            reader.format("kafka")
            .option("kafka.bootstrap.servers", brokers)
            .option("subscribe", topic)
            .option("startingOffsets", "earliest")
        )
        if max_per_trigger:
            reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
        return reader.load().select(F.col("value").cast("string").alias("value"))
    if max_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_per_trigger)
    return reader.format("text").load(path).select("value")


def _whole_number(name: str) -> Column:
    """Integer value of a digit string or a JSON number; null when the field is neither.

    Only a number may have a fraction, which is cut off: as text it is no integer.
    """
    value = F.col(f"m.{name}")
    # Booleans would be cast to 0 and 1.
    return F.when(F.schema_of_variant(value) != "BOOLEAN", F.try_variant_get(value, "$", "bigint"))


def _is_number(field: T.StructField) -> bool:
    return not isinstance(field.dataType, T.StringType) and field.name != "is_bot"


def _parse(messages: DataFrame, schema: T.StructType) -> DataFrame:
    """``m``, the message's fields, and ``bad``: null, or why the row is refused.

    Parsed once: texts as text, numbers as what they are in the message, so that one bad field does not
    hide the others. A message is one JSON object: in brackets, anything behind it is malformed.
    """
    numeric = [f for f in schema if _is_number(f)]
    kinds = [T.StructField(f.name, T.VariantType() if f in numeric else T.StringType()) for f in schema]
    one = F.concat(F.lit("["), "value", F.lit("]"))
    # The generator keeps the optimizer from copying the parse into every field and filter below.
    whole = F.from_json(one, T.ArrayType(T.StructType(kinds)))
    parsed = messages.select("value", F.explode(F.array(whole)).alias("a"))
    broken = F.coalesce(F.size("a") != 1, F.lit(True)) | F.get("a", F.lit(0)).isNull()
    parsed = parsed.select("value", F.get("a", F.lit(0)).alias("m"), broken.alias("broken"))
    bad_number = F.lit(False)
    for field in numeric:
        value = F.col(f"m.{field.name}")
        given = value.isNotNull() & ~F.is_variant_null(value)
        bad_number = bad_number | (given & _whole_number(field.name).isNull())
    reason = F.when(F.col("broken"), "malformed json").when(bad_number, "bad number")
    return parsed.withColumn("bad", reason)


def _field(field: T.StructField, now: Column | None = None) -> Column:
    raw = F.col(f"m.{field.name}")
    if field.name == "is_bot":
        truthy = ~F.lower(F.trim(F.coalesce(raw, F.lit("")))).isin(FALSY)
        return truthy.cast("int").alias(field.name)
    if isinstance(field.dataType, T.StringType):
        return F.coalesce(raw, F.lit("")).alias(field.name)
    if isinstance(field.dataType, T.TimestampType):
        return F.timestamp_seconds(F.coalesce(_whole_number(field.name), now)).alias(field.name)
    number = F.coalesce(_whole_number(field.name), F.lit(0))
    return number.cast(field.dataType).alias(field.name)


def _refused(parsed: DataFrame) -> DataFrame:
    return parsed.filter("bad IS NOT NULL").select("value", F.col("bad").alias("reason"))


def normalize_events(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed activity rows, and the refused messages with the reason.

    Missing and null fields become '' or 0.
    """
    parsed = _parse(messages, ACTIVITY_SCHEMA)
    good = parsed.filter("bad IS NULL").select(*[_field(f) for f in ACTIVITY_SCHEMA])
    return good, _refused(parsed)


def normalize_legacy(messages: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """Wide 17-column events; a missing event or creation time becomes ``as_of``."""
    parsed = _parse(messages, LEGACY_SCHEMA)
    now = as_column(as_of)
    good = parsed.filter("bad IS NULL").select(*[_field(f, now) for f in LEGACY_SCHEMA])
    return good, _refused(parsed)


def enrich_time(df: DataFrame, received="received_at", tz: str = LOCAL_TZ) -> DataFrame:
    """Server-side time fields from the receive time in epoch seconds."""
    ts = F.col(received).cast("bigint")
    return df.withColumns(
        {
            "id": ts * 1000,
            "timestamp": ts,
            "date_num": local_date_num(ts, tz),
            "created_at": ts,
        }
    )


def resolve_ip(
    df: DataFrame,
    cdn="cf_connecting_ip",
    forwarded="x_forwarded_for",
    remote="remote_addr",
) -> DataFrame:
    """Client address: CDN header, else first forwarded address, else the socket."""
    first_hop = F.trim(F.split_part(F.coalesce(F.col(forwarded), F.lit("")), F.lit(","), F.lit(1)))
    empty = F.lit("")
    return df.withColumn(
        "ip_user",
        F.coalesce(
            F.nullif(F.col(cdn), empty), F.nullif(first_hop, empty), F.col(remote), empty
        ),
    )


def mark_bots(df: DataFrame, user_agent="browser") -> DataFrame:
    """Crawler flag: by user agent, or as supplied by the browser."""
    supplied = F.coalesce(F.col("is_bot"), F.lit(0)) if "is_bot" in df.columns else F.lit(0)
    return df.withColumn("is_bot", F.greatest(bot_flag(user_agent), supplied))
