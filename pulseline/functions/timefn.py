"""Time expressions. Event time is epoch seconds; days are local calendar days."""

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_TZ = "Asia/Manila"
SLOT_SECONDS = 600


def local_time(ts, tz: str = LOCAL_TZ) -> Column:
    """Epoch seconds to the local wall-clock time."""
    return F.from_utc_timestamp(F.timestamp_seconds(ts), tz)


def local_hour(ts, tz: str = LOCAL_TZ) -> Column:
    return F.hour(local_time(ts, tz))


def date_num(date_or_time) -> Column:
    """A date or timestamp column as the integer yyyymmdd.

    The column is named once: the optimizer copies expressions into pushed filters, and
    year, month and day apart would triple everything below them.
    """
    return F.date_format(date_or_time, "yyyyMMdd").cast("int")


def local_date_num(ts, tz: str = LOCAL_TZ) -> Column:
    return date_num(local_time(ts, tz))


def to_day(num) -> Column:
    """yyyymmdd back to a date."""
    n = F.col(num) if isinstance(num, str) else num
    return F.to_date(n.cast("string"), "yyyyMMdd")


def shift_day(num, days: int) -> Column:
    """The day ``days`` after (or before) a yyyymmdd column."""
    return date_num(F.date_add(to_day(num), days))


def slot_start(ts, seconds: int = SLOT_SECONDS) -> Column:
    """Start of the tumbling slot that holds ``ts``, in epoch seconds."""
    t = F.col(ts) if isinstance(ts, str) else ts
    return (t - F.pmod(t, F.lit(seconds))).cast("bigint")


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)
