"""Row filters. Each takes and returns a DataFrame and adds plain, pushable predicates."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseline.functions.text import blank
from pulseline.functions.timefn import LOCAL_TZ, as_column, local_date_num, local_hour


def on_day(df: DataFrame, day: int) -> DataFrame:
    return df.filter(F.col("date_num") == day)


def on_days(df: DataFrame, days) -> DataFrame:
    return df.filter(F.col("date_num").isin(list(days)))


def between_days(df: DataFrame, first_day: int, last_day: int) -> DataFrame:
    return df.filter(F.col("date_num").between(first_day, last_day))


def for_host(df: DataFrame, hostname=None) -> DataFrame:
    """Rows of one host (a name or a scalar column); all rows when none is given."""
    if isinstance(hostname, str):
        hostname = hostname.strip() or None
    return df if hostname is None else df.filter(F.col("hostname") == as_column(hostname))


def ip_contains(df: DataFrame, text: str | None) -> DataFrame:
    """Rows whose address contains the text literally."""
    part = (text or "").strip()
    return df.filter(F.col("ip_user").contains(F.lit(part))) if part else df


def time_range(df: DataFrame, start, end=None, tz: str = LOCAL_TZ) -> DataFrame:
    """``start <= timestamp < end`` with the matching bound on the partition day."""
    start = as_column(start)
    df = df.filter(
        (F.col("timestamp") >= start) & (F.col("date_num") >= local_date_num(start, tz))
    )
    if end is not None:
        end = as_column(end)
        df = df.filter(
            (F.col("timestamp") < end) & (F.col("date_num") <= local_date_num(end, tz))
        )
    return df


def trailing(df: DataFrame, as_of, seconds: int) -> DataFrame:
    """The last ``seconds`` up to and including ``as_of``."""
    as_of = as_column(as_of)
    return time_range(df, as_of - F.lit(seconds), as_of + F.lit(1))


def until_hour(df: DataFrame, hour: int, tz: str = LOCAL_TZ) -> DataFrame:
    """Events whose local hour is at most ``hour``."""
    return df.filter(local_hour("timestamp", tz) <= hour)


def humans(df: DataFrame) -> DataFrame:
    return df.filter(F.col("is_bot") == 0)


def with_url(df: DataFrame) -> DataFrame:
    return df.filter(~blank("url"))


def without_referer(df: DataFrame) -> DataFrame:
    return df.filter(blank("referer"))


def matching(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Regular-expression predicate, e.g. the sensitive-path or attack pattern."""
    return df.filter(F.col(column).rlike(pattern))


def search(df: DataFrame, text: str | None, columns) -> DataFrame:
    """Case-insensitive literal search over several columns."""
    if not text:
        return df
    needle = F.lit(text.lower())
    hit = F.lit(False)
    for name in columns:
        hit = hit | F.lower(F.coalesce(F.col(name), F.lit(""))).contains(needle)
    return df.filter(hit)
