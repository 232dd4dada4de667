"""First-seen days as an upsert: a bucketed table to which a batch appends only what the table does not know.

The table is bucketed by (cookie, host), so a batch, dealt into the same buckets, meets it without moving it, and readers take the
minimum per pair without a shuffle. A row is appended for a pair that is new or was seen on an earlier
day than known; a replayed batch finds its own rows and appends nothing. Files grow with the batches: ``compact``
writes a table of one row per pair. One writer at a time is assumed.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulseline.operators import rollups
from pulseline.streaming.jobs import _each_batch

PAIR = ["user_cookie", "hostname"]
COLUMNS = "user_cookie string, hostname string, first_date_num int"
BUCKETS = 256


def open_table(spark: SparkSession, name: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """The table ``name`` over the files in ``path``, made known to this session's catalog if it is not.

    The number of buckets is part of the files and must be the one they were written with.
    """
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({COLUMNS}) USING parquet "
        f"CLUSTERED BY ({', '.join(PAIR)}) SORTED BY ({', '.join(PAIR)}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    spark.catalog.refreshTable(name)
    return spark.table(name)


def unseen(batch: DataFrame, table: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The pairs of a batch of activity that the table does not know, or not that early.

    The batch is the hashed side, bounded by its own pairs; the table streams past it bucket by bucket.
    """
    pairs = rollups.first_seen(batch).withColumns({c: F.coalesce(c, F.lit("")) for c in PAIR})
    pairs = pairs.filter("first_date_num IS NOT NULL").repartition(buckets, *PAIR)
    known = table.withColumnRenamed("first_date_num", "known")
    met = pairs.hint("shuffle_hash").join(known, PAIR, "left")
    first = met.groupBy(*PAIR).agg(
        F.min("first_date_num").alias("first_date_num"), F.min("known").alias("known")
    )
    return first.filter("known IS NULL OR first_date_num < known").drop("known")


def append_unseen(batch: DataFrame, name: str, path: str, buckets: int = BUCKETS) -> None:
    """Append the pairs of a batch that the table does not know yet."""
    rows = unseen(batch, open_table(batch.sparkSession, name, path, buckets), buckets)
    _write(rows, name, path, buckets, "append")


def _write(rows: DataFrame, name: str, path: str, buckets: int, mode: str) -> None:
    writer = rows.write.format("parquet").mode(mode).option("path", path)
    writer.bucketBy(buckets, *PAIR).sortBy(*PAIR).saveAsTable(name)


def keep_seen(
    stream: DataFrame,
    name: str,
    path: str,
    checkpoint: str,
    interval: str | None = "120 seconds",
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Append the pairs that every micro-batch sees for the first time."""
    return _each_batch(
        stream, checkpoint, interval, lambda df, batch_id: append_unseen(df, name, path, buckets)
    )


def read_seen(spark: SparkSession, name: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """First local day per (cookie, host)."""
    return rollups.merge_first_seen(open_table(spark, name, path, buckets))


def compact(
    spark: SparkSession, name: str, path: str, new_name: str, new_path: str, buckets: int = BUCKETS
) -> None:
    """Write the table anew with one row per pair; the old one stays until the caller switches over."""
    _write(read_seen(spark, name, path, buckets), new_name, new_path, buckets, "error")
