"""Totals, pages and top-n."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseline.session import work_dir

RANK_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"
SALTS = 64


def with_total(
    df: DataFrame, rows: DataFrame | None = None, name: str = "total_rows", limit: int | None = None
) -> DataFrame:
    """Append the row count of ``rows`` (default: of ``df``) as a scalar subquery.

    With the ``limit`` of a page also ``total_pages``, the number of such pages.

    A window over everything would move every row to one task. Pass a narrower
    ``rows`` when the number of rows is known from fewer columns.
    """
    total = (df if rows is None else rows).select(F.count("*")).scalar()
    df = df.withColumn(name, total)
    return df if limit is None else df.withColumn("total_pages", total_pages(F.col(name), limit))


def page(df: DataFrame, order, limit: int, offset: int = 0) -> DataFrame:
    """Rows ``offset`` .. ``offset + limit`` of the given total order."""
    ordered = df.orderBy(*order)
    if offset:
        ordered = ordered.offset(offset)
    return ordered.limit(limit)


def page_after(df: DataFrame, keys, cursor, limit: int) -> DataFrame:
    """The next page behind a cursor, for descending keys.

    Costs the same for every page: nothing before the cursor is sorted or skipped.
    """
    behind = F.struct(*keys) < F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, cursor)])
    return df.filter(behind).orderBy(*[F.desc(k) for k in keys]).limit(limit)


def total_pages(total: Column, limit: int) -> Column:
    return F.ceil(total / F.lit(limit)).cast("bigint") if limit > 0 else F.lit(0).cast("bigint")


def top_n(df: DataFrame, n: int, order, per=None) -> DataFrame:
    """First ``n`` rows in the order, overall or per group.

    Overall this is a distributed top-k. Per group, every task keeps only its own
    first ``n`` rows of a group before the shuffle, so a large group stays cheap. Spark
    does that up to the session's limit; for a larger ``n`` a group is first cut in salted parts.
    """
    if per is None:
        return df.orderBy(*order).limit(n)
    if n > int(df.sparkSession.conf.get(RANK_LIMIT)):
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS))
        df = _first_rows(df.withColumn("_salt", salt), n, order, [*per, "_salt"]).drop("_salt")
    return _first_rows(df, n, order, per)


def _first_rows(df: DataFrame, n: int, order, per) -> DataFrame:
    window = Window.partitionBy(*per).orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(window))
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


@dataclass(frozen=True)
class Ranked:
    """Rows in key ranges that follow one another in the order, and how many rows each range has."""

    rows: DataFrame
    order: tuple
    range_name: str
    counts: tuple[tuple[int, int], ...]

    @property
    def total(self) -> int:
        return sum(n for _, n in self.counts)


def ranked(df: DataFrame, order, ranges: int | None = None) -> Ranked:
    """Store ``df`` in ``ranges`` key ranges of a total order, from which pages are picked by rank.

    The rows move once. Ranges are split by all keys of the order, so many rows that are alike in the first
    key are spread as well. The driver learns one count per range, whatever the number of rows. By default there are as many ranges as shuffle
    partitions; a page sorts the one or two ranges that hold it.
    """
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = "range"
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"{name}_"
    path = work_dir(spark, "ranked")
    dealt = df.repartitionByRange(ranges, *order).withColumn(name, F.spark_partition_id())
    dealt.write.partitionBy(name).parquet(path)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.IntegerType())])
    rows = spark.read.schema(schema).parquet(path)
    counts = rows.groupBy(name).agg(F.count("*").alias("n")).collect()
    return Ranked(rows, tuple(order), name, tuple(sorted((r[0], r[1]) for r in counts)))


def ranked_page(pages: Ranked, limit: int, offset: int = 0) -> DataFrame:
    """Rows ``offset`` .. ``offset + limit`` by rank; only the ranges that hold them are read and sorted.

    Behind the last row the page is empty.
    """
    wanted, skipped, before = [], 0, 0
    for one, n in pages.counts:
        if before + n <= offset:
            skipped = before + n
        elif before < offset + limit:
            wanted.append(one)
        before += n
    rows = pages.rows.filter(F.col(pages.range_name).isin(wanted)).drop(pages.range_name)
    return page(rows, pages.order, limit, offset - skipped)
