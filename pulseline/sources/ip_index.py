"""Address search by text: an inverted index of trigrams over the distinct addresses of every day.

Three tables below one path: ``addresses`` (day, address, hits), ``grams`` (the same rows under each three characters of the
address) and ``counts`` (rows per gram). A text is looked up under the rarest of its grams and tested literally, so the rows
are those of a full scan. Postings are range-split by gram, day and address: a gram that every address has is
spread over many files, and a scan skips the row groups of other grams. Shorter texts scan the distinct addresses.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM = 3
ROWS = "date_num int, ip_user string, hits bigint"
POSTINGS = f"gram string, {ROWS}"


def _grams(text: Column) -> Column:
    """The distinct runs of three characters of a text."""
    last = F.length(text) - (GRAM - 1)
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(GRAM))))


def write_index(ua: DataFrame, path: str) -> None:
    """Index the addresses of an activity table; run it for closed days into a new path."""
    spark = ua.sparkSession
    rows = ua.groupBy("date_num", F.coalesce("ip_user", F.lit("")).alias("ip_user")).agg(
        F.count("*").alias("hits")
    )
    keys = ["date_num", "ip_user"]
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(f"{path}/addresses")
    rows = spark.read.schema(ROWS).parquet(f"{path}/addresses")
    postings = rows.select(F.explode(_grams(F.col("ip_user"))).alias("gram"), "*")
    keys = ["gram", *keys]
    postings.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(f"{path}/grams")
    kept = spark.read.schema(POSTINGS).parquet(f"{path}/grams")
    counts = kept.groupBy("gram").agg(F.count("*").alias("n"))
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/counts")


def candidates(spark: SparkSession, path: str, text: str) -> DataFrame:
    """The rows among which those with the text are: postings of its rarest gram, or all distinct addresses.

    The driver reads one count per gram of the text.
    """
    if len(text) < GRAM:
        return spark.read.schema(ROWS).parquet(f"{path}/addresses")
    grams = {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}
    counts = spark.read.schema("gram string, n bigint").parquet(f"{path}/counts")
    found = dict(map(tuple, counts.filter(F.col("gram").isin(sorted(grams))).collect()))
    rarest = min(sorted(grams), key=lambda g: found.get(g, 0))
    return spark.read.schema(POSTINGS).parquet(f"{path}/grams").filter(F.col("gram") == rarest).drop("gram")


def search(
    spark: SparkSession, path: str, text: str | None, first_day: int | None = None, last_day: int | None = None
) -> DataFrame:
    """Day, address and hits of the addresses that contain the text literally, white space around it aside."""
    part = (text or "").strip()
    rows = candidates(spark, path, part)
    if first_day is not None:
        rows = rows.filter(F.col("date_num") >= first_day)
    if last_day is not None:
        rows = rows.filter(F.col("date_num") <= last_day)
    return rows.filter(F.col("ip_user").contains(F.lit(part))) if part else rows
