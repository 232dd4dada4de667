"""Token counts through a digest cache.

A text's key is the digest of its normalised content (blanks at both ends dropped, blanks in a
row made one space: neither changes the tokens) beside the digest of the tokenizer file. Keys
found in the cache take the stored count. For the others one document per key is encoded, the new
counts are appended to the cache and joined back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from pulseline.llm.common import stored
from pulseline.llm.tokens import encoder, file_digest

CACHE = "content string, tokenizer string, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of a tokenizer file, read where the driver runs."""
    return file_digest(path)


def content_digest(text: Column) -> Column:
    """sha256 of the text without blanks at its ends and with one space for blanks in a row."""
    one = F.regexp_replace(text, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")
    return F.sha2(F.trim(one).cast("binary"), 256)


def encode_counts(rows: DataFrame, tokenizer: str) -> DataFrame:
    """content and n_tokens of rows (content, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            ids = enc.encode_batch(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("content"), pa.array([len(x) // 4 for x in ids], pa.int64())],
                ["content", "n_tokens"],
            )

    return rows.select("content", "text").mapInArrow(run, "content string, n_tokens long")


def read_cache(spark, cache_dir: str) -> DataFrame:
    """The stored counts; empty if nothing has been stored yet."""
    try:
        return spark.read.schema(CACHE).parquet(cache_dir)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], CACHE)


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    cache_dir: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 2048,
) -> DataFrame:
    """Token count of every text: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    New counts are appended to ``cache_dir``, which must be shared by all executors; a key that
    two runs append at the same time is stored twice with the same count, which does no harm. A null text
    counts as empty. Repeated rows give one row each; equal texts are encoded once, whatever their
    number. A null id is kept. An empty table gives no rows and stores nothing.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    base = base.withColumn("content", content_digest(F.col("text")))
    keys = base.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes"))
    keys = stored(keys, "digests")
    known = read_cache(spark, cache_dir).filter(F.col("tokenizer") == version)
    misses = (
        keys.groupBy("content")
        .agg(F.min("doc_id").alias("_first"))
        .join(known, "content", "left_anti")
        .withColumnRenamed("content", "_content")
    )
    # One document of each missing key; the side of the keys is the one to be hashed.
    pick = (F.col("content") == F.col("_content")) & F.col("doc_id").eqNullSafe(F.col("_first"))
    todo = base.join(misses.hint("shuffle_hash"), pick, "left_semi")
    new = encode_counts(todo, tokenizer).dropDuplicates(["content"])
    new.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode(
        "append"
    ).parquet(cache_dir)
    counts = spark.read.schema(CACHE).parquet(cache_dir).filter(F.col("tokenizer") == version)
    # Stored, so that a content with many copies is split over tasks where it is joined.
    counts = stored(counts.groupBy("content").agg(F.min("n_tokens").alias("n_tokens")), "counts")
    return keys.join(counts, "content").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
