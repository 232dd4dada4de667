"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import pathlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from pulseline.session import configure, stored, work_dir

__all__ = [
    "WORDS", "bucketed", "each_of", "forget", "held_out", "matrix", "packed", "prepare", "shuffles_dropped", "stored", "table",
    "unpacked", "whole_row", "work_dir",
]

#: A word: everything between ASCII blanks (space, tab, line feed, VT, FF, CR).
WORDS = r"[^\x20\x09-\x0D]+"


#: Bytes of a batch that goes to a Python worker, about; a single longer text is a batch of its own.
BATCH_BYTES = 8 << 20

ROOT = str(pathlib.Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the operators.

    Arrow batches are bounded by rows and by bytes, because texts can be long. Python workers look for this package
    where the driver found it; a cluster without that path gets it with ``--py-files``.
    """
    configure(spark)
    env = spark.sparkContext.environment
    paths = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one, ``row``: what is computed beside it cannot clash with their names."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns]).alias("row")


def packed(rows: DataFrame) -> DataFrame:
    """``rows`` with their column ``text`` as compressed bytes, ``packed``, behind all others.

    For texts that have to move: one by one they get smaller than in an exchange. A null text counts as empty.
    """
    others = [f for f in rows.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = [squeeze((t or "").encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
            arrays = [*(batch.column(f.name) for f in others), pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, [*(f.name for f in others), "packed"])

    return rows.mapInArrow(run, StructType([*others, StructField("packed", BinaryType())]))


def unpacked(texts: pa.Array) -> list[str]:
    """The texts of a batch's column of ``packed`` bytes."""
    open_ = zstandard.ZstdDecompressor().decompress
    return [open_(x).decode("utf-8", "surrogatepass") for x in texts.to_pylist()]


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """``df`` written to the work folder in buckets by ``key`` and read back.

    Joins on the key then bring the other side to the buckets and leave this one where it is. Rows should already be dealt by
    the key, or every task writes a file for every bucket.
    """
    spark = df.sparkSession
    path = work_dir(spark, name)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    title = f"{name}_{path.rsplit('-', 1)[1]}"
    df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(title)
    return spark.table(title)


#: Spark's own switch: a query that has ended drops its shuffle files.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes that run inside drop their shuffle files when they end, not when the driver next collects its garbage.

    For rows that are written once and then read back: running the same frame again would have to repeat its shuffles.
    """
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(DROP_SHUFFLES, before)


def forget(df: DataFrame) -> None:
    """Delete the folder of a ``stored`` frame that nothing reads any more."""
    spark = df.sparkSession
    context, files = spark.sparkContext, df.inputFiles()
    if files:
        folder = context._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def held_out(key: str, modulus: int, remainder: int) -> Column:
    """True where crc32 of the key as text leaves ``remainder``; false for a null key."""
    rest = F.crc32(F.col(key).cast("string").cast("binary")) % modulus
    return F.coalesce(rest == remainder, F.lit(False))


def each_of(n: int) -> Column:
    """One row for each number below ``n``."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def matrix(rows: pa.Table, column: str, dim: int) -> np.ndarray:
    """A column of lists of ``dim`` numbers as one array."""
    flat = rows.column(column).combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim)
