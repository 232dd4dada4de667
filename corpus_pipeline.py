"""A training-data pipeline: quality, near-duplicates, secrets, mixing, packing.

Each stage takes all documents that the one before kept, with the columns of ``documents``; the last
gives the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseline.llm import mixing, near_dedup, packing, quality, secret_scan
from pulseline.llm.common import prepare, stored, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _sized(docs: DataFrame) -> DataFrame:
    """With the length of a changed text brought up to date."""
    if "n_chars" not in docs.columns:
        return docs
    kind = dict(docs.dtypes)["n_chars"]
    return docs.withColumn("n_chars", F.length("text").cast(kind))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field does not reject."""
    prepare(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by five-word shingles and 0.8."""
    prepare(spark)
    return near_dedup.one_of_each(docs, words=5, similarity=0.8)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by their kind."""
    prepare(spark)
    return _sized(secret_scan.mask_secrets(docs))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources brought to their target weights: documents repeated or left out."""
    prepare(spark)
    return _sized(mixing.mixed(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens."""
    prepare(spark)
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("quality", good_quality),
    ("near_dedup", without_near_duplicates),
    ("secrets", without_secrets),
    ("mixing", mixed_sources),
    ("packing", packed),
]

#: No stage but the mixing can be written in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
