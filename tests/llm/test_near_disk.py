"""Near-duplicate detection keeps little on disk: shuffles end with their write, used-up tables are deleted."""

import os
import random

from pyspark.sql import functions as F

from pulseline.llm import common, near_dedup


def _shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = manager.getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle(spark):
    before = _shuffle_files(spark)
    rows = near_dedup.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    assert sorted(r["count"] for r in rows.collect()) == [142] + [143] * 6
    assert not _shuffle_files(spark) - before
    assert spark.conf.get(common.DROP_SHUFFLES, "false") == "false"


def test_copies_of_sets_and_sketches_are_deleted(spark, tmp_path):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(900)}" for _ in range(120)] for _ in range(6)]
    texts = []
    for k, words in enumerate(base):
        for copy in range(3):
            changed = list(words)
            changed[copy * 30] = f"x{copy}"
            texts.append((10 * k + copy, " ".join(changed)))
    texts += [(100, None), (101, ""), (102, texts[0][1])]
    root = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = near_dedup.near_duplicates(docs, words=2)
    made = {x for x in os.listdir(root)} - before
    kinds = [x.rsplit("-", 1)[0] for x in made]
    assert "ends" not in kinds and "profiles" not in kinds and "documents" in kinds
    classes = [x for x in made if x.startswith("classes-")]
    assert [spark.read.parquet(f"{root}/{x}").columns for x in classes] == [["set_hash", "rep", "n"]]
    got = {r.doc_id: r.component_id for r in found.collect()}
    assert got == {i: i // 10 * 10 for i, _ in texts[:18]} | {100: 100, 101: 101, 102: 0}
