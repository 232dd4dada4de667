"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing column names."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pulseline.llm import (
    ann,
    imatch,
    language_id,
    mixing,
    near_dedup,
    packing,
    quality,
    secret_scan,
    token_counts,
    toxicity,
)
from pulseline.llm.common import BATCH_BYTES, prepare
from pulseline.llm.queries import TOKENIZER
from pulseline.session import work_dir

LONG = "alpha beta gamma delta, epsilon zeta. " * 4000
CLASH = (
    "size key value rep label score range edge batch content target taken word spans held_out "
    "source_size epochs cut_key text_ id vector block n a b x node base model sketch "
    "_whole _base _model _spans _mix_size _mix_key _gone _again _id _at _text row whole gone words extra value_"
).split()
ROWS = [
    (1, None, None, None),
    (2, "", "en", "s1"),
    (3, " \t\n", "en", None),
    (4, "only", "en", "s1"),
    (5, LONG, "en", "s2"),
    (6, "one two three four five six seven", None, "s2"),
    (7, "one two three four five six seven", "en", "s3"),
    (8, "same words in this row here", "de", "s3"),
    (8, "same words in this row here", "de", "s3"),
    (None, "a row without an id of its own", "de", "s1"),
    (9, "UPPER case Text 🙂 ünïcode", "de", ""),
]
BASE = "doc_id long, text string, lang string, source string, n_chars long, "
SCHEMA = BASE + ", ".join(f"{c} string" for c in CLASH)
LABELS = "doc_id long, quality int, toxic int, label string, text string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, len(r[1] or ""), *["x"] * len(CLASH)) for r in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i != 2), int(i == 4), "x", "y") for i in range(1, 10)] + [
        (None, 1, 1, "x", "y"),
        (5, 0, 1, "x", "y"),
        (6, None, None, "x", "y"),
    ]
    return spark.createDataFrame(rows, LABELS)


def ids(rows):
    return sorted((r.doc_id for r in rows), key=lambda i: (i is None, i))


ALL_IDS = ids([type("R", (), {"doc_id": r[0]}) for r in ROWS])


def test_toxicity(docs, empty, labels):
    out = toxicity.grade(docs, labels).collect()
    assert ids(out) == ALL_IDS and all(0 <= r.score <= 1 for r in out)
    none = labels.limit(0)
    assert {r.score for r in toxicity.grade(docs, none).collect()} == {0.0}
    assert toxicity.grade(empty, labels).count() == 0


def test_quality(docs, empty, labels):
    out = quality.grade(docs, labels).collect()
    assert ids(out) == ALL_IDS and all(0 <= r.score <= 1 for r in out)
    # No label, no field: everything is as good as the (missing) labels say.
    assert {r.predicted for r in quality.grade(docs, labels.limit(0)).collect()} == {1}
    assert quality.grade(empty, labels).count() == 0
    kept = quality.keep_good(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == len(ROWS)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    scores, links = rng.normal(size=7), rng.normal(size=(2, 2))
    first = np.array([0, 4, 5, 7])
    got, pairs = quality.marginals(scores, links, first)
    want, seen = [], np.zeros((2, 2))
    for a, b in zip(first, first[1:]):
        n = b - a
        paths = [[(m >> t) & 1 for t in range(n)] for m in range(2**n)]
        weight = np.array(
            [np.exp(sum(scores[a + t] for t in range(n) if p[t]) + sum(links[x, y] for x, y in zip(p, p[1:]))) for p in paths]
        )
        weight /= weight.sum()
        want += [sum(w for w, p in zip(weight, paths) if p[t]) for t in range(n)]
        for w, p in zip(weight, paths):
            for x, y in zip(p, p[1:]):
                seen[x, y] += w
    assert np.allclose(got, want) and np.allclose(pairs, seen)


def test_mixing(docs, empty):
    out = mixing.mix(docs).collect()
    assert ids(out) == ALL_IDS
    assert all(r.taken <= 2 * r.size for r in out)
    by_source = {}
    for r in out:
        by_source.setdefault(r.source, []).append(r)
    for rows in by_source.values():
        # Rows with equal keys share what is left; each loses less than a word.
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= len(rows)
        assert rows[0].target <= 2 * rows[0].source_size
    assert {r.taken for r in out if r.doc_id in (1, 2, 3)} == {0}
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0
    assert mixing.mixed(docs).columns == docs.columns


def test_near_dedup(spark, docs, empty):
    out = near_dedup.near_duplicates(docs, words=2).collect()
    assert ids(out) == ALL_IDS
    by = {r.doc_id: r for r in out}
    assert by[7].component_id == 6 and not by[7].kept and by[6].kept
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0
    assert by[1].kept and by[4].n_shingles == 1 and by[8].component_id == 8
    assert by[None].component_id is None and by[None].kept is None
    assert near_dedup.near_duplicates(empty).count() == 0
    kept = near_dedup.one_of_each(docs, words=2)
    assert kept.columns == docs.columns
    assert ids(kept.collect()) == [1, 2, 3, 4, 5, 6, 8, 9, None]
    # An id with several texts is one document and links what they are like.
    rows = [(1, "a b c d"), (2, "e f g h"), (3, "a b c d"), (3, "e f g h")]
    two = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in near_dedup.near_duplicates(two, words=2).collect()} == {1}


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100, 160)], "a long, b long")
    got = near_dedup.components(links).collect()
    assert len(got) == 61 and {r.label for r in got} == {100}


def test_packing(docs, empty):
    out = packing.pack_documents(docs, TOKENIZER).collect()
    assert {r.doc_id for r in out} == set(ALL_IDS)
    assert sum(r.length for r in out if r.doc_id in (1, 2, 3)) == 3
    assert sum(r.doc_id == 8 for r in out) == 2
    assert packing.pack_documents(empty, TOKENIZER).count() == 0


def test_token_counts(spark, docs, empty):
    out = token_counts.count_tokens(docs, TOKENIZER, work_dir(spark, "cache")).collect()
    assert ids(out) == ALL_IDS
    by = {r.doc_id: r for r in out}
    assert by[1].n_tokens == by[2].n_tokens == by[3].n_tokens == 0 and by[3].n_bytes == 3
    assert by[5].over_limit and not by[4].over_limit
    assert token_counts.count_tokens(empty, TOKENIZER, work_dir(spark, "cache")).count() == 0


def test_secrets(docs, empty):
    out = secret_scan.span_counts(secret_scan.find_secrets(docs)).collect()
    assert ids(out) == ALL_IDS and {r.spans for r in out} == {""}
    assert secret_scan.find_secrets(empty).count() == 0
    assert secret_scan.mask_secrets(docs).columns == docs.columns


def test_language(docs, empty):
    out = language_id.identify(docs).collect()
    by = {r.doc_id: r for r in out}
    assert ids(out) == ALL_IDS
    assert {by[i].lang_pred for i in (1, 2, 3)} == {"und"}
    assert all(0 <= r.score <= 1 for r in out)
    assert by[5].lang_pred in ("en", "de")
    assert language_id.identify(empty).count() == 0


def test_fingerprints(spark, docs, empty):
    out = imatch.fingerprints(docs).collect()
    assert ids(out) == ALL_IDS
    by = {r.doc_id: r for r in out}
    assert by[6].fingerprint == by[7].fingerprint and by[1].fingerprint == by[2].fingerprint
    assert by[1].n_chars == 0 and by[7].near_next == 1.0
    assert imatch.fingerprints(empty).count() == 0
    one = imatch.fingerprints(docs.filter("doc_id = 6")).first()
    assert one.near_next == 1.0 and one.n_chars == 33


def test_search(spark):
    schema = "vec_id long, embedding array<float>, id string, vector string, score string"
    good = [(i, [float(i), 1.0], "x", "y", "z") for i in range(1, 6)]
    bad = [
        (20, None, "x", "y", "z"),
        (21, [0.0, 0.0], "x", "y", "z"),
        (22, [float("nan"), 1.0], "x", "y", "z"),
        (23, [float("inf"), 1.0], "x", "y", "z"),
        (24, [None, 1.0], "x", "y", "z"),
        (25, [], "x", "y", "z"),
        (None, [1.0, 1.0], "x", "y", "z"),
        (26, [1.0, 1.0, 1.0], "x", "y", "z"),
    ]
    df = spark.createDataFrame(good + good[:2] + bad, schema)
    out = ann.search(df, df.filter("vec_id in (1, 20, 21, 26)"), k=20).collect()
    mine = sorted((r.rank, r.vec_id, r.score) for r in out if r.query_id == 1)
    assert mine == [(1, 5, 6.0), (2, 4, 5.0), (3, 3, 4.0), (4, 2, 3.0)]
    assert {r.query_id for r in out} == {1}
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
    # Ties go to the smaller id.
    same = spark.createDataFrame([(i, [1.0, 0.0], "", "", "") for i in range(40)], schema)
    tied = ann.search(same, same.filter("vec_id = 0"), k=5).orderBy("rank").collect()
    assert [r.vec_id for r in tied] == [1, 2, 3, 4, 5]


LETTERS = {
    "½ ① ² Ⅷ 12 _": "und",
    "\u0301\u0302": "und",
    "हिन्दी भाषा": "hi",
    "one two": "en",
    "Ⅷ two": "en",
    "e\u0301te\u0301": "fr",
}


def test_letters_of_languages(spark):
    assert language_id.words("हिन्दी½x²") == ["हिन्दी", "x"]
    learn = [(f"{i}", t, lang) for i in range(9) for t, lang in (
        ("यह हिन्दी भाषा है", "hi"), ("one two three", "en"), ("e\u0301te\u0301 de la", "fr"))]
    model = language_id.train(spark.createDataFrame(learn, "id string, text string, lang string"))
    asked = spark.createDataFrame(list(enumerate(LETTERS)), "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language_id.predict(asked, model).collect()}
    assert [got[i] for i in range(len(LETTERS))] == list(LETTERS.values())


def test_batches_are_bounded_by_bytes(spark):
    """Long texts do not meet in one batch."""
    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a "), 500_000).alias("text"))
    prepare(spark)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    got = [r.n for r in rows.coalesce(1).mapInArrow(sizes, "n long").collect()]
    assert sum(got) > 4e7 and max(got) < 2 * BATCH_BYTES


def test_pipeline_stages_keep_odd_rows(spark, docs, labels, tmp_path):
    labels.limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    secret = "password = hunter2secret and more words"
    extra = docs.filter("doc_id = 4").withColumn("text", F.lit(secret)).withColumn("doc_id", F.lit(12).cast("long"))
    frame = docs.unionByName(extra)
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, str(tmp_path))
        if name != "packing":
            assert frame.columns == docs.columns
            frame = spark.createDataFrame(frame.collect(), docs.schema)
        found[name] = frame.collect()
    assert ids(found["quality"]) == ids([*docs.collect(), type("R", (), {"doc_id": 12})])
    # One row of a repeated id and one of two equal texts stay; null ids and empty texts all do.
    assert ids(found["near_dedup"]) == [1, 2, 3, 4, 5, 6, 8, 9, 12, None]
    assert len(found["secrets"]) == len(found["near_dedup"])
    assert [r.text for r in found["secrets"] if r.doc_id == 12] == ["[assign] and more words"]
    assert all(r["_whole"] == "x" and r["_spans"] == "x" for r in found["secrets"])
    # Documents without words are in no mix.
    assert not {1, 2, 3} & {r.doc_id for r in found["mixing"]}
    assert {r["_mix_key"] for r in found["mixing"]} == {"x"}
    assert {r.doc_id for r in found["packing"]} == {r.doc_id for r in found["mixing"]}


def test_pipeline_on_an_empty_table(spark, empty, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    frame = empty
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.count() == 0
