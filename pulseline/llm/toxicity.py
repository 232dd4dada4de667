"""Toxicity by compression distance: windows of a text against two zstandard dictionaries.

One dictionary is trained on ordinary text, the other on the words of toxic texts that hold a
character n-gram typical of them. Every window of a text is compressed twice: with the ordinary dictionary, and with
both dictionaries behind one another. An ordinary window gains nothing from the second one, a toxic window gets
shorter. Windows are short, so their literals stay uncompressed and a match shows in whole
bytes. The lengths saved, held against thresholds, give a document's features, and a logistic
calibration on labelled documents its score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseline.llm.common import held_out

#: Bytes of a window, at most; zstandard compresses no literals below 64.
WINDOW = 56
#: Sizes of the dictionaries' contents.
ORDINARY_BYTES, TOXIC_BYTES = 16_384, 1024
#: Bounds of the fitting sample: documents of each label, and bytes of a document in it.
SAMPLE_DOCS, SAMPLE_BYTES = {0: 3000, 1: 2000}, 16_000
#: n-grams that may mark toxic words: lengths, least log-likelihood ratio that their texts are not
#: drawn from all alike, and least ratio of their shares of toxic and of ordinary texts.
GRAMS, GRAM_GAIN, GRAM_RATIO = (4, 5, 6), 16.0, 30.0
#: Windows count by the bytes saved: the thresholds of the calibration.
SAVED = (3, 4, 5, 6)


def windows(text: str) -> list[bytes]:
    """The whole text in lower case in windows that end before a space, if there is one."""
    data = text.lower().encode("utf-8", "surrogatepass")
    n, i, out = len(data), 0, []
    while i < n:
        j = min(i + WINDOW, n)
        if j < n and (k := data.rfind(b" ", i, j)) > i:
            j = k
        out.append(data[i:j])
        i = j
    return out


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        window_log=17,
        chain_log=16,
        hash_log=15,
        search_log=7,
        min_match=4,
        target_length=64,
        strategy=zstandard.STRATEGY_BTLAZY2,
        write_content_size=False,
        write_checksum=False,
        write_dict_id=False,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    content = content or b" " * 8
    words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=words, compression_params=params)


class Distance:
    """Bytes that windows save with the toxic dictionary."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self._without = _compressor(ordinary).compress
        self._with = _compressor(ordinary + toxic).compress

    def saved(self, text: str | None) -> np.ndarray:
        without, both = self._without, self._with
        return np.array([len(without(w)) - len(both(w)) for w in windows(text or "")] or [0])

    def features(self, text: str | None) -> list[float]:
        saved = self.saved(text)
        top = np.sort(saved)[-3:]
        shares = [float((saved >= s).mean()) for s in SAVED]
        counts = [float(np.log1p((saved >= s).sum())) for s in (5, 7)]
        return [float(top[-1]), float(np.log(len(saved))), float(saved.mean()), *shares, *counts] + [
            float(top.mean())
        ]


def _train(size: int, samples: list[bytes], segment: int) -> bytes:
    """A trained dictionary's content; the samples' own end where there are too few to train."""
    try:
        trained = zstandard.train_dictionary(size, samples, k=segment, d=6)
        return trained.as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _grams(word: str) -> list[str]:
    marked = f" {word} "
    return [marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)]


def typical_words(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """For each toxic text, its words with an n-gram typical of toxic texts."""

    def shares(texts: list[str], known: Counter | None = None) -> Counter:
        count: Counter = Counter()
        for text in texts:
            found = {g for word in set(text.lower().split()) for g in _grams(word)}
            count.update(found if known is None else found.intersection(known))
        return count

    chance = len(toxic) / max(1, len(toxic) + len(ordinary))
    # Rarer n-grams could not be significant even if no ordinary text had them.
    rarest = GRAM_GAIN / -np.log(chance) if 0 < chance < 1 else 1.0
    inside = Counter({g: n for g, n in shares(toxic).items() if n >= rarest})
    outside = shares(ordinary, inside)

    def gain(n: int, other: int) -> float:
        total = n + other
        rest = other * np.log(other / (total * (1 - chance))) if other else 0.0
        return n * np.log(n / (total * chance)) + rest

    odds = GRAM_RATIO * len(toxic) / max(1, len(ordinary))
    typical = {
        g
        for g, n in inside.items()
        if n > odds * (outside[g] + 0.5) and gain(n, outside[g]) >= GRAM_GAIN
    }
    out = []
    for text in toxic:
        kept = [w for w in text.lower().split() if not typical.isdisjoint(_grams(w))]
        if kept:
            out.append(f" {' '.join(kept)} ".encode("utf-8", "surrogatepass"))
    return out


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """Contents of the ordinary and the toxic dictionary."""
    pieces = [
        data[i : i + 256]
        for t in ordinary
        for data in (t.lower().encode("utf-8", "surrogatepass"),)
        for i in range(0, len(data), 256)
    ]
    return (
        _train(ORDINARY_BYTES, pieces, 64),
        _train(TOXIC_BYTES, typical_words(toxic, ordinary), 16),
    )


def logistic(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3
) -> np.ndarray:
    """Weights (constant first) of a penalised logistic regression, by Newton steps."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty * len(y))
    ridge[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ ((y - p) * weight) - ridge * w
        bend = (x.T * (weight * p * (1 - p))) @ x + np.diag(ridge + 1e-9)
        move = np.linalg.solve(bend, slope)
        w = w + move
        if np.abs(move).max() < 1e-8:
            break
    return w


class Model:
    """Dictionaries and calibration; without both labels only a constant score."""

    def __init__(self, ordinary: bytes, toxic: bytes, base: float):
        self.ordinary, self.toxic, self.base = ordinary, toxic, base
        self.weights: np.ndarray | None = None
        self.mean = self.scale = None

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Fit to features of documents whose dictionaries did not see them.

        The sample has its own mix of labels; weights bring back that of all labels.
        """
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        ratio = self.base / (1 - self.base) * (y == 0).sum() / (y == 1).sum()
        self.weights = logistic((x - self.mean) / self.scale, y, np.where(y == 1, ratio, 1.0))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.base)
        z = self.weights[0] + ((x - self.mean) / self.scale) @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def sample(docs: DataFrame, labels: DataFrame, modulus: int, remainder: int) -> DataFrame:
    """doc_id, text and label of the fitting sample, stored in no order.

    Per label the first ``SAMPLE_DOCS`` documents of up to ``SAMPLE_BYTES`` bytes by a hash of their id,
    so the sample is bounded whatever the input and the same in every run.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("label"))
    # An id with both labels is toxic.
    known = known.filter(F.col("label").isin(0, 1)).groupBy("_id").agg(F.max("label").alias("label"))
    rows = docs.select("doc_id", "text").filter(
        ~held_out("doc_id", modulus, remainder) & (F.octet_length("text") <= SAMPLE_BYTES)
    )
    ids = rows.select("doc_id").distinct().join(known, F.col("doc_id") == F.col("_id"))
    mark = F.xxhash64("doc_id", F.lit("toxic"))
    parts = [
        ids.filter(F.col("label") == value).orderBy(mark, "doc_id").limit(bound)
        for value, bound in SAMPLE_DOCS.items()
    ]
    chosen = parts[0].unionByName(parts[1]).select("_id", "label")
    picked = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    # The first of several texts of an id.
    return picked.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def learn(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1) -> Model:
    """Train on the labelled documents that are not held out."""
    rows = sample(docs, labels, modulus, remainder).toArrow().sort_by("doc_id").to_pylist()
    every = {v: list(dict.fromkeys(r["text"] for r in rows if r["label"] == v)) for v in (0, 1)}
    total = labels.filter(~held_out("doc_id", modulus, remainder)).agg(F.avg("toxic")).first()[0]
    base = float(total or 0.0)
    if len(every[0]) < 2 or len(every[1]) < 2:
        return Model(b"", b"", base)
    model = Model(*dictionaries(every[1], every[0]), base)
    # Calibration on features from dictionaries that the other half of the sample trained.
    halves = [{v: texts[i::2] for v, texts in every.items()} for i in (0, 1)]
    found = [
        _features(docs.sparkSession, own, dictionaries(other[1], other[0]))
        for own, other in (halves, halves[::-1])
    ]
    x = np.concatenate([f[0] for f in found])
    model.calibrate(x, np.concatenate([f[1] for f in found]))
    return model


def _features(spark: SparkSession, texts: dict[int, list[str]], trained: tuple[bytes, bytes]):
    """Features and labels of sampled texts, computed by the executors."""
    rows = [(label, text) for label, some in texts.items() for text in some]
    given = spark.createDataFrame(rows, "label int, text string")
    given = given.repartition(spark.sparkContext.defaultParallelism)
    out = given.mapInArrow(
        _feature_rows(*trained, "label", pa.int64()), "label long, x array<double>"
    ).toArrow()
    labels = out.column("label").to_numpy().astype(float)
    return np.array(out.column("x").to_pylist()).reshape(len(labels), -1), labels


def _feature_rows(ordinary: bytes, toxic: bytes, key: str, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(ordinary, toxic)
        for batch in batches:
            x = [distance.features(t) for t in batch.column("text").to_pylist()]
            arrays = [batch.column(key).cast(kind), pa.array(x, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, [key, "x"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"):
    """doc_id, score (0 to 1) and windows of every text that save bytes by the thresholds."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        distance = Distance(known.ordinary, known.toxic)
        for batch in batches:
            if not len(batch):
                continue
            x = np.array([distance.features(t) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(known.scores(x)), pa.array(x[:, 0])],
                ["doc_id", "score", "most_saved"],
            )

    two = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    return two.mapInArrow(run, "doc_id long, score double, most_saved double")


def grade(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.7,
    modulus: int = 3,
    remainder: int = 1,
) -> DataFrame:
    """Toxicity of every document: doc_id, held_out, score, predicted (1 if score >= threshold),
    most_saved (bytes that its most toxic window saves).

    Labels are learned only from documents that are not held out (crc32 of the id as text does not
    leave ``remainder``). Null and empty texts count as one empty window and get a score
    too; with fewer than two documents of a label every score is the share of toxic labels; repeated rows
    get one row each; an empty table gives no rows. Only id and text are read.
    """
    rows = score(docs, learn(docs, labels, modulus, remainder))
    return rows.select(
        "doc_id",
        held_out("doc_id", modulus, remainder).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "most_saved",
    )
