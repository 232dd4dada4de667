"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are shares of character classes and word shapes, its own
and those of the lines before and after it; the chain links the labels of neighbouring lines.
Forward-backward gives each line's probability of being good, and a document's quality is their mean,
weighted by the lines' lengths. The field is fitted on a bounded sample of labelled documents, whose
lines start with the document's label and are then relabelled by the field: a bad document
may have good lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseline.llm.common import held_out

#: Bounds of the fitting sample: documents of each label, and bytes of a document in it.
SAMPLE_DOCS, SAMPLE_BYTES = 1000, 16_000
#: Rounds of relabelling, and steps of gradient ascent in each.
ROUNDS, STEPS = 2, 150
PENALTY = 1e-4


def _classes() -> np.ndarray:
    """A row per byte: letter, capital, digit, blank, sentence sign, other sign, '!', '|'."""
    out = np.zeros((256, 8), np.float32)
    for b in range(256):
        c = chr(b)
        letter = b >= 128 or c.isalpha()
        out[b] = (
            letter,
            b < 128 and c.isupper(),
            c.isdigit() and b < 128,
            b in (9, 10, 11, 12, 13, 32),
            c in ".,;:?'\"-()",
            b > 32 and b < 128 and not c.isalnum() and c not in ".,;:?'\"-()!|",
            c == "!",
            c == "|",
        )
    return out


_CLASSES = _classes()
OWN = 16  # features of one line
FEATURES = 3 * OWN + 3


def line_table(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines of a batch of texts: features, lengths, and each text's first line (and the end).

    Lines end at line feeds; a null or empty text is one empty line. All counts are taken over the batch's
    bytes at once.
    """
    values = [("" if t is None else t).encode("utf-8", "surrogatepass") for t in texts.to_pylist()]
    data = np.frombuffer(b"\n".join(values) + b"\n", np.uint8)
    sizes = np.array([len(v) + 1 for v in values], np.int64)
    ends = np.flatnonzero(data == 10)
    starts = np.r_[0, ends[:-1] + 1]
    first = np.searchsorted(starts, np.r_[0, np.cumsum(sizes)])
    length = (ends - starts).astype(np.float64)

    counts = np.empty((len(starts), _CLASSES.shape[1]))
    for j in range(_CLASSES.shape[1]):
        # Sums from line start to the next one; the line feed counts as blank only.
        counts[:, j] = np.add.reduceat(_CLASSES[:, j].take(data), starts)
    counts[:, 3] -= 1
    blank = _CLASSES[:, 3].take(data) > 0
    word_start = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    word_end = np.flatnonzero(blank & np.r_[False, ~blank[:-1]])
    size = word_end - word_start
    line = np.searchsorted(ends, word_start)
    n = len(starts)
    words = np.bincount(line, minlength=n).astype(np.float64)
    short = np.bincount(line, size <= 3, minlength=n)
    long = np.bincount(line, size >= 18, minlength=n)
    head = data.take(word_start)
    capital = np.bincount(line, (head >= 65) & (head <= 90), minlength=n)
    # Equal words and lines have equal marks: sums of their bytes' values by place.
    value = np.where(blank, 0, data + np.uint64(1)).astype(np.uint64)
    again = np.zeros(n)
    if len(word_start):
        place = np.arange(len(data), dtype=np.uint64)
        place[: word_start[0]] = 0
        place[word_start[0] :] -= np.repeat(
            word_start, np.diff(np.r_[word_start, len(data)])
        ).astype(np.uint64)
        mark = np.add.reduceat(value * (place * place + np.uint64(7)), word_start)
        twice = np.r_[False, (mark[1:] == mark[:-1]) & (line[1:] == line[:-1])]
        again = np.bincount(line, twice, minlength=n)
        turn = np.arange(len(mark), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        # A line's mark: its words' marks by their order in the line.
        lead = np.r_[True, line[1:] != line[:-1]]
        turn -= np.repeat(turn[lead], np.diff(np.r_[np.flatnonzero(lead), len(mark)]))
        whole = np.zeros(n, np.uint64)
        whole[line[lead]] = np.add.reduceat(mark * (turn + np.uint64(3)), np.flatnonzero(lead))
    else:
        whole = np.zeros(n, np.uint64)
    owner = np.repeat(np.arange(len(values), dtype=np.uint64), np.diff(first))
    key = (whole + length.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    key ^= owner * np.uint64(0xC2B2AE3D27D4EB4F)
    _, same, times = np.unique(key, return_inverse=True, return_counts=True)
    repeated = (times[same] > 1) & (words > 0)

    by = np.maximum(length, 1.0)
    per = np.maximum(words, 1.0)
    letters, upper, digits, _, signs, odd, shout, bars = counts.T
    own = np.c_[
        letters / by,
        upper / by,
        digits / by,
        signs / per,
        np.minimum(odd / per, 3.0),
        np.minimum(shout / per, 3.0),
        np.minimum(bars / per, 1.0),
        np.minimum(length / per, 20.0) / 10,
        short / per,
        long / per,
        again / per,
        capital / per,
        np.log1p(words) / 4,
        (length == 0),
        repeated,
        (words > 0) & (words < 4),
    ].astype(np.float32)
    none = np.zeros((1, OWN), np.float32)
    before, after = np.r_[none, own[:-1]], np.r_[own[1:], none]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    edges = np.zeros((n, 3), np.float32)
    edges[:, 0] = 1
    edges[first[:-1], 1] = 1
    edges[first[1:] - 1, 2] = 1
    return np.c_[own, before, after, edges], length, first


def marginals(
    scores: np.ndarray, links: np.ndarray, first: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line, and the expected counts of neighbouring labels.

    ``scores`` are the lines' log odds of being good, ``links`` the 2 x 2 scores of neighbouring
    labels (bad, good), ``first`` the sequences' first lines and the end. All sequences step
    together, longest first.
    """
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    sizes, start = sizes[order], first[:-1][order]
    n, longest = len(sizes), int(sizes[0]) if len(sizes) else 0
    active = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(longest)]
    link = np.exp(links - links.max())
    node = np.empty((len(scores), 2))
    node[:, 1] = 1 / (1 + np.exp(-np.clip(scores, -30, 30)))
    node[:, 0] = 1 - node[:, 1]
    ahead, back = np.empty_like(node), np.ones_like(node)
    for t in range(longest):
        rows = start[: active[t]] + t
        ahead[rows] = node[rows] if t == 0 else (ahead[rows - 1] @ link) * node[rows]
        ahead[rows] /= ahead[rows].sum(axis=1, keepdims=True)
    pairs = np.zeros((2, 2))
    for t in range(longest - 1, 0, -1):
        rows = start[: active[t]] + t
        later = node[rows] * back[rows]
        joint = ahead[rows - 1][:, :, None] * link[None] * later[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        behind = later @ link.T
        back[rows - 1] = behind / behind.sum(axis=1, keepdims=True)
    both = ahead * back
    return both[:, 1] / both.sum(axis=1), pairs


class Field:
    """Weights of line features and label links."""

    def __init__(self, weights: np.ndarray, links: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.weights, self.links, self.mean, self.scale = weights, links, mean, scale

    def line_probabilities(self, table: np.ndarray, first: np.ndarray) -> np.ndarray:
        scores = ((table - self.mean) / self.scale).astype(np.float64) @ self.weights
        return marginals(scores, self.links, first)[0]

    def qualities(self, texts: pa.Array) -> np.ndarray:
        table, length, first = line_table(texts)
        good = self.line_probabilities(table, first)
        weight = np.maximum(length, 1.0)
        return np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])


def fit(texts: pa.Array, labels: np.ndarray) -> Field:
    """Fit a field to documents with labels 0 and 1 by penalised likelihood.

    Lines count by their length in the gradient of their features; links count once each. The two halves
    of the gradient thus weigh a line differently, on purpose: a link is between two lines of any length.
    """
    table, length, first = line_table(texts)
    owner = np.repeat(np.arange(len(labels)), np.diff(first))
    mean, scale = table.mean(axis=0), table.std(axis=0) + 1e-3
    mean[-3], scale[-3] = 0, 1  # the constant
    x = ((table - mean) / scale).astype(np.float64)
    line = labels[owner].astype(np.float64)
    inner = np.ones(len(line), bool)
    inner[first[:-1]] = False
    # A line counts by its length, as it does in the document's quality.
    weight = np.sqrt(np.minimum(np.maximum(length, 1.0), 400.0))
    weight /= weight.mean()
    field = Field(np.zeros(x.shape[1]), np.zeros((2, 2)), mean, scale)
    for turn in range(ROUNDS):
        if turn:
            good = field.line_probabilities(table, first)
            line = np.where(labels[owner] == 0, (good > 0.8).astype(float), line)
        seen = np.zeros((2, 2))
        at = np.flatnonzero(inner)
        np.add.at(seen, (line[at - 1].astype(int), line[at].astype(int)), 1)
        step = np.zeros(x.shape[1] + 4)
        square = np.zeros_like(step)
        for i in range(1, STEPS + 1):
            good, pairs = marginals(x @ field.weights, field.links, first)
            slope = x.T @ ((line - good) * weight) / len(line) - PENALTY * field.weights
            link = (seen - pairs) / len(line) - PENALTY * field.links
            both = np.r_[slope, link.ravel()]
            step = 0.9 * step + 0.1 * both
            square = 0.99 * square + 0.01 * both**2
            move = 0.05 * (step / (1 - 0.9**i)) / (np.sqrt(square / (1 - 0.99**i)) + 1e-8)
            field.weights = field.weights + move[:-4]
            field.links = field.links + move[-4:].reshape(2, 2)
    return field


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int):
    """The fitting sample as Arrow: texts and labels of documents that are not held out.

    Per label the ``SAMPLE_DOCS`` documents of up to ``SAMPLE_BYTES`` bytes that come first by a hash of
    their id, so it is the same in every run and bounded whatever the input.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label"))
    # An id with both labels is bad.
    known = known.filter(F.col("label").isin(0, 1)).groupBy("_id").agg(F.min("label").alias("label"))
    rows = docs.select("doc_id", "text").filter(
        ~held_out("doc_id", modulus, remainder) & (F.octet_length("text") <= SAMPLE_BYTES)
    )
    ids = rows.select("doc_id").distinct().join(known, F.col("doc_id") == F.col("_id"))
    mark = F.xxhash64("doc_id", F.lit(label))
    chosen = None
    for value in (0, 1):
        part = ids.filter(F.col("label") == value).orderBy(mark, "doc_id").limit(SAMPLE_DOCS)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 2 x SAMPLE_DOCS ids.
    picked = rows.join(F.broadcast(chosen.select("_id", "label")), F.col("doc_id") == F.col("_id"))
    # The first of several texts of an id.
    picked = picked.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return picked.toArrow().sort_by("doc_id")


def score(
    docs: DataFrame, field: Field | None, base: float, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id and score (0 to 1) of every text; ``base`` for all without a field."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            if not len(batch):
                continue
            if model is None:
                scores = np.full(len(batch), base)
            else:
                scores = model.qualities(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"]
            )

    two = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    return two.mapInArrow(run, "doc_id long, score double")


def learn(
    docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0
) -> tuple[Field | None, float]:
    """The field, and the share of good documents in the sample (for want of a field).

    Without documents of both labels there is no field; without any the share is 1.
    """
    rows = sample(docs, labels, "quality", modulus, remainder)
    known = rows.column("label").to_numpy()
    base = float(known.mean()) if len(known) else 1.0
    if len(set(known.tolist())) < 2:
        return None, base
    return fit(rows.column("text").combine_chunks(), known), base


def grade(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.3,
    modulus: int = 5,
    remainder: int = 0,
) -> DataFrame:
    """Quality of every document: doc_id, held_out, score, predicted (1 if score >= threshold).

    Labels are learned only from documents that are not held out (crc32 of the id as text does not
    leave ``remainder``). Null and empty texts are one empty line and get a score too; repeated
    rows get one row each; conflicting labels of an id count once; an empty table gives no rows.
    Only id and text are read.
    """
    field, base = learn(docs, labels, modulus, remainder)
    rows = score(docs, field, base)
    return rows.select(
        "doc_id",
        held_out("doc_id", modulus, remainder).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.3,
    modulus: int = 5,
    remainder: int = 0,
    text_col: str = "text",
) -> DataFrame:
    """The rows whose quality reaches the threshold, with all their columns.

    Learns as ``grade`` does. Rows pass through the scoring as they are, so nothing is joined and
    repeated rows and null ids need no key.
    """
    field, base = learn(docs, labels, modulus, remainder)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            if model is None:
                good = np.full(len(batch), base >= threshold)
            elif len(batch):
                good = model.qualities(batch.column(text_col)) >= threshold
            else:
                good = np.zeros(0, bool)
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
