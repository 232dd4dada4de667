"""Language of texts: word frequencies first, character n-grams for unseen words.

Words of all learning texts are counted per language. A known word (its share of the words of some
language reaches ``word_share``) scores every language by log frequency. An unseen word falls back to its
longest character n-grams of which one is known, and so on down to single characters. A text's
language is the one with the largest mean score of its words.

The model goes to every task. Its size has a bound that does not depend on the corpus: at most
1 / ``word_share`` words of a language can have that share of its words, and likewise at most
1 / ``gram_share`` n-grams of each length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseline.llm.common import held_out, stored

WORD_SHARE = 1e-5
GRAM_SHARE = 1e-4
LONGEST = 5
#: Distinct words that a task or worker holds before it hands them on or starts anew.
HELD_WORDS = 300_000

# Letters and the marks on them; numbers that are written as one sign are neither.
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_ASCII = re.compile(r"[a-z]+")


def words(text: str) -> list[str]:
    """Runs of letters with their marks, in lower case."""
    low = text.lower()
    return (_ASCII if low.isascii() else _LETTERS).findall(low)


def grams(word: str, n: int) -> list[str]:
    """n-grams of a word with its ends marked; single characters have no marks."""
    marked = word if n == 1 else f" {word} "
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, word, n over all rows of texts (lang, text); counted in each task before the shuffle."""

    def emit(counts: dict[str, Counter]) -> pa.RecordBatch:
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        langs, found, ns = zip(*rows) if rows else ([], [], [])
        return pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(found, pa.string()), pa.array(ns, pa.int64())],
            ["lang", "word", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            pairs = zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist())
            for lang, text in pairs:
                counts.setdefault(lang, Counter()).update(words(text))
            if sum(map(len, counts.values())) > HELD_WORDS:
                yield emit(counts)
                counts = {}
        yield emit(counts)

    each = texts.select("lang", "text").mapInArrow(run, "lang string, word string, n long")
    return each.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(counted: DataFrame) -> DataFrame:
    """lang, size, gram, n of counted words; summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n"))):
                for size in range(1, LONGEST + 1):
                    for gram in grams(word, size):
                        counts[lang, size, gram] += n
            keys = list(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.string()),
                    pa.array([k[1] for k in keys], pa.int32()),
                    pa.array([k[2] for k in keys], pa.string()),
                    pa.array(list(counts.values()), pa.int64()),
                ],
                ["lang", "size", "gram", "n"],
            )

    schema = "lang string, size int, gram string, n long"
    each = counted.select("lang", "word", "n").mapInArrow(run, schema)
    return each.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Log frequencies per language of known words and n-grams.

    ``places`` has a table from term to row per n-gram size, words at 0; ``scores`` has a row per term
    and a column per language.
    """

    def __init__(self, langs: list[str], tables: list[tuple[dict[str, dict[int, float]], float]]):
        self.langs = langs
        self.places: list[dict[str, int]] = []
        rows = []
        for table, floor in tables:
            self.places.append({term: len(rows) + i for i, term in enumerate(table)})
            for by_lang in table.values():
                row = [floor] * len(langs)
                for i, share in by_lang.items():
                    row[i] = math.log(share)
                rows.append(row)
        self.scores = np.array(rows, np.float32).reshape(len(rows), len(langs))

    def rows_of(self, word: str) -> list[int]:
        """The row of a known word, or those of the longest of its n-grams that are known."""
        if (known := self.places[0].get(word)) is not None:
            return [known]
        for n in range(LONGEST, 0, -1):
            place = self.places[n]
            if found := [place[g] for g in grams(word, n) if g in place]:
                return found
        return []

    def word_scores(self, new: list[str]) -> np.ndarray:
        """Scores of words: means over their rows, zero where there are none."""
        rows = [self.rows_of(w) for w in new]
        sizes = np.array([len(r) for r in rows])
        out = np.zeros((len(new), len(self.langs)), np.float32)
        some = np.flatnonzero(sizes)
        if len(some):
            flat = np.fromiter((i for r in rows for i in r), np.int64, int(sizes.sum()))
            starts = np.r_[0, np.cumsum(sizes[some])[:-1]]
            sums = np.add.reduceat(self.scores[flat], starts, axis=0)
            out[some] = sums / sizes[some, None]
        return out


def train(
    texts: DataFrame, word_share: float = WORD_SHARE, gram_share: float = GRAM_SHARE
) -> Model:
    """A model of all texts (lang, text) with a language; the counts are made by Spark."""
    texts = texts.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counted = stored(word_counts(texts), "words")
    total = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    known = (
        counted.join(F.broadcast(total), "lang")
        .withColumn("share", F.col("n") / F.col("total"))
        .select("lang", F.lit(0).alias("size"), F.col("word").alias("term"), "share")
        .filter(F.col("share") >= word_share)
    )
    pieces = stored(gram_counts(counted), "grams")
    total = pieces.groupBy("lang", "size").agg(F.sum("n").alias("total"))
    parts = (
        pieces.join(F.broadcast(total), ["lang", "size"])
        .withColumn("share", F.col("n") / F.col("total"))
        .select("lang", "size", F.col("gram").alias("term"), "share")
        .filter(F.col("share") >= gram_share)
    )
    rows = known.unionByName(parts).collect()  # bounded by the shares
    langs = sorted({r.lang for r in rows})
    place = {lang: i for i, lang in enumerate(langs)}
    tables: list[dict] = [{} for _ in range(LONGEST + 1)]
    for r in rows:
        tables[r.size].setdefault(r.term, {})[place[r.lang]] = r.share
    floors = [math.log(word_share / 10)] + [math.log(gram_share / 10)] * LONGEST
    return Model(langs, list(zip(tables, floors)))


class Scorer:
    """Predicts texts; remembers the scores of words, up to a fixed number."""

    def __init__(self, model: Model):
        self.model = model
        self._reset()

    def _reset(self):
        self.places: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.langs)), np.float32)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        found = [words(t) if t else [] for t in texts]
        if len(self.places) > HELD_WORDS:
            self._reset()
        new = list(set().union(*found).difference(self.places))
        if new and self.model.langs:
            self.places |= zip(new, range(len(self.places), len(self.places) + len(new)))
            self.scores = np.concatenate([self.scores, self.model.word_scores(new)])
        return [self._one(f) for f in found]

    def _one(self, found: list[str]) -> tuple[str, float]:
        if not found or not self.model.langs:
            return "und", 0.0
        rows = np.fromiter(map(self.places.__getitem__, found), np.int64, len(found))
        # The words' scores depend on one another, so their sum is damped.
        total = self.scores[rows].sum(axis=0, dtype=np.float64) / math.sqrt(len(found))
        best = int(total.argmax())
        return self.model.langs[best], float(1 / np.exp(total - total[best]).sum())


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"):
    """lang_pred and score of every text: doc_id, lang_pred, score (0 to 1).

    ``und`` with score 0 where the text is null, empty or has no letter, or nothing was learned.
    Ties go to the first language in code point order. Rows with repeated or null ids are kept; an empty
    table gives no rows; other input columns are ignored. Whole texts are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            got = scorer.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([g[0] for g in got], pa.string()),
                    pa.array([g[1] for g in got], pa.float64()),
                ],
                ["doc_id", "lang_pred", "score"],
            )

    two = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    return two.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, modulus: int = 3, remainder: int = 1) -> DataFrame:
    """Learn from the documents that are not held out, predict all; see ``predict``.

    A document is held out if crc32 of its id as text leaves ``remainder``. Rows with a null id
    take part in learning.
    """
    out = held_out("doc_id", modulus, remainder)
    model = train(docs.filter(~out).select("lang", "text"))
    return predict(docs, model).withColumn("held_out", out)
