"""I-Match fingerprints: hashes of a document's terms over randomised parts of a lexicon.

The lexicon holds the terms whose inverse document frequency lies in a chosen band. A document keeps its distinct terms
in the lexicon, sorted. Where these are less than a share of its terms, those nearest the band fill up, so that near copies
that are a large part of all texts, whose terms lie above the band, still keep terms in common with their edits.

Sub-lexicons are fixed for the corpus: ``DRAWS`` random ones at each of the shares 1/2, 1/4, and so on, chosen by hashes of the
terms alone. A signature is the hash of all kept terms of a document in one of them: large sub-lexicons tell texts apart that differ in a
few terms, small ones are still equal after larger edits. A signature of share p changes unless none of the
terms that differ is in its sub-lexicon, which has the odds (1 - p)^d for d such terms; the shares at which signatures agree
thus tell how many differ, and with the numbers of kept terms how alike two texts are.

The lexicon goes to every task. Its size has a bound that does not depend on the number of
documents: a term in or above the band is in at least ``low`` of all texts, so there are at
most (mean distinct terms of a text) / ``low`` such terms.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseline.llm.common import packed, unpacked

#: The band of document frequencies (shares of all texts): rarer and more frequent terms go.
LOW, HIGH = 0.001, 0.2
#: Texts with at least this share of all rows count once in the frequencies, and copies of the others as they occur: no
#: text can push its terms out of the band, and at most 1 / COPIES texts have to be known to every task.
COPIES = 1e-5
#: The share of its terms that a document keeps at least, and the distance from the band (in logs of the
#: frequency) that stands for all rarer terms.
KEPT, RARE = 0.5, 1.0
#: Random sub-lexicons of each share, and the number of shares: 1/2, 1/4, and so on.
DRAWS, SHARES = 16, 10
#: Documents of a range in id order, on average, and the most ranges: beyond them ranges grow, whose rows stream through their tasks.
RANGE_DOCS, RANGES = 8192, 1 << 20
#: Distinct terms that a task holds before it hands their counts on.
HELD_TERMS = 300_000

_ENDS = re.compile(r"^\W+|\W+$")
# Odd multipliers of the draws, and one for the terms' own hashes.
_SEEDS = np.random.default_rng(20240115).integers(1, 2**63, DRAWS, dtype=np.uint64) * 2 + 1
_MIX = np.uint64(0x9E3779B97F4A7C15)
# Differing terms for which odds are held against the agreements: each step is 4 % wider.
_STEPS = np.unique(np.round(1.04 ** np.arange(0, 420)))
_STEPS = np.concatenate([[0.0], _STEPS])
_STAY = np.clip((1 - 0.5 ** np.arange(1, SHARES + 1))[None, :] ** _STEPS[:, None], 1e-300, 1.0)
_LOG_STAY, _LOG_GO = np.log(_STAY), np.log(np.maximum(1 - _STAY, 1e-300))


def term(chunk: str) -> str:
    """A chunk between blanks without signs at its ends; empty if it has signs only."""
    return chunk if chunk.isalnum() else _ENDS.sub("", chunk)


class Terms:
    """64-bit hashes of texts' distinct terms in lower case."""

    def __init__(self) -> None:
        self._memo: dict[str, int] = {}

    def hashes(self, text: str) -> set[int]:
        memo, found = self._memo, set(text.lower().split())
        if len(memo) > HELD_TERMS:
            memo.clear()
        for c in found.difference(memo):
            t = term(c)
            memo[c] = xxhash.xxh3_64_intdigest(t) if t else 0
        hashes = set(map(memo.__getitem__, found))
        hashes.discard(0)
        return hashes


def document_frequencies(texts: DataFrame, copies: float = COPIES) -> tuple[float, DataFrame]:
    """The number of texts (text), and term (its hash) and df, with frequent copies counted once.

    Each row of a text that has ``copies`` of all rows or more counts as one by its number of rows. Counted in each task before the
    shuffle; texts do not move, and which are frequent is told by their hashes.
    """
    rows = texts.select("text", F.xxhash64("text").alias("hash"))
    groups = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    total = rows.count()
    often = groups.filter((F.col("n") > 1) & (F.col("n") >= copies * total)).collect()  # at most 1 / copies
    known = np.sort(np.array([r.hash for r in often], np.int64))
    times = {r.hash: r.n for r in often}
    weights = np.array([1 / times[h] for h in known.tolist()])
    n = total - sum(times.values()) + len(times)
    shared = texts.sparkSession.sparkContext.broadcast((known, weights))

    def emit(held: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        arrays = [pa.array(held.view(np.int64)), pa.array(sums)]
        return pa.RecordBatch.from_arrays(arrays, ["term", "df"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights = shared.value
        maker, parts, size = Terms(), [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            every = np.concatenate([p for p, _ in parts])
            each = np.repeat([w for _, w in parts], [len(p) for p, _ in parts])
            held, place = np.unique(every, return_inverse=True)
            return held, np.bincount(place, each, len(held))

        for batch in batches:
            own = batch.column("hash").to_numpy()
            weight = np.ones(len(own))
            if len(known):
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                weight = np.where(known[at] == own, weights[at], 1.0)
            for text, w in zip(batch.column("text").to_pylist(), weight.tolist()):
                found = maker.hashes(text or "")
                parts.append((np.fromiter(found, np.uint64, len(found)), w))
                size += len(found)
            if size > 8 * HELD_TERMS:
                yield emit(*summed())
                parts, size = [], 0
        if size:
            yield emit(*summed())

    each = rows.mapInArrow(count, "term long, df double")
    # Rounded, for sums of shares depend on their order in the last digits.
    return float(n), each.groupBy("term").agg(F.round(F.sum("df"), 3).alias("df"))


def lexicon(texts: DataFrame, low: float = LOW, high: float = HIGH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit hashes of the terms in and above the band, and their distance from it."""
    n, found = document_frequencies(texts)
    rows = found.filter(F.col("df") >= low * n).collect()  # bounded by ``low``
    known = np.array([r.term for r in rows], np.int64).view(np.uint64)
    shares = np.array([r.df for r in rows], float) / max(1.0, n)
    away = np.log(np.maximum(shares / high, 1.0))
    order = np.argsort(known)
    return known[order], away[order]


def sublexicons(hashes: np.ndarray) -> np.ndarray:
    """For each term (rows) and draw (columns) in how many sub-lexicons it is: those of the largest shares."""
    draw = (hashes[:, None] * _SEEDS[None, :]) ^ (hashes[:, None] >> np.uint64(29))
    draw = (draw * _MIX) >> np.uint64(11)
    # 53 bits: each leading zero is one more share.
    return np.minimum(53 - np.frexp(draw.astype(float))[1], SHARES)


class Fingerprinter:
    """Fingerprints of texts by one lexicon."""

    def __init__(self, known: np.ndarray, away: np.ndarray):
        self.known, self.away = known, away
        self._terms = Terms()

    def kept(self, text: str) -> np.ndarray:
        """Sorted hashes of the terms that count: those in the band, and at least the share ``KEPT`` of
        all terms, the nearest to the band first, equal ones by hash."""
        found = self._terms.hashes(text)
        hashes = np.sort(np.fromiter(found, np.uint64, len(found)))
        away = np.full(len(hashes), RARE)
        if len(self.known):
            at = np.searchsorted(self.known, hashes)
            at[at == len(self.known)] = 0
            away = np.where(self.known[at] == hashes, self.away[at], RARE)
        inside, least = int((away == 0).sum()), int(np.ceil(KEPT * len(hashes)))
        if inside >= least:
            return hashes[away == 0]
        return np.sort(hashes[np.argsort(away, kind="stable")[:least]])

    def signatures(self, text: str) -> tuple[int, np.ndarray]:
        """The number of kept terms and one signature per share and draw; 0 where no term is kept."""
        hashes = self.kept(text)
        value = (hashes ^ (hashes >> np.uint64(32))) * _MIX
        value = ((value ^ (value >> np.uint64(29))) >> np.uint64(24)).astype(float)
        # The sum over the sorted distinct terms stands for the hash of their sequence. Terms are added at
        # the smallest share that has them, and carried on to the larger ones.
        place = sublexicons(hashes) * DRAWS + np.arange(DRAWS)
        total = np.bincount(place.ravel(), np.repeat(value, DRAWS), (SHARES + 1) * DRAWS)
        out = np.cumsum(total.reshape(SHARES + 1, DRAWS)[:0:-1], axis=0)[::-1].astype(np.uint64)
        out ^= out >> np.uint64(31)
        return len(hashes), (out * _MIX) >> np.uint64(32)


def text_of(size: int, signatures: np.ndarray) -> str:
    rows = [row.tobytes().hex() for row in signatures.astype(">u4")]
    return f"{size}:" + ":".join(rows)


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """Kept terms in common over all kept terms, as estimated from the signatures that agree.

    1 if all agree, as for two texts without terms. The number of differing terms is the one that
    makes the agreements at all shares likeliest; it is at least the difference of the numbers of terms.
    """
    agree = (a[1] == b[1]).sum(axis=1)
    both = a[0] + b[0]
    if a[0] == b[0] and agree.sum() == SHARES * DRAWS:
        return 1.0
    odds = _LOG_STAY @ agree + _LOG_GO @ (DRAWS - agree)
    low, high = np.searchsorted(_STEPS, [max(1, abs(a[0] - b[0])), both])
    best = low + int(np.argmax(odds[low:high])) if low < high else high
    # The largest step stands for all terms.
    differ = float(both) if best >= high - 1 else float(_STEPS[best])
    return max(0.0, (both - differ) / (both + differ))


#: Stands for a null id in the order: below all others.
_NULL_ID = -(2**63)


def in_ranges(rows: DataFrame, range_docs: int = RANGE_DOCS, ranges: int = RANGES) -> DataFrame:
    """Deal rows (doc_id, text) into ranges of falling ids, each with the first row of the next.

    Gives doc_id, range, edge and the text's compressed bytes, ``packed``; sorted within a range, the row behind every row is the next one, because
    the first row of the following range (of the first range, for the last) is there once more as
    edge. Texts are shuffled once; only bounds and edges, one per range, pass the driver.
    """
    order = F.coalesce(F.col("doc_id"), F.lit(_NULL_ID))
    ids = rows.select(order.alias("id"))
    n = ids.count()
    count = min(ranges, -(-n // range_docs))
    bounds: list[int] = []
    if count > 1:
        shares = [i / count for i in range(1, count)]
        accuracy = F.lit(max(10_000, 10 * count))
        found = ids.agg(F.percentile_approx("id", shares, accuracy)).first()[0]
        bounds = sorted(set(found))
    spread = np.array(bounds, np.int64)

    def place(values):
        return np.searchsorted(spread, values, side="left")

    @F.pandas_udf("int")
    def range_of(v: pd.Series) -> pd.Series:
        return pd.Series(place(v.to_numpy(np.int64)), dtype="int32")

    first = {r[0]: r[1] for r in ids.groupBy(range_of("id")).agg(F.max("id")).collect()}
    used = sorted(first)
    # The first row of a range follows the last row of the range above.
    follows = {first[r]: used[(i + 1) % len(used)] for i, r in enumerate(used)}

    @F.pandas_udf("array<int>")
    def ranges_of(v: pd.Series) -> pd.Series:
        own = place(v.to_numpy(np.int64)).tolist()
        out = [[r, follows[k]] if k in follows else [r] for k, r in zip(v.tolist(), own)]
        return pd.Series(out, dtype=object)

    tie = F.xxhash64("text").alias("tie")
    dealt = rows.select("doc_id", "text", tie, F.posexplode(ranges_of(order)).alias("edge", "range"))
    dealt = packed(dealt)
    return dealt.repartition("range").sortWithinPartitions(
        "range", "edge", F.desc_nulls_last("doc_id"), "tie"
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **band):
    """Fingerprints of every text and of its edited text, with likenesses.

    The edited text has its last third (in code points, rounded down) replaced by as many of the first
    of the next document in order of falling ids; the first follows the last. Null ids come
    last, equal ids are ordered by their text's hash. A null text counts as empty; a text
    without terms has the empty fingerprint, which is like nothing but itself. Repeated rows
    are kept; an empty table gives no rows; other input columns are ignored.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    shared = docs.sparkSession.sparkContext.broadcast(lexicon(rows, **band))
    names = [f.split()[0] for f in RESULT.split(", ")]
    types = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprinter(*shared.value)
        held = None  # the last row: range, edge, id, text, signatures
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("range", "edge", "doc_id"))
            for place, edge, key, text in zip(*columns, unpacked(batch.column("packed"))):
                now = (place, edge, key, text, maker.signatures(text))
                if held is not None and held[0] == place and not held[1]:
                    _, _, key, text, own = held
                    n = len(text)
                    edited = text[: n - n // 3] + now[3][: n // 3]
                    other = maker.signatures(edited)
                    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    near = likeness(own, other), likeness(own, now[4])
                    out.append((key, n, digest, text_of(*own), text_of(*other), *near))
                held = now
            columns = list(zip(*out)) or [[]] * len(names)
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return in_ranges(rows).mapInArrow(run, RESULT)


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)
