"""Pack token sequences into windows by Karmarkar-Karp multiway differencing.

A document's tokens are cut into full windows and a rest, the rest again into pieces of at most
``max_piece``. Which cuts are made depends on the document alone, so texts are encoded once
and only the pieces' sizes take part in the packing. Pieces are dealt into batches of a bounded
size; in each, differencing starts with one partition per piece (that piece against empty
windows) and merges the two partitions with the largest imbalance, largest windows
of one against smallest of the other, until one is left. Its windows are near equal. If the largest
exceeds the capacity, the number of windows rises and the differencing is done again.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseline.llm.common import stored
from pulseline.llm.tokens import encoder

CAPACITY = 4096
#: Longest piece that shares a window with others.
MAX_PIECE = 1024
#: Windows that a batch fills, about.
BATCH_WINDOWS = 128

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cuts(total: int, capacity: int, max_piece: int) -> list[int]:
    """Starts of a document's pieces: full windows, then a rest in near-equal pieces."""
    full = total - total % capacity
    starts = list(range(0, full, capacity))
    if rest := total - full:
        parts = -(-rest // max_piece)
        starts += [full + rest * i // parts for i in range(parts)]
    return starts


def pieces(
    docs: DataFrame,
    tokenizer: str,
    end_id: int | None = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    max_piece: int = MAX_PIECE,
) -> DataFrame:
    """Cut every document's ids (with ``end_id`` behind): one row per piece, with its crc32."""
    last = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            rows = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for key, ids in zip(batch.column("doc_id").to_pylist(), enc.encode_batch(texts)):
                ids += last
                n = len(ids) // 4
                starts = cuts(n, capacity, max_piece)
                for a, b in zip(starts, [*starts[1:], n]):
                    rows.append((key, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), n))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    two = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    return two.mapInArrow(run, PIECES)


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0 to k - 1) of each size, by multiway differencing."""
    heap, members = [], {}
    for i, size in enumerate(sizes.tolist()):
        heap.append((-size, i, np.array([size], np.int64)))
        members[i] = [[i]]
    heapq.heapify(heap)
    # Windows are kept in falling order; windows that are not there are empty.
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        group, other = members.pop(a), members.pop(b)
        n = max(len(x), len(y), min(k, len(x) + len(y)))
        left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        left[: len(x)] = x
        right[n - len(y) :] = y[::-1]
        sums = left + right
        group += [[] for _ in range(n - len(group))]
        for j, more in enumerate(other):
            group[n - 1 - j] = group[n - 1 - j] + more
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        members[a] = [group[j] for j in order.tolist()]
        low = int(sums[-1]) if n == k else 0
        heapq.heappush(heap, (low - int(sums[0]), a, sums))
    out = np.zeros(len(sizes), np.int64)
    for window, group in enumerate(members[heap[0][1]] if heap else []):
        out[group] = window
    return out


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each size, none above the capacity; the fewest that differencing reaches."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        windows = difference(sizes, k)
        most = int(np.bincount(windows, sizes).max(initial=0))
        if most <= capacity:
            return windows
        # Each further window lowers the mean by 1/k of itself; the overflow tells how many
        # are needed at least.
        k += max(1, int(k * (most - capacity) / capacity / 2))


SEQUENCES = f"{PIECES}, sequence_id long, offset long"


def sequences(found: DataFrame, capacity: int = CAPACITY, windows: int = BATCH_WINDOWS):
    """Give stored pieces their sequence and the place in it.

    Batches are dealt by row, not by key, so repeated rows do not gather in one.
    """
    total = found.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).scalar()
    count = F.greatest(F.lit(1), F.ceil(total / (capacity * windows)))
    dealt = found.withColumn("batch", F.pmod(F.xxhash64(F.monotonically_increasing_id()), count))

    def run(key: tuple[pa.Scalar, ...], batch: pa.Table) -> pa.Table:
        batch = batch.drop_columns("batch")
        batch = batch.sort_by([("doc_id", "ascending"), ("start", "ascending")])
        sizes = batch.column("length").to_numpy()
        window = np.zeros(len(sizes), np.int64)
        whole = sizes == capacity
        window[~whole] = pack(sizes[~whole], capacity)
        window[whole] = window[~whole].max(initial=-1) + 1 + np.arange(int(whole.sum()))
        order = np.argsort(window, kind="stable")
        ends = np.cumsum(sizes[order])
        first = np.r_[True, np.diff(window[order]) != 0]
        base = np.maximum.accumulate(np.where(first, ends - sizes[order], 0))
        offset = np.empty(len(sizes), np.int64)
        offset[order] = ends - sizes[order] - base
        sequence = pa.array(key[0].as_py() * (1 << 24) + window)
        return batch.append_column("sequence_id", sequence).append_column(
            "offset", pa.array(offset)
        )

    return dealt.groupBy("batch").applyInArrow(run, SEQUENCES)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int | None = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    max_piece: int = MAX_PIECE,
) -> DataFrame:
    """Pack all documents: one row per piece with its sequence and the offset there.

    A null text counts as empty: its only token is ``end_id``. Rows that repeat an id are packed
    as documents of their own; a null id stays null. Very long texts become full windows
    and a rest. An empty table gives no rows. Other input columns are ignored.
    """
    found = pieces(docs, tokenizer, end_id, id_col, text_col, capacity, max_piece)
    return sequences(stored(found, "pieces"), capacity)
