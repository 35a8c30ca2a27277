"""Packing token sequences into windows by multiway differencing.

Documents are tokenized, ended with an id, and cut: whole windows first, the
rest into pieces of ``max_piece`` at most.  Pieces gather until they fill
``batch`` windows but for a small reserve; the last piece is cut there and the
remainder goes on to the next batch.  Karmarkar-Karp differencing then deals a
batch to windows: every piece starts as a partition with one full and many
empty places, and the two partitions with the largest imbalance merge, the
fullest places of one with the emptiest of the other, until one is left.  If a
window exceeds the capacity, the batch is dealt anew to one window more.

Work is local to a Spark partition (no shuffle, so no key can be hot) and
holds one batch of pieces and one document at a time.  Sequence numbers are
``partition * 2**32 + running number``, so a task that runs again gives the
same rows.

Defined results: a NULL text counts as empty (one piece: the end id alone);
NULL and repeated ids are packed as rows of their own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoframe.llm.common import quoted
from spoframe.llm.tokens import slices, tokenizer

SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
    "sequence_length long"
)


def difference(sizes: list[int], ways: int) -> np.ndarray:
    """Deal ``sizes`` to ``ways`` windows of near-equal sums; returns the window of each."""
    n = len(sizes)
    if ways == 1 or not n:
        return np.zeros(n, np.int64)
    # A partition: sums in falling order, and for each place a tree of pieces (-1: none).
    # Trees: 0..n-1 are pieces, later numbers join two trees.
    left, right = [-1] * n, [-1] * n
    heap = [(-size, i, np.array([size]), np.array([i])) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        _, _, sums_a, trees_a = heapq.heappop(heap)
        _, _, sums_b, trees_b = heapq.heappop(heap)
        if len(sums_a) + len(sums_b) <= ways:  # empty places take the other's full ones
            sums, trees = np.concatenate([sums_a, sums_b]), np.concatenate([trees_a, trees_b])
        else:
            sums, trees = np.zeros(ways, np.int64), np.full(ways, -1)
            sums[: len(sums_a)], trees[: len(trees_a)] = sums_a, trees_a
            at = np.arange(ways - 1, ways - 1 - len(sums_b), -1)
            both = trees[at] >= 0
            joined = np.where(both, 0, trees_b)
            first = len(left)
            joined[both] = np.arange(first, first + both.sum())
            left.extend(trees[at][both].tolist())
            right.extend(trees_b[both].tolist())
            sums[at] += sums_b
            trees[at] = joined
        order = np.argsort(-sums, kind="stable")
        sums, trees = sums[order], trees[order]
        lowest = int(sums[-1]) if len(sums) == ways else 0
        heapq.heappush(heap, (lowest - int(sums[0]), serial, sums, trees))
        serial += 1
    window = np.zeros(n, np.int64)
    for place, tree in enumerate(heap[0][3].tolist()):
        stack = [tree] if tree >= 0 else []
        while stack:
            t = stack.pop()
            if t < n:
                window[t] = place
            else:
                stack += (left[t], right[t])
    return window


def deal(sizes: list[int], capacity: int) -> np.ndarray:
    """:func:`difference` with the fewest windows, from the lower bound up, that all fit."""
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        window = difference(sizes, ways)
        if not sizes or np.bincount(window, weights=sizes).max() <= capacity:
            return window
        ways += 1


class _Packer:
    """Pieces of one Spark partition."""

    def __init__(self, partition: int, capacity: int, max_piece: int, batch: int, reserve: int):
        self.next_sequence = partition << 32
        self.capacity, self.max_piece = capacity, max_piece
        self.full = batch * capacity - reserve
        self.pieces: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
        self.size = 0
        self.rows: list[tuple] = []

    def _put(self, window: list[tuple]) -> None:
        length, offset = sum(len(p[2]) for p in window) // 4, 0
        for doc_id, start, ids, doc_tokens in window:
            self.rows.append((doc_id, start, len(ids) // 4, ids, doc_tokens, self.next_sequence, offset, length))
            offset += len(ids) // 4
        self.next_sequence += 1

    def flush(self) -> None:
        windows: dict[int, list[tuple]] = {}
        for piece, at in zip(self.pieces, deal([len(p[2]) // 4 for p in self.pieces], self.capacity), strict=True):
            windows.setdefault(int(at), []).append(piece)
        for at in sorted(windows):
            self._put(windows[at])
        self.pieces, self.size = [], 0

    def add(self, doc_id, ids: bytes) -> None:
        n, start = len(ids) // 4, 0
        while n - start >= self.capacity:
            self._put([(doc_id, start, ids[4 * start : 4 * (start + self.capacity)], n)])
            start += self.capacity
        parts = -(-(n - start) // self.max_piece)
        for k in range(parts):
            end = start + -(-(n - start) // (parts - k))
            while start < end:
                cut = min(end, start + self.full - self.size)
                self.pieces.append((doc_id, start, ids[4 * start : 4 * cut], n))
                self.size += cut - start
                start = cut
                if self.size >= self.full:
                    self.flush()

    def taken(self) -> pa.RecordBatch:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.binary() if n == "ids" else pa.int64() for n in names]
        columns = list(zip(*self.rows, strict=True)) if self.rows else [[] for _ in names]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 1,
    max_piece: int = 512,
    batch: int = 128,
    reserve: int = 192,
) -> DataFrame:
    """Rows of :data:`SCHEMA`, one a piece: ``ids`` are little-endian unsigned 32-bit."""
    if not 0 < max_piece <= capacity or reserve >= capacity:
        raise ValueError("max_piece must be within the capacity, the reserve below it")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(tokenizer_path)
        packer = _Packer(TaskContext.get().partitionId(), capacity, max_piece, batch, reserve)
        for rows in batches:
            for at in range(0, rows.num_rows, 2000):
                part = rows.slice(at, 2000)
                doc_ids, texts = part.column(0).to_pylist(), [x or "" for x in part.column(1).to_pylist()]
                for a, b in slices(texts):
                    for doc_id, ids in zip(doc_ids[a:b], encode.ids(texts[a:b]), strict=True):
                        packer.add(doc_id, ids + end)
                    if packer.rows:
                        yield packer.taken()
        packer.flush()
        yield packer.taken()

    whole = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    return whole.mapInArrow(run, SCHEMA)
