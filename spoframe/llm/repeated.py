"""Which values of many blocks occur more than once, through compressed exchanges.

A block sends its sorted distinct values once, a row for each bucket of values
that it has some of, as compressed differences; a bucket's rows meet in one
task, are counted, and each block gets back which of its values occur again,
and how often.  A value has one place a block however often it occurs there, so
a frequent value is no hot key, and the values themselves are named by
``VALUE_BITS`` bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoframe.llm.packed import pack_numbers, unpack_numbers

VALUE_BITS = 40
#: Values that a task counts at a time, on average.
BUCKET_VALUES = 1_000_000

SENT = "block long, bucket long, columns binary, counts binary"
FOUND = "array<struct<bucket: bigint, shared: binary, df: binary>>"


def bucket_count(values: int) -> int:
    """Buckets for so many values in all."""
    return max(64, -(-values // BUCKET_VALUES))


def _cuts(values: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket of sorted values begins (and the last one ends)."""
    return np.searchsorted(values * buckets >> VALUE_BITS, np.arange(buckets + 1))


def sent_rows(block: int, values: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """The rows of :data:`SENT` of a block with these sorted distinct values."""
    cuts = _cuts(values, buckets).tolist()
    used = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
    parts = [slice(cuts[b], cuts[b + 1]) for b in used]
    columns = [
        pa.array([block] * len(used), pa.int64()),
        pa.array(used, pa.int64()),
        pa.array([pack_numbers(np.diff(values[c], prepend=0)) for c in parts], pa.binary()),
        pa.array([pack_numbers(counts[c]) for c in parts], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["block", "bucket", "columns", "counts"])


def occurrences(values: np.ndarray, found: list[dict], buckets: int) -> np.ndarray:
    """How often each of a block's values occurs in all blocks, from what came back."""
    cuts, df = _cuts(values, buckets), np.ones(len(values), np.int64)
    for f in found:
        df[cuts[f["bucket"]] + np.cumsum(unpack_numbers(f["shared"]))] = unpack_numbers(f["df"])
    return df


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    last = None

    def done() -> pa.RecordBatch:
        _, at = np.unique(np.concatenate([c for _, c, _ in held]), return_inverse=True)
        df = np.bincount(at, weights=np.concatenate([n for _, _, n in held])).astype(np.int64)[at]
        found = []
        for part in np.split(df, np.cumsum([len(c) for _, c, _ in held])[:-1]):
            shared = np.flatnonzero(part > 1)
            found.append((pack_numbers(np.diff(shared, prepend=0)), pack_numbers(part[shared])))
        columns = [pa.array([b for b, _, _ in held], pa.int64()), pa.array([last] * len(held), pa.int64())]
        columns += [pa.array([f[i] for f in found], pa.binary()) for i in (0, 1)]
        return pa.RecordBatch.from_arrays(columns, ["block", "bucket", "shared", "df"])

    for batch in batches:
        for block, bucket, values, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and bucket != last:
                yield done()
                held = []
            last = bucket
            held.append((block, np.cumsum(unpack_numbers(values)), unpack_numbers(counts)))
    if held:
        yield done()


def repeated_values(sent: DataFrame) -> DataFrame:
    """``(block, found)``: for each block the rows of :data:`FOUND`, of its values that occur more than once."""
    dealt = sent.repartition("bucket").sortWithinPartitions("bucket")
    back = dealt.mapInArrow(_count, "block long, bucket long, shared binary, df binary")
    return back.groupBy("block").agg(F.collect_list(F.struct("bucket", "shared", "df")).alias("found"))


def with_found(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """Blocks with what came back to each (none: an empty list)."""
    none = F.array().cast(FOUND)
    return blocks.join(found, "block", "left").withColumn("found", F.coalesce("found", none))
