"""Sequences of small integers or words as compressed binary cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack_numbers(x: np.ndarray) -> bytes:
    """Non-negative integers, byte plane by byte plane, compressed (small ones leave empty planes)."""
    width = next(w for w in range(1, 9) if not len(x) or int(x.max()) < 1 << (8 * w))
    each = np.ascontiguousarray(x, x.dtype.newbyteorder("<")).view(np.uint8).reshape(len(x), x.itemsize)
    planes = np.ascontiguousarray(each[:, :width].T)
    return len(x).to_bytes(8, "little") + bytes([width]) + pa.compress(planes, "zstd", asbytes=True)


def unpack_numbers(data: bytes, kind: type = np.int64) -> np.ndarray:
    """The integers as 64-bit ones, or as a narrower ``kind`` that holds them."""
    n, width = int.from_bytes(data[:8], "little"), data[8]
    planes = np.frombuffer(pa.decompress(memoryview(data)[9:], n * width, "zstd"), np.uint8).reshape(width, n)
    out = np.zeros(n, np.dtype(kind).newbyteorder("<"))
    each = out.view(np.uint8).reshape(n, out.itemsize)
    for k in range(width):
        each[:, k] = planes[k]
    return out


def pack_words(words: list[bytes]) -> bytes:
    """Byte strings one after another, compressed (sorted ones well)."""
    lengths = pack_numbers(np.array([len(w) for w in words], np.int64))
    return len(lengths).to_bytes(8, "little") + lengths + pa.compress(b"".join(words), "zstd", asbytes=True)


def unpack_words(data: bytes) -> list[bytes]:
    at = 8 + int.from_bytes(data[:8], "little")
    ends = np.concatenate([[0], np.cumsum(unpack_numbers(data[8:at]))]).tolist()
    whole = pa.decompress(data[at:], ends[-1], "zstd", asbytes=True)
    return [whole[a:b] for a, b in zip(ends, ends[1:], strict=False)]
