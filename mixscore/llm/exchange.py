"""Look up very many numeric keys in a sharded table, as packed arrays.

Documents are dealt into units by a hash of their id. A unit asks for its
distinct keys once, however often they occur in it, in one packed row for each
shard; a shard answers in the order asked. So a key that every document
holds is one entry for each unit, no shard is hot, and a row costs six
bytes a key instead of a row's overhead. Units and shards follow the number
of shuffle partitions, which a cluster sizes to its data, so both stay of one
size in memory.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as their first one and gaps of as few bytes as the largest needs."""
    if not len(keys):
        return b""
    gaps = np.diff(keys)
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    planes = np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + planes.tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, U64)
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    gaps = np.zeros((len(planes) + 1, 8), np.uint8)
    gaps[1:, :width] = planes
    out = gaps.view("<u8").reshape(-1).astype(U64)
    out[0] = np.frombuffer(data, "<u8", 1, 1)[0]
    return np.cumsum(out, dtype=U64)


def pack_numbers(numbers: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane: planes of zeros vanish when the shuffle compresses them."""
    size = numbers.dtype.itemsize
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, size).T).tobytes()


def unpack_numbers(data: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).reshape(-1)


def range_bounds(keys: np.ndarray, shards: int) -> list[int]:
    """Where each shard's range of 64-bit hashes begins in the sorted ``keys``, and the end."""
    edges = np.array([(i << 64) // shards for i in range(1, shards)], U64)
    return [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
