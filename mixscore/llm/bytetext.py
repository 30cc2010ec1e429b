"""Words and n-grams of Arrow text columns as numpy arrays of 64-bit hashes.

Everything works on the UTF-8 bytes of whole columns: the separators and the
letters A to Z are single bytes, so no text is decoded. Memory is a small
multiple of the slice given; `slices` cuts a batch by bytes, so one batch of
long documents stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_STEP = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (SplitMix64's finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed) * U64(1_000_003)) * U64(0x9E3779B97F4A7C15))


_BYTE = stream(1, 256)
_BASE = 0x9E3779B97F4A7C15 | 1
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, name: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces whose column ``name`` holds at most ``limit`` bytes, one row at least."""
    if not batch.num_rows:
        return
    _, offsets = utf8(batch.column(batch.schema.get_field_index(name)))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and where each row's words begin among them."""
    inside = ~_BLANK[data]
    first = inside.copy()
    last = inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        first[cuts] |= inside[cuts]
        last[cuts - 1] |= inside[cuts - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: a polynomial of random byte values, then mixed.

    Spans are disjoint and in order. Bytes are taken in steps of a megabyte,
    so that one endless word needs no more memory than many short ones.
    """
    out = np.zeros(len(starts), U64)
    if not len(starts):
        return out
    lengths = ends - starts
    base = np.concatenate([[0], np.cumsum(lengths)])
    powers = np.cumprod(np.full(int(min(lengths.max(), _STEP)), _BASE, U64))
    total = int(base[-1])
    for low in range(0, total, _STEP):
        high = min(total, low + _STEP)
        a = int(np.searchsorted(base, low, side="right")) - 1
        b = int(np.searchsorted(base, high, side="left"))
        begin = np.maximum(base[a:b], low)
        n = np.minimum(base[a + 1 : b + 1], high) - begin
        where = np.arange(low, high) + np.repeat(starts[a:b] - base[a:b], n)
        rank = np.arange(low, high) - np.repeat(base[a:b], n)
        if lengths[a:b].max() > _STEP:
            factor = _big_powers(rank)
        else:
            factor = powers[rank]
        out[a:b] += np.add.reduceat(_BYTE[data[where]] * factor, begin - low)
    return mix(out ^ mix(lengths.astype(U64)))


def _big_powers(rank: np.ndarray) -> np.ndarray:
    """Powers of the base for large exponents, by squaring; the same values as the table's."""
    out = np.ones(len(rank), U64)
    left, square = (rank + 1).astype(U64), U64(_BASE)
    with np.errstate(over="ignore"):
        while left.any():
            out = np.where(left & U64(1), out * square, out)
            left >>= U64(1)
            square = U64((int(square) * int(square)) & 0xFFFFFFFFFFFFFFFF)
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A to Z in lower case, and where each row's words begin."""
    low = lowered(data)
    starts, ends, begin = word_spans(low, offsets)
    return span_hashes(low, starts, ends), begin


def combine(hashes: list[np.ndarray]) -> np.ndarray:
    """One hash for each row of several columns of hashes, in order."""
    out = np.full(len(hashes[0]), 0x5851F42D4C957F2D, U64)
    for h in hashes:
        out = mix(out * U64(_BASE) + h)
    return out


def shingle_sets(hashes: np.ndarray, begin: np.ndarray, size: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its runs of ``size`` words.

    A row with fewer words has its whole sequence as one; a row without words has none.
    """
    grams = combine([hashes[i : len(hashes) - size + 1 + i] for i in range(size)]) if len(hashes) >= size else None
    out = []
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            out.append(combine([hashes[i : i + 1] for i in range(a, b)]))
        else:
            out.append(np.empty(0, U64))
    return out
