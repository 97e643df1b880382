"""Array code for whole batches of texts: byte views of Arrow strings, words, shingles and rolling hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = b" \t\n\x0b\x0c\r"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_rng = np.random.Generator(np.random.PCG64(20240601))
_TABLE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_POWERS = {int(_BASE): np.ones(1, np.uint64), pow(int(_BASE), -1, 2**64): np.ones(1, np.uint64)}
_INVERSE = pow(int(_BASE), -1, 2**64)
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a 64-bit value over the others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, base: int = int(_BASE)) -> np.ndarray:
    """The first n powers of a base, modulo 2**64."""
    if len(_POWERS[base]) < n:
        steps = np.full(1 << (n - 1).bit_length(), base, np.uint64)
        steps[0] = 1
        _POWERS[base] = np.multiply.accumulate(steps)
    return _POWERS[base][:n]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and each row's offset in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows with about size bytes each (a longer row stands alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h[i]: the polynomial hash of the first i bytes."""
    h = np.empty(len(data) + 1, np.uint64)
    h[0] = 0
    np.cumsum(_TABLE[data] * powers(len(data)), out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte spans; equal bytes give equal hashes wherever they stand."""
    return (h[end] - h[start]) * powers(len(h), _INVERSE)[start]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of bytes that are not white space (space, tab to carriage return)."""
    solid = ~_SPACE[data]
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | first[1:n]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | first[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word (A-Z lower-cased) and its row."""
    if lower:
        data = _LOWER[data]
    starts, ends, row = words(data, offsets)
    return mix(span_hash(prefix_hash(data), starts, ends)), row


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Each row's distinct k-word shingles as sorted hashes; a row of fewer words has one, without words none."""
    h, row = word_hashes(data, offsets)
    n = len(offsets) - 1
    count = np.bincount(row, minlength=n)
    m = len(h) - k + 1
    at = np.concatenate([[0], np.cumsum(count)])
    joined = np.zeros(max(m, 0), np.uint64)
    for j in range(k):
        joined = joined * _STEP + h[j : j + len(joined)]
    joined = mix(joined)
    out = []
    for i in range(n):
        a, c = at[i], count[i]
        if c >= k:
            s = np.sort(joined[a : a + c - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif c:
            x = np.uint64(c)
            for w in h[a : a + c]:
                x = x * _STEP + w
            out.append(mix(np.array([x], np.uint64) ^ np.uint64(0xA5A5A5A5)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def packed(rows: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)
