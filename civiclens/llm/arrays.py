"""Byte-level helpers shared by the operators of this subpackage: Arrow text columns as
flat byte arrays, and 64-bit hashes of all words of a batch in a few numpy passes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SEED = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_R = U64(0x9E3779B97F4A7C15 | 1)
_POW: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column, and the n + 1 offsets of its rows. Null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about `most` bytes of text, so that temporary arrays stay small."""
    if not batch.num_rows:
        return
    _, offsets = flat_bytes(batch.column(batch.schema.names.index(column)))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i mod 2**64 for i < n, grown by doubling."""
    if not _POW or len(_POW["up"]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = U64(pow(int(_R), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _POW["up"] = np.concatenate([[U64(1)], np.full(size - 1, _R)]).cumprod(dtype=np.uint64)
            _POW["down"] = np.concatenate([[U64(1)], np.full(size - 1, inverse)]).cumprod(dtype=np.uint64)
    return _POW["up"], _POW["down"]


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[starts[i]:ends[i]] for each i, by prefix sums of a polynomial hash."""
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words [^\\x20\\x09-\\x0D]+ in row order, and the n + 1 offsets of the rows' words."""
    solid = ~SPACE[data]
    before = np.empty_like(solid)
    before[1:] = solid[:-1]
    before[:1] = False
    first = offsets[:-1][offsets[:-1] < len(data)]
    before[first] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty_like(solid)
    after[:-1] = solid[1:]
    after[-1:] = False
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lowered) and the n + 1 offsets of the rows' words."""
    if lower:
        data = LOWER[data]
    starts, ends, rows = words(data, offsets)
    return range_hashes(data, starts, ends), rows


def repeat_ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Concatenation of start[i], ..., start[i] + count[i] - 1."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - count), count)


def gather(data: np.ndarray, start: np.ndarray, count: np.ndarray, most: int = 1 << 19) -> np.ndarray:
    """Concatenation of data[start[i] : start[i] + count[i]], with indices for about `most` entries at a time."""
    ends = np.cumsum(count)
    out, a = np.empty(int(ends[-1]) if len(ends) else 0, data.dtype), 0
    while a < len(count):
        base = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, base + most, side="right")))
        out[base : int(ends[b - 1])] = data[repeat_ranges(start[a:b], count[a:b])]
        a = b
    return out
