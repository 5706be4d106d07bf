"""Sorted arrays of 64-bit hashes: sent between tasks by hash range, kept as files in the folder that all
executors share, and mapped into memory by the workers that look something up."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs

from pyspark.sql import DataFrame

from .arrays import U64

#: Bytes of text whose counts make up a range.
RANGE_BYTES = 16 << 20
SENT = "bucket int, kind string, size long, blob binary"
#: Distinct hashes that a task gathers before it sends them on.
GATHERED = 1 << 20


def range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> U64(32)) * U64(ranges) >> U64(32)).astype(np.int64)


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as byte planes of their differences, and counts, compressed."""
    step = np.diff(keys, prepend=U64(0)).view(np.uint8).reshape(-1, 8).T
    count = counts.astype(np.uint32).view(np.uint8).reshape(-1, 4).T
    return pa.compress(np.concatenate([step, count]).tobytes(), codec="zstd", asbytes=True)


def _unpack(blob: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.decompress(blob, 12 * size, codec="zstd", asbytes=True), np.uint8).reshape(12, size)
    keys = np.cumsum(np.ascontiguousarray(planes[:8].T).view(np.uint64).ravel(), dtype=np.uint64)
    return keys, np.ascontiguousarray(planes[8:].T).view(np.uint32).ravel().astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts (1 each, if None)."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    total = np.diff(np.append(first, len(keys))) if counts is None else np.add.reduceat(counts, first) if len(first) else np.zeros(0, np.int64)
    return keys[first], total


def merged(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    parts = [_unpack(blob, size) for blob, size in zip(rows["blob"], rows["size"], strict=True)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def send(kind: str, keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray) -> Iterator[tuple]:
    """One row for each bucket that has keys."""
    if not len(keys):
        return
    order = np.argsort(bucket, kind="stable")
    keys, counts, bucket = keys[order], counts[order], bucket[order]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    for a, b in zip(cut, [*cut[1:], len(bucket)], strict=True):
        yield int(bucket[a]), kind, int(b - a), _pack(keys[a:b], counts[a:b])


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()),
                                       pa.array(columns[3], pa.binary())], names=["bucket", "kind", "size", "blob"])


def open_store(place: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(place) if "://" in place else (pyarrow.fs.LocalFileSystem(), place)


def write(folder: str, name: str, values: np.ndarray) -> None:
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)
    own = f"{path}/.{name}-{os.getpid()}-{np.random.default_rng().integers(1 << 62)}"
    with store.open_output_stream(own) as out:
        np.lib.format.write_array(out, values)
    store.move(own, f"{path}/{name}.npy")


_OPEN: dict[str, np.ndarray] = {}


def mapped(folder: str, name: str) -> np.ndarray:
    """An array mapped into memory. From a store that is no file system it is first copied to the worker's disk."""
    key = f"{folder}/{name}"
    if key not in _OPEN:
        store, path = open_store(folder)
        path = f"{path}/{name}.npy"
        if not isinstance(store, pyarrow.fs.LocalFileSystem):
            own = tempfile.NamedTemporaryFile(suffix=".npy")
            with store.open_input_stream(path) as src:
                own.write(src.read())
            own.flush()
            path, _OPEN[f"{key} file"] = own.name, own
        _OPEN[key] = np.load(path, mmap_mode="r")
    return _OPEN[key]


class HashArrays:
    """Sorted arrays of hashes by range, with values, under names in one folder."""

    def __init__(self, folder: str, ranges: int):
        self.folder, self.ranges = folder, ranges
        self.filled: dict[str, frozenset] = {}  # ranges that hold anything, by name

    def by_range(self, name: str, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each filled range of the array and the places of the hashes that fall into it."""
        order = np.argsort(hashes, kind="stable")
        cut = np.searchsorted(range_of(hashes[order], self.ranges), np.arange(self.ranges + 1))
        for b in self.filled.get(name, ()):
            if cut[b] < cut[b + 1]:
                yield b, order[cut[b] : cut[b + 1]]

    def look(self, name: str, hashes: np.ndarray, value: str | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are in the array, and the values of those."""
        hit, where, values = np.zeros(len(hashes), bool), [], []
        for b, at in self.by_range(name, hashes):
            have = mapped(self.folder, f"{name}-{b}")
            place = np.minimum(np.searchsorted(have, hashes[at]), len(have) - 1)
            ok = have[place] == hashes[at]
            where.append(at[ok])
            if value:
                values.append(mapped(self.folder, f"{value}-{b}")[place[ok]])
        if not where:
            return hit, np.zeros(0, np.int64)
        at = np.concatenate(where)
        hit[at] = True
        return hit, np.concatenate(values)[np.argsort(at)] if value else np.zeros(0, np.int64)

    def keep(self, name: str, rows: DataFrame, of, least: int = 2) -> int:
        """Write the hashes that of(batch) yields for the rows and that occur `least` times or more, with their
        counts as `<name>_count`. Returns the largest count."""
        folder, ranges = self.folder, self.ranges

        def joined(held: list) -> pa.RecordBatch:
            keys, counts = summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            return batch_of(list(send(name, keys, counts, range_of(keys, ranges))))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, total = [], 0
            for batch in batches:
                for keys in of(batch):
                    held.append(summed(keys))
                    total += len(held[-1][0])
                    if total > GATHERED:
                        yield joined(held)
                        held, total = [], 0
            if total:
                yield joined(held)

        def write_range(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
            keys, counts = merged(parts)
            often = counts >= least
            if often.any():
                write(folder, f"{name}-{key[0]}", keys[often])
                write(folder, f"{name}_count-{key[0]}", counts[often])
            return pd.DataFrame({"bucket": [key[0]], "size": [int(often.sum())], "most": [int(counts.max())]})

        got = rows.mapInArrow(count, SENT).groupBy("bucket").applyInPandas(
            write_range, "bucket int, size long, most long").collect()  # a row for each range
        self.filled[name] = frozenset(r["bucket"] for r in got if r["size"])
        return max((r["most"] for r in got), default=0)
