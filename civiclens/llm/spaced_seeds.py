"""Benchmark decontamination by spaced-seed hashing.

Texts are words [^\\x20\\x09-\\x0D]+ with A-Z lowered. A document overlaps an item when somewhere a
window of WINDOW words of the item stands in the document with at most MISSES words substituted
(12 and 2: a similarity over 0.8). Items of fewer than WINDOW words must occur whole, without
substitutions; items of fewer than LEAST words are not searched.

Each mask reads some positions of a stretch of up to nine words and ignores the others; MASKS are chosen so that
every window with up to two substitutions leaves at least one mask untouched at some offset (a test
proves it by enumeration), so the seeds lose no overlap. A seed that occurs in both texts gives an
alignment; the overlap is then counted word by word along that alignment.

The test items are read in blocks whose seeds and words fit BLOCK_BYTES (measured before they are
sent to the workers); all documents are scanned once per block, so a benchmark of any size works.

Defined results. Null or empty texts overlap with nothing, on both sides. Repeated items each report
their own pairs; repeated documents (same id) give one row a pair, with the largest figures.
Empty tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrays import U64, flat_bytes, mix, pieces, repeat_ranges, word_hashes

WINDOW, MISSES, LEAST = 12, 2, 5
#: Positions that each mask reads.
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 2, 4, 6, 7), (0, 2, 3, 6, 7, 8))
BLOCK_BYTES = 32 << 20
#: Seed hits, or words along alignments, that are looked at together.
SLICE = 1 << 20
_NONE = {k: np.zeros(0, np.int64) for k in ("row", "item", "windows", "best", "first")}


def _seeds(h: np.ndarray, offsets: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the mask at each word where the whole mask lies in one row, and those words."""
    span = mask[-1] + 1
    n = len(h) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.full(n, U64(len(mask)))
    with np.errstate(over="ignore"):
        for k in mask:
            out = (out + h[k : k + n]) * U64(0xD6E8FEB86659FD93)
            out ^= out >> U64(32)
        out = mix(out + U64(sum(1 << k for k in mask)))
    left = np.repeat(offsets[1:], np.diff(offsets))[:n] - np.arange(n)
    ok = np.flatnonzero(left >= span)
    return out[ok], ok


class Items:
    """Seeds and words of a block of test items."""

    def __init__(self, ids: list[int], texts: list[str]):
        data, offsets = flat_bytes(pa.array(texts, pa.large_string()))
        self.words, self.offsets = word_hashes(data, offsets)
        self.ids = np.array(ids, np.int64)
        size = np.diff(self.offsets)
        self.row = np.repeat(np.arange(len(ids)), size)
        self.masks = []
        for mask in [*MASKS, *(tuple(range(n)) for n in sorted({int(n) for n in size if LEAST <= n < WINDOW}))]:
            seeds, at = _seeds(self.words, self.offsets, mask)
            n = size[self.row[at]] if len(at) else np.zeros(0, np.int64)
            use = n >= WINDOW if mask in MASKS else n == len(mask)
            seeds, at = seeds[use], at[use]
            order = np.argsort(seeds, kind="stable")
            seeds, at = seeds[order], at[order]
            flags = np.zeros(1 << 20, dtype=bool)
            flags[seeds >> U64(44)] = True
            self.masks.append((mask, seeds, at, flags))

    def bytes(self) -> int:
        return self.words.nbytes * 3 + sum(s.nbytes * 2 + (1 << 20) for _, s, _, _ in self.masks)


def _slices(count: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of about `most` by the sum of count, of one entry at least."""
    ends, a = np.cumsum(count), 0
    while a < len(count):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield slice(a, b)
        a = b


def overlaps(h: np.ndarray, offsets: np.ndarray, items: Items) -> dict[str, np.ndarray]:
    """Pairs (row, item) that overlap: number of windows (by place in both), largest number of equal words in
    one, first word. Seeds and alignments are taken in slices, so that texts that repeat themselves fill no memory."""
    found = []
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for mask, seeds, at, flags in items.masks:
        if not len(seeds):
            continue
        mine, where = _seeds(h, offsets, mask)
        maybe = flags[mine >> U64(44)]
        mine, where = mine[maybe], where[maybe]
        lo, hi = np.searchsorted(seeds, mine, "left"), np.searchsorted(seeds, mine, "right")
        for part in _slices(hi - lo, SLICE):
            ref = at[repeat_ranges(lo[part], (hi - lo)[part])]
            pos = np.repeat(where[part], (hi - lo)[part])
            # the alignment: where the first word of the item would stand
            one = np.stack([rows[pos], items.row[ref], pos - ref + items.offsets[items.row[ref]]])
            found.append(np.unique(one, axis=1) if one.shape[1] else one)
    if not found or not sum(f.shape[1] for f in found):
        return _NONE
    row, item, start = np.unique(np.concatenate(found, axis=1), axis=1)
    size = np.diff(items.offsets)[item]
    parts = [_counted(h, offsets, items, row[p], item[p], start[p], size[p]) for p in _slices(size, SLICE)]
    pair, equal, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not len(pair):
        return _NONE
    keys, inverse, counts = np.unique(pair, return_inverse=True, return_counts=True)
    best, first = np.zeros(len(keys), np.int64), np.full(len(keys), np.iinfo(np.int64).max)
    np.maximum.at(best, inverse, equal)
    np.minimum.at(first, inverse, doc)
    r = keys // len(items.ids)
    return {"row": r, "item": keys % len(items.ids), "windows": counts, "best": best, "first": first - offsets[r]}


def _counted(h: np.ndarray, offsets: np.ndarray, items: Items, row: np.ndarray, item: np.ndarray, start: np.ndarray,
             size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pair, equal words and first word of all windows along the alignments that reach the overlap."""
    # equal words along each alignment, outside of the document nothing is equal
    which = np.repeat(np.arange(len(row)), size)
    inside = repeat_ranges(np.zeros(len(row), np.int64), size)
    doc = start[which] + inside
    ok = (doc >= offsets[row[which]]) & (doc < offsets[row[which] + 1])
    same = np.zeros(len(doc), np.int64)
    same[ok] = h[doc[ok]] == items.words[(items.offsets[item[which]] + inside)[ok]]
    sums = np.concatenate([[0], np.cumsum(same)])
    base = np.cumsum(size) - size
    width = np.minimum(size, WINDOW)[which]
    whole = inside + width <= size[which]
    here = (base[which] + inside)[whole]
    width, which, doc = width[whole], which[whole], doc[whole]
    equal = sums[here + width] - sums[here]
    # the whole window must lie in the document; short items tolerate nothing
    need = np.where(width < WINDOW, width, WINDOW - MISSES)
    hit = (equal >= need) & (doc >= offsets[row[which]]) & (doc + width <= offsets[row[which] + 1])
    return (row * len(items.ids) + item)[which[hit]], equal[hit], doc[hit]


def blocks(benchmark: DataFrame, item_id: str, text: str, most: int = BLOCK_BYTES) -> Iterator[Items]:
    """The test items in blocks: their number follows from the measured size of all texts."""
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t") * 16 + 64), F.lit(0))).first()[0]  # bytes of words and seeds
    n = -(-total // most)
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect() if n > 1 else rows.collect()
        if part:
            yield Items([-1 if r["i"] is None else r["i"] for r in part], [r["t"] for r in part])


def find(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
         item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and item that overlap: doc_id, item_id, n_windows, best (equal words of the
    best window), first_word (of the document, from 0)."""
    spark = docs.sparkSession
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, item_id long, n_windows long, best long, first_word long"
    out = None
    for items in blocks(benchmark, item_id, item_text, block_bytes):
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces(batch, "text"):
                    h, offsets = word_hashes(*flat_bytes(part.column("text")))
                    got = overlaps(h, offsets, sent.value)
                    if len(got["row"]):
                        yield pa.RecordBatch.from_arrays(
                            [part.column("doc_id").take(pa.array(got["row"])), pa.array(sent.value.ids[got["item"]]),
                             pa.array(got["windows"]), pa.array(got["best"]), pa.array(got["first"])],
                            names=["doc_id", "item_id", "n_windows", "best", "first_word"])

        hits = rows.mapInArrow(run, schema)
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return spark.createDataFrame([], schema)
    return out.groupBy("doc_id", "item_id").agg(
        F.max("n_windows").alias("n_windows"), F.max("best").alias("best"), F.min("first_word").alias("first_word"))


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", by_row: bool = False, **kw) -> DataFrame:
    """Documents that overlap with no item, all columns kept. By id: all rows of an id go with one that overlaps, and
    rows with a null id are kept. With by_row exactly the rows go whose own text overlaps."""
    if by_row:
        key = F.when(F.col(text).isNotNull(), F.xxhash64(text))
        bad = find(docs.select(key.alias("key"), F.col(text).alias("text")), benchmark, "key", **kw).select(F.col("doc_id").alias("_bad")).distinct()
        return docs.withColumn("_key", key).join(bad, F.col("_key") == F.col("_bad"), "left_anti").select(*docs.columns)
    bad = find(docs, benchmark, doc_id, text, **kw).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs[doc_id] == F.col("_bad"), "left_anti")
