"""Exact removal of repeated byte strings: threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte of a text goes when some string of `length` bytes covers it that also starts anywhere else, in
another document or the same one. Strings are judged on the input and never cross documents.

Finding the repeats. Every window of `length` bytes is dealt to the smallest of its anchors (hashes of
its substrings of length / 4 bytes; leftmost of equals). Equal windows have equal anchors at equal
places, so windows can only repeat within the bucket of their anchor. Consecutive windows with one
anchor make a run, and the run's bytes are a snippet. Buckets of an anchor range are then the text of a
Burrows-Wheeler transform (of distinct snippets, with how often they stand in the corpus):

  Starting with the empty string, intervals of suffixes with a common prefix are extended backward,
  breadth first. An extension to length v + 1 that ends where no common-prefix length is known yet sets
  it to v; only such extensions go on. So common prefixes are derived by increasing value, each once,
  and the expansion stops at `length`: suffixes whose neighbour's value is still open then repeat.

Copies of a snippet are counted before the transform, which takes one of them; a snippet alone in its
bucket has nothing else to share a prefix with, so its count decides.

Four passes read the documents: (1) anchors are counted, (2) windows of busy anchors are counted, (3)
snippets with repeated anchors are gathered without their copies, transformed and searched, (4) the
repeated windows of each document are looked up. Between the passes stand sorted hash arrays in the
folder that all executors share; the documents are never shuffled. An anchor with more than BUSY
occurrences (say a passage that a third of all documents holds) would fill one bucket with snippets that
differ outside of the passage. Its windows are counted one by one instead (pass 2), and those that occur
twice or more repeat; so no bucket exceeds BUSY snippets, whatever the input.

Anchors and windows are told apart by 64-bit hashes. Defined results. Null text: as an empty one, with
nothing removed. Texts shorter than `length` keep everything. Repeated rows are copies of each other,
whatever their ids. An empty table gives an empty result. Columns of the input are kept; those named
like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .arrays import U64, _BYTE, _powers, flat_bytes, gather, mix, pieces, range_hashes, repeat_ranges
from .hash_arrays import SENT, HashArrays, batch_of, mapped, range_of, write
from .shared import scratch

BUSY = 1000
RANGE = 4 << 20  # bytes of documents whose snippets are searched in one task
TEXT = 1 << 17  # bytes of snippets in one transform
HELD = 8 << 20  # bytes of distinct snippets that a task gathers before it sends them on


# -- one transform

def suffix_array(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order of all suffixes of text (symbols; 0 ends a snippet, at `ends`), each read up to its snippet's
    end; equal ones by position. Prefix doubling on the groups that are still tied."""
    n = len(text)
    left = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n)  # symbols before the end of the snippet
    wide = np.concatenate([text.astype(np.int64), np.zeros(7, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(7):
        key = key << 9 | np.where(left >= k, wide[k : k + n], 0)
    sa = np.argsort(key, kind="stable")
    first = np.concatenate([[True], key[sa][1:] != key[sa][:-1]])
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(first, np.arange(n), 0)) + 1
    h = 7
    tied = ~(first & np.append(first[1:], True))
    slots = np.flatnonzero(tied)
    while len(slots):
        items = sa[slots]
        more = left[items] >= h
        second = np.where(more, rank[np.minimum(items + h, n - 1)], 0)
        key = rank[items] * (n + 2) + second
        order = np.argsort(key, kind="stable")
        items, key, second = items[order], key[order], second[order]
        sa[slots] = items
        first = np.concatenate([[True], key[1:] != key[:-1]])
        rank[items] = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))] + 1
        # equal to the end of their snippets: tied for good
        tied = ~(first & np.append(first[1:], True)) & (second > 0)
        slots = slots[tied]
        h *= 2
    return sa


def repeated(snippets: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """For each byte of the joined snippets: whether the `length` bytes from there also start elsewhere in them."""
    m, ends = len(sizes), np.cumsum(sizes + 1) - 1
    text = np.zeros(len(snippets) + m, np.uint16)
    body = np.ones(len(text), bool)
    body[ends] = False
    text[body] = snippets.astype(np.uint16) + 1
    sa, n = suffix_array(text, ends), len(text)
    bwt = text[sa - 1]  # the symbol before the first suffix is the last end mark
    by_symbol = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int64)  # row of the suffix that is one symbol longer
    lf[by_symbol] = np.arange(n)
    following = np.full(n, n, np.int64)  # next row with the same symbol before it
    same = bwt[by_symbol][1:] == bwt[by_symbol][:-1]
    following[by_symbol[:-1][same]] = by_symbol[1:][same]
    places = bwt[by_symbol].astype(np.int64) * n + by_symbol

    known = np.zeros(n + 1, bool)  # known[i]: the common prefix of rows i - 1 and i has been derived
    known[0] = known[n] = True
    # length 0: end marks are symbols of their own, and each symbol has an interval
    starts = np.searchsorted(text[sa], np.arange(258))
    known[: m + 1] = True
    known[starts] = True
    lb = np.concatenate([np.arange(m), starts[1:-1]])
    rb = np.concatenate([np.arange(m), starts[2:] - 1])
    keep = lb <= rb
    lb, rb = lb[keep], rb[keep]
    for _ in range(1, length):  # extensions to strings one symbol longer
        if not len(lb):
            break
        width = rb - lb + 1
        row = repeat_ranges(lb, width)
        end = np.repeat(rb, width)
        last = np.flatnonzero((following[row] > end) & (bwt[row] != 0))  # last row of each symbol in the interval
        upper = lf[row[last]]
        open_ = np.flatnonzero(~known[upper + 1])
        # an end can be reached from one interval only: its strings are distinct
        last, upper = last[open_], upper[open_]
        known[upper + 1] = True
        # an interval of one row is extended to one row
        begin, lb = np.repeat(lb, width)[last], upper.copy()
        wide = np.flatnonzero(np.repeat(width, width)[last] > 1)
        lb[wide] = np.searchsorted(places, bwt[row[last[wide]]].astype(np.int64) * n + begin[wide])
        rb = upper
    # open values are `length` or more
    shared = ~known[:-1] | ~known[1:]
    out = np.zeros(n, bool)
    out[sa] = shared
    return out[body]


# -- runs of windows

def runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start of each run, and the hash of its anchor."""
    k = max(1, length // 4)
    n = len(data) - length + 1
    size = np.diff(offsets)
    none = np.zeros(0, np.int64)
    if n <= 0 or not (size >= length).any():
        return none, none, np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
        h = mix((sums[k:] - sums[:-k]) * down[: len(data) - k + 1])
    low = U64((1 << 32) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # smallest hash, then leftmost
    width, span = length - k + 1, 1
    while span * 2 <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    key = np.minimum(key[: len(key) - (width - span)], key[width - span :]) if width > span else key
    anchor = (key & low).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)[:n]
    ok = np.arange(n) + length <= offsets[1:][row]
    start = np.flatnonzero(ok)
    at = anchor[start]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)]))
    last = np.append(first[1:], len(start)) - 1
    return start[first], start[last], h[at[first]]


def _mask_bytes(length: int) -> int:
    return (length - max(1, length // 4) + 1 + 7) // 8


class _Known(HashArrays):
    """What the passes so far have found, as workers read it."""

    def __init__(self, folder: str, ranges: int, length: int, busy: int = BUSY):
        super().__init__(folder, ranges)
        self.length, self.busy = length, busy

    def windows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs whose anchor repeats (lo, hi, anchor), and which of them are busy."""
        lo, hi, anchor = runs(data, offsets, self.length)
        hit, counts = self.look("anchor", anchor, "anchor_count")
        return lo[hit], hi[hit], anchor[hit], counts > self.busy

    def snippets(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and last window of each snippet to compare and the anchor that names its bucket, and the
        windows of busy anchors that were counted more than once."""
        lo, hi, anchor, busy = self.windows(data, offsets)
        each = repeat_ranges(lo[busy], (hi - lo + 1)[busy])
        if len(each):
            each = each[self.look("window", range_hashes(data, each, each + self.length))[0]]
        return lo[~busy], hi[~busy], anchor[~busy], each


def _gather(batches: Iterator[pa.RecordBatch], known: _Known) -> Iterator[pa.RecordBatch]:
    """The task's distinct snippets by range, each with its bucket, size, hash and count."""
    ranges = known.ranges
    held: list[tuple] = []

    def send_on() -> pa.RecordBatch:
        bucket, name, size, data, counts = (np.concatenate([h[i] for h in held]) for i in range(5))
        begin = np.cumsum(size) - size
        _, first, inverse = np.unique(name, return_index=True, return_inverse=True)
        weight = np.bincount(inverse, weights=counts).astype(np.uint64)
        target = range_of(bucket[first], ranges)
        order = np.argsort(target, kind="stable")
        first, weight, target = first[order], weight[order], target[order]
        cut = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
        out = []
        for a, b in zip(cut, [*cut[1:], len(first)], strict=True):
            pick = first[a:b]
            head = np.stack([bucket[pick], name[pick], size[pick].astype(np.uint64), weight[a:b]])
            body = head.tobytes() + gather(data, begin[pick], size[pick]).tobytes()
            out.append((int(target[a]), f"{len(pick)}", len(body), pa.compress(body, codec="zstd", asbytes=True)))
        return batch_of(out)

    total = 0
    for batch in batches:
        for part in pieces(batch, "text"):
            data, offsets = flat_bytes(part.column("text"))
            lo, hi, bucket, _ = known.snippets(data, offsets)
            if not len(lo):
                continue
            size = hi - lo + known.length
            name = range_hashes(data, lo, lo + size)
            names, first, counts = np.unique(name, return_index=True, return_counts=True)
            held.append((bucket[first], names, size[first], gather(data, lo[first], size[first]), counts))
            total += len(held[-1][3])
            if total > HELD:
                yield send_on()
                held, total = [], 0
    if held:
        yield send_on()


def _search(key: tuple, parts: pd.DataFrame, known: _Known) -> pd.DataFrame:
    """Transform the snippets of a range, bucket by bucket in texts of about TEXT bytes, and write which
    windows of each snippet repeat."""
    width = _mask_bytes(known.length)
    heads, bodies, where = [], [], 0
    for n, size, blob in zip(parts["kind"].astype(int), parts["size"], parts["blob"], strict=True):
        raw = pa.decompress(blob, int(size), codec="zstd", asbytes=True)
        head = np.frombuffer(raw, np.uint64, 4 * n).reshape(4, n)
        begin = np.cumsum(head[2]).astype(np.int64) - head[2].astype(np.int64) + where
        heads.append(np.concatenate([head, begin[None].astype(np.uint64)]))
        bodies.append(np.frombuffer(raw, np.uint8, offset=32 * n))
        where += len(bodies[-1])
        del raw
    data, (bucket, name, size, weight, begin) = np.concatenate(bodies), np.concatenate(heads, axis=1)
    bodies.clear()
    # copies from several tasks: one stays, with all counts
    order = np.lexsort((name, bucket))
    first = np.flatnonzero(np.concatenate([[True], name[order][1:] != name[order][:-1]]))
    weight = np.add.reduceat(weight[order].astype(np.int64), first)
    bucket, name, size, begin = (x[order][first] for x in (bucket, name, size.astype(np.int64), begin.astype(np.int64)))
    order = np.argsort(name)
    write(known.folder, f"snippet-{key[0]}", name[order])
    masks = np.zeros((len(name), width), np.uint8)
    fresh = np.concatenate([[True], bucket[1:] != bucket[:-1]])
    # a snippet alone in its bucket has nothing to be compared with: its windows repeat if it does
    alone = np.flatnonzero(fresh & np.append(fresh[1:], True))
    masks[alone[weight[alone] > 1]] = _first_bits(size[alone[weight[alone] > 1]] - known.length + 1, width)
    rest = np.setdiff1d(np.arange(len(name)), alone)
    masks[rest] = _compared(data, bucket[rest], size[rest], begin[rest], weight[rest], known.length, width)
    write(known.folder, f"snippet_mask-{key[0]}", masks[order])
    return pd.DataFrame({"bucket": [key[0]], "size": [len(name)]})


def _first_bits(count: np.ndarray, width: int) -> np.ndarray:
    """Masks of `width` bytes with the first count[i] bits set."""
    return np.packbits(np.arange(width * 8) < count[:, None], axis=1)


def _compared(data: np.ndarray, bucket: np.ndarray, size: np.ndarray, begin: np.ndarray, weight: np.ndarray, length: int,
              width: int) -> np.ndarray:
    """Masks of the windows that repeat, for snippets sorted by bucket."""
    masks = np.zeros((len(bucket), width), np.uint8)
    if not len(bucket):
        return masks
    fresh = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))  # whole buckets go into a text
    filled = np.cumsum(size + 1) - (size + 1)
    text = filled[fresh] // TEXT
    cuts = fresh[np.concatenate([[True], text[1:] != text[:-1]])].tolist()
    for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
        there = size[a:b]
        shared = repeated(gather(data, begin[a:b], there), there, length)
        starts = there - length + 1
        inside = repeat_ranges(np.zeros(len(there), np.int64), starts)
        row = np.repeat(np.arange(b - a), starts)
        bits = np.zeros((b - a, width * 8), bool)
        bits[row, inside] = shared[(np.cumsum(there) - there)[row] + inside] | (weight[a:b] > 1)[row]
        masks[a:b] = np.packbits(bits, axis=1)
    return masks


def find(docs: DataFrame, text: str, length: int, range_bytes: int = RANGE, busy: int = BUSY) -> _Known:
    """Passes 1 to 3."""
    rows = docs.select(F.col(text).alias("text")).where(F.octet_length("text") >= length)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    known = _Known(scratch(docs.sparkSession, "suffix-dedup"), max(1, -(-size // range_bytes)), length, busy)
    if not size:
        return known

    def texts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        return (flat_bytes(part.column("text")) for part in pieces(batch, "text"))

    def busy_windows(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for data, offsets in texts(batch):
            lo, hi, _, often = known.windows(data, offsets)
            each = repeat_ranges(lo[often], (hi - lo + 1)[often])
            yield range_hashes(data, each, each + length)

    if known.keep("anchor", rows, lambda batch: (runs(d, o, length)[2] for d, o in texts(batch))) > busy:
        known.keep("window", rows, busy_windows)
    if known.filled["anchor"]:
        parts = rows.mapInArrow(lambda batches: _gather(batches, known), SENT)
        done = parts.groupBy("bucket").applyInPandas(lambda key, p: _search(key, p, known), "bucket int, size long").collect()
        known.filled["snippet"] = frozenset(r["bucket"] for r in done)
    return known


def covered(known: _Known, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte whether a repeated window covers it."""
    lo, hi, bucket, twice = known.snippets(data, offsets)
    at = twice
    if len(lo):
        size = hi - lo + known.length
        name = range_hashes(data, lo, lo + size)
        masks = np.zeros((len(lo), _mask_bytes(known.length)), np.uint8)
        for b, at in known.by_range("snippet", bucket):
            have = mapped(known.folder, f"snippet-{b}")
            at = at[np.argsort(name[at])]
            place = np.minimum(np.searchsorted(have, name[at]), len(have) - 1)
            ok = have[place] == name[at]
            masks[at[ok]] = mapped(known.folder, f"snippet_mask-{b}")[place[ok]]
        row, inside = np.nonzero(np.unpackbits(masks, axis=1))
        at = np.concatenate([twice, lo[row] + inside])
    depth = np.bincount(at, minlength=len(data) + 1) - np.bincount(at + known.length, minlength=len(data) + 1)
    return np.cumsum(depth[:-1]) > 0


def remove_repeats(docs: DataFrame, text: str = "text", length: int = 200, **kw) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans (maximal runs of removed bytes), kept (the remaining bytes,
    joined; they may be cut within a character)."""
    made = [("n_bytes", LongType()), ("n_removed", LongType()), ("n_spans", LongType()), ("kept", BinaryType())]
    columns = [c for c in docs.columns if c.lower() not in {"_text", *(n for n, _ in made)}]
    known = find(docs, text, length, **kw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "_text"):
                data, offsets = flat_bytes(part.column("_text"))
                gone = covered(known, data, offsets)
                sums = np.concatenate([[0], np.cumsum(gone)])
                fresh = gone.copy()
                fresh[1:] &= ~gone[:-1]
                heads = offsets[:-1][offsets[:-1] < len(data)]
                fresh[heads] = gone[heads]
                spans = np.concatenate([[0], np.cumsum(fresh)])
                left = data[~gone].tobytes()
                at = offsets - sums[offsets]
                kept = [left[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in columns), pa.array(np.diff(offsets)), pa.array(np.diff(sums[offsets])),
                     pa.array(np.diff(spans[offsets])), pa.array(kept, pa.binary())], names=[*columns, *(n for n, _ in made)])

    schema = StructType([*docs.select(*columns).schema.fields, *(StructField(n, t) for n, t in made)])
    return docs.select(*columns, F.col(text).alias("_text")).mapInArrow(run, schema)
