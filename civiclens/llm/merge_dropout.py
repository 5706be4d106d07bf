"""SentencePiece (BPE with byte fallback) encoding with seeded merge-dropout, and lossless decoding.

The vocabulary and its scores come from a public model file, read by the sentencepiece library; the
merges run here, because the library's own dropout cannot be seeded. Of all adjacent pairs whose
concatenation is a piece, the agenda always merges the one with the best score, leftmost first. A
candidate merge is skipped when a keyed hash of (seed, document, place of the unit in the text, place in the
unit, merged piece) falls below `dropout`, so each occurrence of a word is segmented by draws of its own. The
same seed gives the same ids on any cluster; other seeds or documents give other segmentations of the same text.

Texts are taken as they are: no normalisation, no added prefix. A space is the piece sign U+2581; that
sign itself, and every character without a piece, is written in byte pieces. So the pieces' bytes,
joined, are the text's bytes.

No piece goes on beyond a word (the sign of a space stands only in front) or holds a tab or line feed,
so merges are decided within units: spaces and the characters up to the next space. Equal units of a
batch are segmented once without dropout, and the merges done on the way are noted; an occurrence whose
draws skip none of them has that result (to skip a candidate that is never the best changes nothing). The others are segmented one by one: short ones all together in
numpy, one merge of each per round; long ones by a heap.

Defined results. Null text: ids null, decoded null. Empty text: no ids, decodes to an empty text. A
null id is replaced by the text's hash. Repeated rows are encoded alike. Input columns are kept; a column named ids or
decoded is replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .arrays import U64, flat_bytes, mix, pieces, range_hashes, repeat_ranges

LONG = 48  # symbols of a unit from which on the heap segments it
TOGETHER = 1 << 17  # symbols of the units that are segmented at once: their arrays stay in the processor's cache
_NONE = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Vocabulary:
    piece_bytes: np.ndarray  # bytes of all pieces, one after the other
    piece_at: np.ndarray
    of_char: np.ndarray  # code point to id, -1 without a piece
    byte_id: np.ndarray  # byte to id of its byte piece
    pair: np.ndarray  # sorted left id << 32 | right id of all pairs that make a piece
    made: np.ndarray  # id of that piece
    rank: np.ndarray  # of each id: place among the scores, best first
    slot: np.ndarray  # place in `pair` of one pair of each hash slot, -1 without any
    crowded: np.ndarray  # slots of more than one pair


def load_vocabulary(model_file: str) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = sp.get_piece_size()
    normal = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
    raw = [b""] * n
    byte_id = np.full(256, -1, np.int32)
    for i in range(n):
        if sp.is_byte(i):
            value = int(sp.id_to_piece(i)[3:5], 16)
            raw[i], byte_id[value] = bytes([value]), i
    of_char = np.full(0x110000, -1, np.int32)
    pairs = {}
    for piece, i in normal.items():
        raw[i] = piece.replace("▁", " ").encode()
        if len(piece) == 1 and piece != " ":
            of_char[32 if piece == "▁" else ord(piece)] = i
        for k in range(1, len(piece)):
            left, right = normal.get(piece[:k]), normal.get(piece[k:])
            if left is not None and right is not None:
                pairs[left << 32 | right] = i
    keys = np.array(sorted(pairs), np.int64)
    score = np.array([sp.get_score(i) for i in range(n)])
    rank = np.unique(-score, return_inverse=True)[1].astype(np.int64)
    own = _slot(keys)
    slot = np.full(1 << 20, -1, np.int32)
    slot[own] = np.arange(len(keys))
    crowded = np.bincount(own.astype(np.int64), minlength=len(slot)) > 1
    at = np.concatenate([[0], np.cumsum([len(b) for b in raw])])
    return Vocabulary(np.frombuffer(b"".join(raw), np.uint8), at, of_char, byte_id, keys,
                      np.array([pairs[k] for k in keys.tolist()], np.int32), rank, slot, crowded)


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys.astype(np.uint64) * U64(0x9E3779B97F4A7C15)) >> U64(44)


def _skipped(unit: np.ndarray, place: np.ndarray, made: np.ndarray, dropout: float) -> np.ndarray:
    """Which merges the keyed hash skips."""
    draw = mix(unit + (place.astype(np.uint64) << U64(32)) + made.astype(np.uint64))
    return draw < U64(min(int(dropout * 2.0**64), 2**64 - 1))


def _candidates(v: Vocabulary, left: np.ndarray, right: np.ndarray, place: np.ndarray, unit: np.ndarray, dropout: float) -> np.ndarray:
    """Piece that each pair makes, -1 where there is none or the keyed hash skips it. unit: the unit's keyed hash."""
    keys = left.astype(np.int64) << 32 | right.astype(np.int64)
    out = np.full(len(keys), -1, np.int32)
    slots = _slot(keys)
    at = v.slot[slots]
    likely = np.flatnonzero(at >= 0)
    at, wanted = at[likely], keys[likely]
    ok = v.pair[at] == wanted
    other = np.flatnonzero(~ok & v.crowded[slots[likely]])
    if len(other):
        at[other] = np.minimum(np.searchsorted(v.pair, wanted[other]), len(v.pair) - 1)
        ok[other] = v.pair[at[other]] == wanted[other]
    likely, made = likely[ok], v.made[at[ok]]
    if dropout > 0 and len(likely):
        stay = ~_skipped(unit[likely], place[likely], made, dropout)
        likely, made = likely[stay], made[stay]
    out[likely] = made
    return out


def agenda(v: Vocabulary, ids: np.ndarray, place: np.ndarray, unit: np.uint64, dropout: float) -> np.ndarray:
    """Segment one unit by a heap of candidate merges: the ids that remain."""
    ids, place = ids.tolist(), place.tolist()
    n = len(ids)
    nxt, prv, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
    key = np.full(1, unit, np.uint64)
    heap: list = []

    def push(i: int) -> None:
        j = nxt[i]
        if j < n:
            made = int(_candidates(v, np.array([ids[i]]), np.array([ids[j]]), np.array([place[i]]), key, dropout)[0])
            if made >= 0:
                heapq.heappush(heap, (int(v.rank[made]), i, ids[i], ids[j], made))

    first = _candidates(v, np.array(ids[:-1]), np.array(ids[1:]), np.array(place[:-1]), np.full(n - 1, unit, np.uint64), dropout) if n > 1 else []
    for i, made in enumerate(first):
        if made >= 0:
            heap.append((int(v.rank[made]), i, ids[i], ids[i + 1], int(made)))
    heapq.heapify(heap)
    while heap:
        _, i, left, right, made = heapq.heappop(heap)
        j = nxt[i]
        if gone[i] or j >= n or ids[i] != left or ids[j] != right:
            continue
        ids[i], gone[j], nxt[i] = made, True, nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        push(i)
        if prv[i] >= 0:
            push(prv[i])
    return np.array([x for x, dead in zip(ids, gone, strict=True) if not dead], np.int32)


def _lockstep(v: Vocabulary, ids: np.ndarray, place: np.ndarray, at: np.ndarray, unit: np.ndarray, dropout: float,
              noted: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Segment many units (symbols ids[at[k]:at[k + 1]]) at once: each round does the best merge of each
    unit that still has one. Returns the remaining ids and which unit each belongs to. noted takes the
    merges done, as (unit, place, piece).

    Symbols are linked within their unit; a merge goes into the left one and unlinks the right one. `order` holds
    rank and position of each symbol's merge with the next. The arrays shrink when half of the units are finished."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    ids = ids.copy()
    done_ids, done_row = [], []
    alive, made, order = np.ones(len(ids), bool), np.full(len(ids), -1, np.int32), np.full(len(ids), _NONE)

    def linked() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First symbol of each unit, and the symbols after and before each symbol (-1: none)."""
        end = np.append(row[1:] != row[:-1], True)
        after, before = np.arange(1, len(row) + 1), np.arange(-1, len(row) - 1)
        first = np.append(0, np.flatnonzero(end)[:-1] + 1)
        after[end], before[first] = -1, -1
        return first, after, before

    def look(i: np.ndarray, j: np.ndarray) -> None:
        """Candidates of the symbols i with their right neighbours j."""
        made[i] = got = _candidates(v, ids[i], ids[j], place[i], unit[row[i]], dropout)
        order[i] = np.where(got >= 0, v.rank[got] << 32 | i, _NONE)

    if len(ids):
        first, after, before = linked()
        i = np.flatnonzero(after >= 0)
        look(i, i + 1)
    while len(ids):
        best = np.minimum.reduceat(order, first)
        live = best != _NONE
        if 2 * np.count_nonzero(live) <= len(live):
            size = np.diff(np.append(first, len(ids)))
            going = np.repeat(live, size)
            over = alive & ~going
            done_ids.append(ids[over])
            done_row.append(row[over])
            keep = alive & going
            ids, row, place, made, order = ids[keep], row[keep], place[keep], made[keep], order[keep]
            if not len(ids):
                break
            alive = np.ones(len(ids), bool)
            some = np.flatnonzero(order != _NONE)
            order[some] = order[some] >> 32 << 32 | some
            first, after, before = linked()
            best = np.minimum.reduceat(order, first)
            live = best != _NONE
        i = best[live] & 0xFFFFFFFF
        j = after[i]
        ids[i] = made[i]
        if noted is not None:
            noted.append((row[i], place[i], ids[i]))
        alive[j], order[j], order[i] = False, _NONE, _NONE
        after[i] = k = after[j]
        left, right = before[i] >= 0, k >= 0
        before[k[right]] = i[right]
        look(i[right], k[right])
        look(before[i[left]], i[left])
    if not done_ids:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    out, where = np.concatenate(done_ids), np.concatenate(done_row)
    order = np.argsort(where, kind="stable")
    return out[order], where[order]


def _symbols(v: Vocabulary, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the characters (or of their bytes, without a piece) and the byte at which each starts."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    size = np.diff(np.append(lead, len(data)))
    point = data[lead].astype(np.int64) & np.array([0, 0x7F, 0x1F, 0x0F, 0x07])[size]
    for k in (1, 2, 3):
        more = size > k
        point[more] = point[more] << 6 | (data[lead[more] + k] & 0x3F)
    known = v.of_char[point]
    count = np.where(known >= 0, 1, size)
    where = repeat_ranges(lead, count)
    ids = np.repeat(known, count)
    fallback = ids < 0
    ids[fallback] = v.byte_id[data[where[fallback]]]
    return ids, where


def encode_texts(v: Vocabulary, data: np.ndarray, offsets: np.ndarray, variant: np.ndarray, seed: int, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows and the n + 1 offsets of the rows."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    space, control = data == 32, (data == 10) | (data == 9)
    start = control.copy()
    start[1:] |= control[:-1] | (space[1:] & ~space[:-1])
    start[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], len(data))
    row = np.searchsorted(offsets, starts, side="right") - 1
    with np.errstate(over="ignore"):
        salt = mix(np.full(1, seed & (2**64 - 1), np.uint64) + U64(0x51ED27))[0]
        own = mix(mix(variant[row].astype(np.uint64) + salt) + (starts - offsets[row]).astype(np.uint64))
    _, first, inverse = np.unique(range_hashes(data, starts, ends), return_index=True, return_inverse=True)
    got, begin, noted, long = _segmented(v, data, starts[first], ends[first], own[first], 0.0)
    result = inverse  # of each occurrence, the segmentation it has
    if dropout > 0:
        unit, place, made = noted
        order = np.argsort(unit, kind="stable")
        place, made = place[order], made[order]
        at = np.searchsorted(unit[order], np.arange(len(first) + 1))
        again = long[inverse]  # the heap notes nothing: long units are always segmented anew
        for a in range(0, len(inverse), 1 << 16):
            part = inverse[a : a + (1 << 16)]
            count = at[part + 1] - at[part]
            pick = repeat_ranges(at[part], count)
            who = a + np.repeat(np.arange(len(part)), count)
            with np.errstate(over="ignore"):
                again[who[_skipped(own[who], place[pick], made[pick], dropout)]] = True
        redo = np.flatnonzero(again)
        more, from_there, _, _ = _segmented(v, data, starts[redo], ends[redo], own[redo], dropout)
        result = inverse.copy()
        result[redo] = len(first) + np.arange(len(redo))
        got, begin = np.concatenate([got, more]), np.concatenate([begin, len(got) + from_there[1:]])
    count = np.diff(begin)[result]
    out = got[repeat_ranges(begin[:-1][result], count)]
    total = np.concatenate([[0], np.cumsum(count)])
    return out, total[np.searchsorted(starts, offsets)]


def _cuts(total: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of units of about TOGETHER symbols; total: symbols before each unit, and of all."""
    a = 0
    while a < len(total) - 1:
        b = max(a + 1, int(np.searchsorted(total, total[a] + TOGETHER, side="right")) - 1)
        yield a, b
        a = b


def _segmented(v: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, unit: np.ndarray,
               dropout: float) -> tuple[np.ndarray, np.ndarray, tuple, np.ndarray]:
    """Ids of the units data[starts[k]:ends[k]], their n + 1 offsets, the merges done (without dropout), and which units are long."""
    size = ends - starts
    ids, where = _symbols(v, data[repeat_ranges(starts, size)])
    bounds = np.concatenate([[0], np.cumsum(size)])
    at = np.searchsorted(where, bounds)
    place = where - np.repeat(bounds[:-1], np.diff(at))
    length = np.diff(at)
    short = np.flatnonzero(length <= LONG)
    noted: list | None = [] if dropout == 0 else None
    parts, owners = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    total = np.concatenate([[0], np.cumsum(length[short])])
    for a, b in _cuts(total):
        few = short[a:b]
        done: list | None = None if noted is None else []
        pick = repeat_ranges(at[few], length[few])
        got, owner = _lockstep(v, ids[pick], place[pick], total[a : b + 1] - total[a], unit[few], dropout, done)
        parts.append(got)
        owners.append(few[owner])
        if noted is not None:
            noted += [(few[r], q, m) for r, q, m in done]
    for k in np.flatnonzero(length > LONG).tolist():
        parts.append(agenda(v, ids[at[k] : at[k + 1]], place[at[k] : at[k + 1]], unit[k], dropout))
        owners.append(np.full(len(parts[-1]), k))
    got, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    done = tuple(np.concatenate(x) for x in zip(*noted, strict=True)) if noted else (np.zeros(0, np.int64),) * 3
    return (got[order], np.searchsorted(owner[order], np.arange(len(starts) + 1)),
            done, length > LONG)


def decode_ids(v: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and the n + 1 offsets of the rows."""
    size = np.diff(v.piece_at)[ids]
    total = np.concatenate([[0], np.cumsum(size)])
    return v.piece_bytes[repeat_ranges(v.piece_at[ids], size)], total[offsets]


def _decoded(v: Vocabulary, lists: pa.ListArray) -> pa.Array:
    """The texts of lists of ids; null for null."""
    null = lists.is_null().to_numpy(zero_copy_only=False)
    size = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    data, offsets = decode_ids(v, lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)]))
    flat = data.tobytes()
    return pa.array([None if x else flat[a:b].decode() for a, b, x in zip(offsets[:-1], offsets[1:], null, strict=True)], pa.string())


def _kept(df: DataFrame, *names: str) -> list[str]:
    return [c for c in df.columns if c.lower() not in names]


def encode(docs: DataFrame, model_file: str, doc_id: str = "doc_id", text: str = "text", seed: int = 0,
           dropout: float = 0.1, decoded: bool = False) -> DataFrame:
    """docs with ids (array of int); with decoded, also the text that these ids stand for."""
    sent = docs.sparkSession.sparkContext.broadcast(load_vocabulary(model_file))  # a few MB, by the vocabulary
    kept = _kept(docs, "ids", "decoded", "_text", "_variant")
    variant = F.when(F.col(doc_id).isNull(), F.xxhash64(F.col(text), F.lit(seed))).otherwise(F.xxhash64(F.col(doc_id), F.lit(seed)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "_text"):
                column = part.column("_text")
                ids, at = encode_texts(sent.value, *flat_bytes(column), part.column("_variant").to_numpy(zero_copy_only=False), seed, dropout)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids), mask=column.is_null())
                also = [_decoded(sent.value, lists)] if decoded else []
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), lists, *also], names=[*kept, "ids", *(["decoded"] if decoded else [])])

    schema = StructType([*docs.select(*kept).schema.fields, StructField("ids", ArrayType(IntegerType())),
                         *([StructField("decoded", StringType())] if decoded else [])])
    return docs.select(*kept, F.col(text).alias("_text"), variant.alias("_variant")).mapInArrow(run, schema)


def decode(rows: DataFrame, model_file: str, ids: str = "ids") -> DataFrame:
    """rows with decoded, the text that the ids stand for; the ids column is dropped."""
    sent = rows.sparkSession.sparkContext.broadcast(load_vocabulary(model_file))
    kept = _kept(rows, "decoded", "_ids", ids.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), _decoded(sent.value, part.column("_ids"))], names=[*kept, "decoded"])

    schema = StructType([*rows.select(*kept).schema.fields, StructField("decoded", StringType())])
    return rows.select(*kept, F.col(ids).alias("_ids")).mapInArrow(run, schema)
