"""Token ids in files, packed by an adaptive context-mixing range coder.

Format. A part file holds the documents of an id range in ascending order: a header (magic, number of
documents, of ids and of blocks), the documents' ids and lengths, the blocks' sizes and checksums, and
the blocks. A block is BLOCK ids (the last one fewer), coded from a fresh model, so it can be decoded
alone; its crc32 is over the ids as little-endian 32-bit integers.

Coding. An id is four nibbles of 16 bits, highest first. For each nibble three adaptive distributions
are looked up: by the id's nibbles so far (order 0), and by these with the one (order 1) or the two ids
before (order 2); contexts are hashed into SLOTS places. The three are mixed with weights that follow
how well each has predicted, one set of weights for each nibble and for whether the contexts of orders
1 and 2 have been seen. The mixture drives a range coder with 48-bit range and 16-bit output; carries
are added up at the end. All arithmetic is in integers, so that decoding repeats it exactly. Blocks are
coded side by side: numpy works on the same place of all blocks at once.

Tokenizing. The library's byte-level splitter always cuts before a single space that stands between two other
characters, so texts are cut there and a worker gives each distinct unit to the library once; its ids are kept, up to
HELD bytes. Tokenizer files for which that does not hold get whole texts.

Defined results. Null texts are empty: the end id alone. Repeated ids stand next to each other, ordered
by their text. A null doc_id comes first. An empty table gives no files and an empty result. Extra
columns are ignored. A task that runs again replaces its file. A damaged block raises ValueError.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrays import pieces
from .hash_arrays import open_store
from .shared import scratch

MAGIC = b"CMRC0001"
BLOCK = 4096
SLOTS = 2048
TOTAL = 32768  # of a distribution
SIDE = 1280  # blocks coded at once, 200 KB each for their models
HELD = 64 << 20  # of units whose ids a worker keeps
_CUT = re.compile(r"(?<=\S)(?= \S)")
_SPREAD = TOTAL - 16
_ONE = 1 << 14
_HASH = 0x9E3779B1
#: By a nibble coded: the bounds that a distribution moves to; its upper bound, where that is no column.
_TARGET = np.where(np.arange(16) > np.arange(16)[:, None], _SPREAD, 0).astype(np.int16)
_END = np.append(np.zeros(15, np.int32), np.int32(_SPREAD))
#: By the visits so far: a distribution moves by a 4th, 8th, 8th and 16th (times factor, by 16); the first visits count most.
_FACTOR = np.repeat(np.array([[4], [2], [2], [1]], np.int16), 16, axis=1)
_SEEN = np.array([1, 2, 3, 3], np.int16)
#: By the nibbles so far, after a 1: their part of a slot's hash. By the visits in orders 1 and 2: which weights of a place.
_PREFIX = (np.arange(8192) * 202515 + np.searchsorted([16, 256, 4096], np.arange(8192), side="right") * 40503) * _HASH
_KNOWN = (np.arange(16) >= 4) * 2 + (np.arange(16) % 4 > 0)
_STEP = np.arange(16, dtype=np.int32)[:, None]


class _Mixer:
    """Models of `lanes` blocks, the three orders one after the other. Column 0 of a slot counts its visits up to 3;
    columns 1 to 15 are the bounds between the 16 nibbles in a distribution of _SPREAD. The slots of a step are copied
    out, changed side by side and put back, each as one item of 32 bytes."""

    def __init__(self, lanes: int):
        start = np.append(0, _SPREAD * np.arange(1, 16) // 16).astype(np.int16)
        self.table = np.tile(start, (3 * lanes * SLOTS, 1))
        self.slots = self.table.view("V32").ravel()
        self.weight = np.full((3, lanes * 16), _ONE // 3, np.int32)
        self.weight[0] += _ONE - 3 * (_ONE // 3)
        each = np.arange(3 * lanes)
        self.base, self.sets = (each * SLOTS).reshape(3, lanes), (each * 16).reshape(3, lanes)
        self.ends = np.stack([self.sets, self.sets + 1])  # places of the lower and the upper bound of nibble 0
        self.flat = np.zeros(3 * lanes * 16 + 16, np.int16)  # a zero after the last row, as after the others
        self.rows = self.flat[:-16].reshape(-1, 16)
        self.items, self.by_order = self.rows.view("V32").ravel(), self.rows.reshape(3, lanes, 16)
        self.move, self.factor = np.empty((3, lanes, 16), np.int16), np.empty((3 * lanes, 16), np.int16)
        self.wide, self.bounds = np.empty((16, 3, lanes), np.int32), np.empty((16, lanes), np.int32)
        self.context, self.at, self.set = (np.zeros((3, lanes), np.int64) for _ in range(3))

    def follow(self, one: np.ndarray, two: np.ndarray) -> None:
        """The contexts of the next id: none, one before it, two before it."""
        np.multiply(one * 69069 + 7, _HASH, out=self.context[1])
        np.multiply(one * 362437 + two * 1664525 + 13, _HASH, out=self.context[2])

    def open(self, place: int, prefix: np.ndarray) -> None:
        """Copy out the slots of the next nibble."""
        at = self.at
        np.add(self.context, _PREFIX.take(prefix), out=at)
        at >>= 15
        at &= SLOTS - 1
        at += self.base
        self.table.take(at.ravel(), axis=0, out=self.rows, mode="clip")
        self.seen = self.rows[:, 0].copy()
        self.rows[:, 0] = 0
        seen = self.seen.reshape(at.shape)
        np.add(self.sets, (_KNOWN + 4 * place).take(seen[1] * 4 + seen[2]), out=self.set)
        self.w = self.weight.take(self.set)

    def find(self, target: np.ndarray) -> np.ndarray:
        """The nibbles in whose shares the targets (below TOTAL) fall."""
        wide, bounds = self.wide, self.bounds
        np.copyto(wide, self.by_order.transpose(2, 0, 1))
        wide *= self.w
        np.add(wide[:, 0], wide[:, 1], out=bounds)
        bounds += wide[:, 2]
        bounds >>= 14
        bounds += _STEP
        return np.add.reduce((bounds <= target).view(np.int8), axis=0, dtype=np.int64) - 1

    def share(self, nibble: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower bound and width of the nibbles' shares of TOTAL."""
        ends = self.flat.take(self.ends + nibble).astype(np.int32)
        ends[1] += _END.take(nibble)
        self.gain = ends[1] - ends[0]
        ends *= self.w
        low, high = np.add.reduce(ends, axis=1, dtype=np.int32) >> 14
        high -= low
        high += 1
        return (low + nibble).astype(np.uint64), high.astype(np.uint64)

    def learn(self, nibble: np.ndarray) -> None:
        move = self.move
        np.subtract(_TARGET.take(nibble, axis=0), self.by_order, out=move)
        move >>= 2
        _FACTOR.take(self.seen, axis=0, out=self.factor, mode="clip")
        move *= self.factor.reshape(move.shape)
        move >>= 2
        self.by_order += move
        self.rows[:, 0] = _SEEN.take(self.seen)
        self.slots[self.at.ravel()] = self.items
        # whole numbers below 2**53, and quotients that no rounding can lift to the next one
        gain = self.gain
        gain += 64
        gain *= self.w
        share = gain * float(_ONE - 384)
        share /= np.add.reduce(gain, axis=0, dtype=np.int32)
        w = self.w * 15
        w += 128
        w += share.astype(np.int32)
        w >>= 4
        w[0] += _ONE - np.add.reduce(w, axis=0, dtype=np.int32)  # the weights of a set add up to _ONE
        self.weight.put(self.set, w)


def _sides(blocks: int) -> int:
    """Blocks coded at once: shared out evenly, SIDE at most."""
    return -(-blocks // -(-blocks // SIDE)) if blocks else 1


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """ids cut into blocks, each coded on its own."""
    blocks = -(-len(ids) // BLOCK)
    side = _sides(blocks)
    out: list[bytes] = []
    for first in range(0, blocks, side):
        lanes = min(side, blocks - first)
        own = ids[first * BLOCK : (first + lanes) * BLOCK]
        grid = np.zeros(lanes * BLOCK, np.uint16)
        grid[: len(own)] = own
        grid = np.ascontiguousarray(grid.reshape(lanes, BLOCK).T)
        short = len(own) - (lanes - 1) * BLOCK  # ids of the last block: what is coded after them is thrown away
        mixer, lane = _Mixer(lanes), np.arange(lanes)
        low, width = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 48) - 1, np.uint64)
        words = np.zeros((lanes, BLOCK * 4 + 8), np.uint32)
        line, start = words.ravel(), lane * (BLOCK * 4 + 8)
        at = start + 1  # a carry can run into word 0
        one, two = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        mask, small = np.uint64((1 << 48) - 1), np.uint64(1 << 32)
        last = None
        for t in range(BLOCK if lanes > 1 else short):
            if t == short:
                last = words[-1].copy(), at[-1], low[-1]
            token, prefix = grid[t].astype(np.int64), np.ones(lanes, np.int64)
            mixer.follow(one, two)
            for place in range(4):
                nibble = token >> (12 - 4 * place) & 15
                mixer.open(place, prefix)
                lower, share = mixer.share(nibble)
                r = width >> np.uint64(15)
                low += r * lower
                carry = np.flatnonzero(low > mask)
                if len(carry):
                    line[at[carry] - 1] += np.uint32(1)
                    low &= mask
                np.multiply(r, share, out=width)
                full = np.flatnonzero(width < small)
                if len(full):
                    own_low = low[full]
                    line[at[full]] = own_low >> np.uint64(32)
                    at[full] += 1
                    low[full] = own_low << np.uint64(16) & mask
                    width[full] <<= np.uint64(16)
                mixer.learn(nibble)
                prefix = prefix << 4 | nibble
            two, one = one, token + 1
        if last:
            words[-1], at[-1], low[-1] = last
        for shift in (32, 16, 0):
            line[at] = (low >> np.uint64(shift) & np.uint64(0xFFFF)).astype(np.uint32)
            at += 1
        at -= start
        for k in range(int(at.max()) - 1, 0, -1):
            words[:, k - 1] += words[:, k] >> 16
        out += [words[i, : at[i]].astype("<u2").tobytes() for i in range(lanes)]
    return out


def decode_blocks(blocks: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """The ids of the blocks, one after the other."""
    out, side = [], _sides(len(blocks))
    for first in range(0, len(blocks), side):
        own = blocks[first : first + side]
        lanes, n = len(own), np.asarray(sizes[first : first + side])
        length = max(len(b) // 2 for b in own) + 4
        words = np.zeros((lanes, length), np.uint16)
        for i, b in enumerate(own):
            words[i, : len(b) // 2] = np.frombuffer(b, "<u2")
        mixer = _Mixer(lanes)
        # word 0 took the carries of the first 48 bits
        code = np.zeros(lanes, np.uint64)
        for k in range(4):
            code = code << np.uint64(16) | words[:, k]
        line, start = words.ravel(), np.arange(lanes) * length
        at, end = start + 4, start + length - 1
        width = np.full(lanes, (1 << 48) - 1, np.uint64)
        grid = np.zeros((int(n.max(initial=0)), lanes), np.uint16)
        one, two = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        small = np.uint64(1 << 32)
        for t in range(len(grid)):
            prefix = np.ones(lanes, np.int64)
            mixer.follow(one, two)
            for place in range(4):
                mixer.open(place, prefix)
                r = width >> np.uint64(15)
                nibble = mixer.find(np.minimum(code // r, np.uint64(TOTAL - 1)).astype(np.int32))
                lower, share = mixer.share(nibble)
                code -= r * lower
                np.multiply(r, share, out=width)
                full = np.flatnonzero(width < small)
                if len(full):
                    code[full] = code[full] << np.uint64(16) | line[np.minimum(at[full], end[full])]
                    at[full] += 1
                    width[full] <<= np.uint64(16)
                mixer.learn(nibble)
                prefix = prefix << 4 | nibble
            token = prefix & 0xFFFF
            grid[t] = token
            two, one = one, token + 1
        out.append(grid.T[np.arange(len(grid)) < n[:, None]])
    return np.concatenate(out).astype(np.uint32) if out else np.zeros(0, np.uint32)


# -- ids

def cuts_at_spaces(model: str) -> bool:
    """Whether a tokenizer file gives a text the ids of its units, cut before single spaces, one after the other."""
    spec = json.loads(model)
    pre, normal = spec.get("pre_tokenizer") or {}, not any(spec.get(k) for k in ("normalizer", "truncation", "padding"))
    added = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"])) for t in spec.get("added_tokens") or [])
    byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    return bool(byte_level and normal and added and not spec["model"].get("dropout"))


class Ids:
    """Ids of texts by the tokenizers library, each text's followed by end_id."""

    def __init__(self, model: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_str(model), end_id
        self.split = _CUT.split if cuts_at_spaces(model) else lambda text: [text]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str | None, int] = {None: 0}  # None is the end of a text
        self.held, self.starts, self.sizes, self.store = 0, np.zeros(1, np.int64), np.ones(1, np.int64), np.array([self.end_id], np.uint32)

    def of(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids (end ids included), and how many each text has."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.held > HELD:
            self.forget()
        units: list[str | None] = []
        heads = []
        for text in texts:
            heads.append(len(units))
            units += self.split(text)
            units.append(None)
        new = list(set(units).difference(self.known))
        if new:
            coded = [c.ids for c in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            sizes = np.fromiter(map(len, coded), np.int64, len(new))
            self.known.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new)), strict=True))
            self.starts = np.append(self.starts, len(self.store) + np.cumsum(sizes) - sizes)
            self.sizes = np.append(self.sizes, sizes)
            self.store = np.append(self.store, np.fromiter(chain.from_iterable(coded), np.uint32, int(sizes.sum())))
            self.held += sum(map(len, new)) + 100 * len(new)
        place = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
        sizes = self.sizes[place]
        ends = np.cumsum(sizes)
        return self.store[np.repeat(self.starts[place] - (ends - sizes), sizes) + np.arange(ends[-1])], np.add.reduceat(sizes, heads)


# -- files

def pack(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    blocks = encode_blocks(ids)
    sizes = np.array([len(b) for b in blocks], "<u4")
    sums = np.array([zlib.crc32(ids[i : i + BLOCK].astype("<u4").tobytes()) for i in range(0, len(ids), BLOCK)], "<u4")
    head = np.array([len(doc_ids), len(ids), len(blocks)], "<i8")
    return b"".join([MAGIC, head.tobytes(), doc_ids.astype("<i8").tobytes(), lengths.astype("<i8").tobytes(), sizes.tobytes(), sums.tobytes(), *blocks])


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, lengths and token ids of a part file; every block is held against its checksum."""
    if raw[:8] != MAGIC:
        raise ValueError("not a token file")
    docs, n, blocks = np.frombuffer(raw, "<i8", 3, 8).tolist()
    at = 32
    doc_ids, lengths = np.frombuffer(raw, "<i8", docs, at), np.frombuffer(raw, "<i8", docs, at + 8 * docs)
    at += 16 * docs
    sizes, sums = np.frombuffer(raw, "<u4", blocks, at), np.frombuffer(raw, "<u4", blocks, at + 4 * blocks)
    at += 8 * blocks
    ends = at + np.cumsum(sizes.astype(np.int64))
    ids = decode_blocks([raw[e - s : e] for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)],
                        np.minimum(BLOCK, n - BLOCK * np.arange(blocks)))
    for k in range(blocks):
        if zlib.crc32(ids[k * BLOCK : (k + 1) * BLOCK].astype("<u4").tobytes()) != sums[k]:
            raise ValueError(f"block {k} does not match its checksum")
    return doc_ids, lengths, ids


def write_tokens(docs: DataFrame, tokenizer_file: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 2,
                 folder: str | None = None, part_bytes: int = 24 << 20) -> DataFrame:
    """Tokenize and write. One row per part file: part, path, n_docs, n_ids, n_bytes; the parts are in doc_id order."""
    spark = docs.sparkSession
    with open(tokenizer_file) as f:
        model = spark.sparkContext.broadcast(f.read())  # a vocabulary, 1.5 MB
    folder = folder or scratch(spark, "tokens")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 8), F.lit(0))).first()[0]
    if not size:
        return spark.createDataFrame([], "part int, path string, n_docs long, n_ids long, n_bytes long")
    # repeated ids may fall to several parts: the text orders them
    rows = rows.repartitionByRange(max(1, -(-size // part_bytes)), "doc_id", "text").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        coder, part = Ids(model.value, end_id), TaskContext.get().partitionId()
        names, lengths, ids = [], [], []
        for batch in batches:
            for piece in pieces(batch, "text"):
                own, sizes = coder.of(piece.column("text").to_pylist())
                if own.max(initial=0) > 0xFFFF:
                    raise ValueError("the coder takes ids below 65536")
                ids.append(own.astype(np.uint16))
                lengths.append(sizes)
                names.append(piece.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy())
        coder.forget()
        if names:
            flat, sizes = np.concatenate(ids), np.concatenate(lengths)
            ids.clear()
            raw = pack(np.concatenate(names), sizes, flat)
            store, path = open_store(folder)
            store.create_dir(path, recursive=True)
            own = f"{path}/.{part}-{os.getpid()}-{np.random.default_rng().integers(1 << 62)}"
            with store.open_output_stream(own) as out:
                out.write(raw)
            store.move(own, f"{path}/part-{part:08d}.cmrc")
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([f"{folder}/part-{part:08d}.cmrc"]), pa.array([len(sizes)]),
                 pa.array([len(flat)]), pa.array([len(raw)])], names=["part", "path", "n_docs", "n_ids", "n_bytes"])

    return rows.mapInArrow(run, "part int, path string, n_docs long, n_ids long, n_bytes long")


def read_tokens(parts: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (binary, little-endian unsigned 32-bit) of
    every document of the part files. parts: the rows that write_tokens gave, computed once."""
    spark = parts.sparkSession
    listed = sorted(tuple(r) for r in parts.select("part", "path", "n_ids").collect())  # a row for each file
    schema = "doc_id long, start long, n_tokens long, ids binary"
    if not listed:
        return spark.createDataFrame([], schema)
    before = np.concatenate([[0], np.cumsum([r[2] for r in listed])]).tolist()
    rows = [(r[1], int(b)) for r, b in zip(listed, before[:-1], strict=True)]
    files = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "path string, before long")  # a task for each file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                store, place = open_store(path)
                with store.open_input_stream(place) as src:
                    doc_ids, lengths, ids = unpack(src.read())
                ends = np.cumsum(lengths)
                raw = ids.astype("<u4").tobytes()
                for a in range(0, len(ends), 512):
                    e, n = ends[a : a + 512], lengths[a : a + 512]
                    names = pa.array(doc_ids[a : a + 512], mask=doc_ids[a : a + 512] == np.iinfo(np.int64).min)
                    yield pa.RecordBatch.from_arrays(
                        [names, pa.array(before + e - n), pa.array(n),
                         pa.array([raw[4 * (y - x) : 4 * y] for x, y in zip(n.tolist(), e.tolist(), strict=True)], pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"])

    return files.mapInArrow(run, schema)
