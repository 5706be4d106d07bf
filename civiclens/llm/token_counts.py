"""Token counts of a byte-level BPE without making identifiers.

Each word of a text starts as a doubly linked list of byte symbols. A heap holds the adjacent pairs that a merge
joins; the pair of the lowest rank (leftmost first) is popped, joined, and the pairs with its new neighbours
pushed. A word's count is its number of symbols less its number of merges. Words of LONG bytes or more pop all
pairs of the lowest rank together, on arrays: the same merges, because a rule can only use symbols of
lower-ranked rules (checked when the file is read).

Words are cut as the tokenizer's byte-level splitter cuts them. The class of a character (letter, number, space, other) is
asked of the tokenizers library, once for each character that a worker meets, so both follow the same Unicode version. The
added tokens of the file, met inside a text, count one each, which is the library's default.

Memory: pieces of about 1 MB of text, a bounded cache of counts of short words, about 60 bytes for each byte of one long word.

Defined results. Null or empty text: 0 bytes, 0 tokens. Repeated rows are counted alike. Input columns are kept (or
those named in `keep`); columns named n_bytes, n_tokens or over_limit are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .arrays import flat_bytes, pieces

LONG = 2048  # bytes of a word from which on equal ranks are popped together
CACHED_BYTES = 64  # longer words are not kept
CACHED_WORDS = 1 << 19
SPACE, LETTER, NUMBER, OTHER, ADDED = range(5)
_UNKNOWN = 255
BITS = 20  # of a symbol
_LOW = (1 << BITS) - 1
_AFTER, _BEFORE = list(range(1, LONG + 1)), list(range(-1, LONG - 1))
_SHORT_FORMS = ("s", "t", "re", "ve", "m", "ll", "d")  # fixed values of the byte-level splitter


@dataclass(frozen=True)
class Merges:
    """Symbols are numbered anew: bytes first, then in the order in which rules make them."""

    rule: dict[int, int]  # left << BITS | right to rank << BITS | symbol made
    pairs: np.ndarray  # the same, sorted by pair
    rules: np.ndarray
    pair_of: dict[int, int]
    added: tuple[bytes, ...]
    splitter: str  # the tokenizer file, for the classes of characters


def _byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


def load_merges(tokenizer_file: str) -> Merges:
    """Rules of a byte-level BPE from a tokenizers .json file; others raise."""
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    plain = not spec["normalizer"] and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if model.get("type", "BPE") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or not plain:
        raise ValueError(f"{tokenizer_file}: only byte-level BPE without normalizer, prefix space or dropout can be counted")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError(f"{tokenizer_file}: added tokens that take in white space or need word borders can't be counted")
    if len(model["vocab"]) > _LOW:
        raise ValueError(f"{tokenizer_file}: more than {_LOW} symbols")
    symbol = {c: b for b, c in _byte_alphabet().items()}
    made_by, rule = [-1] * 256, {}
    for rank, pair in enumerate(model["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        if left not in symbol or right not in symbol or max(made_by[symbol[left]], made_by[symbol[right]]) >= rank:
            raise ValueError(f"{tokenizer_file}: merge {rank} uses a symbol of a later merge")
        made = symbol.setdefault(left + right, len(made_by))
        if made == len(made_by):
            made_by.append(rank)
        rule.setdefault(symbol[left] << BITS | symbol[right], rank << BITS | made)
    pairs = np.array(sorted(rule), np.int64)
    return Merges(rule, pairs, np.array([rule[p] for p in pairs.tolist()], np.int64), {v: k for k, v in rule.items()},
                  tuple(t["content"].encode() for t in spec["added_tokens"]), tokenizer_file)


def count_short(m: Merges, word: bytes) -> int:
    """Symbols left of one word of LONG bytes at most: a heap of adjacent pairs over a linked list.
    An entry of the heap is the rule's rank and result, then the place, in one number."""
    n, get = len(word), m.rule.get
    symbol, heap, push, pop = list(word), [], heapq.heappush, heapq.heappop
    left = symbol[0]
    for i, right in enumerate(word[1:]):
        got = get(left << BITS | right)
        if got is not None:
            heap.append(got << 12 | i)
        left = right
    if not heap:
        return n
    heapq.heapify(heap)
    after, before = _AFTER[:n], _BEFORE[:n]
    rest = n
    while heap:
        entry = pop(heap)
        i, got = entry & 4095, entry >> 12
        j = after[i]
        if j >= n or get(symbol[i] << BITS | symbol[j]) != got:
            continue
        symbol[i] = made = got & _LOW
        symbol[j] = -1  # no pair holds it: stale entries of the place are passed over
        after[i] = k = after[j]
        rest -= 1
        if k < n:
            before[k] = i
            new = get(made << BITS | symbol[k])
            if new is not None:
                push(heap, new << 12 | i)
        h = before[i]
        if h >= 0:
            new = get(symbol[h] << BITS | made)
            if new is not None:
                push(heap, new << 12 | h)
    return rest


def count_long(m: Merges, word: bytes) -> int:
    """As count_short; all pairs of the lowest rank are popped together."""
    symbol = np.frombuffer(word, np.uint8).astype(np.int64)
    n = len(symbol)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    waiting: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def push(at: np.ndarray) -> None:
        """Places whose symbol and the next one make a pair of some rule."""
        at = at[after[at] < n]
        pair = symbol[at] << BITS | symbol[after[at]]
        where = np.minimum(np.searchsorted(m.pairs, pair), len(m.pairs) - 1)
        ok = m.pairs[where] == pair
        at, got = at[ok], m.rules[where[ok]]
        order = np.argsort(got, kind="stable")
        at, got = at[order], got[order]
        cut = np.append(np.flatnonzero(np.diff(got, prepend=-1)), len(got)).tolist()
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            key = int(got[a])
            if key not in waiting:
                waiting[key] = []
                heapq.heappush(heap, key)
            waiting[key].append(at[a:b])

    if len(m.pairs):
        push(np.arange(n - 1))
    merges = 0
    while heap:
        key = heapq.heappop(heap)
        pair = m.pair_of[key]
        at = np.unique(np.concatenate(waiting.pop(key)))
        at = at[(symbol[at] >= 0) & (after[at] < n)]
        at = at[(symbol[at] << BITS | symbol[after[at]]) == pair]
        if len(at) > 1 and pair >> BITS == pair & _LOW:  # runs of one symbol: every second pair, from the left
            first = np.concatenate([[True], after[at[:-1]] != at[1:]])
            since = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            at = at[since % 2 == 0]
        if not len(at):
            continue
        gone = after[at]
        symbol[at], symbol[gone] = key & _LOW, -1
        after[at] = after[gone]
        inside = after[at] < n
        before[after[at][inside]] = at[inside]
        merges += len(at)
        left = before[at]
        push(np.unique(np.concatenate([at, left[left >= 0]])))
    return n - merges


class Counter:
    """Counts the tokens of pieces of text; keeps the counts of short words and the classes of characters."""

    def __init__(self, merges: Merges):
        from tokenizers import Tokenizer

        self.m = merges
        self.split = Tokenizer.from_file(merges.splitter).pre_tokenizer.pre_tokenize_str
        self.known: dict[bytes, int] = {}
        self.kind = np.full(0x110000, _UNKNOWN, np.uint8)
        self.added = re.compile(b"|".join(re.escape(t) for t in sorted(merges.added, key=len, reverse=True))) if merges.added else None

    def classes(self, points: np.ndarray) -> np.ndarray:
        """Class of each character, by what the library's splitter leaves it together with."""
        kind = self.kind[points]
        new = np.unique(points[kind == _UNKNOWN]).tolist()
        if new:
            self.kind[new] = SPACE
            for mark, value in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
                parts = self.split("".join(f"{mark}{chr(c)}\n" for c in new))
                whole = {start for _, (start, end) in parts if end - start == 2 and start % 3 == 0}
                self.kind[[c for k, c in enumerate(new) if 3 * k in whole]] = value
            kind = self.kind[points]
        return kind

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes at which the words of all rows start, and which of them are added tokens."""
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        n = len(lead)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        kind = self.classes(points)
        cut = np.zeros(n + 1, bool)  # nothing is matched across these
        cut[np.searchsorted(lead, offsets)] = True
        cut[n] = True
        for a, b in self.added_spans(data, offsets):
            x, y = np.searchsorted(lead, [a, b])
            cut[[x, y]], kind[x:y] = True, ADDED
        run = cut[:n].copy()
        run[1:] |= kind[1:] != kind[:-1]
        begin = np.flatnonzero(run)
        end = np.append(begin[1:], n)
        blank = kind[begin] == SPACE
        start = run.copy()
        followed = end[blank]
        last = followed[~cut[followed]] - 1  # the last space of a run in front of a word
        start[last] = True
        start[last[points[last] == 32] + 1] = False
        # short forms: an apostrophe on its own, and the letters behind it
        i = begin[(points[begin] == 39) & (end - begin == 1) & start[begin]]
        i = i[~cut[i + 1]]
        for form in _SHORT_FORMS:
            at = i[i + len(form) < n]
            for k, letter in enumerate(form, 1):
                at = at[(points[at + k] == ord(letter)) & ~cut[at + k]]
            start[at + 1] = False
            after = at + 1 + len(form)
            after = after[after < n]
            start[after] = True
        first = np.flatnonzero(start)
        return lead[first], kind[first] == ADDED

    def added_spans(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        flat = data.tobytes()
        if not self.added or not any(t in flat for t in self.m.added):
            return []
        return [(a + x.start(), a + x.end()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for x in self.added.finditer(flat[a:b])]

    def count(self, word: bytes) -> int:
        n = count_long(self.m, word) if len(word) >= LONG else count_short(self.m, word)
        if len(word) <= CACHED_BYTES:
            if len(self.known) >= CACHED_WORDS:
                self.known.clear()
            self.known[word] = n
        return n

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each row."""
        if not len(data):
            return np.zeros(len(offsets) - 1, np.int64)
        start, added = self.words(data, offsets)
        flat, known, count = data.tobytes(), self.known, self.count
        at = [*start.tolist(), len(data)]
        sizes = np.fromiter((known.get(w) or count(w) for w in (flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True))), np.int64, len(start))
        sizes[added] = 1
        total = np.concatenate([[0], np.cumsum(sizes)])
        return np.diff(total[np.searchsorted(start, offsets)])


def count_tokens(docs: DataFrame, tokenizer_file: str, text: str = "text", limit: int = 1024, keep: Sequence[str] | None = None) -> DataFrame:
    """docs with n_bytes, n_tokens (long) and over_limit (more than `limit` tokens)."""
    made = ("n_bytes", "n_tokens", "over_limit")
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made]
    sent = docs.sparkSession.sparkContext.broadcast(load_merges(tokenizer_file))  # a few MB, by the vocabulary
    source = docs.select(*dict.fromkeys([*kept, text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(sent.value)
        for batch in batches:
            for part in pieces(batch, text):
                data, offsets = flat_bytes(part.column(text))
                n = counter.rows(data, offsets)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)],
                                                 names=[*kept, *made])

    schema = StructType([*docs.select(*kept).schema.fields, StructField("n_bytes", LongType()), StructField("n_tokens", LongType()),
                         StructField("over_limit", BooleanType())])
    return source.mapInArrow(run, schema)
