"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays that the
workers map into memory, used for log probabilities and perplexity.

Tokens are words [^\\x20\\x09-\\x0D]+ with A-Z lowered, then one end token a document; the context of the
first token is a start mark. With c the counts of bigrams and N1+ the number of distinct neighbours:

  P(w | u) = max(c(uw) - D(c), 0) / c(u) + gamma(u) Pc(w)        (Pc(w) alone for a context never seen)
  Pc(w)    = max(N1+(.w) - D'(N1+), 0) / N1+(..) + gamma' / (V + 1)

with three discounts per level from the counts of counts (1, 2, 3 and more), gamma the mass they free,
V the distinct tokens, and one place of the uniform part for unknown words. Sums over the vocabulary
and the unknown word are 1.

Building: (1) words are counted in each task and meet in hash ranges; each range becomes a sorted array
of 64-bit word hashes with counts, and a word's id is its place in them. (2) Bigrams of ids are counted
in each task and meet by context; a context with more than HOT_SHARE of a range's tokens is dealt out
by its second word, and its sums are added up afterwards. Each range becomes a sorted array of bigram
hashes with counts. (3) The distinct contexts of each word are added up by word. Counts travel as sorted,
delta-coded, compressed arrays, combined before each shuffle. No count is pruned. The number of ranges
follows from the bytes of the corpus, so that a task holds RANGE_BYTES of text in counts, whatever the
input. The files lie in the folder that all executors share; each is written under a name of its own and
then renamed, so a repeated task replaces it with the same content.

Defined results. Null or empty texts have one token, the end. Without training documents c, N and V are
0: the base score is that of log10(1/1) a token, and every word has probability 1 / (V + 1) = 1. Repeated
rows are counted and scored as rows of their own. An empty table gives an empty result. Extra columns
are kept by `score`; columns with the names of its results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .arrays import U64, flat_bytes, mix, pieces, word_hashes
from .hash_arrays import RANGE_BYTES, SENT, batch_of, mapped, merged, range_of, send, summed, write
from .shared import scratch, stored

HOT_SHARE = 0.125
HELD = 4 << 20  # counts that a task gathers before it sends them on
_END = U64(0x454E44)


@dataclass
class Model:
    folder: str
    ranges: int
    sizes: np.ndarray  # distinct words of each range; a word's id counts through the ranges
    tokens: int  # N
    documents: int
    discounts: np.ndarray = field(default_factory=lambda: np.zeros(4))  # by min(count, 3)
    lower: np.ndarray = field(default_factory=lambda: np.zeros(4))
    continuations: int = 0  # N1+(..)
    freed: float = 1.0  # gamma'
    filled: frozenset = frozenset()  # ranges that hold bigrams
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    hot_n: np.ndarray = field(default_factory=lambda: np.zeros((0, 3), np.int64))

    @property
    def types(self) -> int:
        return int(self.sizes.sum())

    @property
    def start(self) -> int:
        """Id of the start mark, after all words."""
        return self.types

    def by_range(self, wanted: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(self.ranges + 1))
        for b in range(self.ranges):
            if cut[b] < cut[b + 1]:
                yield b, order[cut[b] : cut[b + 1]]

    def words(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of word hashes, -1 for unknown ones."""
        out = np.full(len(hashes), -1, np.int64)
        base = np.concatenate([[0], np.cumsum(self.sizes)])
        for b, at in self.by_range(hashes, range_of(hashes, self.ranges)):
            if self.sizes[b]:
                have, want = mapped(self.folder, f"word-{b}"), hashes[at]
                place = np.minimum(np.searchsorted(have, want), len(have) - 1)
                out[at] = np.where(have[place] == want, base[b] + place, -1)
        return out

    def gather(self, name: str, ids: np.ndarray) -> np.ndarray:
        """Values of an array aligned with the words, for known ids."""
        base = np.concatenate([[0], np.cumsum(self.sizes)])
        bucket = np.searchsorted(base, ids, side="right") - 1
        out = None
        for b, at in self.by_range(ids, bucket):
            values = mapped(self.folder, f"{name}-{b}")[ids[at] - base[b]]
            if out is None:
                out = np.zeros((len(ids), *values.shape[1:]), values.dtype)
            out[at] = values
        return np.zeros(len(ids), np.int64) if out is None else out


def _bigram_range(model: Model, u: np.ndarray, w: np.ndarray, busy: np.ndarray) -> np.ndarray:
    """By context, or by second word for contexts in many bigrams."""
    key = np.where(busy, mix(w.astype(np.uint64) + U64(1 << 40)), mix(u.astype(np.uint64)))
    return range_of(key, model.ranges)


def _busy(model: Model, counts: np.ndarray) -> np.ndarray:
    return counts > max(1000.0, HOT_SHARE * model.tokens / model.ranges)


def _bigrams(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens with the end of each row, which of them begin a row, and the n + 1 offsets."""
    at = rows + np.arange(len(rows))
    out = np.full(at[-1], _END, np.uint64)
    place = np.arange(len(h)) + np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    out[place] = h
    first = np.zeros(at[-1], bool)
    first[at[:-1]] = True
    return out, first, at


# -- building

def train(docs: DataFrame, text: str = "text", range_bytes: int = RANGE_BYTES) -> Model:
    """Count all rows of docs into a model. Null texts are empty."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    size, n = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    folder, ranges = scratch(spark, "kneser-ney"), max(1, -(-size // range_bytes))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in _gathered(batches, lambda h, first: h):
            yield batch_of(list(send("word", keys, counts, range_of(keys, ranges))))

    def keep_words(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys, counts = merged(rows)
        write(folder, f"word-{key[0]}", keys)
        write(folder, f"count-{key[0]}", counts)
        return pd.DataFrame({"bucket": [key[0]], "types": [len(keys)], "tokens": [int(counts.sum())]})

    got = rows.mapInArrow(count_words, SENT).groupBy("bucket").applyInPandas(keep_words, "bucket int, types long, tokens long").collect()
    sizes = np.zeros(ranges, np.int64)
    for r in got:
        sizes[r["bucket"]] = r["types"]
    model = Model(folder, ranges, sizes, sum(r["tokens"] for r in got), n)
    if not n:
        return model
    known = spark.sparkContext.broadcast(model)

    def count_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value

        def of(h: np.ndarray, first: np.ndarray) -> np.ndarray:
            w = m.words(h)
            u = np.concatenate([[m.start], w[:-1]])
            u[first] = m.start
            return u.astype(np.uint64) << U64(32) | w.astype(np.uint64)

        for keys, counts in _gathered(batches, of):
            u, w = (keys >> U64(32)).astype(np.int64), (keys & U64(0xFFFFFFFF)).astype(np.int64)
            yield batch_of(list(send("bigram", keys, counts, _bigram_range(m, u, w, _busy(m, _context_counts(m, u))))))

    def keep_bigrams(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        m, b = known.value, key[0]
        keys, counts = merged(rows)
        u, w = (keys >> U64(32)).astype(np.int64), (keys & U64(0xFFFFFFFF)).astype(np.int64)
        hashed = mix(keys)
        order = np.argsort(hashed)
        write(folder, f"bigram-{b}", hashed[order])
        write(folder, f"bigram_count-{b}", counts[order].astype(np.uint32))
        times = np.minimum(counts, 3)
        first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
        n123 = np.stack([np.add.reduceat((times == k).astype(np.int64), first) for k in (1, 2, 3)], axis=1)
        contexts = u[first]
        busy = _busy(m, _context_counts(m, contexts))
        out = []
        # the contexts' own numbers go to the ranges of their words, as counts of three kinds
        base = np.concatenate([[0], np.cumsum(m.sizes)])
        for k in (1, 2, 3):
            have = ~busy & (n123[:, k - 1] > 0) & (contexts < m.start)
            ids = contexts[have]
            out += send(f"n{k}", ids.astype(np.uint64), n123[have, k - 1], np.searchsorted(base, ids, side="right") - 1)
        for i in np.flatnonzero(busy | (contexts == m.start)):
            out.append((-1, "hot", int(contexts[i]), np.array(n123[i], np.int64).tobytes()))
        ids, distinct = summed(np.sort(w.astype(np.uint64)))
        out += send("left", ids, distinct, np.searchsorted(base, ids.astype(np.int64), side="right") - 1)
        out.append((-1, "times", b, np.bincount(np.minimum(counts, 5), minlength=6).astype(np.int64).tobytes()))
        return pd.DataFrame(out, columns=["bucket", "kind", "size", "blob"])

    parts = stored(rows.mapInArrow(count_bigrams, SENT).groupBy("bucket").applyInPandas(keep_bigrams, SENT), "bigram-parts")

    def keep_left(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        m, b = known.value, key[0]
        base = int(m.sizes[:b].sum())
        columns = np.zeros((int(m.sizes[b]), 4), np.uint32)
        for j, kind in enumerate(("left", "n1", "n2", "n3")):
            ids, counts = merged(rows[rows["kind"] == kind])
            columns[ids.astype(np.int64) - base, j] = counts
        write(folder, f"left-{b}", np.ascontiguousarray(columns[:, 0]))
        write(folder, f"after-{b}", np.ascontiguousarray(columns[:, 1:]))
        times = np.bincount(np.minimum(columns[:, 0], 5), minlength=6)
        return pd.DataFrame({"bucket": [b], "kind": ["left"], "size": [int(columns[:, 0].sum(dtype=np.int64))],
                             "blob": [times.astype(np.int64).tobytes()]})

    lower = parts.where("bucket >= 0").groupBy("bucket").applyInPandas(keep_left, SENT).collect()
    few = parts.where("bucket < 0").collect()  # a row for each range, and the parts of busy contexts
    times = sum(np.frombuffer(r["blob"], np.int64) for r in few if r["kind"] == "times")
    model.filled = frozenset(r["size"] for r in few if r["kind"] == "times")
    model.discounts = _discounts(times)
    left = sum(np.frombuffer(r["blob"], np.int64) for r in lower)
    model.lower = _discounts(left)
    model.continuations = sum(r["size"] for r in lower)
    over = np.array([left[1], left[2], left[3:].sum()])
    model.freed = float((model.lower[1:] * over).sum() / model.continuations)
    hot: dict[int, np.ndarray] = {}
    for r in few:
        if r["kind"] == "hot":
            hot[r["size"]] = hot.get(r["size"], 0) + np.frombuffer(r["blob"], np.int64)
    model.hot = np.array(sorted(hot), np.int64)
    model.hot_n = np.array([hot[u] for u in sorted(hot)], np.int64).reshape(-1, 3)
    return model


def _gathered(batches: Iterator[pa.RecordBatch], of) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct keys of the rows' tokens and their counts, combined as far as HELD allows."""
    held, total = [], 0
    for batch in batches:
        for part in pieces(batch, "text"):
            h, first, _ = _bigrams(*word_hashes(*flat_bytes(part.column("text"))))
            held.append(summed(of(h, first)))
            total += len(held[-1][0])
            if total > HELD:
                held = [summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))]
                if (total := len(held[0][0])) > HELD // 2:
                    yield held[0]
                    held, total = [], 0
    if held:
        yield summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))


def _context_counts(model: Model, u: np.ndarray) -> np.ndarray:
    """How often each context precedes a token: as often as it stands, or once a document for the start."""
    distinct, inverse = np.unique(u, return_inverse=True)
    out = np.full(len(distinct), model.documents, np.int64)
    words = (distinct >= 0) & (distinct < model.start)
    out[words] = model.gather("count", distinct[words])
    out[distinct < 0] = 0
    return out[inverse]


def _discounts(times: np.ndarray) -> np.ndarray:
    """D by min(count, 3), from the counts of counts; 0.5 a step where a count of counts is missing."""
    n = times.astype(float)
    y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] > 0 else 0.5
    out = [0.0]
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k + 1] / n[k] if n[k] > 0 else k * 0.5
        out.append(min(max(d, 0.05), k - 0.05))
    return np.array(out)


# -- scoring

def log_probabilities(model: Model, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 P of each token in its context, and its count in training."""
    words, inverse = np.unique(h, return_inverse=True)
    ids = model.words(words)
    known = ids >= 0
    count, left = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    n123 = np.zeros((len(words) + 1, 3), np.int64)
    if known.any():
        count[known] = model.gather("count", ids[known])
        left[known] = model.gather("left", ids[known])
        n123[:-1][known] = model.gather("after", ids[known])
    uniform = model.freed / (model.types + 1)
    lower = uniform + np.maximum(left - model.lower[np.minimum(left, 3)], 0) / max(1, model.continuations)
    # contexts: the words of this batch, and the start as a last one
    ctx_id, ctx_count = np.append(ids, model.start), np.append(count, model.documents)
    if len(model.hot):
        place = np.minimum(np.searchsorted(model.hot, ctx_id), len(model.hot) - 1)
        is_hot = model.hot[place] == ctx_id
        n123[is_hot] = model.hot_n[place[is_hot]]
    freed = np.where(ctx_count > 0, (n123 * model.discounts[1:]).sum(axis=1) / np.maximum(ctx_count, 1), 1.0)
    w = inverse
    u = np.concatenate([[len(words)], w[:-1]])
    u[first] = len(words)
    pairs, back = np.unique(u.astype(np.int64) * (len(words) + 1) + w, return_inverse=True)
    pu, pw = pairs // (len(words) + 1), pairs % (len(words) + 1)
    p = freed[pu] * lower[pw]
    seen = np.flatnonzero((ctx_id[pu] >= 0) & (ctx_count[pu] > 0) & known[pw])
    if len(seen):
        a, b = ctx_id[pu[seen]], ids[pw[seen]]
        hashed = mix(a.astype(np.uint64) << U64(32) | b.astype(np.uint64))
        for r, at in model.by_range(hashed, _bigram_range(model, a, b, _busy(model, ctx_count[pu[seen]]))):
            if r not in model.filled:
                continue
            have = mapped(model.folder, f"bigram-{r}")
            at = at[np.argsort(hashed[at])]
            place = np.minimum(np.searchsorted(have, hashed[at]), len(have) - 1)
            hit = have[place] == hashed[at]
            c = mapped(model.folder, f"bigram_count-{r}")[place[hit]].astype(np.int64)
            where = seen[at[hit]]
            p[where] += np.maximum(c - model.discounts[np.minimum(c, 3)], 0) / ctx_count[pu[where]]
    return np.log10(p)[back], count[inverse]


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score (add-one unigram), score (log10 probability of
    the text) and perplexity."""
    made = [("n_tokens", LongType()), ("n_known", LongType()), ("train_tokens", LongType()), ("base_score", DoubleType()),
            ("score", DoubleType()), ("perplexity", DoubleType())]
    kept = [c for c in docs.columns if c.lower() not in {"_text", *(n for n, _ in made)}]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for part in pieces(batch, "_text"):
                h, first, at = _bigrams(*word_hashes(*flat_bytes(part.column("_text"))))
                logp, count = log_probabilities(m, h, first)
                base = np.log10((count + 1) / (m.tokens + m.types + 1))
                total = np.add.reduceat(logp, at[:-1])
                n = np.diff(at)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), pa.array(n), pa.array(np.add.reduceat((count > 0).astype(np.int64), at[:-1])),
                     pa.array(np.full(len(n), m.tokens, np.int64)), pa.array(np.add.reduceat(base, at[:-1])), pa.array(total),
                     pa.array(10 ** (-total / n))], names=[*kept, *(n for n, _ in made)])

    schema = StructType([*docs.select(*kept).schema.fields, *(StructField(n, t) for n, t in made)])
    return docs.select(*kept, F.col(text).alias("_text")).mapInArrow(run, schema)
