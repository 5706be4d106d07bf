"""Phrase collocations from a weighted de Bruijn graph, per language.

A piece (text between punctuation or line ends) is a walk: its edges are its runs of `longest` words, each leading from
the node of its first longest - 1 words to the node of its last. Walks, not edges, are sent first: equal walks are summed, so a
path that many documents share is one entry with a weight, however many edges it has. Then each distinct walk is opened into
its edges and, for the last words of the walk, the shorter runs that end there. Edges are summed over walks. The count
of a shorter phrase is the flow out of its node (the weights of the edges that start with it) plus the piece-end
corrections that start with it; the flow of the empty phrase is the number of words.

Walks are cut where they can't matter: a phrase is a candidate from `least` occurrences on, so no candidate, nor any part
of one, holds two neighbours or three words in a row that occur together less often. Between two such neighbours a walk ends;
at such three words it ends behind the second and the next one begins with that word, whose second count is taken back by a
correction of -1. Words that occur less often and stand alone only add to the number of words. Words, neighbours and then threes
are counted in hashed slots first; a slot's sum is never less than the count of anything in it, so collisions only leave a
cut out. Counts of all phrases that occur `least` times are exact. What is left of the graph has few branches: unary paths
between junctions are single entries.

Scores are exact: products are decimals of 38 digits (counts up to 10**17).

Memory: 1 MB of text at a time, GATHERED distinct slots or WALKS distinct walks in a task, two sets of slot flags (a bit for each 64 to 128
bytes of text, MOST_SLOTS bits at most: 256 MB each; beyond 250 GB of text the flags cut less and more edges are sent, with the same result).

Defined results. Null text: no words. Null language: `und`. Repeated rows count each time. Words are kept as they are but for
A-Z. Columns other than lang and text are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .arrays import LOWER, U64, flat_bytes, mix, pieces, range_hashes
from .hash_arrays import GATHERED, RANGE_BYTES, SENT, batch_of, merged, send, summed
from .shared import stored

MOST_SLOTS = 1 << 31
WALKS = 200_000  # distinct walks that a task gathers before it sends them on
BUCKET_BYTES = 32 << 20  # bytes of text whose walks make up a bucket
_END = np.zeros(256, bool)  # a byte that ends a piece
_END[list(b".,;:!?\n\v\f\r")] = True
_GAP = _END.copy()
_GAP[[0x20, 0x09]] = True


class Pieces:
    """Words of a batch and where their pieces end."""

    def __init__(self, part: pa.RecordBatch):
        raw, offsets = flat_bytes(part.column("text"))
        self.data = data = LOWER[raw]
        solid = ~_GAP[data]
        row_start = np.zeros(len(data) + 1, bool)
        row_start[offsets] = True
        before = np.concatenate([[False], solid[:-1]])[: len(data)] & ~row_start[:-1]
        after = np.concatenate([solid[1:], [False]])[: len(data)] & ~row_start[1:]
        self.start, self.end = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        self.hash = range_hashes(data, self.start, self.end)
        ends = np.concatenate([[0], np.cumsum(_END[data])])
        self.joined = (self.row[1:] == self.row[:-1]) & (ends[self.start[1:]] == ends[self.end[:-1]])  # with the next word
        langs = part.column("lang").dictionary_encode()
        self.lang_of_row, self.langs = langs.indices.to_numpy(zero_copy_only=False), langs.dictionary.to_pylist()

    def slots(self, words: int, n: int, at: np.ndarray) -> np.ndarray:
        """Slots, of n, of the runs of so many words that begin at the words `at`."""
        own = mix(np.array([int.from_bytes(lang.encode()[:64], "little") % (1 << 61) + words for lang in self.langs] or [0], np.uint64))
        with np.errstate(over="ignore"):
            run = own[self.lang_of_row[self.row[at]]]
            for k in range(words):
                run = mix(run * U64(0x9E3779B97F4A7C15) + self.hash[at + k])
        return run >> U64(64 - (n.bit_length() - 1))

    def pairs(self) -> np.ndarray:
        return np.flatnonzero(self.joined)

    def threes(self, flags: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
        """Flag of each word with the next one, and the words that begin three in a row all of whose neighbours are flagged."""
        on, at = np.zeros(len(self.joined), bool), self.pairs()
        on[at] = flagged(flags, self.slots(2, slots, at))
        return on, np.flatnonzero(on[:-1] & on[1:])

    def walks(self, flags: np.ndarray, flags3: np.ndarray, slots: int) -> tuple[list, list]:
        """(language, words) of all walks, '' for each word that only counts; of all words that were counted twice."""
        if not len(self.start):
            return [], []
        on, three = self.threes(flags, slots)
        twice = three[~flagged(flags3, self.slots(3, slots, three))] + 1
        own = np.flatnonzero(np.concatenate([[True], ~on]))
        first = np.sort(np.concatenate([own, twice]))
        last = np.sort(np.concatenate([own[1:] - 1, [len(self.start) - 1], twice]))
        plain = np.concatenate([(self.start[1:] == self.end[:-1] + 1) & (self.data[np.minimum(self.end[:-1], len(self.data) - 1)] == 32) | ~on, [True]])
        wide = np.concatenate([[0], np.cumsum(~plain)])
        odd = wide[last] > wide[first]  # not just one space between words
        rare = first == last
        rare[rare] = ~flagged(flags, self.slots(1, slots, first[rare]))
        end = np.where(rare, self.start[first], self.end[last])
        flat, names = self.data.tobytes(), self.langs
        lang = self.lang_of_row[self.row]
        found = [(names[k], b" ".join(flat[a:b].split()) if o else flat[a:b])
                 for a, b, k, o in zip(self.start[first].tolist(), end.tolist(), lang[first].tolist(), odd.tolist(), strict=True)]
        return found, [(names[k], flat[a:b]) for a, b, k in zip(self.start[twice].tolist(), self.end[twice].tolist(), lang[twice].tolist(), strict=True)]


def flagged(flags: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (flags[(slots >> U64(3)).astype(np.int64)] >> (7 - (slots & U64(7))).astype(np.uint8) & 1).astype(bool)


def frequent_slots(docs: DataFrame, slots: int, least: int, flags: np.ndarray | None = None) -> np.ndarray:
    """A bit for each slot whose words and neighbours (with flags: threes of flagged neighbours) occur `least` times or more in all."""
    ranges = max(8, min(slots >> 10, 1 << max(0, (slots * 128 // RANGE_BYTES)).bit_length()))
    width = slots // ranges
    sent = docs.sparkSession.sparkContext.broadcast(flags)

    def packed(held: list) -> pa.RecordBatch:
        keys, counts = summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
        return batch_of(list(send("slot", keys, counts, (keys // U64(width)).astype(np.int64))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            for part in pieces(batch, "text"):
                found = Pieces(part)
                if sent.value is None:
                    keys = np.concatenate([found.slots(1, slots, np.arange(len(found.start))), found.slots(2, slots, found.pairs())])
                else:
                    keys = found.slots(3, slots, found.threes(sent.value, slots)[1])
                if len(keys):
                    held.append(summed(keys))
                    total += len(held[-1][0])
                if total > GATHERED:
                    yield packed(held)
                    held, total = [], 0
        if held:
            yield packed(held)

    def flag(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        keys, counts = merged(parts)
        on = np.zeros(width, bool)
        on[(keys[counts >= least] - U64(key[0] * width)).astype(np.int64)] = True
        return pd.DataFrame({"bucket": [key[0]], "flags": [np.packbits(on).tobytes()]})

    out = np.zeros(slots // 8, np.uint8)
    rows = docs.mapInArrow(count, SENT).groupBy("bucket").applyInPandas(flag, "bucket int, flags binary")
    for r in rows.collect():  # slots / 8 bytes in all
        out[r["bucket"] * width // 8 : (r["bucket"] + 1) * width // 8] = np.frombuffer(r["flags"], np.uint8)
    return out


def walks(docs: DataFrame, flags: np.ndarray, flags3: np.ndarray, slots: int) -> DataFrame:
    """lang, walk (words joined by one space) and its number of occurrences, less what is counted twice. Tasks send packed walks by bucket."""
    sent = docs.sparkSession.sparkContext.broadcast((flags, flags3))
    buckets = max(8, slots * 128 // BUCKET_BYTES)

    def packed(held: Counter) -> pa.RecordBatch:
        parts: dict[tuple[str, int], list] = {}
        for key in sorted(held):
            parts.setdefault((key[0], zlib.crc32(key[1]) % buckets), []).append(key)
        rows = [(lang, bucket, _zip(b"\n".join(walk for _, walk in keys)), _zip(np.array([held[k] for k in keys]).tobytes())) for (lang, bucket), keys in parts.items()]
        kinds = {"lang": pa.string(), "bucket": pa.int32(), "walks": pa.binary(), "n": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for rows in batches:
            for part in pieces(rows, "text"):
                found, twice = Pieces(part).walks(*sent.value, slots)
                held.update(found)
                held.subtract(twice)
                if len(held) > WALKS:
                    yield packed(held)
                    held = Counter()
        if held:
            yield packed(held)

    def joined(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total: Counter = Counter()
        for walk, n in zip(rows["walks"], rows["n"], strict=True):
            for w, k in zip(zlib.decompress(walk).split(b"\n"), np.frombuffer(zlib.decompress(n), np.int64).tolist(), strict=True):
                total[w] += k
        return pd.DataFrame({"lang": key[0], "walk": [w.decode() for w in total], "n": list(total.values())})

    return docs.mapInArrow(run, "lang string, bucket int, walks binary, n binary").groupBy("lang", "bucket").applyInPandas(joined, "lang string, walk string, n long")


def _zip(data: bytes) -> bytes:
    return zlib.compress(data, 1)


def phrase_counts(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = 5, least: int = 100) -> DataFrame:
    """lang, words (number), phrase, n of all phrases of 1 to `longest` words that occur `least` times or more, and the
    empty phrase with the number of words of each language. Written to the shared folder."""
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slots = min(MOST_SLOTS, max(1 << 16, 1 << (size // 128).bit_length()))
    flags = frequent_slots(docs, slots, least)
    flags3 = frequent_slots(docs, slots, least, flags)
    words = F.split("walk", " ")
    edge = F.explode(F.transform(F.sequence(F.lit(1), F.size("words")), lambda i: F.slice("words", i, longest))).alias("edge")
    edges = (walks(docs, flags, flags3, slots).select("lang", words.alias("words"), "n").select("lang", edge, "n")
             .groupBy("lang", F.array_join("edge", " ").alias("edge")).agg(F.sum("n").alias("n")).select("lang", F.split("edge", " ").alias("edge"), "n"))
    start = F.explode(F.transform(F.sequence(F.lit(0), F.size("edge")), lambda k: F.struct(k.alias("words"), F.array_join(F.slice("edge", 1, k), " ").alias("phrase"))))
    flow = edges.select("lang", start.alias("node"), "n").groupBy("lang", "node.words", "node.phrase").agg(F.sum("n").alias("n"))
    return stored(flow.where((F.col("words") == 0) | (F.col("n") >= least) & (F.col("phrase") != "")), "phrases")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = 5, least: int = 100) -> DataFrame:
    """lang, phrase, words, a, l, r, n, score of all candidates that no longer one makes needless: a counts the phrase, l and r the two
    sides of its lowest-scoring cut, n the language's words."""
    counts = phrase_counts(docs, lang, text, longest, least)
    total = counts.where("words = 0").select("lang", F.col("n").alias("total"))
    found = counts.where("words >= 2").select("lang", "phrase", "words", F.col("n").alias("a"))
    part = F.split("phrase", " ")
    without = [F.array_join(F.slice(part, 1, F.size(part) - 1), " "), F.array_join(F.slice(part, 2, F.size(part) - 1), " ")]
    covered = found.where("words > 2").select("lang", F.explode(F.array(*without)).alias("phrase"), "a").distinct()
    kept = found.join(covered, ["lang", "phrase", "a"], "left_anti")

    cut = F.explode(F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(
        k.alias("k"), F.array_join(F.slice(part, 1, k), " ").alias("first"), F.array_join(F.slice(part, k + 1, longest), " ").alias("rest"))))
    cuts = kept.select("lang", "phrase", "words", "a", cut.alias("cut")).select("lang", "phrase", "words", "a", "cut.*")
    sides = counts.where("words >= 1")
    for name, count in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(sides.select("lang", F.col("phrase").alias(name), F.col("n").alias(count)), ["lang", name])
    cuts = cuts.join(total, "lang")
    score = F.expr("1000BD * a * total div (cast(l as decimal(19, 0)) * r)").alias("score")
    best = cuts.select("lang", "phrase", "words", "a", "total", F.struct(score, "k", "l", "r").alias("cut")) \
        .groupBy("lang", "phrase", "words", "a", "total").agg(F.min("cut").alias("cut"))
    return best.select("lang", "phrase", "words", "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")


def top_collocations(docs: DataFrame, most: int = 2000, **options) -> DataFrame:
    """The first `most` of each language by score, then count (both descending), then phrase; Spark limits each task to as many before the shuffle."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = collocations(docs, **options).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
