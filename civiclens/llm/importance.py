"""Importance resampling of documents towards a target distribution of hashed word n-grams.

A batch's texts are joined with sentinels that no word contains; one regular expression finds the words of all of them, the
place of each word among the documents' offsets tells its document, and runs of words that cross documents are masked before the
buckets are counted. A feature's bucket is the crc32 of its bytes. Checksums of two and three words come from those of the
words: the register after the first part is carried on over as many zero bytes as the second has, then the two are joined by
exclusive or.

The gain of a bucket compares its share in the target with its share in the documents (one added to each count); a
document's weight is the sum of its gains, and Gumbel noise of a keyed hash of its id turns the highest scores into a draw without
replacement in proportion to exp(weight / 1000).

Ranking goes by range partitions: counts of the ranges give each one's first rank, and only ranges that begin above the last drawn
rank are numbered. Counting the buckets (a row of `buckets` at most from each task) and the ranges runs while the query
is built.

Defined results. Null or empty text: no features, weight 0, never drawn. A null id is hashed as empty text and comes last among ties;
repeated rows are scored alike and ranked one after the other. Input columns are kept (or those named in `keep`); columns
with the names of results are replaced. Empty tables: all gains 0, or no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .arrays import pieces
from .shared import stored

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SENTINEL = b"\0"
_DIRECT = 256  # lengths with a table of their own
_ALL = np.uint32(0xFFFFFFFF)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Register after one byte; after 0 to _DIRECT - 1 zero bytes, and after 2**k of them, for each byte of the register."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, step >> 1 ^ np.uint32(0xEDB88320), step >> 1)
    lane = (np.arange(256, dtype=np.uint32) << np.array([0, 8, 16, 24], np.uint32)[:, None])
    direct = np.empty((_DIRECT, 4, 256), np.uint32)
    direct[0] = lane
    for k in range(1, _DIRECT):
        direct[k] = step[direct[k - 1] & 255] ^ direct[k - 1] >> 8
    power = [direct[1]]
    for _ in range(40):
        power.append(_carried(power[-1].ravel(), power[-1].ravel(), 0).reshape(4, 256))
    return step, direct.reshape(-1), np.array(power).reshape(-1)


def _carried(register: np.ndarray, tables: np.ndarray, at) -> np.ndarray:
    """Registers sent through the tables that begin at `at`."""
    return (tables[at + (register & 255)] ^ tables[at + 256 + (register >> 8 & 255)]
            ^ tables[at + 512 + (register >> 16 & 255)] ^ tables[at + 768 + (register >> 24)])


_STEP, _ZEROS, _POWERS = _tables()


def shifted(register: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Registers after so many zero bytes."""
    out = _carried(register, _ZEROS, (zeros % _DIRECT) * 1024)
    more = zeros // _DIRECT
    for k in range(int(more.max(initial=0)).bit_length()):
        on = np.flatnonzero(more >> k & 1)
        out[on] = _carried(out[on], _POWERS, (k + _DIRECT.bit_length() - 1) * 1024)
    return out


def _registers(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Register, from 0, after each word."""
    out = np.zeros(len(start), np.uint32)
    order = np.argsort(-size, kind="stable")
    long = int((size >= 64).sum())
    for k in order[:long].tolist():
        out[k] = zlib.crc32(data[start[k] : start[k] + size[k]], 0xFFFFFFFF) ^ 0xFFFFFFFF
    order = order[long:]
    begin, register, live = start[order], np.zeros(len(order), np.uint32), len(order)
    sizes = size[order]
    for j in range(int(sizes[0]) if live else 0):
        live = int(np.searchsorted(-sizes, -j, side="left"))  # words of more than j bytes come first
        now = register[:live]
        register[:live] = _STEP[(now ^ data[begin[:live] + j]) & 255] ^ now >> 8
    out[order] = register
    return out


def features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document and bucket of each feature, and the number of words of each document."""
    raw = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
    offsets = np.cumsum([0, *(len(t) + 1 for t in raw)])[:-1]
    joined = SENTINEL.join(raw).lower()
    spans = np.fromiter((x for m in WORD.finditer(joined) for x in m.span()), np.int64).reshape(-1, 2)
    start, size = spans[:, 0], spans[:, 1] - spans[:, 0]
    doc = np.searchsorted(offsets, start, side="right") - 1
    word = _registers(np.frombuffer(joined, np.uint8), start, size)
    docs, crcs = [], []
    run, length = word, size
    for k in (1, 2, 3):
        if k > 1:  # run: of k - 1 words, from each word on
            spaced = _STEP[(run[:-1] ^ np.uint32(32)) & 255] ^ run[:-1] >> 8
            run = shifted(spaced, size[k - 1 :]) ^ word[k - 1 :]
            length = length[:-1] + 1 + size[k - 1 :]
        whole = doc[: len(run)] == doc[k - 1 :]
        docs.append(doc[: len(run)][whole])
        crcs.append(run[whole] ^ shifted(np.full(int(whole.sum()), _ALL), length[whole]) ^ _ALL)
        if not len(run):
            break
    return np.concatenate(docs), (np.concatenate(crcs) % np.uint32(buckets)).astype(np.int64), np.bincount(doc, minlength=len(raw))


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = 10_000) -> DataFrame:
    """bucket, n: features in each bucket that has any."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in pieces(batch, "text"):
                total += np.bincount(features(part.column("text"), buckets)[1], minlength=buckets)
        on = np.flatnonzero(total)
        if len(on):
            yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(total[on])], names=["bucket", "n"])

    return docs.select(F.col(text).alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", buckets: int = 10_000) -> DataFrame:
    """bucket, gain: 1000 times the log ratio of its share in the target and in the documents, rounded down."""
    s, t = bucket_counts(docs, text, buckets), bucket_counts(target, target_text, buckets)
    rows = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    rows = rows.join(s.withColumnRenamed("n", "s"), "bucket", "left").join(t.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0, ["s", "t"])
    every = Window.partitionBy()  # `buckets` rows
    of = {c: F.col(c).cast("double") for c in "st"}
    total = {c: F.sum(c).over(every).cast("double") + F.lit(float(buckets)) for c in "st"}
    ratio = (of["t"] + 1.0) * total["s"] / ((of["s"] + 1.0) * total["t"])
    return rows.select("bucket", F.floor(F.log(ratio) * 1000.0).alias("gain"))


def weigh(docs: DataFrame, gain: np.ndarray, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """docs with n_words, n_features and weight."""
    made = ("n_words", "n_features", "weight")
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made]
    sent = docs.sparkSession.sparkContext.broadcast(gain)  # a number for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            for part in pieces(batch, text):
                doc, bucket, n_words = features(part.column(text), len(table))
                weight = np.bincount(doc, table[bucket], len(n_words)).astype(np.int64)  # sums below 2**53
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(n_words), pa.array(np.bincount(doc, minlength=len(n_words))),
                                                  pa.array(weight)], names=[*kept, *made])

    schema = StructType([*docs.select(*kept).schema.fields, *(StructField(c, LongType()) for c in made)])
    return docs.select(*dict.fromkeys([*kept, text])).mapInArrow(run, schema)


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = 5,
             least_words: int = 20, seed: int = 42, buckets: int = 10_000, keep: Sequence[str] | None = None) -> DataFrame:
    """docs with n_words, n_features, weight, score and rank: of the documents with `least_words` words or more, `percent` in a
    hundred with the highest scores get a rank from 1 on, the others null."""
    made = ("n_words", "n_features", "weight", "score", "rank")
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made]
    own = {c: f"_{c}_{'x' * max(map(len, docs.columns))}" for c in ("row", "range", "id")}  # longer than any column's name
    table = np.zeros(buckets, np.int64)
    for r in gains(docs, target, text, target_text, buckets).collect():  # a row for each bucket
        table[r["bucket"]] = r["gain"]
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(own["id"]).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10)
    noise = F.floor(F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)) * -1000.0)
    able = F.col("n_words") >= least_words
    rows = weigh(docs.withColumn(own["id"], F.col(doc_id)), table, text, [*kept, own["id"]]) \
        .withColumns({"score": F.col("weight") + noise, own["row"]: F.monotonically_increasing_id()})
    rows = stored(rows, "scored")  # from here on a row's number is fixed
    order = [F.desc("score"), F.asc_nulls_last(own["id"]), F.asc(own["row"])]
    pool = stored(rows.where(able).select("score", own["id"], own["row"]).repartitionByRange(*order).withColumn(own["range"], F.spark_partition_id()), "ranges")
    size = pool.groupBy(own["range"]).agg(F.count("*").alias("n"))  # a row for each partition
    before = F.coalesce(F.sum("n").over(Window.orderBy(own["range"]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    drawn = F.floor(F.sum("n").over(Window.partitionBy()) * percent / 100)
    first = size.select(own["range"], before.alias("before"), drawn.alias("drawn")).where("before < drawn")
    place = F.row_number().over(Window.partitionBy(own["range"]).orderBy(*order))
    numbered = pool.join(first, own["range"]).withColumn("rank", F.col("before") + place).where("rank <= drawn").select(own["row"], "rank")
    return rows.join(numbered, own["row"], "left").select(*kept, *made[:-1], F.col("rank").cast("long").alias("rank"))
