"""The features of GeoJSON files, found by byte ranges.

A feature collection is one JSON value, often on one line, so Spark's reader gives each file to one task. Here a file is read
as text cut at closing braces, which Spark splits by byte ranges like lines. Where a split lies in the value depends on what
is before it: the number of quotes (is it inside a string?) and of brackets outside strings (how deep is it?).

1. one pass scans each split for both cases, beginning inside a string or not: its quotes modulo 2, and the
   depth it ends at above the one it begins at;
2. prefix sums over a file's splits choose the case of each and give the depth it begins at;
3. each task hands out the objects of depth 3 in its splits: the elements of arrays in the root object. Pieces of
   objects that go on beyond a split are picked up by a second pass over just those splits, and put together.

The table of splits (a row for each) is written once and broadcast. A split's text is scanned in numpy,
batch by batch; nothing is decoded before a whole feature is there."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civiclens.tables import stored

_WHOLE, _OPENS, _INSIDE, _CLOSES = range(4)
DEPTH = 3  # root object, array of features, feature
_STEP = np.zeros(256, np.int8)
_STEP[list(b"{[")] = 1
_STEP[list(b"}]")] = -1
_BACKSLASH, _QUOTE, _OPEN = 92, 34, 123


def _chunks(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """chunk (text up to a closing brace, without it), file, start (of the split)."""
    text = spark.read.option("lineSep", "}").text(path)
    return text.select(F.col("value").alias("chunk"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _quotes(data: np.ndarray) -> np.ndarray:
    """Which bytes are quotes that begin or end a string. No escape reaches over a closing brace."""
    quote = data == _QUOTE
    slash = data == _BACKSLASH
    if not slash.any():
        return quote
    at = np.arange(len(data))
    run = at - np.maximum.accumulate(np.where(slash, -1, at))  # backslashes in a row up to here
    escaped = np.concatenate([[False], run[:-1] % 2 == 1])
    return quote & ~escaped


def _by_split(batches: Iterator[pa.RecordBatch], *also: str) -> Iterator[tuple]:
    """Text of a batch and split, file, start and the values of other columns of the split's table."""
    for part in batches:
        if not part.num_rows:
            continue
        start, code = part.column("start").to_numpy(), part.column("file").dictionary_encode().indices.to_numpy()
        cut = [0, *(np.flatnonzero((np.diff(start) != 0) | (np.diff(code) != 0)) + 1).tolist(), part.num_rows]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            chunks = part.column("chunk").slice(a, b - a).cast(pa.binary()).to_pylist()
            yield np.frombuffer(b"}".join([*chunks, b""]), np.uint8), *(part.column(c)[a].as_py() for c in ("file", "start", *also))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split, for a beginning outside and inside a string: quotes modulo 2, change of depth, lowest depth on the way."""
    key, inside, change, low = None, 0, [0, 0], [0, 0]

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pandas(pd.DataFrame([[*key, inside, *change, *low]], columns=["file", "start", "quotes", "outer", "inner", "low_outer", "low_inner"]))

    for data, *split in _by_split(batches):
        if split != key:
            if key:
                yield row()
            key, inside, change, low = split, 0, [0, 0], [0, 0]
        within = (inside + np.cumsum(_quotes(data))) & 1
        for case in (0, 1):
            depth = change[case] + np.cumsum(np.where(within == case, _STEP[data], 0))
            change[case], low[case] = int(depth[-1]), min(low[case], int(depth.min()))
        inside = int(within[-1])
    if key:
        yield row()


def splits(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Of each split: file, start, begins (inside a string), depth and after (the depths it begins and ends at), since (the split
    in which the object that it begins in was opened)."""
    each = _chunks(spark, path).mapInArrow(_scan, "file string, start long, quotes long, outer long, inner long, low_outer long, low_inner long")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("begins", F.pmod(F.coalesce(F.sum("quotes").over(before), F.lit(0)), F.lit(2)))
    case = lambda x: F.when(F.col("begins") == 0, F.col(f"{x}outer")).otherwise(F.col(f"{x}inner"))
    each = each.withColumns({"change": case(""), "low": case("low_")})
    each = each.withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0))).withColumn("after", F.col("depth") + F.col("change"))
    opens = F.when((F.col("after") >= DEPTH) & (F.col("depth") + F.col("low") < DEPTH), F.col("start"))
    return each.select("file", "start", "begins", "depth", "after", F.last(opens, ignorenulls=True).over(before).alias("since"))


class _Scanner:
    """Hands out the objects of one split after the other."""

    def __init__(self) -> None:
        self.split, self.held, self.kind = None, [], _WHOLE

    def finish(self) -> list[tuple]:
        out = [(b"".join(self.held), _INSIDE if self.kind == _CLOSES else _OPENS, *self.split)] if self.held else []
        self.held = []
        return out

    def take(self, data: np.ndarray, split: list, begins: int, depth: int) -> list[tuple]:
        rows = []
        if split != self.split:
            rows += self.finish()
            self.split, self.inside, self.depth = split, begins, depth
            self.kind = _CLOSES if depth >= DEPTH else _WHOLE
            self.open = depth >= DEPTH
        within = (self.inside + np.cumsum(_quotes(data))) & 1
        step = np.where(within == 0, _STEP[data], 0)
        depth_after = self.depth + np.cumsum(step)
        self.inside, self.depth = int(within[-1]), int(depth_after[-1])
        starts = np.flatnonzero((step == 1) & (depth_after == DEPTH) & (data == _OPEN))
        ends = np.flatnonzero((step == -1) & (depth_after == DEPTH - 1)) + 1
        flat, at = data.tobytes(), 0
        if self.open:  # goes on from before
            if not len(ends):
                self.held.append(flat)
                return rows
            rows.append((b"".join([*self.held, flat[: ends[0]]]), self.kind, *self.split))
            self.held, self.kind, self.open, at = [], _WHOLE, False, int(ends[0])
        for a in starts[starts >= at].tolist():
            k = int(np.searchsorted(ends, a))
            if k == len(ends):
                self.held, self.open = [flat[a:]], True
            else:
                rows.append((flat[a : ends[k]], _WHOLE, *self.split))
        return rows


def _objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = _Scanner()

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"text": pa.binary(), "kind": pa.int32(), "file": pa.string(), "start": pa.int64(), "since": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

    for data, file, start, begins, depth, since in _by_split(batches, "begins", "depth", "since"):
        if rows := scanner.take(data, [file, start, since], begins, depth):
            yield batch(rows)
    if rows := scanner.finish():
        yield batch(rows)


def objects(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """text: every object at depth 3. The table of splits is made while the query is built."""
    table = stored(splits(spark, path), "splits")

    def pieces(which: DataFrame) -> DataFrame:
        chunks = _chunks(spark, path).join(F.broadcast(which), ["file", "start"])  # a row for each split
        return chunks.select("chunk", "file", "start", "begins", "depth", "since").mapInArrow(_objects, "text binary, kind int, file string, start long, since long")

    whole = pieces(table).where(F.col("kind") == _WHOLE).select("text")
    broken = pieces(table.where(f"depth >= {DEPTH} or after >= {DEPTH}")).where(F.col("kind") != _WHOLE)
    opened = F.when(F.col("kind") == _OPENS, F.col("start")).otherwise(F.col("since"))
    sewn = broken.groupBy("file", opened.alias("opened")).agg(F.sort_array(F.collect_list(F.struct("start", "text"))).alias("parts"))
    joined = F.aggregate("parts", F.lit("").cast("binary"), lambda acc, x: F.concat(acc, x["text"]))
    return whole.unionByName(sewn.select(joined.alias("text"))).select(F.decode("text", "utf-8").alias("text"))


def head(spark: SparkSession, path: str | Sequence[str], chunks: int = 4) -> str:
    """The beginning of the first file: text up to the closing brace of that number."""
    rows = _chunks(spark, path).where("start = 0").limit(chunks).collect()
    return "}".join(r["chunk"] for r in rows)
