"""CSV files with line feeds inside quotes, read by byte ranges.

Spark's `multiLine` reader gives a whole file to one task. Here every split of a file is a partition
of its own. Whether a split begins inside a quoted field depends on the number of quotes before it, so

1. one pass counts the quotes of each split (a partial aggregate; a doubled quote counts two and changes
   nothing) and keeps each file's first line;
2. prefix sums over a file's splits, modulo 2, tell which splits begin or end inside a record;
3. each task joins the lines of its splits to records, in order and without a shuffle. The pieces of
   records that go on beyond a split are picked up by a second pass over just those
   splits, and put together per record.

The table of splits (a row for each, path and two flags) is written once and broadcast; nothing else is gathered.
Columns are found by the header of each file, whatever their order there.

Needs quotes as RFC 4180 has them: a field with quotes, separators or line feeds is quoted, and quotes in
it are doubled. A file with an odd number of quotes is refused; read such files with `split=False`."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civiclens.tables import stored

_WHOLE, _OPENS, _INSIDE, _CLOSES = range(4)  # what a row of text is: a record, or where it lies in one
_ROWS = "text string, kind int, file string, start long, since long, header string"
#: Options of both readers: only doubled quotes are escapes.
OPTIONS = {"escape": '"', "multiLine": "true"}
MOST_HEADERS = 100  # different first lines that the files of one read may have


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """line, file, start (of the split) and quotes: the rows of a split keep their order in its task."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                       (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"))


def splits(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Of each split that has lines: file, start, the file's header, begins and ends (inside a record, 0 or 1), since (where the
    record that it begins in was opened) and odd (the file's quotes modulo 2)."""
    lines = _lines(spark, path).withColumn("nth", F.monotonically_increasing_id())  # grows in the order of the lines of a split
    each = lines.groupBy("file", "start").agg(F.sum("quotes").alias("quotes"), F.max(F.pmod("quotes", F.lit(2))).alias("turns"),
                                              F.min_by(F.when(F.col("start") == 0, F.col("line")), "nth").alias("first"))
    by_file, every = Window.partitionBy("file").orderBy("start"), Window.partitionBy("file")
    two = F.lit(2)
    each = each.withColumns({"total": F.sum("quotes").over(by_file), "header": F.max("first").over(every), "odd": F.pmod(F.sum("quotes").over(every), two)})
    each = each.withColumns({"begins": F.pmod(F.col("total") - F.col("quotes"), two).cast("int"), "ends": F.pmod("total", two).cast("int")})
    opens = F.when((F.col("ends") == 1) & ((F.col("begins") == 0) | (F.col("turns") == 1)), F.col("start"))
    since = F.last(opens, ignorenulls=True).over(by_file.rowsBetween(Window.unboundedPreceding, -1))
    return each.select("file", "start", "header", "begins", "ends", since.alias("since"), "odd")


def _rows(columns: Sequence) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                      names=["text", "kind", "file", "start", "since", "header"])


class _Joiner:
    """Joins the lines of one split after the other to records."""

    def __init__(self) -> None:
        self.split, self.open, self.kind, self.inside = None, [], _WHOLE, 0

    def finish(self) -> list[tuple]:
        """What is left of a split that ends inside a record."""
        out = []
        if self.open:
            out = [("\n".join(self.open), *((_INSIDE, *self.split) if self.kind == _CLOSES else (_OPENS, *self.split)))]
        self.open = []
        return out

    def take(self, lines: pa.Array, odd: np.ndarray, split: tuple, begins: int) -> Iterator[pa.RecordBatch]:
        """Records of one line as they are, others and pieces as rows. split: file, start, since, header."""
        rows, skip = [], False
        if split != self.split:
            rows += self.finish()
            self.split, self.kind, self.inside = split, _CLOSES if begins else _WHOLE, begins
            skip = split[1] == 0  # the header
        after = (self.inside + np.cumsum(odd)) & 1
        before = np.concatenate([[self.inside], after[:-1]])
        self.inside = int(after[-1])
        part = (before | after).astype(bool)
        for k in np.flatnonzero(part).tolist():
            self.open.append(lines[k].as_py())
            if not after[k]:
                rows.append(("\n".join(self.open), self.kind, *split))
                self.open, self.kind = [], _WHOLE
        if rows:
            yield _rows(list(zip(*rows, strict=True)))
        part[0] |= skip
        plain = lines.take(pa.array(np.flatnonzero(~part)))
        if len(plain):
            yield _rows([plain, *([x] * len(plain) for x in (_WHOLE, *split))])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    joiner = _Joiner()
    for part in batches:
        if not part.num_rows:
            continue
        start = part.column("start").to_numpy()
        code = part.column("file").dictionary_encode().indices.to_numpy()
        cut = [0, *(np.flatnonzero((np.diff(start) != 0) | (np.diff(code) != 0)) + 1).tolist(), part.num_rows]
        odd = part.column("odd").to_numpy()
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            split = tuple(part.column(c)[a].as_py() for c in ("file", "start", "since", "header"))
            yield from joiner.take(part.column("line").slice(a, b - a), odd[a:b], split, part.column("begins")[a].as_py())
    if rest := joiner.finish():
        yield _rows(list(zip(*rest, strict=True)))


def records(spark: SparkSession, path: str | Sequence[str], table: DataFrame) -> DataFrame:
    """record, header: the text of every record, headers and empty lines left out."""
    def pieces(which: DataFrame) -> DataFrame:
        lines = _lines(spark, path).join(F.broadcast(which), ["file", "start"])  # a row for each split
        return lines.select("line", "file", "start", "since", "header", "begins", F.pmod("quotes", F.lit(2)).alias("odd")).mapInArrow(_joined, _ROWS)

    whole = pieces(table).where(F.col("kind") == _WHOLE).select("text", "header")
    broken = pieces(table.where("begins = 1 or ends = 1")).where(F.col("kind") != _WHOLE)
    opened = F.when(F.col("kind") == _OPENS, F.col("start")).otherwise(F.col("since"))
    sewn = broken.groupBy("file", "header", opened.alias("opened")).agg(F.sort_array(F.collect_list(F.struct("start", "text"))).alias("parts")).select(
        F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"), "header")
    return whole.unionByName(sewn).select(F.regexp_replace("text", "\r$", "").alias("record"), "header").where("record <> ''")


def _names(spark: SparkSession, header: str) -> list[str]:
    """The column names of a header line."""
    fields = ", ".join(f"c{i} string" for i in range(header.count(",") + 1))
    names = spark.range(1).select(F.from_csv(F.lit(header.lstrip("\ufeff").rstrip("\r")), fields, OPTIONS).alias("h")).first()["h"]
    return [n for n in names if n is not None]


def read_split_csv(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The named columns as text. A file without one of them is an error. Counts the quotes of all files while the query is built."""
    table = stored(splits(spark, path), "splits")
    found = table.select("header", "odd").distinct().limit(2 * MOST_HEADERS).collect()
    headers = {r["header"] for r in found}
    if len(headers) > MOST_HEADERS:
        raise ValueError(f"more than {MOST_HEADERS} different headers")
    if any(r["odd"] or r["header"].count('"') % 2 for r in found):
        raise ValueError("a file or header has an odd number of quotes: read it with split=False")
    if not headers:  # no lines at all
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    value = F.lit(None)
    for header in headers:
        names = _names(spark, header)
        missing = [c for c in columns if c not in names]
        if missing:
            raise ValueError(f"no column {', '.join(missing)} in the header {header!r}")
        parsed = F.from_csv("record", ", ".join(f"c{i} string" for i in range(len(names))), OPTIONS)
        value = F.when(F.col("header") == header, F.struct(*[parsed[f"c{names.index(c)}"].alias(c) for c in columns])).otherwise(value)
    return records(spark, path, table).select(value.alias("v")).select(*[F.col("v").getField(c).alias(c) for c in columns])
