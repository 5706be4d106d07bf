"""Approximate nearest neighbours (largest inner product) by shifted space-filling curves.

Several Hilbert curves order the vectors: each curve has a random projection to a few dimensions and a
random shift of its own. The curves are cut into blocks by key quantiles; a query meets the candidates
of its own block and the blocks beside it, as many as make up `share` of the curve, on every curve. The
windows of all curves merge, and the best by the exact inner product in double precision stay.

Vectors are put on a sphere first (each is extended by sqrt(M^2 - |x|^2), M the largest norm), where a
small angle to a query is a large inner product. Projections, shifts and quantiles are fitted on a
bounded sample (SAMPLE rows with the smallest hashes); every row is indexed.

Equal vectors: a candidate with k + 1 smaller ids on the same vector cannot be among the nearest of any
query, so of each vector the k + 1 smallest ids are indexed; equal query vectors are searched once.
Blocks are split by a hash so that no task holds more than about CHUNK candidates and CHUNK queries
(counted first), whatever the distribution.

On vectors without structure the recall follows from share and the number of curves alone; the share is
a part of all rows, so the work grows with queries times rows, as for any search of such vectors. With
clusters a smaller share is enough. Recall at the defaults is measured in tests/llm and in the README.

Defined results. Rows with a null id, null, empty or zero vector, a null or non-finite component, or
another than the most common length take no part. Rows that repeat id and vector count once; an id with
several vectors is a candidate by the best of them and a query by all. Ties go to the smaller id. Fewer
than k candidates: all are returned. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .shared import stored

SAMPLE = 8192
BLOCKS = 64
CHUNK = 4096


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cells (n x d integers below 2**bits; d * bits <= 62)."""
    x = cells.T.astype(np.int64).copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations and reflections, from the coarsest bit on
        low = q - 1
        for i in range(d):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> b & 1)
    return key


class Curves:
    """Projections, shifts and block boundaries, fitted on a sample."""

    def __init__(self, sample: np.ndarray, largest: float, curves: int, dimensions: int, bits: int, seed: int):
        rng = np.random.default_rng(seed)
        self.largest, self.bits = largest, bits
        width = sample.shape[1] + 1
        dimensions = min(dimensions, width)
        self.projections = [np.linalg.qr(rng.normal(size=(width, dimensions)))[0] for _ in range(curves)]
        points = self._sphere(sample, False)
        self.center = points.mean(axis=0)
        # half a turn of the spread either way: the shift moves the coarse cells' borders
        self.scales = [6 * max(1e-12, ((points - self.center) @ p).std()) for p in self.projections]
        self.shifts = rng.uniform(0.25, 0.75, (curves, dimensions))
        at = np.linspace(0, 1, BLOCKS + 1)[1:-1]
        self.bounds = [np.quantile(keys, at) for keys in self._keys(points)]

    def _sphere(self, x: np.ndarray, as_query: bool) -> np.ndarray:
        norm = np.linalg.norm(x, axis=1)
        scale = norm if as_query else np.full(len(x), self.largest)
        last = np.zeros(len(x)) if as_query else np.sqrt(np.maximum(0.0, 1 - (norm / self.largest) ** 2))
        return np.column_stack([x / scale[:, None], last])

    def _keys(self, points: np.ndarray):
        top = 1 << self.bits
        for p, scale, shift in zip(self.projections, self.scales, self.shifts, strict=True):
            cells = np.floor(((points - self.center) @ p / scale + shift) * top)
            yield hilbert_keys(np.clip(cells, 0, top - 1).astype(np.int64), self.bits)

    def cells(self, x: np.ndarray, as_query: bool) -> np.ndarray:
        """Cell (curve * BLOCKS + block) of each vector on each curve: n x curves."""
        keys = self._keys(self._sphere(x, as_query))
        return np.stack([c * BLOCKS + np.searchsorted(b, k, side="right")
                         for c, (k, b) in enumerate(zip(keys, self.bounds, strict=True))], axis=1)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def exact_top(q: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and inner products of its k best candidates. Products that decide are
    summed alike for equal vectors, so that ties are ties."""
    out = []
    for a in range(0, len(q), 256):
        rough = q[a : a + 256] @ c.T
        kth = min(k, len(c)) - 1
        least = -np.partition(-rough, kth, axis=1)[:, kth]
        for row, x, low in zip(rough, q[a : a + 256], least, strict=True):
            near = np.flatnonzero(row >= low - 1e-9 * max(1.0, abs(low)))
            score = (c[near] * x).sum(axis=1)
            best = np.lexsort((ids[near], -score))[:k]
            out.append((ids[near][best], score[best]))
    return out


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v) of the rows that take part, each once."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)).distinct()
    width = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (width[0]["n"] if width else 0))


def search(queries: DataFrame, candidates: DataFrame, k: int, curves: int = 12, dimensions: int = 6, bits: int = 8,
           share: float = 0.12, seed: int = 11) -> DataFrame:
    """queries (qid, v with one row each) against candidates (vec_id, v): qid, vec_id, score of the k best found."""
    spark = queries.sparkSession
    result = "qid long, vec_id long, score double"
    sample = candidates.select("v", F.xxhash64("vec_id", "v").alias("h")).orderBy("h").limit(SAMPLE).collect()
    if not sample:
        return spark.createDataFrame([], result)
    largest = candidates.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    fitted = spark.sparkContext.broadcast(Curves(np.array([r["v"] for r in sample]), largest, curves, dimensions, bits, seed))
    reach = int(np.ceil(share * BLOCKS / 2))

    @F.pandas_udf("array<int>")
    def cells(v: pd.Series) -> pd.Series:
        return pd.Series(list(fitted.value.cells(_matrix(v), False).astype(np.int32))) if len(v) else pd.Series([], dtype=object)

    @F.pandas_udf("array<int>")
    def windows(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        own = fitted.value.cells(_matrix(v), True)
        near = own[:, :, None] + np.arange(-reach, reach + 1)
        return pd.Series([row[row // BLOCKS == mine // BLOCKS].astype(np.int32)
                          for row, mine in zip(near, np.broadcast_to(own[:, :, None], near.shape), strict=True)])

    have = stored(candidates.select("vec_id", "v", cells("v").alias("cells")), "index").select("vec_id", "v", F.explode("cells").alias("cell"))
    want = stored(queries.select("qid", "v", windows("v").alias("cells")), "asked").select("qid", "v", F.explode("cells").alias("cell"))

    def dealt(rows: DataFrame, key: str, other: DataFrame) -> DataFrame:
        """rows with their own part of the cell, and a copy for each part of the other side."""
        parts = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias(name))  # noqa: E731  a row a cell: at most curves * BLOCKS
        own, there = parts(rows, "own"), parts(other, "there")
        out = rows.join(F.broadcast(own), "cell").join(F.broadcast(there), "cell")
        return out.select(key, "v", "cell", F.pmod(F.xxhash64(key), F.col("own")).cast("int").alias("mine"),
                          F.explode(F.sequence(F.lit(0), F.col("there") - 1)).alias("theirs"))

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"qid": [], "vec_id": [], "score": []}).astype({"qid": "int64", "vec_id": "int64"})
        top = exact_top(_matrix(q["v"]), _matrix(c["v"]), c["vec_id"].to_numpy(), k)
        return pd.DataFrame({"qid": np.repeat(q["qid"].to_numpy(), [len(t[0]) for t in top]),
                             "vec_id": np.concatenate([t[0] for t in top]), "score": np.concatenate([t[1] for t in top])})

    left = dealt(want, "qid", have).groupBy("cell", "mine", "theirs")
    right = dealt(have, "vec_id", want).select("vec_id", "v", "cell", F.col("theirs").alias("mine"), F.col("mine").alias("theirs")).groupBy("cell", "mine", "theirs")
    found = left.cogroup(right).applyInPandas(meet, result).groupBy("qid", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def nearest(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, **kw) -> DataFrame:
    """The k nearest rows found of each row whose id is divisible by `every`: query_id, rank, vec_id, score."""
    rows = usable(vectors, vec_id, vector)
    order = Window.partitionBy("v").orderBy("vec_id")
    index = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r")
    asked = rows.where(F.col("vec_id") % every == 0)
    groups = asked.groupBy("v").agg(F.min("vec_id").alias("qid"))
    found = search(groups.select("qid", "v"), index, k + 1, **kw)
    members = asked.join(groups, "v").select(F.col("vec_id").alias("query_id"), "qid").distinct()
    pairs = members.join(found, "qid").where(F.col("vec_id") != F.col("query_id")).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
