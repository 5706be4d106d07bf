"""Least squares, correlation, Welch's t and the bootstrap band.

Fits are aggregates (`regr_slope`, `regr_intercept`, `covar_pop`, ...), so they
run as partial + final aggregates per group. Rows where x or y is NULL are skipped
pairwise, as np.polyfit on the dropped rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from civiclens import constants as K
from civiclens.functions.stats import student_t_p


def ols(df: DataFrame, x: str, y: str | Column, by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """Slope, intercept and n of y ~ x per group."""
    yc = F.col(y) if isinstance(y, str) else y
    xc = F.col(x).cast("double")
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(F.regr_count(yc, xc).alias("n_fit"),
                 F.round(F.regr_slope(yc, xc), digits).alias("slope"),
                 F.round(F.regr_intercept(yc, xc), digits).alias("intercept"))


def regression_by_housing(apps: DataFrame, x: str = "total_no_proposed_residential_units",
                          y: str = "comment_count", housing_order: Sequence[str] = K.HOUSING_ORDER,
                          skip: Sequence[str] = ("Other",), digits: int = 6) -> DataFrame:
    """Per housing type of `housing_order` present in the data: n (all rows of the
    type) and the line of y on x, except for the types in `skip` (no line)."""
    t = apps.where(F.col("housing_type").isin(list(housing_order)))
    fit = F.col("housing_type").isin(list(skip))
    xc, yc = F.col(x).cast("double"), F.col(y).cast("double")
    xs = F.when(~fit, xc)
    return t.groupBy("housing_type").agg(
        F.count("*").alias("n"),
        F.regr_count(yc, xs).alias("n_fit"),
        F.round(F.regr_slope(yc, xs), digits).alias("slope"),
        F.round(F.regr_intercept(yc, xs), digits).alias("intercept"))


def pearson(df: DataFrame, x: str, y: str | Column, by: Sequence[str] = (), with_p: bool = False,
            digits: int = 6) -> DataFrame:
    """Pearson r, n and t = r sqrt((n-2)/(1-r^2)) per group; NULL for constant
    input or n < 2 (Spark's `corr` would divide by zero under ANSI)."""
    yc = (F.col(y) if isinstance(y, str) else y).cast("double")
    xc = F.col(x).cast("double")
    both = F.when(xc.isNotNull() & yc.isNotNull(), F.lit(1))
    xx, yy = F.when(both.isNotNull(), xc), F.when(both.isNotNull(), yc)
    g = df.groupBy(*by) if by else df.groupBy()
    a = g.agg(F.count(both).alias("n"), F.covar_pop(xx, yy).alias("_c"),
              F.stddev_pop(xx).alias("_sx"), F.stddev_pop(yy).alias("_sy"))
    r = F.when(F.col("n") >= 2, F.try_divide(F.col("_c"), F.col("_sx") * F.col("_sy")))
    a = a.withColumn("_r", r)
    t = F.col("_r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("_r") * F.col("_r")))
    a = a.withColumn("_t", t)
    cols = [*by, "n", F.round("_r", digits).alias("r"), F.round("_t", digits).alias("t")]
    if with_p:
        cols.append(F.round(student_t_p(F.col("_t"), F.col("n") - 2), digits).alias("p"))
    return a.select(*cols)


def welch_t(a: DataFrame, b: DataFrame, value: str, by: Sequence[str] = (), with_p: bool = False,
            digits: int = 6) -> DataFrame:
    """Welch's two-sample t statistic of a vs b (NULLs dropped), the
    Welch-Satterthwaite degrees of freedom and optionally the two-sided p.

    Both samples are tagged and aggregated in one pass (per group of `by`, e.g. one
    group per variable of a long table); the statistic is arithmetic on the
    aggregated row."""
    col = value
    keys = list(by)
    tagged = (a.select(*keys, F.col(col).cast("double").alias("_v"), F.lit(True).alias("_a"))
              .unionByName(b.select(*keys, F.col(col).cast("double").alias("_v"), F.lit(False).alias("_a"))))
    va, vb = F.when(F.col("_a"), F.col("_v")), F.when(~F.col("_a"), F.col("_v"))
    g = (tagged.groupBy(*keys) if keys else tagged.groupBy()).agg(
        F.count(va).alias("n_a"), F.avg(va).alias("_ma"), F.var_samp(va).alias("_va"),
        F.count(vb).alias("n_b"), F.avg(vb).alias("_mb"), F.var_samp(vb).alias("_vb"))
    g = g.withColumns({"_qa": F.col("_va") / F.col("n_a"), "_qb": F.col("_vb") / F.col("n_b")})
    qa, qb = F.col("_qa"), F.col("_qb")
    g = g.withColumns({"_t": F.try_divide(F.col("_ma") - F.col("_mb"), F.sqrt(qa + qb)),
                       "_df": F.try_divide((qa + qb) * (qa + qb),
                                           qa * qa / (F.col("n_a") - 1) + qb * qb / (F.col("n_b") - 1))})
    cols = [*keys, "n_a", "n_b", F.round("_t", digits).alias("t"), F.round("_df", digits).alias("df")]
    if with_p:
        cols.append(F.round(student_t_p(F.col("_t"), F.col("_df")), digits).alias("p"))
    return g.select(*cols)


#: Weights (pairs x replicates) that a task of the bootstrap makes at once.
BLOCK = 1 << 19
#: Arithmetic of the bootstrap weights: whole numbers modulo a prime, so that SQL engines can repeat it.
PRIME = 2**31 - 1
#: Factors of x key, y key, replicate, draw and seed in the two rounds; the last is added.
FACTORS = ((1103515245, 1566083941, 1220703125, 1664525, 69069, 12345), (1078318381, 2027812808, 1323257245, 764261123, 1299721, 54321))
SMALL = 16  # counts up to this are drawn by inversion, larger ones from the normal with their mean and variance
DRAWS = 12  # uniforms of a normal draw


def poisson_thresholds(count: int) -> list[int]:
    """A uniform u in 0 .. PRIME - 1 stands for as many occurrences as thresholds that it reaches: Poisson(count) by inversion."""
    shares = [math.fsum(math.exp(-count + k * math.log(count) - math.lgamma(k + 1)) for k in range(j + 1)) for j in range(count + 12 + 4 * math.isqrt(count))]
    return [math.floor(PRIME * x) for x in shares]


def _key(x: np.ndarray) -> np.ndarray:
    """Key of a number below 9e15: its whole part, and 20 bits of the rest."""
    whole = np.floor(x)
    return (whole.astype(np.int64) % PRIME * 1048583 + np.floor((x - whole) * 2.0**20).astype(np.int64)) % PRIME


def _uniform(kx: np.ndarray, ky: np.ndarray, replicate: np.ndarray, draw: int, seed: int) -> np.ndarray:
    """Uniform whole numbers for each pair (rows) and replicate (columns): two rounds of a linear form and a fifth power, which
    permutes the numbers modulo the prime."""
    t = None
    for a, b, c, d, e, f in FACTORS:
        linear = ((a * kx % PRIME + b * ky % PRIME)[:, None] + (c * replicate % PRIME)[None, :] + (d * draw + e * seed + f) % PRIME)
        t = linear % PRIME if t is None else (linear + t * 16807 % PRIME) % PRIME
        square = t * t % PRIME
        t = square * square % PRIME * t % PRIME
    return t


def bootstrap_weights(x: np.ndarray, y: np.ndarray, count: np.ndarray, replicate: np.ndarray, seed: int) -> np.ndarray:
    """How often each distinct pair is drawn in each replicate: Poisson(count)."""
    kx, ky = _key(x), _key(y)
    u = _uniform(kx, ky, replicate, 0, seed)
    out = np.empty(u.shape)
    for c in np.unique(count[count <= SMALL]).tolist():
        rows = count == c
        out[rows] = np.searchsorted(poisson_thresholds(c), u[rows], side="right")
    many = count > SMALL
    if many.any():
        total = sum((_uniform(kx[many], ky[many], replicate, j, seed) for j in range(1, DRAWS)), u[many])
        c = count[many].astype(float)[:, None]
        out[many] = np.maximum(0.0, np.floor(c + np.sqrt(c) * ((total + DRAWS / 2) / PRIME - DRAWS / 2) + 0.5))
    return out


def regression_band(df: DataFrame, x: str, y: str, by: str, replicates: int = 1000,
                    grid: int = 100, level: float = 95.0, seed: int = 0, digits: int = 6) -> DataFrame:
    """Bootstrap band of the least-squares line per group.

    A row bootstrap draws each row Poisson(1) times; equal rows together, c of them, Poisson(c)
    times. So the distinct (x, y) pairs of a group and their counts (a partial aggregate) are enough. Each task
    keeps, for each of its groups, arrays of the five sums that a line needs, one entry for each replicate, and hands on those sums
    instead of rows for pairs and replicates. Weights follow from (seed, replicate, pair) by whole-number
    arithmetic: repeatable on any cluster. The line of each replicate is evaluated on `grid` points over the
    group's x range and the band is the (100-level)/2 and (100+level)/2 percentiles per grid point.

    Rows with a NULL or NaN are skipped. A group whose x is constant has no line and no rows. Values have to be below 9e15.
    Memory of a task: 6 x (replicates + 1) numbers for each group that it meets, and blocks of BLOCK weights."""
    v = df.select(F.col(by).alias("_g"), F.nanvl(F.col(x).cast("double"), F.lit(None)).alias("_x"),
                  F.nanvl(F.col(y).cast("double"), F.lit(None)).alias("_y")).where(
        F.col("_g").isNotNull() & F.col("_x").isNotNull() & F.col("_y").isNotNull())
    pairs = v.groupBy("_g", "_x", "_y").agg(F.count("*").alias("_k"))
    group = pairs.schema["_g"].dataType
    names = ("_n", "_sx", "_sy", "_sxx", "_sxy")
    at = np.arange(replicates)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Replicate -1 is the sample itself."""
        held: dict = {}
        for batch in batches:
            xs, ys, k = (batch.column(c).to_numpy() for c in ("_x", "_y", "_k"))
            code = batch.column("_g").dictionary_encode()
            which = code.indices.to_numpy()
            for g, name in enumerate(code.dictionary.to_pylist()):
                rows = np.flatnonzero(which == g)
                sums, ends = held.setdefault(name, (np.zeros((5, replicates + 1)), [np.inf, -np.inf]))
                for a in range(0, len(rows), max(1, BLOCK // max(1, replicates))):
                    part = rows[a : a + max(1, BLOCK // max(1, replicates))]
                    px, py, pk = xs[part], ys[part], k[part]
                    weights = np.column_stack([pk.astype(float), bootstrap_weights(px, py, pk, at, seed)])
                    sums += np.stack([np.ones_like(px), px, py, px * px, px * py]) @ weights
                    ends[:] = min(ends[0], px.min()), max(ends[1], px.max())
        for name, (sums, ends) in held.items():
            n = replicates + 1
            yield pa.RecordBatch.from_arrays([pa.array([name] * n, to_arrow_type(group)), pa.array(np.arange(-1, replicates)), *map(pa.array, sums),
                                              pa.array([ends[0]] * n), pa.array([ends[1]] * n)], names=["_g", "_r", *names, "_lo", "_hi"])

    schema = StructType([StructField("_g", group), StructField("_r", LongType()), *(StructField(c, DoubleType()) for c in (*names, "_lo", "_hi"))])
    fit = pairs.mapInArrow(summed, schema).groupBy("_g", "_r").agg(*[F.sum(c).alias(c) for c in names], F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    den = F.col("_n") * F.col("_sxx") - F.col("_sx") * F.col("_sx")
    slope = F.try_divide(F.col("_n") * F.col("_sxy") - F.col("_sx") * F.col("_sy"), den)
    fit = fit.select("_g", "_r", "_n", "_sx", "_sy", "_lo", "_hi", slope.alias("_m"))
    fit = fit.select("_g", "_r", "_lo", "_hi", "_m", F.try_divide(F.col("_sy") - F.col("_m") * F.col("_sx"), F.col("_n")).alias("_c"))
    # A group's range is that of all tasks: a window over its replicates + 1 rows.
    of_group = Window.partitionBy("_g")
    fit = fit.withColumns({"_lo": F.min("_lo").over(of_group), "_hi": F.max("_hi").over(of_group)})
    step = (F.col("_hi") - F.col("_lo")) / F.lit(float(grid - 1))
    pts = fit.select("_g", "_r", "_m", "_c", "_lo", step.alias("_step"), F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("gi"))
    pts = pts.select("_g", "_r", "gi", "_m", "_c", (F.col("_lo") + F.col("_step") * F.col("gi")).alias("x"))
    pts = pts.select("_g", "gi", "x", (F.col("_r") < 0).alias("_own"), (F.col("_m") * F.col("x") + F.col("_c")).alias("_yh"))
    drawn = F.when(~F.col("_own"), F.col("_yh"))
    lo_q, hi_q = (100.0 - level) / 200.0, (100.0 + level) / 200.0
    band = pts.where(F.col("_yh").isNotNull()).groupBy("_g", "gi").agg(
        F.first("x").alias("x"), F.max(F.when(F.col("_own"), F.col("_yh"))).alias("yhat"), F.percentile(drawn, F.array(F.lit(lo_q), F.lit(hi_q))).alias("q"))
    return band.where(F.col("yhat").isNotNull()).select(
        F.col("_g").alias(by), F.col("gi").cast("int").alias("grid_index"), F.round("x", digits).alias("x"), F.round("yhat", digits).alias("yhat"),
        F.round(F.get("q", F.lit(0)), digits).alias("lo"), F.round(F.get("q", F.lit(1)), digits).alias("hi"))
