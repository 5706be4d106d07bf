"""Histograms and kernel density (H1-H5).

Bin rule (numpy): edges are lo + i * (hi - lo) / bins, bins are half-open and the
last is closed; x goes to the largest i with edge_i <= x. The index is computed
arithmetically and then corrected against the edges, so a value that lands
exactly on an edge goes where numpy puts it. lo == hi widens to lo-0.5 .. hi+0.5.
Counts are partial + final aggregates on (group, bin); the zero-filled grid is a
generator over the (bounded) bins of each present group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def _edge(lo: Column, step: Column, i: Column) -> Column:
    return i * step + lo


def bin_index(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Index of x in `bins` equal-width bins over [lo, hi] (numpy semantics)."""
    step = (hi - lo) / F.lit(float(bins))
    raw = F.floor((x - lo) * (F.lit(float(bins)) / (hi - lo)))
    i0 = F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1))
    return (F.when(x < _edge(lo, step, i0), i0 - 1)
            .when((i0 < bins - 1) & (x >= _edge(lo, step, i0 + 1)), i0 + 1)
            .otherwise(i0))


def _widen(lo: Column, hi: Column) -> tuple[Column, Column]:
    same = lo == hi
    return (F.when(same, lo - 0.5).otherwise(lo), F.when(same, hi + 0.5).otherwise(hi))


def histogram(df: DataFrame, x: str, bins: int, by: Sequence[str] = (), shared: bool = False,
              digits: int = 6, once: bool = False) -> DataFrame:
    """H1/H3/H4: counts of `x` (NULLs dropped) in equal-width bins from min to max.

    by=()        one histogram over all rows;
    shared=True  one set of bins over all rows, counted per group (H3);
    shared=False each group's own min..max (H4).
    The range and the counts are two passes over the input. once=True counts distinct values first, and both
    passes read that shuffle: for an input that costs more than a shuffle of its values (a join, say).
    Output: by..., bin, bin_lo, bin_hi, n (all bins, zero-filled)."""
    keys = list(by)
    v = df.select(*keys, F.col(x).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    for k in keys:
        v = v.where(F.col(k).isNotNull())
    v = v.groupBy(*keys, "_x").agg(F.count("*").alias("_w")) if once else v.withColumn("_w", F.lit(1))
    # needs the counts too, so that both passes have the same shuffle
    seen = F.when(F.col("_w") > 0, F.col("_x")) if once else F.col("_x")
    if not keys or shared:
        # Global range as a scalar subquery attached once as a column per frame.
        rng = v.agg(F.min(seen).alias("lo0"), F.max(seen).alias("hi0")).select(F.struct("lo0", "hi0")).scalar()
        lo0, hi0 = _widen(F.col("_r.lo0"), F.col("_r.hi0"))
        vr = v.withColumn("_r", rng).withColumns({"_lo": lo0, "_hi": hi0})
        binned = vr.select(*keys, "_w", bin_index(F.col("_x"), F.col("_lo"), F.col("_hi"), bins).alias("bin"))
        if keys:
            groups = v.select(*keys).distinct().withColumn("_r", rng).select(*keys, lo0.alias("_lo"), hi0.alias("_hi"))
        else:
            groups = v.sparkSession.range(1).withColumn("_r", rng).select(lo0.alias("_lo"), hi0.alias("_hi"))
        lo_c, hi_c = F.col("_lo"), F.col("_hi")
    else:
        # One row per group: bounded by the number of groups (councils x signs, stances).
        rng = v.groupBy(*keys).agg(F.min(seen).alias("_lo0"), F.max(seen).alias("_hi0"))
        lo0, hi0 = _widen(F.col("_lo0"), F.col("_hi0"))
        groups = rng.select(*keys, lo0.alias("_lo"), hi0.alias("_hi"))
        binned = (v.join(groups, keys)
                  .select(*keys, "_w", bin_index(F.col("_x"), F.col("_lo"), F.col("_hi"), bins).alias("bin")))
        lo_c, hi_c = F.col("_lo"), F.col("_hi")
    counts = binned.groupBy(*keys, "bin").agg(F.sum("_w").alias("n"))
    seq = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    grid = groups.select(*groups.columns, seq)
    step = (hi_c - lo_c) / F.lit(float(bins))
    out = grid.join(counts, [*keys, "bin"], "left").select(
        *keys, F.col("bin").cast("int").alias("bin"),
        F.round(_edge(lo_c, step, F.col("bin")), digits).alias("bin_lo"),
        F.round(F.when(F.col("bin") == bins - 1, hi_c).otherwise(_edge(lo_c, step, F.col("bin") + 1)),
                digits).alias("bin_hi"),
        F.coalesce(F.col("n"), F.lit(0)).alias("n"))
    return out


def histogram_fixed(df: DataFrame, x: str, width: float, stop: float, start: float = 0.0,
                    digits: int = 6) -> DataFrame:
    """H2: bins with edges start + k * width for the edges of numpy.arange(start, stop +
    width, width); values outside the edges are dropped, the last edge is closed."""
    n_edges = math.ceil((stop + width - start) / width)
    nb = n_edges - 1
    w = F.lit(float(width))
    edge = lambda k: k * w + F.lit(float(start))
    v = df.select(F.col(x).cast("double").alias("_x")).where(
        F.col("_x").isNotNull() & (F.col("_x") >= F.lit(float(start))) & (F.col("_x") <= edge(F.lit(nb))))
    k0 = F.floor((F.col("_x") - F.lit(float(start))) / w)
    k1 = (F.when(F.col("_x") < edge(k0), k0 - 1)
          .when(F.col("_x") >= edge(k0 + 1), k0 + 1).otherwise(k0))
    k = F.when(k1 >= nb, F.lit(nb - 1)).otherwise(k1)
    counts = v.groupBy(k.alias("bin")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(nb).select(F.col("id").alias("bin"))
    return grid.join(counts, "bin", "left").select(
        F.col("bin").cast("int").alias("bin"),
        F.round(edge(F.col("bin")), digits).alias("bin_lo"),
        F.round(edge(F.col("bin") + 1), digits).alias("bin_hi"),
        F.coalesce(F.col("n"), F.lit(0)).alias("n"))


def kde_1d(df: DataFrame, x: str, by: str, gridsize: int = 200, bins_for_scale: int | None = None,
           digits: int = 6) -> DataFrame:
    """H5: Gaussian KDE of `x` per group on a grid shared by all groups (overall
    min..max, `gridsize` points), Scott bandwidth std * n^(-1/5) per group, scaled to
    counts (density * n, times the histogram bin width when `bins_for_scale` is set).

    Exact: identical values are merged first (weight = multiplicity); each distinct
    value then contributes to the grid points through a generator, summed by a
    partial + final aggregate on (group, grid point)."""
    v = df.select(F.col(by).alias("_g"), F.col(x).cast("double").alias("_x")).where(
        F.col("_x").isNotNull() & F.col("_g").isNotNull())
    rng = v.agg(F.min("_x").alias("lo"), F.max("_x").alias("hi")).select(F.struct("lo", "hi")).scalar()
    stats = v.groupBy("_g").agg(F.count("*").alias("_n"), F.stddev_samp("_x").alias("_sd"))
    # The shared grid range rides on the (one row per group) stats table.
    stats = stats.withColumn("_bw", F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))) \
                 .withColumn("_r", rng)
    lo, hi = F.col("_lo"), F.col("_hi")
    distinct = v.groupBy("_g", "_x").agg(F.count("*").alias("_w"))
    step = (hi - lo) / F.lit(float(gridsize - 1))
    gpt = F.explode(F.sequence(F.lit(0), F.lit(gridsize - 1))).alias("gi")
    contrib = (distinct.join(stats.where(F.col("_bw") > 0), "_g")
               .select("_g", "_w", "_x", "_bw", "_n", F.col("_r.lo").alias("_lo"), F.col("_r.hi").alias("_hi"), gpt))
    gx = F.col("gi") * step + lo
    z = (gx - F.col("_x")) / F.col("_bw")
    dens = (contrib.groupBy("_g", "gi").agg(
        F.sum(F.col("_w") * F.exp(z * z * -0.5)).alias("_k"),
        F.first("_bw").alias("_bw"), F.first("_n").alias("_n"),
        F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi")))
    norm = F.col("_n") * F.col("_bw") * F.lit(math.sqrt(2 * math.pi))
    density = F.col("_k") / norm
    scale = F.col("_n").cast("double")
    if bins_for_scale:
        scale = scale * (hi - lo) / F.lit(float(bins_for_scale))
    return dens.select(F.col("_g").alias(by), F.col("gi").cast("int").alias("grid_index"),
                       F.round(gx, digits).alias("x"),
                       F.round(density, digits).alias("density"),
                       F.round(density * scale, digits).alias("scaled"))


def kde_error_bound(width: float, bandwidth: float) -> float:
    """Largest error of a density from linear bins: width**2 / 8 times the largest second derivative of the kernel density,
    which is that of the kernel at 0."""
    return width * width / (8 * math.sqrt(2 * math.pi) * bandwidth**3)


def kde_binned(df: DataFrame, x: str, by: str, gridsize: int = 200, bins: int = 4096, bins_for_scale: int | None = None,
               digits: int = 6) -> DataFrame:
    """H5 for many distinct values: as `kde_1d`, but each value's mass is split over the two nearest of `bins` + 1 equally
    spaced points, in proportion to how near they are; the kernel sums then run over those points.

    The work after the first partial aggregate is groups x bins x gridsize whatever the number of values. The density differs from
    the exact one by at most `kde_error_bound(range / bins, bandwidth)`, also returned as `error`."""
    v = df.select(F.col(by).alias("_g"), F.col(x).cast("double").alias("_x")).where(F.col("_x").isNotNull() & F.col("_g").isNotNull())
    rng = v.agg(F.min("_x").alias("lo"), F.max("_x").alias("hi")).select(F.struct("lo", "hi")).scalar()
    stats = v.groupBy("_g").agg(F.count("*").alias("_n"), F.stddev_samp("_x").alias("_sd"))
    stats = stats.select("_g", "_n", (F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))).alias("_bw"))
    place = (F.col("_x") - F.col("_r.lo")) / (F.col("_r.hi") - F.col("_r.lo")) * F.lit(float(bins))
    at = v.withColumn("_r", rng).where("_r.hi > _r.lo").select("_g", place.alias("_at"))
    at = at.select("_g", "_at", F.least(F.floor("_at"), F.lit(bins - 1)).alias("_b"))
    # counts and sums of the upper shares by bin: a partial aggregate on at most groups x bins keys
    mass = at.groupBy("_g", "_b").agg(F.count("*").alias("_c"), F.sum(F.col("_at") - F.col("_b")).alias("_up"))
    halves = F.explode(F.array(F.struct(F.col("_b").alias("b"), (F.col("_c") - F.col("_up")).alias("w")), F.struct((F.col("_b") + 1).alias("b"), F.col("_up").alias("w")))).alias("_h")
    points = mass.select("_g", halves).groupBy("_g", F.col("_h.b").alias("_b")).agg(F.sum("_h.w").alias("_w")).where("_w > 0")
    lo, span = F.col("_r.lo"), F.col("_r.hi") - F.col("_r.lo")
    terms = points.join(stats.where(F.col("_bw") > 0), "_g").select("_g", "_w", "_b", "_bw", "_n", F.explode(F.sequence(F.lit(0), F.lit(gridsize - 1))).alias("gi"))
    terms = terms.withColumn("_r", rng)
    z = (F.col("gi") / F.lit(float(gridsize - 1)) - F.col("_b") / F.lit(float(bins))) * span / F.col("_bw")
    dens = terms.groupBy("_g", "gi", "_bw", "_n").agg(F.sum(F.col("_w") * F.exp(z * z * -0.5)).alias("_k")).withColumn("_r", rng)
    density = F.col("_k") / (F.col("_n") * F.col("_bw") * F.lit(math.sqrt(2 * math.pi)))
    scale = F.col("_n").cast("double")
    if bins_for_scale:
        scale = scale * span / F.lit(float(bins_for_scale))
    width = span / F.lit(float(bins))
    error = width * width / (F.lit(8 * math.sqrt(2 * math.pi)) * F.col("_bw") * F.col("_bw") * F.col("_bw"))
    return dens.select(F.col("_g").alias(by), F.col("gi").cast("int").alias("grid_index"), F.round(F.col("gi") * (span / F.lit(float(gridsize - 1))) + lo, digits).alias("x"),
                       F.round(density, digits).alias("density"), F.round(density * scale, digits).alias("scaled"), error.alias("error"))
