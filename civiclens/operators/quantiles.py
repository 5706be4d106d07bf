"""Exact quantiles, box statistics and `describe`.

Everything follows from the distinct (group, value) pairs and how often each occurs. Counting
them is a partial aggregate, so a value that a third of all rows share is one row per task before
the shuffle, and later one row in all. All further steps read that one shuffle (the plan's exchange
is reused), and nothing runs while the query is built.

Order statistics are selected by a histogram whose parts are known beforehand: the logarithm of a value's size, cut into PARTS to
the factor 2, with its sign. Counts of the parts tell which hold the wanted ranks, and only the values of those
are put in order. A group has as many parts as its values' orders of magnitude need (some hundred thousand at most, whatever its
rows), so no group is sorted in one task; only values that all lie within a few parts per hundred thousand of each other are.

Interpolation is linear between the order statistics at floor and ceil of
q * (n - 1), as numpy's default `percentile` and DuckDB's `quantile_cont`. NULL and NaN are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a factor of 2.
PARTS = 16384


def _pairs(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Distinct values of each group: _key (struct of the group's columns), _x, and _c, the rows that hold the value."""
    # without groups a 0 that the optimizer does not take for a constant, so that all steps are joins on a key
    key = F.struct(*by) if by else F.struct(F.pmod(F.xxhash64(value), F.lit(1)).alias("all"))
    x = F.nanvl(F.col(value).cast("double"), F.lit(None))
    return df.select(key.alias("_key"), x.alias("_x")).where(F.col("_x").isNotNull()).groupBy("_key", "_x").agg(F.count("*").alias("_c"))


def _small(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """A table with some rows for each group: for one group a broadcast of known size, else AQE measures it."""
    return df if by else F.broadcast(df)


def _part() -> Column:
    """Number of the part that _x lies in; never decreasing in _x. 1080: no double is below 2 ** -1080."""
    size = F.floor((F.log2(F.abs("_x")) + 1080) * PARTS).cast("int") + 1
    return F.when(F.col("_x") > 0, size).when(F.col("_x") < 0, -size).otherwise(0)


def _statistics(pairs: DataFrame, by: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """_key, _n and _q, the array of quantiles, of each group."""
    at = lambda p, f: f(F.lit(float(p)) * (F.col("_n") - 1)).cast("long")
    ranks = F.array_distinct(F.array(*[at(p, f) for p in probs for f in (F.floor, F.ceil)]))
    group = Window.partitionBy("_key")
    running = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    parts = pairs.groupBy("_key", _part().alias("_b")).agg(F.sum("_c").alias("_c"))
    parts = parts.select("_key", "_b", "_c", F.sum("_c").over(running).alias("_to"), F.sum("_c").over(group).alias("_n"))
    parts = parts.select("_key", "_b", "_n", (F.col("_to") - F.col("_c")).alias("_base"), F.filter(ranks, lambda r: (F.col("_to") - F.col("_c") <= r) & (r < F.col("_to"))).alias("_ranks"))
    held = pairs.withColumn("_b", _part()).join(_small(parts.where(F.size("_ranks") > 0), by), ["_key", "_b"])
    inside = Window.partitionBy("_key", "_b").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    held = held.select("_key", "_n", "_x", "_c", (F.col("_base") + F.sum("_c").over(inside)).alias("_to"))
    holds = lambda r: (F.col("_to") - F.col("_c") <= r) & (r < F.col("_to"))
    picks = [F.max(F.when(holds(at(p, f)), F.col("_x"))) for p in probs for f in (F.floor, F.ceil)]
    got = held.groupBy("_key", "_n").agg(F.array(*picks).alias("_s"))
    between = [F.col("_s")[2 * i] + (F.col("_s")[2 * i + 1] - F.col("_s")[2 * i]) * (F.lit(float(p)) * (F.col("_n") - 1) - F.floor(F.lit(float(p)) * (F.col("_n") - 1)))
               for i, p in enumerate(probs)]
    return got.select("_key", "_n", F.array(*between).alias("_q"))


def _groups(by: Sequence[str]) -> list[Column]:
    return [F.col(f"_key.`{k}`").alias(k) for k in by]


def approx_quantiles(df: DataFrame, value: str, by: Sequence[str], probs: Sequence[float],
                     names: Sequence[str], accuracy: int) -> DataFrame:
    """Bounded-memory alternative: `percentile_approx` sketches (rank error about
    n / accuracy), one partial + final aggregate, no range shuffle. Values are data
    points, not interpolated."""
    x = F.col(value).cast("double")
    g = (df.groupBy(*by) if by else df.groupBy()).agg(
        F.count(x).alias("n"), F.percentile_approx(x, list(probs), accuracy).alias("_q"))
    return g.select(*by, "n", *[F.col("_q")[i].alias(nm) for i, nm in enumerate(names)])


def exact_quantiles(df: DataFrame, value: str, by: Sequence[str], probs: Sequence[float],
                    names: Sequence[str] | None = None, accuracy: int | None = None) -> DataFrame:
    """Per group: n and the exact linear-interpolated quantiles `probs` of `value`
    (NULLs skipped). Groups with NULL keys are the caller's to drop. With
    `accuracy`, approximate sketches are used instead (see approx_quantiles)."""
    keys = list(by)
    names = list(names or [f"q{int(round(p * 100))}" for p in probs])
    if accuracy:
        return approx_quantiles(df, value, keys, probs, names, accuracy)
    got = _statistics(_pairs(df, value, keys), keys, probs)
    return got.select(*_groups(keys), F.col("_n").alias("n"), *[F.col("_q")[i].alias(nm) for i, nm in enumerate(names)])


def percentiles(df: DataFrame, value: str, probs: Sequence[float] = (0.95, 0.99),
                by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """Exact percentiles (e.g. p95, p99) of `value`."""
    names = [f"p{int(round(p * 100))}" for p in probs]
    q = exact_quantiles(df, value, by, probs, names)
    return q.select(*by, *[F.round(n, digits).alias(n) for n in names])


def _mean():
    return F.sum(F.col("_x") * F.col("_c")) / F.sum("_c")


def box_stats(df: DataFrame, value: str, by: Sequence[str], whis: float = 1.5,
              digits: int = 6) -> DataFrame:
    """H6: per group n, mean, quartiles, whiskers and outlier count (matplotlib's
    rules: a whisker is the furthest point within 1.5 IQR of its quartile, or the
    quartile itself when no point lies beyond it inside the fence; outliers are the
    points beyond the fences): the quartiles, then an aggregate over the distinct values against the
    fences (one row per group)."""
    keys = list(by)
    pairs = _pairs(df, value, keys)
    q = _statistics(pairs, keys, [0.25, 0.5, 0.75]).select("_key", *[F.col("_q")[i].alias(c) for i, c in enumerate(("q1", "median", "q3"))])
    fences = q.withColumns({"_lof": F.col("q1") - F.lit(whis) * (F.col("q3") - F.col("q1")), "_hif": F.col("q3") + F.lit(whis) * (F.col("q3") - F.col("q1"))})
    v, out = F.col("_x"), (F.col("_x") < F.col("_lof")) | (F.col("_x") > F.col("_hif"))
    agg = pairs.join(_small(fences, keys), "_key").groupBy("_key", "q1", "median", "q3").agg(
        F.sum("_c").alias("n"), _mean().alias("mean"), F.max(F.when(v <= F.col("_hif"), v)).alias("_whi"), F.min(F.when(v >= F.col("_lof"), v)).alias("_wlo"),
        F.coalesce(F.sum(F.when(out, F.col("_c"))), F.lit(0)).alias("n_fliers")).select(*_groups(keys), "*")
    whishi = F.when(F.col("_whi").isNull() | (F.col("_whi") < F.col("q3")), F.col("q3")).otherwise(F.col("_whi"))
    whislo = F.when(F.col("_wlo").isNull() | (F.col("_wlo") > F.col("q1")), F.col("q1")).otherwise(F.col("_wlo"))
    r6 = lambda c: F.round(c if not isinstance(c, str) else F.col(c), digits)
    return agg.select(*keys, "n", r6("mean").alias("mean"), r6("q1").alias("q1"), r6("median").alias("median"),
                      r6("q3").alias("q3"), r6(whislo).alias("whislo"), r6(whishi).alias("whishi"), "n_fliers")


def describe(df: DataFrame, value: str, digits: int = 6) -> DataFrame:
    """Count, mean, sample std, min, quartiles, max (pandas `describe`). The deviations are summed
    against the median, which keeps their squares small, and corrected for the mean."""
    pairs = _pairs(df, value, [])
    whole = F.broadcast(_statistics(pairs, [], [0.25, 0.5, 0.75]))  # one row
    d = F.col("_x") - F.col("_q")[1]
    g = pairs.join(whole, "_key").groupBy().agg(
        F.coalesce(F.sum("_c"), F.lit(0)).alias("count"), _mean().alias("mean"), F.min("_x").alias("min"), F.max("_x").alias("max"),
        F.max("_q").alias("_q"), F.sum(d * F.col("_c")).alias("_d"), F.sum(d * d * F.col("_c")).alias("_d2"))
    spread = F.col("_d2") - F.try_divide(F.col("_d") * F.col("_d"), F.col("count"))
    g = g.withColumn("std", F.sqrt(F.greatest(F.try_divide(spread, F.col("count") - 1), F.try_divide(F.lit(0.0), F.col("count") - 1))))
    outs = [(c, F.col("_q")[i]) for i, c in enumerate(("p25", "p50", "p75"))]
    r6 = lambda c: F.round(c if not isinstance(c, str) else F.col(c), digits)
    return g.select("count", r6("mean").alias("mean"), r6("std").alias("std"), r6("min").alias("min"),
                    *[r6(e).alias(nm) for nm, e in outs], r6("max").alias("max"))
