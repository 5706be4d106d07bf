"""Projections, filters, lookups, joins, windows, sorts and set operations.

Join policy: a side is broadcast by hint only when it is a top-k list. Everything
else, lookups too, is left to Catalyst and AQE, whose runtime
broadcast conversion measures the side first (spark.sql.adaptive.
autoBroadcastJoinThreshold) and otherwise keeps a sort-merge join, with AQE's
skew-join splitting a hot key on the streamed side.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civiclens.functions.scalar import flag_in



# -- P1-P7 ------------------------------------------------------------------------
def select_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols)


def rename_drop(df: DataFrame, renames: Mapping[str, str] | None = None,
                drops: Iterable[str] = ()) -> DataFrame:
    out = df.withColumnsRenamed(dict(renames or {}))
    return out.drop(*drops) if drops else out


def filter_eq(df: DataFrame, col: str, value) -> DataFrame:
    return df.where(F.col(col) == F.lit(value))


def filter_in(df: DataFrame, col: str, values) -> DataFrame:
    """A literal list becomes IN; a DataFrame of keys becomes a left-semi join."""
    if isinstance(values, DataFrame):
        key = values.columns[0]
        return df.join(values.select(F.col(key).alias("_k")).distinct(),
                       F.col(col) == F.col("_k"), "left_semi")
    return df.where(flag_in(col, values))


def drop_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(cols))


def fill_null(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


# -- P11, J1-J7, J9 ---------------------------------------------------------------
def lookup(df: DataFrame, key: str, table: DataFrame, table_key: str,
           values: Mapping[str, str], defaults: Mapping[str, Column] | None = None) -> DataFrame:
    """Left join a small lookup and fill misses. `values` maps lookup column ->
    output name; `defaults` maps output name -> fallback expression (may use df's columns)."""
    t = table.select(F.col(table_key).alias("_lk"), *[F.col(c).alias(o) for c, o in values.items()])
    out = df.join(t, F.col(key) == F.col("_lk"), "left").drop("_lk")
    if defaults:
        out = out.withColumns({o: F.coalesce(F.col(o), d) for o, d in defaults.items()})
    return out


def left_join(df: DataFrame, right: DataFrame, on, how: str = "left") -> DataFrame:
    """Every join of the analyses is a left join; duplicate right keys fan out."""
    return df.join(right, on, how)


def semi_join(df: DataFrame, keys: DataFrame, left_on: str, right_on: str) -> DataFrame:
    """Rows whose key occurs in `keys`. The keys are made distinct first (a partial aggregate):
    a semi join cannot split a hot key on its right side."""
    k = keys.select(F.col(right_on).alias("_sk")).where(F.col("_sk").isNotNull()).distinct()
    return df.join(k, F.col(left_on) == F.col("_sk"), "left_semi")


def exists_flag(df: DataFrame, keys: DataFrame, left_on: str, right_on: str, name: str) -> DataFrame:
    """Boolean column, True when the key occurs in `keys` (a distinct key set)."""
    k = keys.select(F.col(right_on).alias("_ek")).where(F.col("_ek").isNotNull()).distinct()
    return (df.join(k, F.col(left_on) == F.col("_ek"), "left")
            .withColumn(name, F.col("_ek").isNotNull()).drop("_ek"))


# -- W1-W3, O1-O4 -------------------------------------------------------------------
def keep_first(df: DataFrame, key: Sequence[str] | str, order: Sequence[Column | str]) -> DataFrame:
    """First row per key in an explicit order (never dropDuplicates: its survivor
    is arbitrary). The window shuffles on the key; groups are the duplicates of one
    key, which are few."""
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def share_of_total(df: DataFrame, x: str, name: str, scale: float = 100.0,
                   digits: int | None = None) -> DataFrame:
    """X / sum(x) * scale. The total is a scalar subquery: computed once, no
    single-partition window, no cross join."""
    total = df.select(F.sum(x)).scalar()
    v = F.try_divide(F.col(x), total) * F.lit(scale)
    return df.withColumn(name, F.round(v, digits) if digits is not None else v)


def order_desc(df: DataFrame, n: str, tie: str) -> DataFrame:
    """O1: by frequency, with an explicit tie-break."""
    return df.orderBy(F.desc(n), F.asc(tie))


def order_asc(df: DataFrame, x: str, tie: str) -> DataFrame:
    """O2: by coordinate or value, nulls last, with an explicit tie-break."""
    return df.orderBy(F.asc_nulls_last(x), F.asc(tie))


def head_n(df: DataFrame, n: int, order: Sequence[Column | str]) -> DataFrame:
    """O3: first n rows in an explicit order (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)


def top_k(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent keys (count desc, key asc); columns key, n."""
    return (df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), F.asc(key)).limit(k))


def union_fill(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by name; missing columns are NULL."""
    return a.unionByName(b, allowMissingColumns=True)


# -- G10, G11 -----------------------------------------------------------------------
def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def coverage_report(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """One row: n_rows plus count_if of each named condition (one pass)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  *[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in conditions.items()])
