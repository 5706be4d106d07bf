"""List columns: parsing list literals and array helpers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _normalise_literal(text: Column) -> Column:
    # Python list literals differ from JSON in None and tuple brackets. The regular
    # expressions only run on the rare rows that need them.
    t = F.regexp_replace(text, r"\bNone\b", "null")
    t = F.regexp_replace(t, r"^\s*\(", "[")
    t = F.regexp_replace(t, r",?\s*\)\s*$", "]")
    return F.when(F.contains(text, F.lit("None")) | F.contains(text, F.lit("(")), t).otherwise(text)


def parse_int_list(col, missing_as_empty: bool = False) -> Column:
    """L1: '[1, -1, 22]' -> array<int>. Missing stays NULL unless `missing_as_empty`.
    Malformed literals give NULL (count them with `rejected`)."""
    parsed = F.from_json(_normalise_literal(_c(col)), "array<int>")
    return F.coalesce(parsed, F.array().cast("array<int>")) if missing_as_empty else parsed


def parse_double_list(col) -> Column:
    """L2: probabilities; the literal `nan` is read as 0.0."""
    return F.from_json(_normalise_literal(F.regexp_replace(_c(col), r"\bnan\b", "0.0")), "array<double>")


def rejected(text, parsed) -> Column:
    """L1: a literal that is there but could not be parsed."""
    return _c(text).isNotNull() & _c(parsed).isNull()


def contains(list_col, value) -> Column:
    """A2: membership test; a missing list is False."""
    return F.coalesce(F.array_contains(_c(list_col), value), F.lit(False))


def restrict_to(list_col, values: Column) -> Column:
    """A3: distinct elements of the list that are also in `values`."""
    return F.array_intersect(F.array_distinct(_c(list_col)), values)


def unordered_pairs(list_col) -> Column:
    """A4: all unordered pairs (lo, hi) of a list of distinct elements, as structs.
    Generated inside the row: no self-join, no shuffle before the count."""
    a = _c(list_col)
    return F.flatten(F.transform(
        a, lambda x, i: F.transform(
            F.slice(a, i + 2, F.size(a) - i - 1),
            lambda y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")))))


def primary_topic(list_col) -> Column:
    """A5: first topic id > 0 (outlier -1 and topic 0 skipped), else NULL."""
    return F.get(F.filter(_c(list_col), lambda t: t > 0), 0)


def first_ring(coords) -> Column:
    """Outer ring of a polygon coordinate array."""
    return F.get(_c(coords), 0)
