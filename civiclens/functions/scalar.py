"""Scalar helpers: classes, flags, keys, sums, ratios, rounding, labels."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def flag_in(col, values: Iterable) -> Column:
    """P4 flag form: value in the list; NULL is False."""
    return F.coalesce(_c(col).isin(list(values)), F.lit(False))



def sign_class(score) -> Column:
    """Negative / Positive / Neutral (exact zero); NULL stays NULL."""
    s = _c(score)
    return F.when(s < 0, "Negative").when(s > 0, "Positive").when(s == 0, "Neutral")


def area_class(col, inner: Iterable[str], inside: str = "Inner London",
               outside: str = "Outer London") -> Column:
    """Inner / outer label; NULL is outer."""
    return F.when(flag_in(col, inner), inside).otherwise(outside)


def composite_key(a, b, sep: str = "_") -> Column:
    """A + sep + b, NULL if either part is NULL (unlike concat_ws)."""
    return F.concat(_c(a), F.lit(sep), _c(b))


def row_sum(cols: Iterable) -> Column:
    """Null-skipping sum across columns; an all-null row gives 0."""
    parts = [F.coalesce(_c(c), F.lit(0)) for c in cols]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def percent(part, whole) -> Column:
    """Part / whole * 100; NULL when whole is 0 (ANSI-safe)."""
    return F.try_divide(_c(part), _c(whole)) * F.lit(100.0)


def round2(x) -> Column:
    """Round half-up to 2 places."""
    return F.round(_c(x), 2)


def slug(s) -> Column:
    """Lower case, spaces to underscores."""
    return F.regexp_replace(F.lower(_c(s)), " ", "_")


def label(fmt: str, *cols) -> Column:
    """A printf-style label; NULL if any part is NULL."""
    parts = [_c(c) for c in cols]
    whole = F.lit(True)
    for p in parts:
        whole = whole & p.isNotNull()
    return F.when(whole, F.format_string(fmt, *parts))


def title(s) -> Column:
    return F.initcap(_c(s))
