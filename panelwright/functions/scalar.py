"""Column arithmetic in which NULL is the only missing value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a, b) -> Column:
    """a / b, NULL for a zero or missing divisor."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def growth(now, before) -> Column:
    return ratio(_c(now) - _c(before), before)


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or compares with NULL."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def below_or_missing(value, bound) -> Column:
    """1 where value is below bound; a missing value lies below any bound that is there."""
    v, b = _c(value), _c(bound)
    return F.when(v.isNull() & b.isNotNull(), 1).otherwise(flag(v < b))


def finite(value) -> Column:
    """NULL for NaN and infinities."""
    v = _c(value).cast("double")
    return F.when(F.isnan(v) | v.isin(float("inf"), float("-inf")), None).otherwise(v)


def rounded(value, digits: int) -> Column:
    """value to so many decimals, ties of the scaled value away from zero, as SQL engines and array libraries scale it: 1.005 * 100 lies below 100.5.

    Spark's own round() goes by the decimal digits that are printed, and so makes 1.01 of 1.005.
    """
    v, unit = _c(value).cast("double"), F.lit(10.0**digits)
    out = F.round(v * unit) / unit
    return F.when(F.isnan(out) | out.isin(float("inf"), float("-inf")), v).otherwise(out)


def number(text) -> Column:
    """A number written with thousands separators; NULL if it is none."""
    return F.regexp_replace(_c(text), "[, ]", "").try_cast("double")


def sic2(code, how: str = "padded") -> Column:
    """Industry of a code: its first two digits zero-padded to four ('padded') or not ('prefix'), or code // 100 ('integer')."""
    whole = F.try_divide(_c(code).try_cast("double"), F.lit(1.0)).cast("int")
    if how == "integer":
        return F.floor(whole / 100).cast("int")
    text = whole.cast("string")
    return F.substring(F.lpad(text, 4, "0") if how == "padded" else text, 1, 2)


def correlation(a, b) -> Column:
    """Pearson correlation of what both have; NULL where one does not vary."""
    x, y = _c(a), _c(b)
    both = x.isNotNull() & y.isNotNull()
    u, v = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(u) * F.stddev_pop(v))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)
