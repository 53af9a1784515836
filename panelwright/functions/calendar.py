"""Months as YYYYMM and as a running index, business days, and other systems' dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_index(date) -> Column:
    """Months since year 0."""
    return F.year(date) * 12 + F.month(date) - 1


def index_of_key(key) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.floor(k / 100).cast("int") * 12 + k % 100 - 1


def key_of_index(index) -> Column:
    m = F.col(index) if isinstance(index, str) else index
    return (F.floor(m / 12).cast("int") * 100 + m % 12 + 1).cast("int")


def month_key(date) -> Column:
    return F.year(date) * 100 + F.month(date)


def add_months_key(key, n: int) -> Column:
    return key_of_index(index_of_key(key) + n)


def add_business_days(date, n: int) -> Column:
    """n days from Monday to Friday on or back; a weekend counts as its Friday going on and as its Monday going back."""
    d = F.col(date) if isinstance(date, str) else date
    wd = F.weekday(d)
    if n >= 0:
        base = F.date_sub(d, F.greatest(wd - 4, F.lit(0)).cast("int"))
        left = n % 5
        over = F.when(F.weekday(base) + left > 4, 2).otherwise(0)
        return F.when(F.lit(n) == 0, F.when(wd > 4, F.date_add(d, (7 - wd).cast("int"))).otherwise(d)).otherwise(F.date_add(base, (F.lit(n // 5 * 7 + left) + over).cast("int")))
    base = F.when(wd > 4, F.date_add(d, (7 - wd).cast("int"))).otherwise(d)
    left = -n % 5
    over = F.when(F.weekday(base) < left, 2).otherwise(0)
    return F.date_sub(base, (F.lit(-n // 5 * 7 + left) + over).cast("int"))


def sas_date(days) -> Column:
    """Days since 1960-01-01."""
    return F.date_add(F.lit("1960-01-01").cast("date"), F.col(days).cast("int") if isinstance(days, str) else days.cast("int"))


def month_of_yyyymmdd(number) -> Column:
    return F.floor(F.col(number) / 100).cast("int")


def inferred_fiscal_year(key) -> Column:
    """Fiscal year live in a month under the June convention."""
    k = F.col(key) if isinstance(key, str) else key
    year = F.floor(k / 100).cast("int")
    return F.when(k % 100 >= 6, year - 1).otherwise(year - 2)
