"""Operators over one entity's rows in order, and over one cross-section's."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lagged(df: DataFrame, cols: list[str], k: list[int], key: str, order: str) -> DataFrame:
    """df with col_k: the value k rows before, in one pass over one window."""
    w = Window.partitionBy(key).orderBy(order)
    return df.select("*", *(F.lag(c, i).over(w).alias(f"{c}_{i}") for c in cols for i in k))


def lagged_by_calendar(df: DataFrame, col: str, months: int, key: str, index: str) -> DataFrame:
    """df with the value exactly so many months before, whatever rows are missing."""
    w = Window.partitionBy(key).orderBy(index).rangeBetween(-months, -months)
    return df.withColumn(f"{col}_m{months}", F.first(col).over(w))


def compound_lags(col: str, a: int, b: int, key: str, order: str) -> Column:
    """Product of 1 + col over the rows a to b before, less 1; NULL unless all are there."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-b, -a)
    return F.when(F.count(col).over(w) == b - a + 1, F.product(1 + F.col(col)).over(w) - 1)


def rolling_std(col: str, n: int, key: str, order: str) -> Column:
    """Sample deviation of the present and the n - 1 rows before, of what is not NULL; NULL below two values."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(n - 1), 0)
    return F.when(F.count(col).over(w) >= 2, F.stddev_samp(col).over(w))


def row_count(key: str, order: str) -> Column:
    return F.row_number().over(Window.partitionBy(key).orderBy(order))


def from_row(value, n: int, counter: str = "_row") -> Column:
    """value from the n-th row of an entity on."""
    return F.when(F.col(counter) >= n, value)


def forward_fill(col: str, key: str, order: str) -> Column:
    return F.last(col, ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def streak(col: str, key: str, order: str, most: int = 8) -> Column:
    """For how many rows in a row, up to now, the value has increased; `most` at most."""
    w = Window.partitionBy(key).orderBy(order)
    up = [F.coalesce(F.lag(col, i).over(w) > F.lag(col, i + 1).over(w), F.lit(False)) for i in range(most)]
    total, run = F.lit(0), F.lit(True)
    for u in up:
        run = run & u
        total = total + run.cast("int")
    return total


def perpetual_inventory(df: DataFrame, col: str, key: str, order: str, out: str, first: float = 0.25, keep: float = 0.85) -> DataFrame:
    """Stock of past flows: the first flow over `first`, later keep * stock + flow; a NULL flow leaves stock and row without.

    Flows are numbered and cut into blocks of so many that keep ** block is about 1e-200. In a block the stock is keep^i
    times a running sum of x_j keep^-j, whose powers stay finite; to it comes what the block before ended with, carried on.
    What lies further back weighs less than a double shows. So histories of any length take two windows.
    """
    block = max(1, int(200 / -math.log10(keep))) if 0 < keep < 1 else 1 << 40
    whole = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counted = df.withColumn("_n", F.count(col).over(whole) - 1)
    placed = counted.withColumn("_block", F.floor(F.col("_n") / block)).withColumn("_i", (F.col("_n") % block).cast("double"))
    part = F.when(F.col("_n") == 0, F.col(col) / first).otherwise(F.col(col)) * F.pow(F.lit(1 / keep), F.col("_i"))
    inside = Window.partitionBy(key, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumn("_local", F.when(F.col(col).isNotNull(), F.sum(part).over(inside) * F.pow(F.lit(keep), F.col("_i"))))
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    end = F.when(F.col("_i") == block - 1, F.col("_local"))
    carried = F.coalesce(F.last(end, ignorenulls=True).over(before), F.lit(0.0)) * F.pow(F.lit(keep), F.col("_i") + 1)
    return local.withColumn(out, F.col("_local") + carried).drop("_n", "_block", "_i", "_local")


def standardize(df: DataFrame, cols: list[str], order: str, mode: str = "expanding", min_periods: int = 60, by: str | None = None) -> DataFrame:
    """z-scores: 'none', 'full' sample, or 'expanding' once min_periods values are there.

    A series without `by` is one partition; it is a table of months.
    """
    if mode == "none":
        return df
    if mode == "full":
        stats = df.agg(*(f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_samp)))).first().asDict()
        return df.withColumns({c: (F.col(c) - stats[f"_m_{c}"]) / F.nullif(F.lit(stats[f"_s_{c}"]), F.lit(0.0)) for c in cols})
    w = Window.partitionBy(by or F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.when(F.count(c).over(w) >= min_periods, F.try_divide(F.col(c) - F.avg(c).over(w), F.stddev_samp(c).over(w))) for c in cols})


def average_rank(col, by: list[str]) -> Column:
    """Rank from 1 in which equal values share the mean of their places; NULL for NULL."""
    c = F.col(col) if isinstance(col, str) else col
    w = Window.partitionBy(*by, c.isNull()).orderBy(c)
    ties = Window.partitionBy(*by, c)
    return F.when(c.isNotNull(), F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2)


def islands(df: DataFrame, value: str, key: str, index: str, out: str) -> DataFrame:
    """Numbers the stretches of consecutive periods in which the value stays the same."""
    w = Window.partitionBy(key).orderBy(index)
    new = F.coalesce((F.lag(value).over(w) != F.col(value)) | (F.col(index) - F.lag(index).over(w) != 1), F.lit(True))
    return df.withColumn("_new", new.cast("int")).withColumn(out, F.sum("_new").over(w)).drop("_new")


def gap_clusters(df: DataFrame, by: list[str], value: str, tol: float = 1e-5, min_size: int = 1) -> DataFrame:
    """(by, cluster, size, low, high): values in order, cut where the next is more than tol away."""
    w = Window.partitionBy(*by).orderBy(value)
    cut = F.coalesce(F.col(value) - F.lag(value).over(w) > tol, F.lit(False)).cast("int")
    marked = df.dropna(subset=[value]).withColumn("_cut", cut).withColumn("cluster", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "cluster").agg(F.count("*").alias("size"), F.min(value).alias("low"), F.max(value).alias("high")).filter(F.col("size") >= min_size)


def month_end_flag(key: str, date: str) -> Column:
    """Whether the row is its key's last in the month."""
    return F.max(date).over(Window.partitionBy(key, F.trunc(date, "month"))) == F.col(date)
