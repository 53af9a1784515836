"""Reverse engineering of adjusted columns: which benchmark was taken off, when it moves, and why."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import correlation, rounded
from .crosssection import back, modal


def cell_dispersion(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.stddev_samp(value).alias("std"), F.avg(value).alias("mean"))


def constancy(df: DataFrame, by: list[str], value: str, tol: float = 1e-6, min_n: int = 3) -> DataFrame:
    """(cells, constant_share, r2): cells whose value is one number, and how much of its variance lies between cells."""
    cells = df.dropna(subset=[value]).groupBy(*by).agg(F.count("*").alias("n"), (F.max(value) - F.min(value)).alias("range"), F.var_pop(value).alias("v")).filter(F.col("n") >= min_n)
    used = back(df.dropna(subset=[value]), cells.select(*by, "n"), by, "inner")
    total = used.agg(F.var_pop(value).alias("total"))
    one = cells.agg(F.count("*").alias("cells"), F.avg((F.col("range") <= tol).cast("double")).alias("constant_share"), F.sum(F.col("v") * F.col("n")).alias("within"), F.sum("n").alias("rows"))
    return one.join(F.broadcast(total)).select("cells", "constant_share", (1 - F.try_divide(F.try_divide(F.col("within"), F.col("rows").cast("double")), F.col("total"))).alias("r2"))


def reconstruct(df: DataFrame, by: list[str], base: str, adjusted: str, tol: float = 1e-6) -> DataFrame:
    """(n, match, corr) of base less its cell mean against the adjusted column."""
    use = df.dropna(subset=[base])
    j = back(use, use.groupBy(*by).agg(F.avg(base).alias("_mean")), by).dropna(subset=[adjusted])
    r = F.col(base) - F.col("_mean")
    return j.agg(F.count("*").alias("n"), F.avg((F.abs(r - F.col(adjusted)) <= tol).cast("double")).alias("match"), correlation(r, F.col(adjusted)).alias("corr"))


def modal_benchmark(df: DataFrame, industry: str, month: str, implied: str, digits: int = 6) -> DataFrame:
    """Each cell's most frequent implied benchmark with its dominance."""
    return modal(df, [industry, month], implied, digits).withColumn("dominance", F.col("mode_n") / F.col("n"))


def off_mode_matches(df: DataFrame, industry: str, month: str, implied: str, digits: int = 6) -> DataFrame:
    """(off, matched): rows off their cell's mode, and those at another industry's mode of the same month."""
    m = modal(df, [industry, month], implied, digits).select(industry, month, "mode")
    off = back(df.dropna(subset=[implied]), m, [industry, month], "inner").withColumn("_v", rounded(implied, digits)).filter(F.col("_v") != F.col("mode"))
    other = m.select(F.col(month).alias("_mm"), F.col("mode").alias("_other")).distinct()
    j = off.join(other, (F.col(month) == F.col("_mm")) & (F.col("_v") == F.col("_other")), "left")
    return j.agg(F.count("*").alias("off"), F.count("_other").alias("matched"))


def window_linearity(df: DataFrame, island: str, key: list[str], x: str, y: str, min_n: int = 8) -> DataFrame:
    return df.groupBy(*key, island).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2")).filter(F.col("n") >= min_n)


def movement(members: DataFrame, benchmark: DataFrame, industry: str, index: str, key: str, value: str, mark: str, tol: float = 1e-6) -> DataFrame:
    """(refresh, churn, pairs, moved): cells of following months by whether a member's value changed and whether
    members changed, and in how many the benchmark moved."""
    w = Window.partitionBy(industry, key).orderBy(index)
    was = F.lag(index).over(w) == F.col(index) - 1
    next_in = F.lead(index).over(w) == F.col(index) + 1
    m = members.select(industry, index, key, was.alias("_was"), (was & (F.abs(F.col(value) - F.lag(value).over(w)) > tol)).alias("_new"), next_in.alias("_next"))
    cells = m.groupBy(industry, index).agg(F.max(F.coalesce("_new", F.lit(False)).cast("int")).alias("refresh"), F.max((~F.coalesce("_was", F.lit(False))).cast("int")).alias("came"), F.max((~F.coalesce("_next", F.lit(False))).cast("int")).alias("went"))
    b = Window.partitionBy(industry).orderBy(index)
    left = F.when(F.lag(index).over(b) == F.col(index) - 1, F.lag("went").over(b))
    flags = cells.withColumn("_left", left).filter(F.col("_left").isNotNull()).withColumn("churn", F.greatest("came", "_left"))
    moves = benchmark.select(industry, index, F.when(F.lag(index).over(b) == F.col(index) - 1, (F.abs(F.col(mark) - F.lag(mark).over(b)) > tol).cast("int")).alias("moved")).dropna(subset=["moved"])
    return flags.join(moves, [industry, index]).groupBy("refresh", "churn").agg(F.count("*").alias("pairs"), F.sum("moved").alias("moved"))


def robust_means(df: DataFrame, by: list[str], value: str, cut: float = 0.05) -> DataFrame:
    """Each cell's mean, trimmed mean, winsorized mean and median."""
    use = df.dropna(subset=[value])
    b = use.groupBy(*by).agg(F.percentile(value, F.array(F.lit(cut), F.lit(1 - cut))).alias("_q"))
    v = F.col(value)
    j = back(use, b, by, "inner").withColumns({"_lo": F.col("_q")[0], "_hi": F.col("_q")[1]})
    return j.groupBy(*by).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.avg(F.when(v.between(F.col("_lo"), F.col("_hi")), v)).alias("trimmed"), F.avg(F.least(F.greatest(v, F.col("_lo")), F.col("_hi"))).alias("winsorized"), F.median(v).alias("median"))


def sum_identity(df: DataFrame, by: list[str], base: str, adjusted: str) -> DataFrame:
    """Of each cell the sum that adjusting should bring to zero, the benchmark that it implies, and how many members a
    benchmark of the base's sum would need; with the size of what is left."""
    use = df.dropna(subset=[base, adjusted])
    g = use.groupBy(*by).agg(F.count("*").alias("n"), F.sum(adjusted).alias("residual"), F.avg(F.col(base) - F.col(adjusted)).alias("benchmark"), F.sum(base).alias("_sum"))
    return g.withColumn("members", F.try_divide(F.col("_sum"), F.col("benchmark"))).withColumn("bucket", F.when(F.abs("residual") < 1e-6, "zero").when(F.abs("residual") < 0.1, "small").otherwise("large")).drop("_sum")


def coverage_funnel(stages: dict[str, DataFrame], col: str) -> DataFrame:
    """(stage, step, rows, present) of each stage, in order."""
    parts = [d.agg(F.count("*").alias("rows"), F.count(col).alias("present")).select(F.lit(n).alias("stage"), F.lit(i).alias("step"), "rows", "present") for i, (n, d) in enumerate(stages.items())]
    return reduce(lambda a, b: a.unionByName(b), parts)


def null_asymmetry(df: DataFrame, a: str, b: str) -> DataFrame:
    n = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("long")
    x, y = F.col(a).isNull(), F.col(b).isNull()
    return df.agg(n(~x & ~y).alias("shared"), n(~x & y).alias("left_only"), n(x & ~y).alias("right_only"), n(x & y).alias("neither"))


def code_mismatch(a: DataFrame, b: DataFrame, keys: list[str], code: str) -> DataFrame:
    """(kind, n): where two sources' codes agree, differ within the first two digits or beyond, or one is missing."""
    j = a.select(*keys, F.col(code).alias("_x")).join(b.select(*keys, F.col(code).alias("_y")), keys, "full_outer")
    kind = F.when(F.col("_x").isNull() & F.col("_y").isNull(), "no code").when(F.col("_x").isNull(), "right only").when(F.col("_y").isNull(), "left only").when(F.col("_x") == F.col("_y"), "same").when(F.floor(F.col("_x") / 100) == F.floor(F.col("_y") / 100), "same two digits").otherwise("different")
    return j.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def duplicate_columns(df: DataFrame, a: str, b: str, tol: float = 1e-8) -> DataFrame:
    use = df.dropna(subset=[a, b])
    return use.agg(F.count("*").alias("n"), F.avg((F.abs(F.col(a) - F.col(b)) <= tol + 1e-5 * F.abs(b)).cast("double")).alias("close"), correlation(a, b).alias("corr"))


def late_starts(df: DataFrame, cols: list[str], date: str, limit: str) -> DataFrame:
    """(char, first): columns whose first value comes after a date."""
    long = df.select(date, F.explode(F.array(*(F.struct(F.lit(c).alias("char"), F.col(c).cast("double").alias("v")) for c in cols))).alias("_kv")).select(date, "_kv.*").dropna(subset=["v"])
    return long.groupBy("char").agg(F.min(date).alias("first")).filter(F.col("first") > F.lit(limit).cast("date"))


def negative_audit(df: DataFrame, key: str, col: str) -> DataFrame:
    """(entities, any_negative, all_negative, rows_negative) of a column that should not be negative."""
    per = df.dropna(subset=[col]).groupBy(key).agg(F.bool_or(F.col(col) < 0).alias("a"), F.bool_and(F.col(col) < 0).alias("e"), F.sum((F.col(col) < 0).cast("int")).alias("r"))
    return per.agg(F.count("*").alias("entities"), F.sum(F.col("a").cast("int")).alias("any_negative"), F.sum(F.col("e").cast("int")).alias("all_negative"), F.sum("r").alias("rows_negative"))


def inventory(df: DataFrame, entity: str, time: str) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.countDistinct(entity).alias("entities"), F.countDistinct(time).alias("periods"), F.min(time).alias("first"), F.max(time).alias("last"))


def score_decomposition(df: DataFrame, parts: list[tuple[str, str]], total: tuple[str, str]) -> DataFrame:
    """(component, n, differ, over, under, false_zero) of score components and of the total against another source's."""
    pairs = [*parts, total]
    long = df.select(F.explode(F.array(*(F.struct(F.lit(a).alias("component"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in pairs))).alias("_kv")).select("_kv.*").dropna(subset=["x", "y"])
    n = lambda c: F.sum(c.cast("int")).alias
    return long.groupBy("component").agg(F.count("*").alias("n"), n(F.col("x") != F.col("y"))("differ"), n(F.col("x") > F.col("y"))("over"), n(F.col("x") < F.col("y"))("under"), n((F.col("x") == 0) & (F.col("y") != 0))("false_zero"))


def staircase(means: DataFrame, month: str, industry: str, value: str) -> DataFrame:
    """Each month's industries in order of their mean."""
    return means.withColumn("place", F.row_number().over(Window.partitionBy(month).orderBy(value, industry)))
