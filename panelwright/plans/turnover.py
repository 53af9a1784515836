"""Search for the definition and timing that a published industry-adjusted change of asset turnover has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ratio
from ..operators import compare, timing
from ..operators.crosssection import demean
from ..operators.links import pick_one
from ..operators.panel import cut_lineage

#: Definitions, and of how many of a company's first linked reports their values are left out.
CANDIDATES = {"chato": 2, "chato_ia": 2, "masked_ia": 2, "ato": 0, "ato_ia": 0, "change": 1, "change_ia": 2, "pct": 1, "pct_ia": 1, "chato_scheme": 2, "change_scheme": 2, "own": 2, "own_ia": 2}


def company_candidates(reports: DataFrame, scheme: str, key: str = "gvkey", date: str = "datadate", year: str = "fyear", industry: str = "sic2") -> DataFrame:
    """reports with turnovers, their changes, and both less industry means.

    `chato` takes averages of assets two years back, `change` is of the turnover itself and `pct` its growth. `_ia` is less
    the mean of fiscal year and industry, `_scheme` less that of report month and scheme, and `masked_ia` takes means
    after the first two reports are left out.
    """
    w = Window.partitionBy(key).orderBy(date)
    lag = lambda c, k=1: F.lag(c, k).over(w)
    level = reports.withColumns({"ato": ratio(F.col("sale"), (F.col("assets") + lag("assets")) / 2), "_before": ratio(lag("sale"), (lag("assets") + lag("assets", 2)) / 2), "_n": F.row_number().over(w), "_month": F.year(date) * 12 + F.month(date)})
    chato: Column = F.col("ato") - F.col("_before")
    change = F.col("ato") - lag("ato")
    flat = level.withColumns({"chato": chato, "masked": F.when(F.col("_n") > 2, chato), "change": change, "pct": ratio(change, lag("ato"))})
    flat = demean(flat, [year, industry], ["chato", "masked", "ato", "change", "pct"])
    return demean(flat, [scheme, "_month"], ["chato", "change"], out=["chato_scheme", "change_scheme"]).drop("_before", "_n", "_month", "masked")


def candidates(reports: DataFrame, linked: DataFrame, scheme: str, key: str = "gvkey", to: str = "permno", date: str = "datadate", year: str = "fyear", industry: str = "sic2") -> DataFrame:
    """(to, date, CANDIDATES) of linked reports; `own` changes by the entity's reports instead of the company's. linked: (key, date, to)."""
    met = company_candidates(reports, scheme, key, date, year, industry).join(linked.select(key, date, to).distinct(), [key, date])
    own = Window.partitionBy(to).orderBy(date)
    met = pick_one(met, [to, date], [key]).withColumn("_own", ratio(F.col("sale"), (F.col("assets") + F.lag("assets").over(own)) / 2))
    met = demean(met.withColumn("own", F.col("_own") - F.lag("_own").over(own)), [year, industry], "own")
    place = F.row_number().over(Window.partitionBy(key).orderBy(to, date))
    return met.withColumn("_k", place).select(to, date, *(F.when(F.col("_k") > first, F.col(c)).alias(c) for c, first in CANDIDATES.items()))


def search(found: DataFrame, target: DataFrame, value: str, key: str = "permno", date: str = "datadate", decimals: int = 9) -> DataFrame:
    """How each candidate agrees with target (key, signal_yyyymm, value), live from June on or from four months after a report until the next.

    The months that both have are written once for the statistics, which read them several times.
    """
    live = {"june": timing.expand_fixed(found, key, date), "next_report": timing.until_next_report(found, key, date)}
    both = live["june"].withColumn("timing", F.lit("june")).unionByName(live["next_report"].withColumn("timing", F.lit("next_report")))
    met = cut_lineage(both.join(target.select(key, "signal_yyyymm", F.round(value, decimals).alias("y")), [key, "signal_yyyymm"]).filter("y IS NOT NULL"))
    p = met.select("timing", "y", F.explode(F.array(*(F.struct(F.lit(c).alias("candidate"), F.round(c, decimals).alias("x")) for c in CANDIDATES))).alias("_c")).select("timing", "y", "_c.*").dropna(subset=["x"])
    by = ["candidate", "timing"]
    return compare.spearman(p, by, 3, large=True).join(compare.differences(p, by), by).join(compare.winsorized_corr(p, by), by)
