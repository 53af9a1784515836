"""Interval joins, link tables and picking one row of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_join(left: DataFrame, right: DataFrame, on: list[str], ts: str, start: str, end: str, strict_start: bool = False, how: str = "inner") -> DataFrame:
    """Rows of right whose [start, end] holds ts, by equal keys; NULL ends are open, and so is a NULL start if not strict."""
    r = right.select(*(F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns))
    cond = (F.col(ts) <= F.coalesce(r[end], F.lit("9999-12-31").cast("date"))) & ((F.col(ts) >= r[start]) if strict_start else (r[start].isNull() | (F.col(ts) >= r[start])))
    for c in on:
        cond = cond & (left[c] == r[f"_r_{c}"])
    return left.join(r, cond, how).drop(*(f"_r_{c}" for c in on))


def filter_links(df: DataFrame, types=("L*",), prim="ALL", type_col: str = "linktype", prim_col: str = "linkprim", target: str = "permno") -> DataFrame:
    """Links by type codes (a trailing * is a prefix rule) and primary codes, with a target."""
    rule: Column = F.lit(False)
    for t in types:
        rule = rule | (F.col(type_col).startswith(t[:-1]) if t.endswith("*") else F.col(type_col) == t)
    out = df.filter(rule & F.col(target).isNotNull())
    return out if prim == "ALL" else out.filter(F.col(prim_col).isin(list(prim)))


def pick_one(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a full order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def primary_links(df: DataFrame, keys: list[str], prim: str = "linkprim", target: str = "permno", start: str = "linkdt") -> DataFrame:
    """One link a key: primary P before C before others, then the smaller target, then the earlier link."""
    rank = F.when(F.col(prim) == "P", 0).when(F.col(prim) == "C", 1).otherwise(2)
    return pick_one(df, keys, [rank, F.col(target), F.col(start)])


def with_codes(months: DataFrame, reports: DataFrame, mode: str = "company", key: str = "permno", month: str = "signal_yyyymm", own: str = "siccd") -> DataFrame:
    """months with sic and sic2. reports: (key, month, sic, sic2) of the companies' reports that are live in a month.

    "company": both from the report, but for a sic2 that months have. "history": sic is the month's own code, and sic2 the report's, or where there is none the own code's.
    """
    if mode not in ("company", "history"):
        raise ValueError(f"no mode {mode}")
    r = reports.select(key, month, F.col("sic").alias("_sic"), F.col("sic2").alias("_sic2")).distinct()
    kept = F.col("sic2") if mode == "company" and "sic2" in months.columns else None
    j = (months.drop("sic") if kept is not None else months.drop("sic", "sic2")).join(r, [key, month], "left")
    two = F.substring(F.lpad(F.col(own).cast("int").cast("string"), 4, "0"), 1, 2)
    sic, sic2 = (F.col("_sic"), F.col("_sic2") if kept is None else kept) if mode == "company" else (F.col(own), F.coalesce("_sic2", two))
    return j.select(*(c for c in j.columns if c not in ("_sic", "_sic2", "sic2", own)), sic.alias("sic"), sic2.alias("sic2"))


def range_code(df: DataFrame, ranges: DataFrame, code: str, low: str, high: str, label: str, order: str, out: str) -> DataFrame:
    """df with the label of the last range, by order, that holds the code; NULL where none does.

    Ranges are spread over the codes they hold, so that the lookup is an equi-join.
    """
    spread = ranges.withColumn("_code", F.explode(F.sequence(low, high))).groupBy("_code").agg(F.max_by(label, order).alias(out))
    return df.join(spread, df[code].cast("int") == spread["_code"], "left").drop("_code")
