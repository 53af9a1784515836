"""Where results of large tables parted from their SQL."""

import os
import random
import time
from datetime import date

import duckdb
from pyspark.sql import functions as F

from panelwright.functions.scalar import rounded
from panelwright.operators import compare, crosssection, panel, timing
from panelwright.plans import catalog


def query(name):
    return next(q for q in catalog.ALL if q.name == name)


def test_ties_are_rounded_as_sql_does(spark):
    df = spark.range(60_000).selectExpr("id / 10000e0 AS v", "id / 10000e0 - 0.5e0 AS w").union(spark.createDataFrame([(float("inf"), float("-inf")), (float("nan"), 1e308), (-1.005, None)], "v double, w double"))
    values = df.toPandas()
    got = df.select("v", rounded("v", 2).alias("a"), "w", rounded("w", 2).alias("b")).toPandas()
    want = duckdb.query_df(values, "x", "SELECT v, round(v, 2) AS a, w, round(w, 2) AS b FROM x").df()
    assert got.equals(want)


def test_recovered_means_of_ties(spark):
    rows = [(1, 1, 1.0), (1, 2, 1.005), (1, 3, 1.02), (2, 1, None)]
    got = query("recovered_means").build(lambda name: spark.createDataFrame(rows, "m int, industry int, implied double")).collect()
    want = duckdb.sql("SELECT m, count(DISTINCT round(implied, 2)) AS means, count(DISTINCT industry) AS industries FROM (VALUES (1, 1, 1.0e0), (1, 2, 1.005e0), (1, 3, 1.02e0), (2, 1, NULL)) t(m, industry, implied) GROUP BY 1").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) == [(1, 2, 3), (2, 0, 1)]


def test_ranks_keep_rows_whose_values_a_second_computation_moves(spark):
    drawn = F.udf(lambda i: i + random.SystemRandom().random() / 2, "double")  # as a mean whose last digit hangs on the order of its sum
    df = spark.range(500).select(drawn("id").alias("x"), F.col("id").cast("double").alias("y"))
    got = compare.spearman(df, [], 2, large=True).collect()
    assert [(r["n"], round(r["rho"], 9)) for r in got] == [(500, 1.0)]


def test_many_columns_are_drawn_in_as_few_are(spark, monkeypatch):
    names = ["betasq", "lev", "bm", "acc", "ep"]
    rows = [(None if i % 40 == 7 else 200001 + i % 2, i, *(None if (i + k) % 9 == 0 or k == 4 and i % 2 else float("inf") if i == 30 + k else ((i * 37 + k * 11) % 101 - 50) / 7 for k in range(5))) for i in range(300)]
    df = spark.createDataFrame(rows, "m int, id int, " + ", ".join(f"{n} double" for n in names))
    few = crosssection.winsorize_by_kind(df, ["m"], 0.05)
    want = sorted(map(tuple, few.collect()), key=lambda r: r[1])
    monkeypatch.setattr(crosssection, "BATCH", 2)
    many = crosssection.winsorize_by_kind(df, ["m"], 0.05)
    many.write.format("noop").mode("overwrite").save()
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert many.columns == few.columns and "Generate" not in plan and "Window" not in plan
    assert sorted(map(tuple, many.collect()), key=lambda r: r[1]) == want


def test_a_tables_shuffle_goes_with_its_writing(spark):
    def kept():
        return sum(f.startswith("shuffle_") for at in [spark.conf.get("spark.local.dir")] for _, _, files in os.walk(at) for f in files)

    before = kept()
    panel.cut_lineage(spark.range(2000).groupBy((F.col("id") % 7).alias("k")).count())
    until = time.time() + 10
    while kept() > before and time.time() < until:
        time.sleep(0.1)
    assert kept() <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_reports_are_picked_before_they_are_spread(spark):
    rows = [(1, date(y, 12, 31), g, float(g + y)) for y in (2000, 2001, 2003) for g in range(20)] + [(2, date(2000, 12, 31), 5, 1.0), (2, date(2000, 12, 10), 4, 2.0), (None, date(2000, 12, 31), 1, 1.0)]
    df = spark.createDataFrame(rows, "permno int, datadate date, gvkey int, x double")
    for got, first, months in ((timing.expand_rolling(df, ties=("gvkey",)), 7, 13), (timing.expand_fixed(df, ties=("gvkey",)), 6, 12)):
        want = {}
        for p, d, g, x in sorted((r for r in rows if r[0]), key=lambda r: (r[1], -r[2])):
            for m in range(d.year * 12 + 11 + first, d.year * 12 + 11 + first + months):
                want[p, m // 12 * 100 + m % 12 + 1] = (g, x)
        assert {(r["permno"], r["signal_yyyymm"]): (r["gvkey"], r["x"]) for r in got.collect()} == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.index("Generate") < plan.index("Window")  # windows are below, on reports


def test_many_columns_are_standardized_as_few_are(spark, monkeypatch):
    names = [f"x{k}" for k in range(5)]
    rows = [(i, 200001 + i % 2, None if i % 7 == 0 else i % 3, *(None if (i + k) % 9 == 0 or k == 4 and i % 2 else ((i * 37 + k * 11) % 101 - 50) / 7 for k in range(5))) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, m int, industry int, " + ", ".join(f"{n} double" for n in names))
    few = crosssection.standardized(df, names, ["m"], [["m", "industry"], ["m"]], 0.05, 0.95)
    bounds = [None, 0.05, None, 0.1, None]
    less = crosssection.in_long_form(df, names, ["m"], [crosssection.drawn_in(["m"], bounds, 0.9)])
    want, drawn = sorted(map(tuple, few.collect())), sorted(map(tuple, less.collect()))
    monkeypatch.setattr(crosssection, "BATCH", 2)
    many = crosssection.standardized(df, names, ["m"], [["m", "industry"], ["m"]], 0.05, 0.95)
    many.write.format("noop").mode("overwrite").save()
    assert many.columns == few.columns and "Window" not in many._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, many.collect())) == want
    assert sorted(map(tuple, crosssection.in_long_form(df, names, ["m"], [crosssection.drawn_in(["m"], bounds, 0.9)]).collect())) == drawn
