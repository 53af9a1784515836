"""Which months a report is live in."""

from datetime import date

from panelwright.operators import timing


def months(df):
    return sorted(r["signal_yyyymm"] for r in df.collect())


def test_rolling_window_of_a_june_report(spark):
    df = spark.createDataFrame([(1, date(2017, 6, 30), 0.1)], "permno int, datadate date, x double")
    got = months(timing.expand_rolling(df))
    assert got[0] == 201801 and got[-1] == 201901 and len(got) == 13 and 201806 in got and 201905 not in got


def test_latest_report_wins(spark):
    df = spark.createDataFrame([(1, date(2016, 12, 31), 0.1), (1, date(2017, 12, 31), 0.2)], "permno int, datadate date, x double")
    got = timing.expand_rolling(df).filter("signal_yyyymm = 201807").collect()
    assert [r["x"] for r in got] == [0.2]


def test_june_expansion(spark):
    df = spark.createDataFrame([(1, date(2017, 12, 31), 1.5)], "permno int, datadate date, bm double")
    got = months(timing.expand_fixed(df))
    assert got == [201806 + i for i in range(7)] + [201901 + i for i in range(5)]


def test_only_traded_months(spark):
    df = spark.createDataFrame([(1, date(2017, 6, 30), 0.1), (2, None, 1.0)], "permno int, datadate date, x double")
    spine = spark.createDataFrame([(1, 201803), (1, 201803), (2, 201803)], "permno int, signal_yyyymm int")
    assert months(timing.expand_rolling(df, spine=spine)) == [201803]


def test_asof_never_reads_the_future(spark):
    reports = spark.createDataFrame([(1, date(2020, m, 28), float(m)) for m in range(1, 13)], "permno int, datadate date, x double")
    spine = spark.createDataFrame([(1, 202000 + m) for m in range(1, 13)] + [(1, 202101)], "permno int, signal_yyyymm int")
    for r in timing.asof_window(spine, reports, values=["x"]).collect():
        if r["x"] is not None:
            assert 6 <= (r["signal_yyyymm"] // 100 * 12 + r["signal_yyyymm"] % 100) - (2020 * 12 + r["x"]) <= 10


def test_business_days_against_pandas(spark):
    import pandas as pd

    from panelwright.functions.calendar import add_business_days

    days = [d.date() for d in pd.date_range("2024-01-01", periods=21)]
    for n in (-30, -10, -3, -1, 1, 2, 7):
        df = spark.createDataFrame([(d,) for d in days], "d date").withColumn("x", add_business_days("d", n))
        for r in df.collect():
            assert r["x"] == (pd.Timestamp(r["d"]) + pd.tseries.offsets.BDay(n)).date(), (n, r)


def test_event_window(spark):
    from pyspark.sql import functions as F

    daily = spark.createDataFrame([(1, date(2024, 1, d), 1.0) for d in range(1, 32)], "permno int, date date, ret double")
    events = spark.createDataFrame([(1, date(2024, 1, 8))], "permno int, rdq date")  # a Monday: Friday 5 to Tuesday 9
    assert timing.event_window(events, daily, "permno", "rdq", "date", -1, 1, [F.sum("ret").alias("s")]).first()["s"] == 5.0
