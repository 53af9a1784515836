"""Properties of windows, cross-sections, joins and regressions."""

from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.functions import scalar as s
from panelwright.operators import compare, crosssection, links, panel, regression, windows
from panelwright.plans import compare_queries


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), int(m), int(i) % 4 if i % 9 else None, None if rng.random() < 0.1 else float(np.round(rng.normal(), 1))) for m in range(12) for i in range(30)]
    return spark.createDataFrame(rows, "permno int, m int, industry int, x double").cache()


def test_ranks_lie_in_range_and_match_pandas(frame):
    got = crosssection.rank_unit(frame, ["x"], ["m"], fill=None).toPandas().sort_values(["m", "permno"])
    p = frame.toPandas().sort_values(["m", "permno"])
    g = p.groupby("m")["x"]
    want = 2 * (g.rank(method="average") - 1) / (g.transform("count") - 1) - 1
    assert np.allclose(got["x"].astype(float), want.astype(float), equal_nan=True)
    assert got["x"].abs().max() <= 1


def test_demeaned_cells_average_zero_and_keep_null_industry(frame):
    d = crosssection.demean(frame, ["industry", "m"], "x")
    assert d.count() == frame.count()
    assert d.groupBy("industry", "m").agg(F.abs(F.avg("x_ia")).alias("a")).agg(F.max("a")).first()[0] < 1e-12


def test_winsorize_stays_in_bounds_and_leaves_nulls(frame):
    w = crosssection.winsorize(frame, ["x"], ["m"], 0.1, 0.9)
    a, b = frame.groupBy("m").agg(F.min("x").alias("lo"), F.max("x").alias("hi")), w.groupBy("m").agg(F.min("x").alias("lo2"), F.max("x").alias("hi2"))
    assert a.join(b, "m").filter("lo2 < lo or hi2 > hi").isEmpty()
    assert w.filter("x is null").count() == frame.filter("x is null").count()


def test_imputed_values_are_all_there(frame):
    assert crosssection.impute_median(frame, ["x"], [["m", "industry"], ["m"]]).filter("x is null").isEmpty()


def test_compound_needs_all_rows(spark):
    df = spark.createDataFrame([(1, t, 0.1) for t in range(6)], "k int, t int, r double")
    got = [r["c"] for r in df.withColumn("c", windows.compound_lags("r", 2, 4, "k", "t")).orderBy("t").collect()]
    assert got[:4] == [None] * 4 and got[5] == pytest.approx(1.1**3 - 1)


def test_perpetual_inventory_against_a_loop(spark):
    flows = [None, 2.0, 3.0, None, 1.0, 4.0]
    df = spark.createDataFrame([(1, t, x) for t, x in enumerate(flows)], "k int, t int, x double")
    got = [r["s"] for r in windows.perpetual_inventory(df, "x", "k", "t", "s").orderBy("t").collect()]
    stock, want = None, []
    for x in flows:
        if x is None:
            want.append(None)
            continue
        stock = x / 0.25 if stock is None else 0.85 * stock + x
        want.append(stock)
    assert [None if g is None else round(g, 9) for g in got] == [None if w is None else round(w, 9) for w in want]


def test_streak(spark):
    df = spark.createDataFrame([(1, t, float(x)) for t, x in enumerate([1, 2, 3, 3, 4, 5, 6])], "k int, t int, x double")
    assert [r["s"] for r in df.withColumn("s", windows.streak("x", "k", "t")).orderBy("t").collect()] == [0, 1, 2, 0, 1, 2, 3]


def test_interval_join_open_ends(spark):
    left = spark.createDataFrame([(1, date(2000, 1, 1)), (1, date(1980, 1, 1)), (2, date(2000, 1, 1))], "k int, d date")
    right = spark.createDataFrame([(1, None, date(1990, 1, 1), "a"), (1, date(1995, 1, 1), None, "b")], "k int, s date, e date, v string")
    got = {(r["k"], r["d"].year): r["v"] for r in links.interval_join(left, right, ["k"], "d", "s", "e").collect()}
    assert got == {(1, 2000): "b", (1, 1980): "a"}
    assert links.interval_join(left, right, ["k"], "d", "s", "e", strict_start=True).count() == 1


def test_range_code_takes_the_last_range(spark):
    ranges = spark.createDataFrame([(100, 199, "a", 1), (150, 160, "b", 2)], "lo int, hi int, name string, ord int")
    got = {r["c"]: r["out"] for r in links.range_code(spark.createDataFrame([(100,), (155,), (300,)], "c int"), ranges, "c", "lo", "hi", "name", "ord", "out").collect()}
    assert got == {100: "a", 155: "b", 300: None}


def test_sic2(spark):
    df = spark.createDataFrame([("2834",), (None,), ("7372.0",), ("132",)], "sic string")
    assert [r[0] for r in df.select(s.sic2("sic")).collect()] == ["28", None, "73", "01"]
    assert [r[0] for r in df.select(s.sic2("sic", "prefix")).collect()] == ["28", None, "73", "13"]


def test_three_factor_residual_variance_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(66, 3))
    y = x @ [0.5, -0.2, 0.1] + rng.normal(size=66)
    days = pd.bdate_range("2020-01-01", periods=66)
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "date": [d.date() for d in days], "y": y, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]}))
    got = regression.residual_variance(df, "k", "date", "y", ["a", "b", "c"], "v").orderBy("m").toPandas()
    last = days[days.to_period("M") >= days[-1].to_period("M") - 2]
    n = len(last)
    z = np.column_stack([np.ones(n), x[-n:]])
    res = y[-n:] - z @ np.linalg.lstsq(z, y[-n:], rcond=None)[0]
    assert got["v"].iloc[-1] == pytest.approx(res.var(ddof=1))


def test_rolling_regression_and_delay_against_numpy(spark):
    rng = np.random.default_rng(4)
    weeks = pd.date_range("2015-01-02", periods=170, freq="7D")
    x = rng.normal(size=170)
    y = 0.7 * x + 0.3 * np.roll(x, 1) + rng.normal(size=170)
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "week": [d.date() for d in weeks], "y": y, "x": x}))
    spine = spark.createDataFrame([(1, 2018 * 12 + 2)], "k int, m int")  # March 2018: weeks of March 2015 to 1 February 2018
    got = regression.rolling_regression(df, spine, "k", "m", "week", "y", "x", lags=4).first()
    use = (weeks >= "2015-03-01") & (weeks <= "2018-02-01")
    z = np.column_stack([np.ones(use.sum()), x[use]])
    coef = np.linalg.lstsq(z, y[use], rcond=None)[0]
    assert got["n_obs"] == use.sum() and got["beta"] == pytest.approx(coef[1])
    assert got["idiovol"] == pytest.approx((y[use] - z @ coef).std(ddof=1))
    at = np.flatnonzero(use)[4:]

    def adjusted(cols):
        z = np.column_stack([np.ones(len(at)), *cols])
        r = y[at] - z @ np.linalg.lstsq(z, y[at], rcond=None)[0]
        r2 = 1 - r.var() / y[at].var()
        return 1 - (1 - r2) * (len(at) - 1) / (len(at) - z.shape[1])

    many = adjusted([x[at - i] for i in range(5)])
    at = np.flatnonzero(use)
    assert got["pricedelay"] == pytest.approx(1 - adjusted([x[at]]) / many)


def test_merge_features_first_frame_wins(spark):
    a = spark.createDataFrame([(1, 1, None, 5.0), (2, 1, 7, None)], "k int, t int, sic int, x double")
    b = spark.createDataFrame([(1, 1, 9, 6.0), (3, 1, 8, 1.0)], "k int, t int, sic int, x double")
    got = {r["k"]: (r["sic"], r["x"]) for r in panel.merge_features([a, b], ["k", "t"]).collect()}
    assert got == {1: (9, 5.0), 2: (7, None), 3: (8, 1.0)}


def test_required_feature_must_exist(spark):
    with pytest.raises(ValueError):
        panel.require(spark.createDataFrame([(1,)], "k int"), ["bm"])


def test_column_plan_and_trim(spark):
    df = spark.createDataFrame([(1, 2, 3)], "k int, a int, b int")
    assert panel.column_plan(df, ["a", "z"], ["k"]) == {"keep": ["k", "a"], "dropped": ["b"], "missing": ["z"]}
    assert panel.trim(df, ["a", "z"], ["k"]).columns == ["k", "a"]


def test_sinks_and_macro_reader(spark, tmp_path):
    from panelwright.sources import readers

    df = spark.createDataFrame([(1, 202001, float("nan")), (1, 202002, 2.0), (2, 202002, float("inf"))], "permno int, signal_yyyymm int, x double")
    panel.write_feature(df, "x", str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 1
    panel.write_panel(df, str(tmp_path / "p"), "signal_yyyymm")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    (tmp_path / "m.csv").write_text('yyyymm,Index,b/m\n202001,"1,234.5",0.5\n202002,n/a,\n')
    got = readers.read_macro_csv(spark, str(tmp_path / "m.csv")).orderBy("yyyymm").collect()
    assert (got[0]["index"], got[0]["bm"], got[1]["index"]) == (1234.5, 0.5, None)
    (tmp_path / "g.csv").write_text("permno,DATE,bm\n7,20200131,0.25\n")
    assert readers.read_reference_panel(spark, str(tmp_path / "g.csv"), ["bm"]).first().asDict() == {"permno": 7, "bm": 0.25, "signal_yyyymm": 202001}


def test_features_can_be_registered(spark):
    from panelwright.plans import features

    features.register("annual", "own_ratio", features.ratio("ib - ib_1", "assets"), 2)
    try:
        df = spark.createDataFrame([(1, date(2000, 12, 31), 1.0, 10.0), (1, date(2001, 12, 31), 3.0, 10.0)], "gvkey int, datadate date, ib double, assets double")
        got = features.evaluate(df, "annual", "gvkey", "datadate", ["own_ratio"]).orderBy("datadate").collect()
        assert [r["own_ratio"] for r in got] == [None, 0.2]
    finally:
        del features.ANNUAL["own_ratio"]


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 1.0), ("b", 2.0, 2.0)], "char string, x double, y double")
    got = {r["char"]: r["rho"] for r in compare.spearman(df, ["char"]).collect()}
    assert got["a"] is None and got["b"] == pytest.approx(1.0)


def test_agreement_matrix_ranks_all_rows_over_many_tasks(spark):
    rng = np.random.default_rng(7)
    p = pd.DataFrame({"permno": range(900), "m": [23980 + i % 20 for i in range(900)], "a": np.round(rng.normal(size=900), 1), "c": rng.normal(size=900)}).assign(b=np.round(rng.uniform(1000, 1040, 900), 1))
    q = p[["permno", "m"]].assign(a2=p["a"] + np.round(rng.normal(size=900), 2), b2=p["b"] + rng.normal(size=900), c2=-p["c"] + rng.normal(size=900))
    views, cols = {"panel_a": spark.createDataFrame(p), "panel_b": spark.createDataFrame(q)}, ["a", "b", "c", "a2", "b2", "c2"]
    want = p.merge(q, on=["permno", "m"])[cols].rank().corr()
    query = next(x for x in compare_queries.QUERIES if x.name == "agreement_matrix")
    for got in (query.build(views.__getitem__), compare.agreement_matrix(views["panel_a"].join(views["panel_b"], ["permno", "m"]), cols)):
        rows = got.collect()
        assert len(rows) == 21 and all(r["corr"] == pytest.approx(want.loc[r["a"], r["b"]]) for r in rows)
    ranks = {r["c"]: r["rank"] for r in compare.with_ranks(views["panel_a"].select("c"), {"c": "rank"}, []).collect()}
    assert ranks == dict(zip(p["c"], p["c"].rank(), strict=True))
    q = compare.quantiles(views["panel_a"].withColumn("g", F.col("permno") % 3), ["g"], "a", {"low": 0.05, "mid": 0.5, "high": 0.99})
    for r in q.collect():
        assert [r["low"], r["mid"], r["high"]] == pytest.approx(p[p["permno"] % 3 == r["g"]]["a"].quantile([0.05, 0.5, 0.99]).tolist())


def test_industry_schemes_as_published_text(spark):
    from panelwright.functions import industry

    text = " 1 Agric  Agriculture\n          0100-0199 Crops\n          0910-0919 Fishing\n\n 2 Food   Food Products\n          0115-0115 Odd\n          2000-2046 Food\n"
    df = spark.createDataFrame([(110,), (115,), (2046,), (9999,), (None,)], "sic int")
    assert [r["ffi"] for r in industry.with_scheme(df, text).orderBy(F.col("sic").asc_nulls_last()).collect()] == [1, 2, 2, None, None]
    assert {len({n for n, *_ in industry.ranges(k)}) for k in (5, 10, 12)} == {4, 9, 11}


def test_codes_with_and_without_reports(spark):
    months = spark.createDataFrame([(1, 200001, 132), (1, 200002, 132)], "permno int, signal_yyyymm int, siccd int")
    reports = spark.createDataFrame([(1, 200001, 2834, "28")], "permno int, signal_yyyymm int, sic int, sic2 string")
    got = {m: [(r["sic"], r["sic2"]) for r in links.with_codes(months, reports, m).orderBy("signal_yyyymm").collect()] for m in ("company", "history")}
    assert got == {"company": [(2834, "28"), (None, None)], "history": [(132, "28"), (132, "01")]}
    with pytest.raises(ValueError):
        links.with_codes(months, reports, "other")


def test_distress_codes_and_exchanges(spark):
    rows = [(None, 500, 1), (None, 501, 1), (None, 504, 3), (None, 505, 3), (None, 510, 2), (None, 584, 4), (None, 560, None), (-0.2, 560, 1), (None, 585, 1)]
    df = spark.createDataFrame(rows, "dlret double, dlstcd int, exchcd int")
    assert [r[0] for r in df.select(panel.distress_return("dlret", "dlstcd", "exchcd")).collect()] == [-0.35, None, None, -0.55, -0.35, None, None, -0.2, None]


def test_daily_excess_compounds_delistings_and_fills_missing_returns(spark):
    day = date(2020, 1, 2)
    daily = spark.createDataFrame([(1, day, None), (2, day, 0.1), (3, day, 0.1)], "permno int, date date, ret double")
    delist = spark.createDataFrame([(1, day, -0.5), (2, day, None)], "permno int, date date, dlret double")
    factors = spark.createDataFrame([(day, 0.01)], "date date, rf double")
    got = {r["permno"]: r["exret"] for r in regression.daily_excess(daily, delist, factors).collect()}
    assert got == pytest.approx({1: -0.51, 2: 0.09, 3: 0.09})


def test_published_features_are_kept_under_either_name(spark):
    from panelwright.plans import profiles

    df = spark.createDataFrame([(1, 2.0, 3.0, 4.0)], "permno int, book_to_market double, mom1m double, own double")
    assert profiles.allowed(df, ["permno"]).columns == ["permno", "book_to_market", "mom1m"]


def test_month_spine_takes_the_first_table_that_has_all_columns(spark):
    from panelwright.operators import panel

    needs = ("permno", "signal_yyyymm", "sic")
    short = spark.createDataFrame([(1, 199001)], "permno int, signal_yyyymm int")
    whole = spark.createDataFrame([(1, 199003, 10, "x"), (1, 199001, 10, "y"), (2, 199002, None, "z")], "permno int, signal_yyyymm int, sic int, other string")
    told = whole.selectExpr("permno", "signal_yyyymm", "sic", "7 AS source_yyyymm")

    def never():
        raise AssertionError("built although a stored table serves")

    got = sorted(map(tuple, panel.month_spine([short, whole, told], never, needs).collect()))
    assert got == [(1, 199001, 10, None), (1, 199003, 10, 199001), (2, 199002, None, None)]
    assert {r["source_yyyymm"] for r in panel.month_spine([told], never, needs).collect()} == {7}
    assert sorted(map(tuple, panel.month_spine([short], lambda: whole, needs).collect())) == got
    assert panel.month_spine([], lambda: whole.limit(0), needs).isEmpty()


def test_stated_equity_is_not_made_up(spark):
    from panelwright.plans import monthly

    rows = [(1, 10.0, None, None, None, None), (2, None, 5.0, None, None, None), (3, 10.0, 1.0, 2.0, 3.0, 4.0), (4, 10.0, 1.0, None, 3.0, 4.0), (5, 10.0, None, None, None, 4.0), (6, 2.0, None, None, None, 2.0)]
    df = spark.createDataFrame(rows, "k int, seq double, txditc double, pstkrv double, pstkl double, pstk double")
    assert {r["k"]: r["book"] for r in monthly.stated_equity(df).collect()} == {1: 10.0, 3: 9.0, 4: 8.0, 5: 6.0}
