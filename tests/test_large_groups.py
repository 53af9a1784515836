"""Plans and results where groups are large, histories long and values odd."""

import math
from collections import Counter
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.functions import industry
from panelwright.operators import compare, crosssection, links, panel, regression, windows
from panelwright.plans import monthly, planner, profiles
from panelwright.sources import readers
from panelwright.storage import scratch


def plan_of(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()



def test_a_loss_of_all_makes_the_week_one(spark):
    monday = date(2021, 3, 1)
    rows = [(1, monday, -1.0), (1, monday + timedelta(1), 0.1), (2, monday, None), (2, monday + timedelta(1), 0.1), (3, monday, None), (4, monday, -2.0), (4, monday + timedelta(2), 0.5)]
    df = spark.createDataFrame(rows, "permno int, date date, ret double")
    got = {r["permno"]: r["ret"] for r in regression.compound(df, "permno", "date", "ret").collect()}
    assert got == {1: -1.0, 2: pytest.approx(0.1), 3: None, 4: pytest.approx(0.5)}


@pytest.mark.parametrize("depth", [3, 50, 4096])
def test_ranks_and_quantiles_of_narrow_infinite_and_repeated_values(spark, depth):
    rng = np.random.default_rng(2)
    values = [float(np.round(x, 2)) for x in rng.uniform(1000, 1040, 900)] + [math.inf, math.inf, -math.inf, 0.0, -0.0, 1e-300, -5.0]
    rows = [(g, v) for g in ("a", "b") for v in (values if g == "a" else values[:5])] + [("c", 7.0), ("a", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {(r["g"], r["_v"]): (r["n"], r["below"]) for r in compare.places(df, ["g"], "x", depth).collect()}
    for g in "abc":
        own = [v for k, v in rows if k == g and v is not None]
        assert {v: x for (k, v), x in got.items() if k == g} == {v: (own.count(v), sum(w < v for w in own)) for v in own}
    q = {r["g"]: r for r in compare.quantiles(df, ["g"], "x", {"lo": 0.25, "hi": 1.0}).collect()}
    assert q["a"]["hi"] == math.inf and q["a"]["lo"] == pytest.approx(np.quantile([v for v in values if abs(v) < 1e9] + [-1e9, 1e9, 1e9], 0.25)) and q["c"]["lo"] == q["c"]["hi"] == 7.0
    whole = compare.with_ranks(df.dropna().select("x"), {"x": "r"}, []).toPandas()
    assert sorted(whole["r"]) == sorted(pd.Series([v for _, v in rows if v is not None]).rank())


def test_no_range_of_a_narrow_column_is_deep(spark):
    df = spark.range(200_000).select((1000 + F.rand(3) * 40).alias("_v"))
    counts = df.groupBy("_v").count()
    cuts = compare.splitters(counts.withColumn("g", F.lit(1)), ["g"], 2000).first()["_cuts"]
    at = np.searchsorted(np.array(cuts), np.array([r["_v"] for r in df.collect()]))
    depths = np.bincount(at)
    assert 60 < len(cuts) < 160 and cuts == sorted(cuts) and depths.max() < 12 * 2000 and np.sort(depths)[-1] < 0.1 * 200_000


def brute_windows(weekly, months, back=(36, 1)):
    out = {}
    for key, m in months:
        lo, hi = m - back[0], m - back[1]
        out[key, m] = [w for w in weekly if w[0] == key and (lo, 1) <= (w[1].year * 12 + w[1].month - 1, w[1].day) and (w[1].year * 12 + w[1].month - 1, w[1].day) <= (hi, 1)]
    return out


def test_rolled_sums_against_every_window(spark):
    """Weeks with gaps, some of them on a first of the month, and months without any week before them."""
    rng = np.random.default_rng(7)
    first = date(1999, 1, 1)  # a Friday and a first of the month
    weekly = [(k, first + timedelta(7 * i), float(rng.normal(0.002, 0.03)), float(rng.normal(0.001, 0.02))) for k in (1, 2) for i in range(230) if rng.random() > (0.05 if k == 1 else 0.4)]
    months = [(k, y * 12 + m) for k in (1, 2, 3) for y in range(1999, 2004) for m in range(12)]
    obs = spark.createDataFrame(weekly, "permno int, week date, ret double, mkt double")
    spine = spark.createDataFrame(months, "permno int, m int")
    got = {(r["permno"], r["m"]): r for r in regression.rolling_regression(obs, spine, "permno", "m", "week", "ret", "mkt", lags=4).collect()}
    seen = 0
    for at, rows in brute_windows(weekly, months).items():
        if len(rows) < 52:
            assert at not in got
            continue
        rows.sort(key=lambda r: r[1])
        y, x = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
        beta = np.cov(x, y, bias=True)[0, 1] / x.var()
        rest = ((y - y.mean()) ** 2).sum() - beta**2 * ((x - x.mean()) ** 2).sum()
        r = got[at]
        assert r["n_obs"] == len(rows) and r["beta"] == pytest.approx(beta) and r["idiovol"] == pytest.approx(math.sqrt(rest / (len(rows) - 1)))
        past = {w: [row[3] for row in weekly if row[0] == at[0] and row[1] < w][-4:][::-1] for w in (row[1] for row in rows)}
        use = [i for i in range(4, len(rows)) if len(past[rows[i][1]]) == 4]
        a = np.column_stack([np.ones(len(use)), x[use], np.array([past[rows[i][1]] for i in use])])
        fit = a @ np.linalg.lstsq(a, y[use], rcond=None)[0]
        r2 = lambda e, z, n, k: 1 - (e**2).sum() / ((z - z.mean()) ** 2).sum() * (n - 1) / (n - k - 1)
        one = r2(y - (y.mean() + beta * (x - x.mean())), y, len(rows), 1)
        assert r["pricedelay"] == pytest.approx(1 - one / r2(y[use] - fit, y[use], len(use), 5), rel=1e-6)
        seen += 1
    assert seen > 60


def test_weeks_are_not_copied_for_their_windows(spark):
    obs = spark.range(4000).select((F.col("id") % 5).cast("int").alias("permno"), F.expr("date_add(date'1990-01-05', cast(7 * floor(id / 5) as int))").alias("week"), F.rand(1).alias("ret"), F.rand(2).alias("mkt"))
    spine = obs.select("permno", (F.year("week") * 12 + F.month("week") - 1).alias("m")).distinct()
    for lags in (0, 4):
        plan = plan_of(regression.rolling_regression(obs, spine, "permno", "m", "week", "ret", "mkt", lags=lags))
        assert "Generate" not in plan and "RangeFrame" in plan


def wide(spark, n=400, width=60, months=4):
    return spark.range(n).select(F.col("id").alias("permno"), (F.col("id") % months).cast("int").alias("m"), (F.col("id") % 7).cast("int").alias("industry"), *(F.when(F.col("id") % (i + 3) > 0, F.round(F.rand(i) * 50)).alias(f"c{i}") for i in range(width)))


def test_sixty_columns_take_one_exchange(spark):
    df = wide(spark)
    cols = [c for c in df.columns if c[0] == "c"]
    for out in (crosssection.rank_unit(df, cols, ["m"]), crosssection.winsorize(df, cols, ["m"]), crosssection.standardized(df, cols, ["m"], [["m", "industry"], ["m"]])):
        plan = plan_of(out).split("== Initial Plan ==")[-1]
        assert plan.count("Exchange ") == 1 and "percentile" not in plan and out.columns == df.columns


def test_standardized_against_pandas(spark):
    df = wide(spark, width=6)
    cols = [f"c{i}" for i in range(6)]
    p = df.toPandas().sort_values("permno").reset_index(drop=True)
    got = crosssection.standardized(df, cols, ["m"], [["m", "industry"], ["m"]], 0.1, 0.9).toPandas().sort_values("permno").reset_index(drop=True)
    for c in cols:
        g = p.groupby("m")[c]
        v = p[c].clip(g.transform(lambda s: s.quantile(0.1)), g.transform(lambda s: s.quantile(0.9)))
        v = v.fillna(v.groupby([p["m"], p["industry"]]).transform("median")).fillna(v.groupby(p["m"]).transform("median"))
        n, r = v.groupby(p["m"]).transform("count"), v.groupby(p["m"]).rank()
        assert np.allclose(got[c], np.nan_to_num(2 * (r - 1) / (n - 1) - 1))  # a month without any value is all 0


def test_long_form_keeps_rows_that_repeat_and_null_groups(spark):
    df = spark.createDataFrame([(1, None, 2.0, "a"), (1, None, 2.0, "a"), (1, None, None, None), (2, 5, 9.0, "b")], "permno int, m int, x double, name string")
    got = Counter(tuple(r) for r in crosssection.rank_unit(df, ["x"], ["m"], fill=None).collect())
    assert got == Counter({(1, None, 0.0, "a"): 2, (1, None, None, None): 1, (2, 5, 0.0, "b"): 1})
    assert crosssection.rank_unit(df.limit(0), ["x"], ["m"]).isEmpty() and crosssection.rank_unit(df, [], ["m"]).count() == 4


@pytest.mark.parametrize("keep,n", [(0.85, 10_000), (0.5, 3000), (0.99, 500)])
def test_long_stocks_of_flows_against_a_loop(spark, keep, n):
    rng = np.random.default_rng(4)
    flows = [None if rng.random() < 0.05 else float(x) for x in rng.lognormal(0, 2, n)]
    df = spark.createDataFrame([(k, t, x) for k in (1, 2) for t, x in enumerate(flows if k == 1 else flows[: n // 3])], "k int, t int, x double")
    got = {(r["k"], r["t"]): r["s"] for r in windows.perpetual_inventory(df, "x", "k", "t", "s", keep=keep).collect()}
    for k, own in ((1, flows), (2, flows[: n // 3])):
        stock = None
        for t, x in enumerate(own):
            stock = stock if x is None else x / 0.25 if stock is None else keep * stock + x
            assert got[k, t] is None if x is None else got[k, t] == pytest.approx(stock, rel=1e-9)


def test_months_without_factors_count_as_observed(spark):
    day = lambda m, d: date(2020, m, d)
    rng = np.random.default_rng(1)
    rows = [(1, day(m, d), float(rng.normal())) for m in (1, 2, 3, 4) for d in range(1, 28)]
    factors = [(day(m, d), 0.0, float(rng.normal())) for m in (1, 3, 4) for d in range(1, 28)]
    daily, none = spark.createDataFrame(rows, "permno int, date date, ret double"), spark.createDataFrame([], "permno int, date date, dlret double")
    excess = regression.daily_excess(daily, none, spark.createDataFrame(factors, "date date, rf double, mktrf double"), out="y")
    got = {r["m"] % 12 + 1: r["v"] for r in regression.residual_variance(excess, "permno", "date", "y", ["mktrf"], "v").collect()}
    of = {d: x for d, _, x in factors}
    for m, window in ((1, (1,)), (2, (1,)), (3, (1, 3)), (4, (3, 4))):
        use = [(x, of[d]) for _, d, x in rows if d.month in window and d in of]
        y, x = (np.array(c) for c in zip(*use, strict=True))
        slope, cut = np.polyfit(x, y, 1)
        assert got[m] == pytest.approx((y - slope * x - cut).var(ddof=1))


def test_touched_months_are_replaced_and_others_are_not_read(spark):
    path = scratch(spark, "touched")
    panel.write_panel(spark.createDataFrame([(p, m, 1.0) for p in range(20) for m in (200001, 200002, 200003)], "permno int, target_yyyymm int, x double"), path)
    panel.write_panel(spark.createDataFrame([(7, 200002, 2.0)], "permno int, target_yyyymm int, x double"), path)
    got = panel.read_panel(spark, path)
    assert Counter((r["target_yyyymm"], r["x"]) for r in got.collect()) == {(200001, 1.0): 20, (200002, 2.0): 1, (200003, 1.0): 20}
    some = panel.read_panel(spark, path, (200002, 200002))
    assert some.count() == 1 and "PartitionFilters: [isnotnull(target_yyyymm" in some._jdf.queryExecution().executedPlan().toString()
    one = scratch(spark, "feature")
    for value in (1.0, 2.0):
        panel.write_feature(spark.createDataFrame([(1, 200001, value), (2, 200001, math.inf), (3, 200001, math.nan), (4, 200001, None)], "permno int, signal_yyyymm int, x double"), "x", one)
    assert [(r["permno"], r["x"]) for r in spark.read.parquet(one).collect()] == [(1, 2.0)]


def test_bucketed_tables_meet_without_exchange(spark, tmp_path):
    df = wide(spark, width=2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("buckets_x", "buckets_y"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            df.write.mode("overwrite").option("path", f"{tmp_path}/{name}").bucketBy(4, "permno").sortBy("permno", "m").saveAsTable(name)
        joined = spark.table("buckets_x").join(spark.table("buckets_y").withColumnsRenamed({"c0": "d0", "c1": "d1"}).drop("industry"), ["permno", "m"])
        merged = spark.table("buckets_x").groupBy("permno").agg(F.sum("c0").alias("s"))
        assert "Exchange" not in plan_of(merged).split("== Initial Plan ==")[-1] and joined.count() == 400
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS buckets_x")
        spark.sql("DROP TABLE IF EXISTS buckets_y")


def test_readers_of_dates_headers_and_companies(spark, tmp_path):
    from panelwright.functions.calendar import sas_date

    df = spark.createDataFrame([(0.0,), (-1.0,), (21915.0,), (None,)], "n double")
    assert [str(r[0]) for r in df.select(sas_date("n")).collect()] == ["1960-01-01", "1959-12-31", "2020-01-01", "None"]
    (tmp_path / "x.csv").write_text("permno,DATE,bm\n1,20200131,0.5\n")
    assert readers.header(spark, str(tmp_path / "x.csv")) == ["permno", "DATE", "bm"]
    assert readers.read_table(spark, str(tmp_path / "x.csv"), ["bm"], "csv", header=True).columns == ["bm"]
    reports = spark.createDataFrame([(1, 10), (2, 20), (2, 30)], "gvkey int, sic int")
    company = spark.createDataFrame([(2, 99, "x"), (2, 99, "x"), (3, 1, "y")], "gvkey int, sic int, other string")
    assert sorted(((r["gvkey"], r["sic"]) for r in readers.with_company(reports, company).collect()), key=str) == [(1, None), (2, 99), (2, 99)]
    flat = spark.createDataFrame([(-1.0, 1.0, None), (-1.0 + 1e-9, None, None)], "a double, b double, c double")
    assert {r["char"]: (r["n"], r["degenerate"]) for r in panel.degenerate_columns(flat, ["a", "b", "c"]).collect()} == {"a": (2, True), "b": (1, False), "c": (0, False)}
    assert panel.degenerate(flat, "a") and not panel.degenerate(flat, "c")
    stats = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", None), ("d", 0.9)], "char string, rho double")
    assert [r["char"] for r in compare.ranked_last_nulls(stats, "rho").collect()] == ["d", "a", "b", "c"]


def test_codes_that_change_hands(spark):
    day = lambda m: date(2020, m, 28)
    names = spark.createDataFrame([(1, "AAAAAA10", date(2019, 1, 1), date(2020, 2, 29)), (1, "BBBBBB10", date(2020, 3, 1), None), (2, "AAAAAA10", date(2020, 3, 1), None)], "permno int, ncusip string, namedt date, nameendt date")
    months = spark.createDataFrame([(p, day(m), 10.0 * p, 2.0) for p in (1, 2) for m in (1, 2, 3, 4)], "permno int, date date, prc double, cfacpr double")
    prices = monthly.dated_prices(months, names)
    got = {(r["cusip6"], str(r["merge_date"])): (r["permno"], r["prc_adj"]) for r in prices.collect()}
    assert got["AAAAAA", "2020-03-31"] == (1, 5.0) and got["AAAAAA", "2020-04-30"] == (2, 10.0) and got["BBBBBB", "2020-04-30"] == (1, 5.0)
    told = spark.createDataFrame([("T", "AAAAAA10", date(2020, 3, 15), date(2020, 12, 31), 1.0), ("T", "AAAAAA10", date(2020, 3, 15), date(2021, 12, 31), 2.0), ("T", "AAAAAA10", date(2020, 4, 15), None, 3.0)], "ticker string, cusip string, statpers date, fpedats date, meanest double")
    one = monthly.latest_periods(told).collect()
    assert [(r["meanest"], str(r["merge_date"]), r["cusip6"]) for r in one] == [(2.0, "2020-03-31", "AAAAAA")]


def test_company_codes_keep_what_months_have(spark):
    months = spark.createDataFrame([(1, 202001, "55", 9999), (2, 202001, None, 7372)], "permno int, signal_yyyymm int, sic2 string, siccd int")
    reports = spark.createDataFrame([(1, 202001, 2834, "28")], "permno int, signal_yyyymm int, sic int, sic2 string")
    assert {r["permno"]: (r["sic"], r["sic2"]) for r in links.with_codes(months, reports).collect()} == {1: (2834, "55"), 2: (None, None)}
    bare = months.drop("sic2")
    assert {r["permno"]: (r["sic"], r["sic2"]) for r in links.with_codes(bare, reports).collect()} == {1: (2834, "28"), 2: (None, None)}
    assert {r["permno"]: (r["sic"], r["sic2"]) for r in links.with_codes(bare, reports, "history").collect()} == {1: (9999, "28"), 2: (7372, "73")}


def test_schemes_have_their_published_rows():
    assert [len(industry.ranges(k)) for k in (5, 10, 12, 38)] == [58, 58, 49, 37]
    assert sorted({n for n, *_ in industry.ranges(38)}) == list(range(1, 38))
    text = "1 Agric  Agriculture\n   0100-0199 crops\n   0200-0299\n2 Food  Food\n   2000-2099 all"
    assert industry.ranges(text) == [(1, "Agric", 100, 199), (1, "Agric", 200, 299), (2, "Food", 2000, 2099)]


def test_plans_name_their_families(spark):
    assert planner.plan(["rd_mve", "retvol", "sic2", "mom1m"]) == {"annual": ["rdm"], "monthly": ["mom1m"], "daily": ["rvar_mean"]}
    with pytest.raises(ValueError, match="nothing_of_the_kind"):
        planner.plan(["bm", "nothing_of_the_kind"])
    assert all(planner.own_name(n) for n in profiles.PUBLISHED) and len(profiles.PUBLISHED) == 95
    kept = dict(planner.FAMILIES)
    try:
        planner.add("mine", planner.Family(("twice",), "security_month", "the month itself", lambda inputs, names: inputs.months.select(*planner.KEYS, (2 * F.col("prc")).alias("twice"))))
        assert planner.plan(["twice"]) == {"mine": ["twice"]} and "twice" in planner.every_name()
    finally:
        planner.FAMILIES.clear()
        planner.FAMILIES.update(kept)


def test_the_latest_report_that_has_a_value_counts(spark):
    rows = [(1, date(2020, 3, 31), 5.0, None), (1, date(2020, 6, 30), None, 7.0), (1, date(2020, 6, 30), 6.0, 8.0), (2, date(2020, 3, 31), None, 1.0)]
    got = {(r["permno"], r["signal_yyyymm"]): (r["a"], r["b"]) for r in planner.latest_of_window(spark.createDataFrame(rows, "permno int, datadate date, a double, b double"), ["a", "b"]).collect()}
    assert got[1, 202009] == (5.0, None) and got[1, 202012] == (6.0, 8.0) and got[1, 202104] == (6.0, 8.0) and got[2, 202101] == (None, 1.0) and (1, 202008) not in got and (1, 202105) not in got


def test_merged_frames_of_one_key(spark):
    spine = spark.createDataFrame([(1, 1, 1), (1, 2, 1)], "k int, t int, _in int")
    a = spark.createDataFrame([(1, 1, 5.0, None)], "k int, t int, x double, y string")
    b = spark.createDataFrame([(1, 1, 6.0, "b"), (1, 3, 7.0, "c")], "k int, t int, x double, y string")
    got = {(r["k"], r["t"]): (r["_in"], r["x"], r["y"]) for r in panel.merge_features([spine, a, b], ["k", "t"]).collect()}
    assert got == {(1, 1): (1, 5.0, "b"), (1, 2): (1, None, None), (1, 3): (None, 7.0, "c")}


def test_compare_panels_takes_the_better_alignment(spark):
    rng = np.random.default_rng(3)
    months = [(2000 + i // 12) * 100 + i % 12 + 1 for i in range(8)]
    a, b = [], []
    x = {(p, i): float(rng.normal()) for p in range(40) for i in range(8)}
    for (p, i), v in x.items():
        a.append((p, months[i], months[i + 1] if i < 7 else 200009, v, v))
        b.append((p, months[i], v, x.get((p, i - 1))))
    got = compare.compare_panels(spark.createDataFrame(a, "permno int, signal_yyyymm int, target_yyyymm int, s double, t double"), spark.createDataFrame(b, "permno int, month int, s2 double, t2 double"), {"s": "s2", "t": "t2"}, min_pairs=20)
    told = {r["char"]: r for r in got.collect()}
    assert told["s"]["alignment"] == "signal_yyyymm" and told["t"]["alignment"] == "target_yyyymm"
    assert told["s"]["median_rho"] == pytest.approx(1) and told["t"]["abs_1e4"] == 1 and told["t"]["only_a"] == 0 and told["s"]["n"] == 320 and told["t"]["entities_both"] == 40
    assert got.columns[:2] == ["char", "alignment"]
