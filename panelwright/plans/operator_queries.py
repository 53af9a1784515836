"""Queries of joins, timing, windows, cross-sections, returns and panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as c
from ..functions import scalar as s
from ..operators import crosssection as x
from ..operators import links, panel, timing, windows
from ..sources import readers
from . import monthly
from .feature_queries import MONTHLY_SQL, _industry_month
from .shapes import Query

CURRENT = "(SELECT permno, siccd, siccd % 10 AS industry, exchcd FROM {names} WHERE nameendt IS NULL)"


def _ranges(v):
    """Ranges of codes that overlap in part, so that the last one counts."""
    n = v("nation").select("n_nationkey", "n_name")
    return n.select((F.col("n_nationkey") * 100).alias("low"), (F.col("n_nationkey") * 100 + 130).alias("high"), F.concat(F.lit("F"), F.col("n_nationkey") % 12).alias("label"), F.col("n_nationkey").alias("ord"))


def _momentum(v):
    """Momentum and its industry's mean, winsorized and ranked by month, with next month's return."""
    f = monthly.monthly_features(_industry_month(v)).select("permno", "signal_yyyymm", "target_yyyymm", "mom12m", "indmom", "mom1m").dropna(subset=["mom12m"])
    ranked = x.standardized(f, ["mom12m", "indmom", "mom1m"], ["signal_yyyymm"], [])
    return panel.with_outcomes(ranked, v("security_month").select("permno", F.col("signal_yyyymm").alias("target_yyyymm"), "ret"))


def _rank_sql(col: str, by: str) -> str:
    n = f"count({col}) OVER (PARTITION BY {by})"
    r = f"rank() OVER (PARTITION BY {by}, {col} IS NULL ORDER BY {col}) + (count(*) OVER (PARTITION BY {by}, {col}) - 1) / 2e0"
    return f"CASE WHEN {col} IS NULL THEN 0 WHEN {n} > 1 THEN 2 * ({r} - 1) / ({n} - 1) - 1 ELSE 0 END"


def _winsor_sql(inner: str, cols: list[str], by: str, rest: str) -> str:
    q = ", ".join(f"quantile_cont({k}, 0.01) AS lo_{k}, quantile_cont({k}, 0.99) AS hi_{k}" for k in cols)
    w = ", ".join(f"CASE WHEN {k} IS NOT NULL THEN least(greatest({k}, lo_{k}), hi_{k}) END AS {k}" for k in cols)
    return f"SELECT {rest}, {w} FROM ({inner}) a JOIN (SELECT {by}, {q} FROM ({inner}) GROUP BY {by}) b USING ({by})"


_MOM = f"SELECT f.permno, s.signal_yyyymm, s.target_yyyymm, f.mom12m, f.indmom, f.mom1m FROM ({MONTHLY_SQL}) f JOIN {{security_month}} s ON f.permno = s.permno AND f.m = s.m WHERE mom12m IS NOT NULL"
MOMENTUM_SQL = f"""SELECT r.*, s.ret FROM (SELECT permno, target_yyyymm, {', '.join(f"{_rank_sql(k, 'signal_yyyymm')} AS {k}" for k in ('mom12m', 'indmom', 'mom1m'))} FROM ({_winsor_sql(_MOM, ['mom12m', 'indmom', 'mom1m'], 'signal_yyyymm', 'permno, signal_yyyymm, target_yyyymm')})) r
    JOIN {{security_month}} s ON r.permno = s.permno AND r.target_yyyymm = s.signal_yyyymm"""


def _names_join(v):
    return links.interval_join(v("security_month"), v("names"), ["permno"], "date", "namedt", "nameendt", strict_start=True)


def _links_of(v):
    y = v("fundamentals_year").select("gvkey", "datadate", "assets")
    return links.interval_join(y, links.filter_links(v("link")), ["gvkey"], "datadate", "linkdt", "linkenddt")


LINKED = """SELECT y.gvkey, y.datadate, y.assets, l.permno, l.linktype, l.linkprim, l.linkdt FROM {fundamentals_year} y JOIN {link} l ON y.gvkey = l.gvkey AND l.linktype LIKE 'L%' AND l.permno IS NOT NULL
    AND (l.linkdt IS NULL OR y.datadate >= l.linkdt) AND y.datadate <= coalesce(l.linkenddt, DATE '9999-12-31')"""


def _asof(v, cols, require=None):
    q = v("fundamentals_quarter").join(v("link").filter("linkprim = 'P'").select("gvkey", "permno").distinct(), "gvkey")
    one = links.pick_one(q, ["permno", "datadate"], [F.col("gvkey")])
    return timing.asof_window(v("security_month").select("permno", "signal_yyyymm"), one, values=cols, require=require)


QUARTERS = "(SELECT q.*, l.permno FROM {fundamentals_quarter} q JOIN (SELECT DISTINCT gvkey, permno FROM {link} WHERE linkprim = 'P') l ON q.gvkey = l.gvkey QUALIFY row_number() OVER (PARTITION BY l.permno, q.datadate ORDER BY q.gvkey) = 1)"
ASOF = "SELECT s.permno, s.signal_yyyymm, {values} FROM {{security_month}} s LEFT JOIN {quarters} q ON q.permno = s.permno AND year(q.datadate) * 12 + month(q.datadate) - 1 BETWEEN s.m - 10 AND s.m - 6 {more} QUALIFY row_number() OVER (PARTITION BY s.permno, s.m ORDER BY q.datadate DESC NULLS LAST) = 1"


def _merged(v):
    a = v("panel_a").select("permno", "signal_yyyymm", F.col("industry").alias("sic"), "a")
    b = v("panel_b").select("permno", "signal_yyyymm", (F.col("industry") + 100).alias("sic"), F.col("a2").alias("a"), "b2")
    d = v("security_month").select("permno", "signal_yyyymm", F.col("vol").alias("c"))
    return panel.merge_features([a, b, d], ["permno", "signal_yyyymm"])


def _research(v):
    return panel.research_panel(v("panel_a").select("permno", "signal_yyyymm", "target_yyyymm", "industry", "a", "b", "c"), ["a", "b", "c"], start=199601)


_PA = "SELECT permno, signal_yyyymm, target_yyyymm, industry, a, b, c FROM {panel_a} WHERE target_yyyymm >= 199601"
_IMPUTED = f"SELECT permno, signal_yyyymm, target_yyyymm, {', '.join(f'coalesce({k}, median({k}) OVER (PARTITION BY signal_yyyymm, industry), median({k}) OVER (PARTITION BY signal_yyyymm)) AS {k}' for k in 'abc')} FROM ({_winsor_sql(_PA, list('abc'), 'signal_yyyymm', 'permno, signal_yyyymm, target_yyyymm, industry')})"
RESEARCH_SQL = f"SELECT permno, signal_yyyymm, target_yyyymm, {', '.join(f'{_rank_sql(k, "signal_yyyymm")} AS {k}' for k in 'abc')} FROM ({_IMPUTED})"


def _excess(v):
    n = v("names").filter("nameendt IS NULL").select("permno", "exchcd")
    rf = panel.to_percent_units(v("factors_month"), "rf")
    return panel.excess_returns(v("security_month").join(n, "permno"), v("delist"), rf, distress_fill=True)


EXCESS_SQL = f"""SELECT permno, m, dlret, CASE WHEN ret IS NOT NULL OR dlret IS NOT NULL THEN (1 + coalesce(ret, 0)) * (1 + coalesce(dlret, 0)) - 1 END AS retadj,
    CASE WHEN ret IS NOT NULL OR dlret IS NOT NULL THEN (1 + coalesce(ret, 0)) * (1 + coalesce(dlret, 0)) - 1 END - rf AS excess_return FROM
    (SELECT s.permno, s.m, s.ret, f.rf / CASE WHEN (SELECT median(abs(rf)) FROM {{factors_month}}) > 0.02 THEN 100 ELSE 1 END AS rf,
    CASE WHEN d.dlret IS NULL AND d.dlstcd BETWEEN 500 AND 584 AND d.dlstcd NOT IN (501, 502, 503, 504) THEN CASE WHEN n.exchcd IN (1, 2) THEN -0.35e0 WHEN n.exchcd = 3 THEN -0.55e0 END ELSE d.dlret END AS dlret
    FROM {{security_month}} s JOIN {CURRENT} n USING (permno) LEFT JOIN {{delist}} d ON d.permno = s.permno AND d.m = s.m LEFT JOIN {{factors_month}} f ON f.m = s.m)"""


def _macro(v):
    return windows.standardize(panel.macro_predictors(v("macro")), ["dp", "ep", "bm", "tms"], "yyyymm", "expanding", 24)


MACRO_RAW = "SELECT yyyymm, ln(d12) - ln(index) AS dp, ln(e12) - ln(index) AS ep, ln(bm) AS bm, lty - tbl AS tms, baa - aaa AS dfy, ntis, tbl, svar FROM {macro}"
MACRO_SQL = f"SELECT yyyymm, dfy, ntis, {', '.join(f'CASE WHEN count({k}) OVER w >= 24 THEN ({k} - avg({k}) OVER w) / nullif(stddev_samp({k}) OVER w, 0) END AS {k}' for k in ('dp', 'ep', 'bm'))} FROM ({MACRO_RAW}) WINDOW w AS (ORDER BY yyyymm ROWS UNBOUNDED PRECEDING)"


def _blended(v):
    p = v("panel_a").select("permno", F.col("signal_yyyymm").alias("yyyymm"), "industry", "a", "b")
    return x.one_hot(x.interact(p, panel.macro_predictors(v("macro")), "yyyymm", ["a", "b"], ["dp", "svar"]), "industry", list(range(3)), "ind_")


def _bd(v, n):
    return v("events").select(F.to_date("ts").alias("d")).distinct().withColumn("moved", c.add_business_days("d", n))


def _bd_sql(n: int) -> str:
    """By counting: the n-th day from Monday to Friday after or before, weekends first brought on to a weekday."""
    days = "SELECT DISTINCT CAST(ts AS DATE) AS d FROM {events}"
    if n > 0:
        return f"SELECT d, (SELECT x FROM (SELECT d + CAST(i AS INTEGER) AS x, row_number() OVER (ORDER BY i) AS k FROM range(1, 80) t(i) WHERE isodow(d + CAST(i AS INTEGER)) < 6) WHERE k = {n}) AS moved FROM ({days})"
    return f"SELECT d, (SELECT x FROM (SELECT d - CAST(i AS INTEGER) AS x, row_number() OVER (ORDER BY i) AS k FROM range(CASE WHEN isodow(d) > 5 THEN 1 ELSE 1 END, 80) t(i) WHERE isodow(d - CAST(i AS INTEGER)) < 6) WHERE k = {-n}) AS moved FROM ({days})"


def _calendar(v):
    k = F.col("signal_yyyymm")
    return v("security_month").select("signal_yyyymm").distinct().select("signal_yyyymm", c.add_months_key(k, 1).alias("next"), c.add_months_key(k, -7).alias("before"), c.index_of_key(k).alias("m"), c.inferred_fiscal_year(k).alias("fiscal"))


def _month_flags(v):
    d = v("security_day").select("permno", "date")
    return d.select("permno", "date", windows.month_end_flag("permno", "date").cast("int").alias("is_last"), F.dense_rank().over(windows.Window.partitionBy("permno").orderBy(F.trunc("date", "month"))).alias("month_no"))


def _islands(v):
    a = v("panel_a").select("permno", "m", F.floor(F.col("a") * 50).cast("int").alias("level")).dropna()
    return windows.islands(a, "level", "permno", "m", "island")


def _filled(v):
    p = v("panel_a").select("permno", "m", "a")
    return p.withColumn("filled", windows.forward_fill("a", "permno", "m"))


def _rolling(v):
    p = v("panel_a").select("permno", "m", "a")
    return windows.lagged_by_calendar(windows.lagged(p.withColumn("sd", windows.rolling_std("a", 6, "permno", "m")).withColumn("streak", windows.streak("a", "permno", "m", 4)), ["a"], [1, 3], "permno", "m"), "a", 3, "permno", "m")


def _codes(v):
    return links.range_code(v("names").select("permno", "namedt", "siccd"), _ranges(v), "siccd", "low", "high", "label", "ord", "ff")


def _sic2(v):
    y = v("names").select("permno", "namedt", (F.col("siccd") / F.when(F.col("permno") % 3 == 0, 10).otherwise(1)).alias("code"))
    return y.select("permno", "namedt", s.sic2("code").alias("padded"), s.sic2("code", "prefix").alias("prefix"), s.sic2("code", "integer").alias("whole"))


_code = "CAST(floor(siccd / CASE WHEN permno % 3 = 0 THEN 10e0 ELSE 1e0 END) AS INTEGER)"
_pairs_by = [("security_month", "m", "ret")]

QUERIES = [
    Query("momentum_panel", _momentum, "permno target_yyyymm mom12m~6 indmom~6 mom1m~6 ret~8", MOMENTUM_SQL),
    Query("interval_join_names", _names_join, "permno m exchcd shrcd siccd", "SELECT s.permno, s.m, n.exchcd, n.shrcd, n.siccd FROM {security_month} s JOIN {names} n ON s.permno = n.permno AND s.date >= n.namedt AND s.date <= coalesce(n.nameendt, DATE '9999-12-31')"),
    Query("link_join", _links_of, "gvkey datadate permno linktype linkprim assets~6", LINKED),
    Query("link_join_primary", lambda v: links.primary_links(_links_of(v), ["gvkey", "datadate"]), "gvkey datadate permno linkprim", f"SELECT * FROM ({LINKED}) QUALIFY row_number() OVER (PARTITION BY gvkey, datadate ORDER BY CASE linkprim WHEN 'P' THEN 0 WHEN 'C' THEN 1 ELSE 2 END, permno, linkdt NULLS FIRST) = 1"),
    Query("universe_filter", lambda v: panel.within(panel.in_codes(panel.in_codes(_names_join(v), "exchcd", [1, 2]), "shrcd", [10, 11]), "m", 23960, 23999), "permno m exchcd shrcd", "SELECT s.permno, s.m, n.exchcd, n.shrcd FROM {security_month} s JOIN {names} n ON s.permno = n.permno AND s.date >= n.namedt AND s.date <= coalesce(n.nameendt, DATE '9999-12-31') WHERE exchcd IN (1, 2) AND shrcd IN (10, 11) AND m BETWEEN 23960 AND 23999"),
    Query("asof_single", lambda v: _asof(v, ["saleq"], "rdq"), "permno signal_yyyymm datadate saleq~5", ASOF.format(values="q.datadate, q.saleq", quarters=QUARTERS, more="AND q.rdq IS NOT NULL AND q.saleq IS NOT NULL")),
    Query("asof_several", lambda v: _asof(v, ["saleq", "cheq"]), "permno signal_yyyymm datadate saleq~5 cheq~5", ASOF.format(values="q.datadate, q.saleq, q.cheq", quarters=QUARTERS, more="")),
    Query("until_next_report", lambda v: timing.until_next_report(v("fundamentals_year").select("gvkey", "datadate", "fyear"), "gvkey", "datadate"), "gvkey fyear signal_yyyymm target_yyyymm", "SELECT gvkey, fyear, CAST(floor(k / 12) * 100 + k % 12 + 1 AS INTEGER) AS signal_yyyymm, CAST(floor((k + 1) / 12) * 100 + (k + 1) % 12 + 1 AS INTEGER) AS target_yyyymm FROM (SELECT gvkey, fyear, unnest(range(f, coalesce(nx, f + 12))) AS k FROM (SELECT gvkey, fyear, fyear * 12 + 15 AS f, lead(fyear * 12 + 15) OVER (PARTITION BY gvkey ORDER BY fyear) AS nx FROM {fundamentals_year}))"),
    Query("expand_june", lambda v: timing.expand_fixed(v("fundamentals_year").select("gvkey", "datadate", "assets"), "gvkey"), "gvkey datadate signal_yyyymm target_yyyymm assets~5", "SELECT gvkey, datadate, assets, CAST(floor(k / 12) * 100 + k % 12 + 1 AS INTEGER) AS signal_yyyymm, CAST(floor((k + 1) / 12) * 100 + (k + 1) % 12 + 1 AS INTEGER) AS target_yyyymm FROM (SELECT *, unnest(range((fyear + 1) * 12 + 5, (fyear + 1) * 12 + 17)) AS k FROM {fundamentals_year}) QUALIFY row_number() OVER (PARTITION BY gvkey, k ORDER BY datadate DESC) = 1"),
    Query("month_universe", lambda v: panel.month_universe([v("panel_a"), v("panel_b"), v("security_month")], ["permno", "signal_yyyymm"]), "permno signal_yyyymm", "SELECT permno, signal_yyyymm FROM {panel_a} UNION SELECT permno, signal_yyyymm FROM {panel_b} UNION SELECT permno, signal_yyyymm FROM {security_month}"),
    Query("traded_months", lambda v: v("panel_a").join(v("panel_b").select("permno", "m"), ["permno", "m"], "left_semi"), "permno m a~6", "SELECT permno, m, a FROM {panel_a} p WHERE EXISTS (SELECT 1 FROM {panel_b} q WHERE q.permno = p.permno AND q.m = p.m)"),
    Query("merge_features", _merged, "permno signal_yyyymm sic a~6 b2~6 c~6", "SELECT permno, signal_yyyymm, coalesce(p.industry, q.industry + 100) AS sic, coalesce(p.a, q.a2) AS a, q.b2, r.c FROM {panel_a} p FULL JOIN {panel_b} q USING (permno, signal_yyyymm) FULL JOIN (SELECT permno, signal_yyyymm, vol AS c FROM {security_month}) r USING (permno, signal_yyyymm)"),
    Query("industry_codes", _codes, "permno namedt siccd ff", "SELECT permno, namedt, siccd, (SELECT concat('F', n_nationkey % 12) FROM {nation} WHERE siccd BETWEEN n_nationkey * 100 AND n_nationkey * 100 + 130 ORDER BY n_nationkey DESC LIMIT 1) AS ff FROM {names}"),
    Query("sic2_encodings", _sic2, "permno namedt padded prefix whole", f"SELECT permno, namedt, substr(lpad(CAST({_code} AS VARCHAR), 4, '0'), 1, 2) AS padded, substr(CAST({_code} AS VARCHAR), 1, 2) AS prefix, CAST(floor({_code} / 100e0) AS INTEGER) AS whole FROM {{names}}"),
    Query("group_statistics", lambda v: x.group_stat(x.group_stat(v("fundamentals_year"), ["sic2", "fyear"], ["sale", "che"], "mean"), ["sic2", "fyear"], "sale", "median"), "gvkey fyear sic2 sale_mean~5 che_mean~5 sale_median~5", "SELECT gvkey, fyear, sic2, avg(sale) OVER w AS sale_mean, avg(che) OVER w AS che_mean, median(sale) OVER w AS sale_median FROM {fundamentals_year} WINDOW w AS (PARTITION BY sic2, fyear)"),
    Query("demean", lambda v: x.demean(v("panel_a"), ["industry", "m"], ["a", "b"], "median"), "permno m a_ia~6 b_ia~6", "SELECT permno, m, a - median(a) OVER w AS a_ia, b - median(b) OVER w AS b_ia FROM {panel_a} WINDOW w AS (PARTITION BY industry, m)"),
    Query("winsorize", lambda v: x.winsorize(v("panel_a").select("permno", "m", "a", "b"), ["a", "b"], ["m"]), "permno m a~6 b~6", _winsor_sql("SELECT permno, m, a, b FROM {panel_a}", ["a", "b"], "m", "permno, m")),
    Query("winsorize_one_sided", lambda v: x.winsorize(v("panel_a").select("permno", "m", "a"), ["a"], ["m"], None, 0.9, 10), "permno m a~6", "SELECT permno, m, CASE WHEN a IS NOT NULL AND n >= 10 THEN least(a, q) ELSE a END AS a FROM {panel_a} JOIN (SELECT m, quantile_cont(a, 0.9) AS q, count(a) AS n FROM {panel_a} GROUP BY m) USING (m)"),
    Query("impute_median", lambda v: x.impute_median(v("fundamentals_year").select("gvkey", "fyear", "sic2", "che", "xrd"), ["che", "xrd"], [["fyear", "sic2"], ["fyear"]]), "gvkey fyear che~5 xrd~5", "SELECT gvkey, fyear, coalesce(che, median(che) OVER (PARTITION BY fyear, sic2), median(che) OVER (PARTITION BY fyear)) AS che, coalesce(xrd, median(xrd) OVER (PARTITION BY fyear, sic2), median(xrd) OVER (PARTITION BY fyear)) AS xrd FROM {fundamentals_year}"),
    Query("impute_industry_only", lambda v: x.impute_median(v("fundamentals_year").select("gvkey", "fyear", "sic2", "che"), ["che"], [["fyear", "sic2"]], "_ind_median_imputed", False), "gvkey fyear che_ind_median_imputed~5", "SELECT gvkey, fyear, coalesce(che, CASE WHEN sic2 IS NOT NULL THEN median(che) OVER (PARTITION BY fyear, sic2) END) AS che_ind_median_imputed FROM {fundamentals_year}"),
    Query("rank_unit", lambda v: x.rank_unit(v("panel_a").select("permno", "m", "a", "c"), ["a", "c"], ["m"]), "permno m a~6 c~6", f"SELECT permno, m, {_rank_sql('a', 'm')} AS a, {_rank_sql('c', 'm')} AS c FROM {{panel_a}}"),
    Query("research_panel", _research, "permno signal_yyyymm target_yyyymm a~6 b~6 c~6", RESEARCH_SQL),
    Query("required_features", lambda v: panel.require(panel.rename_aliases(v("panel_a").withColumnsRenamed({"a": "bm", "b": "mom1m"})), ["bm", "mom1m"]), "permno m book_to_market~6 mom1m~6", "SELECT permno, m, a AS book_to_market, b AS mom1m FROM {panel_a} WHERE a IS NOT NULL AND b IS NOT NULL"),
    Query("excess_returns", _excess, "permno m dlret~6 retadj~7 excess_return~7", EXCESS_SQL),
    Query("prediction_panel", lambda v: panel.with_outcomes(v("panel_a").select("permno", "signal_yyyymm", "target_yyyymm", "b"), _excess(v).select("permno", F.col("signal_yyyymm").alias("target_yyyymm"), "retadj", "excess_return")), "permno signal_yyyymm b~6 retadj~7 excess_return~7", f"SELECT p.permno, p.signal_yyyymm, p.b, e.retadj, e.excess_return FROM {{panel_a}} p JOIN ({EXCESS_SQL}) e ON p.permno = e.permno AND e.m = p.m + 1"),
    Query("macro_predictors", lambda v: panel.macro_predictors(v("macro")), "yyyymm dp~6 ep~6 bm~6 tms~6 dfy~6 ntis~6 tbl~6 svar~8", MACRO_RAW),
    Query("macro_standardized", _macro, "yyyymm dfy~6 ntis~6 dp~5 ep~5 bm~5", MACRO_SQL),
    Query("macro_interactions", _blended, "permno yyyymm a_x_dp~6 b_x_dp~6 a_x_svar~8 b_x_svar~8 ind_0 ind_1 ind_2", f"SELECT permno, signal_yyyymm AS yyyymm, a * dp AS a_x_dp, b * dp AS b_x_dp, a * svar AS a_x_svar, b * svar AS b_x_svar, {', '.join(f'CASE WHEN industry = {i} THEN 1e0 ELSE 0e0 END AS ind_{i}' for i in range(3))} FROM {{panel_a}} LEFT JOIN ({MACRO_RAW}) m ON m.yyyymm = signal_yyyymm"),
    Query("business_days_on", lambda v: _bd(v, 1), "d moved", _bd_sql(1)),
    Query("business_days_back", lambda v: _bd(v, -1), "d moved", _bd_sql(-1)),
    Query("month_keys", _calendar, "signal_yyyymm next before m fiscal", "SELECT k AS signal_yyyymm, (m + 1) // 12 * 100 + (m + 1) % 12 + 1 AS next, (m - 7) // 12 * 100 + (m - 7) % 12 + 1 AS before, m, CASE WHEN k % 100 >= 6 THEN k // 100 - 1 ELSE k // 100 - 2 END AS fiscal FROM (SELECT DISTINCT signal_yyyymm AS k, m FROM {security_month})"),
    Query("month_flags", _month_flags, "permno date is_last month_no", "SELECT permno, date, CASE WHEN date = max(date) OVER (PARTITION BY permno, date_trunc('month', date)) THEN 1 ELSE 0 END AS is_last, dense_rank() OVER (PARTITION BY permno ORDER BY date_trunc('month', date)) AS month_no FROM {security_day}"),
    Query("constant_islands", _islands, "permno m level island", "SELECT permno, m, level, sum(CASE WHEN level = lag_l AND m - lag_m = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY permno ORDER BY m) AS island FROM (SELECT permno, m, level, lag(level) OVER w AS lag_l, lag(m) OVER w AS lag_m FROM (SELECT permno, m, CAST(floor(a * 50) AS INTEGER) AS level FROM {panel_a} WHERE a IS NOT NULL) WINDOW w AS (PARTITION BY permno ORDER BY m))"),
    Query("forward_fill", _filled, "permno m a~6 filled~6", "SELECT permno, m, a, last_value(a IGNORE NULLS) OVER (PARTITION BY permno ORDER BY m ROWS UNBOUNDED PRECEDING) AS filled FROM {panel_a}"),
    Query("rolling_windows", _rolling, "permno m sd~6 streak a_1~6 a_3~6 a_m3~6", "SELECT p.permno, p.m, CASE WHEN count(a) OVER r >= 2 THEN stddev_samp(a) OVER r END AS sd, lag(a, 1) OVER w AS a_1, lag(a, 3) OVER w AS a_3, q.a3 AS a_m3, " + " + ".join("CASE WHEN " + " AND ".join(f"coalesce(lag(a, {i}) OVER w > lag(a, {i + 1}) OVER w, false)" for i in range(k + 1)) + " THEN 1 ELSE 0 END" for k in range(4)) + " AS streak FROM {panel_a} p LEFT JOIN (SELECT permno AS pp, m + 3 AS mm, a AS a3 FROM {panel_a}) q ON q.pp = p.permno AND q.mm = p.m WINDOW w AS (PARTITION BY p.permno ORDER BY p.m), r AS (PARTITION BY p.permno ORDER BY p.m ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"),
    Query("adjusted_prices", lambda v: readers.adjusted_prices(v("security_month").withColumn("cfacpr", F.when(F.col("permno") % 11 == 0, 0.0).otherwise(2.0))), "permno merge_date prc_adj~5", "SELECT permno, last_day(date + INTERVAL 1 MONTH) AS merge_date, CASE WHEN permno % 11 = 0 THEN NULL ELSE abs(prc) / 2 END AS prc_adj FROM {security_month}"),
    Query("daily_of_some", lambda v: readers.daily_of(v("security_day"), v("names").filter("exchcd = 1"), ["ret", "vol"]), "permno date ret~6 vol~4", "SELECT permno, date, ret, vol FROM {security_day} WHERE permno IN (SELECT permno FROM {names} WHERE exchcd = 1)"),
    Query("last_quarter_of_year", lambda v: links.pick_one(v("fundamentals_quarter"), ["gvkey", "fyearq"], [F.desc("fqtr")]), "gvkey fyearq fqtr saleq~5", "SELECT gvkey, fyearq, fqtr, saleq FROM {fundamentals_quarter} QUALIFY row_number() OVER (PARTITION BY gvkey, fyearq ORDER BY fqtr DESC) = 1"),
    Query("year_tables", lambda v: v("fundamentals_year").select("gvkey", "fyear", F.element_at(F.create_map(*(F.lit(z) for y in range(1995, 2001) for z in (y, 100.0 + 3 * (y - 1995)))), F.col("fyear")).alias("cpi")), "gvkey fyear cpi", "SELECT gvkey, fyear, CASE WHEN fyear BETWEEN 1995 AND 2000 THEN 100e0 + 3 * (fyear - 1995) END AS cpi FROM {fundamentals_year}"),
    Query("firm_december_value", lambda v: v("security_month").filter("m % 12 = 11").groupBy("permco", F.year("date").alias("year")).agg(F.sum(F.col("prc") * F.col("shrout")).alias("value")), "permco year value~3", "SELECT permco, year(date) AS year, sum(prc * shrout) AS value FROM {security_month} WHERE m % 12 = 11 GROUP BY 1, 2"),
]
