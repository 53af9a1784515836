"""Further queries: industry schemes and codes, orders of industry means, forecasts of quarters, sizes, shifted benchmarks, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import industry
from ..operators import audit, compare, crosssection, links, panel, timing
from ..sources import readers
from . import features as f
from . import monthly, turnover
from .compare_queries import MODES
from .feature_queries import ANNUAL_SQL, BM_SQL, _adjusted_sql, _december
from .operator_queries import LINKED, _links_of
from .shapes import Query


def _schemes(v):
    codes = v("part").select((F.col("p_partkey") * 7 % 9000).alias("sic")).distinct()
    for scheme in sorted(industry.SCHEMES):
        codes = industry.with_scheme(codes, scheme)
    return codes


def _scheme_sql() -> str:
    one = lambda k: f"(SELECT number FROM (VALUES {', '.join(f'({n}, {low}, {high}, {i})' for i, (n, _, low, high) in enumerate(industry.ranges(k)))}) r(number, low, high, ord) WHERE sic BETWEEN low AND high ORDER BY ord DESC LIMIT 1) AS ffi{k}"
    return f"SELECT sic, {', '.join(map(one, sorted(industry.SCHEMES)))} FROM (SELECT DISTINCT p_partkey * 7 % 9000 AS sic FROM {{part}})"


def _live_codes(v):
    y = v("fundamentals_year").join(v("link").filter("linkprim = 'P'").select("gvkey", "permno").distinct(), "gvkey").select("gvkey", "permno", "datadate", "sic", "sic2")
    return timing.expand_rolling(y, ties=("gvkey",)).select("permno", "signal_yyyymm", "sic", "sic2")


def _months(v):
    n = v("names").filter("nameendt IS NULL").select("permno", "siccd")
    return v("security_month").select("permno", "signal_yyyymm").join(n, "permno")


LIVE_CODES = """(SELECT permno, CAST(floor(k / 12) * 100 + k % 12 + 1 AS INTEGER) AS signal_yyyymm, sic, sic2 FROM (SELECT l.permno, y.gvkey, y.datadate, y.sic, y.sic2, unnest(range(year(datadate) * 12 + month(datadate) + 6, year(datadate) * 12 + month(datadate) + 19)) AS k
    FROM {fundamentals_year} y JOIN (SELECT DISTINCT gvkey, permno FROM {link} WHERE linkprim = 'P') l ON y.gvkey = l.gvkey) QUALIFY row_number() OVER (PARTITION BY permno, k ORDER BY datadate DESC, gvkey) = 1)"""
MONTHS = "(SELECT s.permno, s.signal_yyyymm, n.siccd FROM {security_month} s JOIN {names} n ON s.permno = n.permno AND n.nameendt IS NULL)"


def _estimates(v):
    """Forecasts with the columns of their source: a cusip with spaces, two horizons, announcements before and after."""
    q = v("fundamentals_quarter").select("gvkey", "datadate", "ibq")
    dated = q.select(F.concat(F.lit("00 "), F.lpad(F.col("gvkey").cast("string"), 5, "0"), F.lit("99")).alias("cusip"), F.col("datadate").alias("fpedats"), F.col("gvkey"), F.explode(F.array(*(F.lit(k) for k in (0, 30, 60, 100)))).alias("back"), "ibq")
    return dated.select("cusip", "fpedats", F.expr("date_add(fpedats, 10 - back)").alias("statpers"), F.expr("date_add(fpedats, CASE WHEN gvkey % 6 = 0 THEN -40 ELSE 25 END)").alias("anndats_act"), F.when((F.col("gvkey") + F.col("back")) % 4 == 0, "1").otherwise("6").alias("fpi"), F.lit("EPS").alias("measure"), F.when((F.col("gvkey") + F.col("back")) % 7 > 0, F.col("ibq") + F.col("back")).alias("medest"), F.col("ibq").alias("actual"))


def _forecast_quarters(v):
    q = v("fundamentals_quarter").select("gvkey", "datadate", F.concat(F.lit("00"), F.substring(F.lpad(F.col("gvkey").cast("string"), 5, "0"), 1, 4)).alias("cusip6"))
    # Of the companies that share a six-digit code the first one is kept.
    q = links.pick_one(q, ["cusip6", "datadate"], ["gvkey"])
    e = links.pick_one(_estimates(v).withColumn("c6", F.substring(F.regexp_replace("cusip", " ", ""), 1, 6)), ["c6", "fpedats", "statpers", "fpi"], [F.col("medest").asc_nulls_last()])
    return readers.with_forecasts(q, readers.quarterly_forecasts(e))


FORECAST_SQL = """WITH q AS (SELECT gvkey, datadate, concat('00', substr(lpad(CAST(gvkey AS VARCHAR), 5, '0'), 1, 4)) AS cusip6, ibq FROM {fundamentals_quarter}),
    e AS (SELECT cusip6, datadate AS fpedats, CAST(datadate + CAST(10 - back AS INTEGER) AS DATE) AS statpers, CAST(datadate + CASE WHEN gvkey % 6 = 0 THEN -40 ELSE 25 END AS DATE) AS ann, CASE WHEN (gvkey + back) % 4 = 0 THEN '1' ELSE '6' END AS fpi, CASE WHEN (gvkey + back) % 7 > 0 THEN ibq + back END AS medest FROM q, unnest([0, 30, 60, 100]) t(back)),
    one AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY cusip6, fpedats, statpers, fpi ORDER BY medest NULLS LAST) = 1),
    last AS (SELECT * FROM one WHERE fpi = '6' AND statpers < ann AND fpedats >= statpers AND medest IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cusip6, fpedats ORDER BY statpers DESC, medest) = 1)
    SELECT q.gvkey, q.datadate, q.cusip6, l.statpers, l.medest FROM (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY cusip6, datadate ORDER BY gvkey) = 1) q LEFT JOIN last l ON l.cusip6 = q.cusip6 AND l.fpedats = q.datadate"""

SIZE_SQL = """SELECT permno, source_date, date, lme AS lagged_market_equity, ln(lme) AS mvel1 FROM (SELECT *, lag(me) OVER w AS lme, lag(date) OVER w AS source_date FROM
    (SELECT permno, date, abs(last_value(p IGNORE NULLS) OVER u) * last_value(shrout IGNORE NULLS) OVER u AS me FROM (SELECT permno, date, m, CASE WHEN (permno + m) % 8 > 0 THEN prc END AS p, shrout FROM {security_month}) WINDOW u AS (PARTITION BY permno ORDER BY date ROWS UNBOUNDED PRECEDING)) WHERE me > 0 WINDOW w AS (PARTITION BY permno ORDER BY date)) WHERE lme IS NOT NULL"""


def _shifted_benchmark(v):
    """A benchmark against its cell's mean some months before and after."""
    modes = audit.modal_benchmark(v("adjusted"), "industry", "m", "implied", 4)
    means = v("adjusted").groupBy("industry", "m").agg(F.avg("base").alias("mean"))
    return compare.shift_search(modes, means, "industry", "m", "mode", "mean", list(range(-2, 3)))


def _three_sources(v):
    """Rank agreement of three panels' values of one feature, two by two, where all have it."""
    j = v("panel_a").select("permno", "m", "c").join(v("panel_b").select("permno", "m", "c2"), ["permno", "m"]).join(v("security_month").select("permno", "m", F.col("vol").alias("c3")), ["permno", "m"]).dropna(subset=["c", "c2", "c3"])
    two = [("c", "c2"), ("c", "c3"), ("c2", "c3")]
    p = j.select("m", F.explode(F.array(*(F.struct(F.lit(f"{a} {b}").alias("char"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in two))).alias("p")).select("m", "p.*")
    return compare.spearman(p, ["char", "m"], 10)


THREE = "(" + " UNION ALL ".join(f"SELECT m, '{a} {b}' AS char, {a} AS x, {b} AS y FROM t" for a, b in (("c", "c2"), ("c", "c3"), ("c2", "c3"))) + ")"
_rank = lambda c: f"rank() OVER (PARTITION BY char, m ORDER BY {c}) + (count(*) OVER (PARTITION BY char, m, {c}) - 1) / 2e0"
THREE_SQL = "WITH t AS (SELECT p.permno, p.m, p.c, q.c2, s.vol AS c3 FROM {panel_a} p JOIN {panel_b} q ON q.permno = p.permno AND q.m = p.m JOIN {security_month} s ON s.permno = p.permno AND s.m = p.m WHERE p.c IS NOT NULL AND q.c2 IS NOT NULL AND s.vol IS NOT NULL) " + f"SELECT char, m, count(*) AS n, corr(rx, ry) AS rho FROM (SELECT *, {_rank('x')} AS rx, {_rank('y')} AS ry FROM {THREE}) GROUP BY 1, 2 HAVING count(*) >= 10"


def _features(v):
    return v("panel_a").select("permno", "signal_yyyymm", "target_yyyymm", "industry", F.col("a").alias("bm"), F.col("b").alias("mvel1"), "c")


def _tails_sql(columns: str, source: str) -> str:
    return f"SELECT {columns}, CASE WHEN bm IS NULL THEN NULL ELSE least(greatest(bm, l1), h1) END AS bm, CASE WHEN mvel1 IS NULL THEN NULL ELSE least(mvel1, h2) END AS mvel1 FROM ({source}) JOIN (SELECT signal_yyyymm, quantile_cont(bm, 0.01) AS l1, quantile_cont(bm, 0.99) AS h1, quantile_cont(mvel1, 0.99) AS h2 FROM ({source}) GROUP BY 1) USING (signal_yyyymm)"


FEATURES = "SELECT permno, signal_yyyymm, target_yyyymm, industry, a AS bm, b AS mvel1, c FROM {panel_a}"


def _stated_books(v):
    y = monthly.stated_equity(v("fundamentals_year")).select("gvkey", "datadate", "book")
    return monthly.book_to_market(y.join(v("link").filter("linkprim = 'P'").select("gvkey", "permno", "permco").distinct(), "gvkey"), _december(v))


STATED_SQL = BM_SQL.replace("y.ceq AS book", "y.seq + coalesce(y.txditc, 0) - coalesce(y.pstkrv, y.pstkl, y.pstk, 0) AS book").replace("ON y.gvkey = l.gvkey)", "ON y.gvkey = l.gvkey AND y.seq + coalesce(y.txditc, 0) - coalesce(y.pstkrv, y.pstkl, y.pstk, 0) > 0)")


def _spine(v):
    """Of two stored tables the second has what a spine needs."""
    dated = links.interval_join(v("security_month"), v("names"), ["permno"], "date", "namedt", "nameendt")
    return panel.month_spine([v("panel_a"), dated], lambda: v("security_month"))


SPINE_SQL = "SELECT s.permno, s.permco, s.date, s.signal_yyyymm, s.target_yyyymm, n.siccd, n.exchcd, n.shrcd, lag(s.signal_yyyymm) OVER (PARTITION BY s.permno ORDER BY s.m) AS source_yyyymm FROM {security_month} s JOIN {names} n ON s.permno = n.permno AND s.date BETWEEN n.namedt AND coalesce(n.nameendt, DATE '9999-12-31')"


def _turnover_search(v):
    reports = industry.with_scheme(v("fundamentals_year").select("gvkey", "datadate", "fyear", "sic", "sic2", "sale", "assets"), 12)
    found = panel.cut_lineage(turnover.candidates(reports, _links_of(v), "ffi12"))
    return turnover.search(found, timing.expand_fixed(found.select("permno", "datadate", "chato_ia")), "chato_ia")


def _turnover_sql() -> str:
    names = turnover.CANDIDATES
    scheme = f"(SELECT sic, (SELECT number FROM (VALUES {', '.join(f'({n}, {low}, {high}, {i})' for i, (n, _, low, high) in enumerate(industry.ranges(12)))}) r(number, low, high, ord) WHERE sic BETWEEN low AND high ORDER BY ord DESC LIMIT 1) AS ffi12 FROM (SELECT DISTINCT sic FROM {{fundamentals_year}}))"
    less = lambda c, over, name: f"{c} - avg({c}) OVER {over} AS {name}"
    return f"""WITH c0 AS (SELECT gvkey, datadate, fyear, sic2, ffi12, sale, assets, sale / nullif((assets + lag(assets) OVER w) / 2, 0) AS ato, lag(sale) OVER w / nullif((lag(assets) OVER w + lag(assets, 2) OVER w) / 2, 0) AS bef, row_number() OVER w AS n
        FROM {{fundamentals_year}} y LEFT JOIN {scheme} k USING (sic) WINDOW w AS (PARTITION BY gvkey ORDER BY datadate)),
    c1 AS (SELECT *, ato - bef AS chato, CASE WHEN n > 2 THEN ato - bef END AS masked, ato - lag(ato) OVER w AS change, (ato - lag(ato) OVER w) / nullif(lag(ato) OVER w, 0) AS pct FROM c0 WINDOW w AS (PARTITION BY gvkey ORDER BY datadate)),
    c2 AS (SELECT *, {', '.join(less(c, 'g', f'{c}_ia') for c in ('chato', 'masked', 'ato', 'change', 'pct'))}, {', '.join(less(c, 'f', f'{c}_scheme') for c in ('chato', 'change'))} FROM c1
        WINDOW g AS (PARTITION BY fyear, sic2), f AS (PARTITION BY ffi12, year(datadate) * 12 + month(datadate))),
    c3 AS (SELECT c2.*, l.permno FROM c2 JOIN (SELECT DISTINCT gvkey, datadate, permno FROM ({LINKED})) l USING (gvkey, datadate) QUALIFY row_number() OVER (PARTITION BY permno, datadate ORDER BY gvkey) = 1),
    c4 AS (SELECT *, sale / nullif((assets + lag(assets) OVER (PARTITION BY permno ORDER BY datadate)) / 2, 0) AS o FROM c3),
    c5 AS (SELECT *, o - lag(o) OVER (PARTITION BY permno ORDER BY datadate) AS own, row_number() OVER (PARTITION BY gvkey ORDER BY permno, datadate) AS k FROM c4),
    c6 AS (SELECT *, {less('own', '(PARTITION BY fyear, sic2)', 'own_ia')} FROM c5),
    c7 AS (SELECT permno, year(datadate) * 12 + month(datadate) - 1 AS told, {', '.join(f'round(CASE WHEN k > {first} THEN {c} END, 9) AS {c}' for c, first in names.items())} FROM c6),
    june AS (SELECT *, 'june' AS timing FROM (SELECT *, unnest(range(CAST(floor(told / 12) AS BIGINT) * 12 + 17, CAST(floor(told / 12) AS BIGINT) * 12 + 29)) AS s FROM c7) QUALIFY row_number() OVER (PARTITION BY permno, s ORDER BY told DESC) = 1),
    follow AS (SELECT *, unnest(range(told + 4, coalesce(nx + 4, told + 16))) AS s, 'next_report' AS timing FROM (SELECT *, lead(told) OVER (PARTITION BY permno ORDER BY told) AS nx FROM c7)),
    two AS (SELECT timing, permno, s, {', '.join(names)} FROM june UNION ALL SELECT timing, permno, s, {', '.join(names)} FROM follow),
    p AS ({' UNION ALL '.join(f"SELECT '{c}' AS candidate, b.timing, b.{c} AS x, j.chato_ia AS y FROM two b JOIN june j ON j.permno = b.permno AND j.s = b.s WHERE b.{c} IS NOT NULL AND j.chato_ia IS NOT NULL" for c in names)}),
    q AS (SELECT candidate, timing, quantile_cont(x, 0.01) AS lx, quantile_cont(x, 0.99) AS hx, quantile_cont(y, 0.01) AS ly, quantile_cont(y, 0.99) AS hy FROM p GROUP BY 1, 2),
    r AS (SELECT *, rank() OVER (PARTITION BY candidate, timing ORDER BY x) + (count(*) OVER (PARTITION BY candidate, timing, x) - 1) / 2e0 AS rx, rank() OVER (PARTITION BY candidate, timing ORDER BY y) + (count(*) OVER (PARTITION BY candidate, timing, y) - 1) / 2e0 AS ry FROM p)
    SELECT candidate, timing, count(*) AS n, corr(rx, ry) AS rho, corr(x, y) AS pearson, median(abs(x - y)) AS median_abs, avg(abs(x - y)) AS mean_abs, quantile_cont(abs(x - y), 0.95) AS p95_abs, corr(least(greatest(x, lx), hx), least(greatest(y, ly), hy)) AS winsor_corr
    FROM r JOIN q USING (candidate, timing) GROUP BY 1, 2"""


QUERIES = [
    Query("stated_book_to_market", _stated_books, "permno permco datadate book_to_market~7", STATED_SQL),
    Query("month_spine", _spine, "permno permco date signal_yyyymm target_yyyymm siccd exchcd shrcd source_yyyymm", SPINE_SQL),
    Query("turnover_search", _turnover_search, "candidate timing n rho~5 pearson~5 median_abs~6 mean_abs~6 p95_abs~6 winsor_corr~5", _turnover_sql()),
    Query("industry_schemes", _schemes, "sic ffi5 ffi10 ffi12 ffi38", _scheme_sql()),
    Query("codes_of_company", lambda v: links.with_codes(_months(v), _live_codes(v)), "permno signal_yyyymm sic sic2", f"SELECT permno, signal_yyyymm, c.sic, c.sic2 FROM {MONTHS} m LEFT JOIN {LIVE_CODES} c USING (permno, signal_yyyymm)"),
    Query("codes_of_history", lambda v: links.with_codes(_months(v), _live_codes(v), "history"), "permno signal_yyyymm sic sic2", f"SELECT permno, signal_yyyymm, m.siccd AS sic, coalesce(c.sic2, substr(lpad(CAST(m.siccd AS VARCHAR), 4, '0'), 1, 2)) AS sic2 FROM {MONTHS} m LEFT JOIN {LIVE_CODES} c USING (permno, signal_yyyymm)"),
    Query("industry_adjusted_linked", lambda v: f.industry_adjusted(v("fundamentals_year"), members=_links_of(v)), "gvkey fyear sic2 " + " ".join(f"{n}~5" for n in [*f.ADJUSTED, "herf"]), _adjusted_sql(f"SELECT gvkey, datadate FROM ({LINKED})")),
    Query("forecast_quarters", _forecast_quarters, "gvkey datadate cusip6 statpers medest~5", FORECAST_SQL),
    Query("lagged_size", lambda v: monthly.lagged_size(v("security_month").withColumn("prc", F.when((F.col("permno") + F.col("m")) % 8 > 0, F.col("prc")))), "permno source_date date lagged_market_equity~3 mvel1~6", SIZE_SQL),
    Query("shifted_benchmark", _shifted_benchmark, "shift n corr~6", f"SELECT s AS shift, count(*) AS n, corr(p.mode, q.mean) AS corr FROM {MODES} p, unnest([-2, -1, 0, 1, 2]) t(s) JOIN (SELECT industry, m, avg(base) AS mean FROM {{adjusted}} GROUP BY 1, 2) q ON q.industry = p.industry AND q.m = p.m + s GROUP BY 1"),
    Query("three_sources", _three_sources, "char m n rho~6", THREE_SQL),
    Query("winsorize_by_kind", lambda v: crosssection.winsorize_by_kind(_features(v), ["signal_yyyymm"]), "permno signal_yyyymm bm~6 mvel1~6 c~6", _tails_sql("permno, signal_yyyymm, c", FEATURES)),
    Query("expand_by_name", lambda v: timing.expand(v("fundamentals_year").select("gvkey", "datadate", "assets"), "rolling", key="gvkey"), "gvkey datadate signal_yyyymm assets~5", "SELECT gvkey, datadate, assets, CAST(floor(k / 12) * 100 + k % 12 + 1 AS INTEGER) AS signal_yyyymm FROM (SELECT *, unnest(range(year(datadate) * 12 + month(datadate) + 6, year(datadate) * 12 + month(datadate) + 19)) AS k FROM {fundamentals_year}) QUALIFY row_number() OVER (PARTITION BY gvkey, k ORDER BY datadate DESC) = 1"),
    Query("annual_scan", lambda v: readers.annual_fundamentals(v("fundamentals_year"), "1993-01-01", "1997-12-31"), "gvkey datadate prcc_f~5", "SELECT gvkey, datadate, abs(prcc_f) AS prcc_f FROM {fundamentals_year} WHERE assets IS NOT NULL AND prcc_f IS NOT NULL AND ni IS NOT NULL AND datadate BETWEEN DATE '1993-01-01' AND DATE '1997-12-31'"),
    Query("quarterly_scan", lambda v: readers.quarterly_fundamentals(v("fundamentals_quarter"), "1994-01-01"), "gvkey datadate ibq~5", "SELECT gvkey, datadate, ibq FROM {fundamentals_quarter} WHERE ibq IS NOT NULL AND datadate >= DATE '1994-01-01'"),
]
