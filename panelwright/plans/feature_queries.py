"""Queries of the feature library."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import regression
from ..operators.timing import expand_rolling
from . import features as f
from . import monthly as m
from .shapes import Query

_LAG_COLUMNS = "assets act che lct dlc txp dp ib csho lt sale revt cogs emp rect invt ppent ppegt aco intan ao ap lco lo ceq dltt ni capx ob dvt xrd xsga".split()
_QLAG_COLUMNS = "atq actq cheq lctq dlcq ppentq saleq txtq ibq seqq ceqq pstkq pstkrq ltq cshoq ajexq dlttq".split()


def _wide(table: str, columns: list[str], ks: range) -> str:
    lags = ", ".join(f"lag({c}, {k}) OVER w AS {c}_{k}" for c in columns for k in ks)
    return f"SELECT *, row_number() OVER w AS n_row, {lags} FROM {{{table}}} WINDOW w AS (PARTITION BY gvkey ORDER BY datadate)"


def _chosen(defs: dict, names=None) -> str:
    return ", ".join(f"CASE WHEN n_row >= {n} THEN {e} END AS {k}" for k, (e, n) in defs.items() if names is None or k in names)


ANNUAL_WIDE, QUARTER_WIDE = _wide("fundamentals_year", _LAG_COLUMNS, range(1, 3)), _wide("fundamentals_quarter", _QLAG_COLUMNS, range(1, 5))
ANNUAL_SQL = f"SELECT gvkey, datadate, fyear, sic2, {_chosen(f.ANNUAL)} FROM ({ANNUAL_WIDE})"


def _adjusted_sql(members: str | None = None) -> str:
    raw = ", ".join(f"{f.ANNUAL[of][0] if of in f.ANNUAL else of} AS r_{n}" for n, (of, _) in f.ADJUSTED.items())
    less = ", ".join(f"CASE WHEN n_row >= {h} THEN r_{n} - avg(r_{n}) OVER w END AS {n}" for n, (_, h) in f.ADJUSTED.items())
    inner = f"SELECT gvkey, datadate, fyear, sic2, n_row, sale, {raw} FROM ({ANNUAL_WIDE})"
    if members:
        inner = f"SELECT * FROM ({inner}) WHERE (gvkey, datadate) IN ({members})"
    first = f"SELECT *, {less}, sum(sale) OVER w AS total FROM ({inner}) WINDOW w AS (PARTITION BY sic2, fyear)"
    return f"SELECT *, sum(pow(sale / nullif(total, 0), 2)) OVER (PARTITION BY sic2, fyear) AS herf FROM ({first})"


def _scores_sql(members: str | None = None) -> str:
    only = f" WHERE (gvkey, datadate) IN ({members})" if members else ""
    raw = ", ".join(f"{e} AS r_{n}" for n, e in f.SCORES.items())
    above = ", ".join(f"CASE WHEN r_{n} > median(r_{n}) OVER w THEN 1 ELSE 0 END AS {n}" for n in f.SCORES)
    return f"SELECT gvkey, datadate, fyear, sic2, {above}, CASE WHEN oancf > ni THEN 1 ELSE 0 END AS m3 FROM (SELECT gvkey, datadate, fyear, sic2, oancf, ni, {raw} FROM ({ANNUAL_WIDE})){only} WINDOW w AS (PARTITION BY fyear, sic2)"


def _quarterly_sql() -> str:
    first = f"SELECT gvkey, datadate, rdq, fyearq, fqtr, sic2, n_row, ibq, {f.QUARTERLY['roaq'][0]} AS r_roaq, {_chosen(f.QUARTERLY)} FROM ({QUARTER_WIDE})"
    std = lambda c, w, n, o: f"CASE WHEN n_row >= {n} AND count({c}) OVER w{w} >= 2 THEN stddev_samp({c}) OVER w{w} END AS {o}"
    ups = [f"coalesce(lag(ibq, {i}) OVER o > lag(ibq, {i + 1}) OVER o, false)" for i in range(8)]
    streak = " + ".join(f"CASE WHEN {' AND '.join(ups[: i + 1])} THEN 1 ELSE 0 END" for i in range(8))
    second = f"SELECT *, {std('sacc', 16, 17, 'stdacc')}, {std('scf', 16, 17, 'stdcf')}, {std('r_roaq', 8, 8, 'roavol')}, {std('rsup', 8, 8, 'sgrvol')}, {streak} AS nincr FROM ({first}) WINDOW o AS (PARTITION BY gvkey ORDER BY datadate), w16 AS (PARTITION BY gvkey ORDER BY datadate ROWS BETWEEN 15 PRECEDING AND CURRENT ROW), w8 AS (PARTITION BY gvkey ORDER BY datadate ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)"
    third = f"SELECT *, median(roavol) OVER g AS d7, median(sgrvol) OVER g AS d8 FROM ({second}) WINDOW g AS (PARTITION BY fyearq, fqtr, sic2)"
    low = lambda v, d, o: f"CASE WHEN ({v} IS NULL AND {d} IS NOT NULL) OR {v} < {d} THEN 1 ELSE 0 END AS {o}"
    return f"SELECT *, {low('roavol', 'd7', 'm7')}, {low('sgrvol', 'd8', 'm8')} FROM ({third})"


_MONTHLY = """SELECT *, avg(mom12m) OVER (PARTITION BY industry, m) AS indmom FROM (SELECT permno, m, industry, ret,
    CASE WHEN lag(abs(prc) * shrout) OVER w > 0 THEN ln(lag(abs(prc) * shrout) OVER w) END AS mvel1, lag(ret) OVER w AS mom1m,
    CASE WHEN count(ret) OVER w2_6 = 5 THEN product(1 + ret) OVER w2_6 - 1 END AS mom6m,
    CASE WHEN count(ret) OVER w2_12 = 11 THEN product(1 + ret) OVER w2_12 - 1 END AS mom12m,
    CASE WHEN count(ret) OVER w13_36 = 24 THEN product(1 + ret) OVER w13_36 - 1 END AS mom36m,
    CASE WHEN count(ret) OVER w13_60 = 48 THEN product(1 + ret) OVER w13_60 - 1 END AS mom60m,
    CASE WHEN row_number() OVER w >= 13 THEN product(1 + ret) OVER w1_6 - product(1 + ret) OVER w7_12 END AS chmom,
    lag(ret, 11) OVER w AS seas1a,
    CASE WHEN lag(vol, 2) OVER w * abs(lag(prc, 2) OVER w) > 0 THEN ln(lag(vol, 2) OVER w * abs(lag(prc, 2) OVER w)) END AS dolvol,
    avg(vol) OVER w1_3 / nullif(shrout, 0) AS turn
    FROM (SOURCE)
    WINDOW w AS (PARTITION BY permno ORDER BY m), """ + ", ".join(f"w{a}_{b} AS (PARTITION BY permno ORDER BY m ROWS BETWEEN {b} PRECEDING AND {a} PRECEDING)" for a, b in ((1, 3), (1, 6), (7, 12), (2, 6), (2, 12), (13, 36), (13, 60))) + ")"
MONTHLY_SQL = _MONTHLY.replace("SOURCE", "SELECT s.*, n.siccd % 10 AS industry FROM {security_month} s JOIN {names} n ON s.permno = n.permno AND n.nameendt IS NULL WHERE ret IS NOT NULL")

DAILY_SQL = """SELECT *, (zeros + (1 / nullif(turns, 0)) / 480000) * 21 / ndays AS zerotrade FROM (SELECT permno, year(date) * 12 + month(date) - 1 AS m,
    max(ret) AS maxret, stddev_samp(ret) AS rvar_mean, avg((askhi - bidlo) / nullif((askhi + bidlo) / 2, 0)) AS baspread,
    stddev_samp(CASE WHEN abs(prc * vol) > 0 THEN ln(abs(prc * vol)) END) AS std_dolvol, stddev_samp(vol / nullif(shrout, 0)) AS std_turn,
    avg(abs(ret) / nullif(abs(prc) * vol, 0)) AS ill, sum(CASE WHEN vol = 0 THEN 1 ELSE 0 END) AS zeros, count(*) AS ndays, sum(vol / nullif(shrout, 0)) AS turns
    FROM {security_day} GROUP BY 1, 2)"""


def _industry_month(v):
    names = v("names").filter("nameendt IS NULL").select(F.col("permno").alias("_p"), (F.col("siccd") % 10).alias("industry"))
    s = v("security_month")
    return s.join(names, s["permno"] == names["_p"]).drop("_p")


def _weekly(v):
    return regression.with_market(regression.compound(v("stock_day"), "permno", "date", "ret"))


WEEKLY_SQL = """SELECT permno, week, ret, avg(ret) OVER (PARTITION BY week) AS mkt FROM (SELECT permno, date + CAST(4 - (isodow(date) - 1) AS INTEGER) AS week,
    product(1 + ret) - 1 AS ret FROM {stock_day} GROUP BY 1, 2)"""
SPREAD = """SELECT w.*, unnest(range(CASE WHEN day(week) = 1 THEN year(week) * 12 + month(week) ELSE year(week) * 12 + month(week) + 1 END, year(week) * 12 + month(week) + 36)) AS m FROM (""" + WEEKLY_SQL + ") w WHERE ret IS NOT NULL"
BETA_SQL = f"""SELECT permno, m, n_obs, sxy / nullif(sxx, 0) AS beta, pow(sxy / nullif(sxx, 0), 2) AS betasq, sqrt(greatest(syy - sxy * sxy / nullif(sxx, 0), 0) / (n_obs - 1)) AS idiovol
    FROM (SELECT permno, m, count(*) AS n_obs, regr_sxy(ret, mkt) AS sxy, regr_sxx(ret, mkt) AS sxx, regr_syy(ret, mkt) AS syy FROM ({SPREAD}) GROUP BY 1, 2) JOIN (SELECT permno, m FROM {{security_month}}) USING (permno, m) WHERE n_obs >= 52"""


def _betas(v, lags=0):
    return regression.rolling_regression(_weekly(v), v("security_month").select("permno", "m"), "permno", "m", "week", "ret", "mkt", lags=lags)


def _excess_daily(v):
    return regression.daily_excess(v("stock_day"), v("delist_day"), v("factors_day"), out="y")


def sweep_sql(source: str, keep: str, k: int) -> str:
    """Centred sums of products c{i}_{j} of source with regressors 1 to k - 1 partialled out, one subquery each."""
    at = lambda i, j: f"c{min(i, j)}_{max(i, j)}"
    for p in range(k - 1, 0, -1):
        source = f"(SELECT {keep}, " + ", ".join(f"{at(i, j)} - coalesce({at(i, p)} * {at(j, p)} / nullif({at(p, p)}, 0), 0) AS {at(i, j)}" for i in range(p) for j in range(i, p)) + f" FROM {source})"
    return source


EXCESS_DAY = "(SELECT d.permno, d.date, (1 + coalesce(d.ret, 0)) * (1 + coalesce(x.dlret, 0)) - 1 - f.rf AS y, f.mktrf, f.smb, f.hml FROM {stock_day} d LEFT JOIN {factors_day} f ON d.date = f.date LEFT JOIN {delist_day} x ON x.permno = d.permno AND x.date = d.date)"


def _residual_sql(factors: list[str], out: str, min_obs: int = 21) -> str:
    cols, k = ["y", *factors], 1 + len(factors)
    two = [(i, j) for i in range(k) for j in range(i, k)]
    ok = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    monthly = "(SELECT permno, year(date) * 12 + month(date) - 1 AS m, count(*) FILTER ({ok}) AS n, ".replace("{ok}", ok) + ", ".join([f"coalesce(sum({c}) FILTER ({ok}), 0) AS s{i}" for i, c in enumerate(cols)] + [f"coalesce(sum({cols[i]} * {cols[j]}) FILTER ({ok}), 0) AS p{i}_{j}" for i, j in two]) + f" FROM {EXCESS_DAY} GROUP BY 1, 2)"
    names = ["n", *(f"s{i}" for i in range(k)), *(f"p{i}_{j}" for i, j in two)]
    rolled = f"(SELECT permno, m, {', '.join(f'sum({c}) OVER w AS {c}' for c in names)} FROM {monthly} WINDOW w AS (PARTITION BY permno ORDER BY m ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"
    centred = f"(SELECT permno, m, n, {', '.join(f'p{i}_{j} - s{i} * s{j} / n AS c{i}_{j}' for i, j in two)} FROM {rolled} WHERE n >= {min_obs})"
    return f"SELECT permno, m, greatest(c0_0, 0) / (n - 1) AS {out} FROM {sweep_sql(centred, 'permno, m, n', k)}"


def _delay_sql(lags: int = 4, min_obs: int = 52) -> str:
    cols, k = ["y", "x", *(f"l{i}" for i in range(1, lags + 1))], lags + 2
    two = [(i, j) for i in range(k) for j in range(i, k)]
    spread = SPREAD.replace("w.*", "w.permno, w.week, w.ret AS y, w.mkt AS x")
    inside = "(SELECT *, " + ", ".join(f"lag(x, {i}) OVER w AS l{i}" for i in range(1, lags + 1)) + f" FROM ({spread}) WINDOW w AS (PARTITION BY permno, m ORDER BY week))"
    ok = f"l{lags} IS NOT NULL"
    sums = ", ".join([f"sum({c}) FILTER ({ok}) AS s{i}" for i, c in enumerate(cols)] + [f"sum({cols[i]} * {cols[j]}) FILTER ({ok}) AS p{i}_{j}" for i, j in two])
    grouped = f"(SELECT permno, m, count(*) AS n0, regr_r2(y, x) AS r2, count(*) FILTER ({ok}) AS n, {sums} FROM {inside} GROUP BY 1, 2)"
    centred = f"(SELECT permno, m, n0, r2, n, p0_0 - s0 * s0 / n AS total, {', '.join(f'p{i}_{j} - s{i} * s{j} / n AS c{i}_{j}' for i, j in two)} FROM {grouped} WHERE n0 >= {min_obs})"
    fit = sweep_sql(centred, "permno, m, n0, r2, n, total", k)
    return f"SELECT permno, m, n0 AS n_obs, 1 - (1 - (1 - r2) * (n0 - 1) / (n0 - 2)) / nullif(1 - (c0_0 / nullif(total, 0)) * (n - 1) / (n - {k}), 0) AS pricedelay FROM {fit} JOIN (SELECT permno, m FROM {{security_month}}) USING (permno, m)"


def _events(v):
    q = v("fundamentals_quarter").filter("rdq IS NOT NULL").select(F.col("gvkey"), "rdq")
    link = v("link").filter("linkprim = 'P'").select(F.col("gvkey").alias("_g"), "permno").distinct()
    return q.join(link, q["gvkey"] == link["_g"]).select("permno", "rdq").distinct()


_BACK30 = "CASE WHEN isodow(rdq) > 5 THEN rdq + CAST(8 - isodow(rdq) AS INTEGER) ELSE rdq END"
EVENT_SQL = f"""SELECT a.permno, a.rdq, a.ear, (a.v1 - b.v0) / nullif(b.v0, 0) AS aeavol FROM
    (SELECT e.permno, e.rdq, sum(d.ret) AS ear, avg(d.vol) AS v1 FROM ev e JOIN {{security_day}} d ON d.permno = e.permno AND d.date BETWEEN e.lo1 AND e.hi1 GROUP BY 1, 2) a
    LEFT JOIN (SELECT e.permno, e.rdq, avg(d.vol) AS v0 FROM ev e JOIN {{security_day}} d ON d.permno = e.permno AND d.date BETWEEN e.lo30 AND e.hi10 GROUP BY 1, 2) b ON a.permno = b.permno AND a.rdq = b.rdq"""
_EVENTS = f""" (SELECT permno, rdq,
    CASE isodow(rdq) WHEN 1 THEN rdq - 3 WHEN 7 THEN rdq - 2 WHEN 6 THEN rdq - 1 ELSE rdq - 1 END AS lo1,
    CASE isodow(rdq) WHEN 5 THEN rdq + 3 WHEN 6 THEN rdq + 2 WHEN 7 THEN rdq + 1 ELSE rdq + 1 END AS hi1,
    ({_BACK30}) - 42 AS lo30, ({_BACK30}) - 14 AS hi10
    FROM (SELECT DISTINCT l.permno, q.rdq FROM {{fundamentals_quarter}} q JOIN {{link}} l ON q.gvkey = l.gvkey AND l.linkprim = 'P' WHERE q.rdq IS NOT NULL)) e"""
_EVENT = EVENT_SQL
EVENT_SQL = _EVENT.replace(" ev e", _EVENTS)

REVISION_SQL = """SELECT permno, m, re FROM (SELECT permno, year(statpers) * 12 + month(statpers) - 1 AS m, statpers, fpedats, n,
    CASE WHEN n = 4 THEN avg(r) OVER p3 WHEN n = 5 THEN avg(r) OVER p4 WHEN n = 6 THEN avg(r) OVER p5 WHEN n >= 7 THEN avg(r) OVER p6 END AS re
    FROM (SELECT *, row_number() OVER (PARTITION BY permno, fpedats ORDER BY statpers) AS n FROM (SELECT s.permno, f.statpers, f.fpedats,
    (f.meanest - lag(f.meanest) OVER (PARTITION BY s.permno, f.fpedats ORDER BY f.statpers)) / s.prc AS r, s.prc FROM (SELECT * FROM {estimates} QUALIFY row_number() OVER (PARTITION BY ticker, cusip, statpers ORDER BY fpedats DESC, meanest) = 1) f
    JOIN (SELECT s.permno, substr(n.ncusip, 1, 6) AS code, last_day(last_day(s.date) + INTERVAL 1 MONTH) AS merge_date, abs(s.prc) / (1 + s.permno % 3) AS prc FROM {security_month} s JOIN {names} n ON s.permno = n.permno AND s.date BETWEEN n.namedt AND coalesce(n.nameendt, DATE '9999-12-31')) s
    ON substr(f.cusip, 1, 6) = s.code AND last_day(f.statpers) = s.merge_date) WHERE r IS NOT NULL AND prc > 0)
    WINDOW """ + ", ".join(f"p{k} AS (PARTITION BY permno ORDER BY fpedats, statpers ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)" for k in (3, 4, 5, 6)) + """)
    WHERE n >= 4 QUALIFY row_number() OVER (PARTITION BY permno, m ORDER BY fpedats DESC, statpers DESC) = 1"""


def _revisions(v):
    months = v("security_month").select("permno", "date", "prc", (1 + F.col("permno") % 3).alias("cfacpr"))
    return m.revision_feature(m.latest_periods(v("estimates")), m.dated_prices(months, v("names")))


def _december(v):
    return v("security_month").filter("m % 12 = 11").select("permno", "permco", F.year("date").alias("year"), (F.col("prc") * F.col("shrout")).alias("value"))


def _books(v):
    y, link = v("fundamentals_year"), v("link").filter("linkprim = 'P'").select(F.col("gvkey").alias("_g"), "permno", "permco").distinct()
    return y.join(link, y["gvkey"] == link["_g"]).select("gvkey", "permno", "permco", "datadate", F.col("ceq").alias("book"), F.col("sic2").alias("industry"))


DECEMBER = "(SELECT permno, permco, year(date) AS year, prc * shrout AS value FROM {security_month} WHERE m % 12 = 11)"
BOOKS = "(SELECT y.gvkey, l.permno, l.permco, y.datadate, y.ceq AS book, y.sic2 AS industry FROM {fundamentals_year} y JOIN (SELECT DISTINCT gvkey, permno, permco FROM {link} WHERE linkprim = 'P') l ON y.gvkey = l.gvkey)"
BM_SQL = f"""SELECT permno, permco, datadate, book_to_market, industry FROM (SELECT b.*, b.book * 1000 / nullif(f.v, 0) AS book_to_market, d.value AS own FROM
    (SELECT * FROM {BOOKS} QUALIFY row_number() OVER (PARTITION BY gvkey, year(datadate) ORDER BY datadate DESC) = 1) b
    JOIN (SELECT permco, year, sum(value) AS v FROM {DECEMBER} GROUP BY 1, 2) f ON b.permco = f.permco AND year(b.datadate) = f.year
    LEFT JOIN {DECEMBER} d ON b.permno = d.permno AND year(b.datadate) = d.year) WHERE book_to_market > 0
    QUALIFY row_number() OVER (PARTITION BY permno, datadate ORDER BY own DESC NULLS LAST, gvkey) = 1"""


def _bm(v):
    return m.book_to_market(_books(v).drop("industry"), _december(v))


def _bm_ia(v):
    names = v("names").filter("nameendt IS NULL").select("permno", (F.col("siccd") % 10).alias("industry"))
    return m.june_demeaned(_bm(v).join(names, "permno"), "book_to_market", "industry")


BM_IA_SQL = f"""SELECT permno, signal_yyyymm, book_to_market, book_to_market - avg(book_to_market) OVER (PARTITION BY industry, signal_yyyymm) AS book_to_market_ia FROM
    (SELECT x.permno, x.book_to_market, n.siccd % 10 AS industry, x.datadate, CAST(floor(x.k / 12) * 100 + x.k % 12 + 1 AS INTEGER) AS signal_yyyymm FROM
    (SELECT permno, datadate, book_to_market, unnest(range((year(datadate) + 1) * 12 + 5, (year(datadate) + 1) * 12 + 17)) AS k FROM ({BM_SQL})) x JOIN {{names}} n ON x.permno = n.permno AND n.nameendt IS NULL
    QUALIFY row_number() OVER (PARTITION BY x.permno, x.k ORDER BY x.datadate DESC) = 1)"""


def _op_profit(v):
    return f.operating_profitability(v("fundamentals_year"))


def _ms(v):
    a, q = f.annual_scores(v("fundamentals_year")), f.quarterly_features(v("fundamentals_quarter"))
    return f.mohanram_score(a, q)


def _ms_sql(members: str | None = None) -> str:
    return MS_SQL.replace(_scores_sql(), _scores_sql(members))


MS_SQL = f"""SELECT a.gvkey, a.datadate, a.fyear, m1 + m2 + m3 + m4 + m5 + m6 + m7 + m8 AS ms FROM ({_scores_sql()}) a LEFT JOIN
    (SELECT gvkey, fyearq, max_by(m7, fqtr) AS m7, max_by(m8, fqtr) AS m8 FROM ({_quarterly_sql()}) GROUP BY 1, 2) q ON a.gvkey = q.gvkey AND a.fyear = q.fyearq"""


def _orgcap(v):
    y = v("fundamentals_year").withColumn("cpi", F.lit(100.0) + 3 * (F.col("fyear") - 1995))
    return f.organisation_capital(y, "cpi")


ORGCAP_SQL = """SELECT gvkey, datadate, CASE WHEN n_row > 1 THEN stock / nullif((assets + lag_at) / 2, 0) END AS orgcap FROM (SELECT *,
    CASE WHEN flow IS NOT NULL THEN sum(CASE WHEN i = 0 THEN flow / 0.25e0 ELSE flow * pow(1 / 0.85e0, i) END) OVER u * pow(0.85e0, i) END AS stock FROM (SELECT *, count(flow) OVER u0 - 1 AS i,
    lag(assets) OVER o AS lag_at, row_number() OVER o AS n_row FROM (SELECT *, xsga / (100e0 + 3 * (fyear - 1995)) AS flow FROM {fundamentals_year})
    WINDOW o AS (PARTITION BY gvkey ORDER BY datadate), u0 AS (PARTITION BY gvkey ORDER BY datadate ROWS UNBOUNDED PRECEDING))
    WINDOW u AS (PARTITION BY gvkey ORDER BY datadate ROWS UNBOUNDED PRECEDING))"""


def _live_annual(v):
    a = f.annual_features(v("fundamentals_year"), ["bm", "agr", "acc"]).join(v("link").filter("linkprim = 'P'").select("gvkey", "permno").distinct(), "gvkey")
    return expand_rolling(a, spine=v("security_month").select("permno", "signal_yyyymm"), ties=("gvkey",))


LIVE_SQL = f"""SELECT permno, signal_yyyymm, gvkey, bm, agr, acc FROM (SELECT l.permno, a.gvkey, a.datadate, a.bm, a.agr, a.acc, unnest(range(year(datadate) * 12 + month(datadate) + 6, year(datadate) * 12 + month(datadate) + 19)) AS k
    FROM ({ANNUAL_SQL}) a JOIN (SELECT DISTINCT gvkey, permno FROM {{link}} WHERE linkprim = 'P') l ON a.gvkey = l.gvkey) x JOIN (SELECT permno AS p, m, signal_yyyymm FROM {{security_month}}) s ON x.permno = s.p AND x.k = s.m
    QUALIFY row_number() OVER (PARTITION BY x.permno, x.k ORDER BY x.datadate DESC, gvkey) = 1"""

_r = lambda names, d=5: " ".join(f"{n}~{d}" for n in names)
_ANNUAL_NAMES, _FLAGS = list(f.ANNUAL), {"divi", "divo", "rd", "convind", "securedind", "sin", "age", "ps"}
_thirds = [_ANNUAL_NAMES[i::3] for i in range(3)]

QUERIES = [
    *(Query(f"annual_features_{i + 1}", lambda v, n=n: f.annual_features(v("fundamentals_year"), n), "gvkey fyear " + " ".join(c if c in _FLAGS else f"{c}~5" for c in n), ANNUAL_SQL) for i, n in enumerate(_thirds)),
    Query("annual_industry_adjusted", lambda v: f.industry_adjusted(v("fundamentals_year")), "gvkey fyear sic2 " + _r([*f.ADJUSTED, "herf"]), _adjusted_sql()),
    Query("annual_scores", lambda v: f.annual_scores(v("fundamentals_year")), "gvkey fyear m1 m2 m3 m4 m5 m6", _scores_sql()),
    Query("mohanram_score", _ms, "gvkey fyear ms", MS_SQL),
    Query("organisation_capital", _orgcap, "gvkey datadate orgcap~5", ORGCAP_SQL),
    Query("quarterly_features", lambda v: f.quarterly_features(v("fundamentals_quarter")), "gvkey datadate " + _r([*f.QUARTERLY, "stdacc", "stdcf", "roavol", "sgrvol"]) + " nincr m7 m8", _quarterly_sql()),
    Query("monthly_features", lambda v: m.monthly_features(_industry_month(v)), "permno m industry " + _r("mvel1 mom1m mom6m mom12m mom36m mom60m chmom seas1a dolvol turn indmom".split()), MONTHLY_SQL),
    Query("daily_month_features", lambda v: m.daily_month_features(v("security_day")), "permno m ndays " + _r("maxret rvar_mean baspread std_dolvol std_turn zerotrade".split(), 8) + " ill~9", DAILY_SQL),
    Query("daily_on_next_row", lambda v: m.on_next_row(v("security_month").select("permno", "m"), m.daily_month_features(v("security_day")), ["maxret"]), "permno m maxret~6", f"SELECT s.permno, s.m, d.maxret FROM (SELECT permno, m, lag(m) OVER (PARTITION BY permno ORDER BY m) AS src FROM {{security_month}}) s LEFT JOIN ({DAILY_SQL}) d ON s.permno = d.permno AND s.src = d.m"),
    Query("weekly_compounding", _weekly, "permno week ret~9 mkt~9", WEEKLY_SQL),
    Query("rolling_beta", _betas, "permno m n_obs beta~5 betasq~5 idiovol~5", BETA_SQL),
    Query("price_delay", lambda v: _betas(v, 4).select("permno", "m", "n_obs", "pricedelay"), "permno m n_obs pricedelay~4", _delay_sql()),
    Query("residual_variance_one_factor", lambda v: regression.residual_variance(_excess_daily(v), "permno", "date", "y", ["mktrf"], "rvar_capm"), "permno m rvar_capm~7", _residual_sql(["mktrf"], "rvar_capm")),
    Query("residual_variance_three_factors", lambda v: regression.residual_variance(_excess_daily(v), "permno", "date", "y", ["mktrf", "smb", "hml"], "rvar_ff3"), "permno m rvar_ff3~7", _residual_sql(["mktrf", "smb", "hml"], "rvar_ff3")),
    Query("announcement_features", lambda v: m.announcement_features(_events(v), v("security_day")), "permno rdq ear~6 aeavol~5", EVENT_SQL),
    Query("forecast_revision", _revisions, "permno m re~6", REVISION_SQL),
    Query("book_to_market", _bm, "permno permco datadate book_to_market~7", BM_SQL),
    Query("june_industry_adjusted", _bm_ia, "permno signal_yyyymm book_to_market~7 book_to_market_ia~7", BM_IA_SQL),
    Query("operating_profitability", _op_profit, "gvkey datadate operating_profitability~5", "SELECT gvkey, datadate, (revt - coalesce(cogs, 0) - coalesce(xsga, 0) - coalesce(xint, 0)) / ceq AS operating_profitability FROM {fundamentals_year} WHERE ceq > 0 AND (cogs IS NOT NULL OR xsga IS NOT NULL OR xint IS NOT NULL) AND revt IS NOT NULL"),
    Query("annual_live_months", _live_annual, "permno signal_yyyymm gvkey bm~5 agr~5 acc~5", LIVE_SQL),
]
