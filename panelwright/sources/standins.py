"""Entity histories as views over the star-schema tables: suppliers stand for securities, customers for companies.

Each view is a SELECT that names other views and tables in braces; it runs as it stands on Spark and, without the
braces, on any SQL engine. Means are moved a little off the ties of their rounding, where engines would part.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _items(names: str, start: int, form: str) -> str:
    return ",\n".join(form.format(name=n, k=start + i) for i, n in enumerate(names.split()))


_FULL = "base * (0.2e0 + ((gvkey * {k} + t) % 17) * 0.05e0) AS {name}"
_GAPS = "CASE WHEN (gvkey * 7 + t * 3 + {k}) % 11 = 0 THEN NULL ELSE base * (0.1e0 + ((gvkey * {k} + t) % 19) * 0.04e0) END AS {name}"
_ZEROS = "CASE WHEN (gvkey * 5 + t + {k}) % 9 = 0 THEN NULL WHEN (gvkey + t + {k}) % 3 = 0 THEN 0e0 ELSE base * (0.05e0 + ((gvkey * {k} + t) % 13) * 0.03e0) END AS {name}"
_SIGNED = "CASE WHEN (gvkey * 3 + t + {k}) % 13 = 0 THEN NULL ELSE base * (((gvkey * {k} + t) % 15) * 0.04e0 - 0.15e0) END AS {name}"

VIEWS = {
    "security_day": """SELECT l_suppkey AS permno, cast(l_shipdate AS date) AS date, round(avg(l_discount) - avg(l_tax) + 3e-12, 10) AS ret,
        sum(l_extendedprice) / sum(l_quantity) AS prc, sum(l_quantity) AS vol, min(l_extendedprice / l_quantity) AS bidlo,
        max(l_extendedprice / l_quantity) AS askhi, cast(1000 + l_suppkey % 7 * 100 AS double) AS shrout
        FROM {lineitem} GROUP BY l_suppkey, cast(l_shipdate AS date)""",
    "security_month": """SELECT permno, permno % 50 AS permco, last_day(date) AS date, year(date) * 12 + month(date) - 1 AS m,
        year(date) * 100 + month(date) AS signal_yyyymm,
        CASE WHEN month(date) = 12 THEN (year(date) + 1) * 100 + 1 ELSE year(date) * 100 + month(date) + 1 END AS target_yyyymm,
        round(avg(ret) + 3e-12, 10) AS ret, round(avg(prc) + 3e-8, 6) AS prc, sum(vol) AS vol, max(shrout) AS shrout
        FROM {security_day} GROUP BY permno, last_day(date), year(date), month(date)""",
    "names": """SELECT s_suppkey AS permno, cast('1990-01-01' AS date) AS namedt, cast('1998-06-30' AS date) AS nameendt,
        n_regionkey % 4 + 1 AS exchcd, 10 + s_suppkey % 3 AS shrcd, 100 * (n_nationkey + 1) + s_suppkey % 100 AS siccd,
        concat('C', lpad(cast(s_suppkey AS varchar(9)), 5, '0'), '10') AS ncusip FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
        UNION ALL SELECT s_suppkey, cast('1998-07-01' AS date), cast(NULL AS date), n_regionkey % 4 + 1, 10 + s_suppkey % 2,
        100 * (n_nationkey + 1) + (s_suppkey + 7) % 100, concat('C', lpad(cast(CASE s_suppkey % 4 WHEN 0 THEN s_suppkey + 50000 WHEN 1 THEN s_suppkey - 1 ELSE s_suppkey END AS varchar(9)), 5, '0'), '10')
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "delist": """SELECT permno, m, CASE WHEN permno % 2 = 0 THEN NULL ELSE -0.1e0 END AS dlret,
        CASE m % 6 WHEN 0 THEN 560 WHEN 1 THEN 505 WHEN 2 THEN 510 WHEN 3 THEN 501 WHEN 4 THEN 500 ELSE 200 END AS dlstcd
        FROM {security_month} WHERE (permno + m) % 17 = 0""",
    "stock_day": """SELECT permno, date, CASE WHEN (permno + day(date)) % 19 = 0 THEN NULL WHEN permno % 11 = 3 AND month(date) = 5 AND day(date) = 11 THEN -1e0 ELSE ret END AS ret FROM {security_day}""",
    "delist_day": """SELECT permno, date, CASE WHEN permno % 5 = 0 THEN NULL ELSE -0.3e0 END AS dlret FROM {security_day} WHERE (permno * 3 + day(date)) % 23 = 0""",
    "factors_day": """SELECT cast(l_shipdate AS date) AS date, avg(l_discount) - 0.04e0 AS mktrf, avg(l_tax) - 0.03e0 AS smb,
        avg(l_quantity) / 1000 - 0.025e0 AS hml, 0.0001e0 AS rf FROM {lineitem}
        WHERE year(l_shipdate) * 100 + month(l_shipdate) NOT IN (199705, 199706) AND day(l_shipdate) <> 17 GROUP BY cast(l_shipdate AS date)""",
    "factors_month": """SELECT year(date) * 12 + month(date) - 1 AS m, avg(mktrf) + 3e0 AS rf FROM {factors_day} GROUP BY year(date) * 12 + month(date) - 1""",
    "macro": """SELECT year(date) * 100 + month(date) AS yyyymm, avg(prc) AS index, avg(bidlo) / 20 AS d12, avg(askhi) / 18 AS e12,
        avg(ret) + 0.5e0 AS bm, avg(ret) AS tbl, avg(ret) * 2 AS aaa, avg(ret) * 3 + 0.01e0 AS baa, avg(ret) + 0.02e0 AS lty,
        avg(vol) / 1000 AS ntis, avg(ret * ret) AS svar FROM {security_day} GROUP BY year(date) * 100 + month(date)""",
    "company_year": """SELECT o_custkey AS gvkey, year(o_orderdate) AS t, sum(o_totalprice) / 100000 AS base, count(*) AS orders
        FROM {orders} GROUP BY o_custkey, year(o_orderdate)""",
    "fundamentals_year": f"""SELECT gvkey, make_date(cast(t AS int), 12, 31) AS datadate, cast(t AS int) AS fyear,
        CASE WHEN gvkey % 29 = 0 THEN NULL ELSE 100 * (c_nationkey + 1) + gvkey % 50 END AS sic,
        CASE WHEN gvkey % 29 = 0 THEN NULL WHEN c_nationkey < 9 THEN concat('0', cast(c_nationkey + 1 AS varchar(9))) ELSE cast(c_nationkey + 1 AS varchar(9)) END AS sic2,
        CASE gvkey % 9 WHEN 0 THEN 713210 WHEN 1 THEN 7132 WHEN 2 THEN NULL ELSE 334111 END AS naics,
        {_items("assets prcc_f csho sale revt lt", 3, _FULL)},
        {_items("act che lct dlc txp dp ceq emp ppent ppegt xsga rect invt aco intan ao ap lco lo dltt ebit nopi cogs xad fatb fatl", 11, _GAPS)},
        {_items("dvt xrd xint pstk dcvt dcpstk cshrc dm ob scstkc txfo txfed", 41, _ZEROS)},
        {_items("ib ni oancf capx txt txdi", 61, _SIGNED)},
        {_items("seq pstkrv pstkl", 71, _GAPS)}, {_items("txditc", 81, _ZEROS)}
        FROM {{company_year}} JOIN {{customer}} ON gvkey = c_custkey""",
    "company": """SELECT c_custkey AS gvkey, 100 * (c_nationkey + 1) + c_custkey % 37 AS sic FROM {customer} WHERE c_custkey % 6 <> 0""",
    "company_quarter": """SELECT o_custkey AS gvkey, year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS t, sum(o_totalprice) / 100000 AS base
        FROM {orders} GROUP BY o_custkey, year(o_orderdate) * 4 + quarter(o_orderdate) - 1""",
    "fundamentals_quarter": f"""SELECT gvkey, last_day(make_date(cast(floor(t / 4e0) AS int), cast(t % 4 * 3 + 3 AS int), 1)) AS datadate,
        CASE WHEN (gvkey + t) % 10 = 0 THEN NULL ELSE last_day(make_date(cast(floor((t + 1) / 4e0) AS int), cast((t + 1) % 4 * 3 + 1 AS int), 1)) END AS rdq,
        cast(floor(t / 4e0) AS int) AS fyearq, cast(t % 4 + 1 AS int) AS fqtr, c_nationkey % 10 AS sic2,
        {_items("atq mveq cshoq", 5, _FULL)},
        {_items("saleq cheq actq lctq dlcq ppentq txtq seqq ceqq pstkq pstkrq ltq dlttq ajexq", 13, _GAPS)},
        {_items("ibq oiadpq", 33, _SIGNED)}
        FROM {{company_quarter}} JOIN {{customer}} ON gvkey = c_custkey""",
    "link": """SELECT c_custkey AS gvkey, c_custkey % (SELECT count(*) FROM {supplier}) AS permno, c_custkey % 50 AS permco,
        CASE c_mktsegment WHEN 'BUILDING' THEN 'LU' WHEN 'MACHINERY' THEN 'LC' WHEN 'HOUSEHOLD' THEN 'LS' ELSE 'NR' END AS linktype,
        CASE c_custkey % 3 WHEN 0 THEN 'P' WHEN 1 THEN 'C' ELSE 'J' END AS linkprim,
        CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE cast('1996-01-01' AS date) END AS linkdt,
        CASE WHEN c_custkey % 5 = 0 THEN cast('1999-12-31' AS date) ELSE NULL END AS linkenddt FROM {customer}
        UNION ALL SELECT c_custkey, (c_custkey + 1) % (SELECT count(*) FROM {supplier}), c_custkey % 50, 'LC', 'C', cast('1997-01-01' AS date), cast(NULL AS date)
        FROM {customer} WHERE c_custkey % 6 = 0""",
    "forecasts": """SELECT o_custkey % (SELECT count(*) FROM {supplier}) AS permno, last_day(cast(o_orderdate AS date)) AS statpers,
        make_date(cast(year(o_orderdate) AS int), 12, 31) AS fpedats, avg(o_totalprice) / 10000 AS meanest
        FROM {orders} GROUP BY o_custkey % (SELECT count(*) FROM {supplier}), last_day(cast(o_orderdate AS date)), make_date(cast(year(o_orderdate) AS int), 12, 31)""",
    "estimates": """SELECT concat('T', cast(permno AS varchar(9))) AS ticker, concat('C', lpad(cast(permno AS varchar(9)), 5, '0'), '10') AS cusip, fpedats, statpers, meanest FROM {forecasts}
        UNION ALL SELECT concat('T', cast(permno AS varchar(9))), concat('C', lpad(cast(permno AS varchar(9)), 5, '0'), '10'), make_date(cast(year(fpedats) + 1 AS int), 12, 31), statpers, meanest * 1.1e0
        FROM {forecasts} WHERE month(statpers) = 12 AND permno % 3 = 0""",
    "panel_a": """SELECT s.permno, s.m, s.signal_yyyymm, s.target_yyyymm, n.siccd % 10 AS industry,
        CASE WHEN (s.permno + s.m) % 23 = 0 THEN NULL ELSE s.ret END AS a, s.prc / 1000 AS b, s.vol / 100 AS c
        FROM {security_month} s JOIN {names} n ON s.permno = n.permno AND n.nameendt IS NULL""",
    "panel_b": """SELECT permno, m, signal_yyyymm, target_yyyymm, industry,
        CASE WHEN (permno * 3 + m) % 31 = 0 THEN NULL WHEN (permno + m) % 10 = 0 THEN a + 0.01e0 ELSE a END AS a2,
        b * 100 + CASE WHEN permno % 7 = 0 THEN 3e0 ELSE 0e0 END AS b2, CASE WHEN m % 2 = 0 THEN c ELSE c + ((permno * 5 + m) % 11) * 0.1e0 END AS c2
        FROM {panel_a} WHERE (permno + 2 * m) % 17 <> 0""",
    "adjusted": """SELECT permno, m, industry, b AS base, b - avg(b) OVER (PARTITION BY industry, m) + CASE WHEN (permno + m) % 9 = 0 THEN 0.5e0 ELSE 0e0 END AS adj,
        round(avg(b) OVER (PARTITION BY industry, m), 4) - CASE WHEN (permno + m) % 9 = 0 THEN 0.5e0 ELSE 0e0 END AS implied FROM {panel_a}""",
}


def needed(sql: str) -> list[str]:
    """Views that a statement uses, each after those it uses itself."""
    out: list[str] = []
    for name in re.findall(r"\{(\w+)\}", sql):
        if name in VIEWS and name not in out:
            out += [n for n in [*needed(VIEWS[name]), name] if n not in out]
    return out


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parts = {n: view(spark, sf_dir, n) for n in set(re.findall(r"\{(\w+)\}", VIEWS[name]))}
    return spark.sql(VIEWS[name], **parts)


def statement(sql: str) -> str:
    """One statement for another engine: the views as common table expressions."""
    plain = lambda s: re.sub(r"\{(\w+)\}", r"\1", s)
    ctes = [f"{n} AS ({plain(VIEWS[n])})" for n in needed(sql)]
    if sql.startswith("WITH "):  # its own follow the views
        return f"WITH {', '.join([*ctes, plain(sql[5:])])}"
    return (f"WITH {', '.join(ctes)} " if ctes else "") + plain(sql)
