"""Queries of whole panels by profile, and their SQL, which makes each feature from the statements of its own query."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import industry
from ..operators.crosssection import BOTH_TAILS, UPPER_TAIL
from . import features as f
from . import feature_queries as q
from . import planner, profiles
from .operator_queries import _rank_sql
from .shapes import Query

#: Imputation by a scheme that the library has; ranks of eight decimals, as two engines add up in other orders.
DIGITS = 8
RULES = {k: replace(p, scheme=38, digits=DIGITS) for k, p in profiles.PROFILES.items()}
INTEGERS = {"divi", "divo", "rd", "convind", "securedind", "sin", "age", "ps", "nincr", "ms", "herf"} - {"herf"}
LOOSE = {"pricedelay": 3, "ill": 8, "beta": 4, "betasq": 4}
TEXT = ("sic2",)


def _names(name: str) -> list[str]:
    return profiles.PUBLISHED if profiles.PROFILES[name].published else planner.every_name()


def _tables(v):
    """The stand-ins, with a deflator."""
    return lambda name: v(name).withColumn("cpi", F.lit(100.0) + 3 * (F.col("fyear") - 1995)) if name == "fundamentals_year" else v(name)


_LINK = """SELECT y.gvkey, y.datadate, l.permno, l.permco FROM {{{table}}} y JOIN {{link}} l ON y.gvkey = l.gvkey AND l.permno IS NOT NULL AND {rule} AND (l.linkdt IS NULL OR y.datadate >= l.linkdt) AND y.datadate <= coalesce(l.linkenddt, DATE '9999-12-31')
    QUALIFY row_number() OVER (PARTITION BY y.gvkey, y.datadate ORDER BY CASE l.linkprim WHEN 'P' THEN 0 WHEN 'C' THEN 1 ELSE 2 END, l.permno, l.linkdt NULLS FIRST) = 1"""


def _rolled(columns: str, source: str) -> str:
    return f"SELECT permno, k, {columns} FROM (SELECT *, unnest(range(year(datadate) * 12 + month(datadate) + 6, year(datadate) * 12 + month(datadate) + 19)) AS k FROM ({source})) QUALIFY row_number() OVER (PARTITION BY permno, k ORDER BY datadate DESC, gvkey) = 1"


def _in_window(names: list[str], source: str) -> str:
    latest = ", ".join(f"(max(struct_pack(d := datadate, v := {c})) FILTER (WHERE {c} IS NOT NULL)).v AS {c}" for c in names)
    return f"SELECT permno, k, {latest} FROM (SELECT *, unnest(range(year(datadate) * 12 + month(datadate) + 5, year(datadate) * 12 + month(datadate) + 10)) AS k FROM ({source})) GROUP BY permno, k"


def _panel_sql(rules: profiles.Profile, names: list[str]) -> str:
    own = {n: planner.own_name(n) for n in names}
    of = {k: [n for n in fam.names if n in own.values()] for k, fam in planner.FAMILIES.items()}
    of["events"] = ["ear", "aeavol"]
    types = [f"l.linktype LIKE '{t[:-1]}%'" if t.endswith("*") else f"l.linktype = '{t}'" for t in rules.links]
    rule = f"({' OR '.join(types)})" + ("" if rules.primary == "ALL" else f" AND l.linkprim IN {tuple(rules.primary)}")
    shares = "" if rules.shares == "ALL" else f" AND n.shrcd IN {tuple(rules.shares)}"
    members = "SELECT gvkey, datadate FROM la" if rules.after else None
    books = f"SELECT y.gvkey, l.permno, l.permco, y.datadate, y.seq + coalesce(y.txditc, 0) - coalesce(y.pstkrv, y.pstkl, y.pstk, 0) AS book, y.sic FROM {{fundamentals_year}} y JOIN la l USING (gvkey, datadate)"
    earned = "SELECT gvkey, datadate, (revt - coalesce(cogs, 0) - coalesce(xsga, 0) - coalesce(xint, 0)) / ceq AS operating_profitability FROM {fundamentals_year} WHERE ceq > 0 AND (cogs IS NOT NULL OR xsga IS NOT NULL OR xint IS NOT NULL) AND revt IS NOT NULL"
    june = "unnest(range((year(datadate) + 1) * 12 + 5, (year(datadate) + 1) * 12 + 17)) AS k"
    parts = {
        "la": _LINK.format(table="fundamentals_year", rule=rule),
        "lq": _LINK.format(table="fundamentals_quarter", rule=rule),
        "live": _rolled("sic, sic2", "SELECT l.permno, y.gvkey, y.datadate, y.sic, y.sic2 FROM {fundamentals_year} y JOIN la l USING (gvkey, datadate)"),
        "u": f"SELECT s.*, c.sic, c.sic2 FROM {{security_month}} s JOIN {{names}} n ON s.permno = n.permno AND s.date BETWEEN n.namedt AND coalesce(n.nameendt, DATE '9999-12-31') LEFT JOIN live c ON c.permno = s.permno AND c.k = s.m WHERE s.date >= DATE '{rules.start}' AND n.exchcd IN {tuple(rules.exchanges)}{shares}",
        "annual": _rolled(", ".join(of["annual"]), f"SELECT l.permno, a.gvkey, a.datadate, {', '.join(of['annual'])} FROM ({q.ANNUAL_SQL}) a JOIN (SELECT gvkey, datadate, {', '.join([*f.ADJUSTED, 'herf'])} FROM ({q._adjusted_sql(members)})) i USING (gvkey, datadate) JOIN (SELECT gvkey, datadate, orgcap FROM ({q.ORGCAP_SQL})) o USING (gvkey, datadate) JOIN (SELECT gvkey, datadate, ms FROM ({q._ms_sql(members)})) s USING (gvkey, datadate) JOIN la l USING (gvkey, datadate)"),
        "qf": f"SELECT x.*, l.permno FROM ({q._quarterly_sql()}) x JOIN lq l USING (gvkey, datadate) WHERE rdq IS NOT NULL",
        "quarterly": _in_window(of["quarterly"], "SELECT * FROM qf"),
        "events": _in_window(of["events"], f"SELECT t.permno, t.datadate, e.ear, e.aeavol FROM (SELECT DISTINCT permno, datadate, rdq FROM qf) t JOIN ({q._EVENT.replace(' ev e', q._EVENTS.replace(q._EVENTS[q._EVENTS.index('(SELECT DISTINCT') : q._EVENTS.rindex(') e')], '(SELECT DISTINCT permno, rdq FROM qf)'))}) e ON e.permno = t.permno AND e.rdq = t.rdq"),
        "monthly": f"SELECT permno, m AS k, {', '.join('CASE WHEN industry IS NOT NULL THEN indmom END AS indmom' if n == 'indmom' else n for n in of['monthly'])} FROM ({q._MONTHLY.replace('SOURCE', 'SELECT *, sic2 AS industry FROM u WHERE ret IS NOT NULL')})",
        "daily": f"SELECT x.permno, x.m AS k, {', '.join(of['daily'])} FROM (SELECT permno, m, lag(m) OVER (PARTITION BY permno ORDER BY m) AS src FROM u) x JOIN ({q.DAILY_SQL}) d ON d.permno = x.permno AND d.m = x.src",
        "regression": f"SELECT permno, m AS k, beta, betasq, idiovol, pricedelay FROM ({q.BETA_SQL.replace('stock_day', 'security_day')}) b LEFT JOIN (SELECT permno, m, pricedelay FROM ({q._delay_sql().replace('stock_day', 'security_day')})) d USING (permno, m)",
        "december": "SELECT permno, permco, year(date) AS year, abs(prc) * shrout AS value FROM u WHERE m % 12 = 11",
        "bm": f"SELECT permno, datadate, sic, book_to_market FROM (SELECT b.*, b.book * 1000 / nullif(f.v, 0) AS book_to_market, d.value AS own FROM (SELECT * FROM ({books}) WHERE book > 0 QUALIFY row_number() OVER (PARTITION BY gvkey, year(datadate) ORDER BY datadate DESC) = 1) b JOIN (SELECT permco, year, sum(value) AS v FROM december GROUP BY 1, 2) f ON b.permco = f.permco AND year(b.datadate) = f.year LEFT JOIN december d ON b.permno = d.permno AND year(b.datadate) = d.year) WHERE book_to_market > 0 QUALIFY row_number() OVER (PARTITION BY permno, datadate ORDER BY own DESC NULLS LAST, gvkey) = 1",
        "june": f"SELECT permno, k, book_to_market, book_to_market - avg(book_to_market) OVER (PARTITION BY floor(sic / 100), k) AS bm_ia FROM (SELECT *, {june} FROM bm) QUALIFY row_number() OVER (PARTITION BY permno, k ORDER BY datadate DESC) = 1",
        "profit": f"SELECT permno, k, operating_profitability FROM (SELECT l.permno, e.gvkey, e.datadate, operating_profitability, {june.replace('datadate', 'e.datadate')} FROM ({earned}) e JOIN la l USING (gvkey, datadate)) QUALIFY row_number() OVER (PARTITION BY permno, k ORDER BY datadate DESC, gvkey) = 1",
    }
    # Means of June are over the rows that are left: the pick comes first.
    parts["june"] = f"SELECT *, book_to_market - avg(book_to_market) OVER (PARTITION BY floor(sic / 100), k) AS bm_ia FROM (SELECT permno, k, sic, book_to_market FROM (SELECT *, {june} FROM bm) QUALIFY row_number() OVER (PARTITION BY permno, k ORDER BY datadate DESC) = 1)"
    at = {n: f"{k}.{n}" for k, ns in of.items() for n in ns} | {"sic2": "u.sic2", "operating_profitability": "profit.operating_profitability"}
    joined = " ".join(f"LEFT JOIN {k} ON {k}.permno = u.permno AND {k}.k = u.m" for k in ("annual", "quarterly", "events", "monthly", "daily", "regression", "june", "profit"))
    return f"WITH {', '.join(f'{k} AS ({s})' for k, s in parts.items())}, panel AS (SELECT u.permno, u.signal_yyyymm, u.target_yyyymm, u.sic, {', '.join(f'{at[o]} AS {n}' for n, o in own.items())} FROM u {joined})"


def _drawn(names: list[str], kinds: tuple[list[str], list[str]], source: str, ids: str) -> str:
    """source with the first kind of names drawn in from above, the second from both sides, by month."""
    upper, both = ([n for n in names if n.lower() in {x.lower() for x in k}] for k in kinds)
    q_ = ", ".join([f"quantile_cont({c}, 0.01) AS lo_{c}" for c in both] + [f"quantile_cont({c}, 0.99) AS hi_{c}" for c in (*upper, *both)])
    drawn = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, lo_{c}), hi_{c}) END AS {c}" if c in both else f"CASE WHEN {c} IS NOT NULL THEN least({c}, hi_{c}) END AS {c}" if c in upper else c for c in names)
    return f"SELECT {ids}, {drawn} FROM {source} JOIN (SELECT signal_yyyymm, {q_} FROM {source} GROUP BY 1) USING (signal_yyyymm)"


def _sql(name: str) -> str:
    rules, names = RULES[name], _names(name)
    ids, sql = "permno, signal_yyyymm, target_yyyymm, sic", _panel_sql(RULES[name], names)
    if rules.winsorized:
        return f"{sql} {_drawn(names, (UPPER_TAIL, BOTH_TAILS), 'panel', ids)}"
    if not rules.ranked:
        return f"{sql} SELECT * FROM panel"
    ranges = ", ".join(f"({n}, {low}, {high}, {i})" for i, (n, _, low, high) in enumerate(industry.ranges(rules.scheme)))
    numbers = [n for n in names if n not in TEXT]
    by = lambda *k: f"OVER (PARTITION BY {', '.join(('signal_yyyymm', *k))})"
    shown = ", ".join(f"round({n} + {0.37 * 10.0 ** (-DIGITS - 3)!r}, {DIGITS}) AS {n}" for n in numbers)
    coded = f"coded AS (SELECT {ids}, sic2, {shown}, (SELECT number FROM (VALUES {ranges}) r(number, low, high, ord) WHERE panel.sic BETWEEN low AND high ORDER BY ord DESC LIMIT 1) AS industry FROM panel WHERE target_yyyymm >= {rules.ranked_from})"
    drawn = f"drawn AS ({_drawn(numbers, ([], numbers), 'coded', f'{ids}, industry, sic2')})"
    filled = f"filled AS (SELECT {ids}, sic2, {', '.join(f'coalesce({c}, median({c}) {by('industry')}, median({c}) {by()}) AS {c}' for c in numbers)} FROM drawn)"
    return f"{sql}, {coded}, {drawn}, {filled} SELECT {ids}, sic2, {', '.join(f'{_rank_sql(c, 'signal_yyyymm')} AS {c}' for c in numbers)} FROM filled"


def _columns(name: str) -> str:
    ranked = RULES[name].ranked
    shown = lambda n: n if n in TEXT else f"{n}~{5 if ranked else LOOSE.get(planner.own_name(n), 5)}"
    return "permno signal_yyyymm target_yyyymm sic " + " ".join(map(shown, _names(name)))


QUERIES = [Query(f"profile_{name}", lambda v, p=RULES[name], n=name: profiles.build(p, _tables(v), _names(n)), _columns(name), _sql(name)) for name in RULES]
