"""Feature definitions as expressions over named columns; `x_1` is x one row of the entity before.

A definition is text, so a feature can be added by name: `register("annual", "my_ratio", ratio("ib", "sale"))`. All
definitions of a kind are evaluated by one projection over one pass of lags.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.crosssection import back, demean, group_stat
from ..operators.windows import lagged, perpetual_inventory, rolling_std, streak


def ratio(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0e0))"


def rise(x: str) -> str:
    return ratio(f"{x} - {x}_1", f"{x}_1")


def rise_of(now: str, before: str) -> str:
    return ratio(f"{now} - {before}", before)


def change(*names: str) -> str:
    """Sum of changes; a name with a minus counts against."""
    return " ".join(f"{'-' if n[0] == '-' else '+'} ({n.lstrip('-')} - {n.lstrip('-')}_1)" for n in names).removeprefix("+ ")


def yes(condition: str) -> str:
    return f"(CASE WHEN {condition} THEN 1 ELSE 0 END)"


MEAN_AT, MEAN_LT = "((assets + assets_1) / 2)", "((lt + lt_1) / 2)"
VALUE = "(prcc_f * csho)"
ACCRUAL = f"({change('act', '-che')} - ({change('lct', '-dlc', '-txp')} - dp))"
LIQUID, DUE = "coalesce(act, che + rect + invt)", "coalesce(lct, ap)"
LIQUID_1, DUE_1 = "coalesce(act_1, che_1 + rect_1 + invt_1)", "coalesce(lct_1, ap_1)"
NET = "(rect{0} + invt{0} + ppent{0} + aco{0} + intan{0} + ao{0} - ap{0} - lco{0} - lo{0})"
CAPX = "(CASE WHEN capx IS NULL AND n_row > 1 THEN ppent - ppent_1 ELSE capx END)"
CONVERTIBLE = "coalesce(dcvt, CASE WHEN pstk IS NULL THEN dcpstk WHEN dcpstk > pstk THEN dcpstk - pstk END)"
TAX_RATE = "(CASE WHEN fyear < 1979 THEN 0.48e0 WHEN fyear <= 1986 THEN 0.46e0 WHEN fyear = 1987 THEN 0.4e0 WHEN fyear <= 1992 THEN 0.34e0 ELSE 0.35e0 END)"
#: Alcohol and tobacco by one classification, gaming by the other, whose codes have trailing zeros or not: fixed values.
SIN = "(sic BETWEEN 2100 AND 2199 OR sic BETWEEN 2080 AND 2085 OR regexp_replace(trim(cast(naics AS varchar(20))), '[.]0+$', '') IN ('7132', '71312', '713210', '71329', '713290', '72112', '721120'))"
OPERATING = ratio("revt - cogs - coalesce(xsga, 0) - coalesce(xint, 0)", "ceq_1")

#: name: (expression, rows of history from which it counts)
ANNUAL: dict[str, tuple[str, int]] = {
    "bm": (ratio("ceq", VALUE), 1),
    "ep": (ratio("ib", VALUE), 1),
    "adm": (ratio("xad", VALUE), 1),
    "rdm": (ratio("xrd", VALUE), 1),
    "lev": (ratio("lt", VALUE), 1),
    "dy": (ratio("dvt", VALUE), 1),
    "sp": (ratio("sale", VALUE), 1),
    "rd_sale": (ratio("xrd", "sale"), 1),
    "agr": (ratio("assets", "assets_1") + " - 1", 2),
    "chcsho": (ratio("csho", "csho_1") + " - 1", 2),
    "lgr": (ratio("lt", "lt_1") + " - 1", 2),
    "sgr": (ratio("sale", "sale_1") + " - 1", 2),
    "gma": (ratio("revt - cogs", "assets_1"), 2),
    "acc": (f"CASE WHEN oancf IS NULL THEN {ratio(ACCRUAL, MEAN_AT)} ELSE {ratio('ib - oancf', MEAN_AT)} END", 2),
    "absacc": (f"abs(CASE WHEN oancf IS NULL THEN {ratio(ACCRUAL, MEAN_AT)} ELSE {ratio('ib - oancf', MEAN_AT)} END)", 2),
    "pctacc": (f"coalesce(ib - oancf, CASE WHEN oancf IS NULL THEN {ACCRUAL} END) / (CASE WHEN ib = 0 THEN 0.01e0 ELSE abs(ib) END)", 2),
    "cfp": (f"CASE WHEN oancf IS NULL THEN {ratio(f'ib - {ACCRUAL}', VALUE)} ELSE {ratio('oancf', VALUE)} END", 1),
    "hire": (f"coalesce({rise('emp')}, 0e0)", 2),
    "chpm": (f"{ratio('ib', 'sale')} - {ratio('ib_1', 'sale_1')}", 2),
    "ato": (ratio("sale", MEAN_AT), 2),
    "pm": (ratio("ib", "sale"), 1),
    "depr": (ratio("dp", "ppent"), 1),
    "pchdepr": (rise_of(ratio("dp", "ppent"), ratio("dp_1", "ppent_1")), 2),
    "cashdebt": (ratio("ib + dp", MEAN_LT), 2),
    "cashpr": (ratio(f"{VALUE} + dltt - assets", "che"), 1),
    "roe": (ratio("ib", "ceq_1"), 2),
    "operprof": (OPERATING, 1),
    "noa": (ratio("(assets - che) - (assets - dlc - dltt - pstk - ceq)", "assets_1"), 2),
    "alm": (ratio("che + 0.75e0 * (act - che) + 0.5e0 * (assets - act)", "assets"), 1),
    "grltnoa": (ratio(f"{NET.format('')} - {NET.format('_1')} - ({change('rect', 'invt', 'aco')} - ({change('ap', 'lco')}) - dp)", MEAN_AT), 2),
    "invest": (f"CASE WHEN ppegt IS NULL THEN {ratio(change('ppent', 'invt'), 'assets_1')} ELSE {ratio(change('ppegt', 'invt'), 'assets_1')} END", 2),
    "egr": (rise("ceq"), 2),
    "chinv": (ratio("invt - invt_1", MEAN_AT), 2),
    "pchcurrat": (rise_of(ratio("act", "lct"), ratio("act_1", "lct_1")), 2),
    "grcapx": (ratio(f"{CAPX} - capx_2", "capx_2"), 3),
    "pchcapx": (f"CASE WHEN capx_1 > 0 THEN {ratio(f'{CAPX} - capx_1', 'capx_1')} END", 2),
    "currat": (ratio(LIQUID, DUE), 1),
    "quick": (ratio(f"{LIQUID} - invt", DUE), 1),
    "pchquick": (rise_of(ratio(f"{LIQUID} - invt", DUE), ratio(f"{LIQUID_1} - invt_1", DUE_1)), 2),
    "pchsaleinv": (rise_of(ratio("sale", "invt"), ratio("sale_1", "invt_1")), 2),
    "salecash": (ratio("sale", "che"), 1),
    "saleinv": (ratio("sale", "invt"), 1),
    "salerec": (ratio("sale", "rect"), 1),
    "tang": (ratio("che + 0.715e0 * rect + 0.547e0 * invt + 0.535e0 * ppent", "assets"), 1),
    "roic": (ratio("ebit - nopi", "ceq + lt - che"), 1),
    "pchsale_pchinvt": (f"{rise('sale')} - {rise('invt')}", 2),
    "pchsale_pchrect": (f"{rise('sale')} - {rise('rect')}", 2),
    "pchsale_pchxsga": (f"{rise('sale')} - {rise('xsga')}", 2),
    "pchgm_pchsale": (f"{rise_of('(sale - cogs)', '(sale_1 - cogs_1)')} - {rise('sale')}", 2),
    "divi": (yes("dvt > 0 AND (dvt_1 IS NULL OR dvt_1 = 0)"), 2),
    "divo": (yes("(dvt IS NULL OR dvt = 0) AND dvt_1 > 0"), 2),
    "rd": (f"CASE WHEN {rise_of(ratio('xrd', 'assets'), ratio('xrd_1', 'assets_2'))} > 0.05e0 THEN 1 WHEN {rise_of(ratio('xrd', 'assets'), ratio('xrd_1', 'assets_2'))} IS NOT NULL THEN 0 END", 2),
    "convind": (yes(f"{CONVERTIBLE} <> 0 OR cshrc <> 0"), 1),
    "securedind": (yes("dm <> 0"), 1),
    "secured": (ratio("dm", "dltt"), 1),
    "tb_1": (f"CASE WHEN ib <= 0 AND (coalesce(txfo, 0) + coalesce(txfed, 0) > 0 OR txt > txdi) THEN 1e0 ELSE {ratio(f'coalesce(txfo + txfed, txt - txdi) / {TAX_RATE}', 'ib')} END", 1),
    "sin": (yes(SIN), 1),
    "realestate": (ratio("fatb + fatl", "coalesce(ppegt, ppent)"), 1),
    "obklg": (ratio("ob", MEAN_AT), 2),
    "chobklg": (ratio("ob - ob_1", MEAN_AT), 2),
    "chato": (f"{ratio('sale', MEAN_AT)} - {ratio('sale_1', '(assets_1 + assets_2) / 2')}", 3),
    "age": ("n_row", 1),
    "ps": (" + ".join(map(yes, ("ni > 0", "oancf > 0", f"{ratio('ni', 'assets')} > {ratio('ni_1', 'assets_1')}", "oancf > ni", f"{ratio('dltt', 'assets')} < {ratio('dltt_1', 'assets_1')}", f"{ratio('act', 'lct')} > {ratio('act_1', 'lct_1')}", f"{ratio('sale - cogs', 'sale')} > {ratio('sale_1 - cogs_1', 'sale_1')}", f"{ratio('sale', 'assets')} > {ratio('sale_1', 'assets_1')}", "coalesce(scstkc, 0) = 0"))), 2),
}

#: Signals against the industry's median of the year: name: expression.
SCORES = {
    "m1": ratio("ni", MEAN_AT),
    "m2": f"CASE WHEN oancf IS NULL THEN {ratio('ib + dp', MEAN_AT)} ELSE {ratio('oancf', MEAN_AT)} END",
    "m4": ratio("coalesce(xrd, 0)", MEAN_AT),
    "m5": ratio(CAPX, MEAN_AT),
    "m6": ratio("coalesce(xad, 0)", MEAN_AT),
}

#: Less their industry's mean of the year: name: (of, rows of history)
ADJUSTED = {"cfp_ia": ("cfp", 1), "chatoia": ("chato", 3), "chempia": ("hire", 2), "chpmia": ("chpm", 2), "pchcapx_ia": ("pchcapx", 2), "me_ia": (VALUE, 1), "tb": ("tb_1", 1)}

PREFERRED = "coalesce(pstkrq, pstkq)"
EQUITY = f"coalesce(seqq, ceqq + {PREFERRED}, CASE WHEN ceqq IS NULL OR {PREFERRED} IS NULL THEN atq - ltq END)"
EQUITY_1 = re.sub(r"\b(seqq|ceqq|pstkrq|pstkq|atq|ltq)\b", r"\1_1", EQUITY)
SALES = "(CASE WHEN saleq <= 0 THEN 0.01e0 ELSE saleq END)"
WORKING = f"({change('actq', '-cheq')} - ({change('lctq', '-dlcq')}))"


def _capital(i: int) -> str:
    a, b = ("" if i == 0 else f"_{i}"), f"_{i + 1}"
    return f"(CASE WHEN saleq <= 0 THEN (ppentq{a} - ppentq{b}) / 0.01e0 ELSE {ratio(f'ppentq{a} - ppentq{b}', f'saleq{a}')} END)"


QUARTERLY: dict[str, tuple[str, int]] = {
    "chtx": (ratio("txtq - txtq_4", "atq_4"), 5),
    "roaq": (ratio("ibq", "atq_1"), 2),
    "roeq": (ratio("ibq", EQUITY_1), 2),
    "rsup": (ratio("saleq - saleq_4", "mveq"), 1),
    "sue": (ratio("ibq - ibq_4", "mveq"), 5),
    "cash": (ratio("cheq", "atq"), 1),
    "sacc": (f"{WORKING} / nullif({SALES}, 0)", 1),
    "scf": (f"ibq / nullif({SALES}, 0) - {WORKING} / nullif({SALES}, 0)", 1),
    "cinvest": (f"{_capital(0)} - ({_capital(1)} + {_capital(2)} + {_capital(3)}) / 3", 5),
    "ni": ("CASE WHEN cshoq * ajexq > 0 AND cshoq_4 * ajexq_4 > 0 THEN ln(cshoq * ajexq) - ln(cshoq_4 * ajexq_4) END", 5),
    "rna": (ratio("oiadpq", f"(atq_4 - cheq_4) - (atq_4 - coalesce(dlcq_4, 0) - coalesce(dlttq_4, 0) - {re.sub(r'(pstkrq|pstkq)', r'\1_4', PREFERRED)} - ceqq_4)"), 5),
}

KINDS = {"annual": ANNUAL, "quarterly": QUARTERLY}


def register(kind: str, name: str, expression: str, min_history: int = 1) -> None:
    KINDS[kind][name] = (expression, min_history)


def lags_of(expressions: list[str], columns: list[str]) -> tuple[list[str], list[int]]:
    """Which columns are used how many rows back."""
    found = {(c, int(k)) for e in expressions for c, k in re.findall(r"\b([a-z]\w*?)_(\d+)\b", e) if c in columns}
    return sorted({c for c, _ in found}), sorted({k for _, k in found})


def evaluate(df: DataFrame, kind: str, key: str, date: str, names: list[str] | None = None, extra: dict | None = None, keep: list[str] | None = None) -> DataFrame:
    """keep, n_row and the features; a feature counts from its row of history on, NULL before."""
    chosen = {n: d for n, d in KINDS[kind].items() if names is None or n in names}
    texts = [e for e, _ in chosen.values()] + list((extra or {}).values())
    cols, ks = lags_of(texts, df.columns)
    n_row = F.row_number().over(Window.partitionBy(key).orderBy(date)).alias("n_row")
    wide = lagged(df, cols, ks, key, date).select("*", n_row) if ks else df.select("*", n_row)
    return wide.select(*(keep or [key, date]), "n_row", *((F.when(F.col("n_row") >= n, F.expr(e)) if n > 1 else F.expr(e)).alias(f"{name}") for name, (e, n) in chosen.items()), *(F.expr(e).alias(f"_{name}") for name, e in (extra or {}).items()))


def annual_features(fund: DataFrame, names: list[str] | None = None, key: str = "gvkey", date: str = "datadate", keep: tuple = ("fyear", "sic2")) -> DataFrame:
    return evaluate(fund, "annual", key, date, names, keep=[key, date, *keep])


def industry_adjusted(fund: DataFrame, by: tuple = ("sic2", "fyear"), key: str = "gvkey", date: str = "datadate", members: DataFrame | None = None) -> DataFrame:
    """ADJUSTED features and herf. Means are over all rows before young rows are left out; with members (key, date), such as linked reports, over these alone, while lags are over all rows."""
    raw = {n: (ANNUAL[of][0] if of in ANNUAL else of) for n, (of, _) in ADJUSTED.items()} | {"sales": "sale"}
    f = evaluate(fund, "annual", key, date, [], raw, [key, date, *by])
    if members is not None:
        f = f.join(members.select(key, date).distinct(), [key, date], "left_semi")
    less = demean(f, list(by), [f"_{n}" for n in ADJUSTED], out=list(ADJUSTED))
    share = group_stat(less, list(by), "_sales", "sum", "_total").withColumn("_share", F.pow(F.try_divide("_sales", "_total"), F.lit(2)))
    herf = group_stat(share, list(by), "_share", "sum", "herf")
    return herf.select(key, date, *by, *(F.when(F.col("n_row") >= h, F.col(n)).alias(n) for n, (_, h) in ADJUSTED.items()), "herf")


def annual_scores(fund: DataFrame, by: tuple = ("fyear", "sic2"), key: str = "gvkey", date: str = "datadate") -> DataFrame:
    """m1 to m6: 1 above the industry's median of the year; m3 compares cash flow and income."""
    f = evaluate(fund, "annual", key, date, [], {**SCORES, "m3": "oancf > ni"}, [key, date, *by])
    f = group_stat(f, list(by), [f"_{m}" for m in SCORES], "median", [f"_md_{m}" for m in SCORES])
    above = _above()
    return f.select(key, date, *by, *(above[m].alias(m) for m in sorted(above)))


def _above() -> dict:
    """m1 to m6 of rows with the scores, and their medians as _md_ columns."""
    return {m: F.coalesce(F.col(f"_{m}") > F.col(f"_md_{m}"), F.lit(False)).cast("int") for m in SCORES} | {"m3": F.coalesce("_m3", F.lit(False)).cast("int")}


def annual_panel(fund: DataFrame, names: list[str], scores: bool = False, members: DataFrame | None = None, by: tuple = ("fyear", "sic2"), key: str = "gvkey", date: str = "datadate") -> DataFrame:
    """(key, date, by, names) of features of ANNUAL, of ADJUSTED, herf and orgcap, and with scores m1 to m6, in one pass.

    One projection over one pass of lags gives all that names need; means, medians and sums of industries are one
    aggregation of it, over the members (key, date) where these are given, as in industry_adjusted(). orgcap needs fund's cpi.
    """
    adjusted, plain = [n for n in names if n in ADJUSTED], [n for n in names if n in ANNUAL]
    extra = {n: (ANNUAL[of][0] if of in ANNUAL else of) for n, (of, _) in ADJUSTED.items() if n in adjusted}
    extra |= {"sales": "sale"} if "herf" in names else {}
    extra |= {**SCORES, "m3": "oancf > ni"} if scores else {}
    if "orgcap" in names:
        fund = perpetual_inventory(fund.withColumn("flow", F.try_divide("xsga", "cpi")), "flow", key, date, "stock")
        extra["orgcap"] = ratio("stock", MEAN_AT)
    f = evaluate(fund, "annual", key, date, plain, extra, [key, date, *by])
    if members is not None:
        f = f.join(members.select(key, date).distinct(), [key, date], "left_semi")
    stats = [F.avg(f"_{n}").alias(f"_mean_{n}") for n in adjusted]
    stats += [F.try_divide(F.sum(F.col("_sales") * F.col("_sales")), F.sum("_sales") * F.sum("_sales")).alias("herf")] if "herf" in names else []
    stats += [F.median(f"_{m}").alias(f"_md_{m}") for m in SCORES] if scores else []
    at = back(f, f.groupBy(*by).agg(*stats), list(by)) if stats else f
    made = {n: F.when(F.col("n_row") >= ADJUSTED[n][1], F.col(f"_{n}") - F.col(f"_mean_{n}")) for n in adjusted} | ({"orgcap": F.when(F.col("n_row") > 1, F.col("_orgcap"))} if "orgcap" in names else {})
    above = _above() if scores else {}
    return at.select(key, date, *by, *(made.get(n, F.col(n)).alias(n) for n in names), *(above[m].alias(m) for m in sorted(above)))


def operating_profitability(fund: DataFrame, key: str = "gvkey", date: str = "datadate") -> DataFrame:
    """(key, date, operating_profitability): earnings before tax over the same year's equity, of reports with equity and one cost at least."""
    told = fund.filter("ceq > 0 AND (cogs IS NOT NULL OR xsga IS NOT NULL OR xint IS NOT NULL)")
    earned = F.col("revt") - sum((F.coalesce(c, F.lit(0.0)) for c in ("cogs", "xsga", "xint")), F.lit(0.0))
    return told.select(key, date, F.try_divide(earned, "ceq").alias("operating_profitability")).dropna(subset=["operating_profitability"])


def organisation_capital(fund: DataFrame, deflator, key: str = "gvkey", date: str = "datadate") -> DataFrame:
    """Stock of deflated overheads over mean assets; none for the first row."""
    return annual_panel(fund.withColumn("cpi", F.col(deflator)), ["orgcap"], key=key, date=date).select(key, date, "orgcap")


def quarterly_features(fund: DataFrame, key: str = "gvkey", date: str = "datadate", by: tuple = ("fyearq", "fqtr", "sic2"), keep: tuple = ("rdq",)) -> DataFrame:
    """QUARTERLY features, deviations over 8 and 16 quarters, the streak of rising income, and m7 and m8."""
    base = ["rsup", "sacc", "scf"]
    f = evaluate(fund, "quarterly", key, date, None, {"roaq": QUARTERLY["roaq"][0], "ibq": "ibq"}, [key, date, *keep, *by])
    f = f.select("*", *(F.when(F.col("n_row") >= n, rolling_std(c, w, key, date)).alias(o) for o, c, w, n in (("stdacc", "sacc", 16, 17), ("stdcf", "scf", 16, 17), ("roavol", "_roaq", 8, 8), ("sgrvol", "rsup", 8, 8))), streak("_ibq", key, date).alias("nincr"))
    f = group_stat(f, list(by), ["roavol", "sgrvol"], "median", ["_md7", "_md8"])
    below = lambda v, m: F.when(F.col(v).isNull() & F.col(m).isNotNull(), 1).otherwise(F.coalesce(F.col(v) < F.col(m), F.lit(False)).cast("int"))
    return f.select(key, date, *keep, *by, *QUARTERLY, "stdacc", "stdcf", "roavol", "sgrvol", "nincr", below("roavol", "_md7").alias("m7"), below("sgrvol", "_md8").alias("m8")) if base else f


def mohanram_score(annual: DataFrame, quarterly: DataFrame, key: str = "gvkey", date: str = "datadate", keep: list[str] = ()) -> DataFrame:
    """ms: m1 to m6 and, from a fiscal year's last quarter, m7 and m8; NULL if any is missing."""
    last = quarterly.groupBy(key, F.col("fyearq").alias("fyear")).agg(F.max_by("m7", "fqtr").alias("m7"), F.max_by("m8", "fqtr").alias("m8"))
    total = sum((F.col(f"m{i}") for i in range(2, 9)), F.col("m1"))
    return annual.join(last, [key, "fyear"], "left").select(key, date, "fyear", *keep, total.alias("ms"))
