"""Features from prices: monthly, from daily rows, around announcements, from regressions and forecasts, and at June."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import add_business_days, month_index
from ..operators.crosssection import demean, group_stat
from ..operators.links import interval_join, pick_one
from ..operators.timing import event_window, expand_fixed
from ..operators.windows import compound_lags


def monthly_features(df: DataFrame, key: str = "permno", order: str = "m", industry: str = "industry") -> DataFrame:
    """Size, momentum over past rows, volume and turnover, and the industry's mean momentum; rows with a return only."""
    use = df.dropna(subset=["ret"])
    w = Window.partitionBy(key).orderBy(order)
    at, n = (lambda c, k: F.lag(c, k).over(w)), F.row_number().over(w)
    log = lambda x: F.when(x > 0, F.ln(x))
    product = lambda a, b: compound_lags("ret", a, b, key, order)
    size = F.abs("prc") * F.col("shrout")
    used = use.withColumn("_size", size)
    f = used.select(
        "*",
        log(at("_size", 1)).alias("mvel1"),
        at("ret", 1).alias("mom1m"),
        F.when(n >= 7, product(2, 6)).alias("mom6m"),
        F.when(n >= 13, product(2, 12)).alias("mom12m"),
        F.when(n >= 37, product(13, 36)).alias("mom36m"),
        F.when(n >= 61, product(13, 60)).alias("mom60m"),
        F.when(n >= 13, product(1, 6) - product(7, 12)).alias("chmom"),
        F.when(n >= 12, at("ret", 11)).alias("seas1a"),
        log(at("vol", 2) * F.abs(at("prc", 2))).alias("dolvol"),
        F.try_divide(F.avg("vol").over(w.rowsBetween(-3, -1)), "shrout").alias("turn"),
    ).drop("_size")
    return group_stat(f, [industry, order], "mom12m", "mean", "indmom")


def lagged_size(df: DataFrame, fill: bool = True, key: str = "permno", date: str = "date") -> DataFrame:
    """(key, source_date, date, lagged_market_equity, mvel1): log of the value at the entity's row before.

    With fill a missing price or number of shares is the entity's last one. Rows without a positive value do not count as rows.
    """
    w = Window.partitionBy(key).orderBy(date)
    last = lambda c: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) if fill else F.col(c)
    value = df.withColumn("_me", F.abs(last("prc")) * last("shrout")).filter("_me > 0")
    before = value.withColumns({"lagged_market_equity": F.lag("_me").over(w), "source_date": F.lag(date).over(w)}).dropna(subset=["lagged_market_equity"])
    return before.select(key, "source_date", date, "lagged_market_equity", F.ln("lagged_market_equity").alias("mvel1"))


def daily_month_features(daily: DataFrame, key: str = "permno", date: str = "date") -> DataFrame:
    """Each month's largest return, deviations of return, dollar volume and turnover, spread, illiquidity, zero trading."""
    turn, dollars = F.try_divide("vol", "shrout"), F.abs(F.col("prc") * F.col("vol"))
    mid = (F.col("askhi") + F.col("bidlo")) / 2
    g = daily.groupBy(key, month_index(F.col(date)).alias("m")).agg(
        F.max("ret").alias("maxret"),
        F.stddev_samp("ret").alias("rvar_mean"),
        F.avg(F.try_divide(F.col("askhi") - F.col("bidlo"), mid)).alias("baspread"),
        F.stddev_samp(F.when(dollars > 0, F.ln(dollars))).alias("std_dolvol"),
        F.stddev_samp(turn).alias("std_turn"),
        F.avg(F.try_divide(F.abs("ret"), dollars)).alias("ill"),
        F.sum((F.col("vol") == 0).cast("double")).alias("_zero"),
        F.count("*").alias("ndays"),
        F.sum(turn).alias("_turn"),
    )
    zero = (F.col("_zero") + F.try_divide(F.lit(1.0), "_turn") / 480000) * 21 / F.col("ndays")
    return g.withColumn("zerotrade", zero).drop("_zero", "_turn")


def on_next_row(months: DataFrame, sources: DataFrame, cols: list[str], key: str = "permno", m: str = "m") -> DataFrame:
    """A month's statistics on the entity's next month row."""
    w = Window.partitionBy(key).orderBy(m)
    led = months.withColumn("_from", F.lag(m).over(w))
    return led.join(sources.select(F.col(key), F.col(m).alias("_from"), *cols), [key, "_from"], "left").drop("_from")


def announcement_features(events: DataFrame, daily: DataFrame, key: str = "permno", event: str = "rdq", date: str = "date") -> DataFrame:
    """(key, event, ear, aeavol): summed return around an event; mean volume then against the weeks before. Days meet their events once for both."""
    inside = lambda lo, hi: F.col(date).between(add_business_days(event, lo), add_business_days(event, hi))
    near, before = inside(-1, 1), inside(-30, -10)
    sums = [F.count_if(near).alias("_days"), F.coalesce(F.sum(F.when(near, F.col("ret"))), F.lit(0.0)).alias("ear"), F.avg(F.when(near, F.col("vol"))).alias("_v1"), F.avg(F.when(before, F.col("vol"))).alias("_v0")]
    met = event_window(events, daily, key, event, date, -30, 1, sums).filter("_days > 0")
    return met.select(key, event, "ear", F.try_divide(F.col("_v1") - F.col("_v0"), "_v0").alias("aeavol"))


def dated_prices(months: DataFrame, names: DataFrame, key: str = "permno", date: str = "date", code: str = "ncusip") -> DataFrame:
    """(key, cusip6, merge_date, prc_adj): split-adjusted prices by the outside code that the entity had at the price's date.

    A code that changes hands belongs, in each month, to whom the dated names give it. merge_date is the end of the month after.
    """
    held = interval_join(months, names.select(key, code, "namedt", "nameendt"), [key], date, "namedt", "nameendt")
    return held.select(key, F.substring(code, 1, 6).alias("cusip6"), F.last_day(F.add_months(F.last_day(date), 1)).alias("merge_date"), F.try_divide(F.abs("prc"), "cfacpr").alias("prc_adj"))


def latest_periods(forecasts: DataFrame) -> DataFrame:
    """Of the estimates that one statement has of a security, that of the furthest period; with cusip6 and merge_date, its month's end."""
    one = pick_one(forecasts.dropna(subset=["meanest", "fpedats"]), ["ticker", "cusip", "statpers"], [F.desc("fpedats"), "meanest"])
    return one.withColumns({"cusip6": F.substring("cusip", 1, 6), "merge_date": F.last_day("statpers")})


def revision_feature(forecasts: DataFrame, prices: DataFrame, key: str = "permno", period: str = "fpedats", at: str = "statpers", on: tuple = ("cusip6", "merge_date")) -> DataFrame:
    """(key, month index, re): mean of the entity's last 3 to 6 revisions over price, by the period's count of revisions.

    forecasts meet prices by `on`: the outside code and the month, so an estimate goes to who has the code then.
    """
    j = forecasts.join(prices, list(on))
    one = Window.partitionBy(key, period).orderBy(at)
    r = j.withColumn("_last", F.lag("meanest").over(one)).filter(F.col("_last").isNotNull() & (F.col("prc_adj") > 0)).withColumn("_r", (F.col("meanest") - F.col("_last")) / F.col("prc_adj"))
    n = F.row_number().over(one)
    of = Window.partitionBy(key).orderBy(period, at)
    past = lambda k: F.avg("_r").over(of.rowsBetween(-k, -1))
    v = r.withColumn("_n", n).withColumn("re", F.when(F.col("_n") == 4, past(3)).when(F.col("_n") == 5, past(4)).when(F.col("_n") == 6, past(5)).when(F.col("_n") >= 7, past(6)))
    return pick_one(v.filter("_n >= 4").withColumn("m", month_index(F.col(at))), [key, "m"], [F.desc(period), F.desc(at)]).select(key, "m", "re")


def stated_equity(reports: DataFrame) -> DataFrame:
    """reports with book: shareholders' equity and deferred taxes less preferred stock, where that is positive.

    Without seq there is no book: it is not made up from common equity or from assets and liabilities.
    """
    preferred = F.coalesce("pstkrv", "pstkl", "pstk", F.lit(0.0))
    return reports.withColumn("book", F.col("seq") + F.coalesce("txditc", F.lit(0.0)) - preferred).filter("book > 0")


def book_to_market(reports: DataFrame, december: DataFrame, firm: str = "permco", key: str = "permno", date: str = "datadate", book: str = "book", value: str = "value", keep: tuple = ()) -> DataFrame:
    """(key, firm, date, book_to_market, keep): the year's last report over the firm's December value of all its securities.

    december: (key, firm, year, value) of securities. The firm's largest security carries the ratio.
    """
    last = pick_one(reports.withColumn("year", F.year(date)), ["gvkey", "year"], [F.desc(date)])
    whole = december.groupBy(firm, "year").agg(F.sum(value).alias("_value"))
    ratio = F.try_divide(F.col(book) * 1000, "_value")
    j = last.join(whole, [firm, "year"]).withColumn("book_to_market", ratio).filter("book_to_market > 0").join(december.select(key, "year", F.col(value).alias("_own")), [key, "year"], "left")
    return pick_one(j, [key, date], [F.desc_nulls_last("_own"), "gvkey"]).select(key, firm, date, "book_to_market", *keep)


def june_demeaned(reports: DataFrame, value: str, industry: str, stat: str = "mean", key: str = "permno") -> DataFrame:
    """A June-timed feature less its industry's mean of each month."""
    return demean(expand_fixed(reports, key), [industry, "signal_yyyymm"], value, stat, f"{value}_ia")
