"""From reports to the months in which they are known."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import add_business_days, key_of_index, month_index
from .links import pick_one


def _spread(df: DataFrame, first, last) -> DataFrame:
    out = df.withColumn("_m", F.explode(F.sequence(first, last)))
    return out.withColumn("signal_yyyymm", key_of_index("_m")).withColumn("target_yyyymm", key_of_index(F.col("_m") + 1)).drop("_m")


def live_until_next(df: DataFrame, first, last, key: str = "permno", date: str = "datadate", ties: tuple = ()) -> DataFrame:
    """One report of each key and date with _first and _last, the months from first to last in which no later report is live.

    first and last must not fall as dates rise. A report that none of its months is left to goes.
    """
    one = pick_one(df.dropna(subset=[key, date]), [key, date], list(ties) or [F.col(date)]).withColumns({"_first": first, "_last": last})
    following = F.lead("_first").over(Window.partitionBy(key).orderBy(date))
    return one.withColumn("_last", F.least("_last", following - 1)).filter("_first <= _last")


def rolling_live(df: DataFrame, key: str = "permno", date: str = "datadate", start: int = 7, end: int = 20, ties: tuple = ()) -> DataFrame:
    """The reports of expand_rolling() with their months as _first and _last; spread() makes rows of months of them."""
    m = month_index(F.col(date))
    return live_until_next(df, m + start, m + end - 1, key, date, ties)


def spread(live: DataFrame) -> DataFrame:
    return _spread(live, F.col("_first"), F.col("_last")).drop("_first", "_last")


def expand_rolling(df: DataFrame, key: str = "permno", date: str = "datadate", start: int = 7, end: int = 20, spine: DataFrame | None = None, ties: tuple = ()) -> DataFrame:
    """Each report is live from start to end - 1 months after its date; the latest wins in a month; spine months only."""
    out = spread(rolling_live(df, key, date, start, end, ties))
    return out if spine is None else out.join(spine.select(key, "signal_yyyymm").distinct(), [key, "signal_yyyymm"], "left_semi")


def expand_fixed(df: DataFrame, key: str = "permno", date: str = "datadate", first_month: int = 6, n: int = 12, ties: tuple = ()) -> DataFrame:
    """A report of year y is live for n months from first_month of y + 1; the latest wins in a month."""
    begin = (F.year(date) + 1) * 12 + first_month - 1
    return spread(live_until_next(df, begin, begin + n - 1, key, date, ties))


def expand(df: DataFrame, convention: str, **options) -> DataFrame:
    """By name: 'rolling', 'june' or 'native' (months are there already)."""
    if convention == "native":
        return df
    return {"rolling": expand_rolling, "june": expand_fixed}[convention](df, **options)


def until_next_report(df: DataFrame, key: str, date: str, lag: int = 4, last: int = 12) -> DataFrame:
    """Live from lag months after a report until the next one is; the last one for so many months."""
    m = month_index(F.col(date)) + lag
    following = F.lead(m).over(Window.partitionBy(key).orderBy(date))
    return _spread(df.withColumn("_from", m).withColumn("_to", F.coalesce(following - 1, m + last - 1)).filter("_from <= _to"), F.col("_from"), F.col("_to")).drop("_from", "_to")


def asof_window(spine: DataFrame, reports: DataFrame, key: str = "permno", month: str = "signal_yyyymm", date: str = "datadate", values: list[str] | None = None, lag_from: int = 10, lag_to: int = 6, require: str | None = None) -> DataFrame:
    """The latest report of the months lag_from to lag_to before each spine month.

    One value column: rows without it do not count. Several: all come from the one latest row. Each report is
    spread over the months that may use it, so the join is by equality and a report meets five rows at most.
    """
    use = reports.dropna(subset=[key, date] + ([require] if require else []))
    if values and len(values) == 1:
        use = use.dropna(subset=values)
    values = values or [c for c in reports.columns if c not in (key, date)]
    m = month_index(F.col(date))
    spread = use.withColumn(month, F.explode(F.transform(F.sequence(m + lag_to, m + lag_from), key_of_index)))
    latest = spread.groupBy(key, month).agg(F.max(F.struct(date, *values)).alias("_r"))
    return spine.join(latest.select(key, month, "_r.*"), [key, month], "left")


def event_window(events: DataFrame, daily: DataFrame, key: str, event: str, date: str, before: int, after: int, aggregates: list, keep: list[str] | None = None) -> DataFrame:
    """Aggregates of daily rows from `before` to `after` business days around each event.

    Daily rows meet events in the event's month and the months beside it, so a long history is not paired whole.
    """
    lo, hi = add_business_days(event, before), add_business_days(event, after)
    e = events.select(*(keep or [key, event])).distinct().withColumn("_lo", lo).withColumn("_hi", hi).withColumn("_b", F.explode(F.sequence(month_index(F.col("_lo")), month_index(F.col("_hi")))))
    d = daily.withColumn("_b", month_index(F.col(date)))
    met = e.join(d, [key, "_b"]).filter(F.col(date).between(F.col("_lo"), F.col("_hi")))
    return met.groupBy(*(keep or [key, event])).agg(*aggregates)
