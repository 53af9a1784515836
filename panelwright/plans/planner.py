"""Panels of named features: what each feature is made from and when it is known, and one merge of what the names need.

A family of features shares its source, its rule of timing and one pass over that source. `plan()` tells which families
a list of names needs; `Inputs` prepares what several families use, each once; `features()` makes each family's frame,
keyed by entity and month, for the needed names alone, and merges all frames on the months of the universe by one union
and one aggregation, whatever their number. `add()` takes a family of one's own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import key_of_index, month_index
from ..operators import links, panel
from ..operators.regression import compound, price_delay, rolling_regression, with_market
from ..operators.timing import expand_fixed, expand_rolling, rolling_live, spread
from . import features as f
from . import monthly as m

KEYS = ["permno", "signal_yyyymm"]
MONTHLY = "mvel1 mom1m mom6m mom12m mom36m mom60m chmom seas1a dolvol turn indmom".split()
DAILY = "maxret rvar_mean baspread std_dolvol std_turn ill zerotrade".split()
JUNE = "book_to_market bm_ia operating_profitability".split()
#: Features of a family that are made at a time, and parts of the entities that price delays are made for one after the other.
WIDE, PARTS = 30, 4
QUARTERLY = [*f.QUARTERLY, "stdacc", "stdcf", "roavol", "sgrvol", "nincr"]


class Inputs:
    """What families are made from. tables(name) gives a source: security_month, security_day, names, link, fundamentals_year, fundamentals_quarter.

    What several families use is computed once and kept in the checkpoint folder.
    """

    def __init__(self, rules, tables: Callable[[str], DataFrame]):
        self.rules, self.tables = rules, tables

    def _linked(self, table: str) -> DataFrame:
        use = links.filter_links(self.tables("link"), self.rules.links, self.rules.primary)
        met = links.interval_join(self.tables(table).select("gvkey", "datadate"), use, ["gvkey"], "datadate", "linkdt", "linkenddt")
        return links.primary_links(met, ["gvkey", "datadate"]).select("gvkey", "datadate", "permno", "permco")

    @cached_property
    def annual_links(self) -> DataFrame:
        return panel.cut_lineage(self._linked("fundamentals_year"))

    @cached_property
    def quarters(self) -> DataFrame:
        """Quarterly features of linked reports that have been announced."""
        q = f.quarterly_features(self.tables("fundamentals_quarter"))
        linked = self._linked("fundamentals_quarter").select("gvkey", "datadate", "permno")
        return panel.cut_lineage(q.filter("rdq is not null").join(linked, ["gvkey", "datadate"]))

    @cached_property
    def months(self) -> DataFrame:
        """Months of the universe, with the codes of their companies' live reports or of their own history."""
        held = links.interval_join(self.tables("security_month"), self.tables("names"), ["permno"], "date", "namedt", "nameendt")
        held = panel.in_codes(panel.in_codes(panel.within(held, "date", F.lit(self.rules.start).cast("date")), "exchcd", self.rules.exchanges), "shrcd", self.rules.shares)
        reports = self.tables("fundamentals_year").select("gvkey", "datadate", "sic", "sic2").join(self.annual_links, ["gvkey", "datadate"])
        live = expand_rolling(reports, ties=("gvkey",)).select(*KEYS, "sic", "sic2")
        return panel.cut_lineage(links.with_codes(held, live, self.rules.codes))


def _annual(inputs: Inputs, names: list[str]) -> DataFrame:
    members = inputs.annual_links if inputs.rules.after else None
    made = f.annual_panel(inputs.tables("fundamentals_year"), [n for n in names if n != "ms"], "ms" in names, members)
    if "ms" in names:
        made = f.mohanram_score(made, f.quarterly_features(inputs.tables("fundamentals_quarter")), keep=[n for n in names if n != "ms"])
    live = rolling_live(inputs.annual_links, ties=("gvkey",))  # links are narrow: of many companies of an entity one report is left
    return spread(made.join(live, ["gvkey", "datadate"])).select(*KEYS, *names)


def latest_of_window(reports: DataFrame, names: list[str], lag_from: int = 10, lag_to: int = 6, date: str = "datadate") -> DataFrame:
    """(permno, signal_yyyymm, names): of each column the value of the latest report lag_from to lag_to months before that has one.

    Each report goes to the five months that may use it, and all columns are picked by one aggregation. Of reports of one
    date the larger value counts.
    """
    at = month_index(F.col(date))
    spread = reports.withColumn("signal_yyyymm", F.explode(F.transform(F.sequence(at + lag_to, at + lag_from), key_of_index)))
    latest = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(date, c)))[c].alias(c)
    return spread.groupBy(*KEYS).agg(*map(latest, names))


def _quarterly(inputs: Inputs, names: list[str]) -> DataFrame:
    return latest_of_window(inputs.quarters.select("permno", "datadate", *names), names)


def _events(inputs: Inputs, names: list[str]) -> DataFrame:
    told = inputs.quarters.select("permno", "datadate", "rdq").distinct()
    around = m.announcement_features(told.select("permno", "rdq").distinct(), inputs.tables("security_day"))
    return latest_of_window(told.join(around, ["permno", "rdq"]), names)


def _monthly(inputs: Inputs, names: list[str]) -> DataFrame:
    made = m.monthly_features(inputs.months, industry="sic2")
    return made.withColumn("indmom", F.when(F.col("sic2").isNotNull(), F.col("indmom"))).select(*KEYS, *names)


def _daily(inputs: Inputs, names: list[str]) -> DataFrame:
    sums = m.daily_month_features(inputs.tables("security_day")).select("permno", "m", *names)
    return m.on_next_row(inputs.months.select(*KEYS, "m"), sums, names).select(*KEYS, *names)


def _regression(inputs: Inputs, names: list[str]) -> DataFrame:
    weekly = panel.cut_lineage(with_market(compound(inputs.tables("security_day"), "permno", "date", "ret")))
    spine = inputs.months.select(*KEYS, "m")
    out = rolling_regression(weekly, spine, "permno", "m", "week", "ret", "mkt")
    if "pricedelay" in names:  # its sums are wide, so it is made by itself, some entities at a time
        use = weekly.dropna(subset=["ret", "mkt"])
        some = lambda df, i: df.filter(F.pmod(F.xxhash64("permno"), F.lit(PARTS)) == i)
        parts = [panel.cut_lineage(price_delay(some(use, i), some(spine, i), "permno", "m", "week", "ret", "mkt", 4, (36, 1), 52)) for i in range(PARTS)]
        out = panel.cut_lineage(out).join(reduce(DataFrame.unionByName, parts), ["permno", "m"], "left")
    return out.select(*KEYS, *names)


def _june(inputs: Inputs, names: list[str]) -> DataFrame:
    year = inputs.tables("fundamentals_year")
    frames = []
    if {"book_to_market", "bm_ia"} & {*names}:
        prices = inputs.months.filter("m % 12 = 11").select("permno", "permco", F.year("date").alias("year"), (F.abs("prc") * F.col("shrout")).alias("value"))
        books = m.stated_equity(year).select("gvkey", "datadate", "book", "sic").join(inputs.annual_links, ["gvkey", "datadate"])
        live = expand_fixed(m.book_to_market(books, prices, keep=("sic",)).withColumn("_industry", F.floor(F.col("sic") / 100)))
        frames.append(m.demean(live, ["_industry", "signal_yyyymm"], "book_to_market", out="bm_ia"))
    if "operating_profitability" in names:
        made = f.operating_profitability(year).join(inputs.annual_links.select("gvkey", "datadate", "permno"), ["gvkey", "datadate"])
        frames.append(expand_fixed(made, ties=("gvkey",)))
    wanted = [x.select(*KEYS, *(n for n in names if n in x.columns)) for x in frames]
    return wanted[0] if len(wanted) == 1 else panel.merge_features(wanted, KEYS)


@dataclass(frozen=True)
class Family:
    """source: what it is made from; timing: when it is known; build(inputs, names) gives (permno, signal_yyyymm, names)."""

    names: tuple[str, ...]
    source: str
    timing: str
    build: Callable[[Inputs, list[str]], DataFrame]


FAMILIES: dict[str, Family] = {
    "annual": Family((*f.ANNUAL, *f.ADJUSTED, "herf", "orgcap", "ms"), "fundamentals_year", "7 to 19 months after the report", _annual),
    "quarterly": Family(tuple(QUARTERLY), "fundamentals_quarter", "6 to 10 months after the report", _quarterly),
    "events": Family(("ear", "aeavol"), "security_day", "6 to 10 months after the report", _events),
    "monthly": Family(tuple(MONTHLY), "security_month", "the month itself", _monthly),
    "daily": Family(tuple(DAILY), "security_day", "the entity's next month", _daily),
    "regression": Family(("beta", "betasq", "idiovol", "pricedelay"), "security_day", "the month itself", _regression),
    "june": Family(tuple(JUNE), "fundamentals_year", "June of the next year to May", _june),
}

#: Names of features that are the spine's own columns.
SPINE = ("sic2",)


def add(name: str, family: Family) -> None:
    FAMILIES[name] = family


def own_name(name: str) -> str | None:
    """The name that a family has for a feature of either name; None where there is none."""
    known = {n for family in FAMILIES.values() for n in family.names} | {*SPINE}
    other = {b: a for a, b in panel.ALIASES.items()} | panel.ALIASES
    return next((n for n in (name, other.get(name)) if n in known), None)


def every_name() -> list[str]:
    """All features that families make."""
    return [*(n for family in FAMILIES.values() for n in family.names), *SPINE]


def plan(names: list[str]) -> dict[str, list[str]]:
    """{family: own names} that the names need; an unknown one is an error."""
    if unknown := [n for n in names if own_name(n) is None]:
        raise ValueError(f"no feature {unknown}")
    own = [own_name(n) for n in names]
    return {k: needed for k, family in FAMILIES.items() if (needed := [n for n in family.names if n in own])}


def features(inputs: Inputs, names: list[str]) -> DataFrame:
    """permno, signal_yyyymm, target_yyyymm, sic and the named features of every month of the universe.

    Families are made one after the other, and WIDE features at a time: the shuffles of one are gone from the disk before those of the next come.
    """
    frames = [panel.cut_lineage(FAMILIES[k].build(inputs, own[at : at + WIDE])) for k, own in plan(names).items() for at in range(0, len(own), WIDE)]
    spine = inputs.months.select(*KEYS, "target_yyyymm", "sic", "sic2", F.lit(1).alias("_in"))
    merged = panel.merge_features([spine, *frames], KEYS).filter("_in = 1")
    return merged.select(*KEYS, "target_yyyymm", "sic", *(F.col(own_name(n)).alias(n) for n in names))
