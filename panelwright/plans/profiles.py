"""Panels by profile: which securities, links, codes and order of means, and what is done to the features at the end."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.industry import with_scheme
from ..operators import panel
from ..operators.crosssection import winsorize_by_kind
from .planner import Inputs, every_name, features

#: The features of the published panel: fixed values.
PUBLISHED = """convind rd_sale rd_mve realestate dy dolvol saleinv mom1m secured depr beta betasq sp mvel1 ill lev salecash roic cashpr ep
    baspread tang quick currat salerec zerotrade std_dolvol retvol std_turn securedind gma mom6m pctacc maxret mom12m acc absacc chmom mom36m
    cfp orgcap idiovol cashdebt chcsho sgr pchsale_pchxsga chinv pchsale_pchinvt pchsaleinv hire grltnoa lgr turn pchgm_pchsale egr pchquick
    pchcurrat pchdepr pchsale_pchrect invest divi stdcf stdacc divo cash grcapx rd sin sic2 pricedelay tb chatoia age herf ps mve_ia roaq bm
    chempia rsup roeq operprof chtx nincr cinvest aeavol bm_ia ear chpmia cfp_ia roavol ms pchcapx_ia indmom agr""".split()


@dataclass(frozen=True)
class Profile:
    """links: codes of link types, a trailing * for a prefix. codes: "company" or "history". after: industry means over
    linked reports alone. published: the names are PUBLISHED. scheme: of the industries that missing values are filled in by.
    digits: decimals that features have when they are ranked, so that those which differ by the order of a sum alone tie.
    """

    start: str
    links: tuple = ("LU", "LC", "LD", "LF", "LN", "LO", "LS", "LX")
    primary: object = "ALL"
    shares: object = (10, 11)
    exchanges: object = (1, 2, 3)
    codes: str = "company"
    after: bool = False
    winsorized: bool = False
    ranked: bool = False
    ranked_from: int = 195701
    published: bool = False
    scheme: int = 49
    digits: int | None = None


#: Fixed values of the three profiles.
PROFILES = {
    "green": Profile("1975-01-01", winsorized=True),
    "datashare": Profile("1957-01-01", ("L*",), ("P", "C"), "ALL", after=True, published=True),
    "research": Profile("1975-01-01", ranked=True),
}


def allowed(df: DataFrame, ids: list[str], names: list[str] = PUBLISHED) -> DataFrame:
    """ids and the features that are among names, themselves or under their other name."""
    other = {b: a for a, b in panel.ALIASES.items()}
    return panel.trim(df, [c for c in df.columns if c in names or other.get(c) in names], ids)


def numbers(df: DataFrame, names: list[str]) -> list[str]:
    return [c for c in names if isinstance(df.schema[c].dataType, T.NumericType)]


def build(profile: Profile, tables: Callable[[str], DataFrame], names: list[str] | None = None, scheme_text: str | None = None) -> DataFrame:
    """permno, signal_yyyymm, target_yyyymm, sic and the features of every month of the universe.

    tables: as of planner.Inputs. names: PUBLISHED for a published profile, otherwise all that have a builder. scheme_text:
    the ranges of the profile's industry scheme as it is published, where the library has not got them.
    """
    names = names or (PUBLISHED if profile.published else every_name())
    out = features(Inputs(profile, tables), names)
    if profile.winsorized:
        out = winsorize_by_kind(out, ["signal_yyyymm"])
    if not profile.ranked:
        return out
    ranked = numbers(out, names)
    if profile.digits is not None:  # a little off the ties of rounding
        out = out.withColumns({c: F.round(F.col(c) + 0.37 * 10.0 ** (-profile.digits - 3), profile.digits) for c in ranked})
    coded = with_scheme(out, scheme_text or profile.scheme, "sic", "industry")
    return panel.research_panel(coded, ranked, start=profile.ranked_from).drop("industry")
