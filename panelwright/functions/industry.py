"""Industry schemes as ranges of four-digit codes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..operators.links import range_code

#: Published schemes by their number of groups: fixed values. A code in no range is in no group.
SCHEMES = {
    5: """
        1 Cnsmr 100-999 2000-2399 2700-2749 2770-2799 3100-3199 3940-3989 2500-2519 2590-2599 3630-3659 3710-3711 3714 3716 3750-3751 3792 3900-3939 3990-3999 5000-5999 7200-7299 7600-7699
        2 Manuf 2520-2589 2600-2699 2750-2769 2800-2829 2840-2899 3000-3099 3200-3569 3580-3621 3623-3629 3700-3709 3712-3713 3715 3717-3749 3752-3791 3793-3799 3860-3899 1200-1399 2900-2999 4900-4949
        3 HiTec 3570-3579 3622 3660-3692 3694-3699 3810-3839 7370-7372 7373 7374 7375 7376 7377 7378 7379 7391 8730-8734 4800-4899
        4 Hlth 2830-2839 3693 3840-3859 8000-8099""",
    10: """
        1 NoDur 100-999 2000-2399 2700-2749 2770-2799 3100-3199 3940-3989
        2 Durbl 2500-2519 2590-2599 3630-3659 3710-3711 3714 3716 3750-3751 3792 3900-3939 3990-3999
        3 Manuf 2520-2589 2600-2699 2750-2769 2800-2829 2840-2899 3000-3099 3200-3569 3580-3621 3623-3629 3700-3709 3712-3713 3715 3717-3749 3752-3791 3793-3799 3860-3899
        4 Enrgy 1200-1399 2900-2999
        5 HiTec 3570-3579 3622 3660-3692 3694-3699 3810-3839 7370-7372 7373 7374 7375 7376 7377 7378 7379 7391 8730-8734
        6 Telcm 4800-4899
        7 Shops 5000-5999 7200-7299 7600-7699
        8 Hlth 2830-2839 3693 3840-3859 8000-8099
        9 Utils 4900-4949""",
    12: """
        1 NoDur 100-999 2000-2399 2700-2749 2770-2799 3100-3199 3940-3989
        2 Durbl 2500-2519 2590-2599 3630-3659 3710-3711 3714 3716 3750-3751 3792 3900-3939 3990-3999
        3 Manuf 2520-2589 2600-2699 2750-2769 3000-3099 3200-3569 3580-3629 3700-3709 3712-3713 3715 3717-3749 3752-3791 3793-3799 3830-3839 3860-3899
        4 Enrgy 1200-1399 2900-2999
        5 Chems 2800-2829 2840-2899
        6 BusEq 3570-3579 3660-3692 3694-3699 3810-3829 7370-7379
        7 Telcm 4800-4899
        8 Utils 4900-4949
        9 Shops 5000-5999 7200-7299 7600-7699
        10 Hlth 2830-2839 3693 3840-3859 8000-8099
        11 Money 6000-6999""",
    38: """
        1 Agric 100-999
        2 Mines 1000-1299
        3 Oil 1300-1399
        4 Stone 1400-1499
        5 Cnstr 1500-1799
        6 Food 2000-2099
        7 Smoke 2100-2199
        8 Txtls 2200-2299
        9 Apprl 2300-2399
        10 Wood 2400-2499
        11 Chair 2500-2599
        12 Paper 2600-2661
        13 Print 2700-2799
        14 Chems 2800-2899
        15 Ptrlm 2900-2999
        16 Rubbr 3000-3099
        17 Lethr 3100-3199
        18 Glass 3200-3299
        19 Metal 3300-3399
        20 MtlPr 3400-3499
        21 Machn 3500-3599
        22 Elctr 3600-3699
        23 Cars 3700-3799
        24 Instr 3800-3879
        25 Manuf 3900-3999
        26 Trans 4000-4799
        27 Phone 4800-4829
        28 TV 4830-4899
        29 Utils 4900-4949
        30 Garbg 4950-4959
        31 Steam 4960-4969
        32 Water 4970-4979
        33 Whlsl 5000-5199
        34 Rtail 5200-5999
        35 Money 6000-6999
        36 Srvc 7000-8999
        37 Govt 9000-9999""",
}


def ranges(scheme: int | str) -> list[tuple[int, str, int, int]]:
    """(number, name, low, high) of a scheme: one of SCHEMES, or the text of a file as the schemes are published.

    In such a text a line with a number and a name begins a group, and lines that begin with two codes are its ranges.
    """
    out, group = [], None
    text = SCHEMES[scheme] if isinstance(scheme, int) else scheme
    for line in text.splitlines():
        if told := re.match(r"\s*(\d{1,2})\s+([A-Za-z]\S*)", line):
            group = int(told[1]), told[2]
        for low, high in re.findall(r"\b(\d{3,4})(?:-(\d{3,4}))?\b", line) if group else ():
            out.append((*group, int(low), int(high or low)))
    return out


def scheme_ranges(spark: SparkSession, scheme: int | str) -> DataFrame:
    """(number, name, low, high, ord); a later range goes before an earlier one."""
    rows = [(*r, i) for i, r in enumerate(ranges(scheme))]
    return spark.createDataFrame(rows, "number int, name string, low int, high int, ord int")


def with_scheme(df: DataFrame, scheme: int | str, code: str = "sic", out: str | None = None) -> DataFrame:
    """df with the number of the code's group; NULL where no range holds the code."""
    return range_code(df, scheme_ranges(df.sparkSession, scheme), code, "low", "high", "number", "ord", out or f"ffi{scheme if isinstance(scheme, int) else ''}")
