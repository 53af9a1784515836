"""Panels: merging features, outcomes, research and macro panels, sinks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import finite
from ..storage import staged_alone
from .crosssection import standardized

#: Columns that are never features.
IDS = {"permno", "permco", "gvkey", "date", "datadate", "signal_yyyymm", "target_yyyymm", "sic", "sic2", "fyear", "exchcd", "shrcd", "industry", "ret", "dlret", "dlstcd", "retadj", "rf", "excess_return"}
#: Feature names of other catalogues.
ALIASES = {"bm": "book_to_market", "operprof": "operating_profitability", "mve_ia": "me_ia", "rd_mve": "rdm", "retvol": "rvar_mean", "ear": "abr"}


def feature_columns(df: DataFrame, deny: set = frozenset(IDS)) -> list[str]:
    """Numeric columns that are not identifiers."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in deny]


def rename_aliases(df: DataFrame, aliases: dict | None = None) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in (aliases or ALIASES).items() if a in df.columns and b not in df.columns})


def within(df: DataFrame, col: str, start=None, end=None) -> DataFrame:
    out = df if start is None else df.filter(F.col(col) >= F.lit(start))
    return out if end is None else out.filter(F.col(col) <= F.lit(end))


def in_codes(df: DataFrame, col: str, codes) -> DataFrame:
    return df if codes == "ALL" else df.filter(F.col(col).isin(list(codes)))


def require(df: DataFrame, names: list[str], aliases: dict | None = None) -> DataFrame:
    """Rows with all the named features, under whichever name they go; an absent one is an error."""
    both = (aliases or ALIASES) | {b: a for a, b in (aliases or ALIASES).items()}
    found = [n if n in df.columns else both.get(n) for n in names]
    if missing := [n for n, f in zip(names, found, strict=True) if f not in df.columns]:
        raise ValueError(f"no column for {missing}")
    return df.dropna(subset=found)


def merge_features(dfs: list[DataFrame], keys: list[str]) -> DataFrame:
    """One row a key with all frames' columns; of a column in several frames the first frame's value counts.

    A union and one aggregation, whatever the number of frames: a frame's columns go as one value. Of a frame's several
    rows of a key one counts.
    """
    own = [[c for c in d.columns if c not in keys] for d in dfs]
    packed = [d.select(*keys, F.struct(*cols).alias(f"_f{i}")) for i, (d, cols) in enumerate(zip(dfs, own, strict=True)) if cols]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), packed)
    frames = [c for c in union.columns if c not in keys]
    whole = union.groupBy(*keys).agg(*(F.first(c, ignorenulls=True).alias(c) for c in frames))
    at: dict[str, list] = {}
    for i, cols in enumerate(own):
        for c in cols:
            at.setdefault(c, []).append(F.col(f"_f{i}.{c}"))
    return whole.select(*keys, *((F.coalesce(*cs) if len(cs) > 1 else cs[0]).alias(c) for c, cs in at.items()))


def month_universe(dfs: list[DataFrame], keys: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.union(b), [d.select(*keys) for d in dfs]).distinct()


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: for a plan that many others are built on."""
    return staged_alone(df, "cut")


#: What a table of months must have so that features can be aligned to it.
SPINE = ("permno", "permco", "date", "signal_yyyymm", "target_yyyymm", "siccd", "exchcd", "shrcd")


def month_spine(stored: list[DataFrame], build: Callable[[], DataFrame], needs: tuple = SPINE, key: str = "permno", month: str = "signal_yyyymm") -> DataFrame:
    """The needed columns of the first stored table that has them all, or of build()'s; with source_yyyymm, the entity's row before, where it is not told.

    Tables are told apart by their columns alone: none is read to decide, and build() is not called where one serves.
    """
    months = next((d for d in stored if set(needs) <= set(d.columns)), None)
    months = build() if months is None else months
    if "source_yyyymm" not in months.columns:
        months = months.withColumn("source_yyyymm", F.lag(month).over(Window.partitionBy(key).orderBy(month)))
    return months.select(*needs, "source_yyyymm")


def to_percent_units(rates: DataFrame, col: str, limit: float = 0.02) -> DataFrame:
    """Rates divided by 100 where their median size shows that they are percentages; one number comes to the driver."""
    mid = rates.agg(F.median(F.abs(col))).first()[0]
    return rates.withColumn(col, F.col(col) / 100) if mid is not None and mid > limit else rates


def distress_return(dlret: str, dlstcd: str, exchcd: str) -> Column:
    """A missing delisting return for performance reasons (codes 500 and 505 to 584): -35 % on exchanges 1 and 2, -55 % on exchange 3."""
    bad = (F.col(dlstcd) == 500) | F.col(dlstcd).between(505, 584)
    return F.when(F.col(dlret).isNull() & bad, F.when(F.col(exchcd).isin(1, 2), -0.35).when(F.col(exchcd) == 3, -0.55)).otherwise(F.col(dlret))


def excess_returns(ret: DataFrame, delist: DataFrame, rf: DataFrame, key: str = "permno", month: str = "m", distress_fill: bool = False) -> DataFrame:
    """ret with dlret, dlstcd, retadj, rf and excess_return; NULL where both returns are missing."""
    j = ret.join(delist, [key, month], "left").join(rf.select(month, "rf"), month, "left")
    if distress_fill:
        j = j.withColumn("dlret", distress_return("dlret", "dlstcd", "exchcd"))
    both = (1 + F.coalesce("ret", F.lit(0.0))) * (1 + F.coalesce("dlret", F.lit(0.0))) - 1
    adj = F.when(F.col("ret").isNotNull() | F.col("dlret").isNotNull(), both)
    return j.withColumn("retadj", adj).withColumn("excess_return", F.col("retadj") - F.col("rf"))


def with_outcomes(signals: DataFrame, returns: DataFrame, key: str = "permno", month: str = "target_yyyymm") -> DataFrame:
    return signals.join(returns.dropDuplicates([key, month]), [key, month])


def research_panel(df: DataFrame, cols: list[str], month: str = "signal_yyyymm", industry: str = "industry", target: str = "target_yyyymm", start: int | None = None, lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    """Window, finite values, winsorized by month, imputed by industry and month, then by month, ranked to [-1, 1]."""
    clean = within(df, target, start).withColumns({c: finite(c) for c in cols})
    return standardized(clean, cols, [month], [[month, industry], [month]], lower, upper)


def macro_predictors(df: DataFrame) -> DataFrame:
    """dp, ep, bm, tms, dfy, ntis, tbl and svar of a series of months."""
    return df.select("yyyymm", (F.ln("d12") - F.ln("index")).alias("dp"), (F.ln("e12") - F.ln("index")).alias("ep"), F.ln("bm").alias("bm"), (F.col("lty") - F.col("tbl")).alias("tms"), (F.col("baa") - F.col("aaa")).alias("dfy"), "ntis", "tbl", "svar")


def column_plan(df: DataFrame, wanted: list[str], ids: list[str]) -> dict[str, list[str]]:
    """Which columns stay, go and are missing when a panel is trimmed to the wanted ones."""
    keep = [c for c in (*ids, *wanted) if c in df.columns]
    return {"keep": keep, "dropped": [c for c in df.columns if c not in keep], "missing": [c for c in wanted if c not in df.columns]}


def trim(df: DataFrame, wanted: list[str], ids: list[str]) -> DataFrame:
    return df.select(*column_plan(df, wanted, ids)["keep"])


def write_panel(df: DataFrame, path: str, month: str = "target_yyyymm", key: str = "permno") -> None:
    """A table of months: those that df has are replaced, all others stay.

    Rows are dealt by ranges of months and entities, sorted within, so that a month is a few files, whose footers let
    readers of some entities skip.
    """
    dealt = df.repartitionByRange(month, key).sortWithinPartitions(month, key)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(month).parquet(path)


def read_panel(spark: SparkSession, path: str, months: tuple[int, int] | None = None, month: str = "target_yyyymm") -> DataFrame:
    """A table of write_panel(), of the months from the first to the last named: the folders of others are not read."""
    df = spark.read.parquet(path)
    return df if months is None else df.filter(F.col(month).between(*months))


def write_feature(df: DataFrame, value: str, path: str, month: str = "signal_yyyymm") -> None:
    """Rows with a finite value, partitioned by month; months that df has are replaced."""
    told = df.withColumn(value, finite(value)).dropna(subset=[value])
    told.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(month).parquet(path)


def write_bucketed(df: DataFrame, table: str, buckets: int, key: str = "permno", month: str = "signal_yyyymm") -> None:
    """A table of the catalogue in buckets of entities: tables of as many buckets are joined and summed by entity without an exchange."""
    df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key, month).saveAsTable(table)


def degenerate(df: DataFrame, col: str, value: float = -1.0, tol: float = 1e-8) -> bool:
    """Whether all values of a column are about the same one."""
    return bool(degenerate_columns(df, [col], value, tol).first()["degenerate"])


def degenerate_columns(df: DataFrame, cols: list[str], value: float = -1.0, tol: float = 1e-8) -> DataFrame:
    """(char, n, degenerate) of each column, in one pass: whether it has values and all are about the same one."""
    one = df.agg(*(F.struct(F.lit(c).alias("char"), F.count(c).alias("n"), F.coalesce(F.max(F.abs(F.col(c).cast("double") - value)) <= tol, F.lit(False)).alias("degenerate")).alias(c) for c in cols))
    return one.select(F.inline(F.array(*cols)))
