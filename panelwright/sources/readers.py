"""Files of other systems as typed DataFrames, with what each source's rows must satisfy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import month_of_yyyymmdd
from ..functions.scalar import number


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, fmt: str = "parquet", **options) -> DataFrame:
    """A table of any format that Spark reads, with the columns asked for only."""
    df = spark.read.format(fmt).options(**options).load(path)
    return df.select(*columns) if columns else df


def header(spark: SparkSession, path: str, fmt: str = "csv") -> list[str]:
    """Column names alone; no row is read beyond the first of a CSV file."""
    return spark.read.format(fmt).option("header", True).load(path).columns


def read_macro_csv(spark: SparkSession, path: str) -> DataFrame:
    """A monthly series with a column yyyymm and numbers that may have thousands separators."""
    raw = spark.read.csv(path, header=True)
    return raw.select(F.col("yyyymm").cast("int").alias("yyyymm"), *(number(f"`{c}`").alias(c.lower().replace("/", "")) for c in raw.columns if c != "yyyymm"))


def read_reference_panel(spark: SparkSession, path: str, features: list[str], date: str = "DATE") -> DataFrame:
    """A published panel keyed by permno and a date YYYYMMDD, whose month becomes the key."""
    schema = ", ".join(["permno bigint", f"`{date}` int", *(f"`{c}` double" for c in features)])
    raw = spark.read.csv(path, header=True, schema=schema, enforceSchema=False)
    return raw.withColumn("signal_yyyymm", month_of_yyyymmdd(date)).drop(date)


def annual_fundamentals(df: DataFrame, start=None, end=None) -> DataFrame:
    """Rows with assets, price and income, prices without sign; standard rows only where those codes are there."""
    for col, code in (("indfmt", "INDL"), ("datafmt", "STD"), ("popsrc", "D"), ("consol", "C")):
        if col in df.columns:
            df = df.filter(F.col(col) == code)
    df = df.dropna(subset=["assets", "prcc_f", "ni"]).withColumn("prcc_f", F.abs("prcc_f"))
    if start is not None:
        df = df.filter(F.col("datadate") >= F.lit(start))
    return df if end is None else df.filter(F.col("datadate") <= F.lit(end))


def with_company(df: DataFrame, company: DataFrame, columns: tuple = ("sic",), key: str = "gvkey") -> DataFrame:
    """Reports with columns of the company's own table, NULL where it has none; they take the place of columns of these names."""
    return df.drop(*columns).join(company.select(key, *columns).dropDuplicates([key]), key, "left")


def quarterly_fundamentals(df: DataFrame, start: str = "1975-01-01") -> DataFrame:
    out = df.dropna(subset=["ibq"]).filter(F.col("datadate") >= F.lit(start).cast("date"))
    if "cusip" in df.columns:
        out = out.withColumn("cusip6", F.substring(F.regexp_replace("cusip", " ", ""), 1, 6))
    return out.withColumn("mveq", F.abs("prccq") * F.col("cshoq")) if "prccq" in df.columns else out


def annual_forecasts(df: DataFrame, fpi: str = "1") -> DataFrame:
    """Estimates made before the announcement, for periods that are not over."""
    return df.filter((F.col("fpi") == fpi) & (F.col("statpers") < F.col("anndats_act")) & (F.col("fpedats") >= F.col("statpers")))


def quarterly_forecasts(df: DataFrame) -> DataFrame:
    """The last median estimate of each (cusip6, fpedats) that was made before the announcement and not after the period."""
    from ..operators.links import pick_one

    use = df.filter("fpi = '6' AND measure = 'EPS' AND statpers < anndats_act AND fpedats >= statpers").dropna(subset=["medest", "fpedats"])
    named = use.withColumn("cusip6", F.substring(F.regexp_replace("cusip", " ", ""), 1, 6))
    return pick_one(named, ["cusip6", "fpedats"], [F.desc("statpers"), "medest"]).select("cusip6", "fpedats", "statpers", "medest", "actual")


def with_forecasts(reports: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Quarterly reports with the forecast of their own quarter's end, where there is one."""
    f = forecasts.withColumn("datadate", F.col("fpedats"))
    return reports.join(f, ["cusip6", "datadate"], "left")


def adjusted_prices(df: DataFrame) -> DataFrame:
    """Split-adjusted prices, dated by the month end at which they are used."""
    return df.select("permno", F.last_day(F.add_months("date", 1)).alias("merge_date"), F.try_divide(F.abs("prc"), "cfacpr").alias("prc_adj"))


def daily_of(daily: DataFrame, ids: DataFrame, columns: list[str]) -> DataFrame:
    """Daily rows of some entities: one partitioned read and a semi join."""
    return daily.select("permno", "date", *columns).join(ids.select("permno").distinct(), "permno", "left_semi")
