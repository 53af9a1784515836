"""How a query's result and its SQL are brought to one form: named columns, decimals rounded alike by both engines."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.standins import statement, view

#: From here on numbers are rounded to nine digits instead of to decimals.
LARGE = 1e9


@dataclass
class Query:
    """cols: names, `name~d` to be rounded to d decimals. sql: a statement over views and tables in braces, or None.

    Rounding is moved a little off the ties, which two engines with sums in other orders would break differently. Large
    numbers keep nine digits.
    """

    name: str
    build: Callable[[Callable[[str], DataFrame]], DataFrame]
    cols: str
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(lambda name: view(spark, sf_dir, name))

        def column(c: str):
            name, _, d = c.partition("~")
            if not d:
                return F.col(name)
            x = F.col(name).cast("double")
            unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - 8)
            return F.when(F.abs(x) < LARGE, F.round(x + 0.37 * 10.0 ** (-int(d) - 3), int(d))).otherwise(F.round(x / unit) * unit).alias(name)

        return df.select(*map(column, self.cols.split()))

    def oracle(self) -> str | None:
        if self.sql is None:
            return None

        def column(c: str) -> str:
            name, _, d = c.partition("~")
            x = f"CAST({name} AS DOUBLE)"
            unit = f"pow(10e0, floor(log10(nullif(abs({x}), 0))) - 8)"
            return f"CASE WHEN abs({x}) < {LARGE} THEN round({x} + {0.37 * 10.0 ** (-int(d) - 3)!r}, {d}) ELSE round({x} / {unit}) * {unit} END AS {name}" if d else name

        return f"SELECT {', '.join(map(column, self.cols.split()))} FROM ({statement(self.sql)}) AS result"
