"""What several operators share: tables, staging in the shared folder, joins on skewed keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import drop_scratch, scratch, shared_dir, staged  # noqa: F401 - for the operators


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def identity(key: str, text: str) -> dict[str, Column]:
    """What tells a row from others of its key: (k, th, tl), its key, its text's hash and length, which is -1 for a null text.

    Rows that agree in all three are equal in key and text, and count as one document.
    """
    return {"k": F.col(key), "th": F.xxhash64(text), "tl": F.coalesce(F.length(text), F.lit(-1))}


def by_identity(docs: DataFrame, rows: DataFrame, key: str, text: str) -> tuple[DataFrame, Column, list[str]]:
    """rows (k, th, tl and others) under names that docs does not have, the condition that a row of docs is one of them, and the three names."""
    names = [unused(docs, f"of_{c}") for c in ("k", "th", "tl")]
    renamed = rows.select(*(F.col(c).alias(n) for c, n in zip(("k", "th", "tl"), names, strict=True)), *(c for c in rows.columns if c not in ("k", "th", "tl")))
    own = identity(key, text)
    return renamed, own["k"].eqNullSafe(renamed[names[0]]) & (own["th"] == renamed[names[1]]) & (own["tl"] == renamed[names[2]]), names


def words(text: Column) -> Column:
    """Runs of what is not a space or control white space (0x09-0x0D); null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), "")


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def slices(texts: pa.Array, size: int = 4_000_000):
    """(start, length) of runs of texts of some bytes each, one text at least."""
    ends, start = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while start < len(ends):
        upto = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, "right")))
        yield start, upto - start
        start = upto


#: Groups that are broadcast at most, and rows from which a group may count as large.
MOST_GROUPS, LARGE_GROUP = 100_000, 256


def large_limit(rows: DataFrame) -> int:
    """Rows beyond which a group of rows is large: no table has more than MOST_GROUPS such groups."""
    return max(LARGE_GROUP, -(-rows.count() // MOST_GROUPS))


def with_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, limit: int, least: int = 2, how: str = "left") -> DataFrame:
    """rows with the columns of groups (one row for each `on`), null where no group of `least` rows or more has theirs; how="inner" leaves those out.

    Groups of more than `limit` rows, of which large_limit() bounds the number, are broadcast, so that their rows stay
    where they are; the other rows meet theirs in a join whose keys have `limit` rows at most.
    """
    new = [c for c in groups.columns if c not in on]
    large = F.broadcast(groups.filter(F.col(size) > limit))
    others = groups.filter((F.col(size) <= limit) & (F.col(size) >= least))
    return rows.join(large, on).select(*rows.columns, *new).unionByName(rows.join(large, on, "left_anti").join(others, on, how).select(*rows.columns, *new))
