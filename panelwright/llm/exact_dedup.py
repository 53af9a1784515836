"""Exact dedup by an extendible-hash index on shared files. DataFrame functions only.

A text's key is the XXH64 of its normalised form. The directory has a slot for each value of a key's upper bits: a
bucket that holds more than `capacity` bytes of text is split by the next bit, which doubles the directory where the
bucket had one slot; the loads of all buckets after 0, 1, 2, ... doublings are one aggregation, and a bucket ends at the
first doubling after which it is not overfull. Keys that equal in all bits of the deepest directory share a bucket,
whatever its load.
Texts are dealt to the tasks that own them: an owner has a range of keys, whole buckets of it. Inside its task texts
are grouped by bucket, key and their own bytes: equal keys with other bytes are chained, as entries of one key with
numbers from 0. Entries (bucket, key, number, SHA-256, bytes, smallest id, copies) and directory are Parquet files in
the shared folder; the texts are not kept.
Copies of a text that is met often are combined where they are read, by key and bytes, so that no owner gets a large
group of copies; documents find such entries by a broadcast of at most MOST_GROUPS rows, and others by a join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import large_limit, staged, unused, with_groups

#: Bytes of text in a bucket, doublings at most, and bytes that an owner should have.
CAPACITY, DEEPEST, OWNED = 1 << 20, 20, 64 << 20


def normal(text: Column) -> Column:
    """Runs of spaces and of 0x09-0x0D as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t-\\r]{2,}|[\\t-\\r]", " ")


def upper_bits(key: str, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


@dataclass(frozen=True)
class Index:
    """rows: (k, h, n, sha) of every document. directory: (slot, bucket, depth, owner), 2 ** depth slots. entries: (bucket, h, chain, sha, n, first, copies)."""

    rows: DataFrame
    directory: DataFrame
    entries: DataFrame
    depth: int


def directory(keys: DataFrame, owners: int, capacity: int = CAPACITY, deepest: int = DEEPEST) -> tuple[DataFrame, int]:
    """(slot, bucket, depth, owner) and the number of doublings. keys: (h, load), h once.

    The directory has 2 ** deepest slots at most: where buckets of `capacity` would need more, they get larger.
    """
    total = int(keys.agg(F.sum("load")).first()[0] or 0)
    capacity = max(capacity, total >> (deepest - 2))
    bits = min(deepest, max(1, total // capacity).bit_length() + 3)
    cells = keys.groupBy(upper_bits("h", bits).alias("cell")).agg(F.sum("load").alias("load"))
    each = cells.select("load", F.explode(F.transform(F.sequence(F.lit(0), F.lit(bits)), lambda d: F.struct(d.alias("depth"), F.call_function("shiftright", F.col("cell"), F.lit(bits) - d).alias("prefix")))).alias("at"))
    nodes = staged(each.groupBy("at.depth", "at.prefix").agg(F.sum("load").alias("load")), "doublings")
    full = nodes.filter((F.col("load") > capacity) & (F.col("depth") < bits)).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("half"))
    split = nodes.withColumn("half", F.shiftright("prefix", 1)).join(full, ["depth", "half"], "left_semi").drop("half")
    buckets = nodes.filter("depth = 0").select("depth", "prefix", "load").unionByName(split).filter((F.col("load") <= capacity) | (F.col("depth") == bits))
    buckets = staged(buckets, "buckets")
    depth = buckets.agg(F.max("depth")).first()[0] or 0
    rest = F.lit(depth) - F.col("depth")
    first = F.call_function("shiftleft", F.col("prefix"), rest)
    bucket = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("depth")) + F.col("prefix")  # a number for each (depth, prefix)
    owner = F.shiftright(first * owners, depth).cast("int")
    slots = F.sequence(first, first + F.call_function("shiftleft", F.lit(1).cast("long"), rest) - 1)
    return staged(buckets.select(bucket.alias("bucket"), "depth", owner.alias("owner"), F.explode(slots).alias("slot")), "directory"), depth


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, hashed: Callable[[Column], Column] = F.xxhash64) -> Index:
    """The index of all texts of docs, in the shared folder."""
    t = normal(F.col(text))
    read = docs.select(F.col(key).alias("k"), t.alias("t")).withColumn("h", hashed(F.col("t")))
    rows = staged(read.select("k", "h", F.octet_length("t").cast("long").alias("n"), F.sha2("t", 256).alias("sha")), "keys")
    limit = large_limit(rows)
    keys = staged(rows.groupBy("h").agg(F.count("*").alias("copies"), F.max("n").alias("n")), "counted")
    loads = keys.select("h", (F.least("copies", F.lit(limit)) * F.greatest("n", F.lit(64))).alias("load"))
    total = int(loads.agg(F.sum("load")).first()[0] or 0)
    owners = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // OWNED))
    slots, depth = directory(loads, owners, capacity)
    often = keys.filter(F.col("copies") > limit).select("h", F.lit(True).alias("often"))
    met = read.join(F.broadcast(often), "h", "left")
    one = lambda df, *by: df.groupBy(*by, "h", "t").agg(F.min("first").alias("first"), F.sum("copies").alias("copies"))
    single = met.select("h", "t", F.col("k").alias("first"), F.lit(1).cast("long").alias("copies"), "often")
    apart = single.filter("often is null").drop("often").unionByName(one(single.filter("often"), *[]))
    dealt = apart.withColumn("slot", upper_bits("h", depth)).join(F.broadcast(slots), "slot").repartitionById(owners, F.col("owner"))
    texts = one(dealt, "owner", "bucket").select("owner", "bucket", "h", F.sha2("t", 256).alias("sha"), F.octet_length("t").cast("long").alias("n"), "first", "copies")
    chained = texts.withColumn("chain", F.expr("row_number() over (partition by owner, bucket, h order by n, sha) - 1"))
    return Index(rows, slots, staged(chained.select("bucket", "h", "chain", "sha", "n", "first", "copies"), "entries"), depth)


def find(index: Index, docs: DataFrame, key: str = "doc_id", text: str = "text", hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(key, bucket, chain, first, copies) of documents that need not be in the index: null where it has no equal text."""
    asked = docs.select(F.col(key).alias("k"), normal(F.col(text)).alias("t")).select("k", hashed(F.col("t")).alias("h"), F.sha2("t", 256).alias("sha"))
    slots = F.broadcast(index.directory.select("slot", F.col("bucket").alias("of")))
    led = with_groups(asked, index.entries, ["h", "sha"], "copies", large_limit(asked), least=1)
    return led.withColumn("slot", upper_bits("h", index.depth)).join(slots, "slot", "left").select(F.col("k").alias(key), F.col("of").alias("bucket"), "chain", "first", "copies")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) of every row of docs.

    Edge cases: a null text is an empty one; texts of white space alone equal one space, not the empty text; a null key
    is smaller than no key, and keeps its row only where all of its group are null; rows with the group's smallest key
    are kept, all of them where a row is repeated; an empty table gives an empty result; other columns are ignored.
    Two different texts with one SHA-256 are an error, as documents find their entry by key and digest.
    """
    index = build(docs, key, text, capacity, hashed)
    if not index.entries.groupBy("h", "sha").count().filter("count > 1").isEmpty():
        raise ValueError("two different texts have one SHA-256")
    led = with_groups(index.rows.select("k", "h", "sha"), index.entries.select("h", "sha", "first", "copies"), ["h", "sha"], "copies", large_limit(index.rows))
    keep = F.when(F.col("copies").isNull(), F.col("k")).otherwise(F.col("first"))
    return led.withColumn("keep_id", keep).select(F.col("k").alias(key), "keep_id", F.coalesce("copies", F.lit(1)).cast("long").alias("group_size"), F.col("k").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows whose text a smaller key has; rows equal in key and text go but for one."""
    mark, digest = unused(docs, "kept_key"), unused(docs, "digest")
    kept = groups(docs, key, text).filter("kept").select(F.col(key).alias(mark), F.col("text_sha256").alias(digest)).distinct()
    sha = F.sha2(normal(F.col(text)), 256)
    left = docs.withColumn(f"_{digest}", sha).join(kept, F.col(key).eqNullSafe(F.col(mark)) & (F.col(f"_{digest}") == F.col(digest)), "left_semi")
    return left.dropDuplicates([key, f"_{digest}"]).drop(f"_{digest}")
