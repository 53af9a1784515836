"""Allow and block rules for urls by host and path.

Each distinct host and path becomes expressions: every suffix of the host at a dot, times every prefix of the path
whose length some rule has. Expressions meet rules in an equi-join on a short hash prefix (32 bits of the digest);
the full digest is compared then, and of the rules left the longest decides. Lengths of rule paths come to the
driver; no rule is longer than a url can usefully be, so they are few. Rules are broadcast up to a checked number and
joined by shuffle beyond; then each rule is copied to all salts and each expression has one, as a rule like a
top-level domain may meet a third of all urls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

BROADCAST_RULES = 200_000
SALTS = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """urls with host, path, rule and verdict, which replace columns of these names.

    rules: (host, path, verdict). A rule fits its host and all subdomains, where the path starts with the rule's. The
    longest host and path together decides, then the longer host, then block. Without a rule, verdict is default.

    Edge cases: a null url, or one without ://, has empty host and path and fits no rule; equal rows each get a row;
    without rules or urls nothing fails; a rule with a null part never fits.
    """
    new = {"host", "path", "rule", "verdict"}
    spark = urls.sparkSession
    plain = urls.drop(*(c for c in urls.columns if c.lower() in new)).withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    facts = rules.dropna(subset=["host", "path", "verdict"]).select(F.translate("host", UPPER, LOWER).alias("rh"), F.col("path").alias("rp"), F.col("verdict").alias("rv")).filter("rh <> ''").withColumn("rd", _digest(F.col("rh"), F.col("rp"))).withColumn("short", _short(F.col("rd")))
    lengths = sorted(r[0] for r in facts.select(F.length("rp")).distinct().collect())
    h, p = unused(urls, "h"), unused(urls, "p")
    distinct = plain.filter("host <> ''").select(F.col("host").alias(h), F.col("path").alias(p)).distinct()
    labels = F.split(h, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    prefixes = F.array(*[F.when(F.length(p) >= n, F.substring(p, 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")
    tried = distinct.withColumn("xh", F.explode(suffixes)).withColumn("xp", F.explode(F.array_compact(prefixes))).withColumn("xd", _digest(F.col("xh"), F.col("xp"))).withColumn("short", _short(F.col("xd")))
    if facts.count() <= BROADCAST_RULES:
        met = tried.join(F.broadcast(facts), "short")
    else:
        salted = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = tried.withColumn("salt", F.pmod(F.xxhash64(h, p), F.lit(SALTS)).cast("int")).join(salted, ["short", "salt"])
    fits = met.filter((F.col("xd") == F.col("rd")) & (F.col("xh") == F.col("rh")) & (F.col("xp") == F.col("rp")))
    rank = F.struct((F.length("rh") + F.length("rp")).alias("n"), F.length("rh").alias("m"), (F.col("rv") == "block").alias("b"), F.concat("rh", "rp").alias("rule"), F.col("rv").alias("verdict"))
    best = fits.groupBy(h, p).agg(F.max(rank).alias("best"))
    joined = plain.join(best, (plain["host"] == best[h]) & (plain["path"] == best[p]), "left")
    return joined.select(*plain.columns, F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
