"""Quality rules for documents, and for hosts by their documents' failures. DataFrame functions only.

A document fails for itself if it has few words or repeats itself. A host's failure rate is its documents' rate,
shrunk towards that of all hosts by a beta prior whose two parameters are fitted to the hosts by moments; documents
of a host whose shrunk rate exceeds the limit are rejected with it. Hosts are counted with partial sums, so a host
with a third of all documents is no large group. Verdicts join back to rows of a few numbers; where whole documents are
filtered, the bad hosts are broadcast up to a counted number, and beyond it a host's documents are dealt to many tasks.

Edge cases: a null text has no words and fails; a null host has no verdict of its own; equal rows each count and
each get a row; one host, or hosts without variance, make the prior as strong as all hosts' documents; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, staged, unused, words

SYMBOLS = "#*$%&|<>"
BROADCAST_HOSTS, SALTS = 500_000, 64


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    Windows are sorted as one long each: a hash in the upper bits, the place in as many lower bits as places need.
    Neighbours with one hash are compared word by word, two places to either side, so that a window of another
    hash value's collision between them does no harm.
    """
    n = F.size(w)
    bits = F.coalesce(F.length(F.bin(n.cast("long"))), F.lit(1))

    def at(x, b):
        return x.bitwiseAND(_shift_left(F.lit(1).cast("long"), b) - 1).cast("int")

    def equal(x, y, b):
        p, q = at(x, b), at(y, b)
        high = _shift_right(x, b) == _shift_right(y, b)
        return F.coalesce(high & (F.get(w, p) == F.get(w, q)) & (F.get(w, p + 1) == F.get(w, q + 1)) & (F.get(w, p + 2) == F.get(w, q + 2)), F.lit(False))

    def covered(keys):
        twice = F.filter(keys, lambda x, j: equal(x, F.get(keys, j - 1), bits) | equal(x, F.get(keys, j + 1), bits) | equal(x, F.get(keys, j - 2), bits) | equal(x, F.get(keys, j + 2), bits))
        places = F.sort_array(F.transform(twice, lambda x: at(x, bits)))
        return let(places, lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))

    keys = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: _shift_left(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), bits).bitwiseOR(i.cast("long"))))
    return F.when(n >= 3, let(keys, covered)).otherwise(0).cast("long")


def _shift_left(x: Column, by: Column) -> Column:
    return F.call_function("shiftleft", x, by)


def _shift_right(x: Column, by: Column) -> Column:
    return F.call_function("shiftrightunsigned", x, by)


def _ruled(docs: DataFrame, text: str, rules: str, min_words: int, max_repeat_percent: int) -> DataFrame:
    """docs and a struct of the counts and base_failed, under a name that docs does not have."""
    t, w = F.coalesce(F.col(text), F.lit("")), unused(docs, "words_of_text")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    counts = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col(w)).alias("n_repeat_words"),
    )
    counted = docs.withColumn(w, words(F.col(text))).select(*docs.columns, counts.alias(rules))
    failed = (F.col(f"{rules}.n_words") < min_words) | (100 * F.col(f"{rules}.n_repeat_words") > max_repeat_percent * F.col(f"{rules}.n_words"))
    return counted.select(*docs.columns, rules, failed.alias(f"{rules}_failed"))


def document_rules(docs: DataFrame, text: str = "text", min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed, which replace columns of these names."""
    rules = unused(docs, "rules")
    ruled = _ruled(docs, text, rules, min_words, max_repeat_percent)
    new = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"}
    return ruled.select(*(c for c in docs.columns if c.lower() not in new), f"{rules}.*", F.col(f"{rules}_failed").alias("base_failed"))


def host_verdicts(judged: DataFrame, host: str = "source", max_rate: float = 0.8) -> DataFrame:
    """(host, documents, failures, rate, host_ok) of every host. judged: rows with host and base_failed, staged."""
    per = judged.filter(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count("*").alias("documents"), F.sum(F.col("base_failed").cast("long")).alias("failures"))
    alpha, beta = beta_prior(per)
    rate = (F.col("failures") + F.lit(alpha)) / (F.col("documents") + F.lit(alpha + beta))
    return per.withColumn("rate", rate).withColumn("host_ok", F.col("rate") <= max_rate)


def beta_prior(per: DataFrame) -> tuple[float, float]:
    """Moments of the hosts' rates, less what sampling adds to their variance; one row comes to the driver."""
    r = F.col("failures") / F.col("documents")
    m = per.agg(F.sum("failures").alias("f"), F.sum("documents").alias("n"), F.var_pop(r).alias("v"), F.avg(1 / F.col("documents")).alias("s")).first()
    n = m["n"] or 0
    mean = ((m["f"] or 0) + 0.5) / (n + 1)
    between = (m["v"] or 0.0) - mean * (1 - mean) * (m["s"] or 0.0)
    strength = max(1.0, min(float(max(n, 1)), mean * (1 - mean) / between - 1 if between > 0 else float("inf")))
    return mean * strength, (1 - mean) * strength


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", max_rate: float = 0.8) -> DataFrame:
    """A row per document: key, its counts, base_failed and kept."""
    judged = staged(document_rules(docs.select(F.col(key), F.col(host), F.col(text)), text).drop(text), "quality")
    bad = host_verdicts(judged, host, max_rate).filter(~F.col("host_ok")).select("host", F.lit(True).alias("host_failed"))
    joined = judged.join(bad, judged[host] == bad["host"], "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("host_failed").isNull()).drop("host", "host_failed", host)


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = 0.8) -> DataFrame:
    """The rows of docs that pass both rules, with their own columns."""
    rules, columns = unused(docs, "rules"), docs.columns
    judged = staged(_ruled(docs, text, rules, 50, 50).drop(rules), "judged")
    bad = staged(host_verdicts(judged.select(F.col(host), F.col(f"{rules}_failed").alias("base_failed")), host, max_rate).filter(~F.col("host_ok")).select(F.col("host").alias(rules)), "bad-hosts")
    good = judged.filter(~F.col(f"{rules}_failed")).drop(f"{rules}_failed")
    if bad.count() <= BROADCAST_HOSTS:
        return good.join(F.broadcast(bad), good[host] == bad[rules], "left_anti").select(*columns)
    # Beyond that a host's documents are dealt to SALTS tasks, so that none gets all of a large host.
    salt = unused(docs, "salt")
    salted = bad.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = good.withColumn(salt, F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, (dealt[host] == salted[rules]) & (dealt[salt] == salted[salt]), "left_anti").select(*columns)
