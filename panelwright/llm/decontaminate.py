"""Benchmark passages in documents: an exact set join on word shingles, prefix-filtered. DataFrame functions only.

An item's windows (item-sized: ten consecutive words, or the whole of a shorter item) are sets of 3-word shingles.
All documents count how often each shingle of the benchmark occurs, and each window orders its shingles from rare to
frequent. As a window has to be contained whole, a prefix of one shingle is necessary and enough: its rarest one. The
documents' shingles are joined with these prefixes alone. A match tells where the window would lie; it has to lie
inside the document (positional and length bound), and its words are compared one by one.

Windows are broadcast up to a counted number. Beyond it they are joined block by block, each block of that size: documents
are read once more for every block, and neither their shingles nor their words are shuffled, whatever repeats in them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_identity, identity, staged

WINDOW, SHINGLE = 10, 3
BROADCAST_ROWS = 400_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def item_words(text: Column) -> Column:
    """Runs of ASCII letters, digits and whatever is not ASCII, A-Z lower-cased; null gives none."""
    t = F.coalesce(text, F.lit(""))
    low = F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    return F.array_remove(F.split(low, r"[\x00-/:-`{-\x7F]+"), "")


def _shingles(w: Column, size: int) -> Column:
    """Hashes of all runs of size words."""
    some = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(F.lit(size), *(F.get(w, i + k) for k in range(size))))
    return F.when(F.size(w) >= size, some).otherwise(F.array().cast("array<bigint>"))


def _tokens(docs: DataFrame, sizes: list[int], *carried) -> DataFrame:
    """(carried, pos, h) of every shingle of every document; docs has w."""
    return docs.select(*carried, F.explode(F.flatten(F.array(*(F.transform(_shingles(F.col("w"), s), lambda h, i: F.struct(i.alias("pos"), h.alias("h"))) for s in sizes)))).alias("s")).select(*carried, "s.pos", "s.h") if len(sizes) > 1 else docs.select(*carried, F.posexplode(_shingles(F.col("w"), sizes[0])).alias("pos", "h"))


def windows(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(wid, words, item) of every window of every item."""
    w = items.select(F.col(key).cast("string").alias("item"), item_words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    cut = w.withColumn("i", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - WINDOW + 1)))).withColumn("words", F.slice("w", F.col("i"), WINDOW))
    return cut.select(F.md5(F.array_join("words", " ")).alias("wid"), "words", "item").distinct()


def find_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated) of every row of docs.

    Edge cases: a null or empty text has no words and is clean; an item without words has no windows; an item with a
    null key makes words hit but has no name to list; equal rows, which share their work, each get a row, and unlike
    texts of one key each their own; no items, or no documents, give no hits; other columns are ignored. Without items
    the digest is that of an empty text.
    """
    return _judged(docs, items, key, text, item, item_text).drop("th", "tl").withColumnRenamed("k", key)


def _judged(docs: DataFrame, items: DataFrame, key: str, text: str, item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(k, th, tl) and what find_items() tells of every row."""
    base = docs.select(*(c.alias(n) for n, c in identity(key, text).items()), item_words(F.col(text)).alias("w"))
    of = ["k", "th", "tl"]
    named = staged(windows(items, item, item_text), "windows")
    plain = named.select("wid", "words").distinct()
    sizes = sorted(r[0] for r in plain.select(F.least(F.lit(SHINGLE), F.size("words"))).distinct().collect())  # 1 to 3
    counted = base.select(*of, F.size("w").cast("long").alias("n_words"))
    if not sizes:
        hits = counted.limit(0).select(*of, F.lit(0).alias("start"), F.lit(0).alias("size"), F.lit("").alias("wid"))
    else:
        hits = staged(_hits(base, plain, sizes, of), "hits")
    spans = hits.groupBy(*of).agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("spans"))
    # Words under spans in order: each span adds what lies beyond the furthest end so far.
    folded = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")), lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["upto"]))).alias("n"), F.greatest(s["end"], a["upto"]).alias("upto")))
    found = hits.select(*of, "wid").distinct().join(named.select("wid", "item"), "wid").groupBy(*of).agg(F.array_sort(F.collect_set("item")).alias("items"))
    told = spans.select(*of, folded["n"].cast("long").alias("n_hit")).join(found.select(*(F.col(c).alias(f"f_{c}") for c in of), "items"), _same("", "f_", of), "left")
    told = told.select(*(F.col(c).alias(f"t_{c}") for c in of), "n_hit", "items")
    joined = counted.join(told, _same("", "t_", of), "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(*of, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def _same(left: str, right: str, of: list[str]) -> Column:
    c = F.col(f"{left}{of[0]}").eqNullSafe(F.col(f"{right}{of[0]}"))
    for name in of[1:]:
        c = c & (F.col(f"{left}{name}") == F.col(f"{right}{name}"))
    return c


def _hits(base: DataFrame, plain: DataFrame, sizes: list[int], of: list[str]) -> DataFrame:
    """(of, start, size, wid): where windows lie."""
    parts = [plain.filter((F.size("words") == s) if s < SHINGLE else (F.size("words") >= s)).select("wid", "words", F.posexplode(_shingles(F.col("words"), s)).alias("offset", "h")) for s in sizes]
    tokens = parts[0]
    for p in parts[1:]:
        tokens = tokens.unionByName(p)
    tokens = staged(tokens, "shingles")
    counts = _in_blocks(tokens.select("h").distinct(), lambda block: _tokens(base, sizes).join(block, "h", "left_semi").groupBy("h").count())
    # A window with a shingle that no document has is in none.
    ranked = tokens.join(counts, "h", "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("c"), "h", "offset", "words")).alias("r")).filter("r.c > 0")
    prefixes = staged(ranked.select("wid", "r.h", "r.offset", "r.words"), "prefixes")
    start = F.col("pos") - F.col("offset")

    def met(block: DataFrame) -> DataFrame:
        inside = _tokens(base, sizes, *of, "w").join(block, "h").filter((start >= 0) & (start + F.size("words") <= F.size("w")))
        return inside.filter(F.slice("w", start + 1, F.size("words")) == F.col("words")).select(*of, start.alias("start"), F.size("words").alias("size"), "wid")

    return _in_blocks(prefixes, met)


def _in_blocks(rows: DataFrame, work) -> DataFrame:
    """work() of all blocks of rows (h and others), each of which is broadcast: one block up to BROADCAST_ROWS, as many as it takes beyond."""
    n = max(1, -(-rows.count() // BROADCAST_ROWS))
    blocks = [rows.filter(F.pmod(F.xxhash64("h", *(c for c in rows.columns if c == "wid")), F.lit(n)) == i) for i in range(n)] if n > 1 else [rows]
    return reduce(DataFrame.unionByName, [work(F.broadcast(b)) for b in blocks])


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs in which no window of an item lies.

    Rows go by key and text: a clean text stays whatever another one of its key holds. Null keys and texts, equal rows
    and empty tables are as in find_items(); all columns are kept.
    """
    bad, is_bad, _ = by_identity(docs, _judged(docs, items, key, text).filter("contaminated").select("k", "th", "tl").distinct(), key, text)
    return docs.join(bad, is_bad, "left_anti")
