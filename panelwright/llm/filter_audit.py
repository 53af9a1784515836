"""What each of several filters removes, redundantly or alone, in every order that they could be applied in.

Each document's failures are a mask. Documents are counted by part and mask, so that what follows works on as many rows
as masks a part: with an order's inverse permutation, the position of each filter, as a column of a matrix, the min-plus
product of masks (0 where a mask fails a filter, infinite elsewhere) and positions is the step in which each mask is
removed in each order. Weighted counts scattered by that step are the removals; what fails the step's filter and went
earlier is redundant.

Failing for a copy does not take a window over copies: a text's other failures are its own, so copies are counted by
part and label, and the smallest id of a text joins narrow rows, large groups by a broadcast of bounded size.
"""

from __future__ import annotations

import hashlib
from itertools import permutations
from math import inf

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import large_limit, slices, staged, with_groups

FILTERS = "ABCDE"
UPPER, SIGNS = bytes(range(65, 91)), b"#$%&*|"
STEPS = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def failures(text: bytes, points: int) -> int:
    """The mask of A to D, A in the lowest bit, of a text of so many code points in UTF-8."""
    words = text.split()  # of bytes: the space and 0x09-0x0D split
    a = len(words) < 200
    b = 100 * len(set(words)) < 50 * len(words)
    c = 100 * (len(text) - len(text.translate(None, UPPER))) > 3 * points
    d = len(text.translate(None, SIGNS)) < len(text)
    return a | b << 1 | c << 2 | d << 3


def masks(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(k, part, mask, sha) of every row; mask has A to D only, sha is the text's SHA-256. Null texts are empty ones."""
    kind = docs.schema[key].dataType.simpleString()

    def marked(batches):
        for b in batches:
            texts = b.column("t").cast(pa.large_binary())
            points = pc.utf8_length(b.column("t"))
            for start, n in slices(texts):
                some = [x.as_py() for x in texts.slice(start, n)]
                found = [failures(t, p) for t, p in zip(some, points.slice(start, n).to_pylist(), strict=True)]
                shas = [hashlib.sha256(t).digest() for t in some]
                at = b.slice(start, n)
                yield pa.record_batch([at.column("k"), at.column("part"), pa.array(found, pa.int32()), pa.array(shas, pa.binary())], ["k", "part", "mask", "sha"])

    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return rows.mapInArrow(marked, f"k {kind}, part string, mask int, sha binary")


def counted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and whole mask, and how many of them are labelled so."""
    rows = staged(masks(docs, key, text, part), "masks")
    texts = staged(rows.groupBy("sha").agg(F.min("k").alias("least"), F.count("*").alias("copies")), "texts")
    led = with_groups(rows, texts, ["sha"], "copies", large_limit(rows))
    whole = led.select("k", "part", F.when(F.col("k") > F.col("least"), F.col("mask") + 16).otherwise(F.col("mask")).alias("mask"))
    told = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("of")).agg(*(F.max((F.col(c) == 1).cast("long")).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))))
    return whole.join(told, whole["k"] == told["of"], "left").groupBy("part", "mask").agg(F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("good", "toxic")))


def removal_steps(mask: np.ndarray, filters: int, orders: list[tuple[int, ...]]) -> np.ndarray:
    """Masks x orders: the step, from 1, in which each mask is removed; infinite for those that fail nothing."""
    place = np.empty((filters, len(orders)))
    for o, order in enumerate(orders):
        place[list(order), o] = np.arange(1, filters + 1)  # the inverse permutation
    fails = np.where(mask[:, None] >> np.arange(filters) & 1, 0.0, inf)
    steps = np.full((len(mask), len(orders)), inf)
    for f in range(filters):  # the min-plus product
        np.minimum(steps, fails[:, f, None] + place[f], out=steps)
    return steps


def interactions(mask: np.ndarray, n: np.ndarray, good: np.ndarray, toxic: np.ndarray, filters: str = FILTERS):
    """(filter_order, step, the seven counts) for one part's masks and their documents, as columns."""
    orders = list(permutations(range(len(filters))))
    steps, size = removal_steps(mask, len(filters), orders), len(filters) + 2
    at = np.where(np.isinf(steps), size - 1, steps).astype(np.int64) + size * np.arange(len(orders))
    scattered = lambda w: np.bincount(at.ravel(), np.repeat(w, len(orders)), size * len(orders)).reshape(-1, size).astype(np.int64)
    exact = lambda w: sum(scattered(np.float64(w >> s & 0xFFFFFF)) << s for s in (0, 24, 48))  # noqa: E731 - whole beyond 2**53
    removed = exact(n)
    kept = n.sum() - np.cumsum(removed[:, 1:-1], axis=1)
    letter = np.array(orders)
    failing = np.array([n[mask >> f & 1 == 1].sum() for f in range(len(filters))])
    alone = np.array([n[mask == 1 << f].sum() for f in range(len(filters))])
    gone = removed[:, 1:-1]
    shapley = np.array([gone[letter == f].sum() for f in range(len(filters))])
    every = [kept, gone, failing[letter] - gone, alone[letter], exact(good)[:, 1:-1], exact(toxic)[:, 1:-1], shapley[letter]]
    names = np.repeat(["".join(filters[f] for f in o) for o in orders], len(filters))
    return names, np.tile(np.arange(1, len(filters) + 1), len(orders)), [x.ravel() for x in every]


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows a part.

    Edge cases: a null text is an empty one, a null part the empty string; a null key is smaller than none and has no
    label, so it fails for no copy; rows that repeat a key do not fail for each other; of several labels of a key, one
    that is 1 counts; a part is there if a document has it; an empty table has no parts; other columns are ignored.
    """

    def parts(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)  # counts: 2 ** filters rows a part at most
        names = np.array(rows.column("part").to_pylist(), object)
        mask, n, good, toxic = (rows.column(c).to_numpy() for c in ("mask", "n", "good", "toxic"))
        for name in sorted(set(names)):
            own = names == name
            order, step, columns = interactions(mask[own], n[own], good[own], toxic[own])
            yield pa.record_batch([pa.array([name] * len(step), pa.string()), pa.array(order.tolist(), pa.string()), pa.array(step, pa.int32()), *(pa.array(c, pa.int64()) for c in columns)], ["part", "filter_order", "step", *STEPS])

    rows = counted(docs, labels, key, text, part).repartition("part")
    return rows.mapInArrow(parts, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in STEPS))
