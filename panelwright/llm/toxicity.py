"""Toxicity by class-conditional Kneser-Ney models of words and of the characters of words.

Models of words give each word a probability by its count in a class's training texts, discounted; what the discount
frees, in proportion to the number of different words of the class, goes to the words of both classes by their
counts together, a word that neither has met counting as half an occurrence. So a rare word's ratio is near that of any
unknown one, whose ending and stem the characters tell.

Two further models, of toxic and of ordinary documents, give each character of a word (and its end) a probability after the
characters before it, four at most. Longest runs, and those from a word's beginning, have their counts in each
class's training texts; a shorter run has the number of different characters that the class has seen before it, its
continuation count. Counts are discounted, and what the discount frees of a context, in proportion to the number of different
characters seen after it, goes to the next shorter run. From pairs down the counts are those of both classes
together, so where neither class knows a rare expression's longer runs both give it the same probability.

Counts cover all runs of all words of all labelled training rows but for the calibration sample's; they are rows of a
table that grows with the input, and so are the models: a run's log ratio of the two probabilities, a context's log
ratio of the two weights of backing off. A word's log-likelihood ratio is the sum over its characters. To score, each
different word of a batch is looked up once, in the models as arrays if their rows are at most `broadcast`, else in a
join of the different words' runs with the table, after which documents meet their words' ratios chunk by chunk.

A document's evidence, by either kind of model, is its log-likelihood ratio divided by its length in characters or words,
the same in its most toxic window of words, and of its few most toxic words. A logistic regression over these, fitted to a bounded sample of
training rows that are kept out of the counts, makes the score.

Edge cases: null and empty texts are scored by the evidence of no word; equal rows each count and each get a row;
without rows of both classes the ratios are what one model against nothing gives and the score is the calibration's
share, 0.5 without any row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, staged
from .flat import DIGIT, LETTER, SIGN, SPACE, Rows, hashes, kinds, runs

#: Rows that calibrate, the share of training rows that they are taken from, and what counts lose to shorter runs.
SAMPLE, SHARE, DISCOUNT = 2_000, 5, 0.75
#: Characters of the longest run, bits of a character, and the longest run that both classes count together.
ORDER, BITS, SHARED = 5, 12, 2
BROADCAST_LABELS, BROADCAST_RUNS, CHUNK = 2_000_000, 4_000_000, 1024
TOP, WINDOW = 4, 8
KINDS, EVIDENCE = 2, 2 + TOP
START, END = 1, 2
_LETTERS = kinds()
_LETTERS[_LETTERS == DIGIT], _LETTERS[_LETTERS == SIGN] = LETTER, SPACE


def mask(k: int) -> int:
    return (1 << (BITS * k)) - 1


class Words:
    """The words of texts (runs of letters and digits, lower-cased): which one of the different ones stands at each place."""

    def __init__(self, texts: pa.Array):
        self.data, self.a, self.b, self.upto = runs(pc.utf8_lower(texts), _LETTERS)
        self.hashes, first, self.which = np.unique(hashes(self.data, self.a, self.b), return_index=True, return_inverse=True)
        self.a1, self.b1 = self.a[first], self.b[first]

    def strings(self) -> list[str]:
        return [self.data[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(self.a1.tolist(), self.b1.tolist(), strict=True)]


def characters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every character of every word, and of its end: the run that ends there, that run's length, and which word it is.

    A run is a number with BITS bits a character, the last one lowest. Digits are one character, and characters beyond
    the first 2^BITS share codes.
    """
    text = np.frombuffer("".join(f"{chr(START)}{w}{chr(END)}" for w in words).encode("utf-32-le", "replace"), np.uint32)
    code = np.where(text < 1 << BITS, text, 3 + text % ((1 << BITS) - 3)).astype(np.int64)
    code[(text >= 48) & (text < 58)] = 48
    word = np.cumsum(text == START) - 1
    inside = np.arange(len(text)) - np.flatnonzero(text == START)[word] if len(text) else np.zeros(0, np.int64)
    run = code.copy()
    for j in range(1, ORDER):
        run[j:] |= np.where(inside[j:] >= j, code[:-j] << (BITS * j), 0)
    at = text != START
    return run[at], np.minimum(inside[at] + 1, ORDER), word[at]


def _counted(batches):
    """(word, run, n0, n1): how often each class has each longest run, and each word by its hash, summed over some texts at a time."""
    for batch in batches:
        texts, toxic = batch.column("t"), batch.column("y").to_numpy()
        for first, some in slices(texts, 6_000_000):
            words = Words(texts.slice(first, some))
            y = np.repeat(toxic[first : first + some], np.diff(words.upto)) == 1
            n = len(words.hashes)
            run, _, word = characters(words.strings())
            u, back = np.unique(run, return_inverse=True)
            times = [np.bincount(words.which[y == c], minlength=n) for c in (False, True)]
            of_runs = [np.bincount(back, t[word], len(u)) for t in times]
            counts = [pa.array(np.concatenate([a, b]).astype(np.int64)) for a, b in zip(of_runs, times, strict=True)]
            run = np.concatenate([u, words.hashes.view(np.int64)])
            yield pa.record_batch([pa.array(np.arange(len(run)) >= len(u)), pa.array(run), *counts], ["word", "run", "n0", "n1"])


def _levels(counts: DataFrame) -> dict[int, DataFrame]:
    """Runs by length with counts n0, n1 of the classes and ns of both: of longest runs and those from a word's beginning as met, of others by continuation."""
    length = reduce(lambda a, k: F.when(F.col("run") > mask(k), k + 1).otherwise(a), range(1, ORDER), F.lit(1))
    top = staged(counts.groupBy("run").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).withColumn("length", length), "runs")
    of = lambda k: top.filter(F.col("length") == k).select("run", "n0", "n1", (F.col("n0") + F.col("n1")).alias("ns"))
    levels = {ORDER: of(ORDER)}
    for k in range(ORDER - 1, 0, -1):
        seen = levels[k + 1].groupBy(F.col("run").bitwiseAND(F.lit(mask(k))).alias("run"))
        levels[k] = staged(seen.agg(F.count_if(F.col("n0") > 0).alias("n0"), F.count_if(F.col("n1") > 0).alias("n1"), F.count("*").alias("ns")).unionByName(of(k)), f"runs{k}")
    return levels


def models(counts: DataFrame, discount: float = DISCOUNT) -> DataFrame:
    """(run, lr, bw): of runs longer than SHARED log(toxic / ordinary probability) of the last character after the others; of contexts log(toxic / ordinary weight) of backing off."""
    levels, context = _levels(counts), F.shiftright("run", BITS)
    one = levels[1]
    share = F.col("ns") / F.lit(one.agg(F.sum("ns")).first()[0] or 1)
    below = one.select("run", share.alias("p0"), share.alias("p1"))
    found, weights = [], []
    for k in range(2, ORDER + 1):
        n = ("ns", "ns") if k <= SHARED else ("n0", "n1")
        sums = levels[k].groupBy(context.alias("context")).agg(*(f.alias(f"{name}{c}") for c in (0, 1) for name, f in (("a", F.sum(n[c])), ("m", F.count_if(F.col(n[c]) > 0)))))
        weight = lambda c: F.when(F.col(f"a{c}") > 0, discount * F.col(f"m{c}") / F.col(f"a{c}")).otherwise(1.0)
        sums = sums.select("context", "a0", "a1", weight(0).alias("w0"), weight(1).alias("w1"))
        p = lambda c: F.when(F.col(f"a{c}") > 0, F.greatest(F.col(n[c]) - discount, F.lit(0.0)) / F.col(f"a{c}")).otherwise(0.0) + F.col(f"w{c}") * F.col(f"p{c}")  # noqa: B023, E731
        met = levels[k].withColumns({"context": context, "rest": F.col("run").bitwiseAND(F.lit(mask(k - 1)))})
        met = met.join(sums, "context").join(below.select(F.col("run").alias("rest"), "p0", "p1"), "rest")
        below = staged(met.select("run", p(0).alias("p0"), p(1).alias("p1")), f"model{k}")
        if k > SHARED:
            found.append(below.select("run", F.ln(F.col("p1") / F.col("p0")).alias("lr"), F.lit(None).cast("double").alias("bw")))
            weights.append(sums.select(F.col("context").alias("run"), F.lit(None).cast("double").alias("lr"), F.ln(F.col("w1") / F.col("w0")).alias("bw")))
    rows = reduce(DataFrame.unionByName, [*found, *weights])
    return staged(rows.groupBy("run").agg(F.max("lr").alias("lr"), F.max("bw").alias("bw")), "models")


def word_models(counts: DataFrame, discount: float = DISCOUNT) -> tuple[DataFrame, float]:
    """(run, lr): log(toxic / ordinary probability) of words by their hashes, from (run, n0, n1), run once; and that of any other word."""
    n = counts.agg(*(f(c).alias(f"{k}{i}") for i, c in enumerate(("n0", "n1")) for k, f in (("a", F.sum), ("m", lambda c: F.count_if(F.col(c) > 0)))), F.count("*").alias("v")).first()
    a, m = [n["a0"] or 0, n["a1"] or 0], [n["m0"] or 0, n["m1"] or 0]
    every = a[0] + a[1] + 0.5 * (n["v"] + 1)
    shared = (F.col("n0") + F.col("n1") + 0.5) / every
    p = lambda c: (F.greatest(F.col(f"n{c}") - discount, F.lit(0.0)) + discount * m[c] * shared) / a[c] if a[c] else shared
    free = [discount * m[c] / a[c] if a[c] else 1.0 for c in (0, 1)]
    return staged(counts.select("run", F.ln(p(1) / p(0)).alias("lr")), "words"), float(np.log(free[1] / free[0]))


class WordRatios:
    """The models of words as an array over their hashes."""

    def __init__(self, run: np.ndarray, lr: np.ndarray, unknown: float):
        self.rows = Rows()
        self.rows.add(run.view(np.uint64))
        self.lr = np.append(lr, unknown)

    def of(self, hashes_: np.ndarray) -> np.ndarray:
        return self.lr[self.rows.of(hashes_)]


class Ratios:
    """The models of characters as arrays over runs."""

    def __init__(self, run: np.ndarray, lr: np.ndarray, bw: np.ndarray):
        self.rows = Rows()
        self.rows.add(run.astype(np.uint64))
        # The last row is that of runs that no class has seen.
        self.lr, self.bw = np.append(lr, np.nan), np.nan_to_num(np.append(bw, 0.0))

    def of(self, words: list[str]) -> np.ndarray:
        """The log-likelihood ratio of each word."""
        run, length, word = characters(words)
        out, left = np.zeros(len(run)), np.arange(len(run))
        for k in range(ORDER, SHARED, -1):
            at = left[length[left] >= k]
            key = run[at] & mask(k)
            lr = self.lr[self.rows.of(key.astype(np.uint64))]
            known = ~np.isnan(lr)
            out[at[known]] += lr[known]
            out[at[~known]] += self.bw[self.rows.of((key[~known] >> BITS).astype(np.uint64))]
            left = np.concatenate([at[~known], left[length[left] < k]])
        return np.bincount(word, out, len(words))


def evidence(words: Words, ratio: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each text: the ratio by length, that of its most toxic window, and the mean ratios of its few most toxic words; ratio and sizes are of the different words."""
    upto, texts = words.upto, len(words.upto) - 1
    out, n = np.zeros((texts, EVIDENCE)), np.diff(upto)
    r = ratio[words.which]
    sums, lengths = np.concatenate([[0.0], np.cumsum(r)]), np.concatenate([[0], np.cumsum(sizes[words.which])])
    some = np.flatnonzero(n)
    out[some, 0] = (sums[upto[some + 1]] - sums[upto[some]]) / (lengths[upto[some + 1]] - lengths[upto[some]])
    out[some, 1] = (sums[upto[some + 1]] - sums[upto[some]]) / WINDOW
    wide = np.flatnonzero(n >= WINDOW)
    if len(wide):
        windows = sums[WINDOW:] - sums[:-WINDOW]
        ends = np.stack([upto[wide], upto[wide + 1] - WINDOW + 1], axis=1).ravel()
        if ends[-1] == len(windows):
            ends = ends[:-1]
        out[wide, 1] = np.maximum.reduceat(windows, ends)[::2] / WINDOW
    at = np.flatnonzero(r > 0)
    text = np.repeat(np.arange(texts), n)[at]
    pair = np.unique(text * len(ratio) + words.which[at]) if len(at) else np.zeros(0, np.int64)
    text, r = pair // max(1, len(ratio)), ratio[pair % max(1, len(ratio))]
    order = np.lexsort([-r, text])
    text, r = text[order], r[order]
    place = np.arange(len(text)) - np.searchsorted(text, text)
    best = np.zeros((texts, TOP))
    best[text[place < TOP], place[place < TOP]] = r[place < TOP]
    out[:, 2:] = np.cumsum(best, axis=1) / np.arange(1, TOP + 1)
    return out


class Calibration:
    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1e-3):
        self.mean, self.scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (0.0, 1.0)
        z = self._z(x)
        self.b = np.zeros(z.shape[1])
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        self.b[0] = np.log(share / (1 - share))
        for _ in range(30 if len(y) and y.min() != y.max() else 0):
            p = 1 / (1 + np.exp(-np.clip(z @ self.b, -30, 30)))
            grad = z.T @ (p - y) / len(y) + ridge * np.r_[0, self.b[1:]]
            hess = (z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(len(self.b))
            self.b -= np.linalg.solve(hess, grad)

    def _z(self, x):
        return np.hstack([np.ones((len(x), 1)), np.clip((x - self.mean) / self.scale, -8, 8)])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._z(x) @ self.b, -30, 30)))


@dataclass
class Fitted:
    table: DataFrame  # run, lr, bw of characters
    words: DataFrame  # run, lr of words
    unknown: float  # lr of other words
    calibration: Calibration | None
    broadcast: int

    def evidence(self, rows: DataFrame, key: str, kind: str) -> DataFrame:
        """(key, x): the evidence of every row of rows (key, t)."""
        few = sum(t.limit(self.broadcast + 1).count() for t in (self.table, self.words)) <= self.broadcast
        return (_by_arrays if few else _by_join)(rows, self, key, kind)


def _rows_of(key: pa.Array, words: Words, ratio: np.ndarray, whole: np.ndarray, name: str) -> pa.RecordBatch:
    """The evidence by characters, per character, and by words, per word."""
    x = np.hstack([evidence(words, ratio, words.b1 - words.a1 + 1), evidence(words, whole, np.ones(len(whole), np.int64))])
    return pa.record_batch([key, pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), KINDS * EVIDENCE).cast(pa.list_(pa.float64()))], [name, "x"])


def _by_arrays(rows: DataFrame, fitted: Fitted, key: str, kind: str) -> DataFrame:
    table, told, unknown = fitted.table, fitted.words.select("run", F.col("lr").cast("float")).toArrow(), fitted.unknown
    got = table.select("run", F.col("lr").cast("float"), F.col("bw").cast("float")).toArrow()
    column = lambda c: got.column(c).to_numpy()
    # at most 16 bytes times `broadcast`
    shared = rows.sparkSession.sparkContext.broadcast(((column("run"), column("lr"), column("bw")), (told.column("run").to_numpy(), told.column("lr").to_numpy(), unknown)))

    def work(batches):
        ratios, whole = Ratios(*shared.value[0]), WordRatios(*shared.value[1])
        for b in batches:
            for first, some in slices(b.column("t")):
                words = Words(b.column("t").slice(first, some))
                yield _rows_of(b.column(key).slice(first, some), words, ratios.of(words.strings()), whole.of(words.hashes), key)

    return rows.mapInArrow(work, f"`{key}` {kind}, x array<double>")


def _by_join(rows: DataFrame, fitted: Fitted, key: str, kind: str) -> DataFrame:
    """As _by_arrays(), for models of any size."""
    table, unknown = fitted.table, fitted.unknown

    def told(batches):
        for b in batches:
            for first, some in slices(b.column("t")):
                words = Words(b.column("t").slice(first, some))
                yield pa.record_batch([pa.array(words.hashes.view(np.int64)), pa.array(words.strings())], ["h", "word"])

    def needed(batches):
        for b in batches:
            run, length, word = characters(b.column("word").to_pylist())
            h = b.column("h").to_numpy()
            for k in range(ORDER, SHARED, -1):
                at = np.flatnonzero(length >= k)
                one = run[at] & mask(k)
                yield pa.record_batch([pa.array(h[word[at]]), pa.array(at), pa.array(np.full(len(at), k, np.int32)), pa.array(one), pa.array(one >> BITS)], ["h", "place", "k", "one", "context"])

    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64(*rows.columns), F.lit(max(1, -(-rows.count() // CHUNK)))).cast("int"))
    words = rows.mapInArrow(told, "h long, word string").dropDuplicates(["h"])
    asked = words.repartition("h").mapInArrow(needed, "h long, place long, k int, one long, context long")
    lr, bw = table.select(F.col("run").alias("one"), "lr").dropna(), table.select(F.col("run").alias("context"), "bw").dropna()
    met = asked.join(lr, "one", "left").join(bw, "context", "left")
    # From the longest run down: the first one known ends the sum, and each that is not adds its context's weight.
    known = F.aggregate(F.reverse(F.array_sort("steps")), F.struct(F.lit(0.0).alias("r"), F.lit(False).alias("done")), lambda a, s: F.struct(F.when(a["done"], a["r"]).otherwise(a["r"] + F.coalesce(s["lr"], s["bw"], F.lit(0.0))).alias("r"), (a["done"] | s["lr"].isNotNull()).alias("done")))
    ratio = met.groupBy("h", "place").agg(F.collect_list(F.struct("k", "lr", "bw")).alias("steps")).groupBy("h").agg(F.sum(known["r"]).alias("r"))
    ratio = ratio.join(fitted.words.select(F.col("run").alias("h"), F.col("lr").alias("w")), "h", "left").withColumn("w", F.coalesce("w", F.lit(unknown)))
    in_chunk = dealt.select("chunk", "t").mapInArrow(_chunk_words, "chunk int, h long").distinct().join(ratio, "h").select("chunk", "h", "r", "w")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        words, known = Words(left.column("t").combine_chunks() if left.num_rows else pa.array([], pa.string())), Rows()
        known.add(right.column("h").to_numpy().view(np.uint64))
        at = known.of(words.hashes)
        r, w = np.append(right.column("r").to_numpy(), 0.0)[at], np.append(right.column("w").to_numpy(), unknown)[at]
        return pa.Table.from_batches([_rows_of(left.column(key).combine_chunks(), words, r, w, key)])

    return dealt.groupBy("chunk").cogroup(in_chunk.groupBy("chunk")).applyInArrow(meet, f"`{key}` {kind}, x array<double>")


def _chunk_words(batches):
    for b in batches:
        for first, some in slices(b.column("t")):
            words = Words(b.column("t").slice(first, some))
            chunk = np.repeat(b.column("chunk").to_numpy()[first : first + some], np.diff(words.upto)).astype(np.int64)
            pair = np.unique(chunk * len(words.hashes) + words.which) if len(chunk) else np.zeros(0, np.int64)
            n = max(1, len(words.hashes))
            yield pa.record_batch([pa.array((pair // n).astype(np.int32)), pa.array(words.hashes[pair % n].view(np.int64))], ["chunk", "h"])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", keep=None, sample: int = SAMPLE, broadcast: int = BROADCAST_RUNS) -> Fitted:
    """Models over all labelled rows that `keep` holds for but the sample, which calibrates: of every fifth row, by a hash of the key, at most `sample`."""
    keep = F.lit(True) if keep is None else keep
    own = labels.filter(keep & F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("of"), F.col(label).cast("int").alias("y"))
    h = F.xxhash64(F.lit(17), "of")
    chosen = staged(own.filter(F.pmod(h, F.lit(SHARE)) == 0).orderBy(h, "of").limit(sample), "calibration")
    rest = own.join(F.broadcast(chosen.select("of")), "of", "left_anti")
    hint = F.broadcast if own.count() <= BROADCAST_LABELS else (lambda df: df)
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    counts = rows.join(hint(rest), F.col("k") == F.col("of")).select("t", "y").mapInArrow(_counted, "word boolean, run long, n0 long, n1 long")
    counts = staged(counts.groupBy("word", "run").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "counts")
    whole, unknown = word_models(counts.filter("word").drop("word"))
    fitted = Fitted(models(counts.filter("not word").drop("word")), whole, unknown, None, broadcast)
    held = rows.join(F.broadcast(chosen), F.col("k") == F.col("of")).select("t", F.concat_ws(" ", F.xxhash64("of", "t"), "y").alias("of"))
    got = fitted.evidence(held, "of", "string").select("of", F.substring_index("of", " ", -1).cast("int").alias("y"), "x").toArrow().sort_by("of")
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, KINDS * EVIDENCE)
    fitted.calibration = Calibration(x, got.column("y").to_numpy().astype(float))
    return fitted


def score(docs: DataFrame, fitted: Fitted, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row."""
    kind, calibration = docs.schema[key].dataType.simpleString(), fitted.calibration
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def scored(batches):
        for b in batches:
            yield pa.record_batch([b.column("k"), pa.array(calibration.scores(b.column("x").flatten().to_numpy().reshape(-1, KINDS * EVIDENCE)))], ["k", "score"])

    return fitted.evidence(rows, "k", kind).mapInArrow(scored, f"k {kind}, score double").withColumnRenamed("k", key)
