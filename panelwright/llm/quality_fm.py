"""A factorisation machine for document quality.

Inputs are hashed words, weighed by a damped count and normalised, structure statistics of the text and its length as
metadata, and the pairwise interactions of all of these through low-rank factors. A score takes time linear in the
inputs: the sum of products over all pairs is half of (square of the sum less sum of squares), factor by factor.

The machine is fitted on the driver to a bounded sample of labelled rows (`sample`, by the order of a hash of the
key); their inputs are made by tasks. Scoring is a pass over the documents without a shuffle.

Edge cases: null and empty texts are scored by their statistics alone; equal rows each get a row; without labelled
rows, or with one class only, every score is the share of class 1, or 0.5; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS, RANK, SAMPLE, EPOCHS = 14, 8, 8_000, 20
_KINDS = np.zeros(256, np.uint8)  # of a byte: 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 stop or comma, 7 other sign, 8 beyond ASCII
for _low, _high, _kind in ((33, 127, 7), (97, 123, 1), (65, 91, 2), (48, 58, 3), (32, 33, 4), (9, 14, 4), (10, 11, 5), (128, 256, 8)):
    _KINDS[_low:_high] = _kind
_KINDS[[44, 46]] = 6
STATISTICS = 19


class Inputs:
    """Rows of hashed words and statistics. Words met before are not hashed again."""

    def __init__(self, bits: int = BITS, limit: int = 600_000):
        self.mask, self.limit, self.known = (1 << bits) - 1, limit, {}

    def buckets(self, words: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.array([known[w] for w in words], np.int64)
        except KeyError:
            if len(known) > self.limit:
                known = self.known = {}
            for w in words:
                if w not in known:
                    known[w] = zlib.crc32(w.encode("utf-8", "replace")) & self.mask
        return np.array([known[w] for w in words], np.int64)

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(indptr, bucket, value) of words and the matrix of statistics."""
        at, idx, val, stats = [0], [], [], np.zeros((len(texts), STATISTICS))
        for i, t in enumerate(texts):
            words = t.lower().split()
            b = self.buckets(words)
            u, c = np.unique(b, return_counts=True)
            v = 1 + np.log(c)
            idx.append(u)
            val.append(v / np.sqrt((v * v).sum()) if len(v) else v)
            at.append(at[-1] + len(u))
            stats[i] = self.statistics(t, words, len(u))
        return np.array(at), np.concatenate(idx or [np.zeros(0, np.int64)]), np.concatenate(val or [np.zeros(0)]), stats

    @staticmethod
    def statistics(text: str, words: list[str], distinct: int) -> list[float]:
        n, chars = len(words), max(1, len(text))
        kinds = np.bincount(_KINDS[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)], minlength=9)
        share = kinds / max(1, kinds.sum())
        lines = [x for x in text.split("\n") if x]
        lengths = np.fromiter(map(len, words), np.int64, n) if n else np.zeros(1)
        same = len(lines) - len(set(lines))
        return [np.log1p(n), np.log1p(chars), *share[1:], distinct / max(1, n), lengths.mean(), lengths.std(), np.log1p(len(lines)), same / max(1, len(lines)), n / max(1, len(lines)) ** 0.5, (lengths <= 3).mean(), text.count("|") / max(1, n), sum(map(str.__eq__, words, words[1:])) / max(1, n)]


class Machine:
    """score = sigmoid(w0 + <w, x> + half of sum over factors of (sum of v x)^2 - sum of (v x)^2)."""

    def __init__(self, bits: int = BITS, rank: int = RANK, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.words = 1 << bits
        size = self.words + STATISTICS
        self.bias, self.w, self.v = 0.0, np.zeros(size), rng.normal(0, 0.02, (size, rank))
        self.mean, self.scale = np.zeros(STATISTICS), np.ones(STATISTICS)

    def joined(self, at, idx, val, stats):
        """All inputs as one sparse matrix."""
        z = np.clip((stats - self.mean) / self.scale, -4, 4) / 2
        n, per = len(stats), np.diff(at) + STATISTICS
        ends = np.cumsum(per)
        indptr = np.concatenate([[0], ends])
        index, value = np.empty(indptr[-1], np.int64), np.empty(indptr[-1])
        fixed = (ends[:, None] - STATISTICS + np.arange(STATISTICS)).ravel()
        mask = np.ones(indptr[-1], bool)
        mask[fixed] = False
        index[mask], value[mask] = idx, val
        index[fixed], value[fixed] = np.tile(self.words + np.arange(STATISTICS), n), z.ravel()
        return indptr, index, value

    def margins(self, indptr, index, value):
        vx = self.v[index] * value[:, None]
        sums = np.add.reduceat(vx, indptr[:-1], axis=0)
        squares = np.add.reduceat(vx * vx, indptr[:-1], axis=0)
        return self.bias + np.add.reduceat(self.w[index] * value, indptr[:-1]) + 0.5 * (sums * sums - squares).sum(axis=1), vx, sums

    def fit(self, at, idx, val, stats, y, epochs: int = EPOCHS, rate: float = 0.1, decay: float = 2e-4, seed: int = 7):
        """AdaGrad on the logistic loss in small batches."""
        self.mean, self.scale = stats.mean(axis=0), stats.std(axis=0) + 1e-6
        indptr, index, value = self.joined(at, idx, val, stats)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        if y.min() == y.max():
            self.v[:] = 0
            return self
        gw, gv, gb, rng = np.full_like(self.w, 1e-2), np.full_like(self.v, 1e-2), 1e-2, np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for s in range(0, len(y), 64):
                rows = order[s : s + 64]
                sizes = indptr[rows + 1] - indptr[rows]
                ptr = np.concatenate([[0], np.cumsum(sizes)])
                take = np.repeat(indptr[rows] - ptr[:-1], sizes) + np.arange(ptr[-1])
                i, x = index[take], value[take]
                margin, vx, sums = self.margins(ptr, i, x)
                g = (1 / (1 + np.exp(-margin)) - y[rows]) / len(rows)
                gi = np.repeat(g, sizes)
                u, back = np.unique(i, return_inverse=True)
                dw = np.bincount(back, gi * x, len(u)) + decay * self.w[u]
                dv = np.zeros((len(u), self.v.shape[1]))
                np.add.at(dv, back, (gi * x)[:, None] * (np.repeat(sums, sizes, axis=0) - vx))
                dv += decay * self.v[u]
                gw[u] += dw * dw
                gv[u] += dv * dv
                self.w[u] -= rate * dw / np.sqrt(gw[u])
                self.v[u] -= 0.3 * rate * dv / np.sqrt(gv[u])
                gb += g.sum() ** 2
                self.bias -= rate * g.sum() / np.sqrt(gb)
        return self

    def scores(self, at, idx, val, stats) -> np.ndarray:
        if not len(stats):
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.margins(*self.joined(at, idx, val, stats))[0], -30, 30)))


_inputs = Inputs()


def _rows(texts: list[str]):
    return _inputs.rows(texts)


def held_out(key: str, folds: int, fold: int):
    """Whether the CRC-32 of the key as text leaves the remainder of the held-out fold."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds)) == fold


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, keep, sample: int) -> DataFrame:
    """(t, y) of at most `sample` labelled rows that `keep` holds for, chosen by a hash of the key."""
    some = labels.filter((F.lit(True) if keep is None else keep) & F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("of"), F.col(label).cast("double").alias("y"))
    chosen = some.orderBy(F.xxhash64("of"), "of", "y").limit(sample)
    texts = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return texts.join(F.broadcast(chosen), F.col("k") == F.col("of")).select("t", "y", F.xxhash64("of", "t").alias("order"))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", keep=None, sample: int = SAMPLE) -> Machine:
    def inputs(batches):
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                at, idx, val, stats = _rows(part.column("t").to_pylist())
                offsets = pa.array(at, pa.int32())
                yield pa.record_batch([part.column("order"), part.column("y"), pa.ListArray.from_arrays(offsets, pa.array(idx.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(val.astype(np.float32))), pa.array(list(stats), pa.list_(pa.float64()))], ["order", "y", "idx", "val", "stats"])

    got = labelled_sample(docs, labels, key, text, label, keep, sample).mapInArrow(inputs, "order long, y double, idx array<int>, val array<float>, stats array<double>").toArrow().sort_by("order")
    machine = Machine()
    if not got.num_rows:
        machine.v[:] = 0
        return machine
    lists = got.column("idx").combine_chunks()
    at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    stats = got.column("stats").combine_chunks().flatten().to_numpy().reshape(-1, STATISTICS)
    return machine.fit(at, lists.flatten().to_numpy().astype(np.int64), got.column("val").combine_chunks().flatten().to_numpy().astype(float), stats, got.column("y").to_numpy())


def score(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row."""
    kind, shared = docs.schema[key].dataType.simpleString(), docs.sparkSession.sparkContext.broadcast(machine)  # a fixed size: some MB

    def work(batches):
        for b in batches:
            scores = [shared.value.scores(*_rows(b.column("t").slice(s, 256).to_pylist())) for s in range(0, b.num_rows, 256)]
            yield pa.record_batch([b.column("k"), pa.array(np.concatenate(scores or [np.zeros(0)]))], ["k", "score"])

    return docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(work, f"k {kind}, score double").withColumnRenamed("k", key)
