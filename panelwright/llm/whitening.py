"""Whitening of embeddings by their leading principal components.

Entries become whole numbers x. Tasks add up what is needed of the different vectors: their number and sums first, then
the products of vectors that are centred before they are multiplied. A covariance has as many rows as vectors have
entries; it is the only matrix that reaches the driver, which makes it tridiagonal by Householder reflections, finds the
leading eigenvalues by bisection on Sturm counts, and their vectors by inverse iteration, in which vectors of
eigenvalues that lie close are made orthogonal to each other anew. Mean and components, a few vectors, go to the tasks,
which project each row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

UNIT = 256
EPS = float(np.finfo(float).eps)


def whole(vector: str, dimension: int) -> Column:
    """floor(256 c) of a vector's entries; null for one that is null, of another size, or with a null or non-finite entry."""
    c = F.col(vector)
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(c.isNotNull() & (F.size(c) == dimension) & finite, F.transform(c, lambda v: F.floor(v.cast("double") * UNIT).cast("long")))


def dimension_of(rows: DataFrame, vector: str) -> int:
    """The most frequent size of vectors that are not empty, the larger one of a tie; 0 without any."""
    sizes = rows.filter(F.size(vector) > 0).groupBy(F.size(vector).alias("d")).count()
    found = sizes.agg(F.max_by("d", F.struct("count", "d"))).first()[0]
    return found or 0


def matrix(batch: pa.RecordBatch, column: str, dimension: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def gram(rows: DataFrame, make, width: int) -> np.ndarray:
    """The sum of y'y over tasks, for the rows y that make() gives of each batch: centred ones."""

    def products(batches):
        total = np.zeros((width, width))
        for b in batches:
            if b.num_rows:
                y = make(b)
                total += y.T @ y
        yield pa.record_batch([pa.array(np.arange(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    parts = rows.mapInArrow(products, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    out = np.zeros((width, width))
    for i, j, v in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # width x width numbers
        out[i, j] = v
    return out


# A symmetric matrix's leading eigenvalues and vectors


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Diagonal, off-diagonal and reflections (first row, unit vector) by which a becomes tridiagonal."""
    a, n, turns = a.astype(float).copy(), len(a), []
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        if not (size := np.linalg.norm(x)) or not np.abs(x[1:]).any():
            continue
        x[0] += np.copysign(size, x[0])
        v = x / np.linalg.norm(x)
        a[k + 1 :, k:] -= 2 * np.outer(v, v @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
        turns.append((k + 1, v))
    return np.diag(a).copy(), np.diag(a, -1).copy(), turns


def below(d: np.ndarray, e: np.ndarray, x: float) -> int:
    """How many eigenvalues of a tridiagonal matrix are less than x: negative terms of the Sturm sequence."""
    tiny = EPS * max(1e-300, float(np.abs(d).max(initial=0) + np.abs(e).max(initial=0)))
    count, q = 0, 1.0
    for i in range(len(d)):
        q = d[i] - x - (e[i - 1] ** 2 / q if i else 0.0)
        if abs(q) < tiny * EPS:
            q = -tiny * EPS
        count += q < 0
    return count


def leading(d: np.ndarray, e: np.ndarray, k: int) -> list[float]:
    """The k largest eigenvalues, falling, each bisected until its interval has no number inside."""
    reach = np.abs(np.append(e, 0.0)) + np.abs(np.insert(e, 0, 0.0))
    low, high, out = float((d - reach).min()), float((d + reach).max()), []
    low, high = low - abs(low) * EPS - 1e-300, high + abs(high) * EPS + 1e-300
    for place in range(len(d) - 1, len(d) - 1 - k, -1):
        a, b = low, (out[-1] if out else high)
        b = b + abs(b) * 4 * EPS
        while (mid := a + (b - a) / 2) not in (a, b):
            if below(d, e, mid) > place:
                b = mid
            else:
                a = mid
        out.append(a + (b - a) / 2)
    return out


def solve(d: np.ndarray, e: np.ndarray, shift: float, y: np.ndarray, tiny: float) -> np.ndarray:
    """x of (T - shift) x = y by elimination with partial pivoting; a zero pivot becomes tiny."""
    n = len(d)
    u = np.zeros((n, 3))  # the rows' pivots and what lies right of them
    x, row = y.astype(float).copy(), [d[0] - shift, e[0] if n > 1 else 0.0, 0.0]
    for i in range(n - 1):
        under = [e[i], d[i + 1] - shift, e[i + 1] if i + 2 < n else 0.0]
        if abs(under[0]) > abs(row[0]):
            row, under = under, row
            x[i], x[i + 1] = x[i + 1], x[i]
        if not row[0]:
            row[0] = tiny
        m = under[0] / row[0]
        u[i] = row
        row = [under[1] - m * row[1], under[2] - m * row[2], 0.0]
        x[i + 1] -= m * x[i]
    u[n - 1] = [row[0] if abs(row[0]) > tiny else tiny, 0.0, 0.0]
    for i in range(n - 1, -1, -1):
        x[i] = (x[i] - (u[i, 1] * x[i + 1] if i + 1 < n else 0.0) - (u[i, 2] * x[i + 2] if i + 2 < n else 0.0)) / u[i, 0]
    return x


def vectors(d: np.ndarray, e: np.ndarray, values: list[float]) -> np.ndarray:
    """A unit vector of the tridiagonal matrix for each value, as rows, by inverse iteration.

    Values closer than a thousandth of the largest make a cluster, whose vectors are made orthogonal in each step.
    """
    scale = max(float(np.abs(d).max()), float(np.abs(e).max(initial=0.0)), 1e-300)
    out, start = [], 0
    for i, value in enumerate(values):
        if i and values[i - 1] - value > 1e-3 * scale:
            start = i
        shift = min(value, (values[i - 1] if i > start else np.inf)) - (i - start) * 2 * EPS * scale  # equal values need unequal shifts
        x = np.random.default_rng(i).standard_normal(len(d))
        for _ in range(8):
            x = solve(d, e, shift, x / np.linalg.norm(x), EPS * scale)
            for _ in range(2):
                for other in out[start:]:
                    x -= (other @ x) * other
            x /= np.linalg.norm(x)
        out.append(x)
    return np.array(out).reshape(len(values), len(d))


def principal(v: np.ndarray, k: int) -> tuple[list[float], np.ndarray]:
    """The k largest eigenvalues of a covariance and their unit vectors as rows; those that rounding cannot tell from 0 are left out."""
    if not len(v) or not np.abs(v).any():
        return [], np.zeros((0, len(v)))
    d, e, turns = tridiagonal(v)
    values = leading(d, e, min(k, len(v)))
    values = [x for x in values if x > 8 * len(v) * EPS * max(values)]
    rows = vectors(d, e, values)
    for first, u in reversed(turns):
        rows[:, first:] -= 2 * np.outer(rows[:, first:] @ u, u)
    return values, rows / np.linalg.norm(rows, axis=1, keepdims=True)


# Over a table


@dataclass(frozen=True)
class Model:
    """n vectors with sums; values and components (rows) of their covariance, its trace, and what whitened is off from the identity."""

    n: int
    sums: list
    values: list
    components: np.ndarray
    trace: float
    error: float

    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean()) @ self.components.T / np.sqrt(self.values)


def fit(vectors_: DataFrame, components: int = 4) -> Model | None:
    """The model of x, an array column of whole numbers of one size, each different vector once; None without rows."""
    distinct = staged(vectors_.select("x").groupBy("x").agg(F.lit(1).alias("one")).select("x"), "distinct")
    size = distinct.select(F.size("x")).first()
    if size is None:
        return None
    width = size[0]
    sums = [0] * width
    for i, s, n in distinct.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).collect():  # a row a dimension
        sums[i] = int(s)
    mean = np.array([s / n for s in sums])
    v = gram(distinct, lambda b: matrix(b, "x", width) - mean, width) / n
    values, rows = principal((v + v.T) / 2, components)
    model = Model(n, sums, values, rows, float(np.trace(v)), 0.0)
    if not values:
        return model
    k = len(values)
    means = distinct.mapInArrow(lambda batches: _means(batches, model, width), "i int, v double, n long").groupBy("i").agg((F.sum("v") / F.sum("n")).alias("m")).collect()
    at = np.array([m for _, m in sorted(means)])
    identity = gram(distinct, lambda b: model.project(matrix(b, "x", width)) - at, k) / n
    return Model(n, sums, values, rows, model.trace, float(np.abs(identity - np.eye(k)).max()))


def _means(batches, model: Model, width: int):
    total, n = np.zeros(len(model.values)), 0
    for b in batches:
        if b.num_rows:
            total, n = total + model.project(matrix(b, "x", width)).sum(axis=0), n + b.num_rows
    yield pa.record_batch([pa.array(np.arange(len(total)), pa.int32()), pa.array(total), pa.array([n] * len(total), pa.int64())], ["i", "v", "n"])


def deviations(x: np.ndarray, n: int, sums: list) -> list:
    """sum((n x - S)^2) of each row, exactly; None where it exceeds a long."""
    most = n * max(1, int(np.abs(x).max(initial=0))) + max(map(abs, sums), default=0)
    if most * most * len(sums) < 1 << 63:
        y = n * x - np.array(sums, np.int64)
        return (y * y).sum(axis=1).tolist()
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 4) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of each remaining row and component.

    Edge cases: rows without vector, with a null, NaN or infinite entry, without entries, or of another size than most
    rows have (the larger one of a tie), are left out; a repeated row is repeated, a vector counts once in the fit;
    components whose eigenvalue rounding cannot tell from 0 are absent, so a table of one different vector, like an
    empty one, gives no rows; a deviation beyond a long is null; a null key is kept; other columns are ignored.
    """
    width = dimension_of(rows, vector)
    kind = rows.schema[key].dataType.simpleString()
    use = rows.select(F.col(key).alias("k"), whole(vector, width).alias("x")).filter("x is not null")
    model = fit(use, components)
    names = ["k", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    form = f"k {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not model.values:
        return rows.sparkSession.createDataFrame([], form).withColumnRenamed("k", key)
    k = len(model.values)

    def projected(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b, "x", width)
            rows_ = np.repeat(np.arange(len(x)), k)
            deviation = pa.array(deviations(x, model.n, model.sums), pa.int64()).take(pa.array(rows_))
            const = lambda v: np.full(len(rows_), v)
            yield pa.record_batch([b.column("k").take(pa.array(rows_)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(const(model.n), pa.int64()), deviation, pa.array(model.project(x).ravel()), pa.array(np.tile(np.array(model.values) / model.trace, len(x))), pa.array(const(model.error))], names)

    return use.mapInArrow(projected, form).withColumnRenamed("k", key)
