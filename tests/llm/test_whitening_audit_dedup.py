"""Whitening, filter audit and exact dedup against brute force, and their defined results on odd rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from conftest import sf_dir
from pyspark.sql import functions as F

from panelwright.llm import exact_dedup, filter_audit, queries, whitening
from panelwright.llm.common import large_limit, with_groups

SPACE = "[\x20\x09-\x0d]+"
CLASH = "1 k, 2 t, 3 h, 4 sha, 5 n, 6 x, 7 part, 8 mask, 9 copies, 10 `first`, 11 bucket, 12 slot, 13 owner, 14 step, 15 kept, 16 component, 17 i, 18 v, 19 least".split(", ")
LONG = " ".join(f"Wörd{i % 977} and{i % 13}\n" for i in range(30_000))
ROWS = [(1, None, "s0"), (2, "", "s0"), (3, " \n \t", None), (4, LONG, "s1"), (5, LONG.replace("\n ", "  \t"), "s1"), (6, "a  b", "s1"), (6, "a  b", "s1"), (7, "a\tb", "s2"), (None, "a null key", "s2"), (None, "a b", None), (8, "\x00 odd <|endoftext|> é́\x0b", "s2"), (9, "a null  key", "s2"), (9, "unlike text of one key", "s2"), (10, " ", "s2")]


def clashing(df):
    return df.withColumns({c.split(" ")[1].strip("`"): F.lit(int(c.split(" ")[0])) for c in CLASH})


@pytest.fixture(scope="module")
def odd(spark):
    return clashing(spark.createDataFrame(ROWS, "doc_id long, text string, lang string")).cache()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{sf_dir()}/documents.parquet")


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


# 11


def test_leading_vectors_against_a_library():
    rng = np.random.default_rng(5)
    made = [rng.standard_normal((40, n)) @ rng.standard_normal((n, n)) for n in (1, 2, 3, 7, 30)]
    cases = [m.T @ m for m in made]
    q = np.linalg.qr(rng.standard_normal((12, 12)))[0]
    cases += [q @ np.diag([5, 5, 5, 5, 5, 1, 1, 1, 0, 0, 0, 0.0]) @ q.T, np.diag([3.0, 3.0, 7.0, 7.0, 1.0]), np.eye(4) * 1e-9, q @ np.diag([1e9, 1e9 - 1e-3, 4.0, 3.0, *[1e-3] * 8]) @ q.T, np.diag(np.arange(20.0)) * 1e12]
    for a in cases:
        a = (a + a.T) / 2
        values, rows = whitening.principal(a, 4)
        want = np.linalg.eigvalsh(a)[::-1][:4]
        want = want[want > 8 * len(a) * whitening.EPS * want.max()]
        assert np.allclose(values, want, rtol=1e-12, atol=1e-12 * want.max())
        assert np.allclose(rows @ rows.T, np.eye(len(rows)), atol=1e-12)
        assert np.abs(rows @ a - np.array(values)[:, None] * rows).max() <= 1e-12 * want.max() * len(a)
    assert whitening.principal(np.zeros((3, 3)), 4)[0] == []
    one = whitening.principal(np.outer([1.0, 2, 2], [1.0, 2, 2]), 4)
    assert np.allclose(one[0], [9.0]) and len(one[1]) == 1


def test_sturm_counts():
    rng = np.random.default_rng(6)
    d, e = rng.standard_normal(15), rng.standard_normal(14)
    e[4] = e[9] = 0.0
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    for x in np.linspace(-4, 4, 60):
        assert whitening.below(d, e, x) == (values < x).sum()


def brute_whitening(rows, k=4):
    """Rows (key, vector) that remain, and for each (n, deviation), |whitened| by the covariance's own function, explained."""
    use = [(key, v) for key, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(256 * float(np.float32(c))) for c in v] for _, v in use])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return use, n, ((n * x - s) ** 2).sum(axis=1), np.abs((x - s / n) @ u / np.sqrt(e)), e / np.trace(v)


def test_whitening_against_brute_force(spark):
    got = queries.op11_whitening(spark, sf_dir()).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir()}/embeddings.parquet").collect()]
    use, n, deviation, white, explained = brute_whitening(rows)
    told = {(r["vec_id"], r["component"]): r for r in got}
    assert len(told) == len(got) == 4 * len(use)
    for i, (key, _) in enumerate(use):
        for c in range(4):
            r = told[key, c + 1]
            assert (r["n"], r["deviation"]) == (n, deviation[i]) and abs(abs(r["whitened"]) - white[i, c]) < 1e-9 and abs(r["explained"] - explained[c]) < 1e-12 and r["identity_error"] < 1e-9
    for c in range(4):
        w = np.array([told[key, c + 1]["whitened"] for key, _ in use])
        assert abs(w.mean()) < 1e-9 and abs((w * w).mean() - 1) < 1e-9


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(3)
    good = [(i, [float(np.float32(c)) for c in rng.standard_normal(3)]) for i in range(40)]
    rows = [*good, (100, None), (101, [1.0, None, 2.0]), (102, [1.0, nan, 2.0]), (103, [inf, 0.0, 0.0]), (104, [-inf, 0.0, 0.0]), (105, []), (106, [1.0, 2.0]), (None, good[0][1]), (7, good[7][1]), (7, [-0.0, 0.0, 1e-9]), (8, [-1e-9, 0.0, 0.0])]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = whitening.whiten(df).collect()
    use, n, deviation, white, explained = brute_whitening([r for r in rows if r[1] is None or len(r[1]) == 3], 3)
    assert n == 42 and Counter((r["vec_id"], r["component"], r["deviation"]) for r in got) == Counter((key, c + 1, d) for (key, _), d in zip(use, deviation.tolist(), strict=True) for c in range(3))
    want = sorted((str(key), c + 1, round(w, 8)) for (key, _), ws in zip(use, white, strict=True) for c, w in enumerate(ws))
    assert sorted((str(r["vec_id"]), r["component"], round(abs(r["whitened"]), 8)) for r in got) == want
    assert whitening.whiten(df.limit(0)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and whitening.whiten(df.limit(0)).isEmpty()
    assert whitening.whiten(df.filter("vec_id = 3").unionByName(df.filter("vec_id = 3"))).isEmpty()  # one different vector has no variance
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)], "vec_id long, embedding array<double>")
    flat = whitening.whiten(line).collect()
    assert {r["component"] for r in flat} == {1} and all(abs(r["explained"] - 1) < 1e-12 for r in flat)


def test_deviations_beyond_a_long_are_null():
    x = np.array([[1 << 40, 0], [0, 3]])
    assert whitening.deviations(x, 1 << 20, [1 << 30, 5]) == [None, (1 << 60) + (3 * (1 << 20) - 5) ** 2]
    assert whitening.deviations(np.array([[2, 1], [0, 3]]), 2, [2, 4]) == [8, 8]


# 12


def brute_audit(rows, labels):
    """Every order applied to every part's documents, one filter after the other."""
    least = {}
    for key, text, _ in rows:
        if key is not None:
            least[text or ""] = min(key, least.get(text or "", key))
    parts = defaultdict(list)
    for key, text, part in rows:
        t = text or ""
        w = words(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": key is not None and key > least[t]}
        parts[part or ""].append((fails, *labels.get(key, (0, 0))))
    out = {}
    for part, own in parts.items():
        orders, removed = {}, Counter()
        for order in permutations("ABCDE"):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                removed[f] += len(gone)
                orders["".join(order), step] = [len(left), len(gone), sum(d[0][f] for d in own) - len(gone), sum(d[0][f] and sum(d[0].values()) == 1 for d in own), sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for (order, step), counts in orders.items():
            out[part, order, step] = (*counts, removed[order[step - 1]])
    return out


def test_filter_audit_against_brute_force(spark, docs, odd):
    labels = spark.read.parquet(f"{sf_dir()}/labels.parquet")
    signs = [(20, "A # B", "en"), (21, "A # B", None), (22, "é" * 99 + "A", "en"), (23, "é" * 24 + "A" + " w" * 4, "en"), (24, "x " * 200, ""), (24, "x " * 200, "en")]
    mine = spark.createDataFrame(signs, "doc_id long, text string, lang string")
    # a null label, a label of no document, and two labels of one key
    more = spark.createDataFrame([(1, None, 1), (1, 1, 0), (6, 1, 1), (999, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for df, told in ((docs, labels), (odd.unionByName(mine, allowMissingColumns=True), more)):
        rows = [(r["doc_id"], r["text"], r["lang"]) for r in df.select("doc_id", "text", "lang").collect()]
        of = defaultdict(lambda: (0, 0))
        for r in told.collect():
            if r["doc_id"] is not None:
                of[r["doc_id"]] = (max(of[r["doc_id"]][0], int(r["quality"] == 1)), max(of[r["doc_id"]][1], int(r["toxic"] == 1)))
        got = filter_audit.audit(df, told).collect()
        assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == brute_audit(rows, of)
        assert len(got) == 600 * len({p or "" for *_, p in rows})
    assert filter_audit.audit(docs.limit(0), labels).isEmpty()


def test_a_third_of_all_rows_with_one_text(spark):
    rows = [(i, "the same text" if i % 3 == 0 else f"text {i}", "en" if i % 2 else "de") for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    labels = spark.createDataFrame([(i, i % 2, i % 5 == 0) for i in range(0, 1200, 4)], "doc_id long, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))
    got = {tuple(r)[:3]: tuple(r)[3:] for r in filter_audit.audit(df, labels).collect()}
    assert got == brute_audit(rows, {r["doc_id"]: (r["quality"], r["toxic"]) for r in labels.collect()})
    assert large_limit(df) < 400
    dedup = {r["doc_id"]: tuple(r)[1:] for r in exact_dedup.groups(df).collect()}
    assert len(dedup) == 1200 and all(dedup[i][:3] == ((0, 400, i == 0) if i % 3 == 0 else (i, 1, True)) for i, *_ in rows)


def test_removal_steps_are_the_first_failing_filter():
    orders = list(permutations(range(4)))
    mask = np.arange(16)
    steps = filter_audit.removal_steps(mask, 4, orders)
    for m in mask:
        for o, order in enumerate(orders):
            assert steps[m, o] == next((s for s, f in enumerate(order, 1) if m >> f & 1), math.inf)


def test_counts_beyond_doubles_stay_whole():
    n = np.array([(1 << 55) + 1, 3], np.int64)
    _, step, columns = filter_audit.interactions(np.array([1, 3]), n, n, n * 0)
    assert columns[1][(step == 1)].max() == (1 << 55) + 4


# 13


def brute_dedup(rows):
    groups = defaultdict(list)
    for key, text in rows:
        groups[re.sub(SPACE, " ", text or "")].append(key)
    out = Counter()
    for t, keys in groups.items():
        keep = min((k for k in keys if k is not None), default=None)
        for k in keys:
            out[k, keep, len(keys), k == keep, hashlib.sha256(t.encode()).hexdigest()] += 1
    return out


#: Keys as they are, few enough to collide, and all the same.
HASHES = [F.xxhash64, lambda t: F.pmod(F.xxhash64(t), F.lit(7)), lambda t: F.length(t) * 0]


@pytest.mark.parametrize("hashed", range(3))
def test_exact_dedup_against_brute_force(docs, odd, hashed):
    for df in (docs, odd):
        want = brute_dedup([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
        for capacity in (1 << 20, 1 << 12) if not hashed else (1 << 12,):
            got = exact_dedup.groups(df, capacity=capacity, hashed=HASHES[hashed])
            assert Counter(tuple(r) for r in got.collect()) == want
    assert exact_dedup.groups(docs.limit(0)).isEmpty()


def test_directory_doubles_until_no_bucket_is_overfull(spark):
    rng = np.random.default_rng(4)
    hashes = [int(h) for h in rng.integers(-(2**63), 2**63 - 1, 3000)] + [(5 << 50) + i for i in range(400)]  # 400 keys share upper bits
    keys = spark.createDataFrame([(h, 100) for h in hashes], "h long, load long")
    slots, depth = exact_dedup.directory(keys, owners=5, capacity=4000)
    rows = slots.collect()
    assert sorted(r["slot"] for r in rows) == sorted(set(r["slot"] for r in rows)) and len(rows) <= 1 << depth
    of = {r["slot"]: r for r in rows}
    load, owners = Counter(), defaultdict(set)
    for h in hashes:
        r = of[(h % 2**64) >> (64 - depth)]
        load[r["bucket"], r["depth"]] += 100
        owners[r["bucket"]].add(r["owner"])
    assert all(len(o) == 1 for o in owners.values()) and {r["owner"] for r in rows} == set(range(5))
    over = [b for b, n in load.items() if n > 4000]
    assert len(over) == 1 and over[0][1] == depth  # the keys that no doubling parts
    first = {b: min(r["slot"] for r in rows if r["bucket"] == b) for b in owners}
    assert sorted(first, key=first.get) == sorted(first, key=lambda b: (min(owners[b]), first[b]))  # owners have ranges of keys
    for b, d in load:  # nothing is split that need not be
        half = (b - (1 << d)) >> 1
        assert not d or 100 * sum((h % 2**64) >> (64 - d + 1) == half if d > 1 else True for h in hashes) > 4000


def test_index_finds_texts_of_other_documents(spark, docs):
    index = exact_dedup.build(docs, capacity=1 << 14)
    assert index.depth > 3
    some = docs.filter("doc_id % 3 = 0").select((F.col("doc_id") + 10_000).alias("doc_id"), F.concat(F.regexp_replace("text", " ", "  "), F.lit("")).alias("text"))
    other = spark.createDataFrame([(1, "in no document at all"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in exact_dedup.find(index, some.unionByName(other)).collect()}
    want = {r[0]: r[1:3] for r in brute_dedup([(r["doc_id"], r["text"]) for r in docs.collect()])}
    assert got[1]["first"] is None and all((r["first"], r["copies"]) == want[k - 10_000] for k, r in got.items() if k >= 10_000)


def test_texts_are_dealt_once_to_their_owners(docs):
    plan = exact_dedup.build(docs).entries.inputFiles()
    assert plan  # files of the shared folder
    left = exact_dedup.drop_copies(docs)
    assert left.schema == docs.schema and left.count() == len({re.sub(SPACE, " ", r["text"] or "") for r in docs.collect()})


def test_one_row_of_equal_rows_is_left(odd):
    left = exact_dedup.drop_copies(odd)
    want = {(k, re.sub(SPACE, " ", t or "")) for k, t, _ in ROWS}
    rows = [(r["doc_id"], re.sub(SPACE, " ", r["text"] or "")) for r in left.collect()]
    assert len(rows) == len(set(rows)) == len({t for _, t in want}) and set(rows) <= want


def test_groups_by_broadcast_and_by_join_agree(spark):
    rows = spark.range(1000).withColumn("g", F.when(F.col("id") < 300, 0).otherwise(F.col("id") % 400))
    groups = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    for limit in (1, 2, 256, 5000):
        got = with_groups(rows, groups, ["g"], "n", limit)
        assert got.count() == 1000
        assert {(r["id"], r["n"], r["least"]) for r in got.collect()} == {(r["id"], *((r["n"], r["least"]) if r["n"] > 1 else (None, None))) for r in rows.join(groups, "g").collect()}
