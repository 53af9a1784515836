"""SimHash fingerprints and their exact groups within a Hamming distance, by sharded vantage-point trees.

A tree over all 64 bits cannot shard well: the distances of unlike texts lie within a few bits of 32, so nearly every
query with radius 3 meets both sides of a split, and each level would copy over half of all fingerprints. Split into
four quarters of 16 bits, two fingerprints within 3 bits agree in one quarter, so in that quarter's own space the
query radius is 0: fingerprints are sharded by the equality of a quarter, or, where so many would crowd these shards,
by that of two of five pieces or three of six. Inside a shard the full distance counts. Shards beyond `crowd` fingerprints are split by their distance to two
vantage points (the shard's smallest and largest fingerprint) into rings of 4; what lies within 3 of a ring's upper
bound also goes to the next ring, so each close pair meets in some ring. What is still beyond `crowd` is cut into
tiles, and every two tiles meet. A task searches its shards with a vantage-point tree each, pruned by the triangle
inequality, and returns a spanning forest of the pairs found, never the pairs.

Only distinct fingerprints take part, so copies cost nothing beyond their count.

Near copies (`near_copies`, `one_of_each`) are found by wider fingerprints of the same kind. Texts whose shingles have a
Jaccard similarity of 0.8 differ in some 15 of 100 bits, at which no equality of fixed pieces is selective. But a bit
flips where its majority is small. So a shard is named by a bit and its value, and a text goes to the shards of the 12 of its
1,024 bits that the largest majorities decide: of 36,000 simulated pairs at 0.8 all met in one shard at least. In a
shard the Hamming distance of 256 bits decides who is a candidate, and the texts' own shingles who is a near copy.
"""

from __future__ import annotations

from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_identity, identity, large_limit, slices, staged, with_groups
from .components import components, forest
from .line_dedup import Units, similar_among

CROWD, BROADCAST_LEAVES = 4096, 500_000
LEAF = 512
#: Of near copies: bits of a fingerprint, those that name its shards, those that are compared, in which candidates differ at most, of
#: which in the first 64; texts of a shard that one task compares.
BITS, DECIDED, COMPARED, NEAR, NEAR_64, SHARD = 1024, 12, 256, 68, 25, 100_000


def simhash(texts: list[bytes], shingle: int = 3) -> np.ndarray:
    """Fingerprints of UTF-8 texts: the majority of the bits of their word shingles' XXH64, ties 0."""
    import xxhash

    h, hashes, sizes = xxhash.xxh64_intdigest, [], []
    for t in texts:
        w = t.lower().split()  # of bytes: A-Z alone is lower-cased, and 0x09-0x0D and the space split
        if not w:
            sizes.append(0)
            continue
        line = memoryview(b" ".join(w))
        ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
        k = max(1, len(w) - shingle + 1)
        first, last = np.concatenate([[0], ends[: k - 1]]).tolist(), (ends[len(w) - k :] - 1).tolist()
        hashes += [h(line[a:b], 42) for a, b in zip(first, last, strict=True)]
        sizes.append(k)
    sizes = np.array(sizes, np.int64)
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        bits = np.array(hashes, ">u8").view(np.uint8)
        ends = np.cumsum(sizes[some])
        step = 0
        while step < len(some):  # a few MB of bits at a time
            upto = max(step + 1, int(np.searchsorted(ends, (ends[step - 1] if step else 0) + 65_536)))
            lo = int(ends[step - 1]) if step else 0
            ones = np.add.reduceat(np.unpackbits(bits[8 * lo : 8 * int(ends[upto - 1])]).reshape(-1, 64), (np.concatenate([[lo], ends[step : upto - 1]]) - lo), axis=0, dtype=np.int32)
            major = (2 * ones > sizes[some[step:upto], None]).astype(np.uint8)
            out[some[step:upto]] = np.packbits(major, axis=1).view(">u8").ravel()
            step = upto
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(key, fp): the 64 bits as a signed long; a null text's is 0."""
    kind = docs.schema[key].dataType.simpleString()

    def work(batches):
        for b in batches:
            texts = b.column("t").cast(pa.large_binary())
            fp = [simhash([t.as_py() for t in texts.slice(i, 256)], shingle) for i in range(0, len(texts), 256)]
            yield pa.record_batch([b.column("k"), pa.array(np.concatenate(fp or [np.zeros(0, np.uint64)]).view(np.int64), pa.int64())], ["k", "fp"])

    return docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(work, f"k {kind}, fp long").withColumnRenamed("k", key)


def _distance(a, b):
    return np.bitwise_count(a ^ b)


def _across(a, ia, b, ib, radius, out) -> None:
    """Pairs of a tree node's two sides. Both go down by one vantage point; b with the overlap that the bound needs."""
    if not len(a) or not len(b):
        return
    if len(a) * len(b) <= LEAF * LEAF:
        i, j = np.nonzero(_distance(a[:, None], b[None, :]) <= radius)
        if len(i):
            out.append(forest(ia[i], ib[j]))
        return
    da, db = _distance(a, a[0]).astype(np.int16), _distance(b, a[0]).astype(np.int16)
    mu = int(np.median(da))
    inside, near, far = da <= mu, db <= mu + radius, db > mu - radius
    if inside.all() or not inside.any() or near.all() and far.all():
        step = max(1, LEAF * LEAF // len(b)) if len(b) < LEAF * LEAF else 1
        for s in range(0, len(a), step):
            for t in range(0, len(b), LEAF * LEAF):
                _across(a[s : s + step], ia[s : s + step], b[t : t + LEAF * LEAF], ib[t : t + LEAF * LEAF], radius, out)
        return
    _across(a[inside], ia[inside], b[near], ib[near], radius, out)
    _across(a[~inside], ia[~inside], b[far], ib[far], radius, out)


def close_forest(points: np.ndarray, radius: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among points, found by a vantage-point tree."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        at = todo.pop()
        p = points[at]
        if len(at) <= LEAF:
            i, j = np.nonzero(np.triu(_distance(p[:, None], p[None, :]) <= radius, 1))
            if len(i):
                out.append(forest(at[i], at[j]))
            continue
        d = _distance(p, p[0]).astype(np.int16)
        mu = int(np.median(d))
        inside = d <= mu
        if inside.all():
            mu = int(d.max()) - 1
            inside = d <= mu
        if not inside.any():  # all equally far
            half = np.arange(len(at)) < len(at) // 2
            _across(p[half], at[half], p[~half], at[~half], radius, out)
            todo += [at[half], at[~half]]
            continue
        _across(p[inside & (d > mu - radius)], at[inside & (d > mu - radius)], p[~inside & (d <= mu + radius)], at[~inside & (d <= mu + radius)], radius, out)
        todo += [at[inside], at[~inside]]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return forest(np.concatenate([i for i, _ in out]), np.concatenate([j for _, j in out]))


def _search(batches, radius: int):
    """Links within each shard of a partition that is sorted by shard."""
    def links(shard, fp):
        starts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(shard)]]))
        of = np.repeat(np.arange(len(starts)), sizes)
        a, b = [], []
        small = sizes[of] <= 128
        where = np.flatnonzero(small)
        gap, f, g = 1, fp[where], of[where]
        while gap < len(where):  # every two of a small shard, all shards at once
            same = g[gap:] == g[:-gap]
            if not same.any():
                break
            near = np.flatnonzero(same & (np.bitwise_count(f[gap:] ^ f[:-gap]) <= radius))
            a.append(f[near])
            b.append(f[near + gap])
            gap += 1
        for s in np.flatnonzero(sizes > 128):
            p = fp[starts[s] : starts[s] + sizes[s]]
            i, j = close_forest(p, radius)
            a.append(p[i])
            b.append(p[j])
        if not a:
            return None
        a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        i, j = forest(a, b) if len(a) else (a, b)
        return pa.record_batch([pa.array(i, pa.int64()), pa.array(j, pa.int64())], ["a", "b"])

    shard, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        shard = np.concatenate([shard, batch.column("shard").to_numpy()])
        fp = np.concatenate([fp, batch.column("fp").to_numpy().view(np.uint64)])
        if not len(shard):
            continue
        whole = int(np.searchsorted(shard, shard[-1]))  # the last shard may go on
        if whole > 65_536:
            if (out := links(shard[:whole], fp[:whole])) is not None:
                yield out
            shard, fp = shard[whole:], fp[whole:]
    if len(shard) and (out := links(shard, fp)) is not None:
        yield out


def agreeing(pieces: int) -> list[int]:
    """Masks of the 64 bits cut into so many pieces: fingerprints within 3 bits agree under one of them at least."""
    cuts = [64 * i // pieces for i in range(pieces + 1)]
    one = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in map(sum, combinations(one, pieces - 3))]


def _shards(points: DataFrame, crowd: int, pieces: int | None = None) -> DataFrame:
    """(shard, fp), fp once for each shard that it belongs to. points: distinct fp.

    Four pieces give 4 leaves a fingerprint by 16 bits, five give 10 by 25 bits, six give 20 by 32 bits: as many are
    taken as keep leaves below `crowd` on average.
    """
    pieces = pieces or (4 if (n := points.count()) <= crowd << 15 else 5 if n <= crowd << 24 else 6)
    leaves = points.select("fp", F.explode(F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(agreeing(pieces))))).alias("leaf"))
    full = staged(leaves.groupBy("leaf").agg(F.count("*").alias("n"), F.min("fp").alias("v"), F.max("fp").alias("u")).filter(F.col("n") > crowd), "crowded")
    crowds = full.count()
    if not crowds:
        return leaves.select(F.xxhash64("leaf").alias("shard"), "fp")
    met = leaves.join(F.broadcast(full) if crowds <= BROADCAST_LEAVES else full, "leaf", "left")
    calm = met.filter("n is null").select(F.xxhash64("leaf").alias("shard"), "fp")

    def rings(v: str):
        d = F.bit_count(F.col("fp").bitwiseXOR(F.col(v)))
        return F.array_distinct(F.array((d / 4).cast("int"), ((d + 3) / 4).cast("int")))

    ringed = met.filter("n is not null").withColumn("r", F.explode(rings("v"))).withColumn("s", F.explode(rings("u"))).select(F.xxhash64("leaf", "r", "s").alias("ring"), "fp")
    sizes = ringed.groupBy("ring").agg(F.count("*").alias("n"))
    tiled = ringed.join(sizes, "ring").withColumn("tiles", F.ceil(F.col("n") / crowd).cast("int")).withColumn("t", F.pmod(F.xxhash64("fp"), "tiles").cast("int"))
    meets = tiled.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(F.xxhash64("ring", F.least("t", "o"), F.greatest("t", "o")).alias("shard"), "fp")
    return calm.unionByName(meets)


def links(points: DataFrame, radius: int = 3, crowd: int = CROWD, pieces: int | None = None) -> DataFrame:
    """(a, b): links that connect the same fingerprints as all links within radius (3 at most) do."""
    if radius > 3:
        raise ValueError("leaves serve radii up to 3")
    dealt = _shards(points, crowd, pieces).repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(lambda batches: _search(batches, radius), "a long, b long")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """(key, fp, fingerprint, component_id) of every row; component_id is the smallest key that links reach.

    Edge cases: null and empty texts share fingerprint 0 and link like any other; texts of fewer words than a
    shingle are one shingle; a null key gets a row and counts only where its component has no other key; a key on
    several rows joins nothing by itself; an empty table gives an empty result; other columns are ignored.
    """
    base = staged(fingerprints(docs, key, text, shingle), "fingerprints")
    distinct = base.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("rows"))
    roots = staged(components(links(distinct.select("fp"), radius)), "roots")
    ids = _headed(distinct, "fp", roots, "component_id")
    return with_groups(base, ids, ["fp"], "rows", large_limit(base), least=1).select(key, "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _headed(distinct: DataFrame, node: str, roots: DataFrame, head: str) -> DataFrame:
    """(node, head, rows) of every node: the smallest `least` of its component. distinct: (node, least, rows); roots: (node, root) of linked ones."""
    led = staged(distinct.join(roots.withColumnRenamed("node", "linked"), F.col(node) == F.col("linked"), "left").select(node, "least", "rows", F.coalesce("root", node).alias("root")), "led")
    # An unlinked node is a component of its own, so components of two nodes and more are those with a head.
    heads = led.groupBy("root").agg(F.min("least").alias("head"), F.count("*").alias("nodes"))
    return staged(with_groups(led, heads, ["root"], "nodes", large_limit(led)).select(node, F.coalesce("head", "least").alias(head), "rows"), "headed")


def _shingle_hashes(text: str, shingle: int) -> set[int]:
    """XXH64 of the different word shingles of a text whose words single spaces part."""
    import xxhash

    line = text.encode()
    w, h, view = line.split(b" "), xxhash.xxh64_intdigest, memoryview(line)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    k = max(1, len(w) - shingle + 1)
    return {h(view[a:b], 42) for a, b in zip([0, *ends[: k - 1].tolist()], (ends[len(w) - k :] - 1).tolist(), strict=True)}


def _mixed(h: np.ndarray, n: int) -> np.ndarray:
    """Further 64 bits of each hash; for n = 0 the hash itself."""
    if not n:
        return h
    h = h ^ np.uint64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def majorities(hashes: list[set[int]]) -> np.ndarray:
    """Of each set of hashes, none empty, and each of BITS bits: how many more have it set than not."""
    sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
    h = np.fromiter(chain.from_iterable(hashes), np.uint64, int(sizes.sum()))
    # Eight counts share a word, a byte for each, so they are made of 255 hashes at most and then added up.
    runs = -(-sizes // 255)
    first = np.cumsum(runs) - runs
    starts = np.repeat(np.cumsum(sizes) - sizes - 255 * first, runs) + 255 * np.arange(runs.sum())
    ones, counts = np.empty((len(sizes), BITS), np.int32), np.empty((len(starts), 8, 8), np.uint8)
    for n in range(BITS // 64):
        bits = _mixed(h, n)
        for i in range(8):
            counts[:, i] = np.add.reduceat(bits >> np.uint64(i) & np.uint64(0x0101010101010101), starts).view(np.uint8).reshape(-1, 8)
        ones[:, 64 * n : 64 * n + 64] = np.add.reduceat(counts.reshape(-1, 64), first, axis=0, dtype=np.int32)
    return 2 * ones - sizes[:, None]


def near_shards(hashes: list[set[int]]) -> tuple[list[list[int]], np.ndarray]:
    """The shards of each set of hashes, and its COMPARED bits as words. Sets of three and fewer are near copies of equal ones alone, and have a shard of their own."""
    m = majorities(hashes)
    order = np.abs(m).astype(np.int64) * BITS - np.arange(BITS)  # of equal majorities the first one
    top = np.argpartition(-order, DECIDED - 1, axis=1)[:, :DECIDED]
    shards = (2 * top + (np.take_along_axis(m, top, 1) > 0)).tolist()
    shards = [s if len(h) > 3 else [sum(h) % (1 << 62) + 2 * BITS] for s, h in zip(shards, hashes, strict=True)]
    return shards, np.packbits(m[:, :COMPARED] > 0, axis=1).view(np.uint64)


FINGERPRINT = [f"f{i}" for i in range(COMPARED // 64)]


def _near_rows(batches, shingle: int):
    """(id, shards, fingerprint) of texts t with words, once a task for equal ones."""
    import xxhash

    seen: set = set()  # saves work and rows; what it forgets only costs them
    for b in batches:
        texts = b.column("t")
        for start, n in slices(texts, 1_000_000):
            for at in range(start, start + n, 256):
                ids, hashes = [], []
                for t in texts.slice(at, min(256, start + n - at)).to_pylist():
                    if t and (i := xxhash.xxh64_intdigest(t.encode(), 42)) not in seen:
                        seen.add(i)
                        ids.append(i)
                        hashes.append(_shingle_hashes(t, shingle))
                if ids:
                    shards, fp = near_shards(hashes)
                    words = [pa.array(np.ascontiguousarray(w)) for w in fp.view(np.int64).T]
                    yield pa.record_batch([pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(shards, pa.list_(pa.int64())), *words], ["id", "shards", *FINGERPRINT])
                if len(seen) > 500_000:
                    seen = set()


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Gives the points that links a-b join one label, the smallest."""
    while (apart := label[a] != label[b]).any():
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
        while not np.array_equal(step := label[label], label):
            label[:] = step


def near_groups(fp: np.ndarray) -> np.ndarray:
    """Of each fingerprint, in words, the first one that links within NEAR bits reach."""
    label, first = np.arange(len(fp)), np.ascontiguousarray(fp[:, 0])
    for r in range(0, len(fp), 128):
        for c in range(r, len(fp), 4096):
            i, j = np.nonzero(_distance(first[r : r + 128, None], first[None, c : c + 4096]) <= NEAR_64)
            i, j = i + r, j + c
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            near = _distance(fp[i], fp[j]).sum(axis=1, dtype=np.int32) <= NEAR
            _join(label, i[near], j[near])
    return label


def _near_stars(batches):
    """(key, head, id) of the texts that links within a shard join: head is the smallest id that they reach; rows come sorted by shard and id."""

    def stars(shard, ids, fp):
        new = np.concatenate([[True], (shard[1:] != shard[:-1]) | (ids[1:] != ids[:-1])])
        shard, ids, fp = shard[new], ids[new], fp[new]
        starts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
        sizes, head = np.diff(np.append(starts, len(shard))), ids.copy()
        for s, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            head[s : s + n] = ids[s + near_groups(fp[s : s + n])]
        out = head != ids
        key = _mixed(shard[out].view(np.uint64), 1) ^ _mixed(head[out].view(np.uint64), 2)
        return pa.record_batch([pa.array(key.view(np.int64)), pa.array(head[out]), pa.array(ids[out])], ["key", "head", "id"])

    held: list = []
    for b in batches:
        if not b.num_rows:
            continue
        shard, ids = (b.column(c).to_numpy() for c in ("shard", "id"))
        fp = np.stack([b.column(c).to_numpy() for c in FINGERPRINT], axis=1).view(np.uint64)
        last = int(np.searchsorted(shard, shard[-1]))  # the last shard may go on
        if held and (last or held[-1][0][-1] != shard[0]):
            held.append((shard[:last], ids[:last], fp[:last]))
            yield stars(*map(np.concatenate, zip(*held, strict=True)))
            held = []
        elif last:
            yield stars(shard[:last], ids[:last], fp[:last])
        held.append((shard[last:], ids[last:], fp[last:]))
    if held:
        yield stars(*map(np.concatenate, zip(*held, strict=True)))


def near_candidates(texts: DataFrame, shingle: int = 5, crowd: int = SHARD) -> DataFrame:
    """(key, head, id) for similar_among(): texts t, whose words single spaces part, share a key if links within a shard join their fingerprints.

    Shards of more than `crowd` rows are cut into tiles, and every two tiles meet.
    """
    words = ", ".join(f"{c} long" for c in FINGERPRINT)
    wide = staged(texts.select("t").mapInArrow(lambda batches: _near_rows(batches, shingle), f"id long, shards array<long>, {words}"), "wide")
    rows = wide.select(F.explode("shards").alias("shard"), "id", *FINGERPRINT)
    full = rows.groupBy("shard").count().filter(F.col("count") > crowd).select("shard", F.ceil(F.col("count") / crowd).cast("int").alias("tiles"))
    met = rows.join(F.broadcast(full), "shard", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1))).withColumn("tile", F.pmod(F.xxhash64("id"), "tiles").cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.xxhash64("shard", F.least("tile", o), F.greatest("tile", o)))
    dealt = met.select(F.explode(F.when(F.col("tiles") == 1, F.array("shard")).otherwise(meets)).alias("shard"), "id", *FINGERPRINT)
    return dealt.repartition("shard").sortWithinPartitions("shard", "id").mapInArrow(_near_stars, "key long, head long, id long")


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """(key, component_id) of every row: component_id is the smallest key that links reach. Texts are linked whose word shingles have a Jaccard similarity of 0.8 or more.

    Candidates are within NEAR bits of each other by SimHash; all of them that could join components are compared shingle
    by shingle, by the words themselves. Edge cases are those of groups(), but that texts without words are linked to
    none but each other.
    """
    return _near(docs, key, text, shingle).select(F.col("k").alias(key), F.col("head.k").alias("component_id"))


def _near(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(k, th, tl, head) of every row: head is the smallest (k, th, tl) of its component, rows without key last."""
    kind = docs.schema[key].dataType.simpleString()

    def spaced(batches):
        for b in batches:  # of bytes: A-Z alone is lower-cased, and 0x09-0x0D and the space split
            for start, n in slices(b.column("t")):
                part = b.slice(start, n)
                lines = [b" ".join(t.as_py().lower().split()).decode() for t in part.column("t").cast(pa.large_binary())]
                yield pa.record_batch([*part.columns[:3], pa.array(lines, pa.string())], ["k", "th", "tl", "t"])

    own = identity(key, text)
    rows = docs.select(*(c.alias(n) for n, c in own.items()), F.coalesce(F.col(text), F.lit("")).alias("t"))
    base = staged(rows.mapInArrow(spaced, f"k {kind}, th long, tl int, t string"), "spaced")
    stars = staged(near_candidates(base, shingle), "stars")
    roots = staged(similar_among(stars, base, "t", Units(shingle, words=True)).drop("h"), "roots")
    ids = base.select("k", "th", "tl", F.xxhash64("t").alias("id"))
    place = F.when(F.col("k").isNotNull(), F.struct("k", "th", "tl"))
    distinct = ids.groupBy("id").agg(F.min(place).alias("least"), F.count("*").alias("rows"))
    return with_groups(ids, _headed(distinct, "id", roots, "head"), ["id"], "rows", large_limit(ids), least=1).select("k", "th", "tl", "head")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """docs with one row of each group of near copies: that with the smallest key.

    Rows go by key and text: of unlike texts of one key each belongs to its own group. Of near copies of one key that
    with the smaller hash stays, of rows equal in both one does. Rows without key all stay, and make no others go.
    """
    near = staged(_near(docs, key, text, shingle), "near_copies").filter("k is not null")
    gone, is_gone, _ = by_identity(docs, near.filter(F.struct("k", "th", "tl") != F.col("head")).select("k", "th", "tl").distinct(), key, text)
    left = docs.join(gone, is_gone, "left_anti")
    twice = staged(near.groupBy("k", "th", "tl").count().filter("count > 1").select("k", "th", "tl"), "doubled")
    if twice.isEmpty():
        return left
    twice, is_twice, _ = by_identity(docs, twice, key, text)
    return left.join(twice, is_twice, "left_anti").unionByName(left.join(twice, is_twice, "left_semi").dropDuplicates([key, text]))
