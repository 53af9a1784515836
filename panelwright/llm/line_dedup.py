"""Fuzzy line dedup: MinHash signatures of character shingles, banding, exact Jaccard, distributed union-find.

Lines of a shingle's length or more take part in this if they hold anything but white space; shorter ones, which are
like another only if they equal it, are deduplicated as they are. A line's id is the XXH64 of its bytes, and lines are equal if a second hash agrees too.
Signatures are made where documents are read, once a task for equal lines; bands of 4 minima each give keys, and lines
that share a key are candidates: at a similarity of 0.8 a pair is one with probability 0.995. Lines that share a key
within a batch are led to the batch's first one before anything is shuffled, and these first ones to the key's first:
a key that a third of all lines have is a row a batch. Every such pair's similarity is computed from the lines' own
shingle sets. Where a key's lines are then not one component, those outside its largest one are compared with all
others inside tasks, tile by tile, which return as many links as join components: no link between candidates is lost, and none is made
that joins nothing.
Of each component the line of the smallest (key, line number) stays, in that place; all others go. A row is known by its
key and its text: unlike texts of one key are documents of their own.
Lines meet what is known of them by their id; ids of very many lines are broadcast, of which large_limit() bounds the number.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_identity, identity, large_limit, staged, unused, with_groups
from .components import components

SHINGLE, BANDS, ROWS, SIMILARITY = 7, 10, 4, 0.8
TILE, SMALL, BITS, COARSE = 2048, 48, 2048, 256
BROADCAST_IDS = 1_000_000
BLANK = " \t\n\x0b\x0c\r"
_PARAMETERS = np.random.default_rng(20240613).integers(1, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_hashes(lines: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of all shingles, and where each line's begin; lines have `size` characters at least.

    A line has as many hashes as characters, but for the last one: those of its last places repeat its first.
    """
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    h = np.zeros(len(codes) - size + 1, np.uint32)
    for i in range(size):
        h *= np.uint32(0x01000193)
        h ^= codes[i : len(codes) - size + 1 + i] * np.uint32(0x9E3779B1)
    # A line's last places begin shingles that reach into the next one: they take the line's first hash.
    starts = np.cumsum(sizes) - sizes
    tail = (np.arange(1, size)[None, :] + (starts + sizes - size)[:, None]).ravel()
    inside = tail < len(h)
    h[tail[inside]] = np.repeat(h[starts], size - 1)[inside]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return h, starts


def band_keys(lines: list[str], size: int = SHINGLE) -> np.ndarray:
    """BANDS keys of each line; lines have `size` characters at least."""
    h, starts = shingle_hashes(lines, size)
    keys, step = np.empty((len(lines), BANDS), np.uint64), np.empty_like(h)
    for band in range(BANDS):
        key = np.full(len(lines), band + 1, np.uint64)
        for a in _PARAMETERS[band * ROWS : (band + 1) * ROWS]:
            np.multiply(h, a, out=step)
            key = (key ^ np.minimum.reduceat(step, starts)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        keys[:, band] = key
    return keys


class _Letters(dict):
    """A character for each word, by 20 bits of its hash."""

    def __missing__(self, word: str) -> str:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        self[word] = c = chr(0x10000 + (xxhash.xxh64_intdigest(word.encode(), 11) & 0xFFFFF))
        return c


_letters = _Letters()


@dataclass(frozen=True)
class Units:
    """What shingles are made of: `size` characters, or words, which are then what single spaces part.

    Words are first compared by letters, one for each word: as equal words have equal letters, similar lines pass
    none the less. What passes is compared by the words themselves.
    """

    size: int = SHINGLE
    words: bool = False

    def letters(self, lines: list[str]) -> list[str]:
        return ["".join(map(_letters.__getitem__, x.split(" "))) if x else "" for x in lines] if self.words else lines

    def shingles(self, line: str) -> set:
        if not self.words:
            return _set(line, self.size)
        w = line.split(" ")
        return {tuple(w[i : i + self.size]) for i in range(max(1, len(w) - self.size + 1))}


CHARACTERS = Units()


def _band_rows(batches):
    """(key, head, id): the band keys of different lines; head is the first line of the key among some lines at a time."""
    import xxhash

    seen: set = set()  # saves work and rows for equal lines; what it forgets only costs them

    def rows(lines, ids):
        keys, ids = band_keys(lines).ravel().view(np.int64), np.repeat(np.array(ids, np.uint64).view(np.int64), BANDS)
        order = np.lexsort([ids, keys])
        keys, ids = keys[order], ids[order]
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        heads = np.repeat(ids[start], np.diff(np.append(start, len(ids))))
        return pa.record_batch([pa.array(keys), pa.array(heads), pa.array(ids)], ["key", "head", "id"])

    lines, ids, size = [], [], 0
    for b in batches:
        for t in b.column("t"):
            for line in t.as_py().split("\n"):
                if len(line) >= SHINGLE and line.strip(BLANK):
                    i = xxhash.xxh64_intdigest(line.encode(), 42)
                    if i not in seen:
                        seen.add(i)
                        lines.append(line)
                        ids.append(i)
                        size += len(line)
            if size > 2_000_000:
                yield rows(lines, ids)
                lines, ids, size = [], [], 0
            if len(seen) > 500_000:
                seen = set()
    if lines:
        yield rows(lines, ids)


def _stars(batches):
    """(key, head, id) of every id that is not its key's first: as it comes, or of heads with the key's; rows come sorted by key and id."""
    last_key = last_id = first = None
    for b in batches:
        apart = b.column("head").to_numpy() != b.column("id").to_numpy()
        if apart.any():
            yield b.filter(pa.array(apart))
        key, ids = b.column("key").to_numpy()[~apart], b.column("id").to_numpy()[~apart]
        if not len(key):
            continue
        new = np.concatenate([[last_key is None or key[0] != last_key], key[1:] != key[:-1]])
        again = np.concatenate([[not new[0] and ids[0] == last_id], (ids[1:] == ids[:-1]) & ~new[1:]])
        at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        heads = np.where(at >= 0, ids[np.maximum(at, 0)], np.int64(0) if first is None else first)
        last_key, last_id, first = key[-1], ids[-1], heads[-1]
        out = ~new & ~again & (ids != heads)
        if out.any():
            yield pa.record_batch([pa.array(key[out]), pa.array(heads[out]), pa.array(ids[out])], ["key", "head", "id"])


def jaccard(a: str, b: str, size: int = SHINGLE) -> float:
    x, y = _set(a, size), _set(b, size)
    return len(x & y) / len(x | y)


def _set(line: str, size: int) -> set:
    return {line[i : i + size] for i in range(max(1, len(line) - size + 1))}


def _bits(lines: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each line's shingles as a set of BITS hashes, and of fewer ones: two such sets differ in no more places than the lines in shingles."""
    bits = np.zeros((len(lines), BITS), bool)
    h, starts = shingle_hashes(lines, size)
    of = np.repeat(np.arange(len(lines)), np.diff(np.append(starts, len(h))))
    bits[of, h & np.uint32(BITS - 1)] = True
    return np.packbits(bits, axis=1).view(np.uint64), np.packbits(bits.reshape(len(lines), -1, COARSE).any(axis=1), axis=1).view(np.uint64)


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int32)


def _similar(x: set, y: set) -> bool:
    same = len(x & y)
    return same >= SIMILARITY * (len(x) + len(y) - same)


#: Of two similar lines, the share of both lines' shingles in which they differ at most.
MOST = (1 - SIMILARITY) / (1 + SIMILARITY)


def _verified(pairs: DataFrame, lines: DataFrame, units: Units = CHARACTERS) -> DataFrame:
    """(a, b) of the pairs whose lines are similar. What passes as sets of hashed shingles is compared exactly."""

    step = 128 if units.words else 2048  # whole texts have large sets

    def alike(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                b = whole.slice(start, step)
                ids, at = np.unique(np.concatenate([b.column("a").to_numpy(), b.column("b").to_numpy()]), return_index=True)
                i, j = (np.searchsorted(ids, b.column(c).to_numpy()) for c in ("a", "b"))
                texts = pa.concat_arrays([b.column("s"), b.column("t")]).take(pa.array(at)).to_pylist()
                spelled = units.letters(texts)
                lengths = np.fromiter(map(len, spelled), np.int64, len(texts)) - units.size + 1
                bits, _ = _bits(spelled, units.size)
                ok = _differ(bits[i], bits[j]) <= MOST * (lengths[i] + lengths[j]) + 1e-9
                sets: dict = {}
                for n in np.flatnonzero(ok).tolist():
                    x, y = (sets[k] if k in sets else sets.setdefault(k, units.shingles(texts[k])) for k in (i[n], j[n]))
                    ok[n] = _similar(x, y)
                mask = pa.array(ok)
                yield pa.record_batch([b.column("a").filter(mask), b.column("b").filter(mask)], ["a", "b"])

    with_a = pairs.join(lines.select(F.col("id").alias("a"), F.col("line").alias("s")), "a")
    both = with_a.join(lines.select(F.col("id").alias("b"), F.col("line").alias("t")), "b")
    return staged(both.select("a", "b", "s", "t").mapInArrow(alike, "a long, b long"), "alike")


def _lines(text: str) -> Column:
    """All lines of a text; null has one that is empty."""
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _ids(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, th, tl, ids): of each row its identity, and the ids and second hashes of its lines, null for those without a word."""
    lines = F.transform(_lines(text), lambda x: F.when(x.rlike("[^ \\t-\\r]"), F.struct(F.xxhash64(x).alias("id"), F.hash(x).alias("h"))))
    return docs.select(*(c.alias(n) for n, c in identity(key, text).items()), lines.alias("ids"))


def similar_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(node, h, root): the component of every line id that is similar to another, and the line's second hash."""
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t"))
    banded = texts.mapInArrow(_band_rows, "key long, head long, id long")
    dealt = banded.repartition(F.when(F.col("id") == F.col("head"), F.col("key")).otherwise(F.xxhash64("key", "id"))).sortWithinPartitions("key", "id")
    return similar_among(staged(dealt.mapInArrow(_stars, "key long, head long, id long"), "stars"), docs, text)


def similar_among(stars: DataFrame, docs: DataFrame, text: str = "text", units: Units = CHARACTERS) -> DataFrame:
    """(node, h, root) as of similar_lines(), by shingles of units. Candidates share a key of stars (key, head, id), in which every id of a key but its head has a row."""
    first = staged(stars.select(F.col("head").alias("a"), F.col("id").alias("b")).distinct(), "first")
    ids = staged(first.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    few = F.broadcast if ids.count() <= BROADCAST_IDS else (lambda df: df)
    every = docs.select(F.explode(_lines(text)).alias("line")).select(F.xxhash64("line").alias("id"), F.hash("line").alias("h"), "line")
    # Should two lines have one id, the one with the smaller second hash stands for it.
    lines = staged(every.join(few(ids), "id", "left_semi").groupBy("id").agg(F.min_by("line", "h").alias("line"), F.min("h").alias("h")), "lines")
    good = _verified(first, lines, units)
    roots = components(good.unionByName(staged(_rest(stars, good, lines, units), "rest")))
    return roots.join(lines.select(F.col("id").alias("node"), "h"), "node")


def _rest(stars: DataFrame, good: DataFrame, lines: DataFrame, units: Units = CHARACTERS) -> DataFrame:
    """Links between lines of one key that are not known to be joined: that do not lead to one line in two steps.

    Of a key's lines those outside its largest group are dealt to `others` tiles, the largest group to `mains`; every
    two tiles but two of the largest group meet in a task. Of keys with the same lines one is enough.
    """
    one = staged(good.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "led")  # a line to its smallest
    two = one.select(F.col("node").alias("root"), F.col("root").alias("further"))
    roots = one.join(two, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
    members = stars.select("key", "id").unionByName(stars.select("key", F.col("head").alias("id"))).distinct()
    led = staged(members.join(roots, members["id"] == roots["node"], "left").select("key", "id", F.coalesce("root", "id").alias("root")), "members")
    sizes = led.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum(F.col("id").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("id")).alias("x"))
    keys = sizes.groupBy("key").agg(F.max(F.struct("n", "root")).alias("largest"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.bit_xor("x").alias("x"), F.count("*").alias("groups")).filter("groups > 1")
    tiles = lambda n: F.greatest(F.lit(1), F.ceil(n / TILE)).cast("int")
    apart = keys.groupBy("n", "s", "x").agg(F.min(F.struct("key", "largest")).alias("one")).select("one.key", "one.largest.root", tiles(F.col("one.largest.n")).alias("mains"), tiles(F.col("n") - F.col("one.largest.n")).alias("others")).withColumnRenamed("root", "main")
    met = led.join(apart, "key").join(lines, "id")
    inside = F.col("root") == F.col("main")
    tile = F.pmod(F.xxhash64("id"), F.when(inside, F.col("mains")).otherwise(F.col("others"))).cast("int")
    meet = lambda kind, i, j: F.xxhash64(F.col("key"), F.lit(kind), i, j)
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    with_others = F.transform(upto("others"), lambda j: meet(0, F.col("tile"), j))
    with_mains = F.transform(upto("mains"), lambda i: meet(0, i, F.col("tile")))
    among = F.transform(F.filter(upto("others"), lambda j: j != F.col("tile")), lambda j: meet(1, F.least("tile", j), F.greatest("tile", j)))
    dealt = met.withColumn("tile", tile).select(F.explode(F.when(inside, with_others).otherwise(F.concat(with_mains, among))).alias("shard"), "id", "root", "line")
    return dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(lambda batches: _cross(batches, units), "a long, b long")


def _cross(batches, units: Units = CHARACTERS):
    """Links between the lines of each shard; rows come sorted by shard."""
    joined: dict = {}  # groups that links of this task have joined, each to another one

    def links(part: pa.Table):
        shard, root, ids = (part.column(c).to_numpy() for c in ("shard", "root", "id"))
        lines = part.column("line").to_pylist()
        starts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
        sizes = np.diff(np.append(starts, len(shard)))
        pairs = _small(shard, root, ids, lines, np.flatnonzero(np.repeat(sizes, sizes) <= SMALL), joined, units)
        for start, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
            at = slice(start, start + n)
            pairs += _links_across(list(zip(ids[at].tolist(), root[at].tolist(), lines[at], strict=True)), units)
        return pa.record_batch([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        shard = batch.column("shard").to_numpy()
        last = int(np.searchsorted(shard, shard[-1]))  # the last shard may go on
        if last or held and held[-1].column("shard")[-1].as_py() != shard[0]:
            yield links(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = []
        held.append(batch.slice(last))
    if held:
        yield links(pa.Table.from_batches(held))


def _small(shard, root, ids, lines: list[str], rows, joined: dict, units: Units) -> list[tuple[int, int]]:
    """Links of shards of few lines: every two lines of a shard and not of a group, all shards at once."""
    spelled = units.letters([lines[i] for i in rows.tolist()])
    lengths = np.fromiter(map(len, spelled), np.int64, len(rows)) - units.size + 1
    packed = [_bits(spelled[k : k + 2048], units.size)[0] for k in range(0, len(rows), 2048)]
    bits, s, r, found = np.concatenate(packed) if packed else None, shard[rows], root[rows], []
    for gap in range(1, SMALL):
        near = np.flatnonzero((s[gap:] == s[:-gap]) & (r[gap:] != r[:-gap]))
        if not (s[gap:] == s[:-gap]).any():
            break
        found.append(near[_differ(bits[near], bits[near + gap]) <= MOST * (lengths[near] + lengths[near + gap]) + 1e-9] + np.array([[0], [gap]]))

    def led(x: int) -> int:
        while x in joined:
            x = joined[x]
        return x

    out = []
    for i, j in np.concatenate(found, axis=1).T.tolist() if found else ():
        x, y = led(int(r[i])), led(int(r[j]))
        if x != y and _similar(units.shingles(lines[rows[i]]), units.shingles(lines[rows[j]])):
            joined[x] = y
            out.append((int(ids[rows[i]]), int(ids[rows[j]])))
    return out


def _links_across(rows: list, units: Units = CHARACTERS) -> list[tuple[int, int]]:
    """Similar lines that join components. rows: (id, root, line).

    Lines of the largest group need no comparison among themselves. Sets of hashed shingles are compared first; what
    passes is compared exactly, unless it has been joined by then.
    """
    label = np.unique([r[1] for r in rows], return_inverse=True)[1]
    largest = np.bincount(label).argmax()
    order = np.argsort(label == largest, kind="stable")  # the largest group last
    ids, lines, label = [rows[i][0] for i in order], [rows[i][2] for i in order], label[order]
    spelled = units.letters(lines)
    sizes = np.array([len(x) - units.size + 1 for x in spelled])
    packed, coarse = _bits(spelled, units.size)
    out, sets = [], {}
    for i in range(int((label != largest).sum())):
        j = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        j = j[_differ(coarse[j], coarse[i]) <= MOST * (sizes[i] + sizes[j]) + 1e-9]
        if len(j):
            j = j[_differ(packed[j], packed[i]) <= MOST * (sizes[i] + sizes[j]) + 1e-9]
        for k in j.tolist():
            if label[k] != label[i]:
                x, y = (sets[n] if n in sets else sets.setdefault(n, units.shingles(lines[n])) for n in (i, k))
                if _similar(x, y):
                    out.append((ids[i], ids[k]))
                    label[label == label[k]] = label[i]
    return out


ROW = ["k", "th", "tl"]


def _removed(ids: DataFrame, roots: DataFrame) -> DataFrame:
    """(k, th, tl, removed) of the documents that lose lines; ids as _ids() gives them."""
    lines = ids.select(*ROW, F.posexplode("ids").alias("n", "line")).filter("line is not null").select(*ROW, "n", "line.id", "line.h")
    place = F.struct("k", "n", "th", "tl")  # of two texts of one key and number the smaller hash comes first
    firsts = lines.groupBy("id", "h").agg(F.min(place).alias("first"), F.count("*").alias("times"))
    met = (firsts["id"] == roots["node"]) & (firsts["h"] == roots["h"])
    led = staged(firsts.join(roots, met, "left").filter("times > 1 or root is not null").select(firsts["id"], firsts["h"], "first", "root", "times"), "touched")
    heads = staged(led.filter("root is not null").groupBy("root").agg(F.min("first").alias("head"), F.count("*").alias("members")), "heads")
    limit = large_limit(lines)
    rooted = with_groups(led.filter("root is not null"), heads, ["root"], "members", limit, least=1, how="inner").select("id", "h", "head", "times")
    kept = staged(rooted.unionByName(led.filter("root is null").select("id", "h", F.col("first").alias("head"), "times")), "places")
    gone = with_groups(lines, kept, ["id", "h"], "times", limit, least=1, how="inner").filter(~place.eqNullSafe(F.col("head")))
    return gone.groupBy(*ROW).agg(F.array_sort(F.collect_set("n")).alias("removed"))


def removed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, th, tl, removed): the identity of a row and the sorted numbers, from 0, of the lines to take out; documents without such lines are absent.

    Edge cases: a null or empty text has no lines; blank lines stay; rows that equal in key and text count as one document,
    and the line that stays does so in each of them; unlike texts of one key are documents of their own, of which the one
    with the smaller hash comes first where line numbers tie; a null key comes before all others; an empty table gives none.
    """
    return _removed(staged(_ids(docs, key, text), "line-ids"), similar_lines(docs, text))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_lines, n_removed, removed_lines) of every row; n_lines counts lines with a word. Edge cases are those of removed_lines()."""
    ids = staged(_ids(docs, key, text), "line-ids")
    gone = _removed(ids, similar_lines(docs, text)).select(*(F.col(c).alias(f"gone_{c}") for c in ROW), "removed")
    counted = ids.select(*ROW, F.size(F.filter("ids", lambda x: x.isNotNull())).alias("n_lines"))
    none = F.array().cast("array<int>")
    joined = counted.join(gone, F.col("k").eqNullSafe(F.col("gone_k")) & (F.col("th") == F.col("gone_th")) & (F.col("tl") == F.col("gone_tl")), "left")
    return joined.select(F.col("k").alias(key), "n_lines", F.size(F.coalesce("removed", none)).alias("n_removed"), F.coalesce("removed", none).alias("removed_lines"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """docs without their repeated lines; length, where docs has it, is counted anew for texts that change.

    Each row loses the lines of its own text, whatever other texts its key has; edge cases are those of removed_lines().
    """
    lines = unused(docs, "gone_lines")
    gone, is_gone, names = by_identity(docs, removed_lines(docs, key, text).withColumnRenamed("removed", lines), key, text)
    joined = docs.join(gone, is_gone, "left").drop(*names)
    at = joined.columns.index(text)

    def cut(batches):
        for b in batches:
            texts = [t if r is None else _without(t, set(r)) for t, r in zip(b.column(at).to_pylist(), b.column(lines).to_pylist(), strict=True)]
            arrays = [*b.columns[:at], pa.array(texts, pa.string()), *b.columns[at + 1 : -1]]
            yield pa.record_batch(arrays, b.schema.names[:-1])

    same, changed = joined.filter(F.col(lines).isNull()).drop(lines), joined.filter(F.col(lines).isNotNull())
    out = changed.mapInArrow(cut, docs.schema)
    if length in docs.columns:
        out = out.withColumn(length, F.length(text).cast(docs.schema[length].dataType))
    return same.unionByName(out)


def _without(text: str | None, gone: set) -> str:
    return "\n".join(line for n, line in enumerate((text or "").split("\n")) if n not in gone)
