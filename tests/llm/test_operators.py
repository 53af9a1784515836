"""The operators against brute force, and their defined results on odd rows."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from conftest import sf_dir
from pyspark.sql import functions as F

from panelwright.llm import decontaminate, line_dedup, packing, quality_fm, quality_rules, queries, simhash, token_counts, tokens, toxicity, url_filter, warc
from panelwright.llm.common import scratch
from panelwright.llm.components import components

#: Further columns with names that operators use inside.
CLASH = "1 k, 2 t, 3 w, 4 h, 5 fp, 6 n, 7 n_words, 8 host, 9 path, 10 rule, 11 key, 12 id, 13 a, 14 b, 15 length, 16 words, 17 base_failed, 18 start, 19 `offset`, 20 sequence_id, 21 digest, 22 piece, 23 score, 24 gone_key, 25 rules, 26 root, 27 line, 28 y".split(", ")
LONG = " ".join(f"wörd{i % 977} and{i % 13}" for i in range(30_000))
ROWS = [(1, None, "s0"), (2, "", "s0"), (3, " \n \t", None), (4, LONG, "s1"), (5, "One two three four five. " * 5, "s1"), (6, "one two three four five. " * 5, "s1"), (6, "one two three four five. " * 5, "s1"), (7, "short", "s2"), (None, "a null key keeps its row", "s2"), (8, "\x00 odd space <|endoftext|> é́", "s2")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumns({c.split(" ")[1].strip("`"): F.lit(int(c.split(" ")[0])) for c in CLASH}).cache()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{sf_dir()}/documents.parquet")


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


# 1


@pytest.mark.parametrize("name,kind,spaced", [("byte_bpe_50k.json", tokens.Counts, True), ("word_bpe_49k.json", tokens.Ids, False)])
def test_memo_gives_the_tokenizers_ids(docs, name, kind, spaced):
    tok, memo = tokens.load(public_tokenizers.path(name)), kind(public_tokenizers.path(name), limit=500)
    for t in [r["text"] or "" for r in docs.select("text").limit(60).collect()] + [t or "" for _, t, _ in ROWS] + ["  a\n\n b's don't\t x ", "İ ΑΣ Σ 12,5 ...", "x" * 3000]:
        ids = tok.encode(t, add_special_tokens=False).ids
        assert memo.count(t) == len(ids) if spaced else memo.batch(pa.array([t]))[0] == np.array(ids, "<u4").tobytes()


def test_overlapping_chunks_splice_to_the_whole_count(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = tokens.load(path)
    texts = ["ab c, d  \n e<|endoftext|> x " * 400, "x" * 3000 + " y" * 500, "é" * 4000, " " * 3000 + "a" + "\n" * 2000, None, "a b " * 900]
    texts += ["x" * 50_000]  # no boundary at all: widened until it is one chunk
    df = spark.createDataFrame([(i % 4, t) for i, t in enumerate([*texts, texts[0]])], "doc_id int, text string")
    want = Counter((i % 4, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False))) for i, t in enumerate([*texts, texts[0]]))
    for chunk, overlap in ((700, 90), (1024, 256)):
        assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(df, path, chunk=chunk, overlap=overlap).collect()) == want
    with pytest.raises(ValueError):
        token_counts.count_tokens(df, path, chunk=90, overlap=90)


def test_token_counts_of_odd_rows(odd):
    tok = tokens.load(public_tokenizers.path("byte_bpe_50k.json"))
    got = Counter((r["doc_id"], r["n_tokens"]) for r in token_counts.count_tokens(odd, public_tokenizers.path("byte_bpe_50k.json")).collect())
    assert got == Counter((i, len(tok.encode(t or "", add_special_tokens=False))) for i, t, _ in ROWS)


# 2


def test_url_rules(spark):
    rules = spark.createDataFrame([*queries.URL_RULES, (None, "/", "block"), ("b.example.org", "/", "block"), ("b.example.org", "/", "allow")], "host string, path string, verdict string")
    urls = {
        None: ("", "", None, "allow"),
        "nothing": ("", "", None, "allow"),
        "http://EXAMPLE.org/en/12?x": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://a.example.org/es": ("a.example.org", "/es", "org/", "allow"),
        "http://a.example.org/es/": ("a.example.org", "/es/", "example.org/es/", "block"),
        "http://notorg/": ("notorg", "/", None, "allow"),
        "http://x.com?/de/": ("x.com", "", None, "allow"),
        "HTTPS://x.com/de/#f": ("x.com", "/de/", "com/de/", "block"),
        "http://b.example.org/": ("b.example.org", "/", "b.example.org/", "block"),
        "http://": ("", "", None, "allow"),
        "a\nb://x.org/\n": ("x.org", "/\n", "org/", "allow"),
    }
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)] * 2, "page_id int, url string, rule string")
    for limit in (10, 0):
        url_filter.BROADCAST_RULES, kept = limit, url_filter.BROADCAST_RULES
        try:
            got = url_filter.judge(df, rules).collect()
        finally:
            url_filter.BROADCAST_RULES = kept
        assert len(got) == 2 * len(urls)
        for r in got:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == urls[r["url"]], r
    assert {r["verdict"] for r in url_filter.judge(df, rules.limit(0)).collect()} == {"allow"}


# 3


def lines_of(text):
    return [(n, x) for n, x in enumerate((text or "").split("\n")) if words(x)]


def brute_lines(rows):
    lines = [(i, n, x) for i, t in rows for n, x in lines_of(t)]
    unique = list(dict.fromkeys(x for *_, x in lines))
    sets, root = [line_dedup._set(x, line_dedup.SHINGLE) for x in unique], list(range(len(unique)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            same = len(x & sets[j])
            if same >= 0.8 * (len(x) + len(sets[j]) - same):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    at, first, gone = {x: i for i, x in enumerate(unique)}, {}, defaultdict(list)
    for i, n, x in sorted(lines):
        if first.setdefault(find(at[x]), (i, n)) != (i, n):
            gone[i].append(n)
    return dict(gone)


def row_hash(spark, texts):
    """What orders unlike texts of one key."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return {texts[r["i"]]: r["h"] for r in df.select("i", F.xxhash64("t").alias("h")).collect()}


def brute_lines_by_row(rows, hashes):
    """Of each (key, text) row the lines it loses: a line stays in the row of the smallest key, number and hash that has one like it."""
    lines = sorted(((i is not None, i or 0), n, hashes[t], x, t) for i, t in {*rows} for n, x in lines_of(t))
    sets, heads, gone = {x: line_dedup._set(x, line_dedup.SHINGLE) for *_, x, _ in lines}, [], defaultdict(list)
    group = {x: {x} for x in sets}
    for x in sets:
        for y in sets:
            same = len(sets[x] & sets[y])
            if x != y and same and same >= 0.8 * (len(sets[x]) + len(sets[y]) - same) and group[x] is not group[y]:
                group[x] |= group[y]
                for z in group[y]:
                    group[z] = group[x]
    for i, n, h, x, t in lines:
        if any(g is group[x] for g in heads):
            gone[i, t].append(n)
        else:
            heads.append(group[x])
    return gone


def test_lines_of_unlike_texts_of_one_key(spark):
    """Rows that share a key lose what others repeat, and nothing that they alone have."""
    shared = "shared line of text here"
    rows = [(0, shared), (1, "first own line\nunique second line kept?"), (1, f"other own line\n{shared}"), (1, f"other own line\n{shared}"), (None, f"of a null key\n{shared}"), (None, "of another null key\nfirst own line"), (2, "first own line\n\nab\nab"), (2, "first own line\nown to the second text"), (2, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = brute_lines_by_row(rows, row_hash(spark, [t for _, t in rows]))
    key = lambda i, t: ((i is not None, i or 0), t)
    want = Counter((i, "\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in gone[key(i, t)]) if gone[key(i, t)] else t) for i, t in rows)
    assert Counter((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(df).collect()) == want
    assert any("unique second line kept?" in (t or "") for _, t in want)
    told = Counter((r["doc_id"], r["n_lines"], tuple(r["removed_lines"])) for r in line_dedup.report(df).collect())
    assert told == Counter((i, len(lines_of(t)), tuple(gone[key(i, t)])) for i, t in rows)


def test_a_line_that_a_third_of_all_rows_have(spark):
    rows = [(i, ("the line that so many rows have\n" if i % 3 == 0 else "") + f"own line {i} {i * 7919 % 1000003}") for i in range(1500)]
    got = {r["doc_id"]: list(r["removed_lines"]) for r in line_dedup.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert {i: v for i, v in got.items() if i % 3 == 0} == {i: [0] if i else [] for i in range(0, 1500, 3)}


def test_line_dedup_against_all_pairs(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.limit(60).collect()]
    # variants that are like the original, some of them unlike each other
    base = "Line of words that many documents repeat with one word changed here and there, number one."
    rng = np.random.default_rng(0)
    for k in range(40):
        w = base.split()
        for j in rng.choice(len(w), 1 + k % 2, replace=False):
            w[j] = f"x{k}"
        rows.append((1000 + k, " ".join(w) + f"\nown line {k} {rng.integers(1e9)}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: list(r["removed_lines"]) for r in line_dedup.report(df).collect() if r["n_removed"]}
    assert got == brute_lines(rows)
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    for i, t in rows:
        assert out[i] == "\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in got.get(i, []))


def test_shards_of_every_size_and_cut_give_the_same_groups():
    rng, rows = np.random.default_rng(8), []
    for shard in range(40):
        base = list(rng.choice(list("abcdefghij "), 60))
        for k in range(int(rng.choice([1, 2, 5, 20, 90]))):
            base[int(rng.integers(60))] = "xyz"[k % 3]
            rows.append((shard, shard * 1000 + k, shard * 1000 + k - k % 2, "".join(base)))
    names = ["shard", "id", "root", "line"]
    table = pa.table([pa.array(c) for c in zip(*rows, strict=True)], names)

    def groups(pairs):
        lead = {r[1]: r[2] for r in rows}
        for a, b in pairs:
            x, y = lead[a], lead[b]
            lead = {i: x if g == y else g for i, g in lead.items()}
        return {frozenset(i for i in lead if lead[i] == g) for g in lead.values()}

    sets = {r[1]: line_dedup._set(r[3], 7) for r in rows}
    want = groups((a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and line_dedup._similar(sets[a[1]], sets[b[1]]))
    for size in (3, 64, 5000):
        got = [(r["a"], r["b"]) for b in line_dedup._cross(iter(table.to_batches(size))) for r in b.to_pylist()]
        assert groups(got) == want and len(got) < len(rows)


def test_measured_recall_of_bands():
    rng, hit, n = np.random.default_rng(3), 0, 0
    while n < 1500:
        one = list(rng.choice(list("abcdefghijklmnop "), 300))
        two = list(one)
        for i in rng.choice(300, int(rng.integers(2, 6)), replace=False):
            two[i] = "#"
        pair = ["".join(one), "".join(two)]
        if line_dedup.jaccard(*pair) >= 0.8:
            keys = line_dedup.band_keys(pair)
            hit, n = hit + bool((keys[0] == keys[1]).any()), n + 1
    assert hit / n > 0.99


def test_lines_that_equal_in_one_hash_only_stay(spark):
    """Two unlike lines under one id, as a collision of the first hash would make."""
    ids = spark.createDataFrame([(1, 0, 0, [(7, 1), (7, 2)]), (2, 0, 0, [(7, 1), None])], "k long, th long, tl int, ids array<struct<id: long, h: int>>")
    none = spark.createDataFrame([], "node long, h int, root long")
    assert {r["k"]: r["removed"] for r in line_dedup._removed(ids, none).collect()} == {2: [0]}


def test_large_groups_by_broadcast_and_by_join_agree(spark, docs, monkeypatch):
    some = docs.limit(80)
    want = sorted(map(str, line_dedup.report(some).collect()))
    monkeypatch.setattr("panelwright.llm.common.LARGE_GROUP", 1)
    assert sorted(map(str, line_dedup.report(some).collect())) == want


def test_lines_across_components_join():
    base = list(np.random.default_rng(5).choice(list("abcdefghijklmnopqrstuvwxyz "), 400))
    rows = []
    for i in range(12):  # a chain: each is like the next one only
        base[i * 30] = str(i % 10)
        rows.append((i, i, "".join(base)))
    pairs = {(a, b) for a, b in line_dedup._links_across(rows)}
    seen, todo = {0}, [0]
    while todo:
        x = todo.pop()
        for a, b in pairs:
            for y in ({a, b} - {x}) if x in (a, b) else ():
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
    assert seen == set(range(12))


def test_line_dedup_of_odd_rows(odd):
    got = {(r["doc_id"], r["n_lines"], r["n_removed"]) for r in line_dedup.report(odd).collect()}
    assert (1, 0, 0) in got and (2, 0, 0) in got and (3, 0, 0) in got and (4, 1, 0) in got and (5, 1, 0) in got and (6, 1, 0) in got
    assert line_dedup.dedup_lines(odd).columns == odd.columns


def test_lines_of_null_keys_repeated_rows_and_short_lines(spark):
    rows = [(None, "ab\nab\nof the null key"), (1, "ab\n\n \nlong enough to be compared 1"), (1, "ab\n\n \nlong enough to be compared 1"), (2, "of the null key\nlong enough to be compared 2")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0), r["n_lines"], tuple(r["removed_lines"])) for r in line_dedup.report(df).collect())
    assert got == [(0, 3, (1,)), (1, 2, (0,)), (1, 2, (0,)), (2, 2, (0, 1))]
    empty = line_dedup.dedup_lines(df.limit(0))
    assert empty.columns == df.columns and empty.isEmpty()


# 4


def brute_rules(t):
    t = t or ""
    w = words(t)
    c, cover = Counter(zip(w, w[1:], w[2:])), set()
    for k in range(len(w) - 2):
        if c[(w[k], w[k + 1], w[k + 2])] > 1:
            cover |= {k, k + 1, k + 2}
    lines = [x for _, x in lines_of(t)]
    return len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


def test_quality_rules_against_brute_force(spark, docs, odd):
    for df in (docs.select("doc_id", "text", "source"), odd):
        want = Counter()
        for r in df.select("doc_id", "text").collect():
            b = brute_rules(r["text"])
            want[(r["doc_id"], *b, b[0] < 50 or 100 * b[4] > 50 * b[0])] += 1
        got = Counter(tuple(r) for r in quality_rules.quality_rules(df).drop("kept").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
        assert got == want


def test_hosts_of_failures_go_and_clean_ones_stay(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(i, "bad" if i < 400 else "good", "x" if i < 390 or i % 10 == 0 else good) for i in range(4000)] + [(9000, None, good)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(df).collect()}
    assert not any(got[i] for i in range(400)) and all(got[i] for i in range(400, 4000) if i % 10) and got[9000]
    kept = quality_rules.keep_good(df.withColumn("base_failed", F.lit(7)).withColumn("rules", F.lit(8)))
    assert kept.count() == sum(got.values()) and kept.columns == [*df.columns, "base_failed", "rules"]


def test_one_host_failing_rarely_keeps_its_clean_documents(spark):
    good = " ".join(f"word{i}" for i in range(80))
    df = spark.createDataFrame([(i, "only", good if i else "x") for i in range(5)], "doc_id long, source string, text string")
    assert quality_rules.quality_rules(df).filter("kept").count() == 4


# 5


def item_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_decontamination_against_brute_force(spark, docs, odd):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir()}/benchmark.parquet").collect()] + [(100, "two five"), (101, "SHORT"), (102, None), (103, "..."), (104, "one two three four five one two three four five one two"), (104, "two five")]
    windows = defaultdict(set)
    for i, t in items:
        w = item_words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(i)
    frame = spark.createDataFrame(items, "item_id long, text string")
    every = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(i, t) for i, t, _ in ROWS]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in every], "doc_id long, text string, w int, wid int")
    want = Counter()
    for i, t in every:
        w, hit, found = item_words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        want[(i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))] += 1
    for limit in (400_000, 1500):
        decontaminate.BROADCAST_ROWS, kept = limit, decontaminate.BROADCAST_ROWS
        try:
            got = Counter(tuple(r) for r in decontaminate.find_items(df, frame).collect())
        finally:
            decontaminate.BROADCAST_ROWS = kept
        assert got == want
    assert decontaminate.find_items(df, frame.limit(0)).filter("contaminated").isEmpty()


# 6 and 9


def auc(score, y):
    order = np.argsort(np.argsort(score)) + 1
    p = y == 1
    return (order[p].sum() - p.sum() * (p.sum() + 1) / 2) / p.sum() / (~p).sum()


@pytest.mark.parametrize("query,label,folds,fold,least", [("op6_quality_fm", "quality", 5, 0, 0.97), ("op9_toxicity", "toxic", 4, 2, 0.95)])
def test_held_out_rows(spark, query, label, folds, fold, least):
    where = sf_dir("sf0.1")
    got = queries.queries()[query](spark, where).join(spark.read.parquet(f"{where}/labels.parquet"), "doc_id").toPandas()
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % folds == fold)).all()
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.3)).all()
    held = got[got["held_out"]]
    assert auc(held["score"].to_numpy(), held[label].to_numpy()) > least
    if label == "toxic":
        found = held.groupby(label)["predicted"].mean()
        assert found[1] >= 0.9 and found[0] <= 0.016


def test_scores_do_not_depend_on_what_they_must_not(spark, docs):
    labels = spark.read.parquet(f"{sf_dir()}/labels.parquet")
    changed = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("s"))
    for how, label in ((quality_fm, "quality"), (toxicity, "toxic")):
        one = {r["doc_id"]: r["score"] for r in how.score(docs, how.fit(docs, labels, label=label)).collect()}
        two = {r["doc_id"]: r["score"] for r in how.score(changed, how.fit(changed, labels, label=label)).collect()}
        assert one == pytest.approx(two)


def test_models_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (4, 0), (5, 1), (None, 1), (7, None)], "doc_id long, y int")
    for how in (quality_fm, toxicity):
        for some in (labels, labels.limit(0), labels.filter("y = 1")):
            got = how.score(odd, how.fit(odd, some, label="y")).collect()
            assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)


def brute_ratio(counted, word):
    """log(toxic / ordinary) of a word under interpolated Kneser-Ney; counted: the words of each class."""
    five, one, many = toxicity.ORDER, toxicity.DISCOUNT, toxicity.SHARED
    raw = [Counter(), Counter()]
    for c in (0, 1):
        for w in counted[c]:
            w = f"^{w}$"
            raw[c].update(w[max(0, i - five + 1) : i + 1] for i in range(1, len(w)))
    levels = {five: [{g: n for g, n in raw[c].items() if len(g) == five} for c in (0, 1)]}
    for k in range(five - 1, 0, -1):
        levels[k] = [Counter(g[1:] for g, n in levels[k + 1][c].items() if n) + Counter({g: n for g, n in raw[c].items() if len(g) == k}) for c in (0, 1)]
    both = {}
    for k in range(many, 0, -1):
        longer = [g for c in (0, 1) for g in levels[k + 1][c]] if k == many else list(both[k + 1])
        both[k] = Counter(g[1:] for g in set(longer)) + Counter({g: raw[0][g] + raw[1][g] for g in {*raw[0], *raw[1]} if len(g) == k})

    def p(c, k, g):
        if k == 1:
            return both[1][g] / sum(both[1].values())
        table = both[k] if k <= many else levels[k][c]
        after = [n for h, n in table.items() if h[:-1] == g[:-1] and n]
        below = p(c, k - 1, g[1:])
        return (max(table.get(g, 0) - one, 0) + one * len(after) * below) / sum(after) if after else below

    w, out = f"^{word}$", 0.0
    for i in range(1, len(w)):
        g = w[max(0, i - five + 1) : i + 1]
        if len(g) > many and p(0, many, g[-many:]):
            out += np.log(p(1, len(g), g) / p(0, len(g), g))
    return out


TOXIC_WORDS = ["vile", "vilest", "vain", "avile", "plain", "plane", "planet", "very"]


def labelled_texts(spark, n=60):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(TOXIC_WORDS[:5] if i % 2 else TOXIC_WORDS[3:], 6)) for i in range(n)]
    labels = [(i, i % 2) for i in range(n)]
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_is_kneser_ney(spark):
    texts, df, labels = labelled_texts(spark)
    for sample in (0, 5):
        fitted = toxicity.fit(df, labels, sample=sample)
        chosen = [r[0] for r in labels.filter("pmod(xxhash64(17, doc_id), 5) = 0").orderBy(F.xxhash64(F.lit(17), "doc_id")).limit(sample).collect()]
        assert len(chosen) == sample
        counted = [[w for i, t in enumerate(texts) if i % 2 == c and i not in chosen for w in t.split()] for c in (0, 1)]
        rows = fitted.table.toPandas()
        words = [*TOXIC_WORDS, "vilely", "villain", "plan", "xvile"]
        got = toxicity.Ratios(rows["run"].to_numpy(), rows["lr"].to_numpy(float), rows["bw"].to_numpy(float)).of(words)
        assert got == pytest.approx([brute_ratio(counted, w) for w in words])


def test_word_models_are_discounted_to_shared_counts(spark):
    texts, df, labels = labelled_texts(spark)
    fitted = toxicity.fit(df, labels, sample=0)
    counts = [Counter(w for i, t in enumerate(texts) if i % 2 == c for w in t.split()) for c in (0, 1)]
    both = counts[0] + counts[1]
    every, lose = both.total() + 0.5 * (len(both) + 1), toxicity.DISCOUNT
    p = lambda c, w: (max(counts[c][w] - lose, 0) + lose * len(counts[c]) * (both[w] + 0.5) / every) / counts[c].total()
    rows, asked = fitted.words.toPandas(), [*both, "villain", "x"]
    words = toxicity.Words(pa.array([" ".join(asked)]))
    got = toxicity.WordRatios(rows["run"].to_numpy(), rows["lr"].to_numpy(), fitted.unknown).of(words.hashes)
    assert dict(zip(words.strings(), got.tolist(), strict=True)) == pytest.approx({w: np.log(p(1, w) / p(0, w)) for w in asked})


def test_toxicity_by_arrays_and_by_join_agree(spark):
    texts, df, labels = labelled_texts(spark)
    odd = df.unionByName(spark.createDataFrame([(90, None), (91, ""), (92, "Vile, VILEST 12 34-planet: " * 5), (92, "x"), (None, "vile")], "doc_id long, text string"))
    both = [toxicity.fit(df, labels, broadcast=n) for n in (10_000, 0)]
    got = [sorted(((str(r["doc_id"]), r["score"]) for r in toxicity.score(odd, f).collect())) for f in both]
    assert [k for k, _ in got[0]] == [k for k, _ in got[1]] and len(got[0]) == 65
    assert [s for _, s in got[0]] == pytest.approx([s for _, s in got[1]], rel=1e-4)


def test_evidence_against_a_loop():
    texts = ["", "vile plain", "plain vile vile " + "plane very " * 9 + "vile", "very"]
    words = toxicity.Words(pa.array(texts))
    worth = {"vile": 2.0, "plain": -1.0, "plane": 0.5, "very": -0.25}
    ratio, sizes = np.array([worth[w] for w in words.strings()]), np.array([len(w) + 1 for w in words.strings()])
    for t, got in zip(texts, toxicity.evidence(words, ratio, sizes), strict=True):
        w = t.split()
        r, n = [worth[x] for x in w], sum(len(x) + 1 for x in w)
        windows = [sum(r[i : i + 8]) for i in range(max(1, len(r) - 7))]
        best = (sorted({worth[x] for x in w if worth[x] > 0}, reverse=True) + [0.0] * 4)[:4]
        assert got == pytest.approx([sum(r) / n if n else 0.0, max(windows) / 8, *np.cumsum(best) / [1, 2, 3, 4]])


def test_factorisation_machine_against_all_pairs(spark, docs):
    labels = spark.read.parquet(f"{sf_dir()}/labels.parquet")
    machine = quality_fm.fit(docs, labels)
    some = docs.limit(15)
    got = {r["doc_id"]: r["score"] for r in quality_fm.score(some, machine).collect()}
    for r in some.collect():
        words = (r["text"] or "").lower().split()
        counts = Counter(zlib.crc32(w.encode()) & ((1 << quality_fm.BITS) - 1) for w in words)
        norm = np.sqrt(sum((1 + np.log(c)) ** 2 for c in counts.values())) if counts else 1.0
        x = {b: (1 + np.log(c)) / norm for b, c in counts.items()}
        z = (np.array(quality_fm.Inputs.statistics(r["text"] or "", words, len(counts))) - machine.mean) / machine.scale
        x |= {machine.words + i: v / 2 for i, v in enumerate(np.clip(z, -4, 4))}
        margin, at = machine.bias + sum(machine.w[i] * v for i, v in x.items()), list(x)
        margin += sum((machine.v[a] @ machine.v[b]) * x[a] * x[b] for n, a in enumerate(at) for b in at[:n])
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-margin)))


def test_linear_time_identity():
    m = quality_fm.Machine()
    m.v = np.random.default_rng(1).normal(size=m.v.shape)
    m.w = np.random.default_rng(2).normal(size=m.w.shape)
    index, value = np.array([3, 70, 900, 20]), np.array([0.5, -1.0, 2.0, 0.25])
    want = m.bias + m.w[index] @ value + sum((m.v[index[a]] @ m.v[index[b]]) * value[a] * value[b] for a in range(4) for b in range(a))
    assert m.margins(np.array([0, 4]), index, value)[0][0] == pytest.approx(want)


# 7


def test_warc_round_trip_at_every_split(spark):
    pages = [(i, f"http://a/{i}", ("same" if i % 3 else f"x{i}") * (1 + i % 5)) for i in range(60)] + [(None, None, None), (99, "http://a b\n", "é" * 5000), (99, "http://a b\n", "é" * 5000), (100, "u", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("refers_to", F.lit(1)).repartition(3)
    files = warc.write_warc(warc.with_revisits(df), scratch(spark, "warc-test"))
    groups = defaultdict(list)
    for i, _, h in pages:
        groups[(h or "").encode()].append(i)
    want = Counter()
    for data, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        for i in ids:
            digest, revisit = base64.b32encode(hashlib.sha1(data).digest()).decode(), i is not None and i < top
            want[(f"<urn:page:{'' if i is None else i}>", "revisit" if revisit else "response", digest, f"<urn:page:{top}>" if revisit else None, len(data), None if revisit else data)] += 1
    for split in (61, 500, 1 << 20):
        got = warc.read_warc(spark, files, split).collect()
        assert Counter((r["record_id"], r["record_type"], r["payload_digest"], r["refers_to"], r["content_length"], None if r["payload"] is None else bytes(r["payload"])) for r in got) == want
    empty = warc.write_warc(warc.with_revisits(df.limit(0)), scratch(spark, "warc-none"))
    assert warc.read_warc(spark, empty).isEmpty()


def test_damaged_members_are_told(tmp_path):
    members = [warc.record(i, "u", f"payload {i} ".encode() * 50, warc.base32_sha1(f"payload {i} ".encode() * 50), None, "2024-01-01T00:00:00Z") for i in range(5)]
    flipped = bytearray(members[2])
    flipped[len(flipped) // 2] ^= 0xFF
    for name, data, whole in (("flip", b"".join([*members[:2], bytes(flipped), *members[3:]]), 4), ("cut", b"".join(members)[:-9], 4), ("tail", b"".join(members) + b"xyz", 4)):
        path = tmp_path / name
        path.write_bytes(data)
        with pytest.raises(warc.Damaged):
            list(warc.read_range(str(path), len(data), 0, len(data)))
        assert len(list(warc.read_range(str(path), len(data), 0, len(data), "skip"))) == whole


def test_padding_and_large_records_are_read(tmp_path):
    payload = np.random.default_rng(1).bytes(9_000_000)  # a record of many blocks that does not compress
    big = warc.record(1, "u", payload, warc.base32_sha1(payload), None, "2024-01-01T00:00:00Z")
    small = warc.record(2, "u", b"small", warc.base32_sha1(b"small"), None, "2024-01-01T00:00:00Z")
    data = big + small + bytes(3_000_000)
    (tmp_path / "padded").write_bytes(data)
    for cuts in ([0, len(data)], [0, len(big) - 5, len(big) + 1, len(data) - 9, len(data)]):
        got = [r for a, b in zip(cuts, cuts[1:], strict=False) for r in warc.read_range(str(tmp_path / "padded"), len(data), a, b)]
        assert [(r[0], r[5]) for r in got] == [("<urn:page:1>", len(payload)), ("<urn:page:2>", 5)] and got[0][6] == payload
    (tmp_path / "late").write_bytes(data + b"x")
    with pytest.raises(warc.Damaged):
        list(warc.read_range(str(tmp_path / "late"), len(data) + 1, 0, len(data) + 1))


def test_revisits_by_broadcast_and_by_join_agree(spark, monkeypatch):
    rows = [(i, "u", "the empty page" if i % 3 == 0 else f"page {i % 200}") for i in range(1200)] + [(None, "u", "page 1"), (5000, "u", None), (5001, "u", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    told = lambda: Counter((r["id"], r["payload"], r["refers_to"]) for r in warc.with_revisits(df).collect())
    want = told()
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert told() == want and sum(r == 1197 for _, _, r in want.elements()) == 399 and want[5000, "", 5001] == 1


def test_headers_in_any_case_and_other_digests():
    block = b"HTTP/1.1 200 OK\r\n\r\nbody"
    got = warc._parse(b"WARC/1.0\r\nwarc-type: response\r\nWARC-RECORD-ID:<x>\r\nwarc-payload-digest: md5:abc\r\ncontent-length: %d\r\n\r\n%b\r\n\r\n" % (len(block), block))
    assert got[0] == "<x>" and got[3] == warc.base32_sha1(b"body") and got[6] == b"body"


def test_archives_are_plain_gzip(spark):
    import gzip

    df = spark.createDataFrame([(1, "http://a/", "<p>"), (2, None, "<p>")], "page_id long, url string, html string").coalesce(1)
    path = warc.write_warc(warc.with_revisits(df), scratch(spark, "warc-gzip")).first()["path"]
    text = gzip.decompress(open(re.sub("^file:", "", path), "rb").read())
    assert text.count(b"WARC/1.1\r\n") == 2 and text.endswith(b"\r\n\r\n")


# 8


def test_packing_is_whole_gapless_and_tight(spark, docs, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = tokens.load(path)
    for df in (docs, odd):
        got = packing.pack(packing.pieces(df, path)).toPandas()
        want = Counter()
        for r in df.select("doc_id", "text").collect():
            ids = np.array(tok.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4")
            for k, at in enumerate(range(0, len(ids), 2048)):
                part = ids[at : at + 2048]
                want[(r["doc_id"], k, at, len(part), zlib.crc32(part.tobytes()))] += 1
        assert Counter((None if i != i else int(i), *map(int, x)) for i, *x in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)) == want
        g = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")["length"]
        assert (g.cumsum() - got.sort_values(["sequence_id", "offset"])["length"] == got.sort_values(["sequence_id", "offset"])["offset"]).all()
        assert g.sum().max() <= 2048 and got["sequence_id"].nunique() <= got["length"].sum() / 2048 + 1 + 0.02 * got["length"].sum() / 2048


def test_best_two_fit_replaces_the_smallest():
    sequence, offset = packing.fit(np.array([6, 3, 2, 2]), 10)  # greedy leaves 6 + 3; 2 + 2 fill better than 3
    sums = np.bincount(sequence, [6, 3, 2, 2])
    assert sorted(sums) == [3, 10]


# 10


def brute_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(b"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def brute_components(points, radius=3):
    label = np.arange(len(points))
    near = [np.flatnonzero(np.bitwise_count(points ^ p) <= radius) for p in points]
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return label
        label = new


def test_simhash_groups_against_brute_force(docs, odd):
    for df in (docs, odd):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        points = np.array([brute_fingerprint(t) for _, t in rows], np.uint64)
        label = brute_components(points)
        want = Counter((i, f"{p:016x}", min((rows[k][0] for k in np.flatnonzero(label == x) if rows[k][0] is not None), default=None)) for (i, _), p, x in zip(rows, points.tolist(), label, strict=True))
        assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.groups(df).collect()) == want


@pytest.mark.parametrize("crowd", [60, 4096])
def test_crowded_shards_give_the_same_groups(spark, crowd):
    rng = np.random.default_rng(0)
    points = []
    for base, n, span in ((int(rng.integers(2**62)), 1500, 13), (int(rng.integers(2**62)), 400, 6)):
        for _ in range(n):
            v = base
            for bit in rng.integers(16, 64, rng.integers(0, span)):
                v ^= 1 << int(bit)
            points.append(v)
    p = np.unique(np.array(points, np.uint64))
    want = brute_components(p)
    i, j = simhash.close_forest(p)
    at = {int(x): k for k, x in enumerate(p.view(np.int64))}
    edges = [(at[r["a"]], at[r["b"]]) for r in simhash.links(spark.createDataFrame([(int(x),) for x in p.view(np.int64)], "fp long"), 3, crowd).collect()]
    for pairs in (list(zip(i.tolist(), j.tolist(), strict=True)), edges):
        label = np.arange(len(p))
        for _ in range(len(p)):
            new = label.copy()
            for a, b in pairs:
                new[a] = new[b] = min(new[a], new[b])
            if (new == label).all():
                break
            label = new
        assert len(set(label.tolist())) == len(set(want.tolist()))
        assert all(want[a] == want[b] for a, b in pairs)


@pytest.mark.parametrize("pieces", [4, 5, 6])
def test_pieces_of_fingerprints_find_the_same_links(spark, pieces):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, 60).tolist()
    near = [b ^ sum(1 << int(i) for i in rng.choice(63, n, replace=False)) for b in base for n in (1, 3, 4)]
    points = spark.createDataFrame([(p,) for p in {*base, *near}], "fp long")
    got = {r["node"]: r["root"] for r in components(simhash.links(points, pieces=pieces)).collect()}
    want = {r["node"]: r["root"] for r in components(spark.createDataFrame([(a, b) for a in {*base, *near} for b in {*base, *near} if a > b and (a ^ b).bit_count() <= 3], "a long, b long")).collect()}
    assert got == want


def test_one_of_each(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(3, text), (1, text), (2, text), (9, "another text of its own kind"), (9, "another text of its own kind"), (None, text)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0) for r in simhash.one_of_each(df).collect()) == [0, 1, 9]
    nulls = spark.createDataFrame([(None, text), (None, text), (9, "x"), (9, "x"), (9, "y")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0) for r in simhash.one_of_each(nulls).collect()) == [0, 0, 9, 9]
    other = " ".join(f"v{i}" for i in range(40))
    rows = [(1, text), (5, text), (5, other), (5, other), (6, other), (7, text + " end"), (8, other), (8, text), (8, "of its own")]
    mixed = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, of_k int, th int")
    assert sorted((r["doc_id"], r["text"]) for r in simhash.one_of_each(mixed).collect()) == [(1, text), (5, other), (8, "of its own")]
    assert simhash.one_of_each(mixed).columns == mixed.columns
    both = spark.createDataFrame([(3, text), (3, text + " end"), (3, text.upper())], "doc_id long, text string")
    assert simhash.one_of_each(both).count() == 1
    hot = spark.createDataFrame([(i, text if i % 3 == 0 else f"{i} " * 5 + f"tail {i}") for i in range(1200)], "doc_id long, text string").repartition(5)
    assert simhash.one_of_each(hot).filter("doc_id % 3 = 0").collect()[0]["doc_id"] == 0 and simhash.one_of_each(hot).count() == 801
    assert {r["component_id"] for r in simhash.groups(hot).filter("doc_id % 3 = 0").collect()} == {0}


def test_one_of_each_takes_near_copies_from_a_similarity_of_08(spark):
    rng, rows, pairs = np.random.default_rng(4), [], {}
    for n, changed in ((500, 4), (240, 2), (100, 1), (200, 3), (200, 6), (200, 9), (12, 3)):
        for _ in range(12):
            one = [f"w{x}" for x in rng.integers(0, 10**6, n)]
            two = list(one)
            for i in rng.choice(n, changed, replace=False):
                two[i] = f"v{rng.integers(0, 10**6)}"
            x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (one, two))
            pairs[len(rows), len(rows) + 1] = len(x & y) / len(x | y)
            rows += [(len(rows), " ".join(one)), (len(rows) + 1, " ".join(two).upper())]
    stay = {r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert any(0.8 <= s < 0.9 for s in pairs.values()) and any(0.6 < s < 0.8 for s in pairs.values())
    assert all(a in stay for a, _ in pairs) and all((b in stay) == (s < 0.8) for (_, b), s in pairs.items())


def near_pairs(n, shared, apart, rng):
    """Sets of hashes, each two with `shared` in common and `apart` of their own."""
    out = []
    for _ in range(n):
        h = rng.integers(0, 2**63, shared + 2 * apart).tolist()
        out += [set(h[: shared + apart]), set(h[:shared] + h[shared + apart :])]
    return out


def test_near_copies_go_by_majorities_of_xxh64_bits():
    text = " ".join(f"w{i % 300}" for i in range(700))
    w = text.split()
    h = {xxhash.xxh64_intdigest(" ".join(w[k : k + 5]), 42) for k in range(len(w) - 4)}
    assert simhash._shingle_hashes(text, 5) == h and simhash._shingle_hashes("one two", 5) == {xxhash.xxh64_intdigest("one two", 42)}
    sets = [h, {5}, set(range(1, 256)), set(range(1, 512))]
    got = simhash.majorities(sets)
    for s, m in zip(sets, got, strict=True):
        for n in range(simhash.BITS // 64):
            mixed = [int(x) for x in simhash._mixed(np.array(sorted(s), np.uint64), n)]
            want = sorted(2 * sum(v >> b & 1 for v in mixed) - len(s) for b in range(64))
            assert sorted(m[64 * n : 64 * n + 64].tolist()) == want
    shards, fp = simhash.near_shards(sets)
    assert [len(s) for s in shards] == [12, 1, 12, 12] and fp.shape == (4, 4)
    for m, s in zip(got, shards, strict=True):
        assert len(s) == 1 or min(abs(m[x // 2]) for x in s) >= np.sort(np.abs(m))[-12] and all((m[x // 2] > 0) == x % 2 for x in s)


def test_pairs_at_08_meet_in_a_shard_within_the_distance():
    rng, missed, total = np.random.default_rng(3), 0, 0
    for shared, apart in ((160, 20), (40, 5), (8, 1)):
        shards, fp = simhash.near_shards(near_pairs(1000, shared, apart, rng))
        near = np.bitwise_count(fp[::2] ^ fp[1::2]).sum(axis=1) <= simhash.NEAR
        near &= np.bitwise_count(fp[::2, 0] ^ fp[1::2, 0]) <= simhash.NEAR_64
        missed += sum(not (ok and set(a) & set(b)) for a, b, ok in zip(shards[::2], shards[1::2], near, strict=True))
        total += 1000
    assert missed <= 0.002 * total


def test_near_groups_are_those_of_all_links():
    rng = np.random.default_rng(5)
    fp = rng.integers(0, 2**64, (6, 4), np.uint64)[rng.integers(0, 6, 700)]
    for _ in range(10):
        fp ^= np.uint64(1) << rng.integers(0, 64, fp.shape, np.uint64)
    fp = np.concatenate([fp, rng.integers(0, 2**64, (50, 4), np.uint64)])[rng.permutation(750)]
    label = np.arange(len(fp))
    near = (np.bitwise_count(fp[:, None] ^ fp[None]).sum(axis=2) <= simhash.NEAR) & (np.bitwise_count(fp[:, None, 0] ^ fp[None, :, 0]) <= simhash.NEAR_64)
    while not np.array_equal(new := np.where(near, label[None], len(fp)).min(axis=1), label):
        label = new
    assert np.array_equal(simhash.near_groups(fp), label) and 50 < len(set(label.tolist())) < 700


@pytest.mark.parametrize("crowd", [3, simhash.SHARD])
def test_near_candidates_share_a_key(spark, crowd):
    rng, texts = np.random.default_rng(6), []
    for n, copies in ((200, 2), (90, 2), (120, 12), (12, 3)):
        for _ in range(5):
            one = [f"w{x}" for x in rng.integers(0, 10**6, n)]
            for _ in range(copies):
                two = list(one)
                two[int(rng.integers(0, n))] = f"v{rng.integers(0, 10**6)}"
                texts.append(" ".join(two))
    texts += ["a a a a a", "a a a a a a", "b", "b c", ""]
    rows = simhash.near_candidates(spark.createDataFrame([(t,) for t in [*texts, *texts]], "t string").repartition(3), crowd=crowd).collect()
    of = defaultdict(set)
    for r in rows:
        of[r["key"]] |= {r["head"], r["id"]}
    ids = [xxhash.xxh64_intdigest(t, 42) - (1 << 64) * (xxhash.xxh64_intdigest(t, 42) >> 63) for t in texts]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    alike = {(i, j) for i in range(len(texts)) for j in range(i) if texts[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    met = {(ids[i], ids[j]) for i in range(len(ids)) for j in range(i) if any(ids[i] in k and ids[j] in k for k in of.values())}
    assert len(alike) > 100 and {(ids[i], ids[j]) for i, j in alike} <= met
    assert all(r["head"] < r["id"] for r in rows) and len(met) < 3 * len(alike)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 500), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[100 + i] for i in range(30)} == {100} and got[201] == 200 and 500 not in got
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


# all


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_on_empty_tables(spark, tmp_path, name):
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        spark.read.parquet(f"{sf_dir()}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.queries()[name](spark, str(tmp_path)).count() == 0


def test_pipeline_keeps_clean_documents_and_its_decisions(spark):
    import corpus_pipeline

    docs, seen = spark.read.parquet(f"{sf_dir()}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf_dir()).cache()
        seen[name] = docs.count()
        if name != "best_fit_packing":
            assert docs.columns == before.columns
    assert seen["quality_rules"] >= seen["line_dedup"] == seen["quality_rules"] >= seen["simhash_near_dedup"] >= seen["decontamination"] > 100


def brute_kept(rows):
    """Positions of (doc_id, text, source) rows that both quality rules keep."""
    failed = []
    for _, t, _ in rows:
        n, _, _, _, repeated = brute_rules(t)
        failed.append(n < 50 or 100 * repeated > 50 * n)
    n, f = Counter(s for *_, s in rows if s is not None), Counter(s for (*_, s), bad in zip(rows, failed, strict=True) if bad and s is not None)
    rates, mean = np.array([f[s] / n[s] for s in n]), (f.total() + 0.5) / (n.total() + 1)
    between = rates.var() - mean * (1 - mean) * np.mean([1 / n[s] for s in n])
    strength = max(1.0, min(float(n.total()), mean * (1 - mean) / between - 1 if between > 0 else np.inf))
    bad = {s for s in n if (f[s] + mean * strength) / (n[s] + strength) > 0.8}
    return [i for i, (*_, s) in enumerate(rows) if not failed[i] and s not in bad]


def brute_near(rows, hashes):
    """(doc_id, text) rows, each once, that come first in their group of near copies, by key and hash."""
    texts = sorted({t for _, t in rows})
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in texts]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in map(words, low)]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if 5 * len(x & sets[j]) >= 4 * len(x | sets[j]):
                root[find(i)] = find(j)
    of, first = {t: find(i) for i, t in enumerate(texts)}, {}
    for i, t in rows:
        first[of[t]] = min((i, hashes[t], t), first.get(of[t], (i, hashes[t], t)))
    return {(i, t) for i, _, t in first.values()}


def test_pipeline_against_brute_force(spark, docs, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    given = [(r["doc_id"], r["text"], f"src{r['doc_id'] % 2}") for r in docs.orderBy("doc_id").limit(50).collect()]
    item = next(t for t, in spark.read.parquet(f"{sf_dir()}/benchmark.parquet").select("text").collect() if len(item_words(t)) >= 10)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    shared = "A line that several of these documents repeat as it stands or with little changed."
    near, made = fresh(120), []
    cut = lambda w, n: "\n".join(" ".join(w[k : k + n]) for k in range(0, len(w), n))
    # Cut into lines at other places, so that line dedup leaves them.
    made += [cut(near, 12), cut([*near[:60], "other", *near[61:]], 17), cut(near, 40).upper()]
    made += [" ".join(fresh(70)) + f"\n{shared}" + "." * k + "\n" + " ".join(fresh(30)) for k in range(3)]
    made += [" ".join(fresh(60)) + f" {item} " + " ".join(fresh(20)), None, "", "short text", "same words again " * 40, " ".join(fresh(5000))]
    # The host that fails takes its one good document with it.
    rows = given + [(10_000 + i, t, "made" if i % 5 else None) for i, t in enumerate(made)] + [(20_000 + i, f"x{i}", "failing") for i in range(60)] + [(20_060, " ".join(fresh(90)), "failing")]
    rows += [rows[-1], (10_000, made[0], None)]
    # Unlike texts of one key: one repeats lines, one is clean, one holds a benchmark passage.
    rows += [(30_000, " ".join(fresh(80)) + f"\n{shared}", None), (30_000, " ".join(fresh(70)), None), (30_000, " ".join(fresh(60)) + f" {item}", None)]
    spark.createDataFrame([(i, t, "en", s, len(t or ""), 5) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, gone_key int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir()}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = [rows[i][:2] for i in brute_kept(rows)]
    assert 20_060 not in dict(left) and 10_011 in dict(left) and 10_010 not in dict(left)
    gone = brute_lines_by_row(left, row_hash(spark, [t for _, t in left]))
    left = [(i, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[(True, i), t])) for i, t in left]
    # Rows equal in key and text are one document.
    left = sorted(brute_near(left, row_hash(spark, [t for _, t in left])))
    assert any(i == 10_000 for i, _ in left) and not {i for i, _ in left} & {10_001, 10_002}
    windows = set()
    for (t,) in spark.read.parquet(f"{tmp_path}/benchmark.parquet").select("text").collect():
        w = item_words(t)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in windows}
    left = [(i, t) for i, t in left if not any(tuple(w[k : k + n]) in windows for w in [item_words(t)] for n in sizes for k in range(len(w) - n + 1))]
    assert 10_006 not in dict(left) and len(left) > 20 and sum(i == 30_000 for i, _ in left) == 2
    tok, want = tokens.load(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for i, t in left:
        ids = np.array(tok.encode(t, add_special_tokens=False).ids + [0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            want[i, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())] += 1
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert Counter(tuple(map(int, x)) for x in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)) == want
    g = got.sort_values(["sequence_id", "offset"])
    assert (g.groupby("sequence_id")["length"].cumsum() - g["length"] == g["offset"]).all() and g.groupby("sequence_id")["length"].sum().max() <= 2048


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{sf_dir()}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
