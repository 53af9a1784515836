"""How two panels agree: coverage, rank agreement, match rates. Column pairs are unpivoted, so all go in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import correlation
from ..storage import staged
from .windows import average_rank


def coverage(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(both, left_only, right_only, share): counts of distinct keys."""
    x = a.select(*keys).distinct().withColumn("_a", F.lit(1))
    y = b.select(*keys).distinct().withColumn("_b", F.lit(1))
    j = x.join(y, keys, "full_outer")
    n = lambda cond: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")
    both = n(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    return j.agg(both.alias("shared"), n(F.col("_b").isNull()).alias("left_only"), n(F.col("_a").isNull()).alias("right_only")).withColumn("share", F.try_divide(F.col("shared").cast("double"), (F.col("shared") + F.col("left_only")).cast("double")))


def pairs(a: DataFrame, b: DataFrame, columns: dict[str, str], keys: list[str], month: str) -> DataFrame:
    """(keys, char, x, y) of every column pair {a's: b's}, joined on keys, both values present."""
    left = a.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("char"), F.col(c).cast("double").alias("x")) for c in columns))).alias("_kv")).select(*keys, "_kv.*")
    right = b.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("char"), F.col(d).cast("double").alias("y")) for c, d in columns.items()))).alias("_kv")).select(*keys, "_kv.*")
    return left.join(right, [*keys, "char"]).dropna(subset=["x", "y"])


#: Different values between two splitters of a group on average, and splitters of a group at most.
DEPTH, SPLITTERS = 4096, 1000


def splitters(counts: DataFrame, by: list[str], depth: int = DEPTH) -> DataFrame:
    """(by, _cuts): sorted values that cut each group's different values into about equal parts.

    A value is taken by its hash, so that every computation takes the same ones; groups of few values have none.
    """
    sizes = counts.groupBy(*by).agg(F.count("*").alias("_d"))
    share = F.least(F.lit(1.0) / depth, F.lit(float(SPLITTERS)) / F.col("_d"))
    drawn = F.pmod(F.xxhash64(*by, "_v"), F.lit(1 << 40)) < share * (1 << 40)
    return _met(counts, sizes, by).groupBy(*by).agg(F.sort_array(F.collect_list(F.when(drawn, F.col("_v")))).alias("_cuts"))


def _met(rows: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    """rows with their group's statistics; where the group is the whole table, they are one row."""
    if by:
        return rows.join(stats, by)
    return rows.withColumn("_one", F.lit(0)).join(F.broadcast(stats.withColumn("_one", F.lit(0))), "_one").drop("_one")


def places(df: DataFrame, by: list[str], col: str, depth: int = DEPTH) -> DataFrame:
    """(by, _v, n, below): each different value of a group, its rows, and the rows of the group with smaller values.

    Values are counted first and dealt to ranges between splitters, which are sampled from the group's own values, so
    that ranges are about equally deep, however narrow the column; ranges are placed by their counted rows, and inside one
    values are sorted. So a group of any size is spread over many tasks. Infinities are values like others, NaN comes last.
    Counts are kept in the shared folder: of a mean computed twice the last digit may differ, and with it a value's range.
    """
    counts = df.filter(F.col(col).isNotNull()).groupBy(*by, F.col(col).cast("double").alias("_v")).agg(F.count("*").alias("n"))
    counts = staged(counts, "counts")
    cuts, v = F.col("_cuts"), F.col("_v")

    def halved(at, _):  # a step of binary search: how many splitters are less
        mid = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        less = (at["lo"] < at["hi"]) & (F.get(cuts, mid) < v)
        return F.struct(F.when(less, mid + 1).otherwise(at["lo"]).alias("lo"), F.when(less | (at["lo"] >= at["hi"]), at["hi"]).otherwise(mid).alias("hi"))

    steps = F.sequence(F.lit(1), F.length(F.bin(F.size(cuts).cast("long"))))
    found = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi")), halved)["lo"]
    dealt = _met(counts, splitters(counts, by, depth), by).withColumn("_bucket", F.when(F.size(cuts) == 0, 0).otherwise(found)).drop("_cuts")
    start, inside = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_bucket"), Window.partitionBy(*by, "_bucket").orderBy("_v")
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = dealt.groupBy(*by, "_bucket").agg(F.sum("n").alias("_s")).withColumn("_offset", before("_s", start)).drop("_s")
    placed = dealt.withColumn("_below", before("n", inside)).join(offsets, [*by, "_bucket"])
    return placed.select(*by, "_v", "n", (F.col("_offset") + F.col("_below")).alias("below"))


def with_ranks(df: DataFrame, cols: dict[str, str], by: list[str]) -> DataFrame:
    """df with the average ranks of columns {name: new name} in groups of any size; neither columns nor by may hold NULL.

    Rows find their ranks by value, so df is computed once: rows whose value came out otherwise a second time would be lost.
    """
    out = df = staged(df, "ranked")
    for n, (c, new) in enumerate(cols.items()):
        ranks = places(df, by, c).select(*by, F.col("_v").alias(f"_v{n}"), (F.col("below") + (F.col("n") + 1) / 2).alias(f"_r{n}"))
        out = out.withColumn(f"_v{n}", F.col(c).cast("double")).join(ranks, [*by, f"_v{n}"])
    kept = [c for c in df.columns if c not in cols.values()]
    return out.select(*kept, *(F.col(f"_r{n}").alias(new) for n, new in enumerate(cols.values())))


def quantiles(df: DataFrame, by: list[str], col: str, qs: dict[str, float]) -> DataFrame:
    """(by, names of qs): exact quantiles by linear interpolation, for groups of any size."""
    at = places(df, by, col)
    sizes = at.groupBy(*by).agg(F.sum("n").alias("_all"))
    near = _met(at, sizes, by)
    place = {name: (F.col("_all") - 1) * F.lit(q) for name, q in qs.items()}
    has = lambda x: (F.col("below") <= x) & (x < F.col("below") + F.col("n"))
    ends = {k: v for name, p in place.items() for k, v in ((f"_l_{name}", F.max(F.when(has(F.floor(p)), F.col("_v")))), (f"_h_{name}", F.max(F.when(has(F.ceil(p)), F.col("_v")))))}
    got = near.groupBy(*by, "_all").agg(*(v.alias(k) for k, v in ends.items()))
    # equal ends need no mean, which infinite ones have none of
    mixed = {name: F.when(F.col(f"_l_{name}") == F.col(f"_h_{name}"), F.col(f"_l_{name}")).otherwise(F.col(f"_l_{name}") + (F.col(f"_h_{name}") - F.col(f"_l_{name}")) * (p - F.floor(p))) for name, p in place.items()}
    return got.select(*by, *(v.alias(k) for k, v in mixed.items()))


def spearman(p: DataFrame, by: list[str], min_pairs: int = 2, out: str = "rho", large: bool = False) -> DataFrame:
    """(by, n, rho): correlation of average ranks within each group; large groups are ranked by counts of values."""
    if large:
        ranked = with_ranks(p.select(*by, "x", "y"), {"x": "rx", "y": "ry"}, by)
    else:
        ranked = p.select(*by, average_rank("x", by).alias("rx"), average_rank("y", by).alias("ry"))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), correlation("rx", "ry").alias(out)).filter(F.col("n") >= min_pairs)


def monthly_summary(p: DataFrame, month: str, min_pairs: int = 10, low: float = 0.5) -> DataFrame:
    """Of each char: number of months, median, mean, quartiles and share below `low` of the monthly rank correlations."""
    s = spearman(p, ["char", month], min_pairs).dropna(subset=["rho"])
    q = lambda v: F.percentile("rho", F.lit(v))
    return s.groupBy("char").agg(F.count("*").alias("months"), q(0.5).alias("median_rho"), F.avg("rho").alias("mean_rho"), q(0.25).alias("p25_rho"), q(0.75).alias("p75_rho"), F.avg((F.col("rho") < low).cast("double")).alias("share_low"))


def _share(c: Column) -> Column:
    return F.avg(c.cast("double"))


def match_rates(p: DataFrame, by: list[str]) -> DataFrame:
    d = F.abs(F.col("x") - F.col("y"))
    return p.groupBy(*by).agg(F.count("*").alias("n"), _share(d <= 1e-4).alias("abs_1e4"), _share(F.round("x", 4) == F.round("y", 4)).alias("round_4"), _share(d <= 1e-3 * (1 + F.abs("y"))).alias("rel_1e3"), _share(d <= 1e-6).alias("abs_1e6"), _share(d <= 1e-2).alias("abs_1e2"), _share(F.col("x") == F.col("y")).alias("exact"))


def differences(p: DataFrame, by: list[str]) -> DataFrame:
    """Pearson correlation, RMSE and quantiles of the absolute difference."""
    d = F.abs(F.col("x") - F.col("y"))
    means = p.groupBy(*by).agg(correlation("x", "y").alias("pearson"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(d).alias("mean_abs"), F.max(d).alias("max_abs"))
    return means.join(quantiles(p.withColumn("_d", d), by, "_d", {"median_abs": 0.5, "p95_abs": 0.95, "p99_abs": 0.99}), by)


def winsorized_corr(p: DataFrame, by: list[str], lower: float = 0.01, upper: float = 0.99, joint: bool = False, out: str = "winsor_corr") -> DataFrame:
    """Correlation of values drawn to each side's own quantiles, or to x's for both."""
    b = quantiles(p, by, "x", {"_lx": lower, "_hx": upper})
    b = b.withColumns({"_ly": F.col("_lx"), "_hy": F.col("_hx")}) if joint else b.join(quantiles(p, by, "y", {"_ly": lower, "_hy": upper}), by)
    clip = lambda c: F.least(F.greatest(F.col(c), F.col(f"_l{c}")), F.col(f"_h{c}"))
    return p.join(b, by).groupBy(*by).agg(correlation(clip("x"), clip("y")).alias(out))


def trimmed_corr(p: DataFrame, by: list[str], keep: float = 0.99, out: str = "trimmed_corr") -> DataFrame:
    """Correlation without the largest differences."""
    d = F.abs(F.col("x") - F.col("y"))
    b = quantiles(p.withColumn("_d", d), by, "_d", {"_q": keep})
    return p.join(b, by).filter(d <= F.col("_q") + 1e-9).groupBy(*by).agg(correlation("x", "y").alias(out))


def percent_rank_corr(p: DataFrame, by: list[str], out: str = "percent_rank_corr") -> DataFrame:
    n = p.groupBy(*by).agg(F.count("*").alias("_all"))
    ranked = with_ranks(p.select(*by, "x", "y"), {"x": "rx", "y": "ry"}, by).join(n, by)
    return ranked.groupBy(*by).agg(correlation(F.col("rx") / F.col("_all"), F.col("ry") / F.col("_all")).alias(out))


def bucket_agreement(p: DataFrame, by: list[str], ties: list[str], n: int = 10, min_pairs: int = 20) -> DataFrame:
    """Share of rows in the same n-tile, and of the lowest and highest tile of x that is in y's."""
    b = lambda c: F.ntile(n).over(Window.partitionBy(*by).orderBy(c, *ties))
    m = p.select(*by, b("x").alias("bx"), b("y").alias("by_")).groupBy(*by).agg(F.count("*").alias("n"), _share(F.col("bx") == F.col("by_")).alias("same"), F.avg(F.when(F.col("bx") == 1, (F.col("by_") == 1).cast("double"))).alias("bottom"), F.avg(F.when(F.col("bx") == n, (F.col("by_") == n).cast("double"))).alias("top"))
    return m.filter(F.col("n") >= min_pairs)


def zscore_agreement(p: DataFrame, by: list[str], month: str, tol: float = 0.1) -> DataFrame:
    """Share of rows whose z-scores within the month, by population deviation, lie within tol."""
    s = p.groupBy(*by, month).agg(*(f(c).alias(f"{k}{c}") for c in ("x", "y") for k, f in (("m", F.avg), ("s", F.stddev_pop))))
    z = lambda c: F.try_divide(F.col(c) - F.col(f"m{c}"), F.col(f"s{c}"))
    return p.join(s, [*by, month]).select(*by, z("x").alias("zx"), z("y").alias("zy")).dropna().groupBy(*by).agg(F.count("*").alias("n"), _share(F.abs(F.col("zx") - F.col("zy")) <= tol).alias("z_agree"))


def suspicion(stats: DataFrame, rho: str = "median_rho", match: str = "abs_1e4", n: str = "n") -> DataFrame:
    """stats with a score, 0 for full agreement to 100, and a label."""
    score = 60 * (1 - F.coalesce(rho, F.lit(0.0))) + 40 * (1 - F.coalesce(match, F.lit(0.0)))
    label = F.when(F.col(n) < 20, "few pairs").when(F.col(match) > 0.95, "same").when(F.col(rho) > 0.99, "same order").when(F.col(rho) > 0.95, "close").when(F.col(rho) < 0, "sign").otherwise("differs")
    return stats.withColumn("score", score).withColumn("label", label)


def status_label(stats: DataFrame, rho: str, have: str, good: float = 0.95) -> DataFrame:
    return stats.withColumn("status", F.when(~F.col(have), "missing").when(F.col(rho).isNull(), "no overlap").when(F.col(rho) >= good, "validated").when(F.col(rho) >= 0.8, "partial").otherwise("mismatch"))


def shift_search(a: DataFrame, b: DataFrame, key: str, index: str, x: str, y: str, shifts: list[int]) -> DataFrame:
    """(shift, n, corr) of a's value against b's so many periods later."""
    moved = a.select(key, F.col(x).alias("x"), F.col(index), F.explode(F.array(*map(F.lit, shifts))).alias("shift")).withColumn(index, F.col(index) + F.col("shift"))
    return moved.join(b.select(key, index, F.col(y).alias("y")), [key, index]).dropna(subset=["x", "y"]).groupBy("shift").agg(F.count("*").alias("n"), correlation("x", "y").alias("corr"))


def scale_search(p: DataFrame, scales: list[float]) -> DataFrame:
    """(scale, n, match): share of rows where x times a scale is y."""
    tried = p.withColumn("scale", F.explode(F.array(*map(F.lit, scales))))
    return tried.groupBy("scale").agg(F.count("*").alias("n"), _share(F.abs(F.col("x") * F.col("scale") - F.col("y")) <= 1e-6 * (1 + F.abs("y"))).alias("match"))


def best_alignment(p: DataFrame, by: str, candidate: str, value: str) -> DataFrame:
    """The candidate with the highest value; the first by name of a tie."""
    c = p.groupBy(by).agg(F.max(value).alias("best")).join(p, by).filter(F.col(value) == F.col("best"))
    return c.groupBy(by).agg(F.min(candidate).alias(candidate), F.first("best").alias(value))


def compare_panels(a: DataFrame, b: DataFrame, columns: dict[str, str], key: str = "permno", alignments: tuple = ("signal_yyyymm", "target_yyyymm"), month: str = "month", min_pairs: int = 50, low: float = 0.5, every: bool = False) -> DataFrame:
    """How each column pair {a's: b's} agrees, under that alignment of a's months to b's under which it does best.

    (char, alignment, keys and entities of either and both, n, pooled_rho, median, mean and share of low monthly rank
    correlations, match rates, pearson, rmse.) Both panels become long, a's once for each alignment, within b's months;
    one aggregation by key pairs them and tells what only one has, one by entity and one by column sum all that needs no
    rank. The best alignment is that of the highest median; of a tie, or without any, the first. every: all alignments.
    """
    span = b.agg(F.min(month).alias("_from"), F.max(month).alias("_to"))
    cell = lambda c, name, at, **more: F.struct(F.lit(name).alias("char"), F.lit(at[0]).alias("alignment"), F.lit(at[1]).alias("_order"), *(v.alias(k) for k, v in more.items()))
    none, order = F.lit(None).cast("double"), list(zip(alignments, range(len(alignments)), strict=True))
    left = _met(a, span, []).select(key, F.explode(F.array(*(cell(c, c, at, _m=F.col(at[0]), x=F.col(c).cast("double"), y=none) for at in order for c in columns))).alias("_c"), "_from", "_to").select(key, "_c.*", "_from", "_to").filter(F.col("x").isNotNull() & F.col("_m").between(F.col("_from"), F.col("_to"))).drop("_from", "_to")
    right = b.select(key, F.explode(F.array(*(cell(d, c, at, _m=F.col(month), x=none, y=F.col(d).cast("double")) for at in order for c, d in columns.items()))).alias("_c")).select(key, "_c.*").filter(F.col("y").isNotNull())
    by = ["char", "alignment", "_order"]
    met = left.unionByName(right).groupBy(*by, key, "_m").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    both, d = F.col("x").isNotNull() & F.col("y").isNotNull(), F.abs(F.col("x") - F.col("y"))
    if_both = lambda c: F.sum(F.when(both, c.cast("double")))
    sums = {"_both": F.count_if(both), "_a": F.count("x"), "_b": F.count("y"), "_sd": if_both(d * d), "_abs": if_both(d <= 1e-4), "_round": if_both(F.round("x", 4) == F.round("y", 4)), "_rel": if_both(d <= 1e-3 * (1 + F.abs("y")))}
    entity = met.groupBy(*by, key).agg(*(v.alias(k) for k, v in sums.items()))
    n = lambda c: F.sum(c).alias(c)
    has = lambda c: F.count_if(F.col(c) > 0)
    whole = entity.groupBy(*by).agg(*map(n, sums), has("_a").alias("entities_a"), has("_b").alias("entities_b"), has("_both").alias("entities_both"))
    share = lambda c: F.try_divide(c, "_both")
    told = whole.select(*by, F.col("_a").alias("keys_a"), F.col("_b").alias("keys_b"), F.col("_both").alias("n"), (F.col("_b") - F.col("_both")).alias("only_b"), (F.col("_a") - F.col("_both")).alias("only_a"), "entities_a", "entities_b", "entities_both", share("_abs").alias("abs_1e4"), share("_round").alias("round_4"), share("_rel").alias("rel_1e3"), F.sqrt(share("_sd")).alias("rmse"))
    pairs_ = met.filter(both)
    pooled = spearman(pairs_, by, 2, "pooled_rho", large=True).drop("n")
    pearson = pairs_.groupBy(*by).agg(correlation("x", "y").alias("pearson"))
    monthly = spearman(pairs_, [*by, "_m"], min_pairs).dropna(subset=["rho"]).groupBy(*by).agg(F.count("*").alias("months"), F.median("rho").alias("median_rho"), F.avg("rho").alias("mean_rho"), F.avg((F.col("rho") < low).cast("double")).alias("share_low"))
    out = told.join(pooled, by, "left").join(pearson, by, "left").join(monthly, by, "left").withColumn("months", F.coalesce("months", F.lit(0)))
    if every:
        return out.drop("_order")
    rest = [c for c in out.columns if c not in ("char", "_order")]
    best = out.groupBy("char").agg(F.max_by(F.struct(*rest), F.struct(F.col("median_rho").isNotNull(), F.col("median_rho"), -F.col("_order"))).alias("_best"))
    return best.select("char", "_best.*")


def ranked_last_nulls(stats: DataFrame, value: str, name: str = "char", out: str = "place") -> DataFrame:
    """stats of columns in order of agreement: the best first, those without a value last, by name where they tie."""
    w = Window.orderBy(F.col(value).desc_nulls_last(), name)
    return stats.withColumn(out, F.row_number().over(w)).orderBy(out)


def agreement_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, corr) of average ranks for every two columns, in one aggregation over rows that have all."""
    ranked = df.dropna(subset=cols).select(*(F.col(c).cast("double").alias(c) for c in cols))
    ranked = with_ranks(ranked, {c: c for c in cols}, [])
    two = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    one = ranked.agg(*(correlation(a, b).alias(f"{a}|{b}") for a, b in two))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in two))).alias("_kv")).select("_kv.*")


def key_multiplicity(df: DataFrame, choices: list[list[str]]) -> DataFrame:
    """(keys, rows, unique_keys, duplicate_groups, max_multiplicity) for each choice of key columns."""
    out = None
    for keys in choices:
        g = df.groupBy(*keys).count().agg(F.sum("count").alias("rows"), F.count("*").alias("unique_keys"), F.sum(F.when(F.col("count") > 1, 1).otherwise(0)).alias("duplicate_groups"), F.max("count").alias("max_multiplicity")).select(F.lit("+".join(keys)).alias("keys"), "*")
        out = g if out is None else out.unionByName(g)
    return out


def histogram(df: DataFrame, value, digits: int = 0, by: list[str] | None = None) -> DataFrame:
    v = F.col(value) if isinstance(value, str) else value
    return df.withColumn("bin", F.round(v, digits)).groupBy(*(by or []), "bin").agg(F.count("*").alias("n"))
