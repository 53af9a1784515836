"""Statistics of groups put back on their rows, winsorizing, imputing, ranking.

Statistics are grouped aggregates joined back by null-safe keys: sums combine before the shuffle and a large
group is one row, where a window would gather it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import rounded
from ..storage import staged_alone

STATS = {"mean": F.avg, "median": F.median, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "std": F.stddev_samp}


def back(df: DataFrame, stats: DataFrame, by: list[str], how: str = "left") -> DataFrame:
    """df with the columns of stats, matched by keys that may be NULL."""
    r = stats.select(*(F.col(c).alias(f"_b_{c}") if c in by else F.col(c) for c in stats.columns))
    cond = F.lit(True)
    for c in by:
        cond = cond & df[c].eqNullSafe(r[f"_b_{c}"])
    return df.join(r, cond, how).drop(*(f"_b_{c}" for c in by))


def group_stat(df: DataFrame, by: list[str], value: str | list[str], stat: str = "mean", out: str | list[str] | None = None) -> DataFrame:
    """df with a statistic of each value over its group; rows without a group key are a group."""
    values = [value] if isinstance(value, str) else value
    outs = [out] if isinstance(out, str) else out or [f"{v}_{stat}" for v in values]
    return back(df, df.groupBy(*by).agg(*(STATS[stat](v).alias(o) for v, o in zip(values, outs, strict=True))), by)


def demean(df: DataFrame, by: list[str], value: str | list[str], stat: str = "mean", out: str | list[str] | None = None) -> DataFrame:
    values = [value] if isinstance(value, str) else value
    outs = [out] if isinstance(out, str) else out or [f"{v}_ia" for v in values]
    marks = [f"_s_{v}" for v in values]
    stats = group_stat(df, by, values, stat, marks)
    return stats.withColumns({o: F.col(v) - F.col(m) for v, o, m in zip(values, outs, marks, strict=True)}).drop(*marks)


def in_long_form(df: DataFrame, cols: list[str], by: list[str], steps: list[Callable[[DataFrame], DataFrame]], carried: list[str] = ()) -> DataFrame:
    """df with cols replaced by what the steps make of them, all columns at once and for one exchange, by cross-section.

    A row becomes one narrow row for each column: by and carried columns, _c (the column's place in cols) and _v, which
    steps replace by windows over (by, _c); one aggregation makes rows of them again. Steps need no further exchange as
    long as their groups are parts of a cross-section, and hold no buffer of values: windows spill. More than BATCH columns
    go by so many at a time, each batch written before the next is made, so that the disk holds the long form of one alone.
    """
    if not cols:
        return df
    if len(cols) > BATCH:
        return _in_batches(df, cols, by, steps, carried)
    rest = [c for c in df.columns if c not in cols and c not in by]
    keys = [*by, *(c for c in carried if c not in by)]
    dealt = df.repartition(*by).withColumn("_row", F.monotonically_increasing_id())
    whole = F.struct(*rest) if rest else F.struct(F.lit(0).alias("_none"))
    each = F.array(*(F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v"), (F.when(F.lit(i == 0), whole)).alias("_rest")) for i, c in enumerate(cols)))
    long = dealt.select("_row", *keys, F.explode(each).alias("_e")).select("_row", *keys, "_e.*")
    for step in steps:
        long = step(long)
    wide = long.groupBy(*by, "_row").agg(F.first("_rest", ignorenulls=True).alias("_rest"), F.array_sort(F.collect_list(F.struct("_c", "_v"))).alias("_vs"))
    place = {c: i for i, c in enumerate(cols)}
    return wide.select(*(F.col("_vs")[place[c]]["_v"].alias(c) if c in place else F.col(c) if c in by else F.col(f"_rest.{c}").alias(c) for c in df.columns))


def _in_batches(df: DataFrame, cols: list[str], by: list[str], steps: list[Callable], carried: list[str]) -> DataFrame:
    """in_long_form() of stored rows with numbers, a batch of columns at a time; one aggregation by number makes rows of the batches again."""
    kept = staged_alone(df.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    rest = [c for c in df.columns if c not in cols]
    parts = [kept.select("_id", F.struct(*(rest or ["_id"])).alias("_p0"))]
    for at in range(0, len(cols), BATCH):
        some = cols[at : at + BATCH]
        extra = [c for c in dict.fromkeys([*by, *carried]) if c not in some]
        made = in_long_form(kept.select("_id", *extra, *some), some, by, at_places(steps, at, len(cols), BATCH), carried)
        parts.append(staged_alone(made.select("_id", *some), "batch").select("_id", F.struct(*some).alias(f"_p{len(parts)}")))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    whole = union.groupBy("_id").agg(*(F.first(c, ignorenulls=True).alias(c) for c in union.columns if c != "_id"))
    place = {c: f"_p{i // BATCH + 1}" for i, c in enumerate(cols)} | dict.fromkeys(rest, "_p0")
    return whole.select(*(F.col(f"{place[c]}.{c}").alias(c) for c in df.columns))


def at_places(steps: list[Callable], at: int, n: int, batch: int) -> list[Callable]:
    """The steps for columns at to at + batch - 1 of n, which they know as the first ones: those of drawn_in() may have bounds for each column."""
    return [step.of(at, min(at + batch, n)) if hasattr(step, "of") else step for step in steps]


def with_quantiles(long: DataFrame, by: list[str], qs: dict[str, float]) -> DataFrame:
    """Rows in long form with exact quantiles, by linear interpolation, of each column's values over by, and _n, their number."""
    group = Window.partitionBy(*by, "_c")
    order = group.orderBy(F.col("_v").asc_nulls_last())
    placed = long.select("*", (F.row_number().over(order) - 1).alias("_place"), F.count("_v").over(group).alias("_n"))
    at = {name: (F.col("_n") - 1) * F.lit(float(q)) for name, q in qs.items()}
    met = lambda x: F.max(F.when((F.col("_place") == x) & F.col("_v").isNotNull(), F.col("_v"))).over(group)
    ends = placed.select("*", *(met(f(x)).alias(f"_{k}_{name}") for name, x in at.items() for k, f in (("l", F.floor), ("h", F.ceil))))
    mixed = {name: F.when(F.col(f"_l_{name}") == F.col(f"_h_{name}"), F.col(f"_l_{name}")).otherwise(F.col(f"_l_{name}") * (1 - (x - F.floor(x))) + F.col(f"_h_{name}") * (x - F.floor(x))) for name, x in at.items()}
    return ends.select(*long.columns, "_n", *(v.alias(name) for name, v in mixed.items()))


#: Columns whose values are sorted at a time.
BATCH = 12


def quantiles_by_batch(df: DataFrame, cols: list[str], by: list[str], qs: dict[str, float]) -> DataFrame:
    """(by, _b): of each cross-section an array over cols of (_n, names of qs): numbers of values and exact quantiles, by linear interpolation.

    BATCH columns at a time go to narrow rows (by, column, value), which are sorted, numbered and left out again but for those
    beside a quantile; the shuffle of a batch is removed before the next one. df should be a stored table, as it is read
    once a batch. What is broadcast is a row for each cross-section and column.
    """
    found = []
    for at in range(0, len(cols), BATCH):
        each = F.array(*(F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(cols[at : at + BATCH], at)))
        long = df.select(*by, F.explode(each).alias("_e")).select(*by, "_e.*").filter("_v is not null")
        sizes = long.groupBy(*by, "_c").agg(F.count("*").alias("_n"))
        placed = long.withColumn("_place", F.row_number().over(Window.partitionBy(*by, "_c").orderBy("_v")) - 1)
        x = {name: (F.col("_n") - 1) * F.lit(float(q)) for name, q in qs.items()}
        ends = {f"_{k}_{name}": F.max(F.when(F.col("_place") == f(v), F.col("_v"))) for name, v in x.items() for k, f in (("l", F.floor), ("h", F.ceil))}
        met = back(placed, F.broadcast(sizes), [*by, "_c"], "inner").groupBy(*by, "_c", "_n").agg(*(v.alias(k) for k, v in ends.items()))
        mixed = {name: F.when(F.col(f"_l_{name}") == F.col(f"_h_{name}"), F.col(f"_l_{name}")).otherwise(F.col(f"_l_{name}") * (1 - (v - F.floor(v))) + F.col(f"_h_{name}") * (v - F.floor(v))) for name, v in x.items()}
        found.append(staged_alone(met.select(*by, "_c", "_n", *(v.alias(k) for k, v in mixed.items())), "quantiles"))
    told = found[0]
    for more in found[1:]:
        told = told.unionByName(more)
    mapped = told.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_c", F.struct("_n", *qs)))).alias("_m"))
    return staged_alone(mapped.select(*by, F.transform(F.sequence(F.lit(0), F.lit(len(cols) - 1)), lambda i: F.try_element_at("_m", i)).alias("_b")), "bounds")


def drawn_in(by: list[str], lower: float | list | None, upper: float | list | None, min_obs: int = 1) -> Callable:
    """A step that draws values to their quantiles. Lists have a bound, or None, for each column."""

    def step(long: DataFrame) -> DataFrame:
        tails = {"_lower": lower, "_upper": upper}
        qs = {f"{k}{q}".replace(".", "_"): q for k, v in tails.items() for q in {x for x in (v if isinstance(v, list) else [v]) if x is not None}}
        out = with_quantiles(long, by, qs)

        def bound(k: str):
            v = tails[k]
            name = lambda q: F.col(f"{k}{q}".replace(".", "_"))
            if not isinstance(v, list):
                return None if v is None else name(v)
            own = F.lit(None).cast("double")
            for q in {x for x in v if x is not None}:
                own = F.when(F.col("_c").isin([i for i, x in enumerate(v) if x == q]), name(q)).otherwise(own)
            return own

        low, high, value = bound("_lower"), bound("_upper"), F.col("_v")
        for f, end in ((F.greatest, low), (F.least, high)):
            if end is not None:
                value = f(value, F.coalesce(end, value))
        drawn = F.when(F.col("_v").isNotNull() & (F.col("_n") >= min_obs), value).otherwise(F.col("_v"))
        return out.select(*(drawn.alias("_v") if c == "_v" else F.col(c) for c in long.columns))

    cut = lambda v, a, b: v[a:b] if isinstance(v, list) else v
    step.of = lambda a, b: drawn_in(by, cut(lower, a, b), cut(upper, a, b), min_obs)
    return step


def filled_in(levels: list[list[str]], null_group: bool = True) -> Callable:
    """A step that gives missing values the median of the first level that has one; all medians are of the values before it."""

    def step(long: DataFrame) -> DataFrame:
        out, medians = long, []
        for i, by in enumerate(levels):
            out = with_quantiles(out, by, {f"_median{i}": 0.5}).drop("_n")
            known = F.lit(True)
            for c in by if not null_group else ():
                known = known & F.col(c).isNotNull()
            medians.append(F.when(known, F.col(f"_median{i}")))
        return out.select(*(F.coalesce("_v", *medians).alias("_v") if c == "_v" else F.col(c) for c in long.columns))

    return step


def ranked_in(by: list[str], fill: float | None = 0.0) -> Callable:
    """A step that makes average ranks on [-1, 1] of values; a single one is 0, a missing one `fill`."""

    def step(long: DataFrame) -> DataFrame:
        group = Window.partitionBy(*by, "_c")
        ties = Window.partitionBy(*by, "_c", "_v")
        rank, n = F.rank().over(group.orderBy(F.col("_v").asc_nulls_last())), F.count("_v").over(group)
        placed = long.select("*", (rank + (F.count(F.lit(1)).over(ties) - 1) / 2).alias("_rank"), n.alias("_n"))
        unit = F.when(F.col("_v").isNull(), F.lit(fill).cast("double")).when(F.col("_n") > 1, 2 * (F.col("_rank") - 1) / (F.col("_n") - 1) - 1).otherwise(0.0)
        return placed.select(*(unit.alias("_v") if c == "_v" else F.col(c) for c in long.columns))

    return step


def winsorize(df: DataFrame, cols: list[str], by: list[str], lower: float | None = 0.01, upper: float | None = 0.99, min_obs: int = 1) -> DataFrame:
    """Values drawn to their cross-section's exact quantiles, by linear interpolation; a None bound leaves that side."""
    return in_long_form(df, cols, by, [drawn_in(by, lower, upper, min_obs)])


#: Features of which only the upper tail is drawn in, and those of which both are: fixed values.
UPPER_TAIL = """betasq mve mvel1 me dy lev baspread depr sp turn dolvol std_dolvol std_turn disp idiovol obklg roavol ill age rd_sale
    rd_mve rdm retvol rvar_mean zerotrade stdcf tang absacc stdacc cash orgcap salecash salerec saleinv pchsaleinv cashdebt realestate
    secured""".split()
BOTH_TAILS = """beta ep fgr5yr mom12m mom1m mom6m mom36m indmom sue agr maxret chfeps bm book_to_market currat pchcurrat quick pchquick
    pchdepr sgr chempia acc pchsale_pchinvt pchsale_pchrect pchcapx_ia pchgm_pchsale pchsale_pchxsga mve_ia me_ia cfp_ia bm_ia sfe chinv
    grltnoa cinvest tb cfp cash_flow_to_price lgr egr pricedelay grcapx chmom roic aeavol chcsho chpmia chatoia grGW ear abr rsup spi
    hire chadv cashpr roaq roe roeq invest chtx pctacc gma operprof operating_profitability op""".split()


def winsorize_by_kind(df: DataFrame, by: list[str], tail: float = 0.01) -> DataFrame:
    """df with the features of either list, whatever their case, drawn in; flags and other columns stay."""
    either = {n.lower() for n in UPPER_TAIL}, {n.lower() for n in BOTH_TAILS}
    cols = [c for c in df.columns if c.lower() in either[0] | either[1]]
    lower = [tail if c.lower() in either[1] else None for c in cols]
    if len(cols) <= BATCH:
        return in_long_form(df, cols, by, [drawn_in(by, lower, 1 - tail)])
    kept = staged_alone(df, "undrawn")
    met = back(kept, F.broadcast(quantiles_by_batch(kept, cols, by, {"_lower": tail, "_upper": 1 - tail})), by)

    def drawn(i: int, c: str):
        v, b = F.col(c).cast("double"), F.get("_b", F.lit(i))
        above = v if lower[i] is None else F.greatest(v, b["_lower"])
        return F.when(v.isNotNull(), F.least(above, b["_upper"])).alias(c)

    place = {c: i for i, c in enumerate(cols)}
    return met.select(*(drawn(place[c], c) if c in place else F.col(c) for c in df.columns))


def impute_median(df: DataFrame, cols: list[str], levels: list[list[str]], suffix: str | None = None, null_group: bool = True) -> DataFrame:
    """Missing values take the median of the first level that has one; in place, or in new columns with a suffix."""
    by = [c for c in levels[0] if all(c in level for level in levels)]
    carried = sorted({c for level in levels for c in level} - {*by})
    new = [c + (suffix or "") for c in cols]
    copied = df.withColumns(dict(zip(new, map(F.col, cols), strict=True))) if suffix else df
    return in_long_form(copied, new, by, [filled_in(levels, null_group)], carried)


def rank_unit(df: DataFrame, cols: list[str], by: list[str], fill: float | None = 0.0) -> DataFrame:
    """Average ranks of each cross-section on [-1, 1]; a single value is 0, a missing one `fill`."""
    return in_long_form(df, cols, by, [ranked_in(by, fill)])


def standardized(df: DataFrame, cols: list[str], by: list[str], levels: list[list[str]], lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    """Winsorized, imputed by the medians of levels, which are parts of cross-sections, and ranked: one pass for all columns."""
    carried = sorted({c for level in levels for c in level} - {*by})
    return in_long_form(df, cols, by, [drawn_in(by, lower, upper), filled_in(levels), ranked_in(by)], carried)


def one_hot(df: DataFrame, col: str, codes: list, prefix: str) -> DataFrame:
    """A 0/1 column for each code; a row without code has none."""
    return df.select("*", *(F.coalesce((F.col(col) == c).cast("double"), F.lit(0.0)).alias(f"{prefix}{c}") for c in codes))


def interact(df: DataFrame, macro: DataFrame, on: str, cols: list[str], by: list[str]) -> DataFrame:
    """df with the product of each column and each macro series, in one projection."""
    joined = df.join(macro.select(on, *by), on, "left")
    return joined.select(*df.columns, *((F.col(c) * F.col(m)).alias(f"{c}_x_{m}") for m in by for c in cols))


def modal(df: DataFrame, by: list[str], value: str, digits: int = 6) -> DataFrame:
    """(by, mode, mode_n, n): the most frequent rounded value of each cell; the smaller one of a tie."""
    counts = df.dropna(subset=[value]).groupBy(*by, rounded(value, digits).alias("mode")).agg(F.count("*").alias("mode_n"))
    return counts.groupBy(*by).agg(F.max_by("mode", F.struct("mode_n", -F.col("mode"))).alias("mode"), F.max("mode_n").alias("mode_n"), F.sum("mode_n").alias("n"))
