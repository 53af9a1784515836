"""Rolling regressions from sums of products, solved in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import month_index


def compound(daily: DataFrame, key: str, date: str, ret: str, out: str = "ret") -> DataFrame:
    """(key, week, out): returns compounded to weeks that end on Fridays; NULL without any return, and -1 with a loss of all.

    The logarithm of a loss of all is NULL, which sums leave out, as they do those of returns below it.
    """
    week = F.date_add(date, (4 - F.weekday(date)).cast("int"))
    return daily.groupBy(key, week.alias("week")).agg(F.when(F.bool_or(F.col(ret) == -1), -1.0).otherwise(F.expm1(F.sum(F.log1p(ret)))).alias(out))


def with_market(weekly: DataFrame, week: str = "week", ret: str = "ret", out: str = "mkt") -> DataFrame:
    """weekly with the equal-weight mean return of each week."""
    return weekly.join(weekly.groupBy(week).agg(F.avg(ret).alias(out)), week)


def rolled(rows: DataFrame, spine: DataFrame, key: str, month: str, date: str, sums: dict[str, Column], months_back: tuple, first: str | None = None) -> DataFrame:
    """spine's (key, month) with sums over the rows of each month's window: from the first day of the month months_back[0]
    before it to the first day of the month months_back[1] before it. first: a column of which the window's first row is kept.

    Rows become one row of sums a month; these are rolled by a RANGE frame over the whole months, and the rows of the
    window's last day, a first of its month, are added. So a row is shuffled once, however long the window is.
    """
    start, end = months_back
    edge = lambda e: F.coalesce(F.sum(F.when(F.dayofmonth(date) == 1, e)), F.lit(0))
    ordered = {"_first": F.min_by(first, date)} if first else {}
    monthly = rows.groupBy(key, month_index(F.col(date)).alias(month)).agg(*(F.coalesce(F.sum(e), F.lit(0)).alias(n) for n, e in sums.items()), *(edge(e).alias(f"_e_{n}") for n, e in sums.items()), *(c.alias(n) for n, c in ordered.items()))
    asked = spine.select(key, month).distinct().withColumn("_asked", F.lit(True))
    both = monthly.unionByName(asked, allowMissingColumns=True).groupBy(key, month).agg(*(F.max(c).alias(c) for c in (*sums, *(f"_e_{n}" for n in sums), *ordered, "_asked")))
    w = Window.partitionBy(key).orderBy(month)
    whole, last = w.rangeBetween(-start, -end - 1), w.rangeBetween(-end, -end)
    of = {n: F.coalesce(F.sum(n).over(whole), F.lit(0)) + F.coalesce(F.sum(f"_e_{n}").over(last), F.lit(0)) for n in sums}
    kept = {"_first": F.first("_first", ignorenulls=True).over(whole)} if first else {}
    return both.select(key, month, "_asked", *(c.alias(n) for n, c in (of | kept).items())).filter("_asked").drop("_asked")


def rolling_regression(obs: DataFrame, spine: DataFrame, key: str, month: str, date: str, y: str, x: str, months_back: tuple = (36, 1), min_obs: int = 52, lags: int = 0) -> DataFrame:
    """spine with beta, betasq, idiovol, n_obs and, with lags, pricedelay of y on x over each month's window."""
    use = obs.dropna(subset=[y, x])
    a, b = F.col(y), F.col(x)
    sums = {"_n": F.lit(1), "_y": a, "_x": b, "_yy": a * a, "_xy": a * b, "_xx": b * b}
    at = rolled(use, spine, key, month, date, sums, months_back).filter(F.col("_n") >= min_obs)
    fit = at.select(key, month, F.col("_n").alias("n_obs"), _less("_xy", "_x", "_y", "_n").alias("_sxy"), _less("_xx", "_x", "_x", "_n").alias("_sxx"), _less("_yy", "_y", "_y", "_n").alias("_syy"))
    beta = F.try_divide("_sxy", "_sxx")
    rest = F.greatest(F.col("_syy") - F.try_divide(F.col("_sxy") * F.col("_sxy"), F.col("_sxx")), F.lit(0.0))
    out = fit.select(key, month, "n_obs", beta.alias("beta"), (beta * beta).alias("betasq"), F.sqrt(rest / (F.col("n_obs") - 1)).alias("idiovol"))
    if lags:
        out = out.join(price_delay(use, spine, key, month, date, y, x, lags, months_back, min_obs), [key, month], "left")
    return spine.join(out, [key, month], "inner")


def price_delay(obs: DataFrame, spine: DataFrame, key: str, month: str, date: str, y: str, x: str, lags: int, months_back: tuple, min_obs: int) -> DataFrame:
    """1 - adjusted R^2 on x alone / adjusted R^2 on x and its lags, in each window; the latter without the window's first rows, whose lags lie outside.

    Rows become sums of products a month, rolled like those of the other regressions; what the window's first rows add is
    a running sum that goes with each row, taken at the window's first one, and subtracted. The regression is solved by
    sweeping one regressor after the other out of the sums.
    """
    w = Window.partitionBy(key).orderBy(date)
    cols = [y, x, *(f"_l{i}" for i in range(1, lags + 1))]
    k = len(cols)
    lagged = obs.select(key, date, y, x, *(F.lag(x, i).over(w).alias(f"_l{i}") for i in range(1, lags + 1)))
    whole = F.lit(True)
    for c in cols:
        whole = whole & F.col(c).isNotNull()
    of = {"_n": F.lit(1.0)} | {f"_s{i}": F.col(a) for i, a in enumerate(cols)} | {f"_p{i}_{j}": F.col(a) * F.col(b) for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i}
    of = {n: F.coalesce(F.when(whole, e), F.lit(0.0)) for n, e in of.items()}
    terms = lagged.select(key, date, y, x, *(e.alias(n) for n, e in of.items()))
    heads = terms.select(key, date, y, x, *of, F.struct(*(F.sum(n).over(w.rowsBetween(0, lags - 1)).alias(n) for n in of)).alias("_head"))
    a, b = F.col(y), F.col(x)
    one = {"_all": F.lit(1), "_y": a, "_x": b, "_yy": a * a, "_xy": a * b, "_xx": b * b}
    sums = rolled(heads, spine, key, month, date, one | {n: F.col(n) for n in of}, months_back, "_head").filter((F.col("_all") >= min_obs))
    r2 = F.try_divide(F.pow(_less("_xy", "_x", "_y", "_all"), F.lit(2)), _less("_xx", "_x", "_x", "_all") * _less("_yy", "_y", "_y", "_all"))
    inner = sums.select(key, month, "_all", r2.alias("_r2"), *((F.col(n) - F.coalesce(F.col(f"_first.{n}"), F.lit(0.0))).alias(n) for n in of))
    centred = inner.filter(F.col("_n") > k).select(key, month, "_all", "_r2", "_n", *(_less(f"_p{i}_{j}", f"_s{i}", f"_s{j}", "_n").alias(f"_c{i}_{j}") for i in range(k) for j in range(i, k)))
    many = swept(centred.withColumn("_total", F.col("_c0_0")), "_c", k)
    adjusted = lambda r2, n, regressors: 1 - (1 - r2) * (n - 1) / (n - regressors - 1)
    one_, all_ = adjusted(F.col("_r2"), F.col("_all"), 1), adjusted(1 - F.try_divide("_c0_0", "_total"), F.col("_n"), k - 1)
    return many.select(key, month, (1 - F.try_divide(one_, all_)).alias("pricedelay"))


def _less(product: str, a: str, b: str, n: str) -> Column:
    """A centred sum of products."""
    return F.col(product) - F.col(a) * F.col(b) / F.col(n)


def swept(df: DataFrame, stem: str, k: int) -> DataFrame:
    """Centred sums of products stem{i}_{j}, i <= j < k, with 1 to k - 1 partialled out: stem0_0 is what they leave of 0."""
    for p in range(k - 1, 0, -1):
        at = lambda i, j: F.col(f"{stem}{min(i, j)}_{max(i, j)}")
        rest = {f"{stem}{i}_{j}": at(i, j) - F.coalesce(F.try_divide(at(i, p) * at(j, p), at(p, p)), F.lit(0.0)) for i in range(p) for j in range(i, p)}
        df = df.select(*(c for c in df.columns if not c.startswith(stem)), *(v.alias(n) for n, v in rest.items()))
    return df


def daily_excess(daily: DataFrame, delist: DataFrame, factors: DataFrame, key: str = "permno", date: str = "date", rf: str = "rf", out: str = "exret") -> DataFrame:
    """Daily rows with factors, where the day has any, and out: the return compounded with the delisting return of the very day, over the rate; a missing return of either kind is 0."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    j = daily.join(delist.select(key, date, "dlret"), [key, date], "left").join(factors, date, "left")
    return j.withColumn(out, (1 + zero("ret")) * (1 + zero("dlret")) - 1 - F.col(rf))


def residual_variance(daily: DataFrame, key: str, date: str, y: str, xs: list[str], out: str, periods: int = 3, min_obs: int = 21) -> DataFrame:
    """(key, m, out): variance of the residuals of y on one or three factors over a month and the observed ones before.

    A month is observed if it has a row; rows without y or a factor do not count.
    Days become a month's sums of products, months are added up over rows, and the normal equations are solved in
    place by determinants.
    """
    cols = [y, *xs]
    k = len(cols)
    names = [f"s{i}" for i in range(k)] + [f"p{i}{j}" for i in range(k) for j in range(i, k)]
    whole = F.lit(True)
    for c in cols:
        whole = whole & F.col(c).isNotNull()
    of = lambda e: F.coalesce(F.sum(F.when(whole, e)), F.lit(0.0))
    sums = [of(F.col(c)) for c in cols] + [of(F.col(cols[i]) * F.col(cols[j])) for i in range(k) for j in range(i, k)]
    monthly = daily.groupBy(key, month_index(F.col(date)).alias("m")).agg(F.count_if(whole).alias("n"), *(s.alias(a) for s, a in zip(sums, names, strict=True)))
    w = Window.partitionBy(key).orderBy("m").rowsBetween(-(periods - 1), 0)
    rolled = monthly.select(key, "m", *(F.sum(c).over(w).alias(c) for c in ("n", *names)))
    c = {(i, j): F.col(f"p{i}{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n") for i in range(k) for j in range(i, k)}
    centred = rolled.select(key, "m", "n", *(v.alias(f"c{i}{j}") for (i, j), v in c.items()))
    at = lambda i, j: F.col(f"c{min(i, j)}{max(i, j)}")
    explained = _quadratic([[at(i, j) for j in range(1, k)] for i in range(1, k)], [at(0, i) for i in range(1, k)])
    value = F.greatest(at(0, 0) - explained, F.lit(0.0)) / (F.col("n") - 1)
    return centred.filter(F.col("n") >= min_obs).select(key, "m", value.alias(out))


def _det(a: list[list[Column]]) -> Column:
    if len(a) == 1:
        return a[0][0]
    total = F.lit(0.0)
    for j, top in enumerate(a[0]):
        term = top * _det([row[:j] + row[j + 1 :] for row in a[1:]])
        total = total + term if j % 2 == 0 else total - term
    return total


def _quadratic(a: list[list[Column]], b: list[Column]) -> Column:
    """b' a^-1 b by Cramer's rule."""
    total = F.lit(0.0)
    for i in range(len(b)):
        swapped = [[b[r] if c == i else a[r][c] for c in range(len(b))] for r in range(len(b))]
        total = total + b[i] * F.try_divide(_det(swapped), _det(a))
    return total
