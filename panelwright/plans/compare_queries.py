"""Queries of the comparison and audit toolkit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import correlation, rounded
from ..operators import audit, compare, timing, windows
from ..operators import crosssection as x
from .operator_queries import EXCESS_SQL, _excess
from .shapes import Query

COLUMNS = {"a": "a2", "b": "b2", "c": "c2"}


def _pairs(v):
    return compare.pairs(v("panel_a"), v("panel_b"), COLUMNS, ["permno", "m"], "m")


PAIRS = "(" + " UNION ALL ".join(f"SELECT p.permno, p.m, '{a}' AS char, CAST(p.{a} AS DOUBLE) AS x, CAST(q.{b} AS DOUBLE) AS y FROM {{panel_a}} p JOIN {{panel_b}} q ON p.permno = q.permno AND p.m = q.m WHERE p.{a} IS NOT NULL AND q.{b} IS NOT NULL" for a, b in COLUMNS.items()) + ")"


def _ranks(by: str) -> str:
    r = lambda c: f"rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2e0"
    return f"(SELECT *, {r('x')} AS rx, {r('y')} AS ry FROM {PAIRS})"


MONTHLY = f"(SELECT char, m, count(*) AS n, corr(rx, ry) AS rho FROM {_ranks('char, m')} GROUP BY 1, 2 HAVING count(*) >= 10)"
MATCH = f"SELECT char, count(*) AS n, avg(CASE WHEN abs(x - y) <= 1e-4 THEN 1e0 ELSE 0 END) AS abs_1e4, avg(CASE WHEN abs(x - y) <= 1e-3 * (1 + abs(y)) THEN 1e0 ELSE 0 END) AS rel_1e3, avg(CASE WHEN abs(x - y) <= 1e-6 THEN 1e0 ELSE 0 END) AS abs_1e6, avg(CASE WHEN x = y THEN 1e0 ELSE 0 END) AS exact FROM {PAIRS} GROUP BY char"
SUMMARY = f"SELECT char, count(*) AS months, median(rho) AS median_rho, avg(rho) AS mean_rho, quantile_cont(rho, 0.25) AS p25_rho, quantile_cont(rho, 0.75) AS p75_rho, avg(CASE WHEN rho < 0.5 THEN 1e0 ELSE 0 END) AS share_low FROM {MONTHLY} WHERE rho IS NOT NULL GROUP BY char"


def _suspicion(v):
    p = _pairs(v)
    return compare.suspicion(compare.monthly_summary(p, "m").join(compare.match_rates(p, ["char"]), "char"))


def _shift(v):
    a = v("panel_a").select("permno", "m", "c")
    return compare.shift_search(a, v("panel_b").select("permno", "m", "c2"), "permno", "m", "c", "c2", list(range(-2, 3)))


def _modes(v):
    return audit.modal_benchmark(v("adjusted"), "industry", "m", "implied", 4)


MODES = "(SELECT industry, m, mode, mode_n, n FROM (SELECT industry, m, round(implied, 4) AS mode, count(*) AS mode_n, sum(count(*)) OVER (PARTITION BY industry, m) AS n FROM {adjusted} GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY industry, m ORDER BY mode_n DESC, mode) = 1)"


def _linearity(v):
    lev = v("adjusted").select("permno", "m", "base", "adj", F.floor(F.col("base") / 400).cast("int").alias("level"))
    return audit.window_linearity(windows.islands(lev, "level", "permno", "m", "island"), "island", ["permno"], "m", "base", 3)


ISLANDS = "(SELECT *, sum(CASE WHEN level = pl AND m - pm = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY permno ORDER BY m) AS island FROM (SELECT *, lag(level) OVER w AS pl, lag(m) OVER w AS pm FROM (SELECT permno, m, base, CAST(floor(base / 400) AS INTEGER) AS level FROM {adjusted}) WINDOW w AS (PARTITION BY permno ORDER BY m)))"


def _movement(v):
    return audit.movement(v("adjusted"), v("adjusted").groupBy("industry", "m").agg(F.round(F.avg("base"), 3).alias("mean")), "industry", "m", "permno", "base", "mean", 2.0)


MOVEMENT = """WITH mem AS (SELECT *, lag(m) OVER w = m - 1 AS was, lag(m) OVER w = m - 1 AND abs(base - lag(base) OVER w) > 2.0 AS fresh, lead(m) OVER w = m + 1 AS nxt FROM {adjusted} WINDOW w AS (PARTITION BY industry, permno ORDER BY m)),
    cells AS (SELECT industry, m, max(CASE WHEN fresh THEN 1 ELSE 0 END) AS refresh, max(CASE WHEN was THEN 0 ELSE 1 END) AS came, max(CASE WHEN nxt THEN 0 ELSE 1 END) AS went FROM mem GROUP BY 1, 2),
    flags AS (SELECT industry, m, refresh, greatest(came, lw) AS churn FROM (SELECT *, CASE WHEN lag(m) OVER b = m - 1 THEN lag(went) OVER b END AS lw FROM cells WINDOW b AS (PARTITION BY industry ORDER BY m)) WHERE lw IS NOT NULL),
    moves AS (SELECT industry, m, CASE WHEN lag(m) OVER b = m - 1 THEN CASE WHEN abs(mean - lag(mean) OVER b) > 2.0 THEN 1 ELSE 0 END END AS moved FROM (SELECT industry, m, round(avg(base), 3) AS mean FROM {adjusted} GROUP BY 1, 2) WINDOW b AS (PARTITION BY industry ORDER BY m))
    SELECT refresh, churn, count(*) AS pairs, sum(moved) AS moved FROM flags JOIN moves USING (industry, m) WHERE moved IS NOT NULL GROUP BY 1, 2"""


def _funnel(v):
    y = v("fundamentals_year")
    return audit.coverage_funnel({"scan": y, "priced": y.filter("prcc_f > 1"), "linked": y.join(v("link").filter("linkprim = 'P'").select("gvkey").distinct(), "gvkey", "left_semi")}, "che")


def _scores(v):
    y = v("fundamentals_year").select("gvkey", "fyear", (F.col("che") > 1).cast("int").alias("p"), (F.col("xrd") > 0).cast("int").alias("q"))
    z = y.withColumn("p2", F.when(F.col("gvkey") % 10 == 0, 1 - F.col("p")).otherwise(F.col("p"))).withColumn("q2", F.when(F.col("gvkey") % 7 == 0, 0).otherwise(F.col("q")))
    t = z.withColumn("t", F.col("p") + F.col("q")).withColumn("t2", F.col("p2") + F.col("q2"))
    return audit.score_decomposition(t, [("p", "p2"), ("q", "q2")], ("t", "t2"))


SCORES = """SELECT component, count(*) AS n, sum(CASE WHEN x <> y THEN 1 ELSE 0 END) AS differ, sum(CASE WHEN x > y THEN 1 ELSE 0 END) AS over, sum(CASE WHEN x < y THEN 1 ELSE 0 END) AS under, sum(CASE WHEN x = 0 AND y <> 0 THEN 1 ELSE 0 END) AS false_zero FROM
    (SELECT 'p' AS component, p AS x, p2 AS y FROM z UNION ALL SELECT 'q', q, q2 FROM z UNION ALL SELECT 't', p + q, p2 + q2 FROM z) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1"""
SCORES = "WITH z AS (SELECT p, q, CASE WHEN gvkey % 10 = 0 THEN 1 - p ELSE p END AS p2, CASE WHEN gvkey % 7 = 0 THEN 0 ELSE q END AS q2 FROM (SELECT gvkey, CASE WHEN che > 1 THEN 1 WHEN che <= 1 THEN 0 END AS p, CASE WHEN xrd > 0 THEN 1 WHEN xrd <= 0 THEN 0 END AS q FROM {fundamentals_year})) " + SCORES


def _variants(v):
    """Industry means under each code source and universe, unioned."""
    s, n = v("security_month").select("permno", "m", "date", "prc"), v("names")
    old = n.filter("nameendt IS NOT NULL").select("permno", "siccd", "exchcd")
    new = n.filter("nameendt IS NULL").select("permno", "siccd", "exchcd")
    out = None
    for name, codes in (("first", old), ("current", new), ("current_main", new.filter("exchcd = 1"))):
        part = s.join(codes, "permno").groupBy(F.floor(F.col("siccd") / 100).cast("int").alias("industry"), "m").agg(F.avg("prc").alias("mean"), F.count("*").alias("n")).withColumn("variant", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


VARIANTS = " UNION ALL ".join(f"SELECT '{k}' AS variant, CAST(floor(siccd / 100e0) AS INTEGER) AS industry, m, avg(prc) AS mean, count(*) AS n FROM {{security_month}} JOIN (SELECT * FROM {{names}} WHERE {w}) USING (permno) GROUP BY 2, 3" for k, w in (("first", "nameendt IS NOT NULL"), ("current", "nameendt IS NULL"), ("current_main", "nameendt IS NULL AND exchcd = 1")))


def _repriced(v):
    """Book value backed out of a December ratio and put over each month's value."""
    s = v("security_month").select("permno", "m", (F.col("prc") * F.col("shrout")).alias("value"))
    dec = s.filter("m % 12 = 11").select("permno", F.floor(F.col("m") / 12).cast("int").alias("y"), F.col("value").alias("dec_value"))
    known = dec.withColumn("book", F.col("dec_value") * (0.5 + F.col("permno") % 10 / 10))
    return s.withColumn("y", (F.floor(F.col("m") / 12) - 1).cast("int")).join(known, ["permno", "y"]).select("permno", "m", (F.col("book") / F.col("dec_value")).alias("bm_dec"), F.try_divide("book", "value").alias("bm_now"))


def _candidates(v):
    """Candidate formulas under two timings against a target, which one of them is."""
    y = v("fundamentals_year").select("gvkey", "datadate", *(F.try_divide("sale", d).alias(n) for n, d in (("f1", "assets"), ("f2", F.col("assets") + 1), ("f3", "lt"))))
    target = timing.expand_fixed(y.select("gvkey", "datadate", F.col("f1").alias("y")), "gvkey").select("gvkey", "signal_yyyymm", "y")
    june = timing.expand_fixed(y, "gvkey").withColumn("timing", F.lit("june"))
    roll = timing.expand_rolling(y, "gvkey").withColumn("timing", F.lit("rolling"))
    both = june.unionByName(roll).select("gvkey", "signal_yyyymm", "timing", F.explode(F.array(*(F.struct(F.lit(n).alias("formula"), F.col(n).alias("x")) for n in ("f1", "f2", "f3")))).alias("_kv")).select("gvkey", "signal_yyyymm", "timing", "_kv.*")
    return both.join(target, ["gvkey", "signal_yyyymm"]).dropna(subset=["x", "y"]).groupBy("formula", "timing").agg(F.count("*").alias("n"), correlation("x", "y").alias("corr"), F.avg((F.abs(F.col("x") - F.col("y")) < 1e-9).cast("double")).alias("match"))


CANDIDATES = """WITH y AS (SELECT gvkey, fyear, datadate, sale / nullif(assets, 0) AS f1, sale / nullif(assets + 1, 0) AS f2, sale / nullif(lt, 0) AS f3 FROM {fundamentals_year}),
    june AS (SELECT *, 'june' AS timing FROM (SELECT *, unnest(range((fyear + 1) * 12 + 5, (fyear + 1) * 12 + 17)) AS k FROM y) QUALIFY row_number() OVER (PARTITION BY gvkey, k ORDER BY datadate DESC) = 1),
    roll AS (SELECT *, 'rolling' AS timing FROM (SELECT *, unnest(range(fyear * 12 + 18, fyear * 12 + 31)) AS k FROM y) QUALIFY row_number() OVER (PARTITION BY gvkey, k ORDER BY datadate DESC) = 1),
    two AS (SELECT * FROM june UNION ALL SELECT * FROM roll), l AS (SELECT gvkey, k, timing, 'f1' AS formula, f1 AS x FROM two UNION ALL SELECT gvkey, k, timing, 'f2', f2 FROM two UNION ALL SELECT gvkey, k, timing, 'f3', f3 FROM two)
    SELECT formula, l.timing, count(*) AS n, corr(x, j.f1) AS corr, avg(CASE WHEN abs(x - j.f1) < 1e-9 THEN 1e0 ELSE 0 END) AS match FROM l JOIN june j ON l.gvkey = j.gvkey AND l.k = j.k WHERE x IS NOT NULL AND j.f1 IS NOT NULL GROUP BY 1, 2"""


def _buckets(v):
    """Rank agreement by two-year bucket."""
    p = compare.pairs(v("panel_a"), v("panel_b"), {"c": "c2"}, ["permno", "m"], "m").withColumn("bucket", F.floor(F.col("m") / 24) * 2)
    return compare.spearman(p, ["bucket"], 100, large=True)


Z = f"(SELECT char, avg(x) OVER w AS mx, stddev_pop(x) OVER w AS sx, avg(y) OVER w AS my, stddev_pop(y) OVER w AS sy, x, y FROM {PAIRS} WINDOW w AS (PARTITION BY char, m))"

_MATRIX = ["a", "b", "c", "a2", "b2", "c2"]
MATRIX = "WITH r AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {k}) + (count(*) OVER (PARTITION BY {k}) - 1) / 2e0 AS r_{k}" for k in _MATRIX) + " FROM {panel_a} p JOIN (SELECT permno, m, a2, b2, c2 FROM {panel_b}) q ON p.permno = q.permno AND p.m = q.m WHERE " + " AND ".join(f"{k} IS NOT NULL" for k in _MATRIX) + ") " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr(r_{a}, r_{b}) AS corr FROM r" for i, a in enumerate(_MATRIX) for b in _MATRIX[i:])

QUERIES = [
    Query("coverage", lambda v: compare.coverage(v("panel_a"), v("panel_b"), ["permno", "m"]), "shared left_only right_only share~6", "SELECT count(*) FILTER (q.m IS NOT NULL AND p.m IS NOT NULL) AS shared, count(*) FILTER (q.m IS NULL) AS left_only, count(*) FILTER (p.m IS NULL) AS right_only, count(*) FILTER (q.m IS NOT NULL AND p.m IS NOT NULL) / CAST(count(p.m) AS DOUBLE) AS share FROM {panel_a} p FULL JOIN {panel_b} q ON p.permno = q.permno AND p.m = q.m"),
    Query("spearman_pooled", lambda v: compare.spearman(_pairs(v), ["char"], large=True), "char n rho~6", f"SELECT char, count(*) AS n, corr(rx, ry) AS rho FROM {_ranks('char')} GROUP BY 1"),
    Query("spearman_monthly", lambda v: compare.spearman(_pairs(v), ["char", "m"], 10), "char m n rho~6", f"SELECT * FROM {MONTHLY}"),
    Query("spearman_summary", lambda v: compare.monthly_summary(_pairs(v), "m"), "char months median_rho~6 mean_rho~6 p25_rho~6 p75_rho~6 share_low~6", SUMMARY),
    Query("match_rates", lambda v: compare.match_rates(_pairs(v), ["char"]), "char n abs_1e4~6 rel_1e3~6 abs_1e6~6 exact~6", MATCH),
    Query("differences", lambda v: compare.differences(_pairs(v), ["char"]), "char pearson~6 rmse~5 mean_abs~5 median_abs~5 p95_abs~5 p99_abs~5 max_abs~5", f"SELECT char, corr(x, y) AS pearson, sqrt(avg(pow(x - y, 2))) AS rmse, avg(abs(x - y)) AS mean_abs, median(abs(x - y)) AS median_abs, quantile_cont(abs(x - y), 0.95) AS p95_abs, quantile_cont(abs(x - y), 0.99) AS p99_abs, max(abs(x - y)) AS max_abs FROM {PAIRS} GROUP BY 1"),
    Query("winsorized_corr", lambda v: compare.winsorized_corr(_pairs(v), ["char"]), "char winsor_corr~6", f"SELECT char, corr(least(greatest(x, lx), hx), least(greatest(y, ly), hy)) AS winsor_corr FROM {PAIRS} JOIN (SELECT char, quantile_cont(x, 0.01) AS lx, quantile_cont(x, 0.99) AS hx, quantile_cont(y, 0.01) AS ly, quantile_cont(y, 0.99) AS hy FROM {PAIRS} GROUP BY 1) USING (char) GROUP BY 1"),
    Query("winsorized_corr_joint", lambda v: compare.winsorized_corr(_pairs(v), ["char"], 0.05, 0.95, True), "char winsor_corr~6", f"SELECT char, CASE WHEN max(b) > min(b) THEN corr(a, b) END AS winsor_corr FROM (SELECT char, least(greatest(x, lx), hx) AS a, least(greatest(y, lx), hx) AS b FROM {PAIRS} JOIN (SELECT char, quantile_cont(x, 0.05) AS lx, quantile_cont(x, 0.95) AS hx FROM {PAIRS} GROUP BY 1) USING (char)) GROUP BY 1"),
    Query("trimmed_corr", lambda v: compare.trimmed_corr(_pairs(v), ["char"], 0.9), "char trimmed_corr~5", f"SELECT char, corr(x, y) AS trimmed_corr FROM {PAIRS} JOIN (SELECT char, quantile_cont(abs(x - y), 0.9) AS q FROM {PAIRS} GROUP BY 1) USING (char) WHERE abs(x - y) <= q + 1e-9 GROUP BY 1"),
    Query("percent_rank_corr", lambda v: compare.percent_rank_corr(_pairs(v), ["char"]), "char percent_rank_corr~6", f"SELECT char, corr(rx, ry) AS percent_rank_corr FROM {_ranks('char')} GROUP BY 1"),
    Query("bucket_agreement", lambda v: compare.bucket_agreement(_pairs(v), ["char", "m"], ["permno"]), "char m n same~6 bottom~6 top~6", f"SELECT char, m, count(*) AS n, avg(CASE WHEN bx = b2 THEN 1e0 ELSE 0 END) AS same, avg(CASE WHEN bx = 1 THEN CASE WHEN b2 = 1 THEN 1e0 ELSE 0 END END) AS bottom, avg(CASE WHEN bx = 10 THEN CASE WHEN b2 = 10 THEN 1e0 ELSE 0 END END) AS top FROM (SELECT char, m, ntile(10) OVER (PARTITION BY char, m ORDER BY x, permno) AS bx, ntile(10) OVER (PARTITION BY char, m ORDER BY y, permno) AS b2 FROM {PAIRS}) GROUP BY 1, 2 HAVING count(*) >= 20"),
    Query("zscore_agreement", lambda v: compare.zscore_agreement(_pairs(v), ["char"], "m"), "char n z_agree~6", f"SELECT char, count(*) AS n, avg(CASE WHEN abs((x - mx) / sx - (y - my) / sy) <= 0.1 THEN 1e0 ELSE 0 END) AS z_agree FROM {Z} WHERE sx > 0 AND sy > 0 GROUP BY 1"),
    Query("suspicion", _suspicion, "char median_rho~6 abs_1e4~6 score~5 label", f"SELECT char, median_rho, abs_1e4, 60 * (1 - coalesce(median_rho, 0)) + 40 * (1 - coalesce(abs_1e4, 0)) AS score, CASE WHEN n < 20 THEN 'few pairs' WHEN abs_1e4 > 0.95 THEN 'same' WHEN median_rho > 0.99 THEN 'same order' WHEN median_rho > 0.95 THEN 'close' WHEN median_rho < 0 THEN 'sign' ELSE 'differs' END AS label FROM ({SUMMARY}) JOIN ({MATCH}) USING (char)"),
    Query("status_label", lambda v: compare.status_label(compare.spearman(_pairs(v), ["char"], large=True).withColumn("have", F.col("n") > 0), "rho", "have"), "char n status", f"SELECT char, n, CASE WHEN rho >= 0.95 THEN 'validated' WHEN rho >= 0.8 THEN 'partial' ELSE 'mismatch' END AS status FROM (SELECT char, count(*) AS n, corr(rx, ry) AS rho FROM {_ranks('char')} GROUP BY 1)"),
    Query("shift_search", _shift, "shift n corr~6", "SELECT s AS shift, count(*) AS n, corr(p.c, q.c2) AS corr FROM {panel_a} p, unnest([-2, -1, 0, 1, 2]) t(s) JOIN {panel_b} q ON q.permno = p.permno AND q.m = p.m + s WHERE p.c IS NOT NULL AND q.c2 IS NOT NULL GROUP BY 1"),
    Query("best_shift", lambda v: compare.best_alignment(_shift(v).withColumn("all", F.lit(1)), "all", "shift", "corr"), "shift corr~6", "SELECT s AS shift, corr(p.c, q.c2) AS corr FROM {panel_a} p, unnest([-2, -1, 0, 1, 2]) t(s) JOIN {panel_b} q ON q.permno = p.permno AND q.m = p.m + s WHERE p.c IS NOT NULL AND q.c2 IS NOT NULL GROUP BY 1 ORDER BY 2 DESC LIMIT 1"),
    Query("scale_search", lambda v: compare.scale_search(compare.pairs(v("panel_a"), v("panel_b"), {"b": "b2"}, ["permno", "m"], "m"), [-1.0, 0.01, 1.0, 100.0]), "scale n match~6", f"SELECT s AS scale, count(*) AS n, avg(CASE WHEN abs(x * s - y) <= 1e-6 * (1 + abs(y)) THEN 1e0 ELSE 0 END) AS match FROM {PAIRS}, unnest([-1e0, 0.01e0, 1e0, 100e0]) t(s) WHERE char = 'b' GROUP BY 1"),
    Query("agreement_matrix", lambda v: compare.agreement_matrix(v("panel_a").join(v("panel_b").select("permno", "m", "a2", "b2", "c2"), ["permno", "m"]), _MATRIX), "a b corr~6", MATRIX),
    Query("key_multiplicity", lambda v: compare.key_multiplicity(v("link"), [["gvkey"], ["permno"], ["gvkey", "permno"], ["gvkey", "linkprim"], ["linktype"]]), "keys rows unique_keys duplicate_groups max_multiplicity", " UNION ALL ".join(f"SELECT '{'+'.join(k)}' AS keys, sum(c) AS rows, count(*) AS unique_keys, sum(CASE WHEN c > 1 THEN 1 ELSE 0 END) AS duplicate_groups, max(c) AS max_multiplicity FROM (SELECT count(*) AS c FROM {{link}} GROUP BY {', '.join(k)})" for k in (["gvkey"], ["permno"], ["gvkey", "permno"], ["gvkey", "linkprim"], ["linktype"]))),
    Query("difference_histogram", lambda v: compare.histogram(_pairs(v), F.col("y") - F.col("x") + 1e-7, 2, ["char"]), "char bin n", f"SELECT char, round(y - x + 1e-7, 2) AS bin, count(*) AS n FROM {PAIRS} GROUP BY 1, 2"),
    Query("agreement_by_bucket", _buckets, "bucket n rho~6", f"SELECT b AS bucket, count(*) AS n, corr(rx, ry) AS rho FROM (SELECT b, rank() OVER (PARTITION BY b ORDER BY x) + (count(*) OVER (PARTITION BY b, x) - 1) / 2e0 AS rx, rank() OVER (PARTITION BY b ORDER BY y) + (count(*) OVER (PARTITION BY b, y) - 1) / 2e0 AS ry FROM (SELECT *, CAST(floor(m / 24) * 2 AS BIGINT) AS b FROM {PAIRS} WHERE char = 'c')) GROUP BY 1 HAVING count(*) >= 100"),
    Query("cell_dispersion", lambda v: audit.cell_dispersion(v("adjusted"), ["industry", "m"], "base"), "industry m n low~5 high~5 std~5 mean~5", "SELECT industry, m, count(base) AS n, min(base) AS low, max(base) AS high, stddev_samp(base) AS std, avg(base) AS mean FROM {adjusted} GROUP BY 1, 2"),
    Query("constancy", lambda v: audit.constancy(v("adjusted"), ["industry", "m"], "implied", 1e-6), "cells constant_share~6 r2~6", "SELECT count(DISTINCT (industry, m)) AS cells, avg(CASE WHEN first THEN CASE WHEN hi - lo <= 1e-6 THEN 1e0 ELSE 0 END END) AS constant_share, 1 - avg(pow(implied - mean, 2)) / var_pop(implied) AS r2 FROM (SELECT industry, m, implied, count(*) OVER w AS n, max(implied) OVER w AS hi, min(implied) OVER w AS lo, avg(implied) OVER w AS mean, row_number() OVER (PARTITION BY industry, m ORDER BY permno) = 1 AS first FROM {adjusted} WHERE implied IS NOT NULL WINDOW w AS (PARTITION BY industry, m)) WHERE n >= 3"),
    Query("reconstruction", lambda v: audit.reconstruct(v("adjusted"), ["industry", "m"], "base", "adj"), "n match~6 corr~6", "SELECT count(*) AS n, avg(CASE WHEN abs(r - adj) <= 1e-6 THEN 1e0 ELSE 0 END) AS match, corr(r, adj) AS corr FROM (SELECT adj, base - avg(base) OVER (PARTITION BY industry, m) AS r FROM {adjusted})"),
    Query("modal_benchmark", _modes, "industry m mode~4 mode_n n dominance~6", f"SELECT *, CAST(mode_n AS DOUBLE) / n AS dominance FROM {MODES}"),
    Query("off_mode_matches", lambda v: audit.off_mode_matches(v("adjusted"), "industry", "m", "implied", 1), "off matched", "WITH q AS " + MODES.replace("round(implied, 4)", "round(implied, 1)") + " SELECT count(*) AS off, count(o.mode) AS matched FROM (SELECT a.m, round(a.implied, 1) AS v FROM {adjusted} a JOIN q ON q.industry = a.industry AND q.m = a.m WHERE round(a.implied, 1) <> q.mode) x LEFT JOIN (SELECT DISTINCT m, mode FROM q) o ON o.m = x.m AND o.mode = x.v"),
    Query("window_linearity", _linearity, "permno island n slope~5 r2~5", f"SELECT permno, island, count(*) AS n, regr_slope(base, m) AS slope, regr_r2(base, m) AS r2 FROM {ISLANDS} GROUP BY 1, 2 HAVING count(*) >= 3"),
    Query("benchmark_movement", _movement, "refresh churn pairs moved", MOVEMENT),
    Query("robust_means", lambda v: audit.robust_means(v("adjusted"), ["industry", "m"], "base"), "industry m n mean~5 trimmed~5 winsorized~5 median~5", "SELECT industry, m, count(*) AS n, avg(base) AS mean, avg(CASE WHEN base BETWEEN lo AND hi THEN base END) AS trimmed, avg(least(greatest(base, lo), hi)) AS winsorized, median(base) AS median FROM {adjusted} JOIN (SELECT industry, m, quantile_cont(base, 0.05) AS lo, quantile_cont(base, 0.95) AS hi FROM {adjusted} GROUP BY 1, 2) USING (industry, m) GROUP BY 1, 2"),
    Query("sum_identity", lambda v: audit.sum_identity(v("adjusted"), ["industry", "m"], "base", "adj"), "industry m n residual~5 benchmark~5 members~4 bucket", "SELECT industry, m, count(*) AS n, sum(adj) AS residual, avg(base - adj) AS benchmark, sum(base) / nullif(avg(base - adj), 0) AS members, CASE WHEN abs(sum(adj)) < 1e-6 THEN 'zero' WHEN abs(sum(adj)) < 0.1 THEN 'small' ELSE 'large' END AS bucket FROM {adjusted} GROUP BY 1, 2"),
    Query("null_asymmetry", lambda v: audit.null_asymmetry(v("panel_a").join(v("panel_b").select("permno", "m", "a2"), ["permno", "m"]), "a", "a2"), "shared left_only right_only neither", "SELECT sum(CASE WHEN a IS NOT NULL AND a2 IS NOT NULL THEN 1 ELSE 0 END) AS shared, sum(CASE WHEN a IS NOT NULL AND a2 IS NULL THEN 1 ELSE 0 END) AS left_only, sum(CASE WHEN a IS NULL AND a2 IS NOT NULL THEN 1 ELSE 0 END) AS right_only, sum(CASE WHEN a IS NULL AND a2 IS NULL THEN 1 ELSE 0 END) AS neither FROM {panel_a} p JOIN {panel_b} q ON p.permno = q.permno AND p.m = q.m"),
    Query("coverage_funnel", _funnel, "stage step rows present", "SELECT 'scan' AS stage, 0 AS step, count(*) AS rows, count(che) AS present FROM {fundamentals_year} UNION ALL SELECT 'priced', 1, count(*), count(che) FROM {fundamentals_year} WHERE prcc_f > 1 UNION ALL SELECT 'linked', 2, count(*), count(che) FROM {fundamentals_year} WHERE gvkey IN (SELECT gvkey FROM {link} WHERE linkprim = 'P')"),
    Query("code_mismatch", lambda v: audit.code_mismatch(v("names").filter("nameendt IS NOT NULL").withColumn("siccd", F.when(F.col("permno") % 9 > 0, F.col("siccd"))), v("names").filter("nameendt IS NULL"), ["permno"], "siccd"), "kind n", "SELECT CASE WHEN p.x IS NULL AND q.y IS NULL THEN 'no code' WHEN p.x IS NULL THEN 'right only' WHEN q.y IS NULL THEN 'left only' WHEN p.x = q.y THEN 'same' WHEN floor(p.x / 100e0) = floor(q.y / 100e0) THEN 'same two digits' ELSE 'different' END AS kind, count(*) AS n FROM (SELECT permno, CASE WHEN permno % 9 > 0 THEN siccd END AS x FROM {names} WHERE nameendt IS NOT NULL) p FULL JOIN (SELECT permno, siccd AS y FROM {names} WHERE nameendt IS NULL) q ON p.permno = q.permno GROUP BY 1"),
    Query("duplicate_columns", lambda v: audit.duplicate_columns(v("panel_a").join(v("panel_b").select("permno", "m", "c2"), ["permno", "m"]), "c", "c2"), "n close~6 corr~6", "SELECT count(*) AS n, avg(CASE WHEN abs(c - c2) <= 1e-8 + 1e-5 * abs(c2) THEN 1e0 ELSE 0 END) AS close, corr(c, c2) AS corr FROM {panel_a} p JOIN {panel_b} q ON p.permno = q.permno AND p.m = q.m WHERE c IS NOT NULL AND c2 IS NOT NULL"),
    Query("late_starts", lambda v: audit.late_starts(v("fundamentals_year").withColumn("late", F.when(F.col("fyear") > 1998, F.col("che"))), ["che", "sale", "late"], "datadate", "1996-12-31"), "char first", "SELECT * FROM (SELECT 'che' AS char, min(datadate) AS first FROM {fundamentals_year} WHERE che IS NOT NULL UNION ALL SELECT 'sale', min(datadate) FROM {fundamentals_year} WHERE sale IS NOT NULL UNION ALL SELECT 'late', min(datadate) FROM {fundamentals_year} WHERE fyear > 1998 AND che IS NOT NULL) WHERE first > DATE '1996-12-31'"),
    Query("negative_audit", lambda v: audit.negative_audit(v("fundamentals_year"), "gvkey", "capx"), "entities any_negative all_negative rows_negative", "SELECT count(*) AS entities, sum(CASE WHEN a THEN 1 ELSE 0 END) AS any_negative, sum(CASE WHEN e THEN 1 ELSE 0 END) AS all_negative, sum(r) AS rows_negative FROM (SELECT gvkey, bool_or(capx < 0) AS a, bool_and(capx < 0) AS e, sum(CASE WHEN capx < 0 THEN 1 ELSE 0 END) AS r FROM {fundamentals_year} WHERE capx IS NOT NULL GROUP BY 1)"),
    Query("inventory", lambda v: audit.inventory(v("panel_a"), "permno", "m"), "rows entities periods first last", "SELECT count(*) AS rows, count(DISTINCT permno) AS entities, count(DISTINCT m) AS periods, min(m) AS first, max(m) AS last FROM {panel_a}"),
    Query("score_decomposition", _scores, "component n differ over under false_zero", SCORES),
    Query("industry_staircase", lambda v: audit.staircase(v("adjusted").groupBy("industry", "m").agg(F.round(F.avg("base"), 3).alias("mean")), "m", "industry", "mean"), "industry m mean~3 place", "SELECT industry, m, mean, row_number() OVER (PARTITION BY m ORDER BY mean, industry) AS place FROM (SELECT industry, m, round(avg(base), 3) AS mean FROM {adjusted} GROUP BY 1, 2)"),
    Query("recovered_means", lambda v: v("adjusted").groupBy("m").agg(F.countDistinct(rounded("implied", 2)).alias("means"), F.countDistinct("industry").alias("industries")), "m means industries", "SELECT m, count(DISTINCT round(implied, 2)) AS means, count(DISTINCT industry) AS industries FROM {adjusted} GROUP BY 1"),
    Query("value_clusters", lambda v: windows.gap_clusters(v("panel_a"), ["m"], "c", 1.0, 2), "m cluster size low~4 high~4", "SELECT m, cluster, count(*) AS size, min(c) AS low, max(c) AS high FROM (SELECT m, c, sum(cut) OVER (PARTITION BY m ORDER BY c ROWS UNBOUNDED PRECEDING) AS cluster FROM (SELECT m, c, CASE WHEN c - lag(c) OVER (PARTITION BY m ORDER BY c) > 1.0 THEN 1 ELSE 0 END AS cut FROM {panel_a} WHERE c IS NOT NULL)) GROUP BY 1, 2 HAVING count(*) >= 2"),
    Query("industry_variants", _variants, "variant industry m n mean~4", VARIANTS),
    Query("repriced_book", _repriced, "permno m bm_dec~6 bm_now~6", "SELECT s.permno, s.m, d.f AS bm_dec, d.value * d.f / nullif(s.prc * s.shrout, 0) AS bm_now FROM {security_month} s JOIN (SELECT permno, CAST(floor(m / 12) AS INTEGER) AS y, prc * shrout AS value, 0.5e0 + permno % 10 / 10e0 AS f FROM {security_month} WHERE m % 12 = 11) d ON d.permno = s.permno AND d.y = floor(s.m / 12) - 1"),
    Query("candidate_formulas", _candidates, "formula timing n corr~6 match~6", CANDIDATES),
    Query("code_crosstab", lambda v: v("panel_a").groupBy("industry", "m").agg(F.count(F.lit(1)).alias("n")), "industry m n", "SELECT industry, m, count(*) AS n FROM {panel_a} GROUP BY 1, 2"),
    Query("largest_differences", lambda v: _pairs(v).withColumn("d", F.abs(F.col("x") - F.col("y"))).orderBy(F.desc("d"), "char", "permno", "m").limit(20), "char permno m d~4", f"SELECT char, permno, m, abs(x - y) AS d FROM {PAIRS} ORDER BY d DESC, char, permno, m LIMIT 20"),
    Query("universe_by_year", lambda v: x.group_stat(v("adjusted").withColumn("year", F.floor(F.col("m") / 12).cast("int")), ["year"], "base", "count", "n").groupBy("year", "n").agg(F.countDistinct("permno").alias("entities"), F.countDistinct("industry").alias("industries")), "year n entities industries", "SELECT CAST(floor(m / 12) AS INTEGER) AS year, count(base) AS n, count(DISTINCT permno) AS entities, count(DISTINCT industry) AS industries FROM {adjusted} GROUP BY 1"),
    Query("outcome_bounds", lambda v: _excess(v).agg(F.min("retadj").alias("low"), F.max("retadj").alias("high"), F.count("retadj").alias("n")), "low~6 high~6 n", f"SELECT min(retadj) AS low, max(retadj) AS high, count(retadj) AS n FROM ({EXCESS_SQL})"),
]
