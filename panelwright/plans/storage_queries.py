"""Queries of what is written and read again, of readers of other systems' files, and of whole panels' agreement."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import calendar as c
from ..operators import compare, panel
from ..sources import readers
from ..storage import scratch
from .compare_queries import COLUMNS
from .shapes import Query


def _round_trip(v):
    """A panel's months, of which some are written once more with other values, and read back from a month on."""
    a = v("panel_a").select("permno", "target_yyyymm", "a", "b", "c")
    path = scratch(a.sparkSession, "panel")
    panel.write_panel(a, path)
    panel.write_panel(a.filter("target_yyyymm % 100 = 3 and permno % 2 = 0").withColumn("b", -F.col("b")), path)
    return panel.read_panel(a.sparkSession, path, (199702, 199904))


ROUND_TRIP = "SELECT permno, target_yyyymm, a, CASE WHEN target_yyyymm % 100 = 3 THEN -b ELSE b END AS b, c FROM {panel_a} WHERE target_yyyymm BETWEEN 199702 AND 199904 AND (target_yyyymm % 100 <> 3 OR permno % 2 = 0)"

_ODD = "CASE permno % 7 WHEN 0 THEN NULL WHEN 1 THEN {inf} WHEN 2 THEN {nan} ELSE b END"


def _feature_file(v):
    """A feature with missing, infinite and undefined values."""
    a = v("panel_a").select("permno", "signal_yyyymm", F.expr(_ODD.format(inf="double('-infinity')", nan="double('nan')")).alias("b"))
    path = scratch(a.sparkSession, "feature")
    panel.write_feature(a, "b", path)
    return a.sparkSession.read.parquet(path)


def _bucketed(v):
    """Two tables in buckets of entities, summed by entity."""
    a = v("panel_a")
    spark = a.sparkSession
    for name, cols in (("panel_buckets_a", ["a", "b"]), ("panel_buckets_c", ["c"])):
        path = scratch(spark, name)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        a.select("permno", "signal_yyyymm", *cols).repartition(8, "permno").write.mode("overwrite").option("path", path).bucketBy(8, "permno").sortBy("permno", "signal_yyyymm").saveAsTable(name)
    return spark.table("panel_buckets_a").join(spark.table("panel_buckets_c"), ["permno", "signal_yyyymm"]).groupBy("permno").agg(F.count("*").alias("n"), F.sum("b").alias("b"), F.sum("c").alias("c"))


def _macro_csv(v):
    """A monthly series as text with thousands separators, some of it no number."""
    m = v("macro")
    path = scratch(m.sparkSession, "macro")
    text = lambda k: F.format_number(F.col(k), 12)
    m.select("yyyymm", text("index").alias("Index"), F.when(F.col("yyyymm") % 5 > 0, text("d12")).otherwise("n/a").alias("D12"), text("bm").alias("b/m")).write.option("header", True).option("quoteAll", True).csv(path)
    return readers.read_macro_csv(m.sparkSession, path)


def _reference_csv(v):
    """A published panel: a date YYYYMMDD and features, of which some are absent."""
    a = v("panel_a")
    path = scratch(a.sparkSession, "reference")
    a.select("permno", (F.col("signal_yyyymm") * 100 + 28).cast("int").alias("DATE"), "a", "c").write.option("header", True).csv(path)
    if readers.header(a.sparkSession, path) != ["permno", "DATE", "a", "c"]:
        raise ValueError("the file's header is not that of the panel")
    return readers.read_reference_panel(a.sparkSession, path, ["a", "c"])


def _numbered_dates(v):
    d = v("security_day").select("permno", "date", F.datediff("date", F.lit("1960-01-01").cast("date")).cast("double").alias("number"))
    back = c.sas_date("number")
    return d.select("permno", "number", back.alias("date"), c.month_key(back).alias("month"), (c.month_key(back) * 100 + F.dayofmonth(back)).alias("day"))


def _guarded(v):
    a = v("panel_a").select("permno", F.lit(-1.0).alias("flat"), F.when(F.col("permno") < 0, 1.0).alias("empty"), (F.col("b") * 0 - 1 + F.col("permno") % 2 * 1e-9).alias("nearly"), "a", "b")
    return panel.degenerate_columns(a, ["flat", "empty", "nearly", "a", "b"])


def _trimmed(v):
    a = panel.rename_aliases(v("panel_a").withColumnsRenamed({"a": "bm", "b": "mvel1"}))
    plan = panel.column_plan(a, ["book_to_market", "mvel1", "absent"], ["permno", "m"])
    if plan["missing"] != ["absent"] or "c" not in plan["dropped"]:
        raise ValueError(f"not the plan of these columns: {plan}")
    return panel.trim(a, ["book_to_market", "mvel1", "absent"], ["permno", "m"])


def _with_target(v):
    """Panels of which one column is known a month later than another one says."""
    b = v("panel_b").select("permno", "m", F.col("signal_yyyymm").alias("month"), *COLUMNS.values())
    late = F.lag("b2").over(Window.partitionBy("permno").orderBy("m"))
    return v("panel_a").withColumn("late", F.col("b")), b.withColumn("late2", late).drop("m")


def _compare(v, **more):
    a, b = _with_target(v)
    return compare.compare_panels(a, b, COLUMNS | {"late": "late2"}, min_pairs=10, **more)


def _compare_sql(every: bool) -> str:
    chars = list((COLUMNS | {"late": "late2"}).items())
    rank = lambda k, by: f"rank() OVER (PARTITION BY {by} ORDER BY {k}) + (count(*) OVER (PARTITION BY {by}, {k}) - 1) / 2e0"
    best = "" if every else " QUALIFY row_number() OVER (PARTITION BY char ORDER BY median_rho DESC NULLS LAST, ord) = 1"
    return f"""WITH q AS (SELECT permno, signal_yyyymm AS month, a2, b2, c2, lag(b2) OVER (PARTITION BY permno ORDER BY m) AS late2 FROM {{panel_b}}),
    al(alignment, ord) AS (VALUES ('signal_yyyymm', 0), ('target_yyyymm', 1)),
    x AS (SELECT * FROM ({' UNION ALL '.join(f"SELECT '{c}' AS char, alignment, ord, permno, CASE WHEN ord = 0 THEN signal_yyyymm ELSE target_yyyymm END AS month, CAST({'b' if c == 'late' else c} AS DOUBLE) AS x FROM {{panel_a}}, al WHERE {'b' if c == 'late' else c} IS NOT NULL" for c, _ in chars)}) WHERE month BETWEEN (SELECT min(month) FROM q) AND (SELECT max(month) FROM q)),
    y AS ({' UNION ALL '.join(f"SELECT '{c}' AS char, alignment, ord, permno, month, CAST({d} AS DOUBLE) AS y FROM q, al WHERE {d} IS NOT NULL" for c, d in chars)}),
    j AS (SELECT char, alignment, ord, permno, month, x, y FROM x FULL JOIN y USING (char, alignment, ord, permno, month)),
    s AS (SELECT char, alignment, ord, count(x) AS keys_a, count(y) AS keys_b, count(x + y) AS n, count(y) - count(x + y) AS only_b, count(x) - count(x + y) AS only_a, count(DISTINCT CASE WHEN x IS NOT NULL THEN permno END) AS entities_a, count(DISTINCT CASE WHEN y IS NOT NULL THEN permno END) AS entities_b, count(DISTINCT CASE WHEN x + y IS NOT NULL THEN permno END) AS entities_both,
        avg(CASE WHEN abs(x - y) <= 1e-4 THEN 1e0 WHEN x + y IS NOT NULL THEN 0 END) AS abs_1e4, avg(CASE WHEN abs(x - y) <= 1e-3 * (1 + abs(y)) THEN 1e0 WHEN x + y IS NOT NULL THEN 0 END) AS rel_1e3, sqrt(avg((x - y) * (x - y))) AS rmse, corr(x, y) AS pearson FROM j GROUP BY 1, 2, 3),
    r AS (SELECT *, {rank('x', 'char, ord')} AS px, {rank('y', 'char, ord')} AS py, {rank('x', 'char, ord, month')} AS mx, {rank('y', 'char, ord, month')} AS my FROM j WHERE x + y IS NOT NULL),
    p AS (SELECT char, ord, corr(px, py) AS pooled_rho FROM r GROUP BY 1, 2),
    mo AS (SELECT char, ord, count(*) AS months, median(rho) AS median_rho, avg(rho) AS mean_rho, avg(CASE WHEN rho < 0.5 THEN 1e0 ELSE 0 END) AS share_low FROM (SELECT char, ord, month, corr(mx, my) AS rho FROM r GROUP BY 1, 2, 3 HAVING count(*) >= 10) WHERE rho IS NOT NULL AND NOT isnan(rho) GROUP BY 1, 2)
    SELECT s.*, pooled_rho, coalesce(months, 0) AS months, median_rho, mean_rho, share_low FROM s LEFT JOIN p USING (char, ord) LEFT JOIN mo USING (char, ord){best}"""


_AGREE = "char alignment keys_a keys_b n only_a only_b entities_a entities_b entities_both months pooled_rho~6 median_rho~6 mean_rho~6 share_low~6 abs_1e4~6 rel_1e3~6 pearson~6 rmse~5"


def _infinite(v):
    """Rank agreement of columns with infinite values, which are the largest or smallest ones."""
    odd = F.when(F.col("permno") % 13 == 0, float("inf")).when(F.col("permno") % 13 == 1, float("-inf")).otherwise(F.col("b"))
    p = v("panel_a").select("permno", "m", odd.alias("x"), F.col("c").alias("y")).dropna()
    return compare.spearman(p, [], 2, large=True).select("n", "rho")


INFINITE = """SELECT count(*) AS n, corr(rx, ry) AS rho FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2e0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2e0 AS ry FROM
    (SELECT CASE permno % 13 WHEN 0 THEN CAST('inf' AS DOUBLE) WHEN 1 THEN CAST('-inf' AS DOUBLE) ELSE b END AS x, c AS y FROM {panel_a}) WHERE x IS NOT NULL AND y IS NOT NULL)"""


def _places(v):
    """Columns in order of agreement, one of them without any."""
    told = _compare(v, every=True).filter("alignment = 'signal_yyyymm'").select("char", F.when(F.col("char") != "c", F.round("median_rho", 6)).alias("rho"))
    return compare.ranked_last_nulls(told, "rho")


PLACES = f"SELECT char, rho, row_number() OVER (ORDER BY rho DESC NULLS LAST, char) AS place FROM (SELECT char, CASE WHEN char <> 'c' THEN round(median_rho, 6) END AS rho FROM ({_compare_sql(True)}) WHERE alignment = 'signal_yyyymm')"

QUERIES = [
    Query("compare_panels", _compare, _AGREE, _compare_sql(False)),
    Query("compare_panels_alignments", lambda v: _compare(v, every=True), _AGREE, _compare_sql(True)),
    Query("columns_by_agreement", _places, "char rho~5 place", PLACES),
    Query("spearman_infinite", _infinite, "n rho~6", INFINITE),
    Query("panel_round_trip", _round_trip, "permno target_yyyymm a~6 b~6 c~6", ROUND_TRIP),
    Query("feature_file", _feature_file, "permno signal_yyyymm b~6", "SELECT permno, signal_yyyymm, b FROM {panel_a} WHERE permno % 7 > 2 AND b IS NOT NULL"),
    Query("bucketed_tables", _bucketed, "permno n b~5 c~5", "SELECT permno, count(*) AS n, sum(b) AS b, sum(c) AS c FROM {panel_a} GROUP BY permno"),
    Query("macro_csv", _macro_csv, "yyyymm index~3 d12~3 bm~3", "SELECT yyyymm, index, CASE WHEN yyyymm % 5 > 0 THEN d12 END AS d12, bm FROM {macro}"),
    Query("reference_panel_csv", _reference_csv, "permno signal_yyyymm a~6 c~6", "SELECT permno, signal_yyyymm, a, c FROM {panel_a}"),
    Query("numbered_dates", _numbered_dates, "permno number date month day", "SELECT permno, CAST(date - DATE '1960-01-01' AS DOUBLE) AS number, date, year(date) * 100 + month(date) AS month, year(date) * 10000 + month(date) * 100 + day(date) AS day FROM {security_day}"),
    Query("degenerate_columns", _guarded, "char n degenerate", "SELECT char, count(x) AS n, coalesce(max(abs(x + 1)) <= 1e-8, false) AS degenerate FROM (SELECT 'flat' AS char, -1e0 AS x FROM {panel_a} UNION ALL SELECT 'empty', NULL FROM {panel_a} UNION ALL SELECT 'nearly', b * 0 - 1 + permno % 2 * 1e-9 FROM {panel_a} UNION ALL SELECT 'a', a FROM {panel_a} UNION ALL SELECT 'b', b FROM {panel_a}) GROUP BY char"),
    Query("trimmed_panel", _trimmed, "permno m book_to_market~6 mvel1~6", "SELECT permno, m, a AS book_to_market, b AS mvel1 FROM {panel_a}"),
    Query("company_codes_joined", lambda v: readers.with_company(v("fundamentals_year").select("gvkey", "datadate", "sic"), v("company")), "gvkey datadate sic", "SELECT gvkey, datadate, c.sic FROM {fundamentals_year} y LEFT JOIN {company} c USING (gvkey)"),
]
