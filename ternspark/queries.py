"""Registered queries: each applies one operator to whole tables; SQL states what it must return."""

from __future__ import annotations

import tempfile
import uuid
import warnings
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cols, moments
from .functions.quantiles import exact_quantiles
from .functions.tails import chi_square_quantile
from .operators import charts, combine, filters, iforest, mahalanobis, outliers, quality, sampling, stats, ternary
from .operators.filters import Element
from .plans import jobs
from .sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: Columns that stand for a composition; half of the rows of a nullable one are missing.
BASE = """t AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus, l_quantity, l_extendedprice, l_discount, l_tax,
    l_extendedprice * l_discount AS disc_amt, l_extendedprice * l_tax AS tax_amt, l_quantity * 50 AS qty_c, l_extendedprice * 0.01 AS base,
    nullif(l_discount, 0) AS disc_null, CASE WHEN l_tax <= 0.07 THEN l_tax END AS tax_null
  FROM lineitem)"""
AMOUNTS = ["disc_amt", "tax_amt"]
AXES = (Element(["disc_amt"]), Element(["tax_amt"]), Element(["qty_c", "base"]))


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def comp(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as a composition (see `BASE`)."""
    t = table(spark, d, "lineitem")
    return t.selectExpr(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_extendedprice * l_discount as disc_amt", "l_extendedprice * l_tax as tax_amt", "l_quantity * 50 as qty_c", "l_extendedprice * 0.01D as base",
        "nullif(l_discount, 0) as disc_null", "case when l_tax <= 0.07D then l_tax end as tax_null")


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql if sql.lstrip().upper().startswith("WITH RECURSIVE") or "{base}" not in sql else sql.replace("{base}", "WITH " + BASE)
        return f

    return add


def rounded(df: DataFrame, digits: int = 6, **by_column: int) -> DataFrame:
    """Doubles to so many digits, as both engines sum in different orders."""
    return df.select(*[F.round(cols.c(n), by_column.get(n, digits)).alias(n) if t == "double" else cols.c(n) for n, t in df.dtypes])


def count_by(df: DataFrame, *names: str) -> DataFrame:
    return df.groupBy(*names).agg(F.count("*").alias("n"))


# ---- sources -------------------------------------------------------------------------------------------------

@register("s01_read_by_type", "SELECT r_regionkey, r_name FROM region")
def _(spark, d):
    return files.read_table(spark, f"{d}/region.parquet").select("r_regionkey", "r_name")


@register("s02_read_many", "SELECT 'supplier' AS file_source, s_nationkey AS nation, count(*) AS n FROM supplier GROUP BY 2 UNION ALL SELECT 'nation', n_nationkey, count(*) FROM nation GROUP BY 2")
def _(spark, d):
    tables = [("supplier", table(spark, d, "supplier").withColumnRenamed("s_nationkey", "nation")), ("nation", table(spark, d, "nation").withColumnRenamed("n_nationkey", "nation")), ("region", table(spark, d, "region"))]
    return count_by(files.union_labelled(tables, ["nation"]), "file_source", "nation")


@register("s03_union_common", "SELECT source_file, count(*) AS n, round(sum(acctbal), 2) AS total FROM (SELECT 'customer' AS source_file, c_acctbal AS acctbal FROM customer UNION ALL SELECT 'supplier', s_acctbal FROM supplier) GROUP BY 1")
def _(spark, d):
    a = table(spark, d, "customer").withColumnRenamed("c_acctbal", "acctbal")
    b = table(spark, d, "supplier").withColumnRenamed("s_acctbal", "acctbal")
    return rounded(files.union_common([("customer", a), ("supplier", b)]).groupBy("source_file").agg(F.count("*").alias("n"), F.sum("acctbal").alias("total")), 2)


@register("s04_bind_datasets", "SELECT CASE l_linestatus WHEN 'F' THEN 'Dataset 1' ELSE 'Dataset 2' END AS dataset, count(*) AS n, round(avg(l_tax), 6) AS mean FROM lineitem GROUP BY 1")
def _(spark, d):
    first, second = halves(spark, d)
    return rounded(files.bind_datasets(first, second, ["l_tax"]).groupBy("dataset").agg(F.count("*").alias("n"), F.avg("l_tax").alias("mean")))


def halves(spark, d):
    """lineitem as two datasets: status F and O."""
    t = comp(spark, d)
    return t.where("l_linestatus = 'F'"), t.where("l_linestatus = 'O'")


@register("s07_filtered_export", "{base}, b AS (SELECT quantile_cont(disc_amt, 0.75) + 1.5 * (quantile_cont(disc_amt, 0.75) - quantile_cont(disc_amt, 0.25)) AS h1, quantile_cont(tax_amt, 0.75) + 1.5 * (quantile_cont(tax_amt, 0.75) - quantile_cont(tax_amt, 0.25)) AS h2 FROM t WHERE l_quantity > 5) SELECT l_orderkey, l_linenumber, round(disc_amt, 6) AS disc_amt, round(tax_amt, 6) AS tax_amt FROM t, b WHERE l_quantity > 5 AND disc_amt <= h1 AND tax_amt <= h2")
def _(spark, d):
    s = jobs.Settings(Element(["disc_amt"]), Element(["tax_amt"]), Element(["l_quantity"], "> 5"), methods=["iqr"], method_columns=AMOUNTS)
    return rounded(jobs.filtered(comp(spark, d), s).select("l_orderkey", "l_linenumber", *AMOUNTS))


@register("s08_preview", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 10")
def _(spark, d):
    return files.preview(table(spark, d, "orders"), "o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus"])


# ---- names and columns ---------------------------------------------------------------------------------------

@register("n04_to_numeric", "SELECT o_orderkey, try_cast(split_part(o_orderpriority, '-', 1) AS DOUBLE) AS rank, try_cast(o_orderstatus AS DOUBLE) AS status FROM orders")
def _(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).alias("rank"), F.col("o_orderstatus").alias("status"))
    return cols.as_numeric(t, ["rank", "status"])


@register("n05_project_axes", "{base} SELECT count(*) AS n, round(sum(disc_amt), 2) AS a, round(sum(tax_amt), 2) AS b FROM t")
def _(spark, d):
    t = comp(spark, d)
    cols.require(t, AMOUNTS)
    return rounded(t.select(*AMOUNTS).agg(F.count("*").alias("n"), F.sum("disc_amt").alias("a"), F.sum("tax_amt").alias("b")), 2)


@register("n06_log10", "SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN log10(c_acctbal) END, 6) AS y FROM customer")
def _(spark, d):
    return rounded(table(spark, d, "customer").select("c_custkey", cols.log10_positive("c_acctbal").alias("y")))


@register("n07_min_max", "SELECT event_id, round((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()), 6) AS value_norm FROM events")
def _(spark, d):
    return rounded(cols.min_max(table(spark, d, "events").select("event_id", "value"), ["value"]).select("event_id", "value_norm"))


@register("n08_label_range", """WITH e AS (SELECT unnest([min(value), max(value), avg(value)]) AS value, unnest(['low', 'high', 'mean']) AS label FROM events)
SELECT label, round(value, 6) AS value, CASE WHEN value = 0 THEN 0 ELSE round(round(value / pow(10, floor(log10(abs(value))) - 2)) * pow(10, floor(log10(abs(value))) - 2), 9) END AS shown FROM e""")
def _(spark, d):
    r = table(spark, d, "events").agg(F.min(cols.num("value")).alias("low"), F.max(cols.num("value")).alias("high"), F.avg(cols.num("value")).alias("mean")).first()
    return rounded(spark.createDataFrame([(k, r[k], cols.signif(r[k])) for k in ("low", "high", "mean")], "label string, value double, shown double"), shown=9)


# ---- filters -------------------------------------------------------------------------------------------------

for _op, _sql in ((">", ">"), ("<", "<"), (">=", ">="), ("<=", "<="), ("==", "="), ("!=", "<>")):
    _slug = {">": "gt", "<": "lt", ">=": "ge", "<=": "le", "==": "eq", "!=": "ne"}[_op]

    @register(f"f01_filter_{_slug}", f"SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity {_sql} 25 GROUP BY 1")
    def _(spark, d, op=_op):
        return count_by(filters.apply_filter(table(spark, d, "lineitem"), "l_quantity", f"{op} 25"), "l_returnflag")


@register("f02_filters_per_column", "{base} SELECT l_returnflag, count(*) AS n FROM t WHERE qty_c > 500 AND base <= 300 GROUP BY 1")
def _(spark, d):
    e = Element(["qty_c", "base"], filters={"qty_c": "> 500", "base": "<= 300%", "l_tax": "> 5"})
    return count_by(filters.filter_elements(comp(spark, d), [e]), "l_returnflag")


@register("f03_filter_all_columns", "{base} SELECT l_returnflag, count(*) AS n FROM t WHERE disc_amt > 1000 AND tax_amt > 1000 GROUP BY 1")
def _(spark, d):
    return count_by(filters.filter_elements(comp(spark, d), [Element(AMOUNTS, "> 1000")]), "l_returnflag")


@register("f04_optional_filter", "{base} SELECT l_linestatus, count(*) AS n FROM t WHERE l_tax >= 0.03 GROUP BY 1")
def _(spark, d):
    t = filters.filter_optional(comp(spark, d), ["l_tax"], ">= 0.03")
    return count_by(filters.filter_optional(t, ["l_quantity"], "not a filter"), "l_linestatus")


@register("f05_keep_groups", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN (SELECT event_type FROM events GROUP BY 1 ORDER BY 1 LIMIT 2) GROUP BY 1")
def _(spark, d):
    t = table(spark, d, "events")
    two = [r.event_type for r in t.groupBy("event_type").count().orderBy("event_type").limit(2).collect()]
    return count_by(filters.keep_groups(t, "event_type", [f"{x} (12 samples)" for x in two]), "event_type")


@register("f06_positive_sums", "{base} SELECT l_returnflag, count(*) AS n FROM t WHERE disc_amt > 0 AND tax_amt > 0 AND disc_null IS NOT NULL AND disc_null > 0 GROUP BY 1")
def _(spark, d):
    return count_by(filters.drop_empty_sums(comp(spark, d), [Element(["disc_amt"]), Element(["tax_amt"]), Element(["disc_null"])]), "l_returnflag")


@register("f07_valid_coordinates", "{base} SELECT l_returnflag, count(*) AS n FROM t WHERE disc_amt + tax_amt > 0 GROUP BY 1")
def _(spark, d):
    return count_by(ternary.coordinates(comp(spark, d), ["disc_amt"], ["tax_amt"], ["disc_amt"]), "l_returnflag")


_IQR = "b AS (SELECT quantile_cont(disc_amt, 0.25) AS a1, quantile_cont(disc_amt, 0.75) AS a3, quantile_cont(tax_amt, 0.25) AS b1, quantile_cont(tax_amt, 0.75) AS b3 FROM t)"
_Z = "b AS (SELECT avg(disc_amt) AS am, stddev_samp(disc_amt) AS asd, avg(tax_amt) AS bm, stddev_samp(tax_amt) AS bsd FROM t)"
_MAD = "m AS (SELECT median(disc_amt) AS am, median(tax_amt) AS bm FROM t), b AS (SELECT am, bm, 3 * 1.4826 * median(abs(disc_amt - am)) AS ad, 3 * 1.4826 * median(abs(tax_amt - bm)) AS bd FROM t, m GROUP BY am, bm)"
_HIGH = {
    "iqr": (_IQR, "disc_amt > a3 + 1.5 * (a3 - a1) OR tax_amt > b3 + 1.5 * (b3 - b1)"),
    "zscore": (_Z, "disc_amt > am + 3 * asd OR tax_amt > bm + 3 * bsd"),
    "mad": (_MAD, "disc_amt > am + ad OR tax_amt > bm + bd"),
}
_BOTH = {
    "iqr": (_IQR, "disc_amt > a3 + 1.5 * (a3 - a1) OR tax_amt > b3 + 1.5 * (b3 - b1) OR disc_amt < a1 - 1.5 * (a3 - a1) OR tax_amt < b1 - 1.5 * (b3 - b1)"),
    "zscore": (_Z, "abs(disc_amt - am) > 3 * asd OR abs(tax_amt - bm) > 3 * bsd"),
    "mad": (_MAD, "abs(disc_amt - am) > ad OR abs(tax_amt - bm) > bd"),
}
for _method, _id in (("iqr", "f08"), ("zscore", "f09"), ("mad", "f10")):
    _with, _cond = _HIGH[_method]

    @register(f"{_id}_{_method}_flags", f"{{base}}, {_with} SELECT l_returnflag, ({_cond}) AS is_outlier, count(*) AS n FROM t, b GROUP BY 1, 2")
    def _(spark, d, method=_method):
        return count_by(outliers.outlier_flag(comp(spark, d), AMOUNTS, method), "l_returnflag", "is_outlier")

    @register(f"f11_{_method}_keep", f"{{base}}, {_with} SELECT l_orderkey, l_linenumber, round(disc_amt, 6) AS disc_amt FROM t, b WHERE {_cond}")
    def _(spark, d, method=_method):
        return rounded(outliers.outlier_filter(comp(spark, d), AMOUNTS, method, keep_outliers=True).select("l_orderkey", "l_linenumber", "disc_amt"))

    @register(f"f11_{_method}_drop", f"{{base}}, {_with} SELECT l_returnflag, count(*) AS n, round(avg(disc_amt), 4) AS mean FROM t, b WHERE NOT ({_cond}) GROUP BY 1")
    def _(spark, d, method=_method):
        return rounded(outliers.outlier_filter(comp(spark, d), AMOUNTS, method).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg("disc_amt").alias("mean")), 4)

    @register(f"f12_{_method}_two_sided", f"{{base}}, {_BOTH[_method][0]} SELECT l_returnflag, count(*) AS n FROM t, b WHERE {_BOTH[_method][1]} GROUP BY 1")
    def _(spark, d, method=_method):
        return count_by(outliers.outlier_filter(comp(spark, d), AMOUNTS, method, keep_outliers=True, side="both"), "l_returnflag")


@register("f14_pipeline_iqr", f"{{base}}, {_IQR} SELECT count(*) AS n FROM t, b WHERE NOT ({_HIGH['iqr'][1]})")
def _(spark, d):
    return outliers.pipeline_filter(comp(spark, d), AMOUNTS, "iqr").agg(F.count("*").alias("n"))


@register("f15_funnel", "SELECT 0 AS step, 'input' AS stage, count(*) AS rows, 100.0::DOUBLE AS percent FROM lineitem UNION ALL SELECT 1, 'quantity', count(*) FILTER (l_quantity > 5), round_even(100.0 * count(*) FILTER (l_quantity > 5) / count(*), 2)::DOUBLE FROM lineitem UNION ALL SELECT 2, 'tax', count(*) FILTER (l_quantity > 5 AND l_tax > 0.02), round_even(100.0 * count(*) FILTER (l_quantity > 5 AND l_tax > 0.02) / count(*), 2)::DOUBLE FROM lineitem")
def _(spark, d):
    return filters.funnel(table(spark, d, "lineitem"), [("quantity", F.col("l_quantity") > 5), ("tax", F.col("l_tax") > 0.02)])


@register("f16_complete_cases", "{base} SELECT count(*) AS rows, count(*) FILTER (disc_null IS NOT NULL AND tax_null IS NOT NULL) AS complete, round_even(100.0 * count(*) FILTER (disc_null IS NOT NULL AND tax_null IS NOT NULL) / count(*), 2)::DOUBLE AS percent FROM t")
def _(spark, d):
    return filters.complete_cases(comp(spark, d), ["disc_null", "tax_null"])


# ---- ternary -------------------------------------------------------------------------------------------------

_ABC = "p AS (SELECT *, disc_amt AS a, tax_amt AS b, qty_c + base AS c FROM t)"


@register("t01_coordinates", f"{{base}}, {_ABC} SELECT l_orderkey, l_linenumber, round(a / (a + b + c), 6) AS \"A\", round(b / (a + b + c), 6) AS \"B\", round(c / (a + b + c), 6) AS \"C\" FROM p WHERE a + b + c > 0")
def _(spark, d):
    return rounded(ternary.coordinates(comp(spark, d), ["disc_amt"], ["tax_amt"], ["qty_c", "base"]).select("l_orderkey", "l_linenumber", "A", "B", "C"))


@register("t02_percentages", "{base} SELECT l_returnflag, count(*) AS rows, count(disc_amt / nullif(disc_amt + tax_amt + disc_amt, 0)) AS valid, round(avg(100 * tax_amt / nullif(disc_amt + tax_amt + disc_amt, 0)), 6) AS mean_b FROM t GROUP BY 1")
def _(spark, d):
    p = ternary.percentages(comp(spark, d), ["disc_amt"], ["tax_amt"], ["disc_amt"])
    return rounded(p.groupBy("l_returnflag").agg(F.count("*").alias("rows"), F.count("A_pct").alias("valid"), F.avg("B_pct").alias("mean_b")))


@register("t02_file_summary", "SELECT l_returnflag AS file, count(*) AS rows, 15 AS columns FROM lineitem GROUP BY 1")
def _(spark, d):
    return ternary.file_summary(comp(spark, d), "l_returnflag")


@register("t03_batch_by_file", "{base}, b AS (SELECT l_returnflag AS g, quantile_cont(disc_amt, 0.25) AS a1, quantile_cont(disc_amt, 0.75) AS a3, quantile_cont(tax_amt, 0.25) AS b1, quantile_cont(tax_amt, 0.75) AS b3 FROM t GROUP BY 1) SELECT l_returnflag, count(*) AS n, round(avg(disc_amt / (disc_amt + tax_amt + qty_c + base)), 6) AS mean_a FROM t JOIN b ON g = l_returnflag WHERE disc_amt <= a3 + 1.5 * (a3 - a1) AND tax_amt <= b3 + 1.5 * (b3 - b1) GROUP BY 1")
def _(spark, d):
    points, _ = jobs.batch_ternary(comp(spark, d), jobs.Settings(*AXES, methods=["iqr"], method_columns=AMOUNTS), "l_returnflag")
    return rounded(points.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg("A").alias("mean_a")))


_HEX = ["l_quantity", "disc_amt", "tax_amt", "qty_c+base", "base", "l_discount", "l_tax+l_discount"]
_HEXCOLS = ["l_quantity", "disc_amt", "tax_amt", "qty_c + base", "base", "l_discount", "l_tax + l_discount"]
_HEXSQL = " UNION ALL ".join(f"SELECT {p} AS panel, {_HEXCOLS[i - 1]} AS \"A\", {_HEXCOLS[j - 1]} AS \"B\", {_HEXCOLS[k - 1]} AS \"C\" FROM t" for p, (i, j, k) in enumerate(ternary.PANELS, 1))


@register("t04_hexagon", f"{{base}}, h AS ({_HEXSQL}) SELECT panel, count(*) AS n, round(avg(\"A\"), 4) AS a, round(avg(\"B\"), 4) AS b, round(avg(\"C\"), 4) AS c FROM h WHERE \"A\" > 0 AND \"B\" > 0 AND \"C\" > 0 GROUP BY 1")
def _(spark, d):
    h = ternary.hexagon(comp(spark, d), _HEX)
    return rounded(h.groupBy("panel").agg(F.count("*").alias("n"), F.avg("A").alias("a"), F.avg("B").alias("b"), F.avg("C").alias("c")), 4)


_PLACE = """round(avg(1.5 / sqrt(3) * cos(radians(30 + 60 * (panel - 1))) + CASE WHEN panel % 2 = 0 THEN -1 ELSE 1 END * (("C" + "A" / 2) / ("A" + "B" + "C") - 0.5)), 6) AS x,
 round(avg(1.5 / sqrt(3) * sin(radians(30 + 60 * (panel - 1))) + CASE WHEN panel % 2 = 0 THEN -1 ELSE 1 END * ("A" * sqrt(3) / 2 / ("A" + "B" + "C") - sqrt(3) / 6)), 6) AS y"""


@register("t05_hexagon_places", f"{{base}}, h AS ({_HEXSQL}) SELECT panel, {_PLACE} FROM h WHERE \"A\" > 0 AND \"B\" > 0 AND \"C\" > 0 GROUP BY 1")
def _(spark, d):
    return rounded(jobs.hex_ternary(comp(spark, d), _HEX).groupBy("panel").agg(F.avg("x").alias("x"), F.avg("y").alias("y")))


@register("t06_point_sizes", "{base} SELECT l_orderkey, l_linenumber, round((qty_c + base) * 2.4 / (SELECT max(qty_c + base) FROM t) + 0.1, 6) AS point_size FROM t")
def _(spark, d):
    return rounded(ternary.point_sizes(comp(spark, d), ["qty_c", "base"]).select("l_orderkey", "l_linenumber", "point_size"))


_QUINT = "q AS (SELECT quantile_cont({x}, 0.2) AS q1, quantile_cont({x}, 0.4) AS q2, quantile_cont({x}, 0.6) AS q3, quantile_cont({x}, 0.8) AS q4 FROM {t})"


def _bin(x: str) -> str:
    return f"1 + ({x} > q1)::INT + ({x} > q2)::INT + ({x} > q3)::INT + ({x} > q4)::INT"


@register("t07_quintile_bins", f"{{base}}, {_QUINT.format(x='disc_amt', t='t')} SELECT bin, [16, 17, 15, 18, 19][bin] AS point_type, count(*) AS n, round(avg(disc_amt), 4) AS mean FROM (SELECT disc_amt, {_bin('disc_amt')} AS bin FROM t, q) GROUP BY 1, 2")
def _(spark, d):
    b = ternary.quintile_types(comp(spark, d), "disc_amt")
    return rounded(b.groupBy("bin", "point_type").agg(F.count("*").alias("n"), F.avg("disc_amt").alias("mean")), 4)


@register("t07_quintile_bins_by_file", f"{{base}}, q AS (SELECT l_returnflag AS g, quantile_cont(disc_amt, 0.2) AS q1, quantile_cont(disc_amt, 0.4) AS q2, quantile_cont(disc_amt, 0.6) AS q3, quantile_cont(disc_amt, 0.8) AS q4 FROM t GROUP BY 1) SELECT l_returnflag, {_bin('disc_amt')} AS bin, count(*) AS n FROM t JOIN q ON g = l_returnflag GROUP BY 1, 2")
def _(spark, d):
    return count_by(ternary.quintile_types_by(comp(spark, d), "disc_amt", ["l_returnflag"]), "l_returnflag", "bin")


@register("t08_colour_bins", f"WITH {_QUINT.format(x='value', t='events')} SELECT {list(ternary.PALETTE)}[{_bin('value')}] AS colour, count(*) AS n FROM events, q GROUP BY 1")
def _(spark, d):
    return count_by(ternary.colour_bins(table(spark, d, "events"), "value"), "colour")


@register("t08_colour_bins_by_file", f"{{base}}, q AS (SELECT l_returnflag AS g, quantile_cont(disc_amt, 0.2) AS q1, quantile_cont(disc_amt, 0.4) AS q2, quantile_cont(disc_amt, 0.6) AS q3, quantile_cont(disc_amt, 0.8) AS q4 FROM t GROUP BY 1) SELECT l_returnflag, {list(ternary.PALETTE)}[{_bin('disc_amt')}] AS colour, count(*) AS n FROM t JOIN q ON g = l_returnflag GROUP BY ALL")
def _(spark, d):
    return count_by(ternary.colour_bins(comp(spark, d), "disc_amt", by=["l_returnflag"]), "l_returnflag", "colour")


@register("t09_fixed_bins", "{base} SELECT CASE WHEN x < 1 OR x > 1e5 THEN NULL WHEN x <= 1.5 THEN '(1, 1.5]' WHEN x <= 3 THEN '(1.5, 3]' WHEN x <= 5 THEN '(3, 5]' WHEN x <= 10 THEN '(5, 10]' ELSE '(10, 100000]' END AS aspect_bin, count(*) AS n FROM (SELECT l_quantity / 4 AS x FROM t) GROUP BY 1")
def _(spark, d):
    binned = ternary.aspect_bins(comp(spark, d).select((F.col("l_quantity") / 4).alias("Aspect.Ratio")))
    return count_by(binned.withColumn("aspect_bin", F.when(F.col("aspect_bin") == "(10, 1e+05]", "(10, 100000]").otherwise(F.col("aspect_bin"))), "aspect_bin")


@register("t10_group_colours", 'SELECT event_type AS "group", count(*) AS samples, row_number() OVER (ORDER BY count(*) DESC, event_type)::INT AS colour_index FROM events GROUP BY 1')
def _(spark, d):
    return ternary.group_colours(table(spark, d, "events"), "event_type")


@register("t10_group_colours_many", 'SELECT l_orderkey AS "group", count(*) AS samples, row_number() OVER (ORDER BY count(*) DESC, l_orderkey)::INT AS colour_index FROM lineitem GROUP BY 1')
def _(spark, d):
    return ternary.group_colours(table(spark, d, "lineitem"), "l_orderkey")


@register("t10_group_colours_by_file", 'SELECT l_returnflag, l_partkey AS "group", count(*) AS samples, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_partkey)::INT AS colour_index FROM lineitem GROUP BY 1, 2')
def _(spark, d):
    return ternary.group_colours_by(table(spark, d, "lineitem"), "l_partkey", "l_returnflag")


@register("t11_group_summary", """WITH g AS (SELECT user_id::VARCHAR AS g, count(*) AS n FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, g) AS k FROM g)
SELECT least(k, 11)::INT AS rank, CASE WHEN k > 10 THEN '(other)' ELSE g END AS "group", sum(n)::BIGINT AS samples, round_even(100.0 * sum(n) / (SELECT count(*) FROM events), 1)::DOUBLE AS percent FROM r GROUP BY 1, 2""")
def _(spark, d):
    return ternary.group_summary(table(spark, d, "events"), "user_id")


@register("t12_size_legend", "SELECT k::INT AS entry, round(hi - k * (hi - lo) / 4, 6) AS value FROM (SELECT max(value) AS hi, min(value) AS lo FROM events), range(5) r(k)")
def _(spark, d):
    return rounded(ternary.size_legend(table(spark, d, "events"), "value"))


@register("t12_colour_legend", "SELECT k::INT AS entry, round(lo + k * (hi - lo) / 5, 6) AS low, round(lo + (k + 1) * (hi - lo) / 5, 6) AS high FROM (SELECT max(value) AS hi, min(value) AS lo FROM events), range(5) r(k)")
def _(spark, d):
    return rounded(ternary.colour_legend(table(spark, d, "events"), "value"))


@register("t13_styled", "{base} SELECT CASE WHEN disc_null IS NULL THEN 0.1 ELSE round(disc_null, 6) END AS point_size, 16 AS point_type, 'black' AS colour, count(*) AS n FROM t GROUP BY 1")
def _(spark, d):
    return count_by(rounded(ternary.styled(comp(spark, d), size="disc_null").select("point_size", "point_type", "colour")), "point_size", "point_type", "colour")


@register("t13_styled_by_columns", "SELECT l_quantity / 50 AS point_size, CASE WHEN l_returnflag = 'A' THEN 17 ELSE 16 END AS point_type, CASE WHEN l_linestatus = 'O' THEN 'red' ELSE 'black' END AS colour, count(*) AS n FROM lineitem GROUP BY ALL")
def _(spark, d):
    t = table(spark, d, "lineitem").selectExpr("l_quantity / 50 as s", "case when l_returnflag = 'A' then 17 end as k", "case when l_linestatus = 'O' then 'red' end as c")
    return count_by(ternary.styled(t, "s", "k", "c"), "point_size", "point_type", "colour")


@register("t14_plot_notes", "SELECT 'points' AS note, count(*)::VARCHAR AS value FROM lineitem WHERE l_quantity > 5 UNION ALL SELECT 'A columns', 'disc_amt' UNION ALL SELECT 'B columns', 'tax_amt' UNION ALL SELECT 'C columns', 'qty_c + base' UNION ALL SELECT 'C filter', 'qty_c > 250'")
def _(spark, d):
    axes = {"A": AXES[0], "B": AXES[1], "C": Element(["qty_c", "base"], filters={"qty_c": "> 250"})}
    return ternary.plot_notes(filters.filter_elements(comp(spark, d), list(axes.values())), axes)


@register("t15_worked_example", "SELECT o_orderkey, round(o_totalprice, 6) AS \"sum_A\", o_custkey::DOUBLE AS \"sum_B\", 1000.0::DOUBLE AS \"sum_C\", round(o_totalprice / (o_totalprice + o_custkey + 1000), 6) AS \"A\", round(o_custkey / (o_totalprice + o_custkey + 1000), 6) AS \"B\", round(1000 / (o_totalprice + o_custkey + 1000), 6) AS \"C\" FROM orders ORDER BY o_orderkey LIMIT 10")
def _(spark, d):
    t = table(spark, d, "orders").withColumn("k", F.lit(1000.0))
    return rounded(ternary.worked_example(t, ["o_totalprice"], ["o_custkey"], ["k"], ["o_orderkey"]))


@register("t15_example_statistics", "WITH e AS (SELECT o_totalprice / (o_totalprice + o_custkey + 1000) AS a, o_custkey / (o_totalprice + o_custkey + 1000) AS b, 1000 / (o_totalprice + o_custkey + 1000) AS c, m.d FROM orders JOIN (SELECT o_orderkey AS k, (pow(o_totalprice - mx, 2) * vy - 2 * (o_totalprice - mx) * (o_custkey - my) * v + pow(o_custkey - my, 2) * vx) / (vx * vy - v * v) AS d FROM orders, (SELECT avg(o_totalprice) AS mx, avg(o_custkey) AS my, var_samp(o_totalprice) AS vx, var_samp(o_custkey) AS vy, covar_samp(o_totalprice, o_custkey) AS v FROM orders)) m ON k = o_orderkey ORDER BY o_orderkey LIMIT 10) " + " UNION ALL ".join(f"SELECT '{n}' AS \"column\", round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS sd, round(min({x}), 6) AS min, round(max({x}), 6) AS max FROM e" for n, x in (("A", "a"), ("B", "b"), ("C", "c"), ("md2", "d"))))
def _(spark, d):
    t = mahalanobis.with_distance(table(spark, d, "orders").withColumn("k", F.lit(1000.0)), ["o_totalprice", "o_custkey"])
    return rounded(ternary.example_statistics(ternary.worked_example(t, ["o_totalprice"], ["o_custkey"], ["k"], ["o_orderkey"], distance="md2"), ["A", "B", "C", "md2"]))


# ---- multivariate --------------------------------------------------------------------------------------------

def _md(t: str, ref: str, out: str = "d") -> str:
    """CTEs: the squared distance of t's disc_amt, tax_amt to the mean and covariance of ref."""
    return f"""c AS (SELECT avg(disc_amt) AS mx, avg(tax_amt) AS my, var_samp(disc_amt) AS a, var_samp(tax_amt) AS b, covar_samp(disc_amt, tax_amt) AS v FROM {ref}),
    {out} AS (SELECT {t}.*, (b * (disc_amt - mx) ** 2 - 2 * v * (disc_amt - mx) * (tax_amt - my) + a * (tax_amt - my) ** 2) / (a * b - v * v) AS md2 FROM {t}, c)"""


@register("m02_check_data", "{base}, o AS (SELECT * FROM t WHERE l_linestatus = 'O'), r AS (" + " UNION ALL ".join(f"SELECT '{x} and {y}' AS pair, corr({x}, {y}) AS r FROM o" for x, y in (("base", "l_extendedprice"), ("base", "l_tax"), ("l_extendedprice", "l_tax"))) + ") SELECT 'correlation' AS \"check\", 'warning' AS severity, pair AS detail FROM r WHERE abs(r) > 0.9")
def _(spark, d):
    first, second = halves(spark, d)
    return mahalanobis.check_data(first, second, ["base", "l_extendedprice", "l_tax"]).where("check = 'correlation'")


@register("m03_mahalanobis", f"{{base}}, {_md('t', 't')} SELECT l_orderkey, l_linenumber, round(md2, 4) AS md2 FROM d")
def _(spark, d):
    return rounded(mahalanobis.with_distance(comp(spark, d), AMOUNTS).select("l_orderkey", "l_linenumber", "md2"), 4)


@register("m05_auto_threshold", f"{{base}}, {_md('t', 't')}, h AS (SELECT avg(md2) + sqrt(100 / 101.0) * stddev_samp(md2) AS lim FROM d) SELECT l_returnflag, md2 > lim AS is_outlier, count(*) AS n FROM d, h GROUP BY 1, 2")
def _(spark, d):
    return count_by(mahalanobis.mahalanobis(comp(spark, d), AMOUNTS)[0], "l_returnflag", "is_outlier")


@register("m05_manual_threshold", f"{{base}}, {_md('t', 't')} SELECT l_returnflag, count(*) AS n FROM d WHERE md2 > 8 GROUP BY 1")
def _(spark, d):
    return count_by(mahalanobis.mahalanobis(comp(spark, d), AMOUNTS, threshold=8.0)[0].where("is_outlier"), "l_returnflag")


_SUM = f"""{{base}}, f AS (SELECT * FROM t WHERE l_linestatus = 'F'), o AS (SELECT * FROM t WHERE l_linestatus = 'O'), {_md('f', 'o')},
s AS (SELECT count(*)::DOUBLE AS n, avg(md2) AS mean, stddev_samp(md2) AS sd, count(*) FILTER (md2 > {chi_square_quantile(0.95, 2)!r})::DOUBLE AS o95, count(*) FILTER (md2 > {chi_square_quantile(0.99, 2)!r})::DOUBLE AS o99 FROM d),
h AS (SELECT mean + sqrt(100 / 101.0) * sd AS lim FROM s)
SELECT metric, round(value, 4) AS value FROM (SELECT unnest(['rows', 'mean', 'sd', 'threshold', 'df', 'over_95', 'over_99', 'outliers']) AS metric, unnest([n, mean, sd, lim, 2.0, o95, o99, (SELECT count(*) FROM d, h WHERE md2 > lim)::DOUBLE]) AS value FROM s, h)"""


@register("m06_distance_summary", _SUM)
def _(spark, d):
    first, second = halves(spark, d)
    return rounded(mahalanobis.summary(first, AMOUNTS, ref=second), 4)


@register("m07_reference_modes", f"{{base}}, f AS (SELECT * FROM t WHERE l_linestatus = 'F'), o AS (SELECT * FROM t WHERE l_linestatus = 'O'), {_md('f', 'o')} SELECT l_returnflag, round(avg(md2), 4) AS mean FROM d GROUP BY 1")
def _(spark, d):
    first, second = halves(spark, d)
    ref = mahalanobis.reference_of("dataset2", first, first, second)
    return rounded(mahalanobis.with_distance(first, AMOUNTS, ref).groupBy("l_returnflag").agg(F.avg("md2").alias("mean")), 4)


@register("m08_distance_filter", f"{{base}}, {_md('t', 't')}, h AS (SELECT avg(md2) + sqrt(100 / 101.0) * stddev_samp(md2) AS lim FROM d) SELECT l_returnflag, count(*) AS n FROM d, h WHERE md2 <= lim GROUP BY 1")
def _(spark, d):
    return count_by(mahalanobis.mahalanobis_filter(comp(spark, d), AMOUNTS), "l_returnflag")


_NULLMD = """c AS (SELECT avg(disc_null) AS mx, avg(tax_null) AS my, var_samp(disc_null) AS a, var_samp(tax_null) AS b, covar_samp(disc_null, tax_null) AS v FROM t WHERE disc_null IS NOT NULL AND tax_null IS NOT NULL),
d AS (SELECT t.*, (b * (disc_null - mx) ** 2 - 2 * v * (disc_null - mx) * (tax_null - my) + a * (tax_null - my) ** 2) / (a * b - v * v) AS md2 FROM t, c), h AS (SELECT avg(md2) + sqrt(100 / 101.0) * stddev_samp(md2) AS lim FROM d)"""


@register("m09_distance_flags", f"{{base}}, {_NULLMD} SELECT coalesce(md2 > lim, false) AS is_outlier, count(*) AS n FROM d, h GROUP BY 1")
def _(spark, d):
    return count_by(mahalanobis.mahalanobis_flag(comp(spark, d), ["disc_null", "tax_null"]), "is_outlier")


@register("m03_mahalanobis_by_file", """{base}, c AS (SELECT l_returnflag AS g, avg(disc_amt) AS mx, avg(tax_amt) AS my, var_samp(disc_amt) AS a, var_samp(tax_amt) AS b, covar_samp(disc_amt, tax_amt) AS v FROM t GROUP BY 1),
d AS (SELECT t.*, (b * (disc_amt - mx) ** 2 - 2 * v * (disc_amt - mx) * (tax_amt - my) + a * (tax_amt - my) ** 2) / (a * b - v * v) AS md2 FROM t JOIN c ON g = l_returnflag),
h AS (SELECT l_returnflag AS g, avg(md2) + sqrt(100 / 101.0) * stddev_samp(md2) AS lim FROM d GROUP BY 1)
SELECT l_returnflag, md2 > lim AS is_outlier, count(*) AS n, round(avg(md2), 4) AS mean FROM d JOIN h ON g = l_returnflag GROUP BY 1, 2""")
def _(spark, d):
    return rounded(mahalanobis.by_group(comp(spark, d), AMOUNTS, "l_returnflag").groupBy("l_returnflag", "is_outlier").agg(F.count("*").alias("n"), F.avg("md2").alias("mean")), 4)


@register("m10_isolation_scores")
def _(spark, d):
    first, second = halves(spark, d)
    forest = iforest.train(second, ["disc_amt", "tax_amt", "l_quantity"], key=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])
    return first.select("l_orderkey", "l_linenumber", iforest.score(forest).alias("if_score"))


@register("m11_isolation_flags")
def _(spark, d):
    first, second = halves(spark, d)
    return count_by(iforest.isolation_forest(first, second, ["disc_amt", "tax_amt", "l_quantity"]), "l_returnflag", "is_outlier")


@register("m11_isolation_by_file")
def _(spark, d):
    return count_by(iforest.isolation_forest_by(comp(spark, d), ["disc_amt", "tax_amt", "l_quantity"], "l_returnflag"), "l_returnflag", "is_outlier")


#: A forest of three small trees with given splits: column, value, path length; the children of node k are 2 k + 1 and 2 k + 2.
_FIXED = iforest.Forest(
    ("disc_amt", "tax_amt", "l_quantity"), np.array([[0, 1, 2, -1, -1, -1, -1], [2, -1, 0, -1, -1, -1, -1], [1, 0, -1, -1, -1, -1, -1]]),
    np.array([[3000.0, 900.0, 25.0, 0, 0, 0, 0], [10.0, 0, 5000.0, 0, 0, 0, 0], [2500.0, 1200.0, 0, 0, 0, 0, 0]]),
    np.array([[0, 0, 0, 4.0, 3.0, 2.5, 2.0], [0, 3.5, 0, 0, 0, 3.0, 1.5], [0, 0, 1.0, 4.5, 3.0, 0, 0]]), iforest._mean_path(256))


@register("m10_fixed_forest", """{base}, p AS (SELECT *, CASE WHEN disc_amt < 3000 THEN CASE WHEN tax_amt < 900 THEN 4.0 ELSE 3.0 END WHEN l_quantity < 25 THEN 2.5 ELSE 2.0 END
  + CASE WHEN l_quantity < 10 THEN 3.5 WHEN disc_amt < 5000 THEN 3.0 ELSE 1.5 END + CASE WHEN tax_amt < 2500 THEN CASE WHEN disc_amt < 1200 THEN 4.5 ELSE 3.0 END ELSE 1.0 END AS path FROM t)
SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(pow(2, -path / 3 / (2 * (ln(255) + 0.5772156649015329) - 2 * 255 / 256.0::DOUBLE))), 6) AS score FROM p GROUP BY ALL""")
def _(spark, d):
    marked = comp(spark, d).withColumn("s", iforest.score(_FIXED))
    return rounded(marked.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.avg("s").alias("score")))


def _flags(spark, d):
    t = outliers.outlier_flag(comp(spark, d), AMOUNTS, "iqr", flag="f_iqr")
    return outliers.outlier_flag(t, AMOUNTS, "mad", flag="f_mad"), {"iqr": "f_iqr", "mad": "f_mad"}


_TWO = f"{{base}}, i AS (WITH {_IQR} SELECT * FROM b), m AS (WITH {_MAD} SELECT * FROM b), f AS (SELECT t.*, (disc_amt > i.a3 + 1.5 * (i.a3 - i.a1) OR tax_amt > i.b3 + 1.5 * (i.b3 - i.b1)) AS x, (disc_amt > m.am + m.ad OR tax_amt > m.bm + m.bd) AS y FROM t, i, m)"


@register("m12_combined", _TWO + " SELECT count(*) AS rows, count(*) FILTER (x OR y) AS outliers, round_even(100.0 * count(*) FILTER (x OR y) / count(*), 2)::DOUBLE AS percent, 'iqr, mad' AS methods FROM f")
def _(spark, d):
    t, f = _flags(spark, d)
    return combine.combined_summary(t, f)


@register("m13_agreement", _TWO + ", r AS (SELECT 100.0 * count(*) FILTER (x AND y) / nullif(count(*) FILTER (x OR y), 0) AS v FROM f) SELECT unnest(['iqr', 'iqr', 'mad', 'mad']) AS method1, unnest(['iqr', 'mad', 'iqr', 'mad']) AS method2, unnest([100.0::DOUBLE, round(coalesce(v, 0)::DOUBLE, 6), round(coalesce(v, 0)::DOUBLE, 6), 100.0]) AS agreement FROM r")
def _(spark, d):
    t, f = _flags(spark, d)
    return rounded(combine.agreement(t, f))


@register("m14_multivariate_analysis")
def _(spark, d):
    marked, f = combine.multivariate_analysis(comp(spark, d), AMOUNTS, ["mahalanobis", "isolation_forest", "iqr", "zscore", "mad"])
    return count_by(marked, *f.values(), "is_outlier")


@register("m14_distance_and_rules", f"""{{base}}, {_md('t', 't')}, h AS (SELECT avg(md2) + sqrt(100.0::DOUBLE / 101) * stddev_samp(md2) AS lim FROM d),
  i AS (WITH {_IQR} SELECT * FROM b), z AS (WITH {_Z} SELECT * FROM b), m AS (WITH {_MAD} SELECT * FROM b),
  f AS (SELECT md2 > lim AS w, (disc_amt > i.a3 + 2.5 * (i.a3 - i.a1) OR tax_amt > i.b3 + 2.5 * (i.b3 - i.b1)) AS x, (disc_amt > z.am + 3 * z.asd OR tax_amt > z.bm + 3 * z.bsd) AS y, (disc_amt > m.am + m.ad OR tax_amt > m.bm + m.bd) AS u FROM d, h, i, z, m)
SELECT w AS mahalanobis_outlier, x AS iqr_outlier, y AS zscore_outlier, u AS mad_outlier, (w OR x OR y OR u) AS is_outlier, count(*) AS n FROM f GROUP BY ALL""")
def _(spark, d):
    marked, f = combine.multivariate_analysis(comp(spark, d), AMOUNTS, ["mahalanobis", "iqr", "zscore", "mad"], limits={"iqr": 2.5})
    return count_by(marked, *f.values(), "is_outlier")


@register("m15_method_summary", _TWO + " SELECT 'iqr' AS method, count(*) AS points, count(*) FILTER (x) AS outliers, round_even(100.0 * count(*) FILTER (x) / count(*), 2)::DOUBLE AS percent FROM f UNION ALL SELECT 'mad', count(*), count(*) FILTER (y), round_even(100.0 * count(*) FILTER (y) / count(*), 2)::DOUBLE FROM f")
def _(spark, d):
    t, f = _flags(spark, d)
    return combine.method_summary(t, f)


@register("m16_chi_square_mode", f"{{base}}, {_md('t', 't')} SELECT l_returnflag, count(*) AS n FROM d WHERE md2 > {chi_square_quantile(0.975, 2)!r} GROUP BY 1")
def _(spark, d):
    return count_by(mahalanobis.mahalanobis(comp(spark, d), AMOUNTS, threshold="chisq")[0].where("is_outlier"), "l_returnflag")


@register("m16_p_values", f"{{base}}, {_md('t', 't')} SELECT l_orderkey, l_linenumber, round(exp(-md2 / 2), 4) AS p_value FROM d")
def _(spark, d):
    return rounded(mahalanobis.with_p_value(mahalanobis.with_distance(comp(spark, d), AMOUNTS), 2).select("l_orderkey", "l_linenumber", "p_value"), 4)


@register("t14_plot_notes_distance", f"{{base}}, {_md('t', 't')}, s AS (SELECT count(*) AS n, avg(md2) AS m, stddev_samp(md2) AS v FROM d) SELECT unnest(['points', 'A columns', 'B columns', 'C columns', 'MDthresh', 'MDmean', 'stdMD']) AS note, unnest([n::VARCHAR, 'disc_amt', 'tax_amt', 'qty_c + base', format('{{:.4f}}', m + sqrt(100 / 101.0::DOUBLE) * v), format('{{:.4f}}', m), format('{{:.4f}}', v)]) AS value FROM s")
def _(spark, d):
    marked, facts = mahalanobis.mahalanobis(comp(spark, d), AMOUNTS)
    return ternary.plot_notes(marked, dict(zip("ABC", AXES, strict=True)), distance="md2", threshold=facts["threshold"])


@register("m16_p_values_odd", f"{{base}}, {_md('t', 't')} SELECT l_returnflag, count(*) FILTER (md2 > {chi_square_quantile(0.95, 3)!r}) AS under_5, count(*) FILTER (md2 > {chi_square_quantile(0.5, 3)!r}) AS under_50 FROM d GROUP BY 1")
def _(spark, d):
    marked = mahalanobis.with_p_value(mahalanobis.with_distance(comp(spark, d), AMOUNTS), 3)
    return marked.groupBy("l_returnflag").agg(F.count_if(F.col("p_value") < 0.05).alias("under_5"), F.count_if(F.col("p_value") < 0.5).alias("under_50"))


@register("m17_robust_distance")
def _(spark, d):
    return count_by(mahalanobis.robust_flag(comp(spark, d), AMOUNTS), "l_returnflag", "is_outlier")


# ---- statistics ----------------------------------------------------------------------------------------------

_FOUR = ["disc_amt", "tax_amt", "l_quantity", "disc_null"]


def _each(names: list[str], select: str, t: str = "t", group: str = "") -> str:
    """One SELECT per column: ``x`` stands for it."""
    return " UNION ALL ".join(f"SELECT {group}'{n}' AS \"column\", {select} FROM (SELECT *, {n}::DOUBLE AS x FROM {t})" + (f" GROUP BY {group.rstrip(', ')}" if group else "") for n in names)


@register("a01_describe", "{base} " + _each(_FOUR, "round(avg(x), 4) AS mean, round(median(x), 4) AS median, round(stddev_samp(x), 4) AS sd"))
def _(spark, d):
    return rounded(stats.describe(comp(spark, d), _FOUR), 4)


@register("a01_describe_by_file", "{base} " + _each(_FOUR, "round(avg(x), 4) AS mean, round(median(x), 4) AS median, round(stddev_samp(x), 4) AS sd", group="l_returnflag, "))
def _(spark, d):
    return rounded(stats.describe(comp(spark, d), _FOUR, ["l_returnflag"]), 4)


_FIVE = "round(min(x), 4) AS min, round(quantile_cont(x, 0.25), 4) AS q1, round(median(x), 4) AS median, round(avg(x), 4) AS mean, round(quantile_cont(x, 0.75), 4) AS q3, round(max(x), 4) AS max"


@register("a02_five_numbers", "{base} " + _each(_FOUR, _FIVE))
def _(spark, d):
    return rounded(stats.five_numbers(comp(spark, d), _FOUR), 4)


@register("a03_summary_with_missing", "{base} " + _each(_FOUR, _FIVE + ", count(*) FILTER (x IS NULL) AS missing, count(*) AS rows"))
def _(spark, d):
    return rounded(stats.summary_with_missing(comp(spark, d), _FOUR), 4)


@register("a04_compare_summaries", "SELECT *, 'Dataset 1' AS dataset FROM (" + _each(["acctbal"], _FIVE, "(SELECT c_acctbal AS acctbal FROM customer)") + ") UNION ALL SELECT *, 'Dataset 2' FROM (" + _each(["acctbal"], _FIVE, "(SELECT s_acctbal AS acctbal FROM supplier)") + ")")
def _(spark, d):
    return rounded(stats.compare_summaries(table(spark, d, "customer").select(F.col("c_acctbal").alias("acctbal")), table(spark, d, "supplier").select(F.col("s_acctbal").alias("acctbal"))), 4)


_COR = ["disc_amt", "tax_amt", "l_quantity"]
_NULLS = ["disc_null", "tax_null", "l_quantity"]


def _corr(names: list[str], t: str, where: str = "", pairwise: bool = False) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS var1, '{b}' AS var2, round(corr({a}, {b}), 6) AS r, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM {t}{where}" for a in names for b in names)


_ALLNULL = " WHERE disc_null IS NOT NULL AND tax_null IS NOT NULL"


@register("a05_correlation_listwise", "{base} " + _corr(_NULLS, "t", _ALLNULL))
def _(spark, d):
    return rounded(stats.correlations(comp(spark, d), _NULLS))


@register("a06_correlation_pairwise", "{base} " + _corr(_NULLS, "t"))
def _(spark, d):
    return rounded(stats.correlations(comp(spark, d), _NULLS, pairwise=True))


_RANKS = ", ".join(f"rank() OVER (ORDER BY {n}) + (count(*) OVER (PARTITION BY {n}) - 1) / 2.0 AS r_{n}" for n in _COR)


@register("a07_spearman", "{base}, k AS (SELECT " + _RANKS + " FROM t) " + " UNION ALL ".join(f"SELECT '{a}' AS var1, '{b}' AS var2, round(corr(r_{a}, r_{b}), 6) AS r, count(*) AS n FROM k" for a in _COR for b in _COR))
def _(spark, d):
    return rounded(stats.correlations(comp(spark, d), _COR, method="spearman"))


@register("a07_kendall", "WITH p AS (SELECT l_quantity AS x, l_discount AS y, count(*)::DOUBLE AS k FROM lineitem GROUP BY 1, 2) SELECT 'l_quantity' AS var1, 'l_discount' AS var2, round(sum(a.k * b.k * sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(sum(a.k * b.k * abs(sign(a.x - b.x))) * sum(a.k * b.k * abs(sign(a.y - b.y)))), 6) AS r, (SELECT count(*) FROM lineitem) AS n FROM p a, p b")
def _(spark, d):
    return rounded(stats.kendall(table(spark, d, "lineitem"), "l_quantity", "l_discount"))


@register("a07_kendall_amounts", "WITH p AS (SELECT value AS x, user_id AS y, count(*)::DOUBLE AS k FROM events GROUP BY 1, 2) SELECT 'value' AS var1, 'user_id' AS var2, round(sum(a.k * b.k * sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(sum(a.k * b.k * abs(sign(a.x - b.x))) * sum(a.k * b.k * abs(sign(a.y - b.y)))), 6) AS r, (SELECT sum(k) FROM p)::BIGINT AS n FROM p a, p b")
def _(spark, d):
    return rounded(stats.kendall(table(spark, d, "events"), "value", "user_id"))


@register("a08_high_correlations", "{base} SELECT * FROM (" + _corr(["disc_amt", "l_discount", "base", "qty_c"], "t") + ") WHERE var1 <> var2 AND abs(r) > 0.5")
def _(spark, d):
    return rounded(stats.high_correlations(stats.correlations(comp(spark, d), ["disc_amt", "l_discount", "base", "qty_c"]), 0.5))


@register("a09_correlation_difference", "{base}, a AS (" + _corr(_COR, "(SELECT * FROM t WHERE l_linestatus = 'F')") + "), b AS (" + _corr(_COR, "(SELECT * FROM t WHERE l_linestatus = 'O')") + ") SELECT var1, var2, a.r AS r1, b.r AS r2, round(a.r - b.r, 4) AS difference, abs(a.r - b.r) > 0.3 AS is_large FROM a JOIN b USING (var1, var2)")
def _(spark, d):
    first, second = halves(spark, d)
    return rounded(stats.correlation_difference(first, second, _COR), difference=4)


_ORD = "a AS (SELECT o_orderkey AS k, o_totalprice AS p FROM orders), b AS (SELECT o_orderkey - 1 AS k, o_totalprice AS p FROM orders)"


def _shifted(spark, d):
    t = table(spark, d, "orders")
    return t.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p")), t.select((F.col("o_orderkey") - 1).alias("k"), F.col("o_totalprice").alias("p"))


@register("a10_paired_correlation", f"WITH {_ORD} SELECT 'p' AS \"column\", round(corr(a.p, b.p), 6) AS r, count(*) AS n FROM a JOIN b USING (k)")
def _(spark, d):
    return rounded(stats.paired_correlation(*_shifted(spark, d), ["p"], ["k"]))


@register("a10_paired_summary", f"WITH {_ORD}, c AS (SELECT corr(a.p, b.p) AS r FROM a JOIN b USING (k)) SELECT round(r, 6) AS mean, round(r, 6) AS median, round(r, 6) AS min, round(r, 6) AS max, (abs(r) > 0.7)::BIGINT AS over FROM c")
def _(spark, d):
    return rounded(stats.paired_summary(stats.paired_correlation(*_shifted(spark, d), ["p"], ["k"])))


@register("a10_paired_by_position", "WITH a AS (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders), b AS (SELECT c_acctbal AS x, row_number() OVER (ORDER BY c_custkey DESC) AS k FROM customer) SELECT 'x' AS \"column\", round(corr(a.x, b.x), 6) AS r, count(*) AS n FROM a JOIN b USING (k)")
def _(spark, d):
    a = table(spark, d, "orders").select(F.col("o_totalprice").alias("x"), F.col("o_orderkey").alias("at"))
    b = table(spark, d, "customer").select(F.col("c_acctbal").alias("x"), (-F.col("c_custkey")).alias("at"))
    return rounded(stats.paired_by_position(a, b, ["x"], ["at"]))


@register("a11_dataset_summary", "{base} SELECT count(*) AS rows, 4::BIGINT AS columns, 3::BIGINT AS numeric_columns, count(*) FILTER (disc_null IS NULL) + count(*) FILTER (tax_null IS NULL) AS missing FROM t")
def _(spark, d):
    return stats.dataset_summary(comp(spark, d).select("l_returnflag", "disc_null", "tax_null", "l_quantity"))


@register("a12_readiness", "SELECT (SELECT count(*) FROM customer) AS rows1, (SELECT count(*) FROM supplier) AS rows2, 2::BIGINT AS columns1, 2::BIGINT AS columns2, 2::BIGINT AS common_numeric, true AS ready")
def _(spark, d):
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("acctbal"))
    return stats.readiness(a, table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("acctbal")))


@register("a13_analyze_data", "{base} " + _each(AMOUNTS, "round(avg(x), 4) AS mean, round(median(x), 4) AS median, round(stddev_samp(x), 4) AS sd"))
def _(spark, d):
    return rounded(jobs.analyze_data(comp(spark, d), [*AMOUNTS, "disc_amt", "no such column"])["statistics"], 4)


# ---- quality -------------------------------------------------------------------------------------------------

_QCOLS = ["disc_amt", "disc_null", "tax_null", "l_quantity", "flat"]
_QBASE = "{base}, z AS (SELECT *, 1.0::DOUBLE AS flat FROM t)"
_QUAL = "count(*) AS rows, count(*) FILTER (x IS NULL) AS missing, count(*) FILTER (isinf(x)) AS infinite, min(x) = max(x) AS zero_variance, count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outliers"


def _qual(t: str = "z", names: list[str] = _QCOLS) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS \"column\", {_QUAL} FROM (SELECT {n}::DOUBLE AS x FROM {t}), (SELECT quantile_cont({n}, 0.25) AS q1, quantile_cont({n}, 0.75) AS q3 FROM {t})" for n in names)


def _with_flat(spark, d):
    return comp(spark, d).withColumn("flat", F.lit(1.0))


@register("q05_column_quality", f"{_QBASE} {_qual()}")
def _(spark, d):
    return quality.column_quality(_with_flat(spark, d), _QCOLS)


@register("q01_missing", f"{_QBASE}, q AS ({_qual()}) SELECT \"column\", missing FROM q")
def _(spark, d):
    return quality.column_quality(_with_flat(spark, d), _QCOLS).select("column", "missing")


@register("q02_infinite", "{base} SELECT 'x' AS \"column\", count(*) FILTER (l_discount = 0) AS infinite FROM t")
def _(spark, d):
    t = comp(spark, d).select(F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.col("l_discount")).alias("x"))
    return quality.column_quality(t, ["x"]).select("column", "infinite")


@register("q03_zero_variance", f"{_QBASE}, q AS ({_qual()}) SELECT \"column\", zero_variance FROM q")
def _(spark, d):
    return quality.column_quality(_with_flat(spark, d), _QCOLS).select("column", "zero_variance")


@register("q04_outliers", f"{_QBASE}, q AS ({_qual()}) SELECT \"column\", outliers FROM q")
def _(spark, d):
    return quality.column_quality(_with_flat(spark, d), _QCOLS, fewest=4).select("column", "outliers")


@register("q06_issues", f"{_QBASE} SELECT 'error' AS severity, 'missing column' AS \"check\", 'nowhere' AS \"column\" UNION ALL " + " UNION ALL ".join(f"SELECT 'warning', 'zero variance', '{n}' FROM z HAVING min({n}) = max({n})" for n in ("disc_amt", "flat")))
def _(spark, d):
    return quality.issues(_with_flat(spark, d), ["disc_amt", "flat", "nowhere"])


@register("q06_issues_of_values", "WITH z AS (SELECT CASE WHEN l_tax <= 0.02 THEN l_tax END AS sparse, CASE WHEN l_linenumber = 1 THEN 'infinity'::DOUBLE ELSE l_tax END AS endless, l_discount FROM lineitem) "
          + " UNION ALL ".join(f"SELECT 'warning' AS severity, 'over half missing' AS \"check\", '{n}' AS \"column\" FROM z HAVING count(*) > 2 * count({n}) UNION ALL SELECT 'warning', 'infinite values', '{n}' FROM z HAVING count(*) FILTER (isinf({n})) > 0" for n in ("sparse", "endless", "l_discount")))
def _(spark, d):
    t = table(spark, d, "lineitem").selectExpr("case when l_tax <= 0.02D then l_tax end as sparse", "case when l_linenumber = 1 then double('infinity') else l_tax end as endless", "l_discount")
    return quality.issues(t)


@register("q07_missing_summary", f"{_QBASE}, q AS ({_qual()}), k AS (SELECT count(*) FILTER (disc_null IS NOT NULL AND tax_null IS NOT NULL) AS complete, round_even(100.0 * count(*) FILTER (disc_null IS NOT NULL AND tax_null IS NOT NULL) / count(*), 2)::DOUBLE AS percent FROM z) SELECT \"column\", missing, outliers, complete, percent FROM q, k")
def _(spark, d):
    return quality.missing_summary(_with_flat(spark, d), _QCOLS)


@register("q08_distribution", "{base} " + " UNION ALL ".join(f"SELECT '{n}' AS \"column\", round(any_value(m), 4) AS mean, round(median(x), 4) AS median, round(stddev_samp(x), 4) AS sd, round(avg((x - m) ** 3) / avg((x - m) ** 2) ** 1.5, 4) AS skewness, round(avg((x - m) ** 4) / avg((x - m) ** 2) ** 2, 4) AS kurtosis FROM (SELECT {n} AS x, avg({n}) OVER () AS m FROM t)" for n in _COR))
def _(spark, d):
    return rounded(quality.distribution(comp(spark, d), _COR), 4)


@register("q09_check_quality", "{base}, z AS (SELECT *, 1.0::DOUBLE AS flat FROM t), f AS (SELECT * FROM z WHERE l_linestatus = 'F'), o AS (SELECT * FROM z WHERE l_linestatus = 'O') SELECT *, 'Dataset 1' AS dataset FROM (" + _qual("f") + ") UNION ALL SELECT *, 'Dataset 2' FROM (" + _qual("o") + ")")
def _(spark, d):
    first, second = halves(spark, d)
    return quality.check_data_quality(first.withColumn("flat", F.lit(1.0)), second.withColumn("flat", F.lit(1.0)), _QCOLS)["quality"]


@register("q10_quality_score", f"{_QBASE}, q AS ({_qual()}), s AS (SELECT round_even(100 - 100.0 * sum(missing) / sum(rows) - 100.0 * sum(infinite) / sum(rows) - 50.0 * count(*) FILTER (zero_variance) / count(*) - least(20.0 * sum(outliers) / sum(rows), 30), 1)::DOUBLE AS score FROM q) SELECT score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM s")
def _(spark, d):
    return quality.quality_score(_with_flat(spark, d), _QCOLS)


def _totals(t: str, names: list[str] = _QCOLS) -> str:
    return f"SELECT unnest(['missing', 'infinite', 'zero_variance', 'outliers']) AS metric, unnest([sum(missing)::BIGINT, sum(infinite)::BIGINT, count(*) FILTER (zero_variance), sum(outliers)::BIGINT]) AS v FROM ({_qual(t, names)})"


@register("q11_quality_summary", "{base}, z AS (SELECT *, 1.0::DOUBLE AS flat FROM t), f AS (SELECT * FROM z WHERE l_linestatus = 'F'), o AS (SELECT * FROM z WHERE l_linestatus = 'O'), a AS (" + _totals("f") + "), b AS (" + _totals("o") + ") SELECT metric, a.v AS \"Dataset 1\", b.v AS \"Dataset 2\" FROM a JOIN b USING (metric)")
def _(spark, d):
    first, second = halves(spark, d)
    return quality.quality_summary(first.withColumn("flat", F.lit(1.0)), second.withColumn("flat", F.lit(1.0)), _QCOLS)


@register("q12_consistency", "{base} " + _each(_FOUR, "round(min(x), 4) AS min, round(max(x), 4) AS max, round(max(x) - min(x), 4) AS range, round(100.0 * count(*) FILTER (x IS NULL) / count(*), 4) AS missing_percent"))
def _(spark, d):
    return rounded(quality.consistency(comp(spark, d), _FOUR), 4)


@register("q13_normality")
def _(spark, d):
    return quality.normality(comp(spark, d), ["disc_amt", "l_quantity"])


@register("q13_normality_by_group")
def _(spark, d):
    return quality.normality_by_group(comp(spark, d).select("l_suppkey", "disc_amt", "l_quantity"), ["l_suppkey"])


@register("q13_jarque_bera_by_group", "{base}, m AS (SELECT l_returnflag, avg(disc_amt) AS m FROM t GROUP BY 1), k AS (SELECT l_returnflag, count(*) AS n, avg(pow(disc_amt - m, 2)) AS k2, avg(pow(disc_amt - m, 3)) AS k3, avg(pow(disc_amt - m, 4)) AS k4 FROM t JOIN m USING (l_returnflag) GROUP BY 1) SELECT l_returnflag, 'disc_amt' AS \"column\", n, CASE WHEN n > 5000 THEN 'too many values' ELSE 'ok' END AS status, round(n / 6.0 * (pow(k3 / pow(k2, 1.5), 2) + pow(k4 / (k2 * k2) - 3, 2) / 4), 3) AS jarque_bera FROM k")
def _(spark, d):
    return rounded(quality.normality_by_group(comp(spark, d), ["l_returnflag"], ["disc_amt"]).select("l_returnflag", "column", "n", "status", "jarque_bera"), 3)


@register("q14_duplicates", "WITH g AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) SELECT sum(n)::BIGINT AS rows, sum(n - 1)::BIGINT AS duplicates, round_even(100.0 * sum(n - 1) / sum(n), 2)::DOUBLE AS percent FROM g")
def _(spark, d):
    return quality.duplicates(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"))


@register("q15_empty_columns", "WITH z AS (SELECT l_tax, NULL::DOUBLE AS \"none\", '' AS blank, 7 AS flat FROM lineitem) " + " UNION ALL ".join(f"SELECT '{n}' AS \"column\", count(*) FILTER (\"{n}\" <> {zero}) = 0 AS empty, count(DISTINCT \"{n}\") <= 1 AS constant FROM z" for n, zero in (("l_tax", "0"), ("none", "0"), ("blank", "''"), ("flat", "0"))))
def _(spark, d):
    t = comp(spark, d).select("l_tax", F.lit(None).cast("double").alias("none"), F.lit("").alias("blank"), F.lit(7).alias("flat"))
    return quality.empty_columns(t)


@register("q16_compare_datasets", "SELECT unnest(['rows1', 'rows2', 'columns1', 'columns2', 'common', 'only1', 'only2', 'overlap_percent', 'types_match']) AS metric, unnest([(SELECT count(*)::VARCHAR FROM customer), (SELECT count(*)::VARCHAR FROM supplier), '3', '2', '2', 'c_mktsegment', '', '66.7', 'true']) AS value")
def _(spark, d):
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("acctbal"), "c_mktsegment")
    return quality.compare_datasets(a, table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("acctbal")))


@register("q17_comprehensive", "{base}, f AS (SELECT * FROM t WHERE l_linestatus = 'F') " + _each(AMOUNTS, "round(min(x), 4) AS min, round(max(x), 4) AS max, round(max(x) - min(x), 4) AS range, 0.0::DOUBLE AS missing_percent", "f"))
def _(spark, d):
    first, second = halves(spark, d)
    return rounded(quality.comprehensive(first.select(*AMOUNTS), second.select(*AMOUNTS))["consistency1"], 4)


# ---- charts --------------------------------------------------------------------------------------------------

_HIST = "e AS (SELECT min(value) AS lo, (max(value) - min(value)) / 30 AS w FROM events), h AS (SELECT event_type, least(floor((value - lo) / w), 29)::INT AS bin, lo, w, count(*) AS n FROM events, e GROUP BY ALL)"


@register("c01_histogram", f"WITH {_HIST} SELECT bin, round(lo + bin * w, 6) AS low, round(lo + (bin + 1) * w, 6) AS high, sum(n)::BIGINT AS count FROM h GROUP BY bin, lo, w")
def _(spark, d):
    return rounded(charts.histogram(table(spark, d, "events"), "value").drop("density"))


@register("c02_histogram_density", f"WITH {_HIST} SELECT event_type, bin, n AS count, round(n / (sum(n) OVER (PARTITION BY event_type) * w), 8) AS density FROM h")
def _(spark, d):
    return rounded(charts.histogram(table(spark, d, "events"), "value", by=["event_type"]).select("event_type", "bin", "count", "density"), 8)


_KDE = """r AS (SELECT event_type AS g, value AS x FROM events), e AS (SELECT min(x) AS lo, max(x) AS hi FROM r),
s AS (SELECT g, count(*) AS n, CASE WHEN quantile_cont(x, 0.75) > quantile_cont(x, 0.25) THEN least(stddev_samp(x), (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.34) ELSE stddev_samp(x) END AS s FROM r GROUP BY g),
b AS (SELECT g, n, 0.9 * s * pow(n, -0.2) AS h FROM s), c AS (SELECT g, least(floor((x - lo) / ((hi - lo) / 2048)), 2047) AS cell, lo, hi, count(*) AS k FROM r, e GROUP BY ALL),
m AS (SELECT g, lo + (cell + 0.5) * ((hi - lo) / 2048) AS mid, lo, hi, k FROM c),
v AS (SELECT m.g, lo + i * (hi - lo) / 511 AS x, sum(k * exp(-0.5 * ((lo + i * (hi - lo) / 511 - mid) / h) ** 2) / (n * h * sqrt(2 * pi()))) AS density FROM m JOIN b USING (g), range(512) t(i) GROUP BY ALL)"""


@register("c03_density", f"WITH {_KDE} SELECT g AS event_type, round(x, 6) AS x, round(density, 8) AS density FROM v")
def _(spark, d):
    return rounded(charts.density(table(spark, d, "events"), "value", ["event_type"]), x=6, density=8)


@register("c03_violin", f"WITH {_KDE} SELECT g AS event_type, count(*) AS n, round(max(density / w), 6) AS widest, round(avg(density / w), 6) AS mean FROM (SELECT *, max(density) OVER () AS w FROM v) GROUP BY 1")
def _(spark, d):
    v = charts.violin(table(spark, d, "events"), "value", ["event_type"])
    return rounded(v.groupBy("event_type").agg(F.count("*").alias("n"), F.max("width").alias("widest"), F.avg("width").alias("mean")))


_BOX = "q AS (SELECT event_type AS g, quantile_cont(value, 0.25) AS q1, median(value) AS med, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)"


@register("c04_box_stats", f"WITH {_BOX} SELECT event_type, 'value' AS \"column\", count(*) AS n, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3, round(min(value) FILTER (value >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low, round(max(value) FILTER (value <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high, count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers, round(med - 1.58 * (q3 - q1) / sqrt(count(*)), 6) AS notch_low, round(med + 1.58 * (q3 - q1) / sqrt(count(*)), 6) AS notch_high FROM events JOIN q ON g = event_type GROUP BY event_type, q1, med, q3")
def _(spark, d):
    return rounded(charts.box_stats(table(spark, d, "events"), ["value"], ["event_type"]))


@register("c04_box_outliers", f"WITH {_BOX} SELECT event_id, event_type FROM events JOIN q ON g = event_type WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)")
def _(spark, d):
    return charts.box_outliers(table(spark, d, "events"), "value", ["event_type"]).select("event_id", "event_type")


@register("c05_scatter", "{base} SELECT l_orderkey, x, y, series FROM (SELECT l_orderkey, disc_null AS x, tax_null AS y, 'tax_null' AS series FROM t UNION ALL SELECT l_orderkey, disc_null, l_quantity, 'l_quantity' FROM t) WHERE x IS NOT NULL AND y IS NOT NULL")
def _(spark, d):
    return charts.scatter(comp(spark, d), ["disc_null", "tax_null", "l_quantity"], ["l_orderkey"])


@register("c06_linear_trend", "SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(sqrt((regr_syy(l_extendedprice, l_quantity) - regr_slope(l_extendedprice, l_quantity) * regr_sxy(l_extendedprice, l_quantity)) / (count(*) - 2)), 3) AS residual_se FROM lineitem GROUP BY 1")
def _(spark, d):
    return rounded(stats.linear_trend(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]), slope=4, intercept=4, residual_se=3)


@register("c07_loess", """
WITH r AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem), e AS (SELECT min(x) AS lo, max(x) AS hi, floor(0.75 * count(*) + 1e-9)::BIGINT AS k FROM r),
g AS (SELECT lo + (hi - lo) * i / 79 AS g, k FROM e, range(80) AS t(i)), c AS (SELECT g, k, abs(x - g) AS d, count(*) AS n FROM g, r GROUP BY ALL),
h AS (SELECT g, min(d) AS h FROM (SELECT g, k, d, sum(n) OVER (PARTITION BY g ORDER BY d) AS upto FROM c) WHERE upto >= k GROUP BY g),
w AS (SELECT g, (x - g) / h AS u, y, pow(1 - pow(abs((x - g) / h), 3), 3) AS w FROM h, r WHERE abs(x - g) < h),
m AS (SELECT g, sum(w) AS a, sum(w * u) AS b, sum(w * u * u) AS c, sum(w * u * u * u) AS d, sum(w * u * u * u * u) AS e, sum(w * y) AS p, sum(w * u * y) AS q, sum(w * u * u * y) AS s FROM w GROUP BY g)
SELECT round(g, 6) AS x, round((p * (c * e - d * d) - b * (q * e - d * s) + c * (q * d - c * s)) / (a * (c * e - d * d) - b * (b * e - d * c) + c * (b * d - c * c)), 4) AS fit FROM m""")
def _(spark, d):
    return rounded(stats.loess(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"), fit=4)


@register("c08_connected", "SELECT o_orderstatus, row_number() OVER w::INT AS place, o_totalprice AS x, o_custkey::DOUBLE AS y, lead(o_totalprice) OVER w AS next_x, lead(o_custkey::DOUBLE) OVER w AS next_y FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey)")
def _(spark, d):
    return charts.connected(table(spark, d, "orders"), "o_totalprice", "o_custkey", "o_orderkey", ["o_orderstatus"])


@register("c09_bar", "SELECT p_type AS category, count(*) AS count FROM part GROUP BY 1")
def _(spark, d):
    return charts.bar(table(spark, d, "part"), "p_type")


@register("c10_bar_percent", "SELECT l_returnflag AS x, l_linestatus AS fill, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 6)::DOUBLE AS percent FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    return rounded(charts.bar_percent(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus"))


_STACK = "{base}, s AS (" + " UNION ALL ".join(f"SELECT l_returnflag AS x, '{n}' AS variable, sum({n}) AS total FROM t GROUP BY 1" for n in ("l_quantity", "disc_amt", "tax_amt", "base")) + ")"


@register("c11_stacked", _STACK + " SELECT x, variable, round(total, 2) AS total FROM s")
def _(spark, d):
    return rounded(charts.stacked(comp(spark, d), "l_returnflag", ["l_quantity", "disc_amt", "tax_amt", "base"]).select("x", "variable", "total"), 2)


@register("c12_stacked_percent", _STACK + " SELECT x, variable, round(total / sum(total) OVER (PARTITION BY x), 6) AS share FROM s")
def _(spark, d):
    return rounded(charts.stacked(comp(spark, d), "l_returnflag", ["l_quantity", "disc_amt", "tax_amt", "base"]).select("x", "variable", "share"))


@register("c13_scatter_matrix", "{base} " + " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, count(*) AS n, round(corr({a}, {b}), 6) AS r, round(regr_slope({b}, {a}), 8) AS slope, round(regr_intercept({b}, {a}), 4) AS intercept FROM t" for a in _COR for b in _COR if a != b))
def _(spark, d):
    return rounded(stats.pair_trends(comp(spark, d), _COR), slope=8, intercept=4)


def _over(n: str, t: str = "t") -> str:
    return f"SELECT '{n}' AS \"column\", bin, round(lo + bin * w, 4) AS low, round(lo + (bin + 1) * w, 4) AS high, count(*) AS count FROM (SELECT least(floor(({n} - lo) / w), k - 1)::INT AS bin, lo, w FROM {t}, (SELECT *, (hi - lo) / k AS w FROM (SELECT min({n}) AS lo, max({n}) AS hi, ceil(log2(count({n}))) + 1 AS k FROM {t})) WHERE {n} IS NOT NULL) GROUP BY bin, lo, w"


@register("c14_overview", "{base} " + " UNION ALL ".join(_over(n) for n in ("disc_amt", "tax_amt", "disc_null")))
def _(spark, d):
    return rounded(charts.overview(comp(spark, d), ["disc_amt", "tax_amt", "disc_null"]), 4)


@register("c15_heatmap", "{base} " + " UNION ALL ".join(f"SELECT '{a}' AS var1, '{b}' AS var2, round(corr({a}, {b}), 6) AS r FROM t" for i, a in enumerate(_COR) for b in _COR[i + 1:]))
def _(spark, d):
    return rounded(charts.heatmap(comp(spark, d), _COR))


@register("c16_build_chart", "SELECT l_returnflag AS x, l_linestatus AS fill, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 6)::DOUBLE AS percent FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    return rounded(charts.build_chart(table(spark, d, "lineitem"), {"type": "bar", "x": "l_returnflag", "color_by": "l_linestatus", "percent": True}))


# ---- samples, functions, sets --------------------------------------------------------------------------------

@register("u01_sample_report", "SELECT count(*) AS rows, least(count(*), 1000) AS kept, count(*) > 1000 AS sampled FROM events")
def _(spark, d):
    return sampling.sample_report(table(spark, d, "events"), 1000).select("rows", F.col("kept").cast("long").alias("kept"), "sampled")


@register("u01_bounded_sample")
def _(spark, d):
    return sampling.bounded_sample(table(spark, d, "events").select("event_id", "value"), ["event_id"], 1000)


@register("u02_map_chunks", "SELECT event_id, round(value * 2, 6) AS doubled FROM events")
def _(spark, d):
    return rounded(sampling.map_chunks(table(spark, d, "events").select("event_id", "value"), lambda p: p.assign(doubled=p.value * 2)[["event_id", "doubled"]], "event_id long, doubled double"))


@register("u03_skip_failures", "SELECT event_id, NULL::VARCHAR AS __failed FROM events")
def _(spark, d):
    return sampling.map_chunks(table(spark, d, "events").select("event_id"), lambda p: p, "event_id long", skip_failures=True)


@register("u04_map_groups", "SELECT n_regionkey AS region, count(*) AS n FROM nation GROUP BY 1")
def _(spark, d):
    t = table(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("region"))
    return sampling.map_groups(t, ["region"], lambda p: p.groupby("region").size().reset_index(name="n"), "region long, n long").select(F.col("region").cast(dict(table(spark, d, "nation").dtypes)["n_regionkey"]).alias("region"), "n")


@register("u05_top_groups", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
def _(spark, d):
    return sampling.top_groups(table(spark, d, "events"), "user_id")


@register("u06_partition_sum", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS total FROM orders")
def _(spark, d):
    return rounded(sampling.partition_sum(table(spark, d, "orders"), "o_totalprice", ["o_custkey"]).select("o_orderkey", "total"), 2)


@register("u07_union_distinct", "SELECT DISTINCT nation FROM (SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier)")
def _(spark, d):
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"))
    return files.union_common([("a", a), ("b", table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")))]).select("nation").distinct()


# ---- jobs ----------------------------------------------------------------------------------------------------

_W1 = f"""{{base}}, f AS (SELECT * FROM t WHERE l_quantity > 5), b AS (SELECT quantile_cont(disc_amt, 0.25) AS a1, quantile_cont(disc_amt, 0.75) AS a3, quantile_cont(tax_amt, 0.25) AS b1, quantile_cont(tax_amt, 0.75) AS b3 FROM f),
g AS (SELECT *, disc_amt / (disc_amt + tax_amt + qty_c + base) AS a, tax_amt / (disc_amt + tax_amt + qty_c + base) AS b_, (qty_c + base) / (disc_amt + tax_amt + qty_c + base) AS c FROM f, b WHERE NOT ({_HIGH['iqr'][1]}) AND disc_amt + tax_amt + qty_c + base > 0),
q AS (SELECT quantile_cont(disc_amt, 0.2) AS q1, quantile_cont(disc_amt, 0.4) AS q2, quantile_cont(disc_amt, 0.6) AS q3, quantile_cont(disc_amt, 0.8) AS q4 FROM g)
SELECT l_returnflag, {_bin('disc_amt')} AS bin, count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b_), 6) AS mean_b, round(avg(c), 6) AS mean_c FROM g, q GROUP BY 1, 2"""


@register("w01_ternary_points", _W1)
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Filter, drop outliers, coordinates, quintile bins, and the mean point of each group and bin."""
    s = jobs.Settings(Element(["disc_amt"]), Element(["tax_amt"]), Element(["qty_c", "base"]), methods=["iqr"], method_columns=AMOUNTS)
    rows = filters.apply_filter(comp(spark, d), "l_quantity", "> 5")
    points = ternary.quintile_types(jobs.ternary_points(rows, s), "disc_amt")
    return rounded(points.groupBy("l_returnflag", "bin").agg(F.count("*").alias("n"), F.avg("A").alias("mean_a"), F.avg("B").alias("mean_b"), F.avg("C").alias("mean_c")))


@register("w02_comprehensive_analysis", _SUM.replace("disc_amt, tax_amt", "disc_amt, tax_amt"))
def _(spark, d):
    first, second = halves(spark, d)
    return rounded(jobs.comprehensive_analysis(first.select(*AMOUNTS), second.select(*AMOUNTS), forest=False)["mahalanobis"], 4)


@register("w03_quick_analysis", "{base}, f AS (SELECT * FROM t WHERE l_linestatus = 'F') " + _each(AMOUNTS, "round(avg(x), 4) AS mean, round(median(x), 4) AS median, round(stddev_samp(x), 4) AS sd", "f"))
def _(spark, d):
    first, second = halves(spark, d)
    return rounded(jobs.quick_analysis(first.select(*AMOUNTS), second.select(*AMOUNTS))["statistics1"], 4)


@register("w04_batch_status", "{base}, b AS (SELECT l_returnflag AS g, quantile_cont(disc_amt, 0.75) + 1.5 * (quantile_cont(disc_amt, 0.75) - quantile_cont(disc_amt, 0.25)) AS h1, quantile_cont(tax_amt, 0.75) + 1.5 * (quantile_cont(tax_amt, 0.75) - quantile_cont(tax_amt, 0.25)) AS h2 FROM t GROUP BY 1) SELECT l_returnflag AS file, count(*) AS rows, count(*) FILTER (disc_amt <= h1 AND tax_amt <= h2) AS points, 'ok' AS status FROM t JOIN b ON g = l_returnflag GROUP BY 1")
def _(spark, d):
    return jobs.batch_ternary(comp(spark, d), jobs.Settings(*AXES, methods=["iqr"], method_columns=AMOUNTS), "l_returnflag")[1]


@register("w04_failing_files", "{base}, b AS (SELECT l_returnflag AS g, quantile_cont(disc_amt, 0.75) + 1.5 * (quantile_cont(disc_amt, 0.75) - quantile_cont(disc_amt, 0.25)) AS h1, quantile_cont(tax_amt, 0.75) + 1.5 * (quantile_cont(tax_amt, 0.75) - quantile_cont(tax_amt, 0.25)) AS h2 FROM t GROUP BY 1) SELECT l_returnflag AS file, count(*) AS rows, count(*) FILTER (disc_amt <= h1 AND tax_amt <= h2) AS points, 'ok' AS status FROM t JOIN b ON g = l_returnflag GROUP BY 1 UNION ALL SELECT 'columnless', 0, 0, 'failed: no column tax_amt' UNION ALL SELECT 'broken', 0, 0, 'failed: unreadable' UNION ALL SELECT 'garbled', 0, 0, 'failed: no column disc_amt, tax_amt, qty_c, base'")
def _(spark, d):
    t, folder = comp(spark, d).select("l_returnflag", *AMOUNTS, "qty_c", "base"), _folder(spark)
    paths = []
    for flag, kind in (("A", "parquet"), ("N", "csv"), ("R", "csv")):
        paths.append(f"{folder}/{flag}.{kind}")
        files.write_table(t.where(F.col("l_returnflag") == flag).drop("l_returnflag"), paths[-1], kind)
    paths += [f"{folder}/columnless.csv", f"{folder}/broken.parquet", f"{folder}/garbled.csv"]
    files.write_table(t.drop("tax_amt"), paths[3], "csv")
    for path in paths[4:]:
        table(spark, d, "region").select("r_name").write.text(path)
    return jobs.batch_files(spark, paths, jobs.Settings(*AXES, methods=["iqr"], method_columns=AMOUNTS))[1]


@register("w05_compare_datasets", f"WITH {_ORD} SELECT 'p' AS \"column\", round(corr(a.p, b.p), 6) AS r, count(*) AS n FROM a JOIN b USING (k)")
def _(spark, d):
    return rounded(jobs.compare_job(*_shifted(spark, d), ["k"])["paired"])


@register("w06_hex_ternary", f"{{base}}, h AS ({_HEXSQL}) SELECT panel, {_PLACE} FROM h WHERE \"A\" > 0 AND \"B\" > 0 AND \"C\" > 0 GROUP BY 1")
def _(spark, d):
    return rounded(jobs.hex_ternary(comp(spark, d), _HEX, ["l_orderkey"]).groupBy("panel").agg(F.avg("x").alias("x"), F.avg("y").alias("y")))


@register("m04_singular_covariance", f"""{{base}}, c AS (SELECT avg(base) AS m, var_samp(base) AS v FROM t), k AS (SELECT m, v + {mahalanobis.RIDGE} AS a, 2 * v AS b, 4 * v + {mahalanobis.RIDGE} AS c, {mahalanobis.RIDGE} * (5 * v + {mahalanobis.RIDGE}) AS det FROM c)
SELECT l_returnflag, count(*) AS n, round(avg((base - m) * (base - m) * (c - 4 * b + 4 * a) / det), 2) AS md2 FROM t, k GROUP BY 1""")
def _(spark, d):
    t = comp(spark, d).select("l_returnflag", "base", (F.col("base") * 2).alias("twice"))
    return rounded(mahalanobis.with_distance(t, ["base", "twice"]).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg("md2").alias("md2")), 2)


@register("quantiles_by_file", "{base} " + " UNION ALL ".join(f"SELECT l_returnflag, '{n}' AS \"column\", {p}::DOUBLE AS prob, round(quantile_cont({n}, {p}), 6) AS value FROM t GROUP BY 1" for n in AMOUNTS for p in (0.1, 0.5, 0.99)))
def _(spark, d):
    return rounded(exact_quantiles(comp(spark, d), AMOUNTS, [0.1, 0.5, 0.99], ["l_returnflag"], direct_rows=0), value=6)


@register("gram_correlation", "{base} " + " UNION ALL ".join(f"SELECT '{a}' AS var1, '{b}' AS var2, round(covar_samp({a}, {b}), 2) AS cov FROM t" for a in _COR for b in _COR))
def _(spark, d):
    _, _, cov = moments._gram(comp(spark, d), _COR)
    return rounded(spark.createDataFrame([(a, b, float(cov[i, j])) for i, a in enumerate(_COR) for j, b in enumerate(_COR)], "var1 string, var2 string, cov double"), 2)


# ---- writing, names, checks and every table of the jobs --------------------------------------------------------

def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share: under ``spark.checkpoint.dir``, on a single machine a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared or tempfile.gettempdir()}/ternspark-{uuid.uuid4().hex}"


@register("s05_write_table", "SELECT 'csv' AS kind, s_nationkey, s_suppkey, s_name FROM supplier UNION ALL SELECT 'parquet', s_nationkey, s_suppkey, s_name FROM supplier UNION ALL SELECT 'json', s_nationkey, s_suppkey, s_name FROM supplier UNION ALL SELECT 'orc', s_nationkey, s_suppkey, s_name FROM supplier")
def _(spark, d):
    t, out = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_name"), None
    for kind in ("csv", "parquet", "json", "orc"):
        path = f"{_folder(spark)}.{kind}"
        files.write_table(t, path, kind)
        back = files.read_table(spark, path).select(F.lit(kind).alias("kind"), *[F.col(n).cast(k).alias(n) for n, k in t.dtypes])
        out = back if out is None else out.union(back)
    return out


@register("s06_export_tables", "SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'empty', 1 UNION ALL SELECT 'region x', count(*) FROM region")
def _(spark, d):
    tables = {"nation": table(spark, d, "nation"), "empty": table(spark, d, "nation").where("n_nationkey < 0"), "region x": table(spark, d, "region")}
    out = None
    for name, path in zip(tables, files.export_tables(tables, _folder(spark), spark), strict=True):
        part = spark.read.parquet(path).agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = part if out is None else out.union(part)
    return out


@register("n01_clean_names", "SELECT round(sum(l_tax), 4) AS \"SiO2\", round(sum(l_discount), 4) AS \"Al2O3\", count(*) AS n FROM lineitem")
def _(spark, d):
    t = cols.rename_clean(table(spark, d, "lineitem").select(F.col("l_tax").alias("SiO2.(Wt%)"), F.col("l_discount").alias("Al2O3.(Wt%)")))
    return rounded(t.agg(F.sum("SiO2").alias("SiO2"), F.sum("Al2O3").alias("Al2O3"), F.count("*").alias("n")), 4)


@register("n02_safe_names", "SELECT o_orderstatus AS order_status, round(sum(o_totalprice), 2) AS total_price FROM orders GROUP BY 1")
def _(spark, d):
    t = cols.rename_safe(table(spark, d, "orders").select(F.col("o_orderstatus").alias("order status"), F.col("o_totalprice").alias("total price")))
    return rounded(t.groupBy("order_status").agg(F.sum("total_price").alias("total_price")), 2)


@register("n03_categorical_columns", "SELECT \"column\" FROM (SELECT 'o_orderdate' AS \"column\", count(DISTINCT o_orderdate) AS k FROM orders UNION ALL SELECT 'year', count(DISTINCT date_trunc('year', o_orderdate)) FROM orders) WHERE k <= 50 UNION ALL SELECT 'o_orderstatus' FROM orders GROUP BY 1")
def _(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.trunc("o_orderdate", "year").alias("year"), "o_orderstatus")
    return spark.range(1).select(F.explode(F.array(*map(F.lit, cols.categorical_columns(t)))).alias("column"))


@register("f13_pick_method", ORACLE["f11_iqr_drop"])
def _(spark, d):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        method = outliers.pick_method(["mad", "zscore", "iqr"])  # of several the first rule wins
    return QUERIES[f"f11_{method}_drop"](spark, d)


@register("m01_checked_distances", ORACLE["m06_distance_summary"])
def _(spark, d):
    for names, lam in ((["disc_amt"], 1.0), (AMOUNTS, -1.0)):
        try:
            mahalanobis.check_inputs(names, lam)
        except ValueError:
            continue
        raise AssertionError("bad inputs were let through")
    mahalanobis.check_inputs(AMOUNTS)
    return QUERIES["m06_distance_summary"](spark, d)


def _halved(sql: str) -> str:
    return "{base}, f AS (SELECT * FROM t WHERE l_linestatus = 'F'), o AS (SELECT * FROM t WHERE l_linestatus = 'O') " + sql


_DESCRIBE = "round(avg(x), 4) AS mean, round(median(x), 4) AS median, round(stddev_samp(x), 4) AS sd"
_TRIPLE = ["disc_amt", "tax_amt", "l_quantity"]


def _both(kind: str, spark, d) -> DataFrame:
    """The tables that the whole job makes of this kind, one for each dataset."""
    first, second = (h.select(*_TRIPLE) for h in halves(spark, d))
    made = jobs.comprehensive_analysis(first, second, forest=False)
    return rounded(made[f"{kind}1"].withColumn("dataset", F.lit(1)).unionByName(made[f"{kind}2"].withColumn("dataset", F.lit(2))), 4)


@register("w02_statistics", _halved("SELECT 1 AS dataset, * FROM (" + _each(_TRIPLE, _DESCRIBE, "f") + ") UNION ALL SELECT 2, * FROM (" + _each(_TRIPLE, _DESCRIBE, "o") + ")"))
def _(spark, d):
    return _both("statistics", spark, d)


@register("w02_correlations", _halved("SELECT 1 AS dataset, * FROM (" + _corr(_TRIPLE, "f").replace(", 6) AS r", ", 4) AS r") + ") UNION ALL SELECT 2, * FROM (" + _corr(_TRIPLE, "o").replace(", 6) AS r", ", 4) AS r") + ")"))
def _(spark, d):
    return _both("correlation", spark, d)


@register("w03_statistics2", _halved(_each(AMOUNTS, _DESCRIBE, "o")))
def _(spark, d):
    first, second = halves(spark, d)
    return rounded(jobs.quick_analysis(first.select(*AMOUNTS), second.select(*AMOUNTS))["statistics2"], 4)


@register("w05_correlation_difference", ORACLE["a09_correlation_difference"])
def _(spark, d):
    first, second = halves(spark, d)
    return rounded(jobs.compare_job(first.select(*_COR), second.select(*_COR))["correlation_difference"], difference=4)


@register("a13_correlations", "{base} " + _corr(_COR, "t"))
def _(spark, d):
    return rounded(jobs.analyze_data(comp(spark, d), [*_COR, "not_there"])["correlations"])


# ---- every table of the jobs, one under the other ---------------------------------------------------------------

#: What names a row of each table of the jobs; all other columns are numbers.
_KEYS = {
    "quality": ["column"], "correlations": ["var1", "var2"], "high_correlations": ["var1", "var2"], "distributions": ["column"], "scores": ["grade"], "score": ["grade"], "quality_summary": ["metric"],
    "heatmap": ["var1", "var2"], "overview": ["column", "bin"], "statistics": ["column"], "correlation": ["var1", "var2"], "mahalanobis": ["metric"], "consistency": ["column"],
    "normality": ["column", "status"], "duplicates": [], "empty": ["column"], "comparison": ["metric", "value"], "issues": ["severity", "check", "column"],
}


def _row_names(name: str, columns: list[str]) -> list[str]:
    return [*_KEYS.get(name.rstrip("12"), _KEYS.get(name, [])), *(["dataset"] if "dataset" in columns else [])]


def _melted(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, key, metric, value): the numbers of all tables, rounded."""
    out = None
    for name, t in tables.items():
        keys = _row_names(name, t.columns)
        values = [F.struct(F.lit(n).alias("metric"), F.round(cols.c(n).cast("double"), 4).alias("value")) for n in t.columns if n not in keys] or [F.struct(F.lit("row").alias("metric"), F.lit(1.0).alias("value"))]
        part = t.select(F.lit(name).alias("table"), F.concat_ws("/", *[cols.c(k).cast("string") for k in keys], F.lit("")).alias("key"), F.inline(F.array(*values)))
        out = part if out is None else out.unionByName(part)
    return out


def _melt(name: str, sql: str, values: list[str], dataset: bool = False) -> str:
    keys = _row_names(name, ["dataset"] if dataset else [])
    key = ", ".join([*[f'"{k}"::VARCHAR' for k in keys], "''"])
    numbers = ", ".join(f'round("{v}"::DOUBLE, 4)' for v in values) if values else "1.0::DOUBLE"
    return f"SELECT '{name}' AS \"table\", concat_ws('/', {key}) AS key, unnest([{', '.join(repr(v) for v in values or ['row'])}]) AS metric, unnest([{numbers}]) AS value FROM ({sql})"


def _datasets(sql: Callable[[str], str]) -> str:
    return f"SELECT *, 'Dataset 1' AS dataset FROM ({sql('f')}) UNION ALL SELECT *, 'Dataset 2' FROM ({sql('o')})"


def _score_sql(t: str) -> str:
    return (f"SELECT score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM (SELECT round_even(100 - 100.0 * sum(missing) / sum(rows) - 100.0 * sum(infinite) / sum(rows)"
            f" - 50.0 * count(*) FILTER (zero_variance) / count(*) - least(20.0 * sum(outliers) / sum(rows), 30), 1)::DOUBLE AS score FROM ({_qual(t, AMOUNTS)}))")


def _shape_sql(t: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS \"column\", any_value(m) AS mean, median(x) AS median, stddev_samp(x) AS sd, avg((x - m) ** 3) / avg((x - m) ** 2) ** 1.5 AS skewness, avg((x - m) ** 4) / avg((x - m) ** 2) ** 2 AS kurtosis, count(*) AS n FROM (SELECT {n} AS x, avg({n}) OVER () AS m FROM {t})" for n in AMOUNTS)


def _pairs_sql(t: str) -> str:
    return _corr(AMOUNTS, t)


_QUALITY_VALUES = ["rows", "missing", "infinite", "zero_variance", "outliers"]
_QUALITY_TABLES = [
    _melt("quality", _datasets(lambda t: _qual(t, AMOUNTS)), _QUALITY_VALUES, True), _melt("correlations", _datasets(_pairs_sql), ["r", "n"], True),
    _melt("high_correlations", "SELECT * FROM (" + _datasets(_pairs_sql) + ") WHERE var1 <> var2 AND abs(r) > 0.9", ["r", "n"], True),
    _melt("distributions", _datasets(_shape_sql), ["mean", "median", "sd", "skewness", "kurtosis"], True), _melt("scores", _datasets(_score_sql), ["score"], True),
]
_STATISTICS = {k: _melt(f"statistics{k}", _each(AMOUNTS, "avg(x) AS mean, median(x) AS median, stddev_samp(x) AS sd", t), ["mean", "median", "sd"]) for k, t in (("1", "f"), ("2", "o"))}


def _amounts(spark, d) -> list[DataFrame]:
    return [h.select(*AMOUNTS) for h in halves(spark, d)]


@register("w03_every_table", _halved(" UNION ALL ".join([*_QUALITY_TABLES, *_STATISTICS.values()])))
def _(spark, d):
    return _melted(jobs.quick_analysis(*_amounts(spark, d)))


_CHARTS = [x for k, t in (("1", "f"), ("2", "o")) for x in (
    _melt(f"heatmap{k}", f"SELECT 'disc_amt' AS var1, 'tax_amt' AS var2, corr(disc_amt, tax_amt) AS r FROM {t}", ["r"]),
    _melt(f"overview{k}", " UNION ALL ".join(_over(n, t) for n in AMOUNTS), ["low", "high", "count"]), _melt(f"correlation{k}", _pairs_sql(t), ["r", "n"]))]
_DISTANCE = _SUM[_SUM.index("SELECT metric, round("):].replace("round(value, 4)", "value")


@register("w02_every_table", _SUM[: _SUM.index("SELECT metric, round(")] + " UNION ALL ".join([
    *_QUALITY_TABLES, *_STATISTICS.values(), *_CHARTS, _melt("mahalanobis", _DISTANCE, ["value"]),
    _melt("quality_summary", f"SELECT a.metric, a.v AS \"Dataset 1\", b.v AS \"Dataset 2\" FROM ({_totals('f', AMOUNTS)}) a JOIN ({_totals('o', AMOUNTS)}) b USING (metric)", ["Dataset 1", "Dataset 2"]),
    _melt("isolation_forest", "SELECT count(*) AS points FROM f", ["points"])]))
def _(spark, d):
    first, second = _amounts(spark, d)
    made = jobs.comprehensive_analysis(first, second)
    # which rows a forest of random trees flags, SQL can't state; tests hold it against planted rows
    return _melted(made | {"isolation_forest": made["isolation_forest"].select("points")})


@register("a13_every_table", _halved(" UNION ALL ".join([
    _melt("statistics", _each(AMOUNTS, "avg(x) AS mean, median(x) AS median, stddev_samp(x) AS sd"), ["mean", "median", "sd"]), _melt("correlations", _pairs_sql("t"), ["r", "n"]),
    _melt("issues", "SELECT 'warning' AS severity, 'zero variance' AS \"check\", 'flat' AS \"column\" FROM (SELECT min(l_quantity * 0) AS a, max(l_quantity * 0) AS b FROM t) WHERE a = b", []),
    _melt("quality", _qual("(SELECT *, l_quantity * 0 AS flat FROM t)", [*AMOUNTS, "flat"]), _QUALITY_VALUES),
    _melt("score", _score_sql("t").replace(_qual("t", AMOUNTS), _qual("(SELECT *, l_quantity * 0 AS flat FROM t)", [*AMOUNTS, "flat"])), ["score"])])))
def _(spark, d):
    made = jobs.analyze_data(comp(spark, d).withColumn("flat", F.col("l_quantity") * 0), [*AMOUNTS, "flat", "not_there"])
    return _melted({k: t.where("column <> 'flat'") if k == "statistics" else t.where("var1 <> 'flat' and var2 <> 'flat'") if k == "correlations" else t for k, t in made.items()})


@register("q17_every_table", _halved(" UNION ALL ".join([*_QUALITY_TABLES, *[x for k, t in (("1", "f"), ("2", "o")) for x in (
    _melt(f"consistency{k}", _each(AMOUNTS, "min(x) AS min, max(x) AS max, max(x) - min(x) AS range, 100.0 * count(*) FILTER (x IS NULL) / count(*) AS missing_percent", t), ["min", "max", "range", "missing_percent"]),
    _melt(f"normality{k}", f"SELECT \"column\", CASE WHEN n > 5000 THEN 'too many values' ELSE 'ok' END AS status, n, n / 6 * (skewness * skewness + (kurtosis - 3) * (kurtosis - 3) / 4) AS jarque_bera FROM ({_shape_sql(t)})", ["n", "jarque_bera"]),
    _melt(f"duplicates{k}", f"SELECT sum(n) AS rows, sum(n - 1) AS duplicates, round_even(100.0 * sum(n - 1) / sum(n), 2) AS percent FROM (SELECT count(*) AS n FROM {t} GROUP BY disc_amt, tax_amt)", ["rows", "duplicates", "percent"]),
    _melt(f"empty{k}", _each(AMOUNTS, "bool_and(x IS NULL OR x = 0) AS empty, coalesce(min(x) = max(x), true) AS constant", t), ["empty", "constant"]))],
    _melt("comparison", "SELECT unnest(['rows1', 'rows2', 'columns1', 'columns2', 'common', 'only1', 'only2', 'overlap_percent', 'types_match']) AS metric, unnest([(SELECT count(*)::VARCHAR FROM f), (SELECT count(*)::VARCHAR FROM o), '2', '2', '2', '', '', '100.0', 'true']) AS value", [])])))
def _(spark, d):
    made = quality.comprehensive(*_amounts(spark, d))
    return _melted({k: t.select("column", "status", "n", "jarque_bera") if k.startswith("normality") else t for k, t in made.items()})
