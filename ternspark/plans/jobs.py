"""Whole jobs: filter, find outliers, compute, summarise, export."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cols import c, common_numeric, numeric_columns, require
from ..functions.moments import correlation_table
from ..operators import charts, iforest, mahalanobis, outliers, quality, stats, ternary
from ..operators.filters import Element, filter_elements, filter_optional
from ..sources.files import export_tables, scan_files


@dataclass(frozen=True)
class Settings:
    """What a ternary run does; the defaults filter nothing."""

    a: Element
    b: Element
    c: Element
    size_by: Sequence[str] = ()
    size_filter: str | None = None
    colour_by: str | None = None
    colour_filter: str | None = None
    methods: Sequence[str] = ()
    method_columns: Sequence[str] = ()
    keep_outliers: bool = False
    reference: str | None = "self"
    lam: float = 1.0
    omega: float = 0.0
    options: Mapping = field(default_factory=dict)


def filtered(df: DataFrame, s: Settings, first: DataFrame | None = None, second: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """The filter chain on the full-width table: element filters, optional filters, one outlier method.

    Statistics see the rows after the element filters; a distance to "self" means to those. With ``by`` every
    group has its own statistics.
    """
    rows = filter_elements(df, [s.a, s.b, s.c])
    rows = filter_optional(rows, s.size_by, s.size_filter) if s.size_by else rows
    rows = filter_optional(rows, [s.colour_by], s.colour_filter) if s.colour_by else rows
    method = outliers.pick_method(s.methods)
    if method is None:
        return rows
    names = list(s.method_columns)
    if method == "mahalanobis":
        if by:
            marked = mahalanobis.by_group(rows, names, by, s.lam, s.omega, "__md2", "__flag").where("__md2 is not null")
            return marked.where(F.col("__flag") if s.keep_outliers else ~F.col("__flag")).drop("__md2", "__flag")
        ref = mahalanobis.reference_of(s.reference, rows, first, second)
        return rows if ref is None else mahalanobis.mahalanobis_filter(rows, names, s.keep_outliers, ref, lam=s.lam, omega=s.omega)
    if method == "isolation_forest":
        if by:
            marked = iforest.isolation_forest_by(rows, names, by, out="__if", flag="__flag", **s.options)
            return marked.where(F.col("__flag") if s.keep_outliers else ~F.col("__flag")).drop("__if", "__flag")
        ref = mahalanobis.reference_of(s.reference, rows, first, second)
        if ref is None:
            return rows
        marked = iforest.isolation_forest(rows, ref, names, out="__if", flag="__flag", **s.options)
        return marked.where(F.col("__flag") if s.keep_outliers else ~F.col("__flag")).drop("__if", "__flag")
    return outliers.pipeline_filter(rows, names, method, s.keep_outliers, [by] if by else [])


def ternary_points(df: DataFrame, s: Settings, first: DataFrame | None = None, second: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """Filtered rows with coordinates A, B, C and styling."""
    require(df, [*s.a.cols, *s.b.cols, *s.c.cols])
    points = ternary.coordinates(filtered(df, s, first, second, by), s.a.cols, s.b.cols, s.c.cols)
    if s.size_by:
        points = ternary.point_sizes(points, s.size_by, by=[by] if by else [])
    if s.colour_by:
        if s.colour_by in numeric_columns(points):
            points = ternary.colour_bins(points, s.colour_by, by=[by] if by else [])
        else:
            points = ternary.colour_rows(points, s.colour_by, by=by)
    return points


def batch_ternary(df: DataFrame, s: Settings, label: str = "file_source") -> tuple[DataFrame, DataFrame]:
    """The same settings for every file of a labelled table, each with its own statistics, in one job; and
    (file, rows, points, status)."""
    points = ternary_points(df, s, by=label)
    rows = df.groupBy(c(label).alias("file")).agg(F.count("*").alias("rows"))
    made = points.groupBy(c(label).alias("__f")).agg(F.count("*").alias("points"))
    status = rows.join(made, F.col("file").eqNullSafe(F.col("__f")), "left").drop("__f")
    status = status.withColumn("points", F.coalesce("points", F.lit(0))).withColumn("status", F.when(F.col("points") > 0, "ok").otherwise("no points"))
    return points, status


def batch_files(spark: SparkSession, paths: Sequence[str], s: Settings, label: str = "file_source") -> tuple[DataFrame, DataFrame]:
    """`batch_ternary` of many files, read together; a file that can't be used is ``failed: ...`` in the status, and the
    others go on."""
    needed = list(dict.fromkeys([*s.a.cols, *s.b.cols, *s.c.cols, *s.method_columns, *s.size_by, *([s.colour_by] if s.colour_by else [])]))
    rows, read = scan_files(spark, paths, needed, label)
    points, made = batch_ternary(rows, s, label)
    status = read.alias("r").join(made.alias("m"), "file", "left").select(
        "file", "r.rows", F.coalesce("points", F.lit(0)).alias("points"), F.when(F.col("r.status") == "ok", F.coalesce("m.status", F.lit("no points"))).otherwise(F.col("r.status")).alias("status"))
    return points, status


def hex_ternary(df: DataFrame, elements: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The six panels of a hexagon with their places."""
    return ternary.place_hexagon(ternary.hexagon(df, elements, keep))


def comprehensive_analysis(first: DataFrame, second: DataFrame, folder: str | None = None, forest: bool = True) -> dict[str, DataFrame]:
    """Quality, chart data, statistics and correlations of two datasets, and distances and a forest on their first
    five common numeric columns; written to a folder if one is given. A multivariate step that fails is left out
    and reported."""
    names = common_numeric(first, second)
    out = quality.check_data_quality(first, second, names)
    out["quality_summary"] = quality.quality_summary(first, second, names, out["quality"])
    for k, d in (("1", first), ("2", second)):
        out |= {f"heatmap{k}": charts.heatmap(d, names), f"overview{k}": charts.overview(d, names), f"statistics{k}": stats.describe(d, names), f"correlation{k}": correlation_table(d, names)}
    some = names[:5]
    spark = first.sparkSession
    try:
        out["mahalanobis"] = mahalanobis.summary(first, some, ref=second)
    except ValueError as e:
        out["mahalanobis"] = spark.createDataFrame([(str(e),)], "message string")
    if forest:
        try:
            marked = iforest.isolation_forest(first, second, some)
            out["isolation_forest"] = marked.agg(F.count("*").alias("points"), F.count_if("is_outlier").alias("outliers"))
        except ValueError as e:
            out["isolation_forest"] = spark.createDataFrame([(str(e),)], "message string")
    if folder:
        export_tables(out, folder, spark)
    return out


def quick_analysis(first: DataFrame, second: DataFrame, folder: str | None = None) -> dict[str, DataFrame]:
    """Quality and statistics of two datasets."""
    names = common_numeric(first, second)
    out = quality.check_data_quality(first, second, names) | {"statistics1": stats.describe(first, names), "statistics2": stats.describe(second, names)}
    if folder:
        export_tables(out, folder, first.sparkSession)
    return out


def compare_job(first: DataFrame, second: DataFrame, key: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Summaries side by side, differences of correlations, and, with a key, paired correlations."""
    names = [n for n in common_numeric(first, second) if n not in (key or ())]
    out = {"summaries": stats.compare_summaries(first, second, names), "correlation_difference": stats.correlation_difference(first, second, names)}
    if key:
        out["paired"] = stats.paired_correlation(first, second, names, key)
        out["paired_summary"] = stats.paired_summary(out["paired"])
    return out


def analyze_data(df: DataFrame, names: Sequence[str]) -> dict[str, DataFrame]:
    """Statistics, correlations, issues and quality of the named columns that exist."""
    use = [n for n in dict.fromkeys(names) if n in numeric_columns(df)]
    columns = quality.column_quality(df, use)
    return {"statistics": stats.describe(df, use), "correlations": correlation_table(df, use), "issues": quality.issues(df, use), "quality": columns, "score": quality.score_of(columns)}
