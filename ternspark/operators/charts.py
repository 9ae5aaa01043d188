"""The data behind charts: binned, summed or summarised on the cluster."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cols import c, log10_positive, num, numeric_columns, require, tidy
from ..functions.moments import correlation_table
from ..functions.quantiles import exact_quantiles
from .outliers import _join_small
from .stats import linear_trend

#: Cells that a density is binned to first, and points of its curve.
CELLS, POINTS = 2048, 512


def histogram(df: DataFrame, name: str, bins: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """(by..., bin, low, high, count, density): equal-width bins over all rows' range, the last one closed.

    ``density`` is count / (values of the group * width). Empty bins give no row; a constant column is one bin
    of width 0 and no density.
    """
    require(df, [name, *by])
    rows = df.select(*map(c, by), num(name).alias("__x")).where("__x is not null")
    ends = rows.agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    at = F.coalesce(F.least(F.floor(F.try_divide(F.col("__x") - F.col("__lo"), width)), F.lit(bins - 1)), F.lit(0)).cast("int")
    binned = rows.crossJoin(F.broadcast(ends)).withColumn("bin", at)  # one row
    counts = binned.groupBy(*map(c, by), "bin", "__lo", "__hi").agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy(*map(c, by)))
    return counts.select(*map(c, by), "bin", (F.col("__lo") + F.col("bin") * width).alias("low"), (F.col("__lo") + (F.col("bin") + 1) * width).alias("high"), "count",
                         F.try_divide(F.col("count"), total * width).alias("density"))


def density(df: DataFrame, name: str, by: Sequence[str] = (), cells: int = CELLS, points: int = POINTS) -> DataFrame:
    """(by..., x, density): a Gaussian kernel density on an even grid over all rows' range, per group.

    Values are binned to ``cells`` first, so the kernel sums run over cells, not rows. The bandwidth of a group
    is 0.9 min(sd, IQR / 1.34) n^-0.2 (the sd alone where the IQR is 0); groups without spread give no rows.
    """
    rows = df.select(*map(c, by), num(name).alias("__x")).where("__x is not null")
    sd = rows.groupBy(*map(c, by)).agg(F.count("*").alias("__n"), F.stddev_samp("__x").alias("__sd"))
    q = exact_quantiles(rows, ["__x"], [0.25, 0.75], by).groupBy(*map(c, by)).agg((F.max("value") - F.min("value")).alias("__iqr"))
    spread = _join_small(sd, q, by) if by else sd.crossJoin(q)
    spread = spread.withColumn("__s", F.when(F.col("__iqr") > 0, F.least(F.col("__sd"), F.col("__iqr") / 1.34)).otherwise(F.col("__sd")))
    spread = spread.where("__s > 0").select(*map(c, by), "__n", (0.9 * F.col("__s") * F.pow(F.col("__n").cast("double"), F.lit(-0.2))).alias("__h"))
    ends = rows.agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    step = (F.col("__hi") - F.col("__lo")) / cells
    cell = F.coalesce(F.least(F.floor(F.try_divide(F.col("__x") - F.col("__lo"), step)), F.lit(cells - 1)), F.lit(0))
    counts = rows.crossJoin(F.broadcast(ends)).withColumn("__cell", cell).groupBy(*map(c, by), "__cell", "__lo", "__hi").agg(F.count("*").alias("__k"))
    counts = counts.withColumn("__mid", F.col("__lo") + (F.col("__cell") + 0.5) * step)
    joined = _join_small(counts, spread, by) if by else counts.crossJoin(F.broadcast(spread))
    grid = F.expr(f"transform(sequence(0, {points - 1}), k -> __lo + k * (__hi - __lo) / {points - 1})")
    z = (F.col("__g") - F.col("__mid")) / F.col("__h")
    parts = joined.where("__h is not null").withColumn("__g", F.explode(grid)).withColumn("__w", F.col("__k") * F.exp(-0.5 * z * z) / (F.col("__n") * F.col("__h") * math.sqrt(2 * math.pi)))
    return parts.groupBy(*map(c, by), F.col("__g").alias("x")).agg(F.sum("__w").alias("density"))


def violin(df: DataFrame, name: str, by: Sequence[str], scale: str = "area", **kw) -> DataFrame:
    """`density` per group with ``width``: relative to the largest density of all groups ("area") or of its own ("width")."""
    if scale not in ("area", "width"):
        raise ValueError("scale is area or width")
    curve = density(df, name, by, **kw)
    window = Window.partitionBy(*map(c, by)) if scale == "width" else Window.partitionBy()
    return curve.withColumn("width", F.col("density") / F.max("density").over(window))  # groups * POINTS rows


def box_stats(df: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, n, q1, median, q3, whisker_low, whisker_high, outliers, notch_low, notch_high).

    Whiskers reach the farthest values within 1.5 interquartile ranges of the box.
    """
    q = exact_quantiles(df, names, [0.25, 0.5, 0.75], by)
    wide = q.groupBy(*map(c, by), "column").agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(k) for k, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])
    values = tidy(df.select(*map(c, by), *[num(n).alias(n) for n in names if n not in by]), by, {n: {"__x": n} for n in names}).where("__x is not null")
    both = _join_small(values, wide, [*by, "column"])
    spread = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("__x") >= F.col("q1") - spread) & (F.col("__x") <= F.col("q3") + spread)
    g = both.groupBy(*map(c, by), "column", "q1", "median", "q3").agg(F.count("*").alias("n"), F.min(F.when(inside, F.col("__x"))).alias("whisker_low"), F.max(F.when(inside, F.col("__x"))).alias("whisker_high"), F.count_if(~inside).alias("outliers"))
    notch = 1.58 * (F.col("q3") - F.col("q1")) / F.sqrt(F.col("n"))
    return g.select(*map(c, by), "column", "n", "q1", "median", "q3", "whisker_low", "whisker_high", "outliers", (F.col("median") - notch).alias("notch_low"), (F.col("median") + notch).alias("notch_high"))


def box_outliers(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """The rows outside the whiskers."""
    boxes = box_stats(df, [name], by).select(*map(c, by), (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("__lo"), (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("__hi"))
    rows = _join_small(df, boxes, by) if by else df.crossJoin(F.broadcast(boxes))
    return rows.where((num(name) < F.col("__lo")) | (num(name) > F.col("__hi"))).drop("__lo", "__hi")


def scatter(df: DataFrame, names: Sequence[str], keep: Sequence[str] = (), log_x: bool = False, log_y: bool = False) -> DataFrame:
    """(keep..., x, y, series): the first column is x, each further one a series; rows without both are left out."""
    require(df, [*names, *keep])
    if len(names) < 2:
        raise ValueError("a scatter takes two columns or more")
    x = log10_positive(names[0]) if log_x else num(names[0])
    series = F.inline(F.array(*[F.struct((log10_positive(n) if log_y else num(n)).alias("y"), F.lit(n).alias("series")) for n in names[1:]]))
    return df.select(*map(c, keep), x.alias("x"), series).where("x is not null and y is not null")


def connected(df: DataFrame, x: str, y: str, key: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., place, x, y, next_x, next_y): points in x order per group, ties by key."""
    rows = df.select(*map(c, by), num(x).alias("x"), num(y).alias("y"), c(key).alias("__key")).where("x is not null and y is not null")
    line = Window.partitionBy(*map(c, by)).orderBy("x", "__key")
    return rows.select(*map(c, by), F.row_number().over(line).alias("place"), "x", "y", F.lead("x").over(line).alias("next_x"), F.lead("y").over(line).alias("next_y"))


def bar(df: DataFrame, x: str) -> DataFrame:
    """(category, count), largest first."""
    return df.groupBy(c(x).alias("category")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "category")


def bar_percent(df: DataFrame, x: str, fill: str) -> DataFrame:
    """(x, fill, count, percent): shares inside each x."""
    counts = df.groupBy(c(x).alias("x"), c(fill).alias("fill")).agg(F.count("*").alias("count"))
    return counts.withColumn("percent", 100.0 * F.col("count") / F.sum("count").over(Window.partitionBy("x")))


def stacked(df: DataFrame, x: str, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., x, variable, total, share): sums of the measures per x, and their share of its total.

    Sums come first and are melted after, so no row is multiplied.
    """
    require(df, [x, *names, *by])
    sums = df.groupBy(*map(c, by), c(x).alias("x")).agg(*[F.sum(num(n)).alias(f"s{i}") for i, n in enumerate(names)])
    long = tidy(sums, [*by, "x"], {n: {"total": f"s{i}"} for i, n in enumerate(names)}, "variable")
    return long.withColumn("share", F.try_divide(F.col("total"), F.sum("total").over(Window.partitionBy(*map(c, by), "x"))))


def overview(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """(column, bin, low, high, count): a histogram of every numeric column with ceil(log2 n) + 1 bins."""
    names = list(names) if names else numeric_columns(df)
    values = tidy(df.select(*[num(n).alias(n) for n in names]), [], {n: {"__x": n} for n in names}).where("__x is not null")
    ends = values.groupBy("column").agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"), (F.ceil(F.log2(F.count("*").cast("double"))) + 1).cast("int").alias("__bins"))
    width = (F.col("__hi") - F.col("__lo")) / F.col("__bins")
    at = F.coalesce(F.least(F.floor(F.try_divide(F.col("__x") - F.col("__lo"), width)), F.col("__bins") - 1), F.lit(0)).cast("int")
    rows = values.join(F.broadcast(ends), "column").withColumn("bin", at)  # a row per column
    counts = rows.groupBy("column", "bin", "__lo", "__hi", "__bins").agg(F.count("*").alias("count"))
    return counts.select("column", "bin", (F.col("__lo") + F.col("bin") * width).alias("low"), (F.col("__lo") + (F.col("bin") + 1) * width).alias("high"), "count")


def heatmap(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """(var1, var2, r) above the diagonal, in the order of the columns."""
    names = list(names) if names else numeric_columns(df)
    place = F.create_map(*[F.lit(x) for k, n in enumerate(names) for x in (n, k)])
    return correlation_table(df, names).where(place[F.col("var1")] < place[F.col("var2")]).select("var1", "var2", "r")


def build_chart(df: DataFrame, spec: Mapping) -> DataFrame:
    """A chart's data from a preset: type, x, y, color_by, log_x, log_y, percent, bins."""
    kind, x, y, by = spec.get("type"), spec.get("x"), spec.get("y"), [spec["color_by"]] if spec.get("color_by") else []
    if kind == "histogram":
        rows = df.withColumn("__v", log10_positive(x)) if spec.get("log_x") else df.withColumn("__v", num(x))
        return histogram(rows, "__v", spec.get("bins", 30), by)
    if kind == "density":
        return density(df, x, by)
    if kind == "violin":
        return violin(df, y or x, by or [x])
    if kind == "boxplot":
        return box_stats(df, [y or x], by or ([x] if y else []))
    if kind == "scatter":
        return scatter(df, [x, y], by, bool(spec.get("log_x")), bool(spec.get("log_y")))
    if kind == "line":
        return connected(df, x, y, spec.get("key", x), by)
    if kind == "trend":
        return linear_trend(df, x, y, by)
    if kind == "bar":
        return bar_percent(df, x, by[0]) if spec.get("percent") and by else bar(df, x)
    if kind == "stacked":
        return stacked(df, x, [y] if isinstance(y, str) else list(y), by)
    raise ValueError(f"unknown chart type {kind!r}")


