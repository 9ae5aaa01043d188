"""Ternary coordinates and what is drawn with them."""

from __future__ import annotations

import math
import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cols import c, num, require, tidy
from ..functions.quantiles import cut, exact_quantiles, quantile_values
from ..functions.ranges import numbered
from .filters import Element, element_sum, value_of
from .outliers import _join_keyed, _join_small

#: Point sizes, point types of the five bins, and what stands in where styling is missing. Fixed values.
SIZES = (0.1, 2.5)
POINT_TYPES = (16, 17, 15, 18, 19)
DEFAULT_SIZE, DEFAULT_TYPE, DEFAULT_COLOUR = 0.1, 16, "black"
#: Bins of an aspect ratio. Fixed values.
ASPECT_BREAKS = (1.0, 1.5, 3.0, 5.0, 10.0, 1e5)
#: Elements (1 to 7) of the six panels of a hexagon. Fixed values.
PANELS = ((1, 2, 3), (3, 4, 1), (4, 3, 5), (6, 5, 3), (3, 7, 6), (7, 3, 2))
PALETTE = ("#440154", "#3B528B", "#21908C", "#5DC863", "#FDE725")


def coordinates(df: DataFrame, a: Sequence[str], b: Sequence[str], cc: Sequence[str], keep_invalid: bool = False) -> DataFrame:
    """Add A, B, C: each axis is the sum of its columns (missing counts as 0) over the total of the three.

    Rows without a positive finite total go, unless ``keep_invalid``: then they have null coordinates.
    """
    require(df, [*a, *b, *cc])
    sums = {n: element_sum(df, cols) for n, cols in (("A", a), ("B", b), ("C", cc))}
    out = df.withColumns({f"__{n}": s for n, s in sums.items()}).withColumn("__total", F.col("__A") + F.col("__B") + F.col("__C"))
    valid = (F.col("__total") > 0) & (F.col("__total") < float("inf"))
    out = out.withColumns({n: F.when(valid, F.try_divide(F.col(f"__{n}"), F.col("__total"))) for n in sums})
    return (out if keep_invalid else out.where(valid)).drop("__A", "__B", "__C", "__total")


def percentages(df: DataFrame, a: Sequence[str], b: Sequence[str], cc: Sequence[str]) -> DataFrame:
    """Add A_pct, B_pct, C_pct; rows without a total stay, with null."""
    out = coordinates(df, a, b, cc, keep_invalid=True)
    return out.withColumns({f"{n}_pct": 100 * F.col(n) for n in "ABC"}).drop("A", "B", "C")


def file_summary(df: DataFrame, label: str = "file_source") -> DataFrame:
    """(file, rows, columns) of every file in a labelled table."""
    return df.groupBy(c(label).alias("file")).agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(df.columns) - 1))


def _elements(texts: Sequence[str]) -> list[list[str]]:
    if len(texts) != 7:
        raise ValueError(f"a hexagon takes 7 elements, not {len(texts)}")
    return [[n.strip() for n in t.split("+")] for t in texts]


def hexagon(df: DataFrame, elements: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., panel, A, B, C): the six panels of seven elements ("A+B" is a sum), from one scan.

    A panel has raw sums; it leaves out rows of which one of its elements has a missing column or no positive sum.
    """
    columns = _elements(elements)
    require(df, sorted({n for e in columns for n in e}))
    total = [element_sum(df, e) for e in columns]
    whole = [reduce(operator.and_, [value_of(df, n).isNotNull() for n in e]) for e in columns]
    rows = df.withColumns({f"__s{k}": F.when(w & (t > 0), t) for k, (t, w) in enumerate(zip(total, whole, strict=True), 1)})
    panels = F.array(*[F.struct(F.lit(p).alias("panel"), *[c(f"__s{k}").alias(n) for n, k in zip("ABC", ks, strict=True)]) for p, ks in enumerate(PANELS, 1)])
    return rows.select(*map(c, keep), F.inline(panels)).where("A is not null and B is not null and C is not null")


def place_hexagon(points: DataFrame) -> DataFrame:
    """Add x, y to panels: the point in its unit triangle (A up, B left, C right), even panels turned by 180
    degrees, around the panel's centre at 30 + 60 (panel - 1) degrees."""
    radius = 1.5 / math.sqrt(3)
    total = F.col("A") + F.col("B") + F.col("C")
    px = F.try_divide(F.col("C") + F.col("A") / 2, total) - 0.5
    py = F.try_divide(F.col("A") * (math.sqrt(3) / 2), total) - math.sqrt(3) / 6
    turn = F.when(F.col("panel") % 2 == 0, -1.0).otherwise(1.0)
    centre = [(radius * math.cos(math.radians(30 + 60 * k)), radius * math.sin(math.radians(30 + 60 * k))) for k in range(6)]
    at = [F.element_at(F.array(*[F.lit(p[i]) for p in centre]), F.col("panel").cast("int")) for i in (0, 1)]
    return points.withColumn("x", at[0] + turn * px).withColumn("y", at[1] + turn * py)


def point_sizes(df: DataFrame, names: Sequence[str], out: str = "point_size", manual: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Add a size from 0.1 to 2.5 in proportion to the sum of columns; a manual size overrides it."""
    if manual is not None:
        return df.withColumn(out, F.lit(float(manual)))
    low, high = SIZES
    rows = df.withColumn("__v", element_sum(df, names) if len(names) > 1 else value_of(df, names[0]))
    if by:
        rows = _join_small(rows, rows.groupBy(*map(c, by)).agg(F.max("__v").alias("__top")), by)
    else:
        rows = rows.crossJoin(F.broadcast(rows.agg(F.max("__v").alias("__top"))))  # one row
    size = F.try_divide(F.col("__v") * (high - low), F.col("__top")) + low
    return rows.withColumn(out, F.coalesce(size, F.lit(DEFAULT_SIZE))).drop("__v", "__top")


def quantile_breaks(df: DataFrame, name: str, bins: int = 5) -> list[float]:
    """Distinct quantiles that cut a column into bins of equal weight."""
    found = quantile_values(df, [name], [k / bins for k in range(bins + 1)])[name]
    return sorted({x for x in found if x is not None})


def quintile_types(df: DataFrame, name: str, bin_column: str = "bin", type_column: str = "point_type") -> DataFrame:
    """Add the quintile bin (from 1, right-closed) and its point type; a column without two breaks is one bin."""
    breaks = quantile_breaks(df, name)
    if len(breaks) < 2:
        return df.withColumn(bin_column, F.lit(1)).withColumn(type_column, F.lit(DEFAULT_TYPE))
    number = cut(num(name), breaks)
    return df.withColumn(bin_column, number).withColumn(type_column, F.coalesce(F.get(F.array(*map(F.lit, POINT_TYPES)), F.col(bin_column) - 1), F.lit(DEFAULT_TYPE)))


def quintile_types_by(df: DataFrame, name: str, by: Sequence[str], bin_column: str = "bin") -> DataFrame:
    """Add the quintile bin of every group's own breaks (ties between breaks merge bins)."""
    q = exact_quantiles(df, [name], [k / 5 for k in range(6)], by)
    wide = q.groupBy(*map(c, by)).agg(F.array_sort(F.collect_set("value")).alias("__breaks"))  # six numbers
    rows = _join_small(df, wide, by)
    inner = F.expr("slice(__breaks, 2, greatest(size(__breaks) - 2, 0))")
    x = num(name)
    return rows.withColumn("__x", x).withColumn("__inner", inner).withColumn(bin_column, F.when(F.col("__x").isNotNull(), F.size(F.filter("__inner", lambda b: b < F.col("__x"))) + 1)).drop("__breaks", "__inner", "__x")


def colour_bins(df: DataFrame, name: str, out: str = "colour", by: Sequence[str] = ()) -> DataFrame:
    """Add the colour of the quintile bin of a column (black where there is none), with ``by`` of each group's own bins."""
    binned = quintile_types_by(df, name, by, "__bin") if by else quintile_types(df, name, "__bin", "__type")
    return binned.withColumn(out, F.coalesce(F.get(F.array(*map(F.lit, PALETTE)), F.col("__bin") - 1), F.lit(DEFAULT_COLOUR))).drop("__bin", "__type")


def cut_labels(df: DataFrame, name: str, breaks: Sequence[float], out: str, labels: Sequence[str] | None = None) -> DataFrame:
    """Add the label of the right-closed bin between fixed breaks (null outside)."""
    labels = labels or [f"({breaks[k]:g}, {breaks[k + 1]:g}]" for k in range(len(breaks) - 1)]
    if len(labels) != len(breaks) - 1:
        raise ValueError("one label for each bin")
    return df.withColumn(out, F.get(F.array(*map(F.lit, labels)), cut(num(name), breaks) - 1))


def aspect_bins(df: DataFrame, name: str = "Aspect.Ratio", out: str = "aspect_bin") -> DataFrame:
    return cut_labels(df, name, ASPECT_BREAKS, out)


def group_colours(df: DataFrame, name: str) -> DataFrame:
    """(group, samples, colour_index): the index follows the count, descending, then the name (null first); every group has
    its own. Groups are numbered in ranges of counts and names, so no sort sees them all."""
    counts = df.groupBy(c(name).alias("group")).agg(F.count("*").alias("samples"))
    return numbered(counts, [-F.col("samples"), F.col("group")], "colour_index").select("group", "samples", F.col("colour_index").cast("int").alias("colour_index"))


def group_colours_by(df: DataFrame, name: str, by: str) -> DataFrame:
    """(by, group, samples, colour_index): `group_colours` of each file, ``by``; files are numbered one after the other, in
    the same ranges, and each begins anew."""
    counts = df.groupBy(c(by).alias("__file"), c(name).alias("group")).agg(F.count("*").alias("samples"))
    counts = counts.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else counts  # read four times
    placed = numbered(counts, [F.col("__file"), -F.col("samples"), F.col("group")], "colour_index", within="__file")
    return placed.select(F.col("__file").alias(by), "group", "samples", F.col("colour_index").cast("int").alias("colour_index"))


def colour_rows(df: DataFrame, name: str, out: str = "colour_index", by: str | None = None) -> DataFrame:
    """Add the colour index of each row's group, with ``by`` among those of its file."""
    keys = [by, name] if by else [name]
    table = group_colours_by(df, name, by) if by else group_colours(df, name)
    # by place: the file may be the group, or have the name of another column of the table
    return _join_keyed(df, table.toDF(*[f"__by{k}" for k in range(len(keys))], "__samples", out).drop("__samples"), keys)


def group_summary(df: DataFrame, name: str, top: int = 10, other: str = "(other)") -> DataFrame:
    """(rank, group, samples, percent): the ``top`` largest groups, and one row for all others."""
    counts = df.groupBy(c(name).cast("string").alias("group")).agg(F.count("*").alias("samples"))
    first = counts.orderBy(F.desc("samples"), "group").limit(top).agg(F.array_sort(F.collect_list(F.struct((-F.col("samples")).alias("s"), F.col("group").isNotNull().alias("named"), F.col("group").alias("g")))).alias("all"))
    total = counts.agg(F.sum("samples").alias("total"))
    both = first.crossJoin(total).withColumn("rest", F.col("total") - F.aggregate("all", F.lit(0).cast("long"), lambda a, x: a - x.s))
    rows = F.concat(
        F.transform("all", lambda x, i: F.struct((i + 1).cast("int").alias("rank"), x.g.alias("group"), (-x.s).alias("samples"))),
        F.filter(F.array(F.struct(F.lit(top + 1).alias("rank"), F.lit(other).alias("group"), F.col("rest").alias("samples"))), lambda x: x.samples > 0))
    return both.select("total", F.inline(rows)).select("rank", "group", "samples", F.bround(100.0 * F.col("samples") / F.col("total"), 1).alias("percent"))


def size_legend(df: DataFrame, name: str, n: int = 5) -> DataFrame:
    """(entry, value): values from the largest to the smallest, evenly spaced."""
    ends = df.agg(F.max(num(name)).alias("hi"), F.min(num(name)).alias("lo"))
    return ends.select(F.posexplode(F.expr(f"transform(sequence(0, {n - 1}), k -> hi - k * (hi - lo) / {n - 1})")).alias("entry", "value"))


def colour_legend(df: DataFrame, name: str, n: int = 5) -> DataFrame:
    """(entry, low, high): ranges of equal width."""
    ends = df.agg(F.max(num(name)).alias("hi"), F.min(num(name)).alias("lo"))
    return ends.select(F.inline(F.expr(f"transform(sequence(0, {n - 1}), k -> struct(k as entry, lo + k * (hi - lo) / {n} as low, lo + (k + 1) * (hi - lo) / {n} as high))")))


def styled(df: DataFrame, size: str | None = None, kind: str | None = None, colour: str | None = None) -> DataFrame:
    """Add point_size, point_type and colour of each row, the defaults where one is missing."""
    def pick(name: str | None, default: Column) -> Column:
        return F.coalesce(c(name), default) if name and name in df.columns else default

    return df.withColumns({"point_size": pick(size, F.lit(DEFAULT_SIZE)), "point_type": pick(kind, F.lit(DEFAULT_TYPE)), "colour": pick(colour, F.lit(DEFAULT_COLOUR))})


def plot_notes(points: DataFrame, elements: dict[str, Element], notes: dict[str, float | str | None] | None = None, distance: str | None = None, threshold: float | None = None) -> DataFrame:
    """(note, value): number of points, columns and filters of the axes, of a column of ``distance`` its mean (MDmean) and
    standard deviation (stdMD) to four digits and the ``threshold`` (MDthresh), and further notes as text."""
    fixed: list[tuple[str, str]] = []
    for axis, e in elements.items():
        fixed.append((f"{axis} columns", " + ".join(e.cols)))
        texts = [f"{n} {f}" for n, f in e.filters.items() if f] or ([e.filter] if e.filter else [])
        if texts:
            fixed.append((f"{axis} filter", "; ".join(texts)))
    if threshold is not None:
        fixed.append(("MDthresh", f"{threshold:.4f}"))
    fixed += [(k, str(v)) for k, v in (notes or {}).items() if v is not None]
    measured = {"MDmean": F.avg(num(distance)), "stdMD": F.stddev_samp(num(distance))} if distance else {}
    rows = F.array(
        F.struct(F.lit("points").alias("note"), F.col("n").cast("string").alias("value")), *[F.struct(F.lit(k).alias("note"), F.lit(v).alias("value")) for k, v in fixed],
        *[F.struct(F.lit(k).alias("note"), F.format_string("%.4f", F.col(k)).alias("value")) for k in measured])
    return points.agg(F.count("*").alias("n"), *[v.alias(k) for k, v in measured.items()]).select(F.inline(rows))


def worked_example(df: DataFrame, a: Sequence[str], b: Sequence[str], cc: Sequence[str], key: Sequence[str], n: int = 10, distance: str | None = None) -> DataFrame:
    """The first rows by key with the sums and coordinates of their axes (0 where the total is 0), and a column of
    ``distance`` if one is named (see `mahalanobis.with_distance`)."""
    first = df.orderBy(*map(c, key)).limit(n)
    sums = {"sum_A": element_sum(df, a), "sum_B": element_sum(df, b), "sum_C": element_sum(df, cc)}
    out = first.withColumns(sums)
    total = F.col("sum_A") + F.col("sum_B") + F.col("sum_C")
    return out.withColumns({x: F.coalesce(F.try_divide(F.col(f"sum_{x}"), total), F.lit(0.0)) for x in "ABC"}).select(*map(c, key), *sums, "A", "B", "C", *([c(distance)] if distance else []))


def example_statistics(example: DataFrame, names: Sequence[str] = ("A", "B", "C")) -> DataFrame:
    """(column, mean, sd, min, max) of the rows of a worked example."""
    kinds = {"mean": F.avg, "sd": F.stddev_samp, "min": F.min, "max": F.max}
    wide = example.agg(*[f(num(x)).alias(f"{k}{i}") for i, x in enumerate(names) for k, f in kinds.items()])
    return tidy(wide, [], {x: {k: f"{k}{i}" for k in kinds} for i, x in enumerate(names)})
