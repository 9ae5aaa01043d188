"""Descriptive statistics, correlations and comparisons of datasets."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.cols import c, common_numeric, num, numeric_columns, require, tidy
from ..functions.moments import average_ranks, correlation_table
from ..functions.quantiles import exact_quantiles
from ..functions.ranges import Sums, middles, numbered, range_of, range_sums

#: Distinct value pairs that Kendall's tau counts in one range, and ranges of each column at most.
KENDALL_CELL, KENDALL_RANGES = 1 << 17, 1024
#: Values among which a distance is searched on the driver.
NEAR_ROWS = 10_000


def describe(df: DataFrame, names: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, mean, median, sd), missing values left out."""
    names = list(names) if names else [n for n in numeric_columns(df) if n not in by]
    require(df, names)
    return _moments(df, names, by, {"mean": F.avg, "sd": F.stddev_samp}, {"median": 0.5}).select(*map(c, by), "column", "mean", "median", "sd")


def five_numbers(df: DataFrame, names: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, min, q1, median, mean, q3, max); a column without values gives nulls."""
    names = list(names) if names else [n for n in numeric_columns(df) if n not in by]
    return _moments(df, names, by, {"min": F.min, "mean": F.avg, "max": F.max}, {"q1": 0.25, "median": 0.5, "q3": 0.75}).select(*map(c, by), "column", "min", "q1", "median", "mean", "q3", "max")


def summary_with_missing(df: DataFrame, names: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """`five_numbers` with the missing values of each column and the number of rows."""
    names = list(names) if names else [n for n in numeric_columns(df) if n not in by]
    kinds = {"min": F.min, "mean": F.avg, "max": F.max, "missing": lambda x: F.count_if(x.isNull()), "rows": lambda x: F.count(F.lit(1))}
    return _moments(df, names, by, kinds, {"q1": 0.25, "median": 0.5, "q3": 0.75}).select(*map(c, by), "column", "min", "q1", "median", "mean", "q3", "max", "missing", "rows")


def _moments(df: DataFrame, names: Sequence[str], by: Sequence[str], kinds: dict, quantiles: dict[str, float]) -> DataFrame:
    """One wide aggregation, and the exact quantiles beside it."""
    aggs = [f(num(n)).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in kinds.items()]
    moments = tidy(df.groupBy(*map(c, by)).agg(*aggs), by, {n: {k: f"{k}{i}" for k in kinds} for i, n in enumerate(names)})
    q = exact_quantiles(df, names, list(quantiles.values()), by)
    wide = q.groupBy(*map(c, by), "column").agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(k) for k, p in quantiles.items()])
    on = F.col("l.column") == F.col("r.column")
    for b in by:
        on = on & F.col(f"l.`{b}`").eqNullSafe(F.col(f"r.`{b}`"))
    return moments.alias("l").join(wide.alias("r"), on).select("l.*", *[F.col(f"r.{k}") for k in quantiles])


def compare_summaries(first: DataFrame, second: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """`five_numbers` of the common columns of two datasets, labelled."""
    names = list(names) if names else common_numeric(first, second)
    return five_numbers(first, names).withColumn("dataset", F.lit("Dataset 1")).unionByName(five_numbers(second, names).withColumn("dataset", F.lit("Dataset 2")))


def correlations(df: DataFrame, names: Sequence[str] | None = None, pairwise: bool = False, method: str = "pearson") -> DataFrame:
    """(var1, var2, r, n) by Pearson, Spearman (average ranks) or Kendall (tau-b)."""
    names = list(names) if names else numeric_columns(df)
    if method == "pearson":
        return correlation_table(df, names, pairwise)
    if method == "spearman":
        rows = df.select(*[num(n).alias(n) for n in names])
        if not pairwise:
            rows = average_ranks(rows.dropna(), names, [f"__r{k}" for k in range(len(names))])
            table = correlation_table(rows, [f"__r{k}" for k in range(len(names))])
            back = F.create_map(*[F.lit(x) for k, n in enumerate(names) for x in (f"__r{k}", n)])
            return table.select(back[F.col("var1")].alias("var1"), back[F.col("var2")].alias("var2"), "r", "n")
        parts = [correlations(df, [a, b], False, "spearman") for i, a in enumerate(names) for b in names[i:]]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out.distinct()
    if method == "kendall":
        out = None
        for i, a in enumerate(names):
            for b in names[i:]:
                one = kendall(df, a, b)
                both = one if a == b else one.union(one.select(F.col("var2").alias("var1"), F.col("var1").alias("var2"), "r", "n"))
                out = both if out is None else out.union(both)
        return out
    raise ValueError(f"unknown method {method!r}")


def kendall(df: DataFrame, a: str, b: str, cell_pairs: int = KENDALL_CELL) -> DataFrame:
    """(var1, var2, r, n): tau-b from the distinct value pairs and their counts; null if a column has no variance.

    Pairs of rows are told apart by ranges of x and of y. Those in one range of x are counted there, by merging; those in
    one range of y but not of x in the range of y, with the ranges of x for values; all others from the numbers of rows
    in the grid of ranges. Ranges follow a sample of the pairs, at most `KENDALL_RANGES` each way; a value that fills
    ranges has one of its own, in which nothing is to be counted. No rows are paired by a join.
    """
    pairs = df.select(num(a).alias("x"), num(b).alias("y")).dropna().groupBy("x", "y").agg(F.count("*").alias("w")).persist()
    cells = pairs
    try:
        size = pairs.agg(F.count("*").alias("pairs"), F.sum("w").alias("n")).first()
        ranges = min(KENDALL_RANGES, -(-size["pairs"] // cell_pairs))
        edges = _pair_edges(pairs, size["pairs"], ranges) if ranges > 1 else ([], [])
        cells = pairs.withColumn("cx", _cell("x", edges[0])).withColumn("cy", _cell("y", edges[1])).persist()  # ranges are searched once
        s = _ordered_in(cells.select("cx", "x", "y", "w"), "cx", "x", "y")
        if ranges > 1:
            grid = cells.groupBy("cx", "cy").agg(F.sum("w").alias("w")).collect()  # at most KENDALL_RANGES squared numbers
            s += _ordered_between(grid)
            s += _ordered_in(cells.groupBy("cy", "y", "cx").agg(F.sum("w").alias("w")), "cy", "y", "cx")
        n = float(size["n"] or 0)
        tied = {v: cells.groupBy(v).agg(F.sum("w").cast("double").alias("w")).agg(F.sum(F.col("w") * F.col("w")).alias("t")).first()["t"] or 0.0 for v in "xy"}
    finally:
        cells.unpersist()
        pairs.unpersist()
    whole = (n * n - tied["x"]) * (n * n - tied["y"])
    return df.sparkSession.range(1).select(F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.lit(max(-1.0, min(1.0, 2 * s / math.sqrt(whole))) if whole > 0 else None).cast("double").alias("r"), F.lit(size["n"] or 0).cast("long").alias("n"))


def _pair_edges(pairs: DataFrame, n: int, ranges: int) -> tuple[list[float], list[float]]:
    """Ascending edges for x and y from a sample picked by hash; a value met at several edges is cut off on both sides."""
    share = F.pmod(F.xxhash64("x", "y"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 64 * ranges / n))
    sample = pairs.where(share).select("x", "y").toPandas()  # bounded: 64 for each range
    out = []
    for v in ("x", "y"):
        values = np.sort(sample[v].to_numpy())
        at = values[np.arange(1, ranges) * len(values) // ranges] if len(values) else values
        kinds, times = np.unique(at, return_counts=True)
        hot = kinds[(times > 1) & (kinds < np.inf)]
        out.append(sorted(set(kinds.tolist()) | set(np.nextafter(hot, np.inf).tolist())))
    return out[0], out[1]


def _cell(name: str, edges: Sequence[float]) -> Column:
    """How many of the ascending edges the value reaches."""
    if not edges:
        return F.lit(0)
    return range_of(F.col(name), F.array(*[F.lit(float(e)) for e in edges]), len(edges))


def _ordered_in(rows: DataFrame, cell: str, x: str, y: str) -> float:
    """Concordant less discordant weight of the pairs inside each cell."""
    several = rows.groupBy(cell).agg(F.min(x).alias("lo"), F.max(x).alias("hi")).where("lo < hi").select(cell)
    rows = rows.join(F.broadcast(several), cell)  # a row for each range

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"s": [concordance(cells[x].to_numpy(), cells[y].to_numpy(), cells["w"].to_numpy())]})

    return rows.groupBy(cell).applyInPandas(run, "s double").agg(F.sum("s").alias("s")).first()["s"] or 0.0


def _ordered_between(grid: Sequence[Row]) -> float:
    """The same for pairs that differ in both ranges, from the weights of the grid's cells."""
    table = np.zeros((max(r["cx"] for r in grid) + 1, max(r["cy"] for r in grid) + 1))
    for r in grid:
        table[r["cx"], r["cy"]] = r["w"]
    below = np.cumsum(table, axis=0) - table  # smaller x, this y
    upto = np.cumsum(below, axis=1)
    return float((table * ((upto - below) - (upto[:, -1:] - upto))).sum())


def concordance(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Concordant less discordant weight of all pairs of distinct points (x, y) with weights, by merging sorted halves.

    Points are sorted by x, then y; blocks of 1, 2, 4, ... neighbours are merged by y, and each point of a right half
    meets the weight of smaller and of greater ones in the left half. Points of equal x, which that counts as concordant,
    are taken off.
    """
    order = np.lexsort((y, x))
    x, w = x[order], w[order].astype(np.int64)
    rank = np.unique(y[order], return_inverse=True)[1].astype(np.int64)
    n, kinds = len(x), int(rank.max(initial=0)) + 1
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if n else np.zeros(0, dtype=np.int64)
    sums, squares = np.add.reduceat(w, first).astype(float), np.add.reduceat(w.astype(float) ** 2, first)
    total = -float(((sums**2 - squares) / 2).sum())
    place = np.arange(n)
    half = 1
    while half < n:
        block = place // (2 * half)
        key = block * kinds + rank[place]
        order = np.argsort(key, kind="stable")
        place, key = place[order], key[order]
        left = (place // half) % 2 == 0
        upto = np.concatenate([[0], np.cumsum(np.where(left, w[place], 0))])
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.cumsum(new) - 1
        starts = np.append(np.flatnonzero(new), n)
        block = block[order]
        ends = np.append(np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])), n)
        own = np.cumsum(np.concatenate([[True], block[1:] != block[:-1]])) - 1
        smaller = upto[starts[group]] - upto[ends[own]]
        greater = upto[ends[own + 1]] - upto[starts[group + 1]]
        right = ~left
        total += float((w[place][right].astype(float) * (smaller - greater)[right]).sum())
        half *= 2
    return total


def high_correlations(table: DataFrame, limit: float = 0.9, strict_reference: bool = False) -> DataFrame:
    """Pairs of different columns with |r| over the limit, in both orders; ``strict_reference`` also leaves out r = 1."""
    out = table.where((F.col("var1") != F.col("var2")) & (F.abs("r") > limit))
    return out.where("r <> 1") if strict_reference else out


def correlation_difference(first: DataFrame, second: DataFrame, names: Sequence[str] | None = None, large: float = 0.3) -> DataFrame:
    """(var1, var2, r1, r2, difference, is_large) of two datasets' correlation tables."""
    names = list(names) if names else common_numeric(first, second)
    a = correlation_table(first, names).select("var1", "var2", F.col("r").alias("r1"))
    b = correlation_table(second, names).select("var1", "var2", F.col("r").alias("r2"))
    return a.join(b, ["var1", "var2"]).withColumn("difference", F.col("r1") - F.col("r2")).withColumn("is_large", F.abs("difference") > large)


def paired_correlation(first: DataFrame, second: DataFrame, names: Sequence[str], key: Sequence[str]) -> DataFrame:
    """(column, r, n): each column against itself across datasets, rows paired by a key; null under two pairs."""
    require(first, [*names, *key])
    require(second, [*names, *key])
    a = first.select(*[c(k).alias(f"k{i}") for i, k in enumerate(key)], *[num(n).alias(f"a{i}") for i, n in enumerate(names)])
    b = second.select(*[c(k).alias(f"k{i}") for i, k in enumerate(key)], *[num(n).alias(f"b{i}") for i, n in enumerate(names)])
    both = a.join(b, [f"k{i}" for i in range(len(key))])
    aggs, entries = [], {}
    for i, n in enumerate(names):
        whole = c(f"a{i}").isNotNull() & c(f"b{i}").isNotNull()
        x, y = F.when(whole, c(f"a{i}")), F.when(whole, c(f"b{i}"))
        aggs += [F.covar_samp(x, y).alias(f"c{i}"), F.stddev_samp(x).alias(f"x{i}"), F.stddev_samp(y).alias(f"y{i}"), F.count(F.when(whole, 1)).alias(f"n{i}")]
        entries[n] = {"r": F.try_divide(c(f"c{i}"), c(f"x{i}") * c(f"y{i}")), "n": f"n{i}"}
    return tidy(both.agg(*aggs), [], entries)


def paired_by_position(first: DataFrame, second: DataFrame, names: Sequence[str], order: Sequence[str]) -> DataFrame:
    """`paired_correlation` of rows at the same place in an order that the caller names.

    Rows of equal keys follow a hash of the columns used; where the order matters, name columns that tell rows apart.
    """
    def placed(df: DataFrame) -> DataFrame:
        require(df, [*names, *order])
        return numbered(df.select(*map(c, names), *[c(o) for o in order if o not in names]), [c(o) for o in order], "__at")

    return paired_correlation(placed(first), placed(second), names, ["__at"])


def paired_summary(table: DataFrame, limit: float = 0.7) -> DataFrame:
    """(mean, median, min, max, over) of the correlations of `paired_correlation`."""
    return table.agg(F.avg("r").alias("mean"), F.percentile("r", 0.5).alias("median"), F.min("r").alias("min"), F.max("r").alias("max"), F.count_if(F.abs("r") > limit).alias("over"))


def dataset_summary(df: DataFrame) -> DataFrame:
    """(rows, columns, numeric_columns, missing) of a whole table."""
    names = numeric_columns(df)
    missing = F.lit(0).cast("long")
    for n in df.columns:
        missing = missing + F.count_if(num(n).isNull() if n in names else c(n).isNull())
    return df.agg(F.count("*").alias("rows"), missing.alias("missing")).select("rows", F.lit(len(df.columns)).cast("long").alias("columns"), F.lit(len(names)).cast("long").alias("numeric_columns"), "missing")


def readiness(first: DataFrame, second: DataFrame) -> DataFrame:
    """(rows1, rows2, columns1, columns2, common_numeric, ready): ready with two common numeric columns or more."""
    common = len(common_numeric(first, second))
    a, b = first.agg(F.count("*").alias("rows1")), second.agg(F.count("*").alias("rows2"))
    counts = {"columns1": len(first.columns), "columns2": len(second.columns), "common_numeric": common}
    return a.crossJoin(b).withColumns({k: F.lit(v).cast("long") for k, v in counts.items()}).withColumn("ready", F.lit(common >= 2))


def linear_trend(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, slope, intercept, r2, residual_se) of least squares, from one aggregation of moments."""
    rows = df.withColumn("__x", num(x)).withColumn("__y", num(y)).where("__x is not null and __y is not null")
    m = rows.groupBy(*map(c, by)).agg(F.count("*").alias("n"), F.avg("__x").alias("mx"), F.avg("__y").alias("my"), F.var_samp("__x").alias("vx"), F.var_samp("__y").alias("vy"), F.covar_samp("__x", "__y").alias("v"))
    slope = F.try_divide("v", "vx")
    rest = (F.col("n") - 1) * (F.col("vy") - slope * F.col("v"))
    return m.select(*map(c, by), "n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"), F.try_divide(F.col("v") * F.col("v"), F.col("vx") * F.col("vy")).alias("r2"),
                    F.when(F.col("n") > 2, F.sqrt(F.greatest(F.lit(0.0), F.try_divide(rest, F.col("n") - 2)))).alias("residual_se"))


def pair_trends(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(x, y, n, r, slope, intercept) of every pair of columns (the data behind a scatter matrix)."""
    aggs, entries = [], {}
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            if i == j:
                continue
            whole = num(a).isNotNull() & num(b).isNotNull()
            x, y = F.when(whole, num(a)), F.when(whole, num(b))
            k = f"{i}_{j}"
            aggs += [F.count(F.when(whole, 1)).alias(f"n{k}"), F.avg(x).alias(f"mx{k}"), F.avg(y).alias(f"my{k}"), F.var_samp(x).alias(f"vx{k}"), F.var_samp(y).alias(f"vy{k}"), F.covar_samp(x, y).alias(f"v{k}")]
            slope = F.try_divide(c(f"v{k}"), c(f"vx{k}"))
            entries[k] = {"x": F.lit(a), "y": F.lit(b), "n": f"n{k}", "r": F.try_divide(c(f"v{k}"), F.sqrt(c(f"vx{k}") * c(f"vy{k}"))), "slope": slope, "intercept": c(f"my{k}") - slope * c(f"mx{k}")}
    return tidy(df.agg(*aggs), [], entries, "pair").drop("pair")


def loess(df: DataFrame, x: str, y: str, span: float = 0.75, points: int = 80) -> DataFrame:
    """(x, fit) at evenly spaced points: local quadratics with tricube weights over the nearest share of rows.

    The distance of a point's k-th nearest row is searched in the numbers of rows on both sides: ranges of x are counted,
    and those that hold the k-th distance of some point counted again in parts, until few values are left. All windows'
    ends and points then cut x into at most 3 ``points`` + 1 ranges, whose sums of powers give the weighted moments of
    every window: (1 - |u|^3)^3 is a polynomial on each side of its point. No row is multiplied; infinite values are left
    out.
    """
    fine = [F.col(v).isNotNull() & (F.abs(v) < float("inf")) for v in ("x", "y")]
    rows = df.select(num(x).alias("x"), num(y).alias("y")).where(fine[0] & fine[1])
    ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"), F.percentile_approx("x", [k / 512 for k in range(513)], 2000).alias("q")).first()
    if not ends["n"]:
        return df.sparkSession.createDataFrame([], "x double, fit double")
    grid = np.linspace(ends["lo"], ends["hi"], points)
    k = min(ends["n"], max(1, math.floor(span * ends["n"] + 1e-9)))
    reach = _kth_distances(rows, grid, k, np.unique(np.concatenate([np.array(ends["q"], dtype=float), grid])))
    edges = np.unique(np.concatenate([grid, grid - reach, grid + reach, np.nextafter(grid, np.inf)]))
    sums = range_sums(rows, edges, 14, 12)
    fits = [(float(g), _local_fit(sums, edges, g, h)) for g, h in zip(grid, reach, strict=True)]
    return df.sparkSession.createDataFrame(fits, "x double, fit double")


def _kth_distances(rows: DataFrame, grid: np.ndarray, k: int, edges: np.ndarray) -> np.ndarray:
    """Of each point the distance of the k-th nearest x, exactly."""
    while True:
        sums = range_sums(rows, edges)
        there = np.flatnonzero(sums.rows)
        low, high, n = sums.low[there], sums.high[there], sums.rows[there]
        spans = []
        for g in grid:
            near = np.where((low <= g) & (g <= high), 0.0, np.minimum(np.abs(low - g), np.abs(high - g)))
            far = np.maximum(np.abs(low - g), np.abs(high - g))
            spans.append((_weighted_rank(near, n, k), _weighted_rank(far, n, k), near, far))
        # the k-th distance lies between the k-th of the nearest and of the farthest that rows of a range may have
        found = np.array([s[0] for s in spans])
        if all(s[0] == s[1] for s in spans):
            return found
        open_ = np.zeros(len(there), dtype=bool)
        for least, most, near, far in spans:
            if least < most:
                open_ |= (near <= most) & (far >= least) & (low < high)
        if int(n[open_].sum()) <= NEAR_ROWS:
            break
        cuts = [np.linspace(a, b, 65)[1:] for a, b in zip(low[open_], high[open_], strict=True)]
        edges = np.unique(np.concatenate([edges, low[open_], *cuts, np.nextafter(high[open_], np.inf)]))
    bounds = [(float(a), float(b)) for a, b in zip(low[open_], high[open_], strict=True)]
    rest = rows.where(_inside("x", bounds)).select("x").groupBy("x").count().toPandas()  # at most NEAR_ROWS rows
    values, times = np.concatenate([rest["x"].to_numpy(), low[~open_]]), np.concatenate([rest["count"].to_numpy(), n[~open_]])
    out = found.copy()
    for j, (g, (least, most, near, far)) in enumerate(zip(grid, spans, strict=True)):
        if least < most:
            # ranges that stay closed lie wholly on one side of the k-th distance
            d = np.concatenate([np.abs(rest["x"].to_numpy() - g), np.where(far[~open_] < least, 0.0, np.where(low[~open_] == high[~open_], far[~open_], np.inf))])
            out[j] = _weighted_rank(d, times, k)
    return out


def _inside(name: str, bounds: Sequence[tuple[float, float]]) -> Column:
    """Whether the value lies in one of the ascending closed intervals."""
    lows, highs = F.array(*[F.lit(a) for a, _ in bounds]), F.array(*[F.lit(b) for _, b in bounds])
    at = _cell(name, [a for a, _ in bounds])
    return (at > 0) & (F.col(name) <= F.get(highs, at - 1)) & (F.col(name) >= F.get(lows, at - 1))


def _weighted_rank(values: np.ndarray, n: np.ndarray, k: int) -> float:
    """The k-th smallest of values that occur ``n`` times."""
    order = np.argsort(values)
    return float(values[order][np.searchsorted(np.cumsum(n[order]), k)])


def _local_fit(sums: Sums, edges: np.ndarray, g: float, h: float) -> float:
    """The weighted quadratic's value at g, from the sums of the ranges inside [g - h, g + h]."""
    mid, half = middles(edges)
    if h == 0:
        own = np.flatnonzero((sums.low >= g) & (sums.high <= g) & (sums.rows > 0))
        return float(sums.moment[own, 0].sum() / sums.rows[own].sum())
    inner = np.flatnonzero((sums.rows > 0) & (sums.low >= g - h) & (sums.high <= g + h))
    scale, shift = half[inner] / h, (mid[inner] - g) / h
    alone = sums.low[inner] == sums.high[inner]  # one value: its powers are exact
    side = np.where((sums.low[inner] + sums.high[inner]) / 2 >= g, 1.0, -1.0)

    def moved(table: np.ndarray, plain: np.ndarray, upto: int) -> np.ndarray:
        """Sums of ((x - g) / h)^p of each range, from those about its middle."""
        out = np.zeros((len(inner), upto))
        for p in range(upto):
            for j in range(p + 1):
                out[:, p] += math.comb(p, j) * scale**j * shift ** (p - j) * table[inner, j]
        u = (sums.low[inner] - g) / h
        out[alone] = plain[inner][alone][:, None] * u[alone][:, None] ** np.arange(upto)
        return out

    xs, ys = moved(sums.power, sums.rows.astype(float), 14), moved(sums.moment, sums.moment[:, 0], 12)

    def weighted(table: np.ndarray, p: int) -> float:
        return float((table[:, p] - 3 * side * table[:, p + 3] + 3 * table[:, p + 6] - side * table[:, p + 9]).sum())

    m = np.array([[weighted(xs, i + j) for j in range(3)] for i in range(3)])
    return float(np.linalg.lstsq(m, np.array([weighted(ys, i) for i in range(3)]), rcond=1e-12)[0][0])
