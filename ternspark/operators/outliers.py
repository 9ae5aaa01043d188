"""High-value outlier rules on single columns: IQR, z-score, MAD."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cols import c, num, numeric_columns, require
from ..functions.quantiles import exact_quantiles

#: Turns a median absolute deviation into a standard deviation of normal values.
MAD_SCALE = 1.4826
#: Default multiplier or threshold, in the order in which methods win.
METHODS = {"mahalanobis": None, "isolation_forest": None, "iqr": 1.5, "zscore": 3.0, "mad": 3.0}


def pick_method(asked: Sequence[str]) -> str | None:
    """One method a run: of several the first of `METHODS` wins, with a warning."""
    unknown = set(asked) - set(METHODS)
    if unknown:
        raise ValueError(f"unknown methods: {sorted(unknown)}")
    chosen = [m for m in METHODS if m in asked]
    if len(chosen) > 1:
        warnings.warn(f"several outlier methods asked for; using {chosen[0]}", stacklevel=2)
    return chosen[0] if chosen else None


def bounds(df: DataFrame, names: Sequence[str], method: str, limit: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by..., column, low, high): values outside are outliers. Null bounds flag nothing."""
    limit = METHODS[method] if limit is None else limit
    if limit is None or limit < 0:
        raise ValueError("the multiplier or threshold must not be negative")
    keys = [c(b) for b in by]
    if method == "iqr":
        q = exact_quantiles(df, names, [0.25, 0.75], by)
        wide = q.groupBy(*keys, "column").agg(F.max(F.when(F.col("prob") == 0.25, F.col("value"))).alias("q1"), F.max(F.when(F.col("prob") == 0.75, F.col("value"))).alias("q3"))
        spread = F.lit(limit) * (F.col("q3") - F.col("q1"))
        return wide.select(*keys, "column", (F.col("q1") - spread).alias("low"), (F.col("q3") + spread).alias("high"))
    if method == "zscore":
        wide = df.groupBy(*keys).agg(*[f(num(n)).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_samp))])
        rows = F.inline(F.array(*[F.struct(F.lit(n).alias("column"), (c(f"m{i}") - limit * c(f"s{i}")).alias("low"), (c(f"m{i}") + limit * c(f"s{i}")).alias("high"), c(f"s{i}").alias("sd")) for i, n in enumerate(names)]))
        return wide.select(*keys, rows).where("sd > 0").drop("sd")
    if method == "mad":
        middle = exact_quantiles(df, names, [0.5], by).select(*keys, "column", F.col("value").alias("median"))
        spots = {r["column"] if not by else (*[r[b] for b in by], r["column"]): r["median"] for r in middle.collect()} if not by else None
        if not by:
            away = df.select(*[F.abs(num(n) - F.lit(spots[n]).cast("double")).alias(n) for n in names])
        else:
            wide = middle.groupBy(*keys).agg(*[F.max(F.when(F.col("column") == n, F.col("median"))).alias(f"__m{i}") for i, n in enumerate(names)])
            away = _join_small(df, wide, by).select(*keys, *[F.abs(num(n) - c(f"__m{i}")).alias(n) for i, n in enumerate(names)])
        mad = exact_quantiles(away, names, [0.5], by).select(*keys, "column", F.col("value").alias("mad"))
        both = middle.join(mad, [*by, "column"])
        spread = F.lit(limit * MAD_SCALE) * F.col("mad")
        return both.select(*keys, "column", (F.col("median") - spread).alias("low"), (F.col("median") + spread).alias("high"))
    raise ValueError(f"unknown method {method!r}")


def _join_small(df: DataFrame, per_group: DataFrame, by: Sequence[str]) -> DataFrame:
    """Statistics of groups beside their rows: a shuffle join unless Spark finds the statistics small."""
    renamed = per_group
    for k, b in enumerate(by):
        renamed = renamed.withColumnRenamed(b, f"__by{k}")
    return _join_keyed(df, renamed, by)


def _join_keyed(df: DataFrame, per_group: DataFrame, by: Sequence[str]) -> DataFrame:
    """`_join_small` of statistics whose keys are named ``__by0``, ``__by1`` and so on (columns of ``by`` may be the same)."""
    on = F.lit(True)
    for k, b in enumerate(by):
        on = on & c(b).eqNullSafe(F.col(f"__by{k}"))
    return df.join(per_group, on, "left").drop(*[f"__by{k}" for k in range(len(by))])


def outlier_flag(df: DataFrame, names: Sequence[str], method: str, limit: float | None = None, side: str = "high", by: Sequence[str] = (), flag: str = "is_outlier") -> DataFrame:
    """Add a flag: whether any of the columns lies beyond its bound. Missing values and text aren't flagged.

    ``side`` is "high", or "both" for the two-sided rules. With ``by`` every group has its own bounds.
    """
    require(df, names)
    use = [n for n in names if n in numeric_columns(df)]
    if not use:
        return df.withColumn(flag, F.lit(False))
    table = bounds(df, use, method, limit, by)
    if by:
        wide = table.groupBy(*[c(b) for b in by]).agg(*[F.max(F.when(F.col("column") == n, F.col(s))).alias(f"__{s}{i}") for i, n in enumerate(use) for s in ("low", "high")])
        out = _join_small(df, wide, by)
        return out.withColumn(flag, _beyond([(num(n), c(f"__low{i}"), c(f"__high{i}")) for i, n in enumerate(use)], side)).drop(*[f"__{s}{i}" for i in range(len(use)) for s in ("low", "high")])
    found = {r["column"]: (r["low"], r["high"]) for r in table.collect()}  # two numbers per column
    return df.withColumn(flag, _beyond([(num(n), *[F.lit(v).cast("double") for v in found.get(n, (None, None))]) for n in use], side))


def _beyond(columns: list[tuple[Column, Column, Column]], side: str) -> Column:
    if side not in ("high", "both"):
        raise ValueError(f"side is high or both: {side!r}")
    out = F.lit(False)
    for x, low, high in columns:
        out = out | F.coalesce(x > high, F.lit(False))
        if side == "both":
            out = out | F.coalesce(x < low, F.lit(False))
    return out


def outlier_filter(df: DataFrame, names: Sequence[str], method: str, limit: float | None = None, keep_outliers: bool = False, side: str = "high", by: Sequence[str] = ()) -> DataFrame:
    """Rows that aren't flagged, or only the flagged ones."""
    flagged = outlier_flag(df, names, method, limit, side, by, "__flag")
    return flagged.where(F.col("__flag") if keep_outliers else ~F.col("__flag")).drop("__flag")


def pipeline_filter(df: DataFrame, names: Sequence[str], method: str, keep_outliers: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """The rule inside the plot pipeline: default limits, and only with two selected columns or more."""
    return outlier_filter(df, names, method, None, keep_outliers, "high", by) if len(names) >= 2 else df


def apply_iqr_filter(df: DataFrame, names: Sequence[str], multiplier: float = 1.5, keep_outliers: bool = False, **kw) -> DataFrame:
    return outlier_filter(df, names, "iqr", multiplier, keep_outliers, **kw)


def apply_zscore_filter(df: DataFrame, names: Sequence[str], threshold: float = 3.0, keep_outliers: bool = False, **kw) -> DataFrame:
    return outlier_filter(df, names, "zscore", threshold, keep_outliers, **kw)


def apply_mad_filter(df: DataFrame, names: Sequence[str], threshold: float = 3.0, keep_outliers: bool = False, **kw) -> DataFrame:
    return outlier_filter(df, names, "mad", threshold, keep_outliers, **kw)
