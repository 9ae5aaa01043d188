"""Several outlier methods on one set of rows."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cols import c
from .iforest import isolation_forest
from .mahalanobis import mahalanobis_flag
from .outliers import METHODS, outlier_flag


def combine_flags(df: DataFrame, flags: dict[str, str], out: str = "is_outlier") -> DataFrame:
    """Add the OR of the methods' flag columns."""
    any_flag = F.lit(False)
    for name in flags.values():
        any_flag = any_flag | F.coalesce(c(name), F.lit(False))
    return df.withColumn(out, any_flag)


def combined_summary(df: DataFrame, flags: dict[str, str]) -> DataFrame:
    """(rows, outliers, percent, methods) of the OR of the flags."""
    joined = combine_flags(df, flags, "__any")
    return joined.agg(F.count("*").alias("rows"), F.count_if("__any").alias("outliers")).withColumn("percent", F.bround(F.try_divide(100.0 * F.col("outliers"), F.col("rows")), 2)).withColumn("methods", F.lit(", ".join(flags)))


def agreement(df: DataFrame, flags: dict[str, str]) -> DataFrame:
    """(method1, method2, agreement): 100 * both / either, 100 on the diagonal, 0 where neither flags."""
    pairs = list(product(flags, repeat=2))
    f = {m: F.coalesce(c(n), F.lit(False)) for m, n in flags.items()}
    aggs = [x for k, (a, b) in enumerate(pairs) for x in (F.count_if(f[a] & f[b]).alias(f"b{k}"), F.count_if(f[a] | f[b]).alias(f"e{k}"))]
    rows = F.array(*[F.struct(F.lit(a).alias("method1"), F.lit(b).alias("method2"), (F.lit(100.0) if a == b else F.coalesce(F.try_divide(100.0 * c(f"b{k}"), c(f"e{k}")), F.lit(0.0))).alias("agreement")) for k, (a, b) in enumerate(pairs)])
    return df.agg(*aggs).select(F.inline(rows))


def multivariate_analysis(data: DataFrame, names: Sequence[str], methods: Sequence[str] = ("mahalanobis", "iqr"), ref: DataFrame | None = None, limits: dict[str, float] | None = None, **forest) -> tuple[DataFrame, dict[str, str]]:
    """``data`` with a flag column per method and ``is_outlier`` for their OR; flags by method."""
    unknown = set(methods) - set(METHODS)
    if unknown:
        raise ValueError(f"unknown methods: {sorted(unknown)}")
    if not {"mahalanobis", "isolation_forest"} & set(methods):
        raise ValueError("at least one of mahalanobis and isolation_forest is needed")
    flags, out, limits = {}, data, limits or {}
    for m in methods:
        flags[m] = f"{m}_outlier"
        if m == "mahalanobis":
            out = mahalanobis_flag(out, names, flags[m], ref, threshold=limits.get(m))
        elif m == "isolation_forest":
            out = isolation_forest(out, ref, names, flag=flags[m], out="__if", **forest).drop("__if")
        else:
            out = outlier_flag(out, names, m, limits.get(m), flag=flags[m])
    return combine_flags(out, flags), flags


def method_summary(df: DataFrame, flags: dict[str, str]) -> DataFrame:
    """(method, points, outliers, percent) of each flag column."""
    aggs = [F.count("*").alias("n"), *[F.count_if(F.coalesce(c(x), F.lit(False))).alias(f"f{k}") for k, x in enumerate(flags.values())]]
    rows = F.array(*[F.struct(F.lit(m).alias("method"), F.col("n").alias("points"), c(f"f{k}").alias("outliers"), F.bround(F.try_divide(100.0 * c(f"f{k}"), F.col("n")), 2).alias("percent")) for k, m in enumerate(flags)])
    return df.agg(*aggs).select(F.inline(rows))
