"""Squared Mahalanobis distances, their thresholds, and a robust version."""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cols import c, common_numeric, num, numeric_columns, require
from ..functions.moments import complete, correlation_table, covariance
from ..functions.quantiles import quantile_values
from ..functions.tails import chi_square_quantile, chi_square_upper, chi_square_upper_column

#: Added to the diagonal of a singular covariance matrix, and the reciprocal condition that counts as singular.
RIDGE, SINGULAR = 1e-6, 2.2e-16


@dataclass(frozen=True)
class Centre:
    """Mean and inverse covariance of a reference: p + p * p numbers."""

    names: tuple[str, ...]
    mean: np.ndarray
    inverse: np.ndarray
    rows: int


def check_inputs(names: Sequence[str], lam: float = 1.0, omega: float = 0.0, threshold: float | None = None) -> None:
    """Raise for what can't work, warn for what is odd."""
    if len(names) < 2:
        raise ValueError("a distance takes two columns or more")
    if threshold is not None:
        if threshold <= 0:
            raise ValueError("the threshold must be positive")
        if threshold > 10_000:
            warnings.warn("the threshold is very large", stacklevel=2)
    if lam < 0 or omega < 0:
        raise ValueError("lambda and omega must not be negative")
    if lam - omega < -50 or lam - omega > 100:
        warnings.warn("lambda - omega is outside -50 to 100", stacklevel=2)


def check_data(data: DataFrame, ref: DataFrame, names: Sequence[str] | None = None, min_ratio: float = 2.0) -> DataFrame:
    """(check, severity, detail) of the columns and rows that a distance would use; errors make it unusable."""
    spark = data.sparkSession
    names = list(names) if names else common_numeric(data, ref)
    issues: list[tuple[str, str, str]] = []
    for label, d in (("data", data), ("reference", ref)):
        missing = [n for n in names if n not in d.columns]
        text = [n for n in names if n in d.columns and n not in numeric_columns(d)]
        issues += [("columns", "error", f"{label}: {n} not found") for n in missing] + [("columns", "error", f"{label}: {n} is not numeric") for n in text]
    if len(names) < 2:
        issues.append(("columns", "error", "two columns or more are needed"))
    if issues:
        return spark.createDataFrame(issues, "check string, severity string, detail string")
    for label, d in (("data", data), ("reference", ref)):
        r = d.agg(F.count_if(complete(names)).alias("n"), *[F.min(num(n)).alias(f"a{k}") for k, n in enumerate(names)], *[F.max(num(n)).alias(f"b{k}") for k, n in enumerate(names)]).first()
        if r["n"] < min_ratio * len(names):
            issues.append(("rows", "error", f"{label}: {r['n']} complete rows for {len(names)} columns"))
        issues += [("variance", "warning", f"{label}: {n} is constant") for k, n in enumerate(names) if r[f"a{k}"] is not None and r[f"a{k}"] == r[f"b{k}"]]
    if len(names) > 2:
        high = correlation_table(ref, names).where("var1 < var2 and abs(r) > 0.9").collect()  # p * p rows at most
        issues += [("correlation", "warning", f"{h['var1']} and {h['var2']}") for h in high]
    _, _, cov = covariance(ref, names)
    if np.isfinite(cov).all() and (np.linalg.cond(cov) > 1e10):
        issues.append(("condition", "warning", "the covariance is nearly singular"))
    return spark.createDataFrame(issues, "check string, severity string, detail string")


def centre_of(ref: DataFrame, names: Sequence[str]) -> Centre:
    """Mean and inverse sample covariance of the complete rows; a singular covariance gets a small ridge."""
    require(ref, names)
    n, mean, cov = covariance(ref, names)
    if n < 2 or not np.isfinite(cov).all():
        raise ValueError("the reference has fewer than two complete rows")
    return Centre(tuple(names), mean, _inverse(cov), n)


def _inverse(cov: np.ndarray) -> np.ndarray:
    condition = np.linalg.cond(cov, 1)
    if not np.isfinite(condition) or 1 / condition < SINGULAR:
        cov = cov + RIDGE * np.eye(len(cov))
    return np.linalg.inv(cov)


def distance(centre: Centre) -> Column:
    """The squared distance as an expression; null for rows with a missing value."""
    x = [num(n) - float(m) for n, m in zip(centre.names, centre.mean, strict=True)]
    out = F.lit(0.0)
    for i in range(len(x)):
        out = out + x[i] * x[i] * float(centre.inverse[i, i])
        for j in range(i + 1, len(x)):
            out = out + 2 * x[i] * x[j] * float(centre.inverse[i, j])
    return out


def with_distance(data: DataFrame, names: Sequence[str], ref: DataFrame | None = None, out: str = "md2") -> DataFrame:
    """Add the squared distance of each row to the reference (default: the data themselves)."""
    return data.withColumn(out, distance(centre_of(data if ref is None else ref, names)))


def auto_threshold(mean: float, sd: float, lam: float = 1.0, omega: float = 0.0) -> float:
    """mean + sqrt(100 / (100 + lambda - omega)) * sd."""
    return mean + math.sqrt(100 / (100 + lam - omega)) * sd


def mahalanobis(data: DataFrame, names: Sequence[str], ref: DataFrame | None = None, lam: float = 1.0, omega: float = 0.0,
                threshold: float | str | None = None, prob: float = 0.975, out: str = "md2", flag: str = "is_outlier") -> tuple[DataFrame, dict[str, float]]:
    """``data`` with squared distance and flag, and the numbers behind them.

    The threshold is manual, automatic (from mean and sd of the distances of ``data``) or "chisq" (the
    quantile ``prob`` for as many degrees of freedom as columns). Incomplete rows have no distance or flag.
    """
    check_inputs(names, lam, omega, threshold if isinstance(threshold, int | float) else None)
    marked = with_distance(data, names, ref, out)
    p = len(names)
    q95, q99 = chi_square_quantile(0.95, p), chi_square_quantile(0.99, p)
    r = marked.agg(F.count(out).alias("n"), F.avg(out).alias("mean"), F.stddev_samp(out).alias("sd"), F.count_if(F.col(out) > q95).alias("over95"), F.count_if(F.col(out) > q99).alias("over99")).first()
    if threshold == "chisq":
        limit = chi_square_quantile(prob, p)
    elif threshold is not None:
        limit = float(threshold)
    else:
        limit = auto_threshold(r["mean"], r["sd"] or 0.0, lam, omega) if r["mean"] is not None else math.inf
    stats = {"rows": r["n"], "mean": r["mean"], "sd": r["sd"], "threshold": limit, "df": p, "over_95": r["over95"], "over_99": r["over99"]}
    return marked.withColumn(flag, F.col(out) > limit), stats


def summary(data: DataFrame, names: Sequence[str], **kw) -> DataFrame:
    """(metric, value) of a run: rows, mean, sd, threshold, df, rows over the 95 % and 99 % chi-square quantiles
    and over the threshold."""
    marked, stats = mahalanobis(data, names, **kw)
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), F.lit(float(v)).alias("value")) for k, v in stats.items() if v is not None], F.struct(F.lit("outliers").alias("metric"), F.col("n").cast("double").alias("value")))
    return marked.agg(F.count_if(F.coalesce("is_outlier", F.lit(False))).alias("n")).select(F.inline(rows))


def reference_of(mode: str | None, data: DataFrame, first: DataFrame | None = None, second: DataFrame | None = None) -> DataFrame | None:
    """The reference of a mode: "self" (the filtered data), "dataset1", "dataset2"; None where there is none."""
    if mode in (None, "", "self"):
        return data
    if mode not in ("dataset1", "dataset2"):
        raise ValueError(f"unknown reference {mode!r}")
    return first if mode == "dataset1" else second


def mahalanobis_filter(data: DataFrame, names: Sequence[str], keep_outliers: bool = False, ref: DataFrame | None = None, **kw) -> DataFrame:
    """Complete rows that aren't outliers, or only the outliers; incomplete rows go in either case."""
    marked, _ = mahalanobis(data, names, ref, out="__md2", flag="__flag", **kw)
    return marked.where(F.col("__flag") if keep_outliers else ~F.col("__flag")).drop("__md2", "__flag")


def mahalanobis_flag(data: DataFrame, names: Sequence[str], flag: str = "is_outlier", ref: DataFrame | None = None, **kw) -> DataFrame:
    """Add a flag on every row, false for incomplete ones."""
    marked, _ = mahalanobis(data, names, ref, out="__md2", flag="__flag", **kw)
    return marked.withColumn(flag, F.coalesce("__flag", F.lit(False))).drop("__md2", "__flag")


def by_group(data: DataFrame, names: Sequence[str], by: str, lam: float = 1.0, omega: float = 0.0, out: str = "md2", flag: str = "is_outlier") -> DataFrame:
    """Every group against itself: one aggregation gives p (p + 3) / 2 + 1 numbers per group; the small table of
    them is inverted group by group and joined back."""
    p = len(names)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    rows = data.where(complete(names))
    moments = rows.groupBy(c(by).alias("g")).agg(F.count("*").alias("n"), *[F.avg(num(n)).alias(f"m{k}") for k, n in enumerate(names)], *[F.covar_samp(num(names[i]), num(names[j])).alias(f"c{i}_{j}") for i, j in pairs])

    def invert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            means, inverses = [], []
            for r in b.itertuples(index=False):
                cov = np.empty((p, p))
                for i, j in pairs:
                    cov[i, j] = cov[j, i] = getattr(r, f"c{i}_{j}")
                ok = r.n > 1 and np.isfinite(cov).all()
                means.append([getattr(r, f"m{k}") for k in range(p)])
                inverses.append(_inverse(cov).ravel().tolist() if ok else None)
            yield pd.DataFrame({"g": b.g, "mean": means, "inverse": inverses})

    kind = dict(data.dtypes)[by]
    table = moments.mapInPandas(invert, f"g {kind}, mean array<double>, inverse array<double>")
    joined = data.join(table, c(by).eqNullSafe(F.col("g")), "left").drop("g")
    x = [num(n) - F.get("mean", F.lit(k)) for k, n in enumerate(names)]
    d = F.lit(0.0)
    for i in range(p):
        for j in range(p):
            d = d + x[i] * x[j] * F.get("inverse", F.lit(i * p + j))
    marked = joined.withColumn(out, d).drop("mean", "inverse")
    limits = marked.groupBy(c(by).alias("g")).agg((F.avg(out) + math.sqrt(100 / (100 + lam - omega)) * F.coalesce(F.stddev_samp(out), F.lit(0.0))).alias("__limit"))
    return marked.join(limits, c(by).eqNullSafe(F.col("g")), "left").withColumn(flag, F.col(out) > F.col("__limit")).drop("g", "__limit")


def with_p_value(marked: DataFrame, p: int, distance: str = "md2", out: str = "p_value") -> DataFrame:
    """Add the chi-square tail of each squared distance."""
    return marked.withColumn(out, chi_square_upper_column(num(distance), p))


def robust_centre(ref: DataFrame, names: Sequence[str], support: float = 0.75, key: Sequence[str] | None = None, subsets: int = 5, subset_rows: int = 300, starts: int = 500, steps: int = 100) -> Centre:
    """Minimum covariance determinant by FAST-MCD (Rousseeuw and Van Driessen 1999).

    A concentration step keeps the ``support`` share of rows nearest to a centre and takes their mean and covariance. A
    sample of ``subsets * subset_rows`` rows, picked by a hash of ``key`` (default: the columns; equal rows once), is
    dealt to disjoint subsets; ``starts`` random starts take two steps in their subset, the ten best of each subset two
    steps in the whole sample, the ten best of those a step over all rows, all ten in one pass, and the best is stepped
    until its determinant stops falling. A limit of a step is an exact quantile of the distances. Up to as many rows as
    the sample holds are worked on whole, on the driver. The covariance is scaled to agree with normal data.
    """
    rows = ref.where(complete(names)).select(*[num(n).alias(n) for n in names], F.xxhash64(*map(c, key or names)).alias("__row"))
    n, p = rows.count(), len(names)
    if n < 3 * p:
        raise ValueError("a robust distance takes three rows per column or more")
    most = subsets * subset_rows
    if n <= most:
        picked = rows.drop("__row").toPandas().to_numpy(dtype=np.float64)  # at most subsets * subset_rows rows
        picked = picked[np.lexsort(picked.T)]
    else:
        share = min(1.0, (most + 8 * math.sqrt(most)) / n)
        light = rows.where(F.shiftrightunsigned(F.xxhash64(F.lit(42), "__row"), 11) < int(share * (1 << 53))) if share < 1 else rows
        light = light.dropDuplicates(["__row"]).orderBy(F.xxhash64(F.lit(43), "__row"), *map(c, names)).limit(most)
        picked = light.drop("__row").toPandas().to_numpy(dtype=np.float64)
    rng = np.random.default_rng(42)
    deal = np.array_split(rng.permutation(len(picked)), subsets if n > most else 1)
    found: list[_Fit] = []
    for own in deal:
        part = picked[own]
        if len(part) > p:
            tried = [_steps(part, _start(part, p, rng), support, 2 if n > most else steps) for _ in range(max(10, starts // len(deal)))]
            found += sorted(tried, key=lambda f: f[0])[:10]
    if n <= most:
        best = min(found, key=lambda f: f[0])
    else:
        found = sorted((_steps(picked, f, support, 2) for f in found), key=lambda f: f[0])
        best = _concentrated(rows, names, found[:10], support, n)
        for _ in range(steps):
            better = _concentrated(rows, names, [best], support, n)
            if better[0] >= best[0] * (1 - 1e-9):
                break
            best = better
    scale = support / (1 - chi_square_upper(chi_square_quantile(support, p), p + 2))
    return Centre(tuple(names), best[1], _inverse(best[2]) / scale, n)


_Fit = tuple[float, np.ndarray, np.ndarray]  # determinant, mean, covariance


def _fit(x: np.ndarray) -> _Fit:
    cov = np.atleast_2d(np.cov(x.T))
    return float(np.linalg.det(cov)), x.mean(axis=0), cov


def _start(x: np.ndarray, p: int, rng: np.random.Generator) -> _Fit:
    """Mean and covariance of p + 1 random rows, more where these are singular."""
    order = rng.permutation(len(x))
    size = p + 1
    while size < len(x) and np.linalg.matrix_rank(np.cov(x[order[:size]].T)) < p:
        size += 1
    return _fit(x[order[:size]])


def _kept(n: int, p: int, support: float) -> int:
    return min(n, max(p + 1, int(support * n)))


def _steps(x: np.ndarray, f: _Fit, support: float, steps: int) -> _Fit:
    h = _kept(len(x), x.shape[1], support)
    for k in range(steps):
        away = x - f[1]
        d = np.einsum("ij,jk,ik->i", away, _inverse(f[2]), away)
        new = _fit(x[np.argpartition(d, h - 1)[:h]])
        if k and new[0] >= f[0] * (1 - 1e-12):
            return new if new[0] < f[0] else f
        f = new
    return f


def _concentrated(rows: DataFrame, names: Sequence[str], fits: Sequence[_Fit], support: float, n: int) -> _Fit:
    """A step over all rows for several centres at once; the one of least determinant."""
    p = len(names)
    marked = rows.select(*map(c, names), *[distance(Centre(tuple(names), f[1], _inverse(f[2]), n)).alias(f"__d{k}") for k, f in enumerate(fits)])
    share = (_kept(n, p, support) - 1) / (n - 1)
    limits = quantile_values(marked, [f"__d{k}" for k in range(len(fits))], [share])
    aggs = []
    for k in range(len(fits)):
        near = [F.when(F.col(f"__d{k}") <= limits[f"__d{k}"][0], c(x)) for x in names]
        aggs += [F.avg(x).alias(f"m{k}_{i}") for i, x in enumerate(near)] + [F.covar_samp(near[i], near[j]).alias(f"c{k}_{i}_{j}") for i in range(p) for j in range(i, p)]
    r = marked.agg(*aggs).first()
    out = []
    for k in range(len(fits)):
        cov = np.array([[r[f"c{k}_{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)], dtype=float)
        out.append((float(np.linalg.det(cov)), np.array([r[f"m{k}_{i}"] for i in range(p)]), cov))
    return min(out, key=lambda f: f[0])


def robust_flag(data: DataFrame, names: Sequence[str], ref: DataFrame | None = None, prob: float = 0.975, out: str = "robust_md2", flag: str = "is_outlier", **kw) -> DataFrame:
    """Add the squared robust distance and whether it exceeds the chi-square quantile (false for incomplete rows)."""
    limit = chi_square_quantile(prob, len(names))
    marked = data.withColumn(out, distance(robust_centre(data if ref is None else ref, names, **kw)))
    return marked.withColumn(flag, F.coalesce(F.col(out) > limit, F.lit(False)))
