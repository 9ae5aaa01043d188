"""Counts, means, covariances and correlations from one aggregation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cols import c, num, tidy

#: Columns up to which a covariance matrix is written out as expressions; more are summed as matrices.
EXPRESSION_COLUMNS = 30
#: Ranges of values that ranks are counted in (a power of two).
RANGES = 1024


def complete(names: Sequence[str]) -> Column:
    """Whether all named columns hold a value."""
    out = F.lit(True)
    for n in names:
        out = out & num(n).isNotNull()
    return out


def covariance(df: DataFrame, names: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, sample covariance) of the complete rows: p (p + 3) / 2 + 1 numbers reach the driver."""
    if len(names) > EXPRESSION_COLUMNS:
        return _gram(df, names)
    rows = df.where(complete(names)).select(*[num(n).alias(f"x{k}") for k, n in enumerate(names)])
    p = len(names)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    r = rows.agg(F.count("*").alias("n"), *[F.avg(f"x{k}").alias(f"m{k}") for k in range(p)], *[F.covar_samp(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    mean = np.array([r[f"m{k}"] for k in range(p)], dtype=np.float64)
    cov = np.full((p, p), np.nan)
    for i, j in pairs:
        if r[f"c{i}_{j}"] is not None:
            cov[i, j] = cov[j, i] = r[f"c{i}_{j}"]
    return r["n"], mean, cov


def _gram(df: DataFrame, names: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """The same for wide tables: each batch gives its rows, sums and X'X about a common shift."""
    p = len(names)
    rows = df.where(complete(names)).select(*[num(n).alias(f"x{k}") for k, n in enumerate(names)])
    shift = np.array([x or 0.0 for x in rows.limit(1000).agg(*[F.avg(f"x{k}") for k in range(p)]).first()], dtype=np.float64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b.to_numpy(dtype=np.float64) - shift
            yield pd.DataFrame({"n": [len(x)], "s": [x.sum(axis=0).tolist()], "g": [(x.T @ x).ravel().tolist()]})

    parts = rows.mapInPandas(run, "n long, s array<double>, g array<double>")
    add = parts.agg(F.sum("n").alias("n"), *[F.sum(F.get("s", F.lit(k))).alias(f"s{k}") for k in range(p)])
    r = add.first()
    n = r["n"] or 0
    total = parts.select(F.posexplode("g")).groupBy("pos").agg(F.sum("col").alias("v")).collect()  # p * p numbers
    g = np.zeros(p * p)
    for t in total:
        g[t["pos"]] = t["v"]
    s = np.array([r[f"s{k}"] or 0.0 for k in range(p)])
    cov = (g.reshape(p, p) - np.outer(s, s) / max(n, 1)) / (n - 1) if n > 1 else np.full((p, p), np.nan)
    return n, shift + s / max(n, 1), cov


def correlation_table(df: DataFrame, names: Sequence[str], pairwise: bool = False) -> DataFrame:
    """(var1, var2, r, n) for all ordered pairs of columns.

    Listwise by default: only rows complete in all columns count; ``pairwise``: rows complete in the two. A
    column without variance has no correlation (null). One aggregation.
    """
    rows = df.select(*[num(n).alias(f"x{k}") for k, n in enumerate(names)])
    if not pairwise:
        rows = rows.dropna()
    p = len(names)
    aggs, entries = [], {}
    for i in range(p):
        for j in range(i, p):
            both = F.col(f"x{i}").isNotNull() & F.col(f"x{j}").isNotNull()
            a, b = (F.when(both, F.col(f"x{k}")) if pairwise else F.col(f"x{k}") for k in (i, j))
            aggs += [F.covar_samp(a, b).alias(f"c{i}_{j}"), F.stddev_samp(a).alias(f"a{i}_{j}"), F.stddev_samp(b).alias(f"b{i}_{j}"), F.count(F.when(both, 1)).alias(f"n{i}_{j}")]
            r = F.try_divide(c(f"c{i}_{j}"), c(f"a{i}_{j}") * c(f"b{i}_{j}"))
            r = F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
            for u, v in {(i, j), (j, i)}:
                entries[f"{u},{v}"] = {"var1": F.lit(names[u]), "var2": F.lit(names[v]), "r": r, "n": f"n{i}_{j}"}
    return tidy(rows.agg(*aggs), [], entries, "pair").drop("pair")


def average_ranks(df: DataFrame, names: Sequence[str], outs: Sequence[str]) -> DataFrame:
    """``df`` with the rank of each column's value among all its values, ties averaged, without a sort in one task.

    Values are counted, dealt into ranges by approximate quantiles (found in one pass for all columns), numbered inside
    their range, and ranges' totals added up.
    """
    probs = [k / RANGES for k in range(1, RANGES)]
    found = df.agg(*[F.percentile_approx(num(n), probs, 10 * RANGES).alias(f"e{k}") for k, n in enumerate(names)]).first()
    out_df = df
    for k, (name, out) in enumerate(zip(names, outs, strict=True)):
        edges = ",".join(map(repr, found[f"e{k}"] or [0.0] * len(probs)))
        steps = ",".join(str(RANGES >> i) for i in range(1, RANGES.bit_length()))
        # the number of edges up to the value, by bisection
        cell = F.expr(f"aggregate(array({steps}), 0, (i, s) -> if(__x >= cast(split('{edges}', ',') as array<double>)[i + s - 1], i + s, i))")
        counts = df.where(num(name).isNotNull()).groupBy(num(name).alias("__x")).count().withColumn("__cell", cell)
        totals = counts.groupBy("__cell").agg(F.sum("count").alias("__t"))
        before = totals.select("__cell", F.expr("coalesce(sum(__t) over (order by __cell rows between unbounded preceding and 1 preceding), 0)").alias("__base"))  # a row per range
        inside = F.expr("coalesce(sum(count) over (partition by __cell order by __x rows between unbounded preceding and 1 preceding), 0)")
        ranks = counts.withColumn("__in", inside).join(F.broadcast(before), "__cell").select("__x", (F.col("__base") + F.col("__in") + (F.col("count") + 1) / 2).alias(out))
        out_df = out_df.withColumn("__x", num(name)).join(ranks, "__x", "left").drop("__x")
    return out_df
