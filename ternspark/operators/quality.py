"""Data quality: missing, infinite, constant, outlying; scores and comparisons."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cols import c, common_numeric, num, numeric_columns, require, tidy
from ..functions.moments import correlation_table
from ..functions.quantiles import exact_quantiles
from ..functions.tails import chi_square_upper, chi_square_upper_column, shapiro_wilk
from .filters import complete_cases
from .stats import high_correlations

#: Rows up to which the Shapiro-Wilk test is defined.
SHAPIRO_ROWS = 5000


def column_quality(df: DataFrame, names: Sequence[str] | None = None, fewest: int = 1) -> DataFrame:
    """(column, rows, missing, infinite, zero_variance, outliers) of numeric columns.

    NaN is missing. Zero variance is null under two values. Outliers lie beyond 1.5 interquartile ranges on
    either side (0 with fewer than ``fewest`` values). Two passes: quantiles, then everything else.
    """
    names = list(names) if names else numeric_columns(df)
    require(df, names)
    q = {(r["column"], r["prob"]): r["value"] for r in exact_quantiles(df, names, [0.25, 0.75]).collect()}  # two numbers a column
    aggs, entries = [F.count("*").alias("rows")], {}
    for i, n in enumerate(names):
        x = num(n)
        q1, q3 = q.get((n, 0.25)), q.get((n, 0.75))
        out = F.lit(False)
        if q1 is not None:
            out = (x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1))
        aggs += [F.count(x).alias(f"n{i}"), F.count_if(F.abs(x) == float("inf")).alias(f"inf{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.count_if(out).alias(f"out{i}")]
        entries[n] = {"rows": "rows", "missing": c("rows") - c(f"n{i}"), "infinite": f"inf{i}", "zero_variance": F.when(c(f"n{i}") >= 2, c(f"lo{i}") == c(f"hi{i}")),
                      "outliers": F.when(c(f"n{i}") >= fewest, c(f"out{i}")).otherwise(F.lit(0).cast("long"))}
    return tidy(df.agg(*aggs), [], entries)


def issues(df: DataFrame, names: Sequence[str] | None = None, min_rows: int = 1) -> DataFrame:
    """(severity, check, column) of what is wrong or odd; valid tables have no errors."""
    spark = df.sparkSession
    schema = "severity string, check string, column string"
    wanted = list(names) if names else df.columns
    found = [("error", "missing column", n) for n in wanted if n not in df.columns]
    if not df.columns:
        return spark.createDataFrame([("error", "no columns", None)], schema)
    have = [n for n in wanted if n in df.columns]
    numeric = [n for n in have if n in numeric_columns(df)]
    if not numeric:
        found.append(("warning", "no numeric column", None))
    blank = df.agg(F.count("*").alias("rows"), *[F.count_if(num(n).isNull() if n in numeric else c(n).isNull()).alias(f"m{k}") for k, n in enumerate(have)]).first()
    if blank["rows"] < min_rows:
        found.append(("error", "no rows", None))
    found += [("warning", "over half missing", n) for k, n in enumerate(have) if blank["rows"] and blank[f"m{k}"] > 0.5 * blank["rows"]]
    if numeric and blank["rows"]:
        for r in column_quality(df, numeric).collect():  # a row a column
            found += [("warning", "infinite values", r["column"])] if r["infinite"] else []
            found += [("warning", "zero variance", r["column"])] if r["zero_variance"] else []
    return spark.createDataFrame(found, schema)


def is_valid(df: DataFrame, names: Sequence[str] | None = None) -> bool:
    return issues(df, names).where("severity = 'error'").isEmpty()


def missing_summary(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """(column, missing, outliers, complete, percent): per column, beside the complete cases of all of them."""
    names = list(names) if names else numeric_columns(df)
    whole = complete_cases(df, names).select("complete", "percent")
    return column_quality(df, names, fewest=4).select("column", "missing", "outliers").crossJoin(F.broadcast(whole))  # one row


def distribution(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """(column, mean, median, sd, skewness, kurtosis): population skewness, kurtosis not in excess."""
    names = list(names) if names else numeric_columns(df)
    aggs = [f(num(n)).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (("mean", F.avg), ("sd", F.stddev_samp), ("sk", F.skewness), ("ku", F.kurtosis))]
    m = tidy(df.agg(*aggs), [], {n: {"mean": f"mean{i}", "sd": f"sd{i}", "skewness": f"sk{i}", "kurtosis": c(f"ku{i}") + 3} for i, n in enumerate(names)})
    q = exact_quantiles(df, names, [0.5]).select("column", F.col("value").alias("median"))
    return m.join(q, "column").select("column", "mean", "median", "sd", "skewness", "kurtosis")


def quality_score(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """(score, grade): 100 - missing % - infinite % - 50 * share of constant columns - min(20 * outliers / cells, 30)."""
    return score_of(column_quality(df, names))


def score_of(table: DataFrame) -> DataFrame:
    t = table.agg(F.sum("rows").alias("cells"), F.sum("missing").alias("missing"), F.sum("infinite").alias("infinite"), F.sum("outliers").alias("outliers"),
                  F.count_if(F.coalesce("zero_variance", F.lit(False))).alias("flat"), F.count("*").alias("columns"))

    def share(x: str, of: str, times: float) -> Column:
        return F.coalesce(F.try_divide(times * F.col(x), F.col(of)), F.lit(0.0))

    raw = 100.0 - share("missing", "cells", 100.0) - share("infinite", "cells", 100.0) - share("flat", "columns", 50.0) - F.least(share("outliers", "cells", 20.0), F.lit(30.0))
    score = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), 1)
    grade = F.when(F.col("score") >= 90, "A").when(F.col("score") >= 80, "B").when(F.col("score") >= 70, "C").when(F.col("score") >= 60, "D").otherwise("F")
    return t.select(score.alias("score")).withColumn("grade", grade)


def check_data_quality(first: DataFrame, second: DataFrame, names: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Tidy tables of both datasets on their common numeric columns: quality, correlations, high correlations,
    distributions and scores."""
    names = list(names) if names else common_numeric(first, second)
    both = {"Dataset 1": first, "Dataset 2": second}
    columns = {k: column_quality(d, names) for k, d in both.items()}  # its quantiles are found here, once for all tables

    def stacked(make) -> DataFrame:
        parts = [make(k).withColumn("dataset", F.lit(k)) for k in both]
        return parts[0].unionByName(parts[1])

    return {
        "quality": stacked(lambda k: columns[k]),
        "correlations": stacked(lambda k: correlation_table(both[k], names, pairwise=True)),
        "high_correlations": stacked(lambda k: high_correlations(correlation_table(both[k], names, pairwise=True))),
        "distributions": stacked(lambda k: distribution(both[k], names)),
        "scores": stacked(lambda k: score_of(columns[k])),
    }


def quality_summary(first: DataFrame, second: DataFrame, names: Sequence[str] | None = None, quality: DataFrame | None = None) -> DataFrame:
    """(metric, Dataset 1, Dataset 2): missing, infinite, zero variance and outliers of the common columns; ``quality``
    is the table of that name from `check_data_quality`, if it is at hand."""
    names = list(names) if names else common_numeric(first, second)
    parts = []
    for label, d in (("Dataset 1", first), ("Dataset 2", second)):
        columns = column_quality(d, names) if quality is None else quality.where(F.col("dataset") == label)
        t = columns.agg(F.sum("missing").alias("missing"), F.sum("infinite").alias("infinite"), F.count_if(F.coalesce("zero_variance", F.lit(False))).alias("zero_variance"), F.sum("outliers").alias("outliers"))
        parts.append(tidy(t, [], {k: {"value": k} for k in ("missing", "infinite", "zero_variance", "outliers")}, "metric").withColumn("dataset", F.lit(label)))
    return parts[0].unionByName(parts[1]).groupBy("metric").pivot("dataset", ["Dataset 1", "Dataset 2"]).agg(F.first("value"))


def consistency(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """(column, min, max, range, missing_percent)."""
    names = list(names) if names else numeric_columns(df)
    aggs = [F.count("*").alias("rows"), *[f(num(n)).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (("lo", F.min), ("hi", F.max), ("n", F.count))]]
    return tidy(df.agg(*aggs), [], {n: {"min": f"lo{i}", "max": f"hi{i}", "range": c(f"hi{i}") - c(f"lo{i}"), "missing_percent": F.try_divide(100.0 * (c("rows") - c(f"n{i}")), c("rows"))} for i, n in enumerate(names)})


def normality(df: DataFrame, names: Sequence[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """(column, n, statistic, p_value, normal, status, jarque_bera, jb_p).

    Shapiro-Wilk for 4 to 5000 values of a column that varies; else the status says why not. Jarque-Bera, from
    the moments, answers at any size.
    """
    names = list(names) if names else numeric_columns(df)
    shape = tidy(df.agg(*[f(num(n)).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max), ("sk", F.skewness), ("ku", F.kurtosis))]), [],
                 {n: {"n": f"n{i}", "lo": f"lo{i}", "hi": f"hi{i}", "sk": f"sk{i}", "ku": f"ku{i}"} for i, n in enumerate(names)})
    facts = {r["column"]: r for r in shape.collect()}
    out = []
    for n in names:
        r = facts[n]
        jb = r["n"] / 6 * (r["sk"] ** 2 + r["ku"] ** 2 / 4) if r["n"] and r["sk"] is not None and not np.isnan(r["sk"]) else None
        jb_p = chi_square_upper(jb, 2) if jb is not None else None
        status, w, p = "ok", None, None
        if r["n"] < 4:
            status = "too few values"
        elif r["n"] > SHAPIRO_ROWS:
            status = "too many values"
        elif r["lo"] == r["hi"]:
            status = "constant"
        else:
            values = df.select(num(n).alias("x")).where("x is not null").toPandas()["x"]  # SHAPIRO_ROWS at most
            w, p = shapiro_wilk(values.to_numpy())
        out.append((n, r["n"], w, p, None if p is None else p > alpha, status, jb, jb_p))
    return df.sparkSession.createDataFrame(pd.DataFrame(out, columns=list("abcdefgh")).astype(object).where(lambda d: d.notna(), None).values.tolist(), "column string, n long, statistic double, p_value double, normal boolean, status string, jarque_bera double, jb_p double")


def normality_by_group(df: DataFrame, by: Sequence[str], names: Sequence[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """(by..., column, n, statistic, p_value, normal, status, jarque_bera, jb_p): `normality` of every group.

    Moments come from one aggregation; Shapiro-Wilk from a sorted array of a group's values, which only groups of 4 to
    5000 values that vary are gathered for.
    """
    names = list(names) if names else [n for n in numeric_columns(df) if n not in by]
    require(df, [*names, *by])
    kinds = (("n", F.count), ("lo", F.min), ("hi", F.max), ("sk", F.skewness), ("ku", F.kurtosis))
    shape = tidy(df.groupBy(*map(c, by)).agg(*[f(num(n)).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in kinds]), by, {n: {k: f"{k}{i}" for k, _ in kinds} for i, n in enumerate(names)})
    jb = F.when(~F.isnan("sk"), F.col("n") / 6 * (F.col("sk") * F.col("sk") + F.col("ku") * F.col("ku") / 4))
    status = F.when(F.col("n") < 4, "too few values").when(F.col("n") > SHAPIRO_ROWS, "too many values").when(F.col("lo") == F.col("hi"), "constant").otherwise("ok")
    facts = shape.select(*map(c, by), "column", "n", status.alias("status"), jb.alias("jarque_bera"), chi_square_upper_column(jb, 2).alias("jb_p"))
    same = F.col("v.column") == F.col("f.column")
    for b in by:
        same = same & F.col(f"v.`{b}`").eqNullSafe(F.col(f"f.`{b}`"))
    values = tidy(df.select(*map(c, by), *[num(n).alias(n) for n in names]), by, {n: {"x": n} for n in names}).where("x is not null")
    small = values.alias("v").join(facts.where("status = 'ok'").alias("f"), same, "left_semi")
    arrays = small.groupBy(*map(c, by), "column").agg(F.sort_array(F.collect_list("x")).alias("x"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(batch.num_columns - 1)
            found = [shapiro_wilk(v.values.to_numpy()) for v in x]
            parts = [*batch.columns[:-1], pa.array([f[0] for f in found], type=pa.float64()), pa.array([f[1] for f in found], type=pa.float64())]
            yield pa.RecordBatch.from_arrays(parts, names=[*batch.schema.names[:-1], "statistic", "p_value"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in arrays.schema.fields[:-1])
    tested = arrays.mapInArrow(test, f"{schema}, statistic double, p_value double")
    on = F.col("f.column") == F.col("t.column")
    for b in by:
        on = on & F.col(f"f.`{b}`").eqNullSafe(F.col(f"t.`{b}`"))
    return facts.alias("f").join(tested.alias("t"), on, "left").select(
        *[F.col(f"f.`{b}`") for b in by], "f.column", "n", "statistic", "p_value", (F.col("p_value") > alpha).alias("normal"), "status", "jarque_bera", "jb_p")


def duplicates(df: DataFrame) -> DataFrame:
    """(rows, duplicates, percent): rows that repeat an earlier one in all columns. Only counts are shuffled after
    equal rows are combined."""
    counts = df.groupBy(*map(c, df.columns)).agg(F.count("*").alias("__n"))
    return counts.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicates")).withColumn("percent", F.bround(F.try_divide(100.0 * F.col("duplicates"), F.col("rows")), 2))


def duplicate_names(names: Sequence[str]) -> list[str]:
    return sorted({n for n in names if list(names).count(n) > 1})


def empty_columns(df: DataFrame) -> DataFrame:
    """(column, empty, constant): empty holds nothing but missing, 0 or ""; constant has one distinct value at most."""
    kinds = dict(df.dtypes)
    numeric = numeric_columns(df)
    aggs, entries = [], {}
    plain = [n for n in df.columns if not kinds[n].startswith(("array", "map", "struct"))]
    for i, n in enumerate(plain):
        x = num(n) if n in numeric else c(n).cast("string")
        aggs += [F.count_if(x.isNotNull() & (x != (F.lit(0.0) if n in numeric else F.lit("")))).alias(f"f{i}"), F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")]
        entries[n] = {"empty": c(f"f{i}") == 0, "constant": F.coalesce(c(f"a{i}") == c(f"b{i}"), F.lit(True))}
    return tidy(df.agg(*aggs), [], entries)


def compare_datasets(first: DataFrame, second: DataFrame) -> DataFrame:
    """(metric, value) as text: rows, columns, common and one-sided columns, overlap and type agreement."""
    a, b = dict(first.dtypes), dict(second.dtypes)
    common = [n for n in first.columns if n in b]
    every = len(set(a) | set(b))
    facts = {
        "columns1": str(len(a)), "columns2": str(len(b)), "common": str(len(common)),
        "only1": ", ".join(n for n in first.columns if n not in b), "only2": ", ".join(n for n in second.columns if n not in a),
        "overlap_percent": f"{100 * len(common) / every:.1f}" if every else "0.0", "types_match": str(all(a[n] == b[n] for n in common)).lower(),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), (F.col(k).cast("string") if k.startswith("rows") else F.lit(facts.get(k))).alias("value")) for k in ("rows1", "rows2", *facts)])
    return first.agg(F.count("*").alias("rows1")).crossJoin(second.agg(F.count("*").alias("rows2"))).select(F.inline(rows))


def comprehensive(first: DataFrame, second: DataFrame) -> dict[str, DataFrame]:
    """All quality tables of two datasets."""
    names = common_numeric(first, second)
    out = check_data_quality(first, second, names)
    for label, d in (("1", first), ("2", second)):
        out |= {f"consistency{label}": consistency(d, names), f"normality{label}": normality(d, names), f"duplicates{label}": duplicates(d), f"empty{label}": empty_columns(d)}
    return out | {"comparison": compare_datasets(first, second)}
