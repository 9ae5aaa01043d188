"""Columns: quoting, missing values, coercion and names."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Endings that mark a unit in a column name. Fixed values.
UNIT_ENDINGS = (".(Wt%)", ".(Wt.%)", ".(Wt. %)", ".(%)", ".(wt%)", ".(wt.%)")
#: Text columns count as categories, others if they have at most this many distinct values.
MAX_LEVELS = 50


def c(name: str) -> Column:
    """A column by its exact name, dots and parentheses included."""
    return F.col("`" + name.replace("`", "``") + "`")


def num(x: str | Column) -> Column:
    """A numeric column as double with NaN as null, so that both kinds of missing value count alike."""
    x = (c(x) if isinstance(x, str) else x).cast("double")
    return F.when(~F.isnan(x), x)


def to_number(x: str | Column) -> Column:
    """Text as double: surrounding spaces ignored, anything that isn't a decimal number is null."""
    x = F.trim(c(x) if isinstance(x, str) else x)
    # from digit to digit a cast takes decimal numbers and hexadecimal ones only; patterns, which are slow, judge the rest
    ends = F.substring(x, 1, 1).isin(*"0123456789.+-") & F.substring(x, -1, 1).isin(*"0123456789.") & ~F.contains(x, F.lit("x")) & ~F.contains(x, F.lit("X"))
    plain = x.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(Inf|inf|Infinity)$")
    return F.when(ends, _try_double(x)).when(plain, F.expr("1.0D") * _try_double(F.regexp_replace(x, "(?i)inf(inity)?$", "Infinity")))


def _try_double(x: Column) -> Column:
    return x.try_cast("double")


def as_numeric(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` with the named columns as doubles; bad text and NaN become null."""
    kinds = dict(df.dtypes)
    return df.withColumns({n: to_number(n) if kinds[n] == "string" else num(n) for n in names})


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame, max_levels: int = MAX_LEVELS) -> list[str]:
    """Text columns, and other non-numeric ones with few distinct values (one aggregation for all of them)."""
    others = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.NumericType | T.StringType | T.ArrayType | T.MapType | T.StructType)]
    counts = df.agg(*[F.count_distinct(c(n)).alias(n) for n in others]).first() if others else {}
    few = {n for n in others if counts[n] <= max_levels}
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) or f.name in few]


def common_numeric(left: DataFrame, right: DataFrame) -> list[str]:
    """Columns that are numeric on both sides, in the left order."""
    there = set(numeric_columns(right))
    return [n for n in numeric_columns(left) if n in there]


def require(df: DataFrame, names: Sequence[str], what: str = "columns") -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} not found: {', '.join(missing)}")


def clean_names(names: Sequence[str]) -> list[str]:
    """Names for people: no unit, dots and underscores as spaces, words capitalised (the rest of a word stays)."""
    spaced = [re.sub(r"[._]", " ", n.replace(".(Wt%)", "")) for n in names]
    return [re.sub(r"(^|\s)(\S)", lambda m: m[1] + m[2].upper(), s).strip() for s in spaced]


def safe_names(names: Sequence[str]) -> list[str]:
    """Names for machines: units stripped, other characters than letters, digits, dot and underscore as ``_``.

    Names that would collide are an error.
    """
    out = []
    for n in names:
        for ending in UNIT_ENDINGS:
            n = n.replace(ending, "")
        out.append(re.sub(r"[^A-Za-z0-9._]", "_", n))
    if len(set(out)) < len(out):
        raise ValueError(f"names collide after cleaning: {sorted(n for n in set(out) if out.count(n) > 1)}")
    return out


def rename_safe(df: DataFrame) -> DataFrame:
    return df.toDF(*safe_names(df.columns))


def rename_clean(df: DataFrame) -> DataFrame:
    return df.toDF(*clean_names(df.columns))


def log10_positive(x: str | Column) -> Column:
    """log10, null where it isn't defined."""
    x = num(x)
    return F.when(x > 0, F.log10(x))


def signif(x: float, digits: int = 3) -> float:
    """A scalar to so many significant digits, for labels."""
    return float(f"{x:.{digits - 1}e}")


def min_max(df: DataFrame, names: Sequence[str], suffix: str = "_norm") -> DataFrame:
    """Columns scaled to 0..1 over all rows (a constant column gives null)."""
    ends = df.agg(*[f(num(n)).alias(f"__{k}_{n}") for n in names for k, f in (("lo", F.min), ("hi", F.max))])
    out = df.crossJoin(F.broadcast(ends))  # one row
    scaled = {n + suffix: F.try_divide(num(n) - c(f"__lo_{n}"), c(f"__hi_{n}") - c(f"__lo_{n}")) for n in names}
    return out.withColumns(scaled).drop(*[f"__{k}_{n}" for n in names for k in ("lo", "hi")])


def tidy(df: DataFrame, ids: Sequence[str], values: dict[str, dict[str, Column | str]], key: str = "column") -> DataFrame:
    """One wide row per group as one row per entry: ``values`` maps an entry to its named columns."""
    rows = [F.struct(F.lit(k).alias(key), *[(c(x) if isinstance(x, str) else x).alias(n) for n, x in v.items()]) for k, v in values.items()]
    return df.select(*[c(i) for i in ids], F.inline(F.array(*rows)))
