"""Simple predicates and the filter funnel."""

from __future__ import annotations

import operator
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cols import c, num, require, to_number

OPERATORS = {">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le, "==": operator.eq, "!=": operator.ne}
_FILTER = re.compile(r"^\s*(>=|<=|==|!=|>|<)\s*(.+?)\s*$")


@dataclass(frozen=True)
class Element:
    """An axis: the sum of one or more columns, with one filter for all of them or one for each."""

    cols: Sequence[str]
    filter: str | None = None
    filters: Mapping[str, str] = field(default_factory=dict)


def parse_filter(text: str, lenient: bool = False) -> tuple[str, float]:
    """(operator, value) of a filter such as ``"> 10"``; ``lenient`` strips other characters from the value."""
    m = _FILTER.match(text)
    if not m:
        raise ValueError(f"a filter is an operator and a number: {text!r}")
    op, value = m.groups()
    try:
        return op, float(value)
    except ValueError:
        digits = re.sub(r"[^0-9.\-]", "", value) if lenient else ""
        try:
            return op, float(digits)
        except ValueError:
            raise ValueError(f"not a number: {value!r}") from None


def value_of(df: DataFrame, name: str) -> Column:
    return to_number(name) if dict(df.dtypes)[name] == "string" else num(name)


def condition(df: DataFrame, name: str, text: str, lenient: bool = False) -> Column:
    require(df, [name])
    op, value = parse_filter(text, lenient)
    return OPERATORS[op](value_of(df, name), F.lit(value))


def apply_filter(df: DataFrame, name: str, text: str | None) -> DataFrame:
    """Rows of which a column meets ``"<operator> value"``; no filter keeps all. Missing values never meet one."""
    return df if text is None or not text.strip() else df.where(condition(df, name, text))


def element_condition(df: DataFrame, element: Element) -> Column | None:
    """The element's filters, ANDed: those of its own columns, else its one filter for every column."""
    own = {n: f for n, f in element.filters.items() if n in element.cols and f}
    if own:
        parts = [condition(df, n, f, lenient=True) for n, f in own.items()]
    elif element.filter:
        parts = [condition(df, n, element.filter, lenient=True) for n in element.cols]
    else:
        return None
    return reduce(operator.and_, parts)


def filter_elements(df: DataFrame, elements: Sequence[Element]) -> DataFrame:
    """Rows that meet the filters of all elements, in one predicate that reaches the scan."""
    parts = [p for p in (element_condition(df, e) for e in elements) if p is not None]
    return df.where(reduce(operator.and_, parts)) if parts else df


def filter_columns(df: DataFrame, filters: Mapping[str, str]) -> DataFrame:
    """Every named filter in turn."""
    return reduce(lambda d, f: apply_filter(d, f[0], f[1]), filters.items(), df)


def filter_optional(df: DataFrame, names: Sequence[str], text: str | None) -> DataFrame:
    """The filter of an optional parameter on each of its columns; text that isn't a filter is ignored."""
    if not text or not re.match(r"^\s*[<>=!]", text):
        return df
    return df.where(reduce(operator.and_, [condition(df, n, text) for n in names]))


def strip_count(label: str) -> str:
    """``"name (12 samples)"`` -> ``"name"``."""
    return re.sub(r"\s*\([^()]*\)\s*$", "", label)


def keep_groups(df: DataFrame, name: str, labels: Sequence[str]) -> DataFrame:
    """Rows of the chosen groups; labels may carry a trailing parenthesis. If none matches, all rows stay."""
    require(df, [name])
    kept = df.where(c(name).isin([strip_count(x) for x in labels]))
    return df if not labels or kept.isEmpty() else kept


def element_sum(df: DataFrame, cols: Sequence[str]) -> Column:
    """The sum of columns, missing values counting as 0."""
    return reduce(operator.add, [F.coalesce(value_of(df, n), F.lit(0.0)) for n in cols])


def drop_empty_sums(df: DataFrame, elements: Sequence[Element]) -> DataFrame:
    """Rows of which every element sums to more than 0 and no needed column is missing."""
    needed = list(dict.fromkeys(n for e in elements for n in e.cols))
    positive = reduce(operator.and_, [element_sum(df, e.cols) > 0 for e in elements])
    present = reduce(operator.and_, [value_of(df, n).isNotNull() for n in needed])
    return df.where(positive & present)


def funnel(df: DataFrame, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """(step, stage, rows, percent) left after each stage in turn, from one pass."""
    held, aggs = F.lit(True), [F.count("*").alias("s0")]
    for k, (_, cond) in enumerate(stages, 1):
        held = held & F.coalesce(cond, F.lit(False))
        aggs.append(F.count_if(held).alias(f"s{k}"))
    names = ["input", *[n for n, _ in stages]]
    rows = F.array(*[F.struct(F.lit(k).alias("step"), F.lit(n).alias("stage"), c(f"s{k}").alias("rows"), F.bround(F.try_divide(100.0 * c(f"s{k}"), c("s0")), 2).alias("percent")) for k, n in enumerate(names)])
    return df.agg(*aggs).select(F.inline(rows))


def complete_cases(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(rows, complete, percent) over the chosen columns."""
    require(df, names)
    whole = reduce(operator.and_, [value_of(df, n).isNotNull() if dict(df.dtypes)[n] != "string" else c(n).isNotNull() for n in names])
    return df.agg(F.count("*").alias("rows"), F.count_if(whole).alias("complete")).withColumn("percent", F.bround(F.try_divide(100.0 * F.col("complete"), F.col("rows")), 2))
