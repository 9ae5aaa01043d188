"""Exact quantiles (linear interpolation between order statistics) that don't build one giant map."""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .cols import c, num, tidy

#: Rows of a group up to which the built-in exact percentile is used; beyond it, ranks are counted inside brackets.
DIRECT_ROWS = 5_000_000
#: Half the width of a bracket, in probability, and the size of the sketch that finds its ends.
BRACKET, SKETCH = 0.002, 4000
#: Values of a bracket that may reach the driver; wider ones are cut into `CELLS` and narrowed to the one that counts.
MOST, CELLS = 10_000, 256


def exact_quantiles(df: DataFrame, names: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """(by..., column, prob, value), one row per group, column and probability; null for columns without values.

    The value at rank (n - 1) p, interpolated. Without groups, and for groups of over ``direct_rows`` rows (so at most
    rows / ``direct_rows`` groups), brackets around each quantile are narrowed until few values are left (see
    `_narrowed`); for all others ``percentile`` keeps a map of a group's values, at most ``direct_rows``.
    """
    if not by:
        found = quantile_values(df, names, probs)
        rows = [F.struct(F.lit(n).alias("column"), F.lit(float(p)).alias("prob"), F.lit(v).cast("double").alias("value")) for n in names for p, v in zip(probs, found[n], strict=True)]
        return df.sparkSession.range(1).select(F.inline(F.array(*rows)))
    keys = df.select(*[c(b) for b in by])
    large = keys.groupBy(*[c(b) for b in by]).count().where(F.col("count") > direct_rows).drop("count").collect()
    if not large:
        return _direct(df, names, probs, by)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.schema.fields)
    groups = F.broadcast(df.sparkSession.createDataFrame([(*r, k) for k, r in enumerate(large)], f"{kinds}, __g int"))  # at most rows / direct_rows
    same = F.lit(True)
    for b in by:
        same = same & F.col(f"v.`{b}`").eqNullSafe(F.col(f"w.`{b}`"))
    rows = df.alias("v").join(groups.alias("w"), same).select("w.__g", *[num(F.col(f"v.`{n}`")).alias(f"x{k}") for k, n in enumerate(names)])
    found = _narrowed(rows, len(names), probs)
    made = [(*r, n, float(p), found[g, k][j]) for g, r in enumerate(large) for k, n in enumerate(names) for j, p in enumerate(probs)]
    out = df.sparkSession.createDataFrame(made, f"{kinds}, column string, prob double, value double")
    rest = df.alias("v").join(groups.alias("w"), same, "left_anti")
    return _direct(rest, names, probs, by).unionByName(out)


def _direct(df: DataFrame, names: Sequence[str], probs: Sequence[float], by: Sequence[str]) -> DataFrame:
    wide = df.groupBy(*[c(b) for b in by]).agg(*[F.percentile(num(n), [float(p) for p in probs]).alias(f"q{k}") for k, n in enumerate(names)])
    long = tidy(wide, by, {n: {"v": f"q{k}"} for k, n in enumerate(names)})
    points = F.arrays_zip(F.array(*[F.lit(float(p)) for p in probs]).alias("prob"), F.coalesce("v", F.array(*[F.lit(None).cast("double")] * len(probs))).alias("value"))
    return long.select(*[c(b) for b in by], "column", F.inline(points))


def quantile_values(df: DataFrame, names: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Global quantiles as scalars."""
    found = _narrowed(df.select(*[num(n).alias(f"x{k}") for k, n in enumerate(names)]), len(names), probs)
    return {n: found[0, k] for k, n in enumerate(names)}


@dataclass
class _Target:
    """A quantile on its way: group, column x, the two ranks wanted, the values found for them, and the bracket that
    holds the ranks, with the numbers of values below and inside."""

    g: int
    x: int
    low: int
    high: int
    part: float
    lo: float
    hi: float
    below: int = 0
    inside: int = 0
    got: list[float] = field(default_factory=list)

    def value(self) -> float:
        a, b = self.got
        return a if self.low == self.high or a == b else a + self.part * (b - a)

    def settle(self, values: Sequence[tuple[float, int]]) -> None:
        """Take the values at both ranks from the bracket's ascending values and their counts."""
        upto = self.below
        for x, n in values:
            upto += n
            while len(self.got) < 2 and upto > (self.low, self.high)[len(self.got)]:
                self.got.append(float(x))


class _Brackets:
    """Brackets of many targets as columns: literals where there is one group, else beside the rows by a broadcast join of a
    row for each group."""

    def __init__(self, rows: DataFrame, targets: Sequence[_Target]) -> None:
        self.grouped = "__g" in rows.columns
        self.slots: dict[tuple[int, int], list[_Target]] = {}  # (column, place among the column's targets of a group)
        places: dict[tuple[int, int], int] = {}
        for t in targets:
            k = places[t.g, t.x] = places.get((t.g, t.x), -1) + 1
            self.slots.setdefault((t.x, k), []).append(t)
        self.keys = sorted(self.slots)
        self.at = {(t.g, i): t for i, key in enumerate(self.keys) for t in self.slots[key]}
        if self.grouped:
            table = [(g, *[v for i in range(len(self.keys)) for v in ((self.at[g, i].lo, self.at[g, i].hi) if (g, i) in self.at else (None, None))]) for g in sorted({t.g for t in targets})]
            schema = "__g int, " + ", ".join(f"lo{i} double, hi{i} double" for i in range(len(self.keys)))
            self.rows = rows.join(F.broadcast(rows.sparkSession.createDataFrame(table, schema)), "__g")
        else:
            self.rows = rows.withColumn("__g", F.lit(0))

    def ends(self, i: int) -> tuple[Column, Column]:
        if self.grouped:
            return F.col(f"lo{i}"), F.col(f"hi{i}")
        t = self.at[0, i]
        return F.lit(t.lo), F.lit(t.hi)

    def x(self, i: int) -> Column:
        return F.col(f"x{self.keys[i][0]}")

    def holds(self, i: int) -> Column:
        lo, hi = self.ends(i)
        return (self.x(i) >= lo) & (self.x(i) <= hi)

    def held(self, value: Column | None) -> DataFrame:
        """(group, slot, value): a row for each value in a bracket."""
        each = F.array(*[F.when(self.holds(i), F.struct(F.lit(i).alias("i"), self.x(i).alias("x"), (F.lit(0) if value is None else _cell(self.x(i), *self.ends(i))).alias("cell"))) for i in range(len(self.keys))])
        return self.rows.select("__g", F.explode(F.filter(each, lambda s: s.isNotNull())).alias("s")).select("__g", "s.*")


def _cell(x: Column, lo: Column, hi: Column) -> Column:
    """The part of a bracket that a value lies in; infinite values have their own."""
    most = sys.float_info.max
    lo, hi = F.greatest(lo, F.lit(-most)) / 2, F.least(hi, F.lit(most)) / 2
    inner = F.least(F.lit(CELLS), 1 + F.floor(CELLS * F.try_divide(x / 2 - lo, hi - lo)).cast("int"))
    return F.when(x == -math.inf, 0).when(x == math.inf, CELLS + 1).otherwise(F.coalesce(inner, F.lit(1)))


def _narrowed(rows: DataFrame, columns: int, probs: Sequence[float]) -> dict[tuple[int, int], list[float | None]]:
    """Of each group (``__g``; without such a column there is one) and column ``x<k>`` the quantiles.

    One pass counts and sketches; quantiles 0 and 1 are the ends. The next counts what lies below and inside brackets of
    some 0.4 % of the rows (an end that was too far off moves to the column's). Brackets with over `MOST` values are cut
    into cells, and the cell that holds the ranks is the next bracket, until few values are left, which reach the driver:
    no task or group holds a share of the rows. Infinite values are values like others.
    """
    ends = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-BRACKET, BRACKET)})
    aggs = [f(F.col(f"x{k}")).alias(f"{a}{k}") for k in range(columns) for a, f in (("n", F.count), ("a", F.min), ("b", F.max))]
    for k in range(columns):
        sketch = F.kll_sketch_agg_double(F.col(f"x{k}"), F.lit(SKETCH))
        aggs.append(F.when(F.count(f"x{k}") > 0, F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(float(e)) for e in ends]))).alias(f"e{k}"))
    by = ["__g"] if "__g" in rows.columns else []
    facts: dict[int, Row] = {r["__g"] if by else 0: r for r in rows.groupBy(*by).agg(*aggs).collect()}
    every: dict[tuple[int, int, int], _Target] = {}
    for g, r in facts.items():
        for k in range(columns):
            n, first, last = r[f"n{k}"], r[f"a{k}"], r[f"b{k}"]
            for j, p in enumerate(probs if n else []):
                h = (n - 1) * p
                t = every[g, k, j] = _Target(g, k, math.floor(h), math.ceil(h), h - math.floor(h), first, last, 0, n)
                if first == last or t.high == 0 or t.low == n - 1:
                    t.got = [last if t.low == n - 1 else first] * 2
                elif n > MOST:
                    lo, hi = (ends.index(min(1.0, max(0.0, p + d))) for d in (-BRACKET, BRACKET))
                    t.lo = r[f"e{k}"][lo] if p > BRACKET else first
                    t.hi = r[f"e{k}"][hi] if p < 1 - BRACKET else last
    todo = [t for t in every.values() if not t.got and facts[t.g][f"n{t.x}"] > MOST]
    while todo:
        b = _Brackets(rows, todo)
        counted = b.rows.groupBy("__g").agg(*[F.count_if(cond).alias(f"{a}{i}") for i in range(len(b.keys)) for a, cond in (("below", b.x(i) < b.ends(i)[0]), ("inside", b.holds(i)))]).collect()
        found = {r["__g"]: r for r in counted}
        todo = []
        for (g, i), t in b.at.items():
            t.below, t.inside = found[g][f"below{i}"], found[g][f"inside{i}"]
            if t.below > t.low or t.high >= t.below + t.inside:
                t.lo, t.hi = (facts[g][f"a{t.x}"] if t.below > t.low else t.lo), (facts[g][f"b{t.x}"] if t.high >= t.below + t.inside else t.hi)
                todo.append(t)
    while todo := [t for t in every.values() if not t.got and t.inside > MOST and t.lo < t.hi]:
        b = _Brackets(rows, todo)
        cells = b.held(F.lit(1)).groupBy("__g", "i", "cell").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()  # `CELLS` and two rows for each target
        of: dict[tuple[int, int], list[Row]] = {}
        for r in cells:
            of.setdefault((r["__g"], r["i"]), []).append(r)
        for at, t in b.at.items():
            upto, picked = t.below, []
            for r in sorted(of[at], key=lambda r: r["cell"]):
                while len(picked) < 2 and (t.low, t.high)[len(picked)] < upto + r["n"]:
                    picked.append((r, upto))
                upto += r["n"]
            (one, before), (other, _) = picked
            if one["cell"] != other["cell"]:  # the ranks are the last of one cell and the first of the next
                t.got = [one["hi"], other["lo"]]
            else:
                t.lo, t.hi, t.below, t.inside = one["lo"], one["hi"], before, one["n"]
    open_ = [t for t in every.values() if not t.got and t.lo < t.hi]
    if open_:
        b = _Brackets(rows, open_)
        values: dict[tuple[int, int], list[tuple[float, int]]] = {}
        for r in b.held(None).groupBy("__g", "i", "x").count().collect():  # at most `MOST` values for each target
            values.setdefault((r["__g"], r["i"]), []).append((r["x"], r["count"]))
        for at, t in b.at.items():
            t.settle(sorted(values[at]))
    for t in every.values():
        if not t.got:
            t.got = [t.lo, t.lo]
    return {(g, k): [every[g, k, j].value() if (g, k, j) in every else None for j in range(len(probs))] for g in facts for k in range(columns)}


def cut(x: Column, breaks: Sequence[float]) -> Column:
    """The number (from 1) of the right-closed interval between ascending breaks, the lowest break included."""
    inside = (x >= F.lit(float(breaks[0]))) & (x <= F.lit(float(breaks[-1])))
    above = F.lit(1)
    for b in breaks[1:-1]:
        above = above + F.when(x > F.lit(float(b)), 1).otherwise(0)
    return F.when(inside, above)
