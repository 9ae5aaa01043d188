"""Exact positions in large sorted tables, and sums over ranges of a column, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that are numbered in one range, ranges at most, and rows of the sample that ranges are found by, for each of them.
RANGE_ROWS, MOST_RANGES, SAMPLED = 1_000_000, 4096, 32


def numbered(df: DataFrame, order: Sequence[Column], out: str, range_rows: int = RANGE_ROWS, within: str | None = None) -> DataFrame:
    """``df`` with the place (from 1) of each row in an ascending order, nulls first; rows of equal keys follow a hash of
    the whole row, and rows equal in all columns are interchangeable.

    Rows fall into ranges between keys of a sample (picked by hash), are numbered inside their range, and the rows of all
    ranges before are added. Each range is a function of the row, so recomputed tasks agree. With ``within``, the column by
    which the order begins, each of its values begins anew: only one that holds an edge has rows in a range before.
    """
    taken = {*df.columns, out}
    key_, range_, at_, own_, size_, before_, place_ = (_free(n, taken) for n in ("__key", "__range", "__at", "__own", "__size", "__before", "__place"))
    key = F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)], F.xxhash64(*[F.col(f"`{n}`") for n in df.columns]).alias("tie"))
    rows = df.withColumn(key_, key)
    own = F.col(key_)["k0"] if within else F.lit(0)
    n = df.count()
    ranges = min(MOST_RANGES, -(-n // range_rows))
    if ranges <= 1:
        return rows.withColumn(out, F.row_number().over(Window.partitionBy(own).orderBy(key_)).cast("long")).drop(key_)  # at most ``range_rows`` rows
    share = F.pmod(F.xxhash64(F.lit(3), key_), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLED * ranges / n))
    sample = [r[0] for r in rows.where(share).select(key_).orderBy(key_).collect()]  # bounded: SAMPLED for each range
    edges = [sample[k * len(sample) // ranges] for k in range(1, ranges)] if sample else []
    kind = rows.schema[key_].dataType
    rows = rows.withColumn(range_, range_of(F.col(key_), F.array(*[_literal(e, kind) for e in edges]), len(edges)) if edges else F.lit(0))
    cut = rows.where(own.isin([v for v in {e["k0"] for e in edges} if v is not None]) | (own.isNull() if None in {e["k0"] for e in edges} else F.lit(False))) if within else rows
    sizes = cut.groupBy(F.col(range_).alias(at_), own.alias(own_)).agg(F.count("*").alias(size_))
    earlier = Window.partitionBy(own_).orderBy(at_).rowsBetween(Window.unboundedPreceding, -1)
    before = F.broadcast(sizes.select(at_, own_, F.coalesce(F.sum(size_).over(earlier), F.lit(0)).alias(before_)))  # at most two rows for each range
    place = F.row_number().over(Window.partitionBy(range_, own).orderBy(key_))
    placed = rows.withColumn(place_, place).join(before, (F.col(range_) == F.col(at_)) & own.eqNullSafe(F.col(own_)), "left")
    return placed.withColumn(out, (F.coalesce(before_, F.lit(0)) + F.col(place_)).cast("long")).drop(key_, range_, at_, own_, place_, before_)


def _free(name: str, taken: set[str]) -> str:
    """A name for a column of our own that the table, or the result, doesn't have."""
    while name in taken:
        name += "_"
    return name


def _literal(value, kind) -> Column:
    return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(value, kind.fields, strict=True)])


def range_of(key: Column, edges: Column, n: int) -> Column:
    """How many of ``n`` ascending edges the key reaches, by bisection.

    The key is carried in the state: of a table joined with itself Spark infers wrong filters from columns that a lambda
    names from outside.
    """
    steps = F.array(*[F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)])

    def step(state: Column, s: Column) -> Column:
        at = state["at"]
        return F.struct(F.when((at + s <= n) & (state["key"] >= F.get(edges, at + s - 1)), at + s).otherwise(at).alias("at"), state["key"].alias("key"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), key.alias("key")), step, lambda state: state["at"])


class Sums:
    """What `range_sums` gives for each range: rows, least and greatest x, and sums of powers about the range's middle.

    ``power[i, p]`` is the sum of ((x - middle) / half)^p over the rows of range i, ``moment[i, p]`` that of y times it;
    range i lies from edge i - 1 (included) to edge i.
    """

    def __init__(self, n: int, powers: int, moments: int) -> None:
        self.rows = np.zeros(n, dtype=np.int64)
        self.low, self.high = np.full(n, np.inf), np.full(n, -np.inf)
        self.power, self.moment = np.zeros((n, powers)), np.zeros((n, moments))


def middles(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The middle and half the width of each range; of the two open ones, their edge and 1."""
    mid, half = np.zeros(len(edges) + 1), np.ones(len(edges) + 1)
    if len(edges):
        mid[0], mid[-1] = edges[0], edges[-1]
        mid[1:-1], half[1:-1] = edges[:-1] / 2 + edges[1:] / 2, np.maximum(edges[1:] / 2 - edges[:-1] / 2, np.finfo(float).tiny)
    return mid, half


def range_sums(df: DataFrame, edges: np.ndarray, powers: int = 0, moments: int = 0) -> Sums:
    """Sums of the rows (x, y) in each range between ascending edges, in one pass: every task adds up its rows in arrays of
    the size of the ranges, and these are added. Both columns are doubles without nulls."""
    n = len(edges) + 1
    mid, half = middles(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Sums(n, powers, moments)
        for batch in batches:
            x, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at = np.searchsorted(edges, x, side="right")
            own.rows += np.bincount(at, minlength=n)
            np.minimum.at(own.low, at, x)
            np.maximum.at(own.high, at, x)
            if powers or moments:
                u = np.clip((x - mid[at]) / half[at], -1.0, 1.0)
                term = np.ones(len(x))
                for p in range(max(powers, moments)):
                    if p < powers:
                        own.power[:, p] += np.bincount(at, weights=term, minlength=n)
                    if p < moments:
                        own.moment[:, p] += np.bincount(at, weights=term * y, minlength=n)
                    term = term * u
        there = np.flatnonzero(own.rows)
        lists = [pa.array(list(a[there]), type=pa.list_(pa.float64())) for a in (own.power, own.moment)]
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(own.rows[there]), pa.array(own.low[there]), pa.array(own.high[there]), *lists], names=["at", "n", "low", "high", "power", "moment"])

    parts = df.mapInArrow(run, "at int, n long, low double, high double, power array<double>, moment array<double>")
    wide = parts.groupBy("at").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), *[F.sum(F.get(c, F.lit(p))).alias(f"{c}{p}") for c, k in (("power", powers), ("moment", moments)) for p in range(k)])
    out = Sums(n, powers, moments)
    for r in wide.collect():  # a row for each range
        out.rows[r["at"]], out.low[r["at"]], out.high[r["at"]] = r["n"], r["low"], r["high"]
        for c, k in (("power", powers), ("moment", moments)):
            for p in range(k):
                getattr(out, c)[r["at"], p] = r[f"{c}{p}"]
    return out
