"""Positions inside large groups without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of the MD5 that name a cell: a group is numbered in up to 16**4 pieces.
CELL_DIGITS = 4
#: Places of a run in a cell, where rows have a place.
CELL_PLACES = 4096


def shuffled_key(key: str, size: str | None = None) -> Column:
    """A fixed pseudo-random order of rows: MD5 of the key as text (null counts as empty), with the size if named.

    With the size, rows that share a key, or have none, are spread too unless they are of one size.
    """
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.md5(text if size is None else F.concat(text, F.lit(":"), F.col(size).cast("string")))


def running_totals(df: DataFrame, group: str, key: str, size: str, out: str, total: str | None = None, place: tuple[str, str] | None = None, tie: str | None = None) -> DataFrame:
    """Add ``out``: the sum of ``size`` over the rows before this one in its ``group``, in `shuffled_key` order of key and ``tie`` (default: ``size``).

    Each group is cut into cells by hash; cells are summed first (partial aggregation), then rows are
    numbered inside their cell, so no task holds a group. ``total`` names a column for the group's sum.
    Rows with equal key and tie are interchangeable. ``place`` names two columns whose order counts instead
    of the hash: runs of rows, and a row's place (from 0) in its run; a run is cut into cells by place.
    """
    tie = tie or size
    if place is None:
        cells = df.withColumn("__h", shuffled_key(key, tie)).withColumn("__cell", F.substring("__h", 1, CELL_DIGITS))
    else:
        cells = df.withColumn("__h", F.col(place[1])).withColumn("__cell", F.struct(F.col(place[0]).alias("run"), F.floor(F.col(place[1]) / CELL_PLACES).alias("piece")))
    in_group = Window.partitionBy(group)
    offsets = (
        cells.groupBy(group, "__cell").agg(F.sum(size).alias("__sum"))
        .withColumn("__base", F.sum("__sum").over(in_group.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)))
    )
    if total:
        offsets = offsets.withColumn(total, F.sum("__sum").over(in_group))
    offsets = offsets.drop("__sum")
    in_cell = Window.partitionBy(group, "__cell").orderBy("__h", key, tie).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cells.join(offsets, [group, "__cell"])
        .withColumn(out, F.coalesce("__base", F.lit(0)) + F.coalesce(F.sum(size).over(in_cell), F.lit(0)))
        .drop("__h", "__cell", "__base")
    )
