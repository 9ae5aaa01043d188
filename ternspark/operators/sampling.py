"""Bounded samples and user functions over chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.cols import c, num

MAX_ROWS, PREVIEW_ROWS, CHUNK_ROWS, SEED = 100_000, 20_000, 10_000, 42


def bounded_sample(df: DataFrame, key: Sequence[str], max_rows: int = MAX_ROWS, seed: int = SEED) -> DataFrame:
    """All rows if there are at most ``max_rows``, else exactly so many, the same each run: the smallest hashes of
    the key. A top-k per partition, not a global sort."""
    if df.limit(max_rows + 1).count() <= max_rows:
        return df
    return df.orderBy(F.xxhash64(F.lit(seed), *map(c, key)), *map(c, key)).limit(max_rows)


def sample_report(df: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(rows, kept, sampled) of a bounded sample."""
    return df.agg(F.count("*").alias("rows")).select("rows", F.least("rows", F.lit(max_rows)).alias("kept"), (F.col("rows") > max_rows).alias("sampled"))


def map_chunks(df: DataFrame, operation: Callable[[pd.DataFrame], pd.DataFrame], schema: str | StructType, chunk_rows: int = CHUNK_ROWS, skip_failures: bool = False) -> DataFrame:
    """A function of a chunk over all chunks, results one under the other. Chunk edges are arbitrary.

    With ``skip_failures`` the result has a further column ``__failed``: null for results, and one row with the
    error's name for each chunk that failed.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), chunk_rows):
                chunk = batch.iloc[start : start + chunk_rows].reset_index(drop=True)
                if not skip_failures:
                    yield operation(chunk)
                    continue
                try:
                    yield operation(chunk).assign(__failed=None)
                except Exception as e:  # reported as a row
                    yield pd.DataFrame({n: [None] for n in names} | {"__failed": [type(e).__name__]})

    wanted = df.sparkSession.createDataFrame([], schema).schema
    names = wanted.names
    return df.mapInPandas(run, StructType(wanted.fields).add("__failed", "string") if skip_failures else wanted)


def map_groups(df: DataFrame, by: Sequence[str], operation: Callable[[pd.DataFrame], pd.DataFrame], schema: str | StructType) -> DataFrame:
    """A function of each group's rows; a group must fit one worker."""
    return df.groupBy(*map(c, by)).applyInPandas(operation, schema)


def top_groups(df: DataFrame, name: str, n: int = 10) -> DataFrame:
    """(group, n): the most frequent values, ties by value (null first); groups are counted before they are sorted."""
    return df.groupBy(c(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c(name)).limit(n)


def partition_sum(df: DataFrame, value: str, by: Sequence[str], out: str = "total") -> DataFrame:
    """Add to each row the sum of a column over its group. Sums are made per group and joined back, so that no task holds
    the rows of a group."""
    sums = df.groupBy(*[c(b).alias(f"__by{k}") for k, b in enumerate(by)]).agg(F.sum(num(value)).alias(out))
    same = F.lit(True)
    for k, b in enumerate(by):
        same = same & c(b).eqNullSafe(F.col(f"__by{k}"))
    return df.join(sums, same, "left").drop(*[f"__by{k}" for k in range(len(by))])
