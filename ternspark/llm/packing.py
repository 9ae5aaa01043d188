"""Operator 10: optimal length buckets and token-budget batches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordinals import running_totals

#: Number of length buckets.
BUCKETS = 12
#: Tokens in a batch, padding included.
TOKEN_BUDGET = 65_536


def boundaries(lengths: Sequence[int], counts: Sequence[int], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of the buckets that minimise the total padding, by dynamic programming (divide and conquer).

    ``lengths`` are the distinct lengths, ascending, with the rows of each. All buckets are used where there are
    lengths enough. Among equal costs the last bucket that starts earliest wins.
    """
    top = np.asarray(lengths, dtype=np.int64)
    count = np.asarray(counts, dtype=np.int64)
    n = np.concatenate([[0], np.cumsum(count)])
    s = np.concatenate([[0], np.cumsum(count * top)])
    m = len(top)
    best, starts = top * n[1:] - s[1:], [np.zeros(m, dtype=np.int64)]
    for k in range(1, min(buckets, m)):
        best, start = _next_bucket(best, k, top, n, s)
        starts.append(start)
    bounds, j = [], m - 1
    for start in reversed(starts):
        bounds.append(int(top[j]))
        j = int(start[j]) - 1
    return bounds[::-1]


def _next_bucket(best: np.ndarray, k: int, top: np.ndarray, n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least padding of cells 0..j in k + 1 buckets, and the cell at which the last of them starts, from ``best`` of k.

    The padding of one bucket over cells i..j satisfies the quadrangle inequality, so the earliest best start
    never falls as j rises: the middle of a range is solved first and bounds the starts of both halves. All
    ranges of a depth are solved at once, in O(m) numbers.
    """
    m = len(top)
    out, start = np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64)
    low, high, first, last = (np.array([x]) for x in (k, m - 1, k, m - 1))  # cells low..high start within first..last
    while len(low):
        mid = (low + high) // 2
        size = np.minimum(last, mid) - first + 1
        begin = np.cumsum(size) - size
        own = np.repeat(np.arange(len(mid)), size)
        i = first[own] + np.arange(len(own)) - begin[own]
        cost = best[i - 1] + top[mid][own] * (n[mid + 1][own] - n[i]) - (s[mid + 1][own] - s[i])
        least = np.minimum.reduceat(cost, begin)
        hits = np.flatnonzero(cost == least[own])
        at = i[hits[np.searchsorted(hits, begin)]]  # the earliest of equals
        out[mid], start[mid] = least, at
        low, high, first, last = (np.concatenate(x) for x in ((low, mid + 1), (mid - 1, high), (first, at), (at, last)))
        some = low <= high
        low, high, first, last = low[some], high[some], first[some], last[some]
    return out, start


def pack(docs: DataFrame, length: Column | None = None, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET, id: str = "doc_id", text: str = "text",
         place: tuple[Column, Column] | None = None) -> DataFrame:
    """Batches of documents of similar length: (id, n_tokens, bucket, padded_len, batch, place).

    ``length`` counts a row's tokens (default: UTF-8 bytes, the tokens of a byte-level model; null is 0).
    Bucket bounds minimise the padding over all rows: every distinct length may be a bound, whatever the longest
    text. The driver takes the histogram as arrays: at most sqrt(2 x tokens) lengths (some 245,000 for 30 GB, 14
    million, or 2 GB with the choices of 12 buckets, for 100 TB). Inside a bucket, batches take max(1, budget //
    padded_len) rows each in a fixed hash order of id and length, or in the order of ``place``: a run of rows, and
    the row's place in it. A text longer than the budget is a batch of its own and stays whole. Rows without tokens
    go to the first bucket. Equal rows are interchangeable; an empty table gives an empty table.
    """
    placed = [] if place is None else [place[0].alias("__run"), place[1].alias("__place")]
    rows = docs.select(F.col(id), F.coalesce(length if length is not None else F.octet_length(text), F.lit(0)).cast("long").alias("n_tokens"), *placed)
    histogram = rows.groupBy(F.greatest(F.lit(1), F.col("n_tokens")).cast("long").alias("length")).count()
    parts = histogram.groupBy((F.col("length") / 65_536).cast("long").alias("part")).agg(F.array_sort(F.collect_list(F.struct("length", "count"))).alias("all"))
    parts = parts.select("part", F.col("all.length").alias("lengths"), F.col("all.count").alias("counts")).orderBy("part").collect()
    lengths, counts = (np.concatenate([np.array(r[c], dtype=np.int64) for r in parts] or [np.ones(1, dtype=np.int64)]) for c in ("lengths", "counts"))
    bounds = boundaries(lengths, counts, buckets)
    bucket = F.lit(len(bounds) - 1)
    for k in reversed(range(len(bounds) - 1)):
        bucket = F.when(F.col("n_tokens") <= bounds[k], F.lit(k)).otherwise(bucket)
    rows = rows.withColumn("bucket", bucket.cast("long")).withColumn("padded_len", F.element_at(F.array(*[F.lit(b).cast("long") for b in bounds]), (F.col("bucket") + 1).cast("int")))
    rows = running_totals(rows.withColumn("__one", F.lit(1).cast("long")), "bucket", id, "__one", "__rank", place=("__run", "__place") if placed else None, tie="n_tokens")
    each = F.greatest(F.lit(1).cast("long"), F.expr(f"{budget}L div padded_len"))
    return rows.select(id, "n_tokens", "bucket", "padded_len", F.floor(F.col("__rank") / each).cast("long").alias("batch"), (F.col("__rank") % each).cast("long").alias("place"))
