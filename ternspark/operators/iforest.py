"""Isolation forest (Liu, Ting and Zhou 2008): bounded training, vectorised scoring of every row."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from ..functions.cols import c, common_numeric, num
from ..functions.moments import complete
from ..functions.quantiles import exact_quantiles, quantile_values
from ..sources.files import kept
from .outliers import _join_small

CONTAMINATION, TREES, SAMPLE, SEED = 0.1, 200, 256, 42
#: Rows that all trees choose from, as a multiple of what they take together, and rows that are walked down at once.
POOL, WALKED = 1, 256
#: Points of a group that are scored in one task.
BLOCK_ROWS = 200_000


@dataclass(frozen=True)
class Forest:
    """Trees as flat arrays (tree x node): split column (-1: leaf), split value, path length at a leaf. Children
    of node k are 2 k + 1 and 2 k + 2, so a forest is as deep as log2 of its sample and of fixed size."""

    names: tuple[str, ...]
    column: np.ndarray
    value: np.ndarray
    length: np.ndarray
    norm: float


def _mean_path(n: float) -> float:
    """The average path length of an unsuccessful search among n values."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _grow(x: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = 2 ** (depth + 1) - 1
    column, value, length = np.full(size, -1), np.zeros(size), np.zeros(size)
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        node, rows, level = todo.pop()
        own = x[rows]
        free = np.flatnonzero(own.min(0) < own.max(0)) if len(rows) else np.zeros(0, dtype=int)
        if level == depth or len(rows) <= 1 or not len(free):
            length[node] = level + _mean_path(len(rows))
            continue
        k = int(rng.choice(free))
        cutoff = rng.uniform(own[:, k].min(), own[:, k].max())
        column[node], value[node] = k, cutoff
        left = own[:, k] < cutoff
        todo += [(2 * node + 1, rows[left], level + 1), (2 * node + 2, rows[~left], level + 1)]
    return column, value, length


def train(ref: DataFrame, names: Sequence[str], trees: int = TREES, sample_size: int = SAMPLE, seed: int = SEED, key: Sequence[str] | None = None) -> Forest:
    """A forest of the complete reference rows. Each tree sees its own ``sample_size`` rows, those of lowest hash of the row
    and the tree, so the result doesn't depend on partitions.

    A hash of the row picks the rows (some `POOL` times ``trees * sample_size`` of them, or all) from which the trees
    take theirs; trees grow on executors, and only they reach the driver. Rows that are equal in ``key`` (default: all
    columns that can be hashed) stand or fall together; name a key to read fewer columns.
    """
    use = list(key) if key else [f.name for f in ref.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]
    rows = ref.where(complete(names)).select(*[num(n).alias(f"x{k}") for k, n in enumerate(names)], F.xxhash64(*map(c, use)).alias("row"))
    n = rows.count()
    if n == 0:
        raise ValueError("the reference has no complete row")
    size = min(sample_size, n)
    columns = [f"x{k}" for k in range(len(names))]
    depth = max(1, math.ceil(math.log2(max(2, size))))
    wanted = min(n, POOL * trees * size + 10 * math.isqrt(POOL * trees * size))
    pool = rows.where(_share(F.xxhash64(F.lit(seed), "row"), wanted / n))
    # of equal rows no tree can take more than its size
    pool = pool.groupBy(*columns, "row").count().withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("count"), F.lit(size)).cast("int")))).drop("count")
    some = min(1.0, (size + 8 * math.sqrt(size) + 8) / wanted)
    own = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("place", F.xxhash64(F.lit(seed), "tree", "row", "copy")).where(_share(F.col("place"), some))

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        tree = int(part["tree"].iloc[0])
        x = part.sort_values(["place", *columns]).head(size)[columns].to_numpy(dtype=np.float64)
        column, value, length = _grow(x, depth, np.random.default_rng(seed + tree))
        return pd.DataFrame({"tree": [tree], "split": [column.tolist()], "value": [value.tolist()], "length": [length.tolist()]})

    # a number of partitions of our own: the rows are few bytes, but growing trees is work that Spark would put in one task
    own = own.repartition(min(trees, ref.sparkSession.sparkContext.defaultParallelism), "tree")
    built = own.groupBy("tree").applyInPandas(grow, "tree int, split array<long>, value array<double>, length array<double>").orderBy("tree").collect()  # ``trees`` rows
    return Forest(tuple(names), *[np.array([r[k] for r in built]) for k in ("split", "value", "length")], _mean_path(size) or 1.0)


def _share(hashed: Column, share: float) -> Column:
    """Whether a 64-bit hash lies in the lowest share of all."""
    return F.lit(True) if share >= 1 else F.shiftrightunsigned(hashed, 11) < int(share * (1 << 53))


def score_batch(forest: Forest, x: np.ndarray) -> np.ndarray:
    """Scores of rows: all trees are walked together, a level at a time, as one matrix of rows by trees."""
    trees, size = forest.column.shape
    base = np.arange(trees) * size
    inner = forest.column >= 0
    column = np.where(inner, forest.column, 0).ravel()
    value = forest.value.ravel()
    node = np.arange(size)
    # a leaf is its own child, so all walks take the same number of steps
    child = np.where(inner[:, :, None], (2 * node + 1)[None, :, None] + np.arange(2)[None, None, :], node[None, :, None]) + base[:, None, None]
    child = child.reshape(-1)
    length = forest.length.ravel()
    steps = int(math.log2(size + 1)) - 1
    out = np.empty(len(x))
    p = x.shape[1]
    for start in range(0, len(x), WALKED):
        part = np.ascontiguousarray(x[start : start + WALKED])
        flat, row = part.ravel(), (np.arange(len(part)) * p)[:, None]
        at = np.broadcast_to(base, (len(part), trees))
        for _ in range(steps):
            right = flat[row + column[at]] >= value[at]
            at = child[2 * at + right]
        out[start : start + WALKED] = length[at].sum(axis=1)
    return np.power(2.0, -out / trees / forest.norm)


def score(forest: Forest) -> Column:
    """The score (0 to 1) as a column; null for incomplete rows."""
    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for parts in batches:
            x = np.column_stack([p.to_numpy(dtype=np.float64, na_value=np.nan) for p in parts])
            whole = ~np.isnan(x).any(axis=1)
            out = np.full(len(x), np.nan)
            if whole.any():
                out[whole] = score_batch(forest, x[whole])
            yield pd.Series(out).astype("Float64").mask(~whole)

    return run(*[num(n) for n in forest.names])


def usable_columns(ref: DataFrame, names: Sequence[str]) -> list[str]:
    """The columns that vary in the reference."""
    r = ref.agg(*[f(num(n)).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (("a", F.min), ("b", F.max))]).first()
    return [n for i, n in enumerate(names) if r[f"a{i}"] is not None and r[f"a{i}"] < r[f"b{i}"]]


def isolation_forest(data: DataFrame, ref: DataFrame | None = None, names: Sequence[str] | None = None, contamination: float = CONTAMINATION, trees: int = TREES,
                     sample_size: int = SAMPLE, seed: int = SEED, own_threshold: bool = False, out: str = "if_score", flag: str = "is_outlier") -> DataFrame:
    """Add score and flag. The threshold is the quantile 1 - contamination of the reference's scores, reached or
    exceeded by outliers; ``own_threshold`` takes it from the data's own scores, exceeded strictly, and asks for ten
    reference rows. Incomplete rows have no score and aren't outliers."""
    ref = data if ref is None else ref
    if not 0 < contamination < 1:
        raise ValueError("contamination lies between 0 and 1")
    columns = usable_columns(ref, list(names) if names else common_numeric(data, ref))
    if not columns:
        raise ValueError("no shared numeric column varies in the reference")
    if own_threshold and ref.where(complete(columns)).limit(10).count() < 10:
        raise ValueError("the reference has fewer than ten complete rows")
    forest = train(ref, columns, trees, sample_size, seed)
    scored = data.withColumn(out, score(forest))
    base = scored if own_threshold or ref is data else ref.withColumn(out, score(forest))
    limit = quantile_values(base.select(c(out)), [out], [1 - contamination])[out][0]
    beyond = F.col(out) > F.lit(limit) if own_threshold else F.col(out) >= F.lit(limit)
    return scored.withColumn(flag, F.coalesce(beyond, F.lit(False)))


def train_by(data: DataFrame, names: Sequence[str], by: str, trees: int = TREES, sample_size: int = SAMPLE, seed: int = SEED, least_rows: int = 1) -> DataFrame:
    """(group, rows, tree, split, value, length, norm): the forest of every group, the same that `train` grows of the group's
    rows alone. Groups with fewer than ``least_rows`` complete rows, or in which no column varies, have none.

    One job for all groups: a row takes part by its hash and its group's size, and every tree of every group is a task
    group of some ``sample_size`` rows, however large its group is.
    """
    use = [f.name for f in data.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]
    x = [f"x{k}" for k in range(len(names))]
    rows = data.where(complete(names)).select(c(by).alias("group"), *[num(n).alias(k) for n, k in zip(names, x, strict=True)], F.xxhash64(*map(c, use)).alias("row"))
    varies = [F.coalesce(F.min(k) < F.max(k), F.lit(False)) for k in x]
    sizes = rows.groupBy("group").agg(F.count("*").alias("rows"), F.greatest(*varies, F.lit(False)).alias("varies")).where(F.col("varies") & (F.col("rows") >= least_rows)).drop("varies")
    sizes = sizes.withColumn("size", F.least("rows", F.lit(sample_size)))
    asked = POOL * trees * F.col("size")
    sizes = sizes.withColumn("wanted", F.least("rows", asked + 10 * F.floor(F.sqrt(asked)))).withColumn("some", (F.col("size") + 8 * F.sqrt("size") + 8) / F.col("wanted"))
    pool = _join_small(rows, sizes, ["group"]).where("rows is not null")
    pool = pool.where(_share_of(F.xxhash64(F.lit(seed), "row"), F.col("wanted") / F.col("rows")))
    pool = pool.groupBy("group", "rows", "size", "some", *x, "row").count().withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("count", "size").cast("int")))).drop("count")
    own = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("place", F.xxhash64(F.lit(seed), "tree", "row", "copy")).where(_share_of(F.col("place"), F.col("some")))

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        tree, size = int(part["tree"].iloc[0]), int(part["size"].iloc[0])
        depth = max(1, math.ceil(math.log2(max(2, size))))
        points = part.sort_values(["place", *x]).head(size)[x].to_numpy(dtype=np.float64)
        column, value, length = _grow(points, depth, np.random.default_rng(seed + tree))
        return part.iloc[:1][["group", "rows", "tree"]].assign(split=[column.tolist()], value=[value.tolist()], length=[length.tolist()], norm=_mean_path(size) or 1.0)

    own = own.repartition(data.sparkSession.sparkContext.defaultParallelism, "group", "tree")
    kind = data.schema[by].dataType.simpleString()
    forests = own.groupBy("group", "tree").applyInPandas(grow, f"group {kind}, rows long, tree int, split array<long>, value array<double>, length array<double>, norm double")
    # ``trees`` rows a group, used twice
    return forests.checkpoint() if data.sparkSession.sparkContext.getCheckpointDir() else forests


def _share_of(hashed: Column, share: Column) -> Column:
    """`_share` of a column."""
    return (share >= 1) | (F.shiftrightunsigned(hashed, 11) < F.floor(share * float(1 << 53)))


def score_by(data: DataFrame, forests: DataFrame, names: Sequence[str], by: str, out: str = "if_score") -> DataFrame:
    """Add the score by the forest of each row's group (see `train_by`); null for incomplete rows and without a forest.

    A group's different points are dealt to blocks of some `BLOCK_ROWS`, each of which meets its forest in a task; scores
    are joined to the rows by group and values, one row for each of them. With a checkpoint folder points are scored once.
    """
    x = [f"__x{k}" for k in range(len(names))]
    rows = data.withColumns({k: num(n) for n, k in zip(names, x, strict=True)})
    parts = F.ceil(F.col("rows") / BLOCK_ROWS).cast("int")
    blocks = forests.groupBy("group").agg(F.max(parts).alias("parts"))
    points = rows.where(complete(names)).select(c(by).alias("group"), *x).distinct()
    points = _join_small(points, blocks, ["group"]).where("parts is not null").withColumn("block", F.pmod(F.xxhash64(*x), F.col("parts")).cast("int")).drop("parts")
    dealt = forests.withColumn("block", F.explode(F.sequence(F.lit(0), parts - 1)))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        trees = right.sort_by("tree")
        made = [np.array(trees.column(k).to_pylist()) for k in ("split", "value", "length")]
        scores = np.zeros(0)
        if left.num_rows:
            scores = score_batch(Forest(tuple(names), *made, trees.column("norm")[0].as_py()), np.column_stack([left.column(k).to_numpy() for k in x]))
        return left.drop_columns(["block"]).append_column("score", pa.array(scores, type=pa.float64()))

    kind = data.schema[by].dataType.simpleString()
    scores = points.groupBy("group", "block").cogroup(dealt.groupBy("group", "block")).applyInArrow(run, f"group {kind}, {', '.join(f'{k} double' for k in x)}, score double")
    scores = kept(scores).select(F.col("group").alias("__group"), *[F.col(k).alias(f"__s{k}") for k in x], F.col("score").alias(out))
    on = c(by).eqNullSafe(F.col("__group"))
    for k in x:
        on = on & (F.col(k) == F.col(f"__s{k}"))
    return rows.drop(out).join(scores, on, "left").drop("__group", *x, *[f"__s{k}" for k in x])


def isolation_forest_by(data: DataFrame, names: Sequence[str], by: str, contamination: float = CONTAMINATION, trees: int = TREES, sample_size: int = SAMPLE, seed: int = SEED,
                        own_threshold: bool = False, out: str = "if_score", flag: str = "is_outlier") -> DataFrame:
    """`isolation_forest` of every group against itself, all groups in one job. Groups that it would raise an error for (no
    column varies; with ``own_threshold``, under ten complete rows) have no scores and no outliers."""
    if not 0 < contamination < 1:
        raise ValueError("contamination lies between 0 and 1")
    forests = train_by(data, names, by, trees, sample_size, seed, 10 if own_threshold else 1)
    scored = score_by(data, forests, names, by, out)
    limits = exact_quantiles(kept(scored.select(c(by), c(out))), [out], [1 - contamination], [by]).select(c(by), F.col("value").alias("__limit"))
    both = _join_small(scored, limits, [by])
    beyond = F.col(out) > F.col("__limit") if own_threshold else F.col(out) >= F.col("__limit")
    return both.withColumn(flag, F.coalesce(beyond, F.lit(False))).drop("__limit")
