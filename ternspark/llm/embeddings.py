"""Operator 6: near-duplicate vectors by random-hyperplane signatures in several tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .scratch import written

#: Least cosine of a link, chance that a pair at that cosine meets in no table, vectors aimed at in a bucket.
COSINE, MISS, BUCKET = 0.95, 1e-6, 128
#: Vectors of a block; pairs of blocks of the same bucket are compared in one task.
BLOCK = 512
#: Bits of the signature that go with a vector's number to its buckets, and rows of buckets that may be broadcast.
SKETCH, BROADCAST_BUCKETS = 128, 200_000
SEED = 20_240_601
#: Length of the mean of all vectors from which on they are compared by what they have beside it, too.
LEANING = 0.3


def plan(n: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables): buckets of about `BUCKET` vectors, tables enough for ``miss``."""
    bits = min(30, max(1, round(math.log2(max(2, n / BUCKET)))))
    together = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-together)))


def farthest(cosine: float = COSINE, bits: int = SKETCH, miss: float = MISS) -> int:
    """Signature bits of ``bits`` in which a pair at ``cosine`` differs at most, but with a probability of a tenth of ``miss``."""
    p, above = math.acos(max(-1.0, min(1.0, cosine))) / math.pi, 1.0
    for k in range(bits):
        above -= math.comb(bits, k) * p**k * (1 - p) ** (bits - k)
        if above <= miss / 10:
            return k
    return bits


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _normal(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that squares of very large or small components stay numbers."""
    x = x / np.abs(x).max(axis=1, initial=1e-320)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _signatures(x: np.ndarray, bits: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each vector in each table, and the first `SKETCH` bits of all tables."""
    planes = np.random.default_rng(SEED).standard_normal((x.shape[1], bits * tables))
    signs = x @ planes >= 0
    first = np.zeros((len(x), SKETCH), dtype=bool)
    first[:, : min(SKETCH, signs.shape[1])] = signs[:, :SKETCH]
    return (signs.reshape(len(x), tables, bits) << np.arange(bits)).sum(axis=2).astype(np.int32), np.packbits(first, axis=1, bitorder="little")


def _mean_of(classes: DataFrame) -> dict[int, np.ndarray]:
    """The mean of the vectors, of length 1 each, by their number of components."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                x = _normal(_vectors(batch.filter(pa.array(dims == dim)).column(0), dim))
                n, total = sums.get(dim, (0, np.zeros(dim)))
                sums[dim] = n + len(x), total + x.sum(axis=0)
        for dim, (n, total) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, type=pa.int32()), pa.array(range(dim), type=pa.int32()), pa.array([n] * dim, type=pa.int64()), pa.array(total)], names=["dim", "at", "n", "x"])

    out: dict[int, np.ndarray] = {}
    for r in classes.select("v", "dim").mapInArrow(run, "dim int, at int, n long, x double").groupBy("dim", "at").agg((F.sum("x") / F.sum("n")).alias("x")).collect():  # a row for each component
        out.setdefault(r["dim"], np.zeros(r["dim"]))[r["at"]] = r["x"]
    return out


def beside(x: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`SKETCH` signature bits of the vectors less their mean, and the lengths of what is left."""
    left = x - mean
    planes = np.random.default_rng(SEED + 1).standard_normal((x.shape[1], SKETCH))
    return np.packbits(left @ planes >= 0, axis=1, bitorder="little"), np.sqrt((left * left).sum(axis=1))


def limits_beside(cosine: float, miss: float) -> np.ndarray:
    """Bits in which sketches of `beside` may differ, by the cosine of what is left, from -1 on in steps of 1 / 32."""
    return np.array([farthest(max(-1.0, -1 + k / 32), SKETCH, miss) for k in range(65)], dtype=np.int16)


def _valid(vector: str) -> Column:
    ok = F.col(vector).isNotNull() & ~F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(ok & F.exists(vector, lambda v: v != 0), F.lit(False))


def _first_met(left: np.ndarray, right: np.ndarray, table: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the pairs (i, j) share no bucket in the tables before ``table``: each pair is counted once."""
    if not table or not len(i):
        return np.ones(len(i), dtype=bool)
    out = np.ones(len(i), dtype=bool)
    for k in range(0, len(i), 65_536):
        s = slice(k, k + 65_536)
        out[s] = ~(left[i[s], :table] == right[j[s], :table]).any(axis=1)
    return out


def near_vectors(vectors: DataFrame, cosine: float = COSINE, id: str = "vec_id", vector: str = "embedding", miss: float = MISS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Two vectors are linked if they meet in a bucket of some table and their cosine, in double precision, is at
    least ``cosine``; a pair at that cosine is missed with probability ``miss`` or little more at most. Equal vectors form
    a class that is compared once. Numbers and `SKETCH` signature bits go to the buckets, which name the vectors that
    differ in few bits from another; these alone are fetched and compared. Where the vectors' mean is longer than `LEANING`
    they also have to agree in the signs of what they have beside it. Buckets are cut into blocks, so a bucket with
    a third of all rows is many tasks (its vectors' links have to be counted, so work grows as the square of it); tasks
    return counts and a spanning set of links, not pairs.

    Null vectors and those that are zero or hold null, NaN or infinite components link with nothing; so do
    vectors of different lengths with each other. Rows that share an id are one vector in components. Rows
    without an id link with nothing.
    """
    kind = vectors.schema[vector].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).cast(kind).alias("v"))
    rows = rows.withColumn("ok", F.col("vec_id").isNotNull() & _valid("v"))
    rows = rows.withColumn("cls", F.when(F.col("ok"), F.sha2(F.to_json(F.struct("v")).cast("binary"), 256)))
    named = written(rows.select("vec_id", "ok", F.unhex("cls").alias("cls")), "vectors")
    classes = rows.where("ok").groupBy("cls").agg(F.min("vec_id").alias("head"), F.count("*").alias("n"), F.first("v").alias("v"))
    # rows that share an id are one vector: their classes are linked, and each has a number of its own
    classes = written(classes.select(F.monotonically_increasing_id().alias("num"), "head", "n", "v", F.size("v").alias("dim"), F.unhex("cls").alias("cls")), "classes")
    n = classes.count()
    bits, tables = plan(n, cosine, miss)
    means = {dim: m for dim, m in _mean_of(classes).items() if np.sqrt((m * m).sum()) > LEANING}

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                own = batch.filter(pa.array(dims == dim))
                x = _normal(_vectors(own.column(1), int(dim)))
                buckets, sketch = _signatures(x, bits, tables)
                length = pa.nulls(len(x), pa.float64())
                if means:
                    more, left = beside(x, means.get(int(dim), np.zeros(int(dim))))
                    sketch, length = np.concatenate([sketch, more], axis=1), pa.array(left)
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(list(buckets), type=pa.list_(pa.int32())), pa.array([x.tobytes() for x in sketch], type=pa.binary()), length], names=["num", "signs", "sketch", "length"])

    signed = written(classes.select("num", "v", "dim").mapInArrow(sign, "num long, signs array<int>, sketch binary, length double"), "signed")
    place = signed.select("num", "sketch", "length", F.posexplode("signs").alias("tab", "bucket")).select("num", "sketch", "length", (F.shiftleft(F.col("tab").cast("long"), 32) + F.col("bucket")).alias("key"))
    hot = written(place.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1"), "hot")
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_BUCKETS else hot
    dealt = place.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("num", "key"), F.col("blocks")).cast("int"))
    pair = F.expr("transform(sequence(0, blocks - 1), k -> struct(shiftleft(cast(least(block, k) as bigint), 32) + greatest(block, k) as pq, block > k as right))")
    dealt = dealt.withColumn("x", F.explode(pair)).select("key", "x.pq", "x.right", "num", "sketch", "length")
    limit, whole = farthest(cosine, min(SKETCH, bits * tables), miss), SKETCH // bits
    limits = limits_beside(cosine, miss)
    masks = [np.packbits(np.arange(SKETCH) // bits == t, bitorder="little").view(np.uint64) for t in range(min(whole, tables))]

    def candidates(key: tuple, table: pa.Table) -> pa.Table:
        """The vectors of two blocks that differ in few bits from one of the other block and met in no earlier table."""
        tab, pq = key[0].as_py() >> 32, key[1].as_py()
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint64).reshape(table.num_rows, -1)
        sketch, more = sketch[:, : SKETCH // 64], sketch[:, SKETCH // 64 :]
        length = table.column("length").to_numpy()
        right = table.column("right").to_numpy()
        a = np.flatnonzero(~right)
        b = a if pq >> 32 == pq & 0xFFFFFFFF else np.flatnonzero(right)
        found = np.zeros(len(right), dtype=bool)
        for start in range(0, len(a), 256):
            i = a[start : start + 256]
            far = np.bitwise_count(sketch[i][:, None, 0] ^ sketch[b][None, :, 0]).astype(np.int16)
            for w in range(1, SKETCH // 64):
                far += np.bitwise_count(sketch[i][:, None, w] ^ sketch[b][None, :, w])
            x, y = np.nonzero(far <= limit)
            x, y = i[x], b[y]
            keep = x != y
            if means:
                # the distance of two vectors at the cosine, seen from the mean: their cosine there is this at least
                x, y = x[keep], y[keep]
                least = 1 - (1 - cosine) / np.maximum(length[x] * length[y], 1e-12)
                far = np.bitwise_count(more[x] ^ more[y]).sum(axis=1, dtype=np.int16)
                keep = far <= limits[np.floor((np.maximum(least, -1.0) + 1) * 32).astype(np.int64)]
            for mask in masks[:tab]:
                x, y = x[keep], y[keep]
                keep = (((sketch[x] ^ sketch[y]) & mask) != 0).any(axis=1)
            found[x[keep]] = found[y[keep]] = True
        return pa.table({"key": table.column("key"), "pq": table.column("pq"), "num": table.column("num"), "right": table.column("right")}).filter(pa.array(found))

    jobs = dealt.groupBy("key", "pq").applyInArrow(candidates, "key long, pq long, num long, right boolean")
    full = written(jobs, "jobs").join(classes.select("num", "n", "v", "dim").join(signed.select("num", "signs"), "num"), "num")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        tab, pq = key[0].as_py() >> 32, key[1].as_py()
        same = pq >> 32 == pq & 0xFFFFFFFF
        num, size, dims, right = (table.column(c).to_numpy() for c in ("num", "n", "dim", "right"))
        links: dict[int, int] = {}
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        for dim in np.unique(dims):
            of = np.flatnonzero(dims == dim)
            own = table.filter(pa.array(dims == dim))
            x = _normal(_vectors(own.column("v").combine_chunks(), int(dim)))
            signs = _vectors(own.column("signs").combine_chunks(), tables).astype(np.int32)
            left = np.flatnonzero(~right[of])
            other = left if same else np.flatnonzero(right[of])
            for start in range(0, len(left), 128):
                some = left[start : start + 128]
                i, j = np.nonzero(x[some] @ x[other].T >= cosine - 1e-12)
                i, j = some[i], other[j]
                keep = (np.einsum("ij,ij->i", x[i], x[j]) >= cosine) & ((num[of][i] < num[of][j]) if same else True)
                i, j = i[keep], j[keep]
                first = _first_met(signs, signs, tab, i, j)
                i, j = of[i[first]], of[j[first]]
                for h, w in ((num[i], size[j]), (num[j], size[i])):
                    at, where = np.unique(h, return_inverse=True)
                    for y, c in zip(at.tolist(), np.bincount(where, weights=w, minlength=len(at)).tolist(), strict=True):
                        links[y] = links.get(y, 0) + int(c)
                for y, z in zip(num[i].tolist(), num[j].tolist(), strict=True):
                    y, z = root(y), root(z)
                    if y != z:
                        parent[max(y, z)] = min(y, z)
        out = [(h, root(h), c) for h, c in links.items()]
        return pa.table({"num": pa.array([x[0] for x in out], type=pa.int64()), "other": pa.array([x[1] for x in out], type=pa.int64()), "links": pa.array([x[2] for x in out], type=pa.int64())})

    made = written(full.groupBy("key", "pq").applyInArrow(compare, "num long, other long, links long"), "links")
    one_id = named.where("ok").join(classes.select("cls", "num"), "cls").groupBy("vec_id").agg(F.min("num").alias("num"), F.max("num").alias("other")).where("num <> other")
    several = named.where("ok").join(one_id.select("vec_id", F.col("num").alias("other")), "vec_id").join(classes.select("cls", "num"), "cls").select("num", "other")
    found = components(made.select("num", "other").union(several), "num", "other").withColumnRenamed("node", "num").join(classes.select("num", "head"), "num")
    smallest = found.groupBy("component").agg(F.min("head").alias("component_id"))
    counts = made.groupBy("num").agg(F.sum("links").alias("links"))
    summary = classes.select("cls", "num", "head", "n").join(counts, "num", "left").join(found.join(smallest, "component").select("num", "component_id"), "num", "left")
    summary = summary.select("cls", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "head").alias("component_id"))
    out = named.join(summary, "cls", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
