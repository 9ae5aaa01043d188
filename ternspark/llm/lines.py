"""Operator 7: reversible line deduplication with reference counts and sharded cuckoo filters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

#: Shortest key (code points) and fewest documents that make a line repeated.
MIN_CHARS, MIN_DOCS = 20, 3
#: Keys in a shard of the cuckoo filter when it is built, and postings that are probed with it in one task.
SHARD_KEYS, PROBE_ROWS = 200_000, 1_000_000

SPACE = b" \t\n\x0b\x0c\r"
#: Bytes that continue a code point.
_CONTINUE = bytes(range(0x80, 0xC0))


class CuckooFilter:
    """Sets of 128-bit keys (two int64 arrays) with deletion: buckets of four 16-bit fingerprints.

    A key lies in one of two buckets; the second is found from the first and the fingerprint alone. Deleting a
    key that was inserted leaves all others findable.
    """

    def __init__(self, buckets: int):
        self.table = np.zeros((buckets, 4), dtype=np.uint16)

    @classmethod
    def of(cls, hi: np.ndarray, lo: np.ndarray) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, len(hi)) / 2.8))))  # room for later insertions
        while True:
            made = cls(buckets)
            if made.insert(hi, lo):
                return made
            buckets *= 2

    @classmethod
    def read(cls, data: bytes) -> CuckooFilter:
        made = cls(0)
        made.table = np.frombuffer(data, dtype=np.uint16).reshape(-1, 4).copy()
        return made

    def write(self) -> bytes:
        return self.table.tobytes()

    def entries(self) -> list[tuple[int, int]]:
        """(fingerprint, lower of its two buckets) of all that is held, sorted: the same for the same keys and size."""
        at, slot = np.nonzero(self.table)
        fp = self.table[at, slot]
        other = at.astype(np.uint64) ^ (self._spread(fp) & np.uint64(len(self.table) - 1))
        return sorted(zip(fp.tolist(), np.minimum(at.astype(np.uint64), other).tolist(), strict=True))

    @staticmethod
    def _places(table: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(table) - 1)
        fp = (hi.view(np.uint64) >> np.uint64(48)).astype(np.uint16)
        fp[fp == 0] = 1
        first = lo.view(np.uint64) & mask
        return fp, first, first ^ (CuckooFilter._spread(fp) & mask)

    @staticmethod
    def _spread(fp: np.ndarray) -> np.ndarray:
        x = fp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return x >> np.uint64(24)

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        fp, a, b = self._places(self.table, hi, lo)
        return (self.table[a] == fp[:, None]).any(axis=1) | (self.table[b] == fp[:, None]).any(axis=1)

    def _placed(self, fp: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Put fingerprints into free slots of their buckets; which of them found one."""
        order = np.argsort(at, kind="stable")
        bucket = at[order].astype(np.int64)
        new = np.concatenate([[True], bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, dtype=bool)
        rank = np.arange(len(bucket)) - np.maximum.accumulate(np.where(new, np.arange(len(bucket)), 0))
        free = self.table[bucket] == 0
        slots = np.argsort(~free, axis=1, kind="stable")  # free ones first
        fits = rank < free.sum(axis=1)
        self.table[bucket[fits], slots[fits, rank[fits]]] = fp[order][fits]
        out = np.zeros(len(fp), dtype=bool)
        out[order[fits]] = True
        return out

    def insert(self, hi: np.ndarray, lo: np.ndarray, kicks: int = 500) -> bool:
        """False if the table is too full; it then holds only part of the keys."""
        fp, a, b = self._places(self.table, hi, lo)
        # most keys find a free slot in one of their buckets; the others move fingerprints one by one
        left = ~self._placed(fp, a)
        fp, a, b = fp[left], a[left], b[left]
        left = ~self._placed(fp, b)
        fp, a, b = fp[left], a[left], b[left]
        mask = len(self.table) - 1
        for f, x, y in zip(fp.tolist(), a.tolist(), b.tolist(), strict=True):
            for at in (x, y):
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = f
                    break
            else:
                at = y
                for k in range(kicks):
                    slot = k % 4
                    f, self.table[at, slot] = int(self.table[at, slot]), f
                    at ^= int(self._spread(np.array([f], dtype=np.uint16))[0]) & mask
                    free = np.flatnonzero(self.table[at] == 0)
                    if len(free):
                        self.table[at, free[0]] = f
                        break
                else:
                    return False
        return True

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> None:
        fp, a, b = self._places(self.table, hi, lo)
        for f, x, y in zip(fp.tolist(), a.tolist(), b.tolist(), strict=True):
            for at in (x, y):
                there = np.flatnonzero(self.table[at] == f)
                if len(there):
                    self.table[at, there[0]] = 0
                    break


def line_keys(text: bytes | None, min_chars: int = MIN_CHARS) -> tuple[list[bytes], list[bytes | None]]:
    """Lines of a UTF-8 text and the 16-byte digest of each line's key (None for keys under ``min_chars`` code points)."""
    lines = (text or b"").split(b"\n")
    out: list[bytes | None] = []
    for line in lines:
        if len(line) < min_chars:
            out.append(None)
            continue
        key = line.strip(SPACE).lower()  # of bytes: A-Z alone are lower-cased
        long = len(key) >= 4 * min_chars or len(key) >= min_chars and len(key.translate(None, _CONTINUE)) >= min_chars
        out.append(xxhash.xxh3_128_digest(key) if long else None)
    return lines, out


def postings(docs: DataFrame, id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(hi, lo, doc): the distinct line keys of each document; rows without an id aren't documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests: list[bytes] = []
            owners: list[int] = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {k for k in line_keys(body, min_chars)[1] if k is not None}
                digests += own
                owners += [doc] * len(own)
            both = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            hi, lo, doc = pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1])), pa.array(owners, type=pa.int64())
            for start in range(0, len(owners), 100_000):
                yield pa.RecordBatch.from_arrays([x.slice(start, 100_000) for x in (hi, lo, doc)], names=["hi", "lo", "doc"])

    rows = docs.select(F.col(id).cast("long").alias("doc"), F.col(text).cast("binary").alias("text")).where("doc is not null")
    return rows.mapInArrow(run, "hi long, lo long, doc long").distinct()


def reference_counts(held: DataFrame) -> DataFrame:
    """The exact table: (hi, lo, n_docs, keeper), keeper being the largest doc that holds the line."""
    return held.groupBy("hi", "lo").agg(F.count("*").alias("n_docs"), F.max("doc").alias("keeper"))


@dataclass(frozen=True)
class LineIndex:
    """The lines of a set of documents, kept up to date by `insert` and `remove`.

    ``postings`` (hi, lo, doc) are the distinct keys of each document, ``counts`` the exact table over them, and
    ``filters`` (shard, filter) the cuckoo filters of the keys that ``min_docs`` documents hold. The shard of a key is
    its low bits; all three are tables in the shared folder.
    """

    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_chars: int = MIN_CHARS
    min_docs: int = MIN_DOCS

    def repeated(self) -> DataFrame:
        return self.counts.where(F.col("n_docs") >= self.min_docs)

    def shard(self) -> Column:
        return F.col("hi").bitwiseAND(F.lit(self.shards - 1).cast("long")).cast("int").alias("shard")


def build(docs: DataFrame, id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineIndex:
    held = written(postings(docs, id, text, min_chars), "postings")
    counts = written(reference_counts(held), "counts")
    return _sharded(held, counts, 1, min_chars, min_docs) or LineIndex(held, counts, _all_built(held, counts, 1, min_chars, min_docs), 1, min_chars, min_docs)


def _all_built(held: DataFrame, counts: DataFrame, shards: int, min_chars: int, min_docs: int) -> DataFrame:
    index = LineIndex(held, counts, held, shards, min_chars, min_docs)
    return written(_built(index.repeated().select(index.shard(), "hi", "lo")), "filters")


def _sharded(held: DataFrame, counts: DataFrame, shards: int, min_chars: int, min_docs: int) -> LineIndex | None:
    """An index with as many shards as the repeated keys now take, its filters built from the exact table; None where
    ``shards`` are enough."""
    n, more = counts.where(F.col("n_docs") >= min_docs).count(), shards
    while n > more * SHARD_KEYS:
        more *= 2
    return LineIndex(held, counts, _all_built(held, counts, more, min_chars, min_docs), more, min_chars, min_docs) if more > shards else None


def _built(keys: DataFrame) -> DataFrame:
    """(shard, filter) of the keys (shard, hi, lo)."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        made = CuckooFilter.of(table.column("hi").to_numpy(), table.column("lo").to_numpy())
        return pa.table({"shard": pa.array([key[0].as_py()], type=pa.int32()), "filter": [made.write()]})

    return keys.groupBy("shard").applyInArrow(run, "shard int, filter binary")


def insert(index: LineIndex, docs: DataFrame, id: str = "doc_id", text: str = "text") -> LineIndex:
    """The index with further documents; lines of a document that it has already are added to it."""
    fresh = written(postings(docs, id, text, index.min_chars).join(index.postings, ["hi", "lo", "doc"], "left_anti"), "fresh")
    change = fresh.groupBy("hi", "lo").agg(F.count("*").alias("more"), F.max("doc").alias("high"))
    change = index.counts.join(change, ["hi", "lo"], "right").select("hi", "lo", F.coalesce("n_docs", F.lit(0)).alias("before"), (F.coalesce("n_docs", F.lit(0)) + F.col("more")).alias("n_docs"), F.greatest("keeper", "high").alias("keeper"))
    return _updated(index, index.postings.union(fresh), written(change, "change"))


def remove(index: LineIndex, docs: DataFrame, id: str = "doc_id") -> LineIndex:
    """The index without the documents that have the ids of ``docs``: undoes their insertion."""
    ids = docs.select(F.col(id).cast("long").alias("doc")).distinct()
    gone = written(index.postings.join(ids, "doc", "left_semi"), "gone")
    stay = written(index.postings.join(ids, "doc", "left_anti").select("hi", "lo", "doc"), "postings")
    change = gone.groupBy("hi", "lo").agg(F.count("*").alias("less"))
    keepers = stay.join(change, ["hi", "lo"], "left_semi").groupBy("hi", "lo").agg(F.max("doc").alias("keeper"))
    change = index.counts.drop("keeper").join(change, ["hi", "lo"]).join(keepers, ["hi", "lo"], "left")
    return _updated(index, stay, written(change.select("hi", "lo", F.col("n_docs").alias("before"), (F.col("n_docs") - F.col("less")).alias("n_docs"), "keeper"), "change"))


def _updated(index: LineIndex, held: DataFrame, change: DataFrame) -> LineIndex:
    """The index after ``change``, the changed keys: (hi, lo, before, n_docs, keeper)."""
    same = index.counts.join(change.select("hi", "lo"), ["hi", "lo"], "left_anti")
    counts = written(same.union(change.where("n_docs > 0").select("hi", "lo", "n_docs", "keeper")), "counts")
    grown = _sharded(held, counts, index.shards, index.min_chars, index.min_docs)
    if grown:
        return grown
    crossed = change.withColumn("add", F.col("n_docs") >= index.min_docs).where(F.col("add") != (F.col("before") >= index.min_docs)).select(index.shard(), "hi", "lo", "add")
    touched = crossed.select("shard").distinct()

    def run(table: pa.Table, keys: pa.Table) -> pa.Table:
        held = CuckooFilter.read(table.column("filter")[0].as_py()) if table.num_rows else CuckooFilter(4)
        hi, lo, add = (keys.column(c).to_numpy() for c in ("hi", "lo", "add"))
        held.delete(hi[~add], lo[~add])
        fits = held.insert(hi[add], lo[add])
        return pa.table({"shard": keys.column("shard").slice(0, 1), "filter": pa.array([held.write() if fits else None], type=pa.binary())})

    old = index.filters.join(touched, "shard", "left_semi")
    made = written(old.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInArrow(run, "shard int, filter binary"), "filters")
    after = LineIndex(held, counts, made, index.shards, index.min_chars, index.min_docs)
    full = made.where("filter is null").select("shard")  # built again, larger, from the exact table
    again = _built(after.repeated().select(after.shard(), "hi", "lo").join(F.broadcast(full), "shard", "left_semi"))
    filters = index.filters.join(touched, "shard", "left_anti").union(made.where("filter is not null")).union(again)
    return LineIndex(held, counts, written(filters, "filters"), index.shards, index.min_chars, index.min_docs)


def probe(index: LineIndex, held: DataFrame) -> DataFrame:
    """The postings (hi, lo, doc) of ``held`` that the filters may hold: all that are repeated, and few others.

    Postings meet the filter of their shard in pieces of about `PROBE_ROWS`, so neither the number of repeated lines nor
    a line that a third of all documents hold sets a limit.
    """
    rows = held.select(index.shard(), "hi", "lo", "doc")
    pieces = written(rows.groupBy("shard").agg(F.ceil(F.count("*") / PROBE_ROWS).cast("int").alias("pieces")), "pieces")
    pieces = F.broadcast(pieces)  # a row per shard, that is, for every 200,000 repeated lines
    rows = rows.join(pieces, "shard").withColumn("piece", F.pmod(F.xxhash64("doc"), F.col("pieces")).cast("int")).drop("pieces")
    filters = index.filters.join(pieces, "shard").select("shard", "filter", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))

    def run(keys: pa.Table, table: pa.Table) -> pa.Table:
        out = keys.select(["hi", "lo", "doc"])
        if not table.num_rows or not out.num_rows:
            return out.slice(0, 0)
        hit = CuckooFilter.read(table.column("filter")[0].as_py()).contains(out.column("hi").to_numpy(), out.column("lo").to_numpy())
        return out.filter(pa.array(hit))

    return rows.groupBy("shard", "piece").cogroup(filters.groupBy("shard", "piece")).applyInArrow(run, "hi long, lo long, doc long")


def drop_repeated_lines(docs: DataFrame, index: LineIndex | None = None, id: str = "doc_id", text: str = "text",
                        min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` without repeated lines: ``text`` replaced, ``n_lines`` and ``n_dropped`` added (or replaced).

    A line's key is the line without white space at its ends, A-Z lower-cased. Keys of ``min_chars`` code
    points found in ``min_docs`` documents lose all their lines except in the largest id that holds them.
    ``index`` holds the lines of the corpus to count in (default: of ``docs``; with one, its limits count). Null and
    empty texts are one empty line. Rows that share an id are one document; rows without an id aren't counted and
    keep their lines. Keys are compared by 128-bit digests; bytes that aren't UTF-8 stay as they are. An empty table
    stays empty.
    """
    if index is None:
        index = build(docs, id, text, min_chars, min_docs)
        held = index.postings
    else:
        min_chars = index.min_chars
        held = written(postings(docs, id, text, min_chars), "postings")
    # a key that very many hold is split by Spark where it sees the skew: the table has one row for it
    lost = probe(index, held).join(index.repeated(), ["hi", "lo"]).where("doc <> keeper")
    lost = lost.groupBy("doc").agg(F.collect_list(F.struct("hi", "lo")).alias("__lost")).withColumnRenamed("doc", "__doc")  # bounded by the document's lines
    columns = [c for c in docs.columns if c not in (text, "n_lines", "n_dropped")]
    body = F.col(text).cast("binary").alias("__body")
    rows = docs.where(F.col(id).isNotNull()).withColumn("__doc", F.col(id).cast("long")).join(lost, "__doc", "left").select(*columns, body, "__lost")
    rows = rows.union(docs.where(F.col(id).isNull()).select(*columns, body, F.lit(None).cast("array<struct<hi: long, lo: long>>")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, lost_at = batch.column(len(columns)).to_pylist(), batch.column(len(columns) + 1)
            flat = lost_at.flatten()
            digests = np.stack([flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)], axis=1).astype("<i8").tobytes() if len(flat) else b""
            sizes = lost_at.value_lengths().fill_null(0).to_pylist()
            at, kept, n_lines, n_dropped = 0, [], [], []
            for body, size in zip(bodies, sizes, strict=True):
                if not size:
                    kept.append(body)
                    n_lines.append((body or b"").count(b"\n") + 1)
                    n_dropped.append(0)
                    continue
                drop = {digests[16 * k : 16 * k + 16] for k in range(at, at + size)}
                at += size
                lines, keys = line_keys(body, min_chars)
                stay = [x for x, k in zip(lines, keys, strict=True) if k is None or k not in drop]
                kept.append(b"\n".join(stay))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(columns)], pa.array(kept, type=pa.binary()), pa.array(n_lines, type=pa.int64()), pa.array(n_dropped, type=pa.int64())],
                names=[*columns, text, "n_lines", "n_dropped"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*columns).schema.fields)
    out = rows.mapInArrow(run, f"{schema}`{text}` binary, n_lines long, n_dropped long").withColumn(text, F.col(text).cast("string"))
    return out.select(*[c for c in docs.columns if c in columns or c == text], "n_lines", "n_dropped")
