"""Operator 4: near-duplicate documents by bottom-k sketches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .scratch import written

#: Words in a shingle, least similarity in percent, and values kept of a set.
WORDS, PERCENT, KEEP = 5, 80, 64
#: Standard errors of a sketch that estimates may be off.
ERRORS = 6
#: Longest list whose pairs are rows; classes in longer ones are compared in blocks of about so many and so many bytes.
SHORT, BLOCK, BLOCK_BYTES = 32, 256, 32 << 20
#: Ids that may be broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 200_000
#: Bytes of text hashed at once (a longer text is hashed alone).
CHUNK = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_ODD = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0xA0761D6478BD642F], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def least_estimate(percent: int, keep: int) -> float:
    """Estimated similarity under which a pair isn't verified: the bound less `ERRORS` standard errors of a full sketch."""
    j = percent / 100
    return max(0.0, j - ERRORS * math.sqrt(j * (1 - j) / keep))


def least_overlap(percent: int, keep: int) -> int:
    """Retained values that two full sketches of similar sets share at least (32 of 64 at 80 percent)."""
    return max(1, math.floor(keep * least_estimate(percent, keep)))


class Shingler:
    """Sets of word shingles of many texts at once, as 64-bit hashes.

    Words are runs of bytes outside ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased. A word's hash is a polynomial
    of its bytes modulo 2**64, read off running sums over the whole chunk.
    """

    def __init__(self, words: int):
        self.words = words
        byte = np.arange(256)
        byte[65:91] += 32
        self.space = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
        self.value = _mixed((byte.astype(np.uint64) + np.uint64(1)) * np.uint64(0x632BE59BD9B4E019))
        self.power = self.back = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            for name, base in (("power", _BASE), ("back", _INVERSE)):
                x = np.full(n, base, dtype=np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))

    def sets(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The sorted distinct shingle hashes (int64) of each text."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) < CHUNK):
                size += len(texts[end]) + 1
                end += 1
            yield from self._chunk(texts[at:end])
            at = end

    def _chunk(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        data = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
        self._powers(len(data))
        blank = self.space[data]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        first, last = edge[0::2], edge[1::2]
        total = np.cumsum(self.value[data] * self.power[: len(data)])
        word = _mixed((total[last - 1] - total[first - 1]) * self.back[first] + (last - first).astype(np.uint64) * _ODD[7])
        begins = np.cumsum([1, *(len(t) + 1 for t in texts)])
        bounds = np.searchsorted(first, begins)
        w = self.words
        n = len(word) - w + 1
        joined = np.zeros(max(n, 0), dtype=np.uint64)
        for k in range(w if n > 0 else 0):
            joined += word[k : k + n] * _ODD[k % 8] * np.uint64(2 * (k // 8) + 1)
        joined = _mixed(joined).view(np.int64)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= w:
                yield np.unique(joined[a : b - w + 1])
            elif b > a:  # the whole sequence is the one shingle
                whole = np.uint64(b - a)
                with np.errstate(over="ignore"):
                    for x in word[a:b]:
                        whole = _mixed(np.array([whole * _ODD[5] + x], dtype=np.uint64))[0]
                yield np.array([whole], dtype=np.uint64).view(np.int64)
            else:
                yield np.empty(0, dtype=np.int64)


def _bodies(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _digest(values: np.ndarray) -> bytes:
    x = values.view(np.uint64)
    return np.array([_mixed(x ^ _ODD[0]).sum(dtype=np.uint64), _mixed(x ^ _ODD[1]).sum(dtype=np.uint64)], dtype=np.uint64).tobytes() + len(x).to_bytes(4, "little")


def sketches(docs: DataFrame, words: int, keep: int) -> DataFrame:
    """(doc, n, digest, sketch) from (doc, text): size, digest and the smallest ``keep`` hashes of each set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            n, digest, low = [], [], []
            for s in shingler.sets(_bodies(batch.column(1))):
                n.append(len(s))
                digest.append(_digest(s))
                low.append(s[:keep])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, type=pa.int64()), pa.array(digest, type=pa.binary()), pa.array(low, type=pa.list_(pa.int64()))], names=["doc", "n", "digest", "sketch"])

    return docs.mapInArrow(run, "doc long, n long, digest binary, sketch array<long>")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """(digest, full) from (doc, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                sets = list(shingler.sets(_bodies(batch.column(1).slice(start, 256))))
                yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], type=pa.binary()), pa.array(sets, type=pa.list_(pa.int64()))], names=["digest", "full"])

    return docs.mapInArrow(run, "digest binary, full array<long>").dropDuplicates(["digest"])


def _lists(classes: DataFrame, percent: int, keep: int) -> DataFrame:
    """Inverted lists of retained values that can decide a pair: (key, cls, n, shared).

    Two sets that are similar enough have c = min(ceil(percent n / 100), `least_overlap`) retained values in common (at
    80 percent, sets under 64 surely; larger ones, of 64 values each, fail it about once in 10**8). Ordered by the
    number of classes that hold them, rare ones first, the first common value is then among the first m - c + 1 of
    either set's m values that several classes hold. So the most common values, such as those of a passage that many
    documents share, give no list unless they are most of a sketch. ``shared`` is m.
    """
    values = classes.select("cls", "n", F.explode("sketch").alias("key"))
    # counted before they meet again: a value that very many classes hold is one row, whose join Spark splits
    counted = values.join(values.groupBy("key").agg(F.count("*").alias("f")).where("f > 1"), "key")
    own = Window.partitionBy("cls")
    ranked = counted.withColumn("shared", F.count("*").over(own)).withColumn("at", F.row_number().over(own.orderBy("f", "key")))
    least = F.least(F.ceil(F.col("n") * percent / 100), F.lit(least_overlap(percent, keep)))
    return ranked.where(F.col("at") <= F.col("shared") - least + 1).select("key", "cls", "n", "shared")


def _fetched(heads: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """The full sets of the documents ``heads`` (doc)."""
    heads = written(heads.distinct(), "heads")
    small = F.broadcast(heads) if heads.count() <= BROADCAST_IDS else heads
    return written(full_sets(docs.join(small, "doc", "left_semi"), words), "full")


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int, keep: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough."""
    left = classes.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("digest").alias("d_a"), F.col("sketch").alias("s_a"), F.col("head").alias("h_a"))
    right = classes.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("digest").alias("d_b"), F.col("sketch").alias("s_b"), F.col("head").alias("h_b"))
    near = pairs.join(left, "a").join(right, "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    union = F.expr(f"slice(array_sort(array_union(s_a, s_b)), 1, {keep})")
    shared = F.size(F.array_intersect(F.array_intersect(union, "s_a"), "s_b"))
    near = written(near.where(shared >= F.lit(least_estimate(percent, keep)) * F.size(union)).select("a", "b", "n_a", "n_b", "d_a", "d_b", "h_a", "h_b"), "near")
    full = _fetched(near.select(F.col("h_a").alias("doc")).union(near.select("h_b")), docs, words)
    both = near.join(full.select(F.col("digest").alias("d_a"), F.col("full").alias("f_a")), "d_a").join(full.select(F.col("digest").alias("d_b"), F.col("full").alias("f_b")), "d_b")
    common = F.size(F.array_intersect("f_a", "f_b"))
    return written(both.where(100 * common >= percent * (F.col("n_a") + F.col("n_b") - common)).select("a", "b"), "confirmed")


def _candidates(sets: list[np.ndarray], percent: int, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of sorted sets of which the sketch of the union says that they may be similar enough."""
    n = np.array([len(s) for s in sets])
    none = np.iinfo(np.int64).max
    sketch = np.full((len(sets), keep), none)
    for k, s in enumerate(sets):
        sketch[k, : min(len(s), keep)] = s[:keep]
    value, token = np.unique(sketch, return_inverse=True)
    token = token.reshape(sketch.shape)
    often = (np.bincount(token.ravel(), minlength=len(value)) > 1) & (value != none)
    column = np.cumsum(often) - 1
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    row, at = np.nonzero(often[token])
    at = column[token[row, at]]
    for start in range(0, int(often.sum()), 4096):
        own = (at >= start) & (at < start + 4096)
        x = np.zeros((len(sets), 4096), dtype=np.float32)
        x[row[own], at[own] - start] = 1
        common += x @ x.T
    least = np.minimum(np.ceil(n * percent / 100), least_overlap(percent, keep))
    fits = 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])
    i, j = np.nonzero(np.triu((common >= np.minimum(least[:, None], least[None, :])) & fits, 1))
    good = np.zeros(len(i), dtype=bool)
    for k in range(0, len(i), 16_384):
        part = slice(k, k + 16_384)
        both = np.sort(np.concatenate([sketch[i[part]], sketch[j[part]]], axis=1), axis=1)
        again = np.concatenate([np.zeros((len(both), 1), dtype=bool), both[:, 1:] == both[:, :-1]], axis=1)
        again &= both != none
        place = np.cumsum(~again & (both != none), axis=1)  # of a value among the distinct ones
        in_union = place <= keep
        size = np.minimum(place[:, -1], keep)
        good[part] = (again & in_union).sum(axis=1) >= least_estimate(percent, keep) * size
    return i[good], j[good]


def _in_blocks(lists: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int, keep: int) -> DataFrame:
    """Links (a, b) that join components inside long lists, without a row for every pair.

    Classes are dealt to blocks by their longest list, of about `BLOCK` classes and at most about `BLOCK_BYTES` (or one
    set); every two blocks that share a list are compared in one task: sketches estimate first, full sets of what is left
    confirm, and a spanning set of the links found is returned. Tasks grow as the square of a list's blocks.
    """
    own = lists.groupBy("cls").agg(F.max_by(F.struct("key", "size", "total"), F.struct("size", "key")).alias("p"), F.first("component").alias("component"))
    parts = F.ceil(F.greatest(F.col("p.size") / BLOCK, 8 * F.col("p.total") / BLOCK_BYTES))
    part = F.pmod(F.xxhash64("cls"), parts).cast("int")
    own = written(own.select("cls", "component", F.struct(F.col("p.key").alias("list"), part.alias("part")).alias("block")), "own")
    touched = lists.select("key", "cls").join(own, "cls").select("key", "block").distinct()
    pairs = touched.select("key", F.col("block").alias("p")).join(touched.select("key", F.col("block").alias("q")), "key").where("p <= q").select("p", "q").distinct()
    pairs = written(pairs, "blocks")
    facts = written(own.join(classes.select("cls", "head", "digest"), "cls"), "facts")
    full = _fetched(facts.select(F.col("head").alias("doc")), docs, words)
    sets = written(facts.join(full, "digest").select("cls", "component", "block", "full"), "sets")
    dealt = pairs.withColumn("block", F.explode(F.array_distinct(F.array("p", "q")))).join(sets, "block")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        heads, part = table.column("cls").to_numpy(), table.column("component").to_numpy()
        column = table.column("full").combine_chunks()
        sets = np.split(column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())[:-1])
        seen: dict[int, int] = {}

        def root(k: int) -> int:
            while seen.get(k, k) != k:
                k = seen[k]
            return k

        a, b = [], []
        for i, j in zip(*(x.tolist() for x in _candidates(sets, percent, keep)), strict=True):
            u, v = root(int(part[i])), root(int(part[j]))
            if u != v:
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    seen[max(u, v)] = min(u, v)
                    a.append(int(heads[i]))
                    b.append(int(heads[j]))
        return pa.table({"a": pa.array(a, type=pa.int64()), "b": pa.array(b, type=pa.int64())})

    return written(dealt.select("p", "q", "cls", "component", "full").groupBy("p", "q").applyInArrow(run, "a long, b long"), "blocklinks")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, keep: int = KEEP, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Two documents are linked if 100 |intersection| >= ``percent`` |union| of their sets of word shingles.
    Documents with equal sets form a class, represented by its smallest id. Inverted lists of retained values
    gather classes; each class is first compared with the head that most of its lists have, then, in lists that
    still hold several components, all pairs across components are compared: as rows in short lists, in blocks
    inside tasks in long ones.
    A pair's similarity is estimated on the sketch of the union and confirmed on the full sets. Sets hold 64-bit hashes
    of shingles (whole ones, all of them); classes are told apart by 128 bits and the size.

    Texts without words have an empty set and link with nothing. Rows that share an id are one document: their texts
    are compared alone and their components are one.
    Rows without an id link with nothing and have no component; they are kept. Extra columns are ignored.
    """
    source = docs.select(F.col(id).cast("long").alias("doc"), F.col(text).alias("text"))
    signed = written(sketches(source, words, keep), "sketches")
    known = signed.where("doc is not null and n > 0")
    classes = known.groupBy("digest").agg(F.min("doc").alias("head"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    lists = written(_lists(classes, percent, keep), "lists")
    # the low of a list is the class that shares most values with others: the original of a group of copies
    heads = lists.groupBy("key").agg(F.max_by("cls", F.struct("shared", -F.col("cls"))).alias("low"), F.count("*").alias("size")).where("size > 1")
    lists = written(lists.join(heads, "key").select("key", "cls", "n", "low"), "headed")
    best = lists.where("cls <> low").groupBy("cls", "low").count().groupBy("cls").agg(F.max_by("low", F.struct("count", -F.col("low"))).alias("a"))
    links = _confirmed(best.select("a", F.col("cls").alias("b")), classes, source, words, percent, keep).union(_same_id(known, classes))
    found = components(links)

    named = lists.join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    # classes without a link are components of their own: they are counted before a list's most frequent one is picked
    parts = named.groupBy("key", "component").agg(F.count("*").alias("k"), F.sum("n").alias("part"))
    mixed = parts.groupBy("key").agg(
        F.min("component").alias("c1"), F.max("component").alias("c2"), F.max_by("component", F.struct("k", -F.col("component"))).alias("c0"), F.sum("k").alias("size"), F.sum("part").alias("total"))
    open_lists = written(named.join(mixed.where("c1 <> c2").select("key", "c0", "size", "total"), "key").select("key", "cls", "n", "component", "c0", "size", "total"), "open")
    short = open_lists.where(f"size <= {SHORT}")
    x = short.where("component <> c0").select("key", F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("component").alias("c_a"))
    y = short.select("key", F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("component").alias("c_b"), "c0")
    across = x.join(y, "key").where(f"c_a <> c_b and (c_b = c0 or a < b) and 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    across = across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = _confirmed(across, classes, source, words, percent, keep)
    more = more.union(_in_blocks(open_lists.where(f"size > {SHORT}"), classes, source, words, percent, keep))
    if not more.isEmpty():
        found = components(links.union(more))

    linked = found.withColumnRenamed("node", "cls").join(classes.select("cls", "digest", "head"), "cls")
    smallest = linked.groupBy("component").agg(F.min("head").alias("component_id"))
    linked = linked.join(smallest, "component").select("digest", "component_id")
    heads = classes.select("digest", "head").join(linked, "digest", "left").select("digest", F.coalesce("component_id", "head").alias("component_id"))
    rows = signed.select("doc", "n", "digest").join(heads, "digest", "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc"))
    component = F.when(F.col("n") > 0, component).otherwise(F.col("doc"))
    return rows.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _same_id(known: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) of classes that hold texts of one id."""
    several = known.groupBy("doc").agg(F.min("digest").alias("one"), F.max("digest").alias("other")).where("one <> other").select("doc", "one")
    other = known.join(several, "doc").where("digest <> one").select("one", "digest").distinct()
    one = classes.select(F.col("digest").alias("one"), F.col("cls").alias("a"))
    return other.join(one, "one").join(classes.select("digest", F.col("cls").alias("b")), "digest").select("a", "b")
