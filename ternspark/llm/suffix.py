"""Operator 8: exact repeated substrings across documents, by suffix arrays of what may repeat."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

#: Bytes of a repeated string, of the grams whose hashes stand for it, and of a chunk on average.
LENGTH, GRAM, CHUNK = 50, 24, 128
#: Bytes of text hashed at once, so that arrays stay in a core's cache (a longer text is hashed alone).
PIECE = 1 << 18
#: Bits of a Bloom filter for each hash, and at most in all (64 MB): what it lets through beyond is sorted out later.
FILTER_BITS, FILTER_MOST = 16, 1 << 29
#: Contexts with one least hash beyond which they are dealt out string by string: a two-thousandth of all, within
#: these limits (so a group is never over some 8 MB). Bytes of a task's stretches.
HOT, HOT_MOST, SHARD_BYTES = 4_000, 100_000, 4 << 20
#: Symbols of a text whose suffixes are sorted step by step together with those of others, the fewest texts, and the most
#: symbols of all.
TOGETHER, FEWEST, BATCH = 4_096, 24, 2 << 20
#: Bytes of a list that may be broadcast.
BROADCAST_BYTES = 32 << 20
#: Stands for a missing id: larger than all others.
NO_ID = (1 << 63) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
_LEVELS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


class Text:
    """Texts laid end to end, with the hashes of all their grams and the least hash of every string of `LENGTH`."""

    def __init__(self, bodies: list[bytes], hashed: bool = True):
        self.raw = b"".join(bodies)
        self.sizes = np.array([len(b) for b in bodies], dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        self.begins = self.ends - self.sizes
        if not hashed:
            return
        g = _VALUE[np.frombuffer(self.raw, dtype=np.uint8)]
        step, eight = 1, g
        for c in _LEVELS:  # 2, 4, 8, 16 bytes
            if len(g) <= step:
                g = g[:0]
                break
            g = g[:-step] * c + g[step:]
            step *= 2
            eight = g if step == 8 else eight
        more = GRAM - 16
        g = g[: max(0, len(self.raw) - GRAM + 1)]
        self.grams = _mixed(g * _LEVELS[0] + eight[16 : 16 + len(g)]) if more == 8 and len(g) else _mixed(g)

    def least(self) -> np.ndarray:
        """For every start, the least gram hash of the `LENGTH` bytes from there (also across texts: skip those)."""
        m, span, want = self.grams, 1, LENGTH - GRAM + 1
        while span * 2 <= want:
            m = np.minimum(m[:-span], m[span:]) if len(m) > span else m[:0]
            span *= 2
        rest = want - span
        return np.minimum(m[: len(m) - rest], m[rest:]) if len(m) > rest else m[:0]

    def strings(self, starts: np.ndarray) -> np.ndarray:
        """Hashes of the strings of `LENGTH` bytes at ``starts``."""
        g = self.grams
        return _mixed(g[starts] * _LEVELS[0] + g[starts + GRAM] * _LEVELS[1] + g[starts + LENGTH - GRAM] * _LEVELS[2])

    def starts(self) -> np.ndarray:
        """How many strings of `LENGTH` bytes start in each text."""
        return np.maximum(self.sizes - LENGTH + 1, 0)

    def chunks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first start, end of starts) of all chunks; cuts depend on the bytes around them alone."""
        hit = (self.grams & np.uint64(0x7FFFFFFF)) < np.uint64(0x80000000 // CHUNK)
        hit[1:] &= ~hit[:-1]  # in a run of equal bytes only the first
        cut = np.flatnonzero(hit)
        n = self.starts()
        own = np.searchsorted(self.ends, cut, side="right")
        ok = (cut > self.begins[own]) & (cut < self.begins[own] + n[own])
        has = np.flatnonzero(n)
        a = np.concatenate([self.begins[has], cut[ok]])
        text = np.concatenate([has, own[ok]])
        by = np.argsort(a, kind="stable")
        a, text = a[by], text[by]
        b = np.append(a[1:], 0)
        last = np.append(text[1:] != text[:-1], True) if len(text) else np.zeros(0, dtype=bool)
        b[last] = (self.begins + n)[text[last]]
        return text, a, b


def suffix_array(text: list[int]) -> list[int]:
    """The suffix array of symbols > 0, by linear grouping (Baier 2016).

    Phase 1 goes through the groups of suffixes from the highest to the lowest. For each suffix of a group the
    nearest earlier suffix in a lower group is found by following pointers over groups done before. Those
    previous suffixes leave their groups: the ones met l times form a new group right above their old one, more
    meetings higher up. At the end a group holds the suffixes that begin with the same longest Lyndon word.
    Phase 2 emits suffixes in ascending order: each puts the suffix before it, and the chain of that one's
    previous pointers, at the front of what is left of their groups. No symbols are renamed, nothing recurs. Time is
    linear but for the sorting of a group's members by place.
    """
    n = len(text)
    first: dict[int, list[int]] = {}
    for s, c in enumerate(text):
        if c in first:
            first[c].append(s)
        else:
            first[c] = [s]
    members = [first[c] for c in sorted(first)]
    below = list(range(-1, len(members) - 1))  # the next lower group
    above = list(range(1, len(members) + 1))  # the next higher one
    size = [len(m) for m in members]
    group = [0] * n
    for g, m in enumerate(members):
        for s in m:
            group[s] = g
    done = bytearray(n)
    prev = [-1] * n
    order: list[int] = []
    g = len(members) - 1
    while g >= 0:
        own = members[g] if len(members[g]) == size[g] else [s for s in members[g] if group[s] == g]
        members[g] = own
        order.append(g)
        if len(own) == 1:
            s = own[0]
            done[s] = 1
            p = s - 1
            while p >= 0 and done[p]:
                p = prev[p]
            prev[s] = p
            if p >= 0:
                old = group[p]
                if size[old] > 1:
                    new = len(members)
                    members.append([p])
                    size.append(1)
                    size[old] -= 1
                    group[p] = new
                    up = above[old]
                    below.append(old)
                    above.append(up)
                    above[old] = below[up] = new
            g = below[g]
            continue
        own.sort()
        for s in own:
            done[s] = 1
        met: dict[int, int] = {}
        for s in own:
            p = s - 1
            while p >= 0 and done[p]:
                p = prev[p]
            prev[s] = p
            if p >= 0:
                met[p] = met.get(p, 0) + 1
        if met:
            times: dict[int, dict[int, list[int]]] = {}
            for p, k in met.items():
                times.setdefault(k, {}).setdefault(group[p], []).append(p)
            for k in sorted(times, reverse=True):
                for old, moved in times[k].items():
                    if len(moved) == size[old]:
                        continue  # the whole group moves: it stays where it is
                    new = len(members)
                    members.append(moved)
                    size.append(len(moved))
                    size[old] -= len(moved)
                    for p in moved:
                        group[p] = new
                    up = above[old]
                    below.append(old)
                    above.append(up)
                    above[old] = below[up] = new
        g = below[g]
    order.reverse()
    front = [0] * len(members)
    at = 0
    for g in order:
        front[g] = at
        at += size[g]
    out = [-1] * n
    placed = bytearray(n)

    def chain(p: int) -> None:
        while p >= 0 and not placed[p]:
            placed[p] = 1
            g = group[p]
            out[front[g]] = p
            front[g] += 1
            p = prev[p]

    chain(n - 1)  # the empty suffix comes before all
    for i in range(n):
        if out[i] > 0:
            chain(out[i] - 1)
    return out


def suffix_arrays(text: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The suffix arrays of many short texts: each row of ``text`` holds ``size`` symbols > 0, the rest is ignored.

    Places behind a row's end hold -1.
    """
    rows, width = text.shape
    inside = np.arange(width)[None, :] < size[:, None]
    led = np.zeros(int(size.sum()) + rows, dtype=text.dtype)
    begin = np.cumsum(size + 1) - size - 1
    there = _ranges(begin + 1, begin + 1 + size)
    led[there] = text[inside]
    out = np.full((rows, width), -1, dtype=np.int64)
    out[inside] = (suffix_orders(led, size + 1) - np.repeat(begin + 1, size + 1))[there]
    return out


def suffix_orders(text: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The suffix orders of texts end to end, each of ``size`` symbols: a 0 that leads it, then symbols > 0. The places of a
    text, but the first, hold where its suffixes begin, in ascending order.

    The construction of `suffix_array`, a step for every text at once. A group is known by the first place of its
    suffixes in the result; suffixes that leave it take the last places. The leading 0 is never done and has a group of its own,
    so that all pointers end there.
    """
    n, rows = len(text), len(size)
    row_begin = np.cumsum(size) - size
    row_end = row_begin + size - 1
    order = np.argsort(text, kind="stable")
    row = np.repeat(np.arange(rows, dtype=np.uint16 if rows <= 1 << 16 else np.int64), size)
    held = order[np.argsort(row[order], kind="stable")]  # the suffixes, group after group, and where each stands
    value = text[held]
    new = np.ones(n, dtype=bool)
    new[1:] = value[1:] != value[:-1]
    new[row_begin] = True
    first = np.flatnonzero(new)
    at = np.empty(n, dtype=np.int64)
    at[held] = np.arange(n)
    count = np.zeros(n, dtype=np.int64)  # by a group's first place
    count[first] = np.diff(np.append(first, n))
    group = np.empty(n, dtype=np.int64)  # the first place of each suffix's group
    group[held] = np.repeat(first, count[first])
    ends_at = np.zeros(n, dtype=np.int64)  # the first place of the group that ends at a place
    ends_at[first + count[first] - 1] = first
    done, leaves = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    prev, mark = np.full(n, -1, dtype=np.int64), np.empty(n, dtype=np.int64)
    some = size > 1
    begin, end = row_begin[some], row_end[some]
    while len(end):
        now = ends_at[end]
        m = held[_ranges(now, end + 1)]
        done[m] = True
        p = m - 1
        prev[m] = p
        more = np.flatnonzero(done[p])
        while len(more):
            q = prev[p[more]]
            p[more] = q
            prev[m[more]] = q
            more = more[done[q]]
        old = group[p]
        some = count[old] > 1  # a suffix alone in its group stays where it is
        p, old = p[some], old[some]
        if len(p):
            number = np.arange(len(p))
            mark[p] = number
            if (mark[p] == number).all():
                by = np.argsort(old)
                u, old = p[by], old[by]
                cut = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]]))
            else:
                u, k = np.unique(p, return_counts=True)
                old = group[u]
                by = np.lexsort((-k, old))
                u, k, old = u[by], k[by], old[by]
                cut = np.flatnonzero(np.concatenate([[True], (old[1:] != old[:-1]) | (k[1:] != k[:-1])]))  # suffixes that leave a group together
            c, of = np.diff(np.append(cut, len(u))), old[cut]
            fresh = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            upto = np.cumsum(c)
            upto -= np.repeat(np.append(0, upto)[fresh], np.diff(np.append(fresh, len(of))))
            was = count[of]
            to = of + was - upto
            # they change places with those that stay at the end of the group
            last = np.append(fresh[1:], len(of)) - 1
            leaves[u] = True
            tail = held[_ranges(to[last], of[last] + was[last])]
            holes = at[u]
            holes = holes[holes < np.repeat(to[last], np.diff(np.append(cut[fresh], len(u))))]
            stay = tail[~leaves[tail]]
            held[holes] = stay
            at[stay] = holes
            leaves[u] = False
            place = _ranges(to, to + c)
            held[place] = u
            at[u] = place
            group[u] = np.repeat(to, c)
            count[to] = c
            ends_at[to + c - 1] = to
            left = was[last] - upto[last]
            some = left > 0
            count[of[last][some]] = left[some]
            ends_at[(of[last] + left - 1)[some]] = of[last][some]
        some = now > begin + 1
        begin, end = begin[some], now[some] - 1
    front = np.arange(n)
    out = row_begin.repeat(size)
    placed = np.zeros(n, dtype=bool)
    placed[row_begin] = True

    def chain(p: np.ndarray) -> None:
        p = p[~placed[p]]
        while len(p):
            placed[p] = True
            g = group[p]
            f = front[g]
            out[f] = p
            front[g] = f + 1
            p = prev[p]
            p = p[~placed[p]]

    chain(row_end)  # the empty suffix comes before all
    by = np.argsort(-size, kind="stable")
    begin, left = row_begin[by], np.searchsorted(-size[by], -np.arange(1, int(size.max(initial=0))), side="left")
    for i, k in enumerate(left.tolist(), 1):  # the texts with an i-th suffix
        chain(out[begin[:k] + i] - 1)
    return out


def _pieces(bodies: list[bytes], hashed: bool = True) -> Iterator[tuple[int, Text]]:
    """Neighbouring texts of about `PIECE` bytes at a time, with the number of the first."""
    at = 0
    while at < len(bodies):
        end, size = at, 0
        while end < len(bodies) and (end == at or size + len(bodies[end]) < PIECE):
            size += len(bodies[end])
            end += 1
        yield at, Text(bodies[at:end], hashed)
        at = end


def _bodies(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _fresh(text: Text, repeated: list[list[int] | None]) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of the starts of strings in chunks that no smaller document has, neighbouring chunks as one."""
    own, a, b = text.chunks()
    gone = np.zeros(len(own), dtype=bool)
    first = np.searchsorted(own, np.arange(len(repeated)))
    for k, numbers in enumerate(repeated):
        if numbers:
            gone[first[k] + np.array(numbers)] = True
    a, b = a[~gone], b[~gone]
    apart = a[1:] != b[:-1]
    return (a[np.append(True, apart)], b[np.append(apart, True)]) if len(a) else (a, b)


def _ranges(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [a, b), in order."""
    n = b - a
    return np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum()) if len(n) else np.zeros(0, dtype=np.int64)


def _runs(text: Text, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(least hash, text, first start, strings) of neighbouring strings, of the ranges [a, b) of starts, with the same least
    hash. Texts lie further apart than neighbours do."""
    if not len(a):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    h = text.least().view(np.int64)
    new, inside = np.empty(len(h), dtype=bool), np.zeros(len(h) + 1, dtype=np.int8)
    new[1:] = h[1:] != h[:-1]
    new[a] = True
    inside[a], inside[b] = 1, -1
    start = np.flatnonzero(new & np.cumsum(inside[:-1], dtype=np.int8).view(bool))
    end = np.minimum(np.append(start[1:], len(h)), b[np.searchsorted(a, start, side="right") - 1])
    return h[start], np.searchsorted(text.ends, start, side="right"), start, end - start


def _chunk_rows(rows: DataFrame) -> DataFrame:
    """(hi, lo, doc, th, number): 128-bit digests of every chunk with the bytes that its strings reach."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, text in _pieces(_bodies(batch.column(2))):
                own, a, b = text.chunks()
                digests = _digests(text, a, b)
                number = np.arange(len(own)) - np.searchsorted(own, own)
                which = pa.array(own + at)
                yield pa.RecordBatch.from_arrays([pa.array(digests[:, 0]), pa.array(digests[:, 1]), batch.column(0).take(which), batch.column(1).take(which), pa.array(number.astype(np.int32))], names=["hi", "lo", "doc", "th", "number"])

    return rows.select("doc", "th", "text").mapInArrow(run, "hi long, lo long, doc long, th long, number int")


def _shared_hashes(base: DataFrame, buckets: int) -> DataFrame:
    """(h, n): least hashes that strings of fresh chunks of several documents have, and how many runs of them.

    A batch packs its hashes by their low bits, each with its document (the smallest and the largest where a
    batch has more), so a bucket is a few arrays, and a very common hash has two entries per batch.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, doc = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            repeated = batch.column(3).to_pylist()
            hs, ds = [], []
            for at, text in _pieces(_bodies(batch.column(2))):
                h, own, _, _ = _runs(text, *_fresh(text, repeated[at : at + len(text.sizes)]))
                hs.append(h)
                ds.append(doc[own + at])
            if not sum(map(len, hs)):
                continue
            h, d = np.concatenate(hs), np.concatenate(ds)
            by = np.argsort(h)
            h, d = h[by], d[by]
            begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            n = np.diff(np.append(begin, len(h)))
            low, high = np.minimum.reduceat(d, begin), np.maximum.reduceat(d, begin)
            twice = low != high
            # a hash with more than one document stands twice, its runs counted once
            h2 = np.concatenate([h[begin], h[begin][twice]])
            d2 = np.concatenate([low, high[twice]])
            n2 = np.concatenate([n, np.zeros(int(twice.sum()), dtype=np.int64)])
            bucket = h2 & (buckets - 1)
            by = np.argsort(bucket * len(docs) + d2)
            h2, d2, n2, bucket = h2[by], docs[d2[by]], n2[by], bucket[by]
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, dtype=np.int64)
            rows = [[], [], [], []]
            for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(bucket)], strict=True):
                odd = np.flatnonzero(n2[x:y] != 1)
                rows[0].append(int(bucket[x]))
                rows[1].append(h2[x:y].tobytes())
                rows[2].append(np.diff(d2[x:y], prepend=0).tobytes())
                rows[3].append(np.stack([odd, n2[x:y][odd]]).astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], type=pa.int64()), *[pa.array(r, type=pa.binary()) for r in rows[1:]]], names=["bucket", "h", "d", "n"])

    def count(key: tuple, table: pa.Table) -> pa.Table:
        h = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in table.column("h").to_pylist()])
        d = np.concatenate([np.cumsum(np.frombuffer(x, dtype=np.int64)) for x in table.column("d").to_pylist()])
        n = np.ones(len(h), dtype=np.int64)
        at = 0
        for x, odd in zip(table.column("h").to_pylist(), table.column("n").to_pylist(), strict=True):
            where, value = np.frombuffer(odd, dtype=np.int64).reshape(2, -1)
            n[at + where] = value
            at += len(x) // 8
        by = np.argsort(h, kind="stable")
        h, d, n = h[by], d[by], n[by]
        begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        several = np.minimum.reduceat(d, begin) < np.maximum.reduceat(d, begin)
        return pa.table({"h": h[begin][several], "n": np.add.reduceat(n, begin)[several]})

    return base.mapInArrow(pack, "bucket long, h binary, d binary, n binary").groupBy("bucket").applyInArrow(count, "h long, n long")


class Bloom:
    """A set of 64-bit hashes that may hold others too, in at most `FILTER_MOST` bits; built in pieces by low bits."""

    PIECES = 64

    def __init__(self, bits: int, data: np.ndarray):
        self.bits, self.data = bits, data

    @staticmethod
    def _places(h: np.ndarray, bits: int) -> np.ndarray:
        """Places of each hash in its piece of ``bits`` bits."""
        x = h.view(np.uint64)
        return np.stack([_mixed(x + _LEVELS[k]) & np.uint64(bits - 1) for k in range(3)])

    @classmethod
    def of(cls, hashes: DataFrame, n: int) -> Bloom:
        """The filter of the column ``h`` of n rows; its pieces, 1 MB at most each, reach the driver."""
        bits = 1 << 10
        while bits * cls.PIECES < min(n * FILTER_BITS, FILTER_MOST):
            bits *= 2

        def build(key: tuple, table: pa.Table) -> pa.Table:
            held = np.zeros(bits, dtype=bool)
            held[cls._places(table.column("h").to_numpy(), bits).ravel()] = True
            return pa.table({"piece": [key[0].as_py()], "data": [np.packbits(held, bitorder="little").tobytes()]})

        data = np.zeros((cls.PIECES, bits // 8), dtype=np.uint8)
        parts = max(1, n // cls.PIECES // 4_000_000)
        small = hashes.select(F.col("h").bitwiseAND(F.lit(cls.PIECES - 1).cast("long")).alias("piece"), F.pmod(F.xxhash64("h"), F.lit(parts)).alias("part"), "h")
        rows = small.groupBy("piece", "part").applyInArrow(build, "piece long, data binary").toArrow()
        for piece, part in zip(rows.column("piece").to_pylist(), rows.column("data").to_pylist(), strict=True):
            data[piece] |= np.frombuffer(part, dtype=np.uint8)
        return cls(bits, data.reshape(-1))

    def holds(self, h: np.ndarray) -> np.ndarray:
        piece = (h & np.int64(self.PIECES - 1)).astype(np.uint64) * np.uint64(self.bits)
        out = np.ones(len(h), dtype=bool)
        for place in self._places(h, self.bits):
            at = piece + place
            out &= (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def _context_rows(base: DataFrame, wanted: Bloom, hot: Bloom) -> DataFrame:
    """(key, ch, doc, th, start, n, ctx, chunk): stretches of n strings, from ``start``, that may be repeated.

    Those of strings that share a least hash among ``wanted`` are keyed by it; with one in ``hot`` there is a row per
    string, keyed by the string's own hash, so that a very common hash isn't one group (a hash that a filter holds wrongly
    costs work, no result: all texts do the same). Chunks that later documents have too (of which this is the first one)
    are keyed by their digest.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            repeated, firsts = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for at, text in _pieces(_bodies(batch.column(2))):
                h, own, start, n = _runs(text, *_fresh(text, repeated[at : at + len(text.sizes)]))
                ok = wanted.holds(h)
                h, own, start, n = h[ok], own[ok], start[ok], n[ok]
                single = hot.holds(h)
                each = np.where(single, n, 1)
                number = _ranges(np.zeros(len(each), dtype=np.int64), each)
                h, own, start, n = np.repeat(h, each), np.repeat(own, each), np.repeat(start, each) + number, np.repeat(np.where(single, 1, n), each)
                alone = np.repeat(single, each)
                h = h.copy()
                h[alone] = text.strings(start[alone]).view(np.int64)
                ch = np.zeros(len(h), dtype=np.int64)
                a, b = _chunks_of(text, firsts[at : at + len(text.sizes)])
                if len(a):
                    digest = _digests(text, a, b)
                    h, ch = np.concatenate([h, digest[:, 0]]), np.concatenate([ch, digest[:, 1]])
                    own, start, n = np.concatenate([own, np.searchsorted(text.ends, a, side="right")]), np.concatenate([start, a]), np.concatenate([n, b - a])
                plain = len(alone)
                for k in range(0, len(h), 20_000):
                    s = slice(k, k + 20_000)
                    which = pa.array(own[s] + at)
                    ctx = [text.raw[x:y] for x, y in zip(start[s].tolist(), (start + n + LENGTH - 1)[s].tolist(), strict=True)]
                    chunk = np.arange(k, k + len(ctx)) >= plain
                    code = ch[s].copy()
                    code[~chunk] = [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x, c in zip(ctx, chunk.tolist(), strict=True) if not c]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[s]), pa.array(code), batch.column(0).take(which), batch.column(1).take(which), pa.array(start[s] - text.begins[own[s]]), pa.array(n[s]), pa.array(ctx, type=pa.binary()), pa.array(chunk)],
                        names=["key", "ch", "doc", "th", "start", "n", "ctx", "chunk"])

    return base.mapInArrow(run, "key long, ch long, doc long, th long, start long, n long, ctx binary, chunk boolean")


def _digests(text: Text, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """128-bit digests of the chunks of starts [a, b), with all the bytes that their strings reach, as two columns."""
    view = memoryview(text.raw)
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[x:y]) for x, y in zip(a.tolist(), (b + LENGTH - 1).tolist(), strict=True)]), dtype="<i8").reshape(-1, 2)


def smallest_holders(stretches: list[bytes], low: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For every string of `LENGTH` bytes of every stretch, in order, the smallest ``low`` of the stretches of its group
    that hold it, by the suffix order of the group's stretches laid end to end.

    ``group`` is ascending. Short groups are sorted together, long ones one by one; equal strings stand side by side in
    the order and are told by their bytes. Equal stretches of a group are sorted once: what follows a separator is no part
    of a string, so suffixes of copies stand side by side, and each is put beside that of the copy sorted.
    """
    if not stretches:
        return np.zeros(0, dtype=np.int64)
    number: dict[tuple[int, bytes], int] = {}
    which = np.array([number.setdefault(x, len(number)) for x in zip(group.tolist(), stretches, strict=True)], dtype=np.int64)
    raw = np.frombuffer(b"\0".join([x for _, x in number]) + b"\0" * 9, dtype=np.uint8)  # a separator after each, and room to read 8 bytes anywhere
    size = np.array([len(x) for _, x in number], dtype=np.int64)
    of = np.array([g for g, _ in number], dtype=np.int64)
    begin_of = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    length = np.add.reduceat(size + 1, begin_of)
    total = int(length.sum())
    symbols = raw[:total].astype(np.int16) + 2
    ends = np.cumsum(size + 1)
    symbols[ends - 1] = 1  # smaller than all bytes
    offset = np.cumsum(length) - length
    starts = _ranges(ends - size - 1, np.maximum(ends - LENGTH, ends - size - 1))
    owner = np.repeat(np.arange(len(size)), np.maximum(size - LENGTH + 1, 0))
    place = np.full(total, -1, dtype=np.int64)
    place[starts] = np.arange(len(starts))
    orders = []
    by = np.argsort(length, kind="stable")
    upto = np.cumsum(length[by] + 1)
    k = 0
    while k < len(by):
        end = int(min(np.searchsorted(upto, BATCH + (upto[k - 1] if k else 0), side="right"), np.searchsorted(length[by], TOGETHER, side="right")))
        if end - k >= FEWEST:
            own = by[k:end]
            a, n = offset[own], length[own] + 1
            led = symbols[_ranges(a - 1, a + length[own])]
            begin = np.cumsum(n) - n
            led[begin] = 0
            found = suffix_orders(led, n) + np.repeat(a - begin - 1, n)
            found[begin] = total - 1  # a separator: no string starts there
            orders.append(found)
        else:
            end = max(end, k + 1)
            for g in by[k:end].tolist():
                orders.append(np.array(suffix_array(symbols[offset[g] : offset[g] + length[g]].tolist()), dtype=np.int64) + offset[g])
        k = end
    order = place[np.concatenate(orders)]
    order = order[order >= 0]  # whole strings, in lexical order inside each group
    # each with its copies
    copies, per = np.argsort(which, kind="stable"), np.bincount(which)
    base = np.cumsum(np.maximum(size - LENGTH + 1, 0)[which]) - np.maximum(size - LENGTH + 1, 0)[which]
    mine = owner[order]
    first = np.cumsum(per) - per
    holder = copies[_ranges(first[mine], first[mine] + per[mine])]
    here = np.repeat(starts[order], per[mine])
    string = base[holder] + here - (ends - size - 1)[which[holder]]
    word = np.ndarray(total + 1, dtype="<u8", buffer=raw.data, strides=(1,))
    new = np.ones(len(here), dtype=bool)
    kin = group[holder]
    new[1:] = kin[1:] != kin[:-1]
    for j in (*range(0, LENGTH - 7, 8), LENGTH - 8):
        w = word[here + j]
        new[1:] |= w[1:] != w[:-1]
    begin = np.flatnonzero(new)
    out = np.empty(len(here), dtype=np.int64)
    if len(here):
        out[string] = np.repeat(np.minimum.reduceat(low[holder], begin), np.diff(np.append(begin, len(here))))
    return out


def _may_repeat(bodies: list[bytes], low: np.ndarray, later: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which strings of the stretches to sort: those of stretches that later documents have, and those whose hash
    stretches of different documents have."""
    if not len(own):
        return np.zeros(0, dtype=bool)
    text = Text(bodies)
    kind = np.unique(text.strings(_ranges(text.begins, text.begins + text.starts())), return_inverse=True)[1]
    least, most = np.full(kind.max() + 1, NO_ID), np.full(kind.max() + 1, -NO_ID)
    np.minimum.at(least, kind, low[own])
    np.maximum.at(most, kind, low[own])
    return later[own] | (least != most)[kind]


def _sorted_out(table: pa.Table) -> pa.Table:
    """`_answers` of the stretches (key, ch, ctx, low, high) of a shard."""
    table = table.sort_by("key")
    keys, low, high = (table.column(c).to_numpy() for c in ("key", "low", "high"))
    later = high > low
    alone = np.concatenate([[True], keys[1:] != keys[:-1]]) & np.concatenate([keys[1:] != keys[:-1], [True]])
    table, low, high, later = (x.filter(pa.array(later | ~alone)) if isinstance(x, pa.Table) else x[later | ~alone] for x in (table, low, high, later))
    bodies, keys = table.column("ctx").to_pylist(), table.column("key").to_numpy()
    n = np.array([len(s) - LENGTH + 1 for s in bodies], dtype=np.int64)
    begins = np.cumsum(n) - n
    own = np.repeat(np.arange(len(n)), n)
    some = _may_repeat(bodies, low, later, own)
    new = np.flatnonzero(some & ~(np.concatenate([[False], some[:-1]]) & np.concatenate([[False], own[1:] == own[:-1]])) if len(some) else some)
    count = np.diff(np.append(np.searchsorted(np.flatnonzero(some), new), int(some.sum())))
    parts = [(g, bodies[k][x : x + m + LENGTH - 1]) for g, k, x, m in zip(keys[own[new]].tolist(), own[new].tolist(), (new - begins[own[new]]).tolist(), count.tolist(), strict=True)]
    # equal stretches of a group stand in the order twice at most: for the first and for the last document that has them
    number: dict[tuple[int, bytes], int] = {}
    which = np.array([number.setdefault(p, len(number)) for p in parts], dtype=np.int64)
    first, last = np.full(len(number), NO_ID), np.full(len(number), -NO_ID)
    np.minimum.at(first, which, low[own[new]])
    np.maximum.at(last, which, high[own[new]])
    copies = np.repeat(np.arange(len(number)), np.where(last > first, 2, 1))
    end = np.searchsorted(copies, np.arange(len(number)), side="right") - 1
    doc = first[copies]
    doc[end] = last
    names = list(number)
    stretches = [names[k][1] for k in copies.tolist()]
    found = smallest_holders(stretches, doc, np.array([g for g, _ in names], dtype=np.int64)[copies])
    cut = np.cumsum([0, *(len(x) - LENGTH + 1 for x in stretches)])
    # what the order says of the last document's copy holds for all documents after the owners that it names
    owner = high[own]
    owner[some] = found[_ranges(cut[end[which]], cut[end[which] + 1])]
    hit = owner < high[own]
    edge = np.ones(len(hit) + 1, dtype=bool)  # runs end with their stretch, and where the owner changes
    edge[1:-1] = (own[1:] != own[:-1]) | (owner[1:] != owner[:-1])
    a = np.flatnonzero(hit & edge[:-1])
    b = np.flatnonzero(hit & edge[1:]) + 1
    of = own[a]
    flat = pa.StructArray.from_arrays([pa.array(a - begins[of]), pa.array(b - begins[of]), pa.array(owner[a])], names=["a", "b", "owner"])
    runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(n) + 1)).astype(np.int32)), flat)
    return pa.table({"key": table.column("key"), "ch": table.column("ch"), "n": pa.array(n), "runs": runs}).filter(pa.array(np.isin(np.arange(len(n)), of)))


def _answers(contexts: DataFrame) -> DataFrame:
    """(key, ch, n, runs) of the distinct stretches, of n strings, that hold strings which some earlier document has: the
    suffix order names the smallest document, the ``owner``, of every string; runs are of one owner."""
    total = contexts.agg(F.sum(F.octet_length("ctx"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        return _sorted_out(table)

    # what later documents have of a chunk isn't among the stretches, but its first document knows of them
    high = F.greatest(F.max("doc"), F.max(F.when(F.col("chunk"), F.lit(NO_ID))))
    distinct = contexts.groupBy("key", "ch", "ctx").agg(F.min("doc").alias("low"), high.alias("high"))
    shard = F.pmod("key", F.lit(shards)).alias("shard")
    return distinct.select(shard, "key", "ch", "ctx", "low", "high").groupBy("shard").applyInArrow(run, "key long, ch long, n long, runs array<struct<a:long,b:long,owner:long>>")


def repeated_spans(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept) for every row of ``docs``.

    Bytes covered by a string of `LENGTH` bytes that also starts in a document with a smaller id are removed;
    ``spans`` are the maximal removed runs as (from, to) in bytes, ``kept`` the remaining bytes. Strings are
    judged on the input, overlaps count, and nothing matches across documents. A null text is empty. Rows that
    share an id don't remove from each other. A missing id is larger than all others.

    1. Texts are cut into chunks by content; equal chunks are ordered once.
    2. The least gram hash of every string in the other chunks is counted; what may repeat shares one.
    3. Strings with such a hash are gathered by it; those whose own hash occurs again, and the chunks of 1, are sorted by
       suffix arrays, equal stretches for the first and the last document that has them. Equal strings stand side by side
       in the order and are compared byte for byte; the smallest document among them owns the string. What a document
       has of a stretch goes where the owner is smaller.
    Hashes are filters, and tell which documents have a stretch: 64 bits beside a 64-bit key, 128 bits for chunks. A text is
    hashed whole, at some 30 bytes of memory for each of its bytes.
    """
    source = docs.select(F.coalesce(F.col(id).cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    source = source.withColumn("th", F.xxhash64("text"))
    chunks = written(_chunk_rows(source), "chunks", "zstd")
    several = chunks.groupBy("hi", "lo").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("hi", "lo", "low")
    shared = written(chunks.join(several, ["hi", "lo"]).select("hi", "lo", "doc", "th", "number", (F.col("doc") > F.col("low")).alias("later")), "shared", "zstd")
    lists = shared.groupBy("doc", "th").agg(F.collect_set(F.when(F.col("later"), F.col("number"))).alias("again"), F.collect_set(F.when(~F.col("later"), F.col("number"))).alias("firsts"))
    # rows that share id and text have the same lists; four bytes for each repeated chunk: small lists go to all executors, longer ones meet the texts in a shuffle
    base = source.join(_sent(written(lists, "lists", "zstd"), F.size("again") + F.size("firsts"), 4), ["doc", "th"], "left").select("doc", "th", "text", "again", "firsts")

    runs = chunks.count() * CHUNK // 18  # about as many as least hashes
    buckets = 256
    while buckets < 65_536 and buckets * 100_000 < runs:
        buckets *= 2
    most = max(HOT, min(HOT_MOST, runs // 2_000))
    hashes = written(_shared_hashes(base, buckets).select("h", (F.col("n") > most).alias("hot")), "hashes")
    n_hot, n = hashes.agg(F.count_if("hot"), F.count("*")).first()
    contexts = written(_context_rows(base, Bloom.of(hashes, n), Bloom.of(hashes.where("hot"), n_hot)), "contexts", "zstd")
    answers = written(_answers(contexts), "answers")
    held = contexts.select("key", "ch", "doc", "th", "start").join(answers, ["key", "ch"])
    runs = held.select("doc", "th", "start", F.explode("runs").alias("r")).where("r.owner < doc")
    runs = runs.select("doc", "th", F.struct((F.col("start") + F.col("r.a")).alias("a"), (F.col("start") + F.col("r.b")).alias("b")).alias("r"))
    marks = runs.groupBy("doc", "th").agg(F.collect_list("r").alias("runs"))  # bounded by the document's length
    marks = written(_joined_up(marks), "marks", "zstd")
    # a copy of a chunk goes whole where all its strings have earlier owners
    chunk = answers.where(F.aggregate("runs", F.lit(0).cast("long"), lambda t, r: t + r.b - r.a) == F.col("n"))
    chunk = chunk.select(F.col("key").alias("hi"), F.col("ch").alias("lo"), F.array_max(F.transform("runs", lambda r: r.owner)).alias("owner"))
    copies = shared.where("later").join(chunk, ["hi", "lo"]).where("owner < doc")
    copies = written(copies.groupBy("doc", "th").agg(F.collect_set("number").alias("again")), "copies", "zstd")
    rows = source.join(_sent(copies, F.size("again"), 4), ["doc", "th"], "left").join(_sent(marks, F.size("runs"), 16), ["doc", "th"], "left")
    out = _cut(rows.select("doc", "text", "again", "runs"))
    return out.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "spans", "kept")


def _sent(lists: DataFrame, size: Column, each: int) -> DataFrame:
    """Lists by document, broadcast where their entries of so many bytes are few."""
    entries = lists.agg(F.sum(size + 4)).first()[0] or 0
    return F.broadcast(lists) if entries * each <= BROADCAST_BYTES else lists


def _joined_up(marks: DataFrame) -> DataFrame:
    """(doc, th, runs) with ranges that meet or overlap as one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column(2)
            flat, row = runs.flatten(), np.repeat(np.arange(batch.num_rows), runs.value_lengths().to_numpy())
            a, b = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            wide = int(b.max(initial=0)) + 2  # keeps rows apart
            by = np.lexsort((a, row))
            a, b, row = a[by] + row[by] * wide, b[by] + row[by] * wide, row[by]
            top = np.maximum.accumulate(b)
            new = np.flatnonzero(np.concatenate([[True], a[1:] > top[:-1]])) if len(a) else np.zeros(0, dtype=np.int64)
            last = np.append(new[1:], len(a)) - 1
            shift = row[new] * wide
            pairs = pa.StructArray.from_arrays([pa.array(a[new] - shift), pa.array(top[last] - shift)], names=["a", "b"])
            offsets = np.searchsorted(row[new], np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), pairs)], names=["doc", "th", "runs"])

    return marks.select("doc", "th", "runs").mapInArrow(run, "doc long, th long, runs array<struct<a:long,b:long>>")


def _chunks_of(text: Text, numbers: list[list[int] | None]) -> tuple[np.ndarray, np.ndarray]:
    """Where the chunks of these numbers of each text start and where their starts end."""
    has = [k for k, x in enumerate(numbers) if x]
    if not has:
        none = np.zeros(0, dtype=np.int64)
        return none, none
    some = Text([text.raw[text.begins[k] : text.ends[k]] for k in has])
    own, a, b = some.chunks()
    first = np.searchsorted(own, np.arange(len(has)))
    which = np.concatenate([first[i] + np.array(numbers[k]) for i, k in enumerate(has)])
    shift = (text.begins[has] - some.begins)[own[which]]
    return a[which] + shift, b[which] + shift


def _cut(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        for batch in batches:
            again = batch.column(2).to_pylist()
            marks = batch.column(3)
            flat, size = marks.flatten(), marks.value_lengths().fill_null(0).to_numpy()
            a = flat.field(0).to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0, dtype=np.int64)
            b = flat.field(1).to_numpy(zero_copy_only=False) if len(flat) else a
            upto = np.concatenate([[0], np.cumsum(size)])
            for at, text in _pieces(_bodies(batch.column(1)), hashed=False):
                n = len(text.sizes)
                delta = np.zeros(len(text.raw) + LENGTH + 1, dtype=np.int32)
                x, y = _chunks_of(text, again[at : at + n])
                s = slice(upto[at], upto[at + n])
                shift = np.repeat(text.begins, size[at : at + n])
                np.add.at(delta, np.concatenate([x, a[s] + shift]), 1)
                np.add.at(delta, np.concatenate([y, b[s] + shift]) + LENGTH - 1, -1)
                gone = np.cumsum(delta[: len(text.raw)]) > 0
                edges = np.zeros(len(text.raw) + 1, dtype=bool)  # runs end with their text
                edges[text.begins] = True
                begin = np.flatnonzero(gone & ~np.concatenate([[False], gone[:-1]]) | gone & edges[:-1])
                end = np.flatnonzero(gone & (~np.concatenate([gone[1:], [False]]) | np.concatenate([edges[1:-1], [True]]))) + 1 if len(gone) else begin
                of = np.searchsorted(text.ends, begin, side="right")
                total = np.concatenate([[0], np.cumsum(gone)])
                removed = total[text.ends] - total[text.begins]
                n_spans = np.bincount(of, minlength=n)
                kept, spans, k = [], [], 0
                for i in range(n):
                    lo, hi = int(text.begins[i]), int(text.ends[i])
                    mine = list(zip(begin[k : k + n_spans[i]].tolist(), end[k : k + n_spans[i]].tolist(), strict=True))
                    k += int(n_spans[i])
                    parts, left = [], lo
                    for p, q in mine:
                        parts.append(text.raw[left:p])
                        left = q
                    parts.append(text.raw[left:hi])
                    kept.append(b"".join(parts))
                    spans.append([{"from": p - lo, "to": q - lo} for p, q in mine])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), pa.array(text.sizes), pa.array(removed), pa.array(n_spans.astype(np.int64)), pa.array(spans, type=span), pa.array(kept, type=pa.binary())],
                    names=["doc", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return rows.mapInArrow(run, "doc long, n_bytes long, n_removed long, n_spans long, spans array<struct<from:long,to:long>>, kept binary")
