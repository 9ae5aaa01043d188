"""Operator 11: phrases whose words occur together more often than apart, counted in direct-address tiles."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

#: Occurrences that make a phrase a candidate, words of the longest ones, rows of the report for each language, and the
#: percentage of a phrase's occurrences inside one longer candidate from which on it isn't reported.
LEAST, LONGEST, TOP, COVER = 10, 3, 2000, 50
#: A tile is 2^TILE_BITS ids square; tiles of the first HEAD_TILES by HEAD_TILES are counted densely where they hold a
#: pair for every SPARSE cells at least.
TILE_BITS, HEAD_TILES, SPARSE = 9, 16, 8
#: Pairs that a task counts at once, and words that it keeps the ids of.
FLUSH, KEPT_WORDS = 1 << 19, 1 << 17
#: Frequent words and phrases that are sent to the tasks (16 bytes each). Beyond, see `mine`.
SENT = 1 << 21
#: Bytes of a text that are split at once.
PIECE = 1 << 22

UNKNOWN = "und"
GAP, BEYOND = -1, -2  # ids of what ends a phrase (a piece's end or a rare word), and of words that weren't sent

_SPLIT = bytes(b"\n"[0] if b in b".,;:!?\n\x0b\x0c\r" else b" "[0] if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_CUT = re.compile(rb"[\x20\x09-\x0d.,;:!?]")


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, lists of bounded size (but for longer words); ``b"\\n"`` ends a piece, ``b""`` is nothing."""
    at = 0
    while at < len(text):
        cut = _CUT.search(text, at + PIECE) if len(text) > at + PIECE else None
        end = cut.start() if cut else len(text)
        yield text[at:end].translate(_SPLIT).replace(b"\n", b" \n ").split(b" ")
        at = end


class Vocabulary(dict):
    """Numbers of the words met by a task, in the order they were met: 0 is nothing, 1 the end of a piece."""

    def __init__(self, seed: int) -> None:
        super().__init__({b"": 0, b"\n": 1})
        self.seed, self.words, self.hashes = seed, [b"", b"\n"], np.zeros(2, dtype=np.int64)

    def __missing__(self, word: bytes) -> int:
        self.words.append(word)
        n = self[word] = len(self)
        return n

    def numbers(self, text: bytes) -> np.ndarray:
        """The number of each word of a text and of each end of a piece, and one more of these at the end."""
        parts = [np.fromiter(map(self.__getitem__, part), dtype=np.int32, count=len(part)) for part in tokens(text)]
        out = np.concatenate([*parts, np.ones(1, dtype=np.int32)])
        return out[out != 0]

    def hashed(self) -> np.ndarray:
        """The 64-bit hash of every word."""
        fresh = [xxhash.xxh64_intdigest(w, self.seed) for w in self.words[len(self.hashes) :]]
        self.hashes = np.concatenate([self.hashes, np.array(fresh, dtype=np.uint64).view(np.int64)])
        return self.hashes


def tile_counts(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of ids (by rank of frequency, from 0) and how often each occurs.

    Pairs of frequent ids fall into a grid of tiles. A well-filled tile is an array of counts addressed by the pair
    itself (``np.bincount``); the pairs of all others are sorted and counted as coordinates.
    """
    side = HEAD_TILES << TILE_BITS
    tile = np.where((left < side) & (right < side), (left >> TILE_BITS) * HEAD_TILES + (right >> TILE_BITS), HEAD_TILES * HEAD_TILES).astype(np.int16)
    full = np.bincount(tile, minlength=HEAD_TILES * HEAD_TILES + 1) >= (1 << 2 * TILE_BITS) // SPARSE
    full[-1] = False
    dense = np.flatnonzero(full[tile])
    dense = dense[np.argsort(tile[dense], kind="stable")]
    low = (1 << TILE_BITS) - 1
    lefts, rights, counts = [], [], []
    ends = np.searchsorted(tile[dense], np.arange(len(full) + 1))
    for t in np.flatnonzero(full):
        own = dense[ends[t] : ends[t + 1]]
        cells = np.bincount((left[own] & low) << TILE_BITS | right[own] & low, minlength=1 << 2 * TILE_BITS)
        seen = np.flatnonzero(cells)
        lefts.append((t // HEAD_TILES << TILE_BITS) + (seen >> TILE_BITS))
        rights.append((t % HEAD_TILES << TILE_BITS) + (seen & low))
        counts.append(cells[seen])
    rest = ~full[tile]
    code, n = np.unique(left[rest] << 31 | right[rest], return_counts=True)
    return np.concatenate([*lefts, code >> 31]), np.concatenate([*rights, code & (1 << 31) - 1]), np.concatenate([*counts, n])


class Ids:
    """Ids by rank of frequency for the sorted keys of one language: of words (their hashes) or of phrases (pairs of ids)."""

    def __init__(self, keys: np.ndarray, n: np.ndarray) -> None:
        order = np.lexsort((keys, -n))
        self.by_id = keys[order]
        at = np.argsort(self.by_id)
        self.keys, self.ids = self.by_id[at], at

    def of(self, keys: np.ndarray, missing: int) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), missing, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ids[at], missing)


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("binary").alias("text"))


def _batched(names: list[str], lang: str, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), 1 << 16):
        part = [pa.array(c[at : at + (1 << 16)]) for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part[0])), *part], names=["lang", *names])


def count_words(texts: DataFrame, seed: int) -> DataFrame:
    """Occurrences ``n`` of each word (``h``: its hash) by ``lang``; ``other`` differs from ``word`` if two words share a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[Vocabulary, list[np.ndarray]]] = {}

        def emitted() -> Iterator[pa.RecordBatch]:
            for lang, (vocabulary, seen) in known.items():
                n = np.bincount(np.concatenate(seen), minlength=len(vocabulary))
                words, h = vocabulary.words, vocabulary.hashed()
                for at in range(2, len(words), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words[part])), pa.array(h[part]), pa.array(words[part], type=pa.binary()), pa.array(n[part])], names=["lang", "h", "word", "n"])
            known.clear()

        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                vocabulary, seen = known.setdefault(lang, (Vocabulary(seed), []))
                before = len(vocabulary)
                seen.append(vocabulary.numbers(text or b""))
                size += len(seen[-1]) + 8 * (len(vocabulary) - before)
                if size > 2 * FLUSH:
                    yield from emitted()
                    size = 0
        yield from emitted()

    rows = texts.mapInArrow(run, "lang string, h long, word binary, n long")
    return rows.groupBy("lang", "h").agg(F.sum("n").alias("n"), F.min("word").alias("word"), F.max("word").alias("other"))


def _cut(counted: DataFrame, most: int) -> tuple[int, bool]:
    """The lowest count from which on at most ``most`` rows have it, and whether these are all rows."""
    place = F.floor(F.log2("n") * 8)
    sizes = counted.groupBy(place.alias("place")).agg(F.count("*").alias("rows"), F.min("n").alias("low")).collect()  # a row per eighth of a power of two
    total, low = 0, 1 << 62
    for r in sorted(sizes, key=lambda r: -r["place"]):
        total += r["rows"]
        if total > most:
            return low, False
        low = r["low"]
    return low, True


def _sent(counted: DataFrame, columns: list[str], most: int) -> tuple[dict[str, tuple[np.ndarray, ...]], bool]:
    """The most frequent rows, at most ``most``, by language: the columns and ``n``; and whether they are all rows."""
    low, every = _cut(counted, most)
    rows = counted.where(F.col("n") >= low).select("lang", *columns, "n").toArrow()  # bounded by ``most``
    langs = rows.column("lang").combine_chunks().dictionary_encode() if rows.num_rows else pa.array([], type=pa.string()).dictionary_encode()
    number = langs.indices.to_numpy()
    values = [rows.column(c).to_numpy() for c in (*columns, "n")]
    return {lang: tuple(v[number == k] for v in values) for k, lang in enumerate(langs.dictionary.to_pylist())}, every


def count_phrases(texts: DataFrame, size: int, words: dict[str, tuple[np.ndarray, ...]], every_word: bool, shorter: list[dict[str, tuple[np.ndarray, ...]]], seed: int) -> DataFrame:
    """Occurrences ``n`` of phrases of ``size`` words, ``h1`` to ``h<size>`` their hashes, by ``lang``; all that occur
    `LEAST` times are among them.

    ``words`` are the frequent words; with ``every_word`` any other is rare and ends a phrase. ``shorter`` are the
    frequent phrases of 2 to ``size`` - 1 words; if they are all given, phrases are counted as pairs of a shorter phrase
    and a word, each by its rank, otherwise by the hashes of their words.
    """
    shared = texts.sparkSession.sparkContext.broadcast((words, shorter))
    paired = every_word and len(shorter) == size - 2
    names = [f"h{k}" for k in range(1, size + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, phrases = shared.value
        made: dict[str, tuple[Ids, list[Ids]]] = {}
        known: dict[str, tuple[Vocabulary, list[np.ndarray]]] = {}
        pending = 0

        def ids_of(lang: str) -> tuple[Ids, list[Ids]]:
            if lang not in made:
                none = np.zeros(0, dtype=np.int64)
                ids, levels = Ids(*listed.get(lang, (none, none))), []
                for k, level in enumerate(phrases):
                    rows = level.get(lang, (none,) * (k + 3))
                    left = ids.of(rows[0], GAP)
                    for j in range(k):
                        left = levels[j].of(left << 31 | ids.of(rows[j + 1], GAP), GAP)
                    levels.append(Ids(left << 31 | ids.of(rows[k + 1], GAP), rows[-1]))
                made[lang] = ids, levels
            return made[lang]

        def spelled(ids: Ids, levels: list[Ids], left: np.ndarray) -> list[np.ndarray]:
            out: list[np.ndarray] = []
            for level in reversed(levels):
                code = level.by_id[left]
                out.insert(0, ids.by_id[code & (1 << 31) - 1])
                left = code >> 31
            return [ids.by_id[left], *out]

        def counted(lang: str, vocabulary: Vocabulary, seen: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            ids, levels = ids_of(lang)
            number = np.concatenate(seen)
            hashes = vocabulary.hashed()
            by_word = ids.of(hashes, GAP if every_word else BEYOND)
            by_word[1] = GAP
            word = by_word[number]
            places = len(word) - size + 1
            if places <= 0:
                return
            if paired:
                left, fine = word, word >= 0
                for k, level in enumerate(levels):
                    code = left[:-1] << 31 | word[k + 1 :]
                    there = (left[:-1] >= 0) & (word[k + 1 :] >= 0)
                    left = np.where(there, level.of(code, GAP), GAP)
                fine = (left[:-1] >= 0) & (word[size - 1 :] >= 0)
                if size > 2:
                    fine &= left[1:] >= 0  # its last words are a frequent phrase too
                one, other, n = tile_counts(left[:-1][fine], word[size - 1 :][fine])
                yield from _batched([*names, "n"], lang, [*spelled(ids, levels, one), ids.by_id[other], n])
                return
            fine = np.ones(places, dtype=bool)
            ranked = np.ones(places, dtype=bool)
            for k in range(size):
                fine &= word[k : places + k] != GAP
                ranked &= word[k : places + k] >= 0
            if size == 2:
                one, other, n = tile_counts(word[:places][ranked], word[1:][ranked])
                yield from _batched([*names, "n"], lang, [ids.by_id[one], ids.by_id[other], n])
                fine &= ~ranked
            h = hashes[number]
            rows = np.stack([h[k : places + k][fine] for k in range(size)], axis=1)
            order = np.lexsort(rows.T[::-1])
            rows = rows[order]
            first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])) if len(rows) else np.zeros(0, dtype=np.int64)
            n = np.diff(np.append(first, len(rows)))
            yield from _batched([*names, "n"], lang, [*rows[first].T.copy(), n])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                vocabulary, seen = known.setdefault(lang, (Vocabulary(seed), []))
                before = len(vocabulary)
                seen.append(vocabulary.numbers(text or b""))
                pending += len(seen[-1]) + len(vocabulary) - before
                if pending > FLUSH:
                    for name, (v, s) in known.items():
                        if s:
                            yield from counted(name, v, s)
                            s.clear()
                    if sum(len(v) for v, _ in known.values()) > KEPT_WORDS:
                        known.clear()
                    pending = 0
        for name, (v, s) in known.items():
            if s:
                yield from counted(name, v, s)

    rows = texts.mapInArrow(run, f"lang string, {', '.join(f'{c} long' for c in names)}, n long")
    return rows.groupBy("lang", *names).agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def _exact_score(a: Column, both: Column) -> Column:
    """floor(1,000,000 a^2 / both) without rounding, while a < 10^15."""
    wide = a.cast("decimal(15,0)")
    return F.call_function("div", wide * wide * F.lit(1_000_000).cast("decimal(7,0)"), both)


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, top: int | None = TOP, sent: int = SENT) -> DataFrame:
    """The phrases of 2 to ``longest`` words of each language that occur together most exclusively.

    Texts are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these at blanks and tabs into words, A-Z lower-cased, on
    bytes. A phrase (adjoining words of a piece) that occurs ``a`` >= `LEAST` times is a candidate; cut after its first
    k words into parts that occur l and r times it scores floor(10^6 a^2 / (l r)), and its lowest score counts (of equal
    ones the smallest k). Candidates of whose occurrences `COVER` % or more lie inside one longer candidate aren't
    reported. Returns ``lang, rank, phrase, a, l, r, n, score`` for the first ``top`` of each language by score and a
    (descending) and phrase (bytes, ascending); all with None.

    Words are counted first, then pairs of frequent words, then longer phrases as pairs of a frequent phrase and a word.
    Each has an id by its rank, so that a task counts frequent ones in tiles (`tile_counts`), and Spark adds up the
    tasks' distinct pairs. Keys between the stages are 64-bit hashes of words that no two words of a language share:
    this is checked, another seed is tried otherwise. Only the ``sent`` most frequent words or phrases are sent to tasks;
    where there are more, the others are counted by their hashes, as are phrases longer than those: the same rows with
    more bytes to shuffle.

    A null text is empty, a null language ``und``; texts without words count for nothing; repeated rows count each;
    other columns don't matter. A very long text is split bit by bit; a task holds 8 bytes for each of its words.
    """
    if longest < 2:
        raise ValueError("longest must be at least 2")
    texts = _texts(docs, text, lang)
    for seed in range(8):
        vocabulary = written(count_words(texts, seed), "words")
        if not vocabulary.where(F.col("word") != F.col("other")).limit(1).count():
            break
    else:
        raise RuntimeError("words share hashes under every seed")
    words = vocabulary.where(F.col("n") >= LEAST).select("lang", F.col("h").alias("h1"), "word", "n")
    listed, every_word = _sent(words, ["h1"], sent)
    levels: list[DataFrame] = [words]
    shorter: list[dict[str, tuple[np.ndarray, ...]]] = []
    for size in range(2, longest + 1):
        found = written(count_phrases(texts, size, listed, every_word, shorter, seed), f"phrases{size}")
        levels.append(found)
        if size < longest and every_word and len(shorter) == size - 2:
            rows, every = _sent(found, [f"h{k}" for k in range(1, size + 1)], sent)
            if every:
                shorter.append(rows)
    scored = [_scored(levels, size) for size in range(2, longest + 1)]
    out = scored[0]
    for more in scored[1:]:
        out = out.unionByName(more)
    totals = vocabulary.groupBy("lang").agg(F.sum("n").alias("all"))
    if top is not None:
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    else:
        out = out.withColumn("rank", F.lit(None).cast("long"))
    return out.join(F.broadcast(totals) if _few(totals) else totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", F.col("all").alias("n"), "score"
    )


def _few(totals: DataFrame) -> bool:
    """Whether there are at most 10,000 languages."""
    return totals.limit(10_001).count() <= 10_000


def _scored(levels: list[DataFrame], size: int) -> DataFrame:
    """The candidates of ``size`` words that no longer one covers, with their words and scores."""
    h = [f"h{k}" for k in range(1, size + 1)]
    rows = levels[size - 1].withColumnRenamed("n", "a")
    inside = [
        longer.select("lang", *[F.col(f"h{at + k}").alias(f"h{k}") for k in range(1, size + 1)], "n")
        for length, longer in enumerate(levels[size:], size + 1) for at in range(length - size + 1)
    ]
    if inside:
        around = inside[0]
        for more in inside[1:]:
            around = around.unionByName(more)
        around = around.groupBy("lang", *h).agg(F.max("n").alias("around"))
        rows = rows.join(around, ["lang", *h], "left").where(F.coalesce(100 * F.col("around"), F.lit(0)) < COVER * F.col("a")).drop("around")
    for k in range(1, size):
        for part, keys in ((f"l{k}", h[:k]), (f"r{k}", h[k:])):
            level = levels[len(keys) - 1]
            level = level.select("lang", *[F.col(f"h{j}").alias(c) for j, c in enumerate(keys, 1)], F.col("n").alias(part), *([F.col("word").alias(f"w_{keys[0]}")] if len(keys) == 1 else []))
            rows = rows.join(level, ["lang", *keys])
    for c in h:
        if f"w_{c}" not in rows.columns:
            rows = rows.join(levels[0].select("lang", F.col("h1").alias(c), F.col("word").alias(f"w_{c}")), ["lang", c])
    cuts = [F.struct(_exact_score(F.col("a"), F.col(f"l{k}").cast("decimal(15,0)") * F.col(f"r{k}").cast("decimal(15,0)")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, size)]
    best = F.least(*cuts) if len(cuts) > 1 else cuts[0]
    phrase = F.concat(*[x for c in h for x in (F.lit(b" "), F.col(f"w_{c}"))][1:])
    return rows.select("lang", phrase.alias("phrase"), "a", best.alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
