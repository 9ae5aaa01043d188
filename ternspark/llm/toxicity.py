"""Operator 12: toxicity by a weighted lexicon, learned from labels and matched by an Aho-Corasick automaton."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

#: The bounded sample of labelled rows that the lexicon is learned from: rows and characters of each class, picked by
#: hashes of id and text, each text once.
SAMPLE_ROWS, SAMPLE_CHARS = 20_000, 40_000_000
#: Letters of the word beginnings that are tried beside whole words.
SHORTEST, LONGEST = 4, 12
#: What an entry takes: toxic rows, log odds, and twice the log likelihood ratio.
LEAST_ROWS, LEAST_ODDS, LEAST_RATIO = 5, 2.0, 30.0
#: Different neighbours that it takes for each toxic row, and so many in any case (copies of a text share theirs).
PLACES_A_ROW, PLACES_ENOUGH = 1.2, 50
#: Log odds from which on an entry is looked at, as exceptions may raise them; and the clean rows that make an exception
#: and the probability of so many by chance.
SUSPECT_ODDS, EXCEPTION_ROWS, EXCEPTION_CHANCE = 0.3, 3, 1e-4
#: Share of an entry's rows from which on a longer entry stands for it.
SAME = 0.95
#: Score from which on a text is predicted to be toxic.
TOXIC = 0.7

# Letters of other scripts that look like Latin ones, and signs that stand for letters.
_LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k",
    "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
}
_SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}
_INVISIBLE = "­​‌‍⁠﻿"

_LETTERS = str.maketrans(_LOOKALIKES | dict.fromkeys(_INVISIBLE))
_INSIDE = re.compile(r"(?<=[^\W\d_])[013457@$!|]+(?=[^\W\d_])|(?<!\S)[013457@$]+(?=[^\W\d_])|(?<=[^\W\d_])[013457]+(?![\w@$])")
_BETWEEN = re.compile(r"[\W_]+")


def folded(text: str) -> str:
    """The words of a text, a blank before and behind each: compatibility forms, lower case, look-alike letters and signs
    inside words (``1d10t``) as the letters they stand for, invisible characters left out."""
    text = (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()
    if not text.isascii():
        text = text.translate(_LETTERS)
    text = _INSIDE.sub(lambda m: "".join(_SIGNS[c] for c in m.group()), text)
    return f" {_BETWEEN.sub(' ', text).strip()} "


def entries_of(word: str) -> list[str]:
    """What may stand for a word in the lexicon: the word, a blank on both sides, and its beginnings, a blank before."""
    return [f" {word} "] + [f" {word[:k]}" for k in range(SHORTEST, min(len(word) - 1, LONGEST) + 1)]


@dataclass
class Lexicon:
    """Entries with their weights, exceptions (entry, phrase with its word), and the score's coefficients."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[tuple[str, str, int]] = field(default_factory=list)  # (entry, phrase, place of the word's blank in it)
    model: tuple[float, float, float] = (-4.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        values: dict[str, tuple[float, list[int]]] = {e: (w, []) for e, w in self.weights.items()}
        for _, phrase, at in self.exceptions:
            weight, places = values.get(phrase, (0.0, []))
            values[phrase] = weight, [*places, len(phrase) - 1 - at]
        for key, (weight, places) in values.items():
            found.add_word(key, (weight, len(key) - 1, tuple(places)))
        found.make_automaton()
        return found

    def measure(self, automaton: ahocorasick.Automaton, text: str) -> tuple[float, int]:
        """The weight of all matches outside exceptions, and the number of words."""
        words = folded(text)
        hits: dict[int, float] = {}
        spared: set[int] = set()
        if self.weights:
            for end, (weight, back, places) in automaton.iter(words):
                if weight:
                    hits[end - back] = max(weight, hits.get(end - back, 0.0))
                spared.update(end - p for p in places)
        return sum(w for at, w in hits.items() if at not in spared), words.count(" ") - 1 if words.strip() else 0

    def score(self, weight: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Probability from the weight as it is and as a density, per hundred words."""
        x = _features(weight, words)
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.model), -30, 30)))

    def predict(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """Add ``score`` (0 to 1) and ``predicted`` (1 from `TOXIC` on) to every row; columns of those names are replaced.

        A text that is null or has no word is scored as one without matches. Bytes that aren't UTF-8 are no letters.
        """
        columns = [c for c in docs.columns if c not in ("score", "predicted")]
        rows, body = docs.select(*columns, F.col(text).cast("binary").alias("__body")), len(columns)
        weights, exceptions, model = self.weights, self.exceptions, self.model  # bounded by the sample

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Lexicon(weights, exceptions, model)
            automaton = own.automaton()
            for batch in batches:
                found = [own.measure(automaton, t) for t in _decoded(batch.column(body))]
                score = own.score(np.array([f[0] for f in found]), np.array([f[1] for f in found]))
                yield pa.RecordBatch.from_arrays([*batch.columns[:body], pa.array(score), pa.array((score >= TOXIC).astype(np.int32))], names=[*columns, "score", "predicted"])

        schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
        return rows.mapInArrow(run, f"{schema}score double, predicted int")


def _decoded(column: pa.Array) -> list[str]:
    return [(x or b"").decode("utf-8", "replace") for x in column.to_pylist()]


def _features(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(weight)), np.log1p(weight), np.log1p(100 * weight / np.maximum(words, 1))], axis=1)


def _log_odds(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    return F.log((toxic + 0.5) / (n_toxic - toxic + 0.5)) - F.log((clean + 0.5) / (n_clean - clean + 0.5))


def _ratio(t: float, c: float, n_toxic: int, n_clean: int) -> float:
    """Twice the log likelihood ratio of t of the toxic and c of the clean rows against one share for both."""

    def part(k: float, n: int, p: float) -> float:
        return (k * math.log(k / n / p) if k else 0.0) + ((n - k) * math.log((n - k) / n / (1 - p)) if n > k else 0.0)

    share = (t + c) / (n_toxic + n_clean)
    return 2 * (part(t, n_toxic, share) + part(c, n_clean, share)) if 0 < share < 1 else 0.0


def _sample(labelled: DataFrame, text: str, label: str, rows: int, chars: int) -> DataFrame:
    """About ``rows`` different texts of each class, but not over ``chars`` characters."""
    known = labelled.where(F.col(label).isin(0, 1) & F.col(text).isNotNull()).select(F.col(text).cast("binary").alias("text"), F.col(label).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r for r in known.groupBy("toxic").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("chars")).collect()}  # two rows at most
    rates = {k: min(1.0, rows / r["n"], chars / max(1, r["chars"])) for k, r in sizes.items()}
    return written(known.where(_picked(F.xxhash64(F.lit(12), "text"), "toxic", rates)).dropDuplicates(["text", "toxic"]), "sample", "zstd")


def _picked(hashed: Column, label: str, rates: dict[int, float]) -> Column:
    """Whether a hash lies in the share of its class that is wanted."""
    return F.pmod(hashed, F.lit(1_000_000)) < F.when(F.col(label) == 1, rates.get(1, 0.0)).otherwise(rates.get(0, 0.0)) * 1_000_000


def labelled_texts(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, label) of about ``rows`` labelled documents of each class, picked by a hash of the id: only so many ids go to
    all executors, and no text is shuffled."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull()).select(F.col(id).alias("__id"), F.col(label).cast("int").alias(label))
    rates = {r[0]: min(1.0, rows / r["count"]) for r in known.groupBy(label).count().collect()}  # two rows at most
    wanted = known.where(_picked(F.xxhash64(F.lit(13), "__id"), label, rates))
    return docs.select(id, text).join(F.broadcast(wanted), F.col(id) == F.col("__id")).select(text, label)  # some 2 * ``rows`` ids


def fit(labelled: DataFrame, text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Lexicon:
    """The lexicon of rows labelled 1 against rows labelled 0 (others, and null texts, don't count).

    Whole words and word beginnings are entries if they occur in at least `LEAST_ROWS` different toxic texts, beside
    different words (`PLACES_A_ROW`, `PLACES_ENOUGH`, so that copies of one text don't make entries) and far more often than in clean ones
    (`LEAST_ODDS`, `LEAST_RATIO`); the weight is the log odds. Of entries that begin alike and occur in the same texts
    the longest counts. A phrase of such a word and the word beside it that `EXCEPTION_ROWS` clean texts hold, and no
    toxic one, is an exception, if that is unlikely by chance (`EXCEPTION_CHANCE`). Two coefficients for the weight of a text's matches, as it is and by length, and a
    constant are fitted on the sample. Without toxic or clean rows the lexicon is empty.
    """
    sample = _sample(labelled, text, label, sample_rows, sample_chars)
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = size.get(1, 0), size.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon()

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[tuple[str, int]] = Counter()

        def emitted() -> pa.RecordBatch:
            keys = list(held)
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([held[k] if k[1] else 0 for k in keys]), pa.array([0 if k[1] else held[k] for k in keys])], names=["entry", "t", "c"])
            held.clear()
            return out

        for batch in batches:
            for body, toxic in zip(_decoded(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                held.update((e, toxic) for e in {e for w in set(folded(body).split()) for e in entries_of(w)})
                if len(held) > 1 << 19:
                    yield emitted()
        if held:
            yield emitted()

    counted = sample.select("text", "toxic").mapInArrow(candidates, "entry string, t long, c long").groupBy("entry").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    odds = _log_odds(F.col("t"), F.col("c"), n_toxic, n_clean)
    suspects = {r["entry"]: (r["t"], r["c"]) for r in counted.where((F.col("t") >= LEAST_ROWS) & (odds >= SUSPECT_ODDS)).collect()}  # bounded by the sample
    suspects = {e: v for e, v in suspects.items() if _ratio(v[0], 0, n_toxic, n_clean) >= LEAST_RATIO}
    if not suspects:
        return Lexicon()
    known = frozenset(suspects)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, toxic in zip(_decoded(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                words = ["", *folded(body).split(), ""]
                own = [[e for e in entries_of(w) if e in known] if w else [] for w in words]
                rows = {(e, f" {words[k - 1]} {words[k]} ", len(words[k - 1]) + 1) for k, some in enumerate(own) for e in some if words[k - 1]}
                rows |= {(e, f" {words[k]} {words[k + 1]} ", 0) for k, some in enumerate(own) for e in some if words[k + 1]}
                listed = sorted(rows)
                n = len(listed)
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in listed], type=pa.string()), pa.array([r[1] for r in listed], type=pa.string()), pa.array([r[2] for r in listed], type=pa.int32()), pa.array([toxic] * n, type=pa.int64()), pa.array([1 - toxic] * n, type=pa.int64())], names=["entry", "phrase", "at", "t", "c"])

    phrases = written(sample.select("text", "toxic").mapInArrow(neighbours, "entry string, phrase string, at int, t long, c long").groupBy("entry", "phrase", "at").agg(F.sum("t").alias("t"), F.sum("c").alias("c")), "phrases")
    places = {r["entry"]: r["n"] for r in phrases.where("t > 0").groupBy("entry").agg(F.count("*").alias("n")).collect()}
    spared = [
        r for r in phrases.where((F.col("t") == 0) & (F.col("c") >= EXCEPTION_ROWS)).collect()  # bounded by the sample
        if r["c"] * -math.log(max(1e-300, suspects[r["entry"]][1] / sum(suspects[r["entry"]]))) >= -math.log(EXCEPTION_CHANCE)
    ]
    around: Counter[str] = Counter()
    for r in spared:
        around[r["entry"]] += r["c"]
    weights = {}
    for e, (t, c) in suspects.items():
        left = max(0, c - around[e])
        odds_left = math.log((t + 0.5) / (n_toxic - t + 0.5)) - math.log((left + 0.5) / (n_clean - left + 0.5))
        if odds_left >= LEAST_ODDS and _ratio(t, left, n_toxic, n_clean) >= LEAST_RATIO and places.get(e, 0) >= min(PLACES_A_ROW * t, PLACES_ENOUGH):
            weights[e] = odds_left
    kept = _closed(weights, {e: suspects[e][0] for e in weights})
    found = Lexicon({e: weights[e] for e in kept}, sorted({(r["entry"], r["phrase"], r["at"]) for r in spared if r["entry"] in kept}))
    return _fitted(found, sample)


def _closed(weights: dict[str, float], rows: dict[str, int]) -> list[str]:
    """Of entries that begin alike, those that say most: not one that a longer one stands for, nor what extends one kept."""
    every = sorted(weights)
    best: dict[str, int] = {}  # rows of the most frequent entry that extends a beginning
    for e in every:
        for k in range(2, len(e)):
            if e[:k] in weights:
                best[e[:k]] = max(best.get(e[:k], 0), rows[e])
    kept: set[str] = set()
    for e in sorted((e for e in every if best.get(e, 0) < SAME * rows[e]), key=lambda e: (-rows[e], e)):
        if not any(e[:k] in kept for k in range(2, len(e))):
            kept.add(e)
    return sorted(kept)


def _fitted(found: Lexicon, sample: DataFrame) -> Lexicon:
    """The score's coefficients by logistic regression on the sample, classes as frequent as they are."""
    weights, exceptions = found.weights, found.exceptions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(weights, exceptions)
        automaton = own.automaton()
        for batch in batches:
            made = [own.measure(automaton, t) for t in _decoded(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], type=pa.float64()), pa.array([m[1] for m in made], type=pa.int64()), batch.column(1)], names=["weight", "words", "toxic"])

    rows = sample.select("text", "toxic").mapInArrow(run, "weight double, words long, toxic int").toArrow()  # bounded by the sample
    weight, words, y = (rows.column(k).to_numpy() for k in range(3))
    order = np.lexsort((y, words, weight))
    x, y = _features(weight[order], words[order]), y[order].astype(float)
    b = np.zeros(3)
    hold = np.diag([1e-4, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold, x.T @ (y - p) - hold @ b)
        b += step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    b[1:] = np.maximum(b[1:], 0.0)  # more matches never lower a score
    found.model = float(b[0]), float(b[1]), float(b[2])
    return found


def is_held_out(id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3, is 1 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """``id``, ``held_out``, ``score`` and ``predicted`` of every document, by the labels of those that aren't held out.

    Labels, languages, sources and ids take no part in a score. Repeated labels of an id count each; ids that are null
    have none. Repeated rows score alike; other columns don't matter.
    """
    light = docs.select(id, text)
    train = labelled_texts(light.where(~is_held_out(id)), labels.where(~is_held_out(id)), id, text, label)
    return fit(train, text, label).predict(light, text).select(id, is_held_out(id).alias("held_out"), "score", "predicted")
