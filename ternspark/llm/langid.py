"""Operator 5: language identification with interpolated Kneser-Ney character models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

#: Characters in an n-gram.
ORDER = 5
#: The bounded sample of labelled documents that the models are fitted on: documents and characters per language (a
#: hash of the id picks documents, which count whole) and, of those, the share kept apart for calibration.
SAMPLE_DOCS, SAMPLE_CHARS, CALIBRATION = 1_000, 2_000_000, 0.25
#: Share of the documents of the known languages that calibration lets be rejected, and nats per symbol over its
#: language's mean up to which no text is (a long text that repeats itself lies off the mean, but not that far).
REJECTED, SLACK = 0.002, 0.25
#: Characters scored at once (a longer text is scored alone).
CHUNK = 1 << 19

UNKNOWN = "und"
GAP = 0  # the symbol of what isn't a letter; letters are their lower-cased code points

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _symbol(point: int) -> int:
    """The symbol of a code point."""
    c = chr(point)
    low = c.lower()
    return (ord(low) if len(low) == 1 else point) if c.isalpha() else GAP


def symbols_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, runs of gaps as one and a gap after each text that has letters; and each text's bounds."""
    points = np.frombuffer("".join([t + "\n" for t in texts]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    there = np.zeros(int(points.max(initial=0)) + 1, dtype=bool)
    there[points] = True
    table = np.zeros(len(there), dtype=np.uint32)
    for point in np.flatnonzero(there).tolist():
        table[point] = _symbol(point)
    raw = table[points]
    keep = raw != GAP
    keep[1:] |= raw[:-1] != GAP
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    kept = np.concatenate([[0], np.cumsum(keep)])
    return raw[keep], np.concatenate([[0], kept[ends]]) if texts else np.zeros(1, dtype=np.int64)


def padded(symbols: np.ndarray, bounds: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols with ``order`` gaps before each text, and the place of each symbol."""
    own = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    place = np.arange(len(symbols)) + order * (own + 1)
    out = np.zeros(len(symbols) + order * (len(bounds) - 1), dtype=np.uint32)
    out[place] = symbols
    return out, place


def gram_hashes(symbols: np.ndarray, order: int) -> list[np.ndarray]:
    """For k of 0..order, the 64-bit hash of the k symbols that end at each place (of k - 1 before it: its context)."""
    value = _mixed((symbols.astype(np.uint64) + np.uint64(1)) * _ODD)
    out = [np.zeros(len(symbols), dtype=np.uint64)]
    for _ in range(order):
        longer = value.copy()
        longer[1:] += out[-1][:-1] * _ODD
        out.append(_mixed(longer))
    return out


@dataclass
class Model:
    """Sorted n-gram hashes and log probabilities of one language, one pair of arrays for each order.

    ``keys[k]`` holds the hashes of the (k + 1)-grams seen, ``logp[k]`` their interpolated log probabilities; ``back[k]``
    the log weight with which a context hands over what it hasn't seen to the shorter one; ``base`` is the log
    probability of any symbol. ``mean`` is the cross-entropy of the documents kept apart.
    """

    keys: list[np.ndarray] = field(default_factory=list)
    logp: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    back: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    mean: float = float("inf")

    def score(self, grams: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        """Log probabilities of symbols; grams[k] and contexts[k] are the hashes of the k + 1 and the k symbols that count."""
        out = np.zeros(len(grams[0]))
        left = np.arange(len(out))
        for k in range(len(self.keys) - 1, -1, -1):
            value, seen = _lookup(self.keys[k], self.logp[k], grams[k][left])
            out[left[seen]] += value[seen]
            left = left[~seen]
            out[left] += _lookup(self.contexts[k], self.back[k], contexts[k][left])[0]
        out[left] += self.base
        return out


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the sorted keys wanted (0 where there is none), and which of them there are."""
    if not len(keys) or not len(wanted):
        return np.zeros(len(wanted)), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    seen = keys[at] == wanted
    return np.where(seen, values[at], 0.0), seen


def kneser_ney(grams: np.ndarray, counts: np.ndarray, size: int) -> Model:
    """Interpolated Kneser-Ney from the distinct n-grams of the highest order (rows of symbols) and their counts.

    Lower orders count the distinct symbols that precede a gram; each order discounts by n1 / (n1 + 2 n2). ``size`` is
    the number of symbols that the base distribution knows.
    """
    order = grams.shape[1]
    table = []  # (hash of the last k symbols, of those before the last one, of the last k - 1, count) for k of order..1
    count = counts.astype(np.float64)
    for k in range(order, 0, -1):
        h = _row_hashes(grams[:, order - k :])
        key, first, where = np.unique(h, return_index=True, return_inverse=True)
        count = np.bincount(where, weights=count if k == order else np.ones(len(h)), minlength=len(key))
        grams = grams[first]
        table.append((key, _row_hashes(grams[:, order - k : -1]), _row_hashes(grams[:, order - k + 1 :]), count))
    model = Model(base=-np.log(size))
    below: tuple[np.ndarray, np.ndarray] | None = None
    for key, context, shorter, n in reversed(table):
        n1, n2 = float((n == 1).sum()), float((n == 2).sum())
        discount = min(max(n1 / (n1 + 2 * n2), 0.1), 0.9) if n1 + n2 else 0.5
        contexts, where, kinds = np.unique(context, return_inverse=True, return_counts=True)
        total = np.bincount(where, weights=n, minlength=len(contexts))
        weight = discount * kinds / total
        lower = np.full(len(key), 1.0 / size) if below is None else below[1][np.searchsorted(below[0], shorter)]
        p = (n - discount) / total[where] + weight[where] * lower
        below = key, p
        model.keys.append(key)
        model.logp.append(np.log(p))
        model.contexts.append(contexts)
        model.back.append(np.log(weight))
    return model


def _row_hashes(rows: np.ndarray) -> np.ndarray:
    """The hash that `gram_hashes` gives the symbols of each row."""
    h = np.zeros(len(rows), dtype=np.uint64)
    for k in range(rows.shape[1]):
        h = _mixed(_mixed((rows[:, k].astype(np.uint64) + np.uint64(1)) * _ODD) + h * _ODD)
    return h


@dataclass
class Identifier:
    """Fitted models by language, in alphabetical order, and how far over its mean a text may lie: ``limit`` standard
    deviations, of variance ``within`` / symbols + ``between``."""

    models: dict[str, Model]
    order: int = ORDER
    within: float = 1.0
    between: float = 0.0
    limit: float = float("inf")

    def predict(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """Add ``lang_pred``, ``score`` (0 to 1), ``cross_entropy`` and ``rejected`` to every row.

        ``lang_pred`` is the language of lowest cross-entropy per symbol (the alphabetically first of equals),
        ``und`` for texts that are null or have no letter, which are rejected with score 0. ``score`` is the
        language's share of the likelihood of ten symbols of average surprise. A text that has letters is
        rejected if its cross-entropy lies farther over the mean of its language than all but a share of `REJECTED`
        of the calibration documents do (and by over `SLACK`); it keeps its prediction. Bytes that aren't UTF-8 are no letters. Columns
        of those names are replaced.
        """
        columns = [c for c in docs.columns if c not in ("lang_pred", "score", "cross_entropy", "rejected")]
        rows, body = docs.select(*columns, F.col(text).cast("binary").alias("__body")), len(columns)
        shared = docs.sparkSession.sparkContext.broadcast(_plain(self))  # bounded by the sample

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = _from_plain(shared.value)
            for batch in batches:
                for start in range(0, batch.num_rows, 512):
                    part = batch.slice(start, 512)
                    made = found.score(_decoded(part.column(body)))
                    yield pa.RecordBatch.from_arrays([*part.columns[:body], *made], names=[*columns, "lang_pred", "score", "cross_entropy", "rejected"])
            _let_go(shared)

        schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
        return rows.mapInArrow(run, f"{schema}lang_pred string, score double, cross_entropy double, rejected boolean")

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per symbol (text x language) and symbols of each text; 0 symbols if it has no letter."""
        parts, at = [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) < CHUNK):
                size += len(texts[end])
                end += 1
            parts.append(self._entropies(texts[at:end]))
            at = end
        if not parts:
            return np.zeros((0, len(self.models))), np.zeros(0, dtype=np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        symbols, bounds = symbols_of(texts)
        every, place = padded(symbols, bounds, self.order)
        hashes = gram_hashes(every, self.order)
        _, first, kind = np.unique(hashes[-1][place], return_index=True, return_inverse=True)
        at = place[first]
        grams, contexts = [h[at] for h in hashes[1:]], [h[at - 1] for h in hashes[:-1]]
        n = np.diff(bounds)
        out = np.zeros((len(texts), len(self.models)))
        full = n > 0
        if full.any():
            for k, model in enumerate(self.models.values()):
                out[full, k] = -np.add.reduceat(model.score(grams, contexts)[kind], bounds[:-1][full]) / n[full]
        return out, n

    def score(self, texts: list[str]) -> list[pa.Array]:
        entropy, n = self.entropies(texts)
        names = list(self.models)
        if not names:
            return [pa.array([UNKNOWN] * len(texts)), pa.array([0.0] * len(texts)), pa.array([None] * len(texts), type=pa.float64()), pa.array([True] * len(texts))]
        best = entropy.argmin(axis=1)
        lowest = entropy[np.arange(len(best)), best]
        share = 1.0 / np.exp(-10.0 * (entropy - lowest[:, None])).sum(axis=1)
        mean = np.array([m.mean for m in self.models.values()])[best]
        over = lowest - mean
        rejected = (n == 0) | (over > SLACK) & (self.distance(over, n) > self.limit)
        picked = np.array(names, dtype=object)[best]
        picked[n == 0] = UNKNOWN
        return [pa.array(picked.tolist(), type=pa.string()), pa.array(np.where(n == 0, 0.0, share)), pa.array(lowest, mask=n == 0), pa.array(rejected)]

    def distance(self, over: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Standard deviations by which texts of n symbols lie over their language's mean."""
        return over / np.sqrt(self.within / np.maximum(n, 1) + self.between)


def _plain(found: Identifier) -> tuple:
    """The parts of fitted models without their classes: a broadcast names classes, which executors may not have."""
    models = {name: (m.keys, m.logp, m.contexts, m.back, m.base, m.mean) for name, m in found.models.items()}
    return models, found.order, found.within, found.between, found.limit


def _from_plain(parts: tuple) -> Identifier:
    return Identifier({name: Model(*m) for name, m in parts[0].items()}, *parts[1:])


def _let_go(shared: object) -> None:
    """Free a broadcast's value in a worker, which would hold it while it waits for other tasks; the next one reads it again."""
    vars(shared).pop("_value", None)


def _decoded(column: pa.Array) -> list[str]:
    return [(x or b"").decode("utf-8", "replace") for x in column.to_pylist()]


def fit(labelled: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", order: int = ORDER,
        sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, rejected: float = REJECTED) -> Identifier:
    """Models of every language of ``labelled`` (rows with a null language or text don't count).

    About ``sample_docs`` documents per language, but not over ``sample_chars`` characters, picked by a hash of the id,
    are the bounded sample; n-grams are counted by Spark, and the driver takes those of the sample: at most
    ``sample_chars`` for each language.
    """
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = known.groupBy(lang).agg(F.count("*").alias("n"), F.sum(F.char_length(text)).alias("chars")).collect()  # a row per language
    rates = {r[lang]: min(1.0, sample_docs / r["n"], sample_chars / max(1, r["chars"])) for r in sizes}
    place = F.pmod(F.xxhash64(F.lit(7), F.col(id)), F.lit(1_000_000))
    rate = F.create_map(*[F.lit(x) for kv in rates.items() for x in kv])[F.col(lang)] if rates else F.lit(0.0)
    apart = F.pmod(F.xxhash64(F.lit(8), F.col(id)), F.lit(1000)) < int(1000 * CALIBRATION)
    sample = written(known.where(place < rate * 1_000_000).select(F.col(lang).alias("lang"), F.col(text).cast("binary").alias("text"), apart.alias("apart")), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), _decoded(batch.column(1)), strict=True):
                every, place = padded(*symbols_of([body]), order)
                _, first, n = np.unique(gram_hashes(every, order)[-1][place], return_index=True, return_counts=True)
                rows = np.lib.stride_tricks.sliding_window_view(every, order)[place[first] - order + 1] if len(place) else np.zeros((0, order), dtype=np.uint32)
                grams = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * order), len(rows), [None, pa.py_buffer(rows.astype("<u4").tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), type=pa.string()), grams.cast(pa.binary()), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    counted = sample.where("not apart").select("lang", "text").mapInArrow(count, "lang string, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = counted.column("lang").to_pandas().to_numpy()
    grams = np.frombuffer(b"".join(counted.column("gram").to_pylist()), dtype="<u4").reshape(-1, order)
    n = counted.column("n").to_numpy()
    size = len(np.unique(grams)) + 1 if len(grams) else 1  # the symbols of the sample and one for all others
    found = Identifier({name: kneser_ney(grams[names == name], n[names == name], size) for name in sorted(set(names))}, order)
    return _calibrated(found, sample, rejected)


def _calibrated(found: Identifier, sample: DataFrame, rejected: float) -> Identifier:
    """Means, variance and limit from the documents kept apart; all but a share ``rejected`` of them lie inside."""
    shared = sample.sparkSession.sparkContext.broadcast(_plain(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = _from_plain(shared.value)
        for batch in batches:
            names = list(fitted.models)
            entropy, n = fitted.entropies(_decoded(batch.column(1)))
            own = [names.index(x) if x in names else -1 for x in batch.column(0).to_pylist()]
            mine = np.array([entropy[k, j] if j >= 0 else 0.0 for k, j in enumerate(own)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(mine), pa.array(n.astype(np.int64))], names=["lang", "h", "n"])
        _let_go(shared)

    rows = sample.where("apart").select("lang", "text").mapInArrow(run, "lang string, h double, n long").where("n > 0").toArrow()  # bounded by the sample
    names, h, n = np.array(rows.column("lang").to_pylist(), dtype=object), rows.column("h").to_numpy(), rows.column("n").to_numpy().astype(float)
    over = np.zeros(len(h))
    for name, model in found.models.items():
        own = names == name
        if own.any():
            model.mean = float(np.average(h[own], weights=n[own]))  # a language without such documents rejects nothing
            over[own] = h[own] - model.mean
    use = np.isin(names, list(found.models))
    over, n = over[use], n[use]
    if len(over):
        # squared distances from the mean fall with length towards what documents differ by
        found.within, found.between = (float(x) for x in _not_negative(np.stack([1 / n, np.ones(len(n))], axis=1), over**2))
        found.limit = float(np.quantile(found.distance(over, n), 1 - rejected, method="higher"))
    return found


def _not_negative(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least squares with two coefficients of at least (nearly) 0, rows weighted against their own size."""
    w = 1 / np.maximum(x[:, 0], 1e-9)[:, None] ** 0.5
    fits = [np.linalg.lstsq(x * w, y * w[:, 0], rcond=None)[0]]
    for keep in (0, 1):
        one = np.zeros(2)
        one[keep] = np.linalg.lstsq((x * w)[:, [keep]], y * w[:, 0], rcond=None)[0][0]
        fits.append(one)
    good = [f for f in fits if (f >= 0).all()] or [np.abs(fits[0])]
    best = min(good, key=lambda f: float((((x * w) @ f - y * w[:, 0]) ** 2).sum()))
    return np.maximum(best, [1e-6, 1e-6])


def is_held_out(id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4, is 2 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with ``held_out`` and the predictions of models fitted on the rows that aren't held out."""
    train = docs.select(id, text, lang).where(~is_held_out(id))
    return fit(train, id, text, lang).predict(docs, text).withColumn("held_out", is_held_out(id))
