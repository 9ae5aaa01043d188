"""Operator 13: tokens of two tokenizers aligned by their bytes, and the pairs of tokens that overlap, as inverted bitmaps."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written

#: Where the vocabulary files lie, on every executor.
TOKENIZERS, FILE_A, FILE_B = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Documents of a block, each a bit of its bitmaps, and postings from which on a block is closed.
BLOCK_BITS, POSTINGS = 12, 1 << 21
#: Characters of the texts that are worked on at once (a longer text is cut), of the longest segments that a task keeps
#: the alignment of, and segments kept (some 400 bytes each).
CHUNK, KEPT_CHARS, KEPT = 1 << 18, 64, 1 << 18
#: Distinct pairs up to which their counts are sent to all executors (some 40 bytes each).
SENT = 1 << 21
#: Pieces that each of the pairs' counts is dealt to otherwise.
SALT = 16

_BITSET = (1 << BLOCK_BITS) // 8  # bytes of a bitmap; fewer than half as many documents are a list of two-byte numbers
_B_BITS = 16  # of a pair's code, for the second id
_CUT = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")
_PLAIN = re.compile(r"\A[^\s▁](?s:.*[^\s▁])?\Z")


class Tokenizers:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, folder: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(f"{folder}/{FILE_A}")
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{FILE_B}")
        spelled = _byte_letters()
        self.bytes_a = [_spelled(self.a.id_to_token(i) or "", spelled) for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        self.bytes_b = [_piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.len_a = np.array([len(x) for x in self.bytes_a], dtype=np.int64)
        self.len_b = np.array([len(x) for x in self.bytes_b], dtype=np.int64)
        # an id with what follows it: in A `,` or `|`, in B `,` or `;` or nothing
        self.written = [f"{i}{s}".encode() for s in ",|" for i in range(len(self.len_a))] + [f"{i}{s}".encode() for s in (",", ";", "") for i in range(len(self.len_b))]

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """A's ids of a blank and the text, B's of the text."""
        return self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.b.encode(text)

    def covers(self, a: list[int], b: list[int], body: bytes) -> bool:
        """Whether the tokens of both sides are these bytes."""
        return b"".join(map(self.bytes_a.__getitem__, a)) == body and b"".join(map(self.bytes_b.__getitem__, b)) == body


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones stand for themselves, the others
    follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _spelled(token: str, letters: dict[str, int]) -> bytes:
    return bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()


def _piece_bytes(piece: str) -> bytes:
    if re.fullmatch(r"<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


def chunks(text: str) -> Iterator[str]:
    """A text in parts of some `CHUNK` characters, cut where `segments` may cut it."""
    at = 0
    while len(text) - at > CHUNK:
        cut = _CUT.search(text, at + CHUNK)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


def segments(text: str) -> list[str]:
    """A text cut at its lone blanks, these left out.

    A blank between two characters that aren't white space begins a token on both sides: A splits texts there before it
    merges bytes, and no piece of B holds a blank behind another character. So segments align on their own.
    """
    return _CUT.split(text)


#: Of a segment: tokens of A and of B, groups, the groups as text, and the codes of its links as bytes.
Alignment = tuple[int, int, int, bytes, bytes]


def aligned(t: Tokenizers, texts: list[str]) -> list[Alignment | None]:
    """The alignment of each segment; None where the tokens of one side aren't its bytes.

    They are encoded as one text. If that isn't covered, each is on its own.
    """
    bodies = [b" " + x.encode("utf-8", "replace") for x in texts]
    a, b = t.encode(" ".join(texts))
    if not t.covers(a, b, b"".join(bodies)):
        if len(texts) == 1:
            return [None]
        half = len(texts) // 2
        return aligned(t, texts[:half]) + aligned(t, texts[half:])
    ids_a, ids_b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
    end_a, end_b = np.cumsum(t.len_a[ids_a]), np.cumsum(t.len_b[ids_b])
    text_end = np.cumsum([len(x) for x in bodies])
    n_a, n_b = (np.diff(np.searchsorted(e, text_end) + 1, prepend=0) for e in (end_a, end_b))
    ends = np.union1d(end_a, end_b)  # each stretch between two neighbours is one link
    of_a, of_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
    both = (end_a[of_a] == ends) & (end_b[of_b] == ends)
    code = (ids_a[of_a] << _B_BITS | ids_b[of_b]).tobytes()
    link_to = (8 * (np.searchsorted(ends, text_end) + 1)).tolist()
    n_groups = np.diff(np.searchsorted(ends[both], text_end) + 1, prepend=0)
    # groups as text: A's ids, then B's; a token's place is its rank and what of the other side comes before it
    group_a, group_b = np.searchsorted(ends[both], end_a), np.searchsorted(ends[both], end_b)
    order = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
    order[np.arange(len(ids_a)) + np.searchsorted(group_b, group_a, "left")] = ids_a + len(t.len_a) * np.append(group_a[1:] != group_a[:-1], True)
    mark = np.append(group_b[1:] != group_b[:-1], True).astype(np.int64)
    mark[np.cumsum(n_b) - 1] = 2
    order[np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, "right")] = 2 * len(t.len_a) + ids_b + len(t.len_b) * mark
    parts = list(map(t.written.__getitem__, order.tolist()))
    bounds = [0, *np.cumsum(n_a + n_b).tolist()]
    said = [b"".join(parts[x:y]) for x, y in zip(bounds, bounds[1:])]
    return list(zip(n_a.tolist(), n_b.tolist(), n_groups.tolist(), said, [code[x:y] for x, y in zip([0, *link_to], link_to)]))


class Known(dict):
    """Alignments of segments, those of short ones kept for later texts."""

    def __init__(self, t: Tokenizers) -> None:
        super().__init__()
        self.t = t

    def of(self, texts: list[list[str]]) -> list[list[Alignment | None]]:
        """The alignments of all segments of some texts."""
        if len(self) > KEPT:
            self.clear()
        fresh = list(set().union(*texts).difference(self))
        # white space at a segment's end (so at its text's) would join the blank of the next one
        plain = [x for x in fresh if _PLAIN.search(x)]
        if plain:
            self.update(zip(plain, aligned(self.t, plain)))
        for x in fresh:
            if x not in self:
                self[x] = aligned(self.t, [x])[0]
        out = [list(map(self.__getitem__, text)) for text in texts]
        for x in fresh:
            if len(x) > KEPT_CHARS:
                del self[x]
        return out


def bitmaps(code: np.ndarray, doc: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """Distinct codes, and for each the bitmaps of documents in whose number of links bit 0, 1, ... is set.

    A (code, document) may occur repeatedly, the numbers then add up. A bitmap of few documents is a list of two-byte
    numbers (less than `_BITSET` bytes), of many `_BITSET` bytes.
    """
    key, where = np.unique(code.astype(np.int64) << BLOCK_BITS | doc, return_inverse=True)
    n = np.zeros(len(key), dtype=np.int64)
    np.add.at(n, where, times)
    codes, row = np.unique(key >> BLOCK_BITS, return_inverse=True)
    place = key & (1 << BLOCK_BITS) - 1
    depth = int(n.max(initial=1)).bit_length()
    planes = np.zeros(len(codes), dtype=np.int64)
    np.maximum.at(planes, row, np.ceil(np.log2(n + 1)).astype(np.int64))
    start = np.concatenate([[0], np.cumsum(planes)])
    cells, docs = [], []
    for p in range(depth):
        there = (n >> p & 1).astype(bool)
        cells.append(start[row[there]] + p)
        docs.append(place[there])
    cell, pos = np.concatenate(cells), np.concatenate(docs)
    order = np.argsort(cell << BLOCK_BITS | pos)
    cell, pos = cell[order], pos[order]
    held = np.bincount(cell, minlength=start[-1])
    size = np.where(2 * held < _BITSET, 2 * held, _BITSET)
    offset = np.concatenate([[0], np.cumsum(size)])
    data = np.zeros(offset[-1], dtype=np.uint8)
    few = size[cell] < _BITSET
    at = offset[cell] + 2 * (np.arange(len(cell)) - np.concatenate([[0], np.cumsum(held)])[cell])
    data[at[few]] = pos[few] & 255
    data[at[few] + 1] = pos[few] >> 8
    np.bitwise_or.at(data, offset[cell[~few]] + (pos[~few] >> 3), (1 << (pos[~few] & 7)).astype(np.uint8))
    bits = pa.Array.from_buffers(pa.binary(), int(start[-1]), [None, pa.py_buffer(offset.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
    return codes, pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), bits)


def _cells(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all bitmaps of a column: their row, their plane, their size in bytes; and the bytes."""
    counts = np.diff(column.offsets.to_numpy())
    row = np.repeat(np.arange(len(column)), counts)
    plane = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    bits = column.flatten().cast(pa.large_binary())
    offset = np.frombuffer(bits.buffers()[1], dtype=np.int64)[bits.offset : bits.offset + len(bits) + 1] if len(bits) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(bits.buffers()[2], dtype=np.uint8)[offset[0] : offset[-1]] if len(bits) and offset[-1] > offset[0] else np.zeros(0, dtype=np.uint8)
    return row, plane, np.diff(offset), data


def postings(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All set bits of a column of bitmaps: row, plane and document."""
    row, plane, size, data = _cells(column)
    dense = np.repeat(size == _BITSET, size)
    full, bit = np.nonzero(np.unpackbits(data[dense].reshape(-1, _BITSET), axis=1, bitorder="little"))
    few = np.flatnonzero(size < _BITSET)
    cell = np.concatenate([np.repeat(few, size[few] // 2), np.flatnonzero(size == _BITSET)[full]])
    return row[cell], plane[cell], np.concatenate([data[~dense].view("<u2").astype(np.int64), bit])


def populations(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Documents and links of each row: bits of the planes merged by OR, and bits of each plane times its weight."""
    row, plane, size, data = _cells(column)
    count = size // 2
    dense = size == _BITSET
    count[dense] = np.bitwise_count(data[np.repeat(dense, size)].reshape(-1, _BITSET)).sum(axis=1, dtype=np.int64)
    links = np.zeros(len(column), dtype=np.int64)
    np.add.at(links, row, count << plane)
    docs = np.zeros(len(column), dtype=np.int64)
    np.add.at(docs, row, count)
    several = np.flatnonzero(np.bincount(row, minlength=len(column)) > 1)
    for at in range(0, len(several), 2048):
        part = several[at : at + 2048]
        own, _, doc = postings(column.take(pa.array(part)))
        merged = np.zeros((len(part), 1 << BLOCK_BITS), dtype=bool)
        merged[own, doc] = True  # the planes' OR
        docs[part] = merged.sum(axis=1)
    return docs, links


class _Block:
    """Documents that share bitmaps, until they are emitted."""

    def __init__(self, number: int) -> None:
        self.number, self.ids, self.rows, self.hashes, self.fine = number, [], [], [], []
        self.code: list[np.ndarray] = []
        self.doc: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.size = 0

    def open(self, id: object) -> int:
        self.ids.append(id)
        self.rows.append([0, 0, 0, 0])
        self.hashes.append(None)
        self.fine.append(True)
        return len(self.ids) - 1

    def add(self, known: Known, parts: list[tuple[int, str]]) -> None:
        """Texts (document, text) of this block, in order."""
        codes, docs = [], []
        for (doc, _), found in zip(parts, known.of([segments(text) for _, text in parts]), strict=True):
            if None in found:
                self.fine[doc] = False
            if not self.fine[doc]:
                continue
            *numbers, groups, links = zip(*found, strict=True)
            said, code = b";".join(groups), b"".join(links)
            for j, n in enumerate(numbers):
                self.rows[doc][j] += sum(n)
            self.rows[doc][3] += len(code) // 8
            if self.hashes[doc] is None:
                self.hashes[doc] = hashlib.sha256(said)
            else:
                self.hashes[doc].update(b";" + said)
            codes.append(code)
            docs.append((doc, len(code) // 8))
        if not codes:
            return
        doc_of = np.repeat([d for d, _ in docs], [n for _, n in docs])
        key, n = np.unique(doc_of << 2 * _B_BITS | np.frombuffer(b"".join(codes), dtype=np.int64), return_counts=True)
        self.code.append(key & (1 << 2 * _B_BITS) - 1)
        self.doc.append(key >> 2 * _B_BITS)
        self.times.append(n)
        self.size += len(n)

    def emitted(self, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        fine = np.array(self.fine, dtype=bool)
        rows = np.array(self.rows, dtype=np.int64).reshape(-1, 4) * fine[:, None]
        digest = [h.hexdigest() if h is not None and f else "" for h, f in zip(self.hashes, self.fine, strict=True)]
        n = len(rows)
        yield _rows(self.number, n, id=pa.array(self.ids, type=id_type), place=pa.array(np.arange(n, dtype=np.int32)), **{c: pa.array(rows[:, k]) for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}, groups_sha256=pa.array(digest), id_type=id_type)
        if self.code:
            code, doc, times = np.concatenate(self.code), np.concatenate(self.doc), np.concatenate(self.times)
            keep = fine[doc]
            codes, bits = bitmaps(code[keep], doc[keep], times[keep])
            for at in range(0, len(codes), 1 << 14):
                part = bits.slice(at, 1 << 14)
                yield _rows(self.number, len(part), code=pa.array(codes[at : at + (1 << 14)]), bits=part, id_type=id_type)


def _schema(id_type: pa.DataType) -> list[tuple[str, pa.DataType]]:
    return [("block", pa.int64()), ("id", id_type), ("place", pa.int32()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
            ("groups_sha256", pa.string()), ("code", pa.int64()), ("bits", pa.list_(pa.binary()))]


def _rows(block: int, n: int, id_type: pa.DataType, **columns: pa.Array) -> pa.RecordBatch:
    given = columns | {"block": pa.array(np.full(n, block))}
    return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(n, t) for c, t in _schema(id_type)], names=[c for c, _ in _schema(id_type)])


def encoded(docs: DataFrame, id: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """One table of two kinds of rows: documents (``code`` is null) and, for each pair of ids in a block of documents, the
    bitmaps of these."""
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(Tokenizers(folder))
        block = _Block(TaskContext.get().partitionId() << 32)
        waiting: list[tuple[int, str]] = []
        size = 0
        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field(0).type
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc = block.open(name)
                text = body.decode("utf-8", "replace") if body else ""
                block.fine[doc] = text.encode("utf-8", "replace") == (body or b"")
                for part in chunks(text) if text and block.fine[doc] else ():
                    waiting.append((doc, part))
                    size += len(part)
                    if size > CHUNK:
                        block.add(known, waiting)
                        waiting, size = [], 0
                if len(block.ids) == 1 << BLOCK_BITS or block.size > POSTINGS:
                    if waiting:
                        block.add(known, waiting)
                        waiting, size = [], 0
                    yield from block.emitted(id_type)
                    block = _Block(block.number + 1)
        if waiting:
            block.add(known, waiting)
        if block.ids:
            yield from block.emitted(id_type)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"block long, id {kind}, place int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, code long, bits array<binary>")


def pair_counts(index: DataFrame) -> DataFrame:
    """Documents ``n_docs`` and links ``n`` of every pair of ids, and whether ``n`` is the highest of its B id (``best``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def summed() -> pa.RecordBatch:
            code, where = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            out = []
            for k in (1, 2):
                n = np.zeros(len(code), dtype=np.int64)
                np.add.at(n, where, np.concatenate([h[k] for h in held]))
                out.append(pa.array(n))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(code), *out], names=["code", "n_docs", "n"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), *populations(batch.column(1))))
            if sum(len(h[0]) for h in held) > 1 << 20:
                yield summed()
        if held:
            yield summed()

    partial = index.where("code is not null").select("code", "bits").mapInArrow(run, "code long, n_docs long, n long")
    pairs = written(partial.groupBy("code").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n")), "pairs")
    b = F.col("code").bitwiseAND((1 << _B_BITS) - 1)
    most = pairs.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return pairs.withColumn("b", b).join(F.broadcast(most), "b").select(  # a row for each id of B's vocabulary
        "code", F.shiftright("code", _B_BITS).alias("a"), "b", "n_docs", "n", (F.col("n") == F.col("most")).alias("best")
    )


def _scores(index: DataFrame, pairs: DataFrame, sent: int) -> DataFrame:
    """Of each document (``block``, ``place``) the sum of its links' counts and the links of pairs that are best."""
    light = pairs.select("code", "n", "best")
    rows = index.where("code is not null").select("code", "block", "bits")
    if light.limit(sent + 1).count() <= sent:
        rows = rows.join(F.broadcast(light), "code")
    else:
        light = light.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(SALT)).cast("int")).join(light, ["code", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, plane, doc = postings(batch.column(1))
            block, n, best = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3))
            blocks, number = np.unique(block, return_inverse=True)
            place = number[row] << BLOCK_BITS | doc
            total, hits = np.zeros(len(blocks) << BLOCK_BITS, dtype=np.int64), np.zeros(len(blocks) << BLOCK_BITS, dtype=np.int64)
            np.add.at(total, place, n[row] << plane)
            np.add.at(hits, place, best[row].astype(np.int64) << plane)
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(blocks[seen >> BLOCK_BITS]), pa.array((seen & (1 << BLOCK_BITS) - 1).astype(np.int32)), pa.array(total[seen]), pa.array(hits[seen])], names=["block", "place", "count_sum", "n_best"])

    made = rows.select("block", "bits", "n", "best").mapInArrow(run, "block long, place int, count_sum long, n_best long")
    return made.groupBy("block", "place").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))


def align(docs: DataFrame, id: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, sent: int = SENT) -> DataFrame:
    """How the tokens of a byte-level tokenizer (A) and of a piece tokenizer (B) cover each text.

    A blank and the text are encoded by A, the text by B, which puts the blank before it; strings of special tokens are
    plain text. Returns for each document ``id``, ``n_a``, ``n_b``, ``n_groups`` (stretches between bytes where tokens of
    both end), ``n_links`` (pairs of an A and a B token that share bytes), ``n_best`` (links of pairs of ids that no other
    A id outnumbers for their B id in the corpus), ``count_sum`` (links in the corpus of each link's pair of ids) and
    ``groups_sha256``. Texts that are null, empty or not covered exactly by both (such as bytes that aren't UTF-8) have
    no tokens: zeros and an empty digest.

    Each text is encoded once. Links become an inverted index: for each pair of ids and block of documents, bitmaps of
    the documents whose number of links has bit 0, 1, ... set. Their bits add up to the pair's counts; then each bitmap
    hands its pair's count back to its documents. Pairs occur at most once in a block, so no pair makes a hot group.
    The counts are sent to all executors for up to ``sent`` pairs, otherwise joined by a shuffle. Repeated rows and ids
    count each; other columns don't matter. Texts are aligned segment by segment (see `segments`), and a task aligns a
    short segment once; a long text is worked on in parts, but a stretch without lone blanks whole.
    """
    index = written(encoded(docs, id, text, folder), "pair-index", "zstd")
    scores = _scores(index, written(pair_counts(index), "pair-counts"), sent)
    rows = index.where("code is null").select("block", "place", F.col("id").alias(id), "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return rows.join(scores, ["block", "place"], "left").select(
        id, "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"), F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256"
    )
