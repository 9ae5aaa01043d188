"""Operator 2: canonical exact digests of documents."""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

#: Rows in a range of ids in which neighbours are found, and the fewest and most ranges.
RANGE_ROWS, FEWEST, MOST = 4_000, 64, 1 << 16
#: Bytes of text that a partition of ranges may hold.
PARTITION_BYTES = 64 << 20
#: Rows of a key table that may be broadcast (16 to 60 bytes each); larger ones are joined by a shuffle.
BROADCAST_KEYS = 200_000


def canonical(text: str) -> Column:
    """Compatibility-composed Unicode (NFKC), full case folding, NFKC again, runs of white space as one space,
    none at the ends. Null counts as empty."""
    def icu(cls: str, method: str, x: Column) -> Column:
        return F.reflect(F.lit(f"com.ibm.icu.{cls}"), F.lit(method), x, F.lit(True))

    composed = icu("text.Normalizer", "compose", F.coalesce(F.col(text), F.lit("")))
    folded = icu("text.Normalizer", "compose", icu("lang.UCharacter", "foldCase", composed))
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


#: Hex digits of the digest: 128 bits.
DIGITS = 32


def wide_digest(x: Column, digits: int = DIGITS) -> Column:
    """128 bits as hex: two xxHash64 with different beginnings. ``digits`` shortens it (to test clashes)."""
    return F.lower(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), x)), 16, "0") for seed in (1, 2)])).substr(1, digits)


def _small(keys: DataFrame) -> DataFrame:
    """A written table of keys, broadcast where it is of a checked size."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _shared(digests: DataFrame) -> DataFrame:
    """The digests that occur more than once."""
    return _small(written(digests.groupBy("digest").count().where("count > 1").select("digest"), "shared"))


def _collisions(texts: DataFrame) -> DataFrame:
    """Byte comparison inside equal buckets: (digest, canon, nth) where different canonical texts share a digest.

    Equal texts are combined before the shuffle, so a large group of copies is one row.
    """
    distinct = texts.groupBy("digest", "canon").count()
    several = distinct.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    nth = F.row_number().over(Window.partitionBy("digest").orderBy("canon")) - 1
    return written(distinct.join(several, "digest", "left_semi").select("digest", "canon", nth.alias("nth")), "clash")


def _named(digest: Column, nth: Column) -> Column:
    return F.concat(digest, F.when(nth > 0, F.concat(F.lit("-"), nth.cast("string"))).otherwise(""))


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint", digits: int = DIGITS) -> DataFrame:
    """Add ``out``, equal exactly for texts with equal canonical forms; a column of that name is replaced.

    The digest is 32 hex digits; texts that share one are compared byte for byte, and if they differ, all but
    the first in byte order get a suffix ``-1``, ``-2``, ... Null and empty texts are equal. Empty tables
    stay empty.
    """
    rows = docs.withColumn("__canon", canonical(text)).withColumn("__digest", wide_digest(F.col("__canon"), digits))
    canon = rows.select(F.col("__canon").alias("canon"), F.col("__digest").alias("digest"))
    clash = _collisions(canon.join(_shared(canon.select("digest")), "digest", "left_semi"))
    if clash.isEmpty():
        return rows.withColumn(out, F.col("__digest")).drop("__digest", "__canon")
    clash = clash.select(F.col("digest").alias("__digest"), F.col("canon").alias("__canon"), F.col("nth").alias("__nth"))
    return rows.join(clash, ["__digest", "__canon"], "left").withColumn(out, _named(F.col("__digest"), F.col("__nth"))).drop("__digest", "__canon", "__nth")


def exact_classes(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint, class_id): documents with equal fingerprints, named by the smallest id."""
    marked = fingerprint(docs.select(id, text), text).select(id, "fingerprint")
    first = marked.groupBy("fingerprint").agg(F.min(id).alias("class_id"))
    return marked.join(first, "fingerprint").select(id, "fingerprint", "class_id")


def _cell(x: Column, bounds: list[int]) -> Column:
    """The number of ascending bounds up to ``x``: first among every k-th bound, then among the k after it."""
    if not bounds:
        return F.lit(0)
    k = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[i : i + k] for i in range(0, len(bounds), k)]

    def longs(values: list[int]) -> Column:
        return F.expr(f"cast(split('{','.join(map(str, values))}', ',') as array<bigint>)")

    fine = F.from_json(F.lit(str(groups)), "array<array<bigint>>")
    coarse = F.size(F.filter(longs([g[0] for g in groups]), lambda b: b <= x))
    inside = F.size(F.filter(F.get(fine, coarse - 1), lambda b: b <= x))
    return F.when(coarse > 0, (coarse - 1) * k + inside).otherwise(F.lit(0))


def _piece(h: Column, n: Column) -> Column:
    """Which of n equal parts of all 64-bit numbers ``h`` lies in (from 1), counted from the highest down."""
    return F.greatest(F.lit(1), F.least(n, F.ceil((F.lit(2.0**63) - h.cast("double")) / 2.0**64 * n).cast("int")))


def with_next(docs: DataFrame, id: str = "doc_id", text: str = "text", ranges: int | None = None, digits: int = DIGITS) -> DataFrame:
    """(id, text, digest, sha, copies, next_id, next_text, next_digest, next_sha): each row beside the next one in
    descending id (after the last: the first).

    ``digest`` is that of the canonical text; ``sha``, the SHA-256 of the text, and the id name a row. Rows of one
    id follow each other by descending hash of the text, null ids come last, null texts count as empty.

    Rows are dealt to ranges of ids with quantiles of the ids as bounds. Rows without an id, and those of an id that
    fills several ranges, are cut by the hash, and equal ones of them are one row that stands for ``copies`` (all but
    the last of which are followed by their like). Each range also gets the first row of the range below as a guard,
    so neighbours are found inside ranges and no task sorts all rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total, absent, size = rows.agg(F.count("*"), F.count_if(F.col("id").isNull()), F.sum(F.octet_length("text"))).first()
    ranges = ranges or min(MOST, max(FEWEST, total // RANGE_ROWS))
    found = [int(x) for x in rows.approxQuantile("id", [k / ranges for k in range(1, ranges)], 1 / (8 * ranges))]
    bounds = sorted(set(found))
    fill = {x: n for x, n in Counter(found).items() if n > 2}  # ids that fill ranges, and how many
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("copies", F.lit(1).cast("long"))
    parts = F.when(F.col("id").isNull(), F.lit(max(1, ranges * absent // max(1, total))))
    if fill:
        parts = F.when(F.col("id").isin(list(fill)), F.lit(max(fill.values()))).otherwise(parts)
    if fill or absent:
        often = F.col("id").isNull() | F.col("id").isin(list(fill))
        rows = rows.where(~often).unionByName(rows.where(often).groupBy("id", "text", "h").agg(F.count("*").alias("copies")))
    # an id with pieces is the least of its cell, so its pieces (1, 2, ...) follow the others (0)
    piece = F.coalesce(F.when(parts.isNotNull(), _piece(F.col("h"), parts)), F.lit(0))
    rows = rows.withColumn("cell", F.when(F.col("id").isNull(), F.lit(-1)).otherwise(_cell(F.col("id"), bounds))).withColumn("piece", piece)
    tops = {(r.cell, r.piece): (r.id, r.h) for r in rows.groupBy("cell", "piece").agg(F.max("id").alias("id"), (F.max("h") if fill or absent else F.lit(0)).alias("h")).collect()}  # a row per range
    order = sorted(tops, key=lambda k: (-k[0], k[1]))
    rows = rows.withColumn("guard", F.lit(0))
    if order:
        above = [{"cell": c, "piece": p, "to": t, "to_piece": q} for (c, p), (t, q) in zip([*order[1:], *order[:1]], order, strict=True)]  # a range, and the one that its first row follows
        heads = F.col("id").isin([i for (_, p), (i, _) in tops.items() if not p]) & (F.col("piece") == 0)
        if fill or absent:
            heads = heads | F.col("h").isin([h for (_, p), (_, h) in tops.items() if p]) & (F.col("piece") > 0)
        first = F.max(F.struct("id", "h", "text")).alias("x")
        guards = rows.where(heads).groupBy("cell", "piece").agg(first).select("cell", "piece", "x.*")
        to = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(above)), "array<struct<cell: int, piece: int, to: int, to_piece: int>>")).alias("x")).select("x.*")
        guards = guards.join(F.broadcast(to), ["cell", "piece"])
        rows = rows.unionByName(guards.select("id", "text", "h", F.lit(1).cast("long").alias("copies"), F.col("to").alias("cell"), F.col("to_piece").alias("piece"), F.lit(1).alias("guard")))
    rows = rows.withColumn("canon", canonical("text")).withColumn("digest", wide_digest(F.col("canon"), digits)).withColumn("sha", F.unhex(F.sha2("text", 256))).drop("canon")
    rows = rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), (size or 0) // PARTITION_BYTES), "cell", "piece")
    line = Window.partitionBy("cell", "piece").orderBy("guard", F.desc_nulls_last("id"), F.desc("h"), F.desc("text"))
    for c in ("id", "text", "digest", "sha"):
        rows = rows.withColumn(f"next_{c}", F.lead(c).over(line))
    return rows.where("guard = 0").drop("guard", "cell", "piece", "h")


def _edit(text: Column, next_text: Column) -> Column:
    cut = F.floor(F.char_length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - cut), F.substring(next_text, F.lit(1), cut))


def _renamed(light: DataFrame, docs: DataFrame, id: str, text: str) -> DataFrame | None:
    """(digest, sha, nth) of the texts and edits of ``light`` that share a digest with an earlier, different canonical
    text; None where no digest is shared by different ones.

    Texts with one SHA-256 are one text. Of every digest that several have, one row each is fetched again (an edit with
    the row that follows) and their canonical texts are compared byte for byte.
    """
    row = ["id", "sha", "next_id", "next_sha"]
    none = [F.lit(None).cast("long").alias("next_id"), F.lit(None).cast("binary").alias("next_sha")]
    every = light.select("digest", F.col("sha").alias("key"), "id", "sha", *none).union(light.select("edited_digest", F.unhex("edited_sha256"), *row))
    two = [F.xxhash64(F.lit(seed), "key") for seed in (1, 2)]
    several = every.groupBy("digest").agg(*[f(x).alias(f"{n}{k}") for k, x in enumerate(two) for n, f in (("a", F.min), ("b", F.max))]).where("a0 <> b0 or a1 <> b1")
    several = written(several.select("digest"), "several")
    if several.isEmpty():
        return None
    each = every.join(_small(several), "digest").groupBy("digest", "key").agg(F.min(F.struct(*row)).alias("x")).select("digest", "key", "x.*")
    each = written(each, "each")
    wanted = written(each.select("id", "sha").union(each.where("next_sha is not null").select("next_id", "next_sha")).distinct(), "wanted")
    ids = _small(written(wanted.select("id").distinct(), "ids"))
    source = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = source.join(ids, source.id.eqNullSafe(ids.id), "left_semi").withColumn("sha", F.unhex(F.sha2("text", 256)))
    keys = _small(wanted)
    texts = texts.join(keys, texts.id.eqNullSafe(keys.id) & (texts.sha == keys.sha), "left_semi")
    texts = written(texts.groupBy("id", "sha").agg(F.min("text").alias("text")), "texts")
    own = each.alias("e").join(texts.alias("t"), F.expr("e.id <=> t.id and e.sha = t.sha")).select("e.*", "t.text")
    follow = texts.select(F.col("id").alias("n_id"), F.col("sha").alias("n_sha"), F.col("text").alias("next_text"))
    cut = own.where("next_sha is not null").join(follow, F.expr("next_id <=> n_id and next_sha = n_sha")).select("digest", "key", _edit(F.col("text"), F.col("next_text")).alias("text"))
    both = own.where("next_sha is null").select("digest", "key", "text").union(cut).withColumn("canon", canonical("text")).drop("text")
    both = written(both, "canon")
    clash = _collisions(both)
    if clash.isEmpty():
        return None
    return written(both.join(clash, ["digest", "canon"]).where("nth > 0").select("digest", F.col("key").alias("sha"), "nth"), "renamed")


def edits(docs: DataFrame, id: str = "doc_id", text: str = "text", digits: int = DIGITS) -> DataFrame:
    """Fingerprints of every document, of its edit and of its likeness to the next one.

    The edit replaces the last third of the text's code points by the first as many of the next document's (see
    `with_next` for rows that share an id or have none).
    Returns (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row for every
    row of ``docs``; fingerprints are named as `fingerprint` does, over texts and edits together, and the likeness of
    two exact ones is 1 if they are equal, else 0.
    """
    rows = with_next(docs, id, text, digits=digits)
    # of several copies, all but one are followed by their like
    kinds = F.filter(F.array(F.struct(F.lit(False).alias("like"), F.lit(1).cast("long").alias("n")), F.struct(F.lit(True).alias("like"), (F.col("copies") - 1).alias("n"))), lambda x: x.n > 0)
    rows = rows.withColumn("kind", F.explode(kinds))
    for c in ("id", "text", "digest", "sha"):
        rows = rows.withColumn(f"next_{c}", F.when(F.col("kind.like"), F.col(c)).otherwise(F.col(f"next_{c}")))
    rows = rows.withColumn("edited", _edit(F.col("text"), F.col("next_text"))).withColumn("edited_canon", canonical("edited"))
    light = written(rows.select(
        "id", "sha", "next_id", "next_sha", "digest", "next_digest", F.char_length("text").cast("long").alias("n_chars"), F.col("kind.n").alias("n"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), wide_digest(F.col("edited_canon"), digits).alias("edited_digest"),
    ), "edits")
    light = light.withColumn("edited_key", F.unhex("edited_sha256"))
    renamed = _renamed(light, docs, id, text)
    for out, digest, sha in (("fingerprint", "digest", "sha"), ("edited_fingerprint", "edited_digest", "edited_key"), ("next_fingerprint", "next_digest", "next_sha")):
        if renamed is None:
            light = light.withColumn(out, F.col(digest))
        else:
            names = renamed.select(F.col("digest").alias(digest), F.col("sha").alias(sha), "nth")
            light = light.join(names, [digest, sha], "left").withColumn(out, _named(F.col(digest), F.col("nth"))).drop("nth")
    light = light.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    same = lambda x, y: F.when(F.col(x) == F.col(y), 1.0).otherwise(0.0)
    return light.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                        same("fingerprint", "edited_fingerprint").alias("near_edited"), same("fingerprint", "next_fingerprint").alias("near_next"))
