"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ternspark.llm import langid, lines, minhash, mixing, packing
from ternspark.llm.scratch import shared_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models reject go, the others keep their columns."""
    known = langid.fit(docs.select("doc_id", "text", "lang").where(~langid.is_held_out()))
    return known.predict(docs).where(~F.col("rejected")).select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; ``n_chars`` follows the text."""
    return lines.drop_repeated_lines(docs).withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8) stays: the smallest id."""
    gone = minhash.near_duplicates(docs.select("doc_id", "text")).where(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out in the order of the weighted mix of sources."""
    return mixing.in_mix_order(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's length bucket, batch and place in it; batches are filled in the order of the mix.

    That order is the one of the files that the mixing stage wrote (names ascend, longer ones come later) and
    of the rows in them.
    """
    name = F.col("_metadata.file_name")
    return packing.pack(docs, place=(F.struct(F.length(name), name), F.col("_metadata.row_index")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("packing", pack_batches),
]

#: SQL states neither the language models nor the near-duplicate links at a corpus's size.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{name}")
        docs = spark.read.parquet(f"{out}/{name}")
    return docs
