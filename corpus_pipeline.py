"""From raw documents to packed training sequences, in four stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one
before it kept; it is written as Parquet and read again before the next.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.exact_dedup import drop_duplicates
from plumbline.llm.language_id import drop_undetermined
from plumbline.llm.near_dedup import drop_near_duplicates
from plumbline.llm.packing import encode_pieces, pack
from plumbline.llm.shared import new_folder, scratch, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts in which no language can be told: null, or without a letter."""
    return drop_undetermined(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates, linked from a similarity of 0.8, the row with the smallest doc_id stays."""
    return drop_near_duplicates(docs, threshold=80)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts, with the sequence of 2048 ids that each is in and its place there."""
    pieces = encode_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), keeps_space=False, end_id=0)
    return pack(pieces).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("packing", packing),
]

#: SQL can express neither the language machines nor near-duplicates or packing; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out = new_folder(spark, f"stage-{name}")
        with scratch(spark):
            done = stage(spark, docs, sf_dir)
            done.write.parquet(out)
        docs = spark.read.schema(done.schema).parquet(out)
    return STAGES[-1][1](spark, docs, sf_dir)
