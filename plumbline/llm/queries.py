"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.alignment import align_tokens
from plumbline.llm.exact_dedup import exact_duplicates
from plumbline.llm.fill_in_middle import fill_in_middle_digests
from plumbline.llm.flat_tokens import token_counts
from plumbline.llm.hamming import nearest
from plumbline.llm.language_id import hierarchical_language_id
from plumbline.llm.near_dedup import near_duplicates
from plumbline.llm.packing import encode_pieces, pack
from plumbline.llm.piece_sampling import decode_pieces, sample_pieces
from plumbline.llm.repeats import remove_repeats
from plumbline.llm.shared import table
from plumbline.llm.token_output import read_shards, write_shards
from plumbline.llm.url_filter import judge_urls
from plumbline.llm.warc import read_archives, write_archives


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and n_tokens (with the end id) of every document, by the 49k vocabulary."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keeps_space=False, end_id=49407)


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keeps_space=True, end_id=2)
    return read_shards(spark, shards)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchical_language_id(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keeps_space=False, end_id=0)
    return pack(pieces).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_archives(write_archives(table(spark, sf_dir, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the number and crc32 of the sampled ids of its whole text, and the crc32 of the text decoded from them."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    back = decode_pieces(sample_pieces(table(spark, sf_dir, "documents"), model), model)
    n = (F.octet_length("ids") / 4).cast("long").alias("n_pieces")
    return back.select("doc_id", n, F.crc32("ids").alias("ids_crc32"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest sign codes for every vector whose id is divisible by 20, among all rows."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), k=10)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle_digests(table(spark, sf_dir, "documents"))


def op12_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py, which stands at the top of the repository."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_near_dedup": op2_near_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_token_output": op4_token_output,
    "op5_language_id": op5_language_id,
    "op6_packing": op6_packing,
    "op7_warc": op7_warc,
    "op8_piece_sampling": op8_piece_sampling,
    "op9_top_k": op9_top_k,
    "op10_url_filter": op10_url_filter,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_repeat_removal": op12_repeat_removal,
    "op13_token_alignment": op13_token_alignment,
    "pipeline": pipeline,
}
