"""The queries of the operators of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, language, mixing, ngram_join, pii, recompression, suffix_dedup, topk, warc
from .common import table


def vocabulary_path() -> str:
    """The byte-level BPE file that comes with the public tokenizers package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive_round_trip(spark, table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), vocabulary_path())


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op6_language_ecoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op8_pii_lstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op9_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.substring_dedup(table(spark, sf_dir, "documents"))


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_capture_index": op1_warc_capture_index,
    "op2_entropy_mixing": op2_entropy_mixing,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_bpe_round_trip": op4_bpe_round_trip,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_language_ecoc": op6_language_ecoc,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_pii_lstm_crf": op8_pii_lstm_crf,
    "op9_recompression_dedup": op9_recompression_dedup,
    "op10_topk_search": op10_topk_search,
}

ORACLES: dict[str, str] = {
    "op1_warc_capture_index": warc.SQL,
    "op2_entropy_mixing": mixing.SQL,
    "op3_ngram_jaccard_join": ngram_join.SQL,
    "op5_exact_dedup": exact_dedup.SQL,
    "op7_suffix_array_dedup": suffix_dedup.SQL,
    "op9_recompression_dedup": recompression.SQL,
    "op10_topk_search": topk.SQL,
}
