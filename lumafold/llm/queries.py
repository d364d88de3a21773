"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumafold.llm import brown_lm, byte_bpe, codebooks, divergence, infill, line_dedup, mtree_search, near_dup, packing, pairwise_quality, piece_counts, sstable, substring_dedup
from lumafold.session import ship, table


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    packed = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_sst_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    return sstable.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op7_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    return line_dedup.dedup_digest(docs)


def op9_rank_queue_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    return substring_dedup.dedup_digest(docs, length=50)


def op2_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    return divergence.judge(docs).drop("language", "class_distance", "word_distance", "word_limit")


def op3_bayesian_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    return near_dup.near_duplicates(docs, width=5, percent=85)


def op1_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    return pairwise_quality.classify(docs, table(spark, sf_dir, "labels"))


def op10_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    return brown_lm.score_documents(docs)


def op8_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(ship(spark), sf_dir, "embeddings")
    return mtree_search.top_k(vectors, F.col("id") % 20 == 0, k=20)


def op11_pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    return piece_counts.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ship(spark), sf_dir, "documents")
    return infill.digests(docs)


def op13_kdtree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(ship(spark), sf_dir, "embeddings")
    return codebooks.code_table(vectors)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_sst_shards": op6_sst_shards,
    "op7_line_windows": op7_line_windows,
    "op9_rank_queue_bpe": op9_rank_queue_bpe,
    "op4_difference_cover": op4_difference_cover,
    "op2_divergence_rules": op2_divergence_rules,
    "op3_bayesian_minhash": op3_bayesian_minhash,
    "op1_bradley_terry": op1_bradley_terry,
    "op10_brown_classes": op10_brown_classes,
    "op8_mtree_topk": op8_mtree_topk,
    "op11_pretoken_counts": op11_pretoken_counts,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_kdtree_codes": op13_kdtree_codes,
}

ORACLES: dict[str, str] = {
    "op7_line_windows": line_dedup.SQL,
    "op4_difference_cover": substring_dedup.SQL,
    "op3_bayesian_minhash": near_dup.SQL,
    "op2_divergence_rules": divergence.sql(),
    "op8_mtree_topk": mtree_search.SQL,
    "op12_fill_in_middle": infill.SQL,
    "op13_kdtree_codes": codebooks.sql(),
}
