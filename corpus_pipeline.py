"""The corpus pipeline: documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a table that is written
and read again as the next stage's docs. All but the last return the columns of documents, with n_chars anew.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumafold.llm import divergence, line_dedup, near_dup, packing, substring_dedup
from lumafold.llm.common import release, scratch, stage, text_key
from lumafold.session import ship, table


#: Names of the columns that the cuts add, unlike any of documents.
COUNTS = ("__lf_before", "__lf_removed")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` that aren't among the rows of ``gone`` (doc_id and __lf_key): other texts of the same id, or without one, stay."""
    rows = gone.select(F.col("doc_id").alias("__lf_gone"), F.col("__lf_key").alias("__lf_gone_key")).distinct().hint("shuffle_hash")
    same = docs["doc_id"].eqNullSafe(F.col("__lf_gone")) & (text_key() == F.col("__lf_gone_key"))
    return docs.join(rows, same, "left_anti").select(*docs.columns)


def _trimmed(cut: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` after a cut of texts: n_chars counted anew, and no rows that the cut left without a word."""
    emptied = (F.col(COUNTS[1]) > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    counted = cut.where(~emptied)
    if "n_chars" in docs.columns:
        counted = counted.withColumn("n_chars", F.when(F.col(COUNTS[1]) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return counted.select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the divergence rules reject go."""
    ship(spark)
    verdicts = stage(divergence.judge(docs, with_keys=True), "verdicts")  # written, else the filter would repeat the distances in its plan
    return _without(docs, verdicts.where("not kept"))


def line_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of three-line windows go; documents of which nothing stays go too."""
    ship(spark)
    return _trimmed(line_dedup.dedup_lines(docs, counts=COUNTS), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, the document with the smallest id stays."""
    ship(spark)
    return _without(docs, near_dup.near_duplicates(docs, width=5, percent=85, with_keys=True).where("not kept"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of later copies of fifty-word windows go; documents of which nothing stays go too."""
    ship(spark)
    return _trimmed(substring_dedup.dedup_substrings(docs, length=50, counts=COUNTS), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece, with its place in its sequence."""
    ship(spark)
    packed = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_windows),
    ("minhash_near_dedup", near_duplicates),
    ("substring_dedup", substrings),
    ("best_fit_packing", best_fit_packing),
]

#: Packing has no SQL form, so the run is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(ship(spark), sf_dir, "documents")
    for name, work in STAGES[:-1]:
        with scratch(spark) as keep:  # what a stage wrote for itself goes when its result is written
            docs = keep(stage(work(spark, docs, sf_dir), name))
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
