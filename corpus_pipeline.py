"""A corpus pipeline: language ID, line dedup, SimHash dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written
as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwright.llm import bpe, langid, linededup, mixing, simhash
from graphwright.llm.common import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without a letter go."""
    said = langid.identify(docs)
    return said.where(F.col("lang_pred") != langid.UNKNOWN).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that other documents repeat; n_chars follows."""
    kept = linededup.dedup_lines(docs)
    return kept.withColumns({"text": F.col("deduped"), "n_chars": F.length("deduped").cast("long")}).select(
        *COLUMNS
    )


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the least doc_id, of each group of near-duplicates.

    Texts of a Jaccard similarity of 0.8 or more over sets of five words. Rows
    without a doc_id come after others; of rows repeated as a whole one stays.
    """
    return simhash.deduplicated(docs, n=5, similarity=0.8).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as often as it takes it."""
    return mixing.mixed_documents(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of each document's ids and decoded bytes."""
    import public_tokenizers

    return bpe.bpe_digests(
        docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


STAGES = [
    ("language_id", language),
    ("line_dedup", line_dedup),
    ("simhash_dedup", near_dedup),
    ("mixing", mixing_stage),
    ("bpe", encode),
]

#: Language ID, SimHash and BPE have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, all stages applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
