"""Corpus pipeline: quality filter, exact dedup, near dedup, mixing, tokenising.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; its result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameprep.llm import byte_bpe, exact_dedup, jaccard_join, mixing, quality
from frameprep.llm.common import release, release_since, staged, staged_so_far, table
from frameprep.llm.queries import TOKENIZER


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject."""
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return exact_dedup.keep_one_per_text(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the row with the smallest doc_id."""
    return jaccard_join.keep_one_per_class(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated by their fitted rates, so that small domains reach their targets."""
    return mixing.mix_rows(docs, table(spark, sf_dir, "labels"), "lang")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, and how many copies the mix holds."""
    ranks = byte_bpe.load_ranks(public_tokenizers.path(TOKENIZER))
    rows = byte_bpe.encode_digests(docs, ranks, public_tokenizers.PATTERN)
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_duplicates),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", tokenise),
]

#: SQL cannot express a trained classifier or merges by rank
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        mark, read = staged_so_far(), docs
        docs = staged(stage(spark, docs, sf_dir), f"stage{k}")
        release_since(mark, docs)
        release(read)
    return STAGES[-1][1](spark, docs, sf_dir)
