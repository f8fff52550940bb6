"""The registered queries of this subpackage: each applies one operator, with its
production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameprep.llm import (byte_bpe, centroids, exact_dedup, filter_audit, jaccard_join, language_model, licenses, line_dedup, mixing, pii, quality,
                           substring_dedup, topk)
from frameprep.llm.common import table

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
LANGUAGE_WEIGHTS = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(licenses.license_scan(table(spark, sf_dir, "documents")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(pii.find_pii(table(spark, sf_dir, "documents")))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return language_model.lm_score(table(spark, sf_dir, "documents"), held_out)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.load_ranks(public_tokenizers.path(TOKENIZER))
    return byte_bpe.encode_digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.soft_mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), LANGUAGE_WEIGHTS, "lang")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.filter_masks(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_line_dedup, op3_exact_top_k, op4_ngram_jaccard_join, op5_pii, op6_lm_score, op7_byte_bpe, op8_quality,
    op9_soft_mixing, op10_exact_dedup, op11_filter_audit, op12_substring_dedup, op13_centroid_clustering)}
ORACLE = {"op3_exact_top_k": topk.ORACLE, "op10_exact_dedup": exact_dedup.ORACLE, "op11_filter_audit": filter_audit.ORACLE,
          "op12_substring_dedup": substring_dedup.ORACLE, "op13_centroid_clustering": centroids.ORACLE}
