"""The queries of this subpackage; ``oracles`` has DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnmem.llm import decontaminate, exact_dedup, jaccard_join, lm_score, packing, pii, quality, sharding, substring_dedup, token_counts
from cairnmem.llm.oracles import ORACLE_SQL as ORACLE_SQL


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of equal texts, and the row of each that stays."""
    return exact_dedup.classes(_documents(spark, sf_dir))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all texts under a bigram model with learned mixture weights."""
    return lm_score.scores(_documents(spark, sf_dir))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without the passages of 35 words that occur elsewhere."""
    kept = substring_dedup.remove_repeats(_documents(spark, sf_dir), min_words=35, with_text=False)
    return kept.select("doc_id", "n_words", "n_removed", "kept_sha256", "longest")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the documents whose sets of 4-word shingles have a similarity of 0.85 or more."""
    found = jaccard_join.near_copies(_documents(spark, sf_dir), n=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every text, by kind and place."""
    found = pii.find(_documents(spark, sf_dir))
    counts = [F.expr(f"size(filter(spans, s -> s.kind = '{kind}'))").cast("long").alias(f"n_{kind}") for kind in pii.BASE_KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_joined(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, found by the separators of flat token files."""
    return token_counts.document_token_counts(_documents(spark, sf_dir)).select("doc_id", "n_tokens", "ended")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the place and the similarity."""
    return decontaminate.find(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into power-of-two sequences of at most 1024 tokens."""
    return packing.pack(_documents(spark, sf_dir), max_tokens=1024, end_id=0, with_ids=False)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from the labels of four folds of five."""
    return quality.scores(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of near-equal bytes that keep equal texts together."""
    return sharding.shard(_documents(spark, sf_dir), shards=8)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_pii": op5_pii,
    "op6_token_counts": op6_token_counts,
    "op7_decontamination": op7_decontamination,
    "op8_packing": op8_packing,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_sharding": op10_sharding,
}
