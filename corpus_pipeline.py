"""From raw documents to training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs.  All but the last keep the columns of documents, whatever further columns
there are and whatever their names; the columns doc_id and text are read.

Nulls and ties, as the stages' operators have them: a null text counts as empty, in every stage.  Empty texts are
scored like others, are copies of each other, link with nothing, hold no benchmark item, and are packed as
their end token.  Of copies the smallest doc_id stays, null last.  Rows with a null doc_id pass like others, and
repeated rows are copies.  An empty table gives an empty result.
"""

from pyspark.sql import DataFrame, SparkSession

from cairnmem.llm import decontaminate, exact_dedup, jaccard_join, packing, quality
from cairnmem.llm.staging import Stage


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, does not reject: those that score 0.3 or more.  Without
    any labels all stay."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal texts, equal but for white space: the one with the smallest doc_id."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: 5-word shingles, a similarity of 0.8 or more.  Texts shorter
    than a shingle are near copies only of equal words."""
    return jaccard_join.drop_near_copies(docs, n=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark: no window as long as an item is like it by 0.8 or more.  Null and
    empty items match nothing."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 1024 tokens: doc_id, the place of the piece, and its ids."""
    return packing.pack(docs, max_tokens=1024, end_id=0)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", sequences),
]

#: SQL cannot express the classifier or the tokenizer; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table documents of sf_dir."""
    stage = Stage(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage.write(docs, name.replace(" ", "-"))
    return docs
