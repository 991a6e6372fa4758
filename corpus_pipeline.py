"""From documents to packed training sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import common, decontaminate, minhash, packing, secrets, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't call toxic."""
    return toxicity.remove(docs.select(COLUMNS), common.read(spark, sf_dir, "labels"), toxicity.label_categories(), ["toxic"])


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near-duplicates."""
    return minhash.deduplicate(docs).select(COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.remove(docs.select(COLUMNS), common.read(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked; ``n_chars`` follows the text where it changed."""
    masked = secrets.redact(docs.withColumn("_before", F.col("text")))
    changed = ~F.col("_before").eqNullSafe(F.col("text"))
    return masked.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars"))).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens, described from the sequences' ids."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_copies", without_near_copies),
    ("benchmark", without_benchmark),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: The classifier, the sampling and the tokenizer have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, stages: list = STAGES) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in stages:
        docs = common.settle(stage(spark, docs, sf_dir), name)
    return docs


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training sequences with their token ids, of all that the stages before packing keep."""
    return packing.sequences(run(spark, sf_dir, STAGES[:-1]))
