"""Readers, writers, source inventory and review packets."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.answers import answer_log
from lectern.sources.schemas import require_columns

ROUTING_KEYS = ("level", "subject_code", "year", "session", "component", "question_number")
REVIEW = ("is_correct", "reviewer", "reviewed_at", "notes")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are skipped and a missing path is an empty table."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    parsed = lines.filter(F.trim("value") != "").select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row"))
    return parsed.select("row.*")


def read_csv(spark: SparkSession, path: str, schema: str, required: Iterable[str] = ()) -> DataFrame:
    """CSV with a header; columns are matched by name and the required ones must be there."""
    header = spark.read.option("header", True).csv(path)
    require_columns(header, required)
    wanted = spark.createDataFrame([], schema).schema
    return header.select(*[
        (F.col(f.name).try_cast(f.dataType) if f.name in header.columns else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in wanted
    ])


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, fields: Sequence[str], mode: str = "overwrite") -> None:
    """Only ``fields``, in their order; other columns are left out."""
    df.select(*fields).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks partitioned by type and sorted by routing keys, so filters on them skip files and row groups."""
    keys = [k for k in ROUTING_KEYS if k in chunks.columns]
    # Rebalancing splits a type that fills most of the corpus into files of the advisory size.
    chunks.hint("rebalance", F.col("document_type")).sortWithinPartitions(*keys).write.mode("overwrite").partitionBy(
        "document_type").parquet(path)


def write_postings(postings: DataFrame, path: str, parts: int | None = None) -> None:
    """Postings ranged by term (a very frequent term spans several files) for term pruning at read time."""
    ranged = postings.repartitionByRange(parts, "term", "chunk_id") if parts else postings.repartitionByRange("term", "chunk_id")
    ranged.sortWithinPartitions("term").write.mode("overwrite").parquet(path)


def inventory(spark: SparkSession, root: str, pattern: str = "*.pdf") -> DataFrame:
    """``(path, bytes, sha256)`` of every matching file below ``root``."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    )
    base = root.rstrip("/") + "/"
    relative = F.regexp_replace("path", F.lit(rf"^.*?\Q{base}\E"), F.lit(""))
    return files.select(relative.alias("path"), F.length("content").cast("bigint").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def fingerprint(files: DataFrame, schema_version: str, buckets: int = 4096) -> DataFrame:
    """One-row content fingerprint of an inventory, independent of listing order.

    File lines are hashed in even buckets first, so no task holds the whole inventory.
    """
    line = F.sha2(F.to_json(F.struct("bytes", "path", "sha256")), 256)
    ordered = lambda c: F.array_join(F.array_sort(F.collect_list(c)), "")
    parts = files.select(line.alias("h")).groupBy(F.pmod(F.xxhash64("h"), F.lit(buckets)).alias("b")).agg(F.sha2(ordered("h"), 256).alias("d"))
    return parts.agg(F.substring(F.sha2(F.concat(F.lit(schema_version), ordered("d")), 256), 1, 20).alias("fingerprint"))


def _blank(*names: str) -> list[Column]:
    return [F.lit("").alias(n) for n in names]


def metadata_review(documents: DataFrame) -> DataFrame:
    return documents.select("*", *_blank(*REVIEW))


def boundary_review(chunks: DataFrame, size: int = 50) -> DataFrame:
    """The first ``size`` parsed entries in corpus order, with blank review columns."""
    rows = chunks.filter(F.col("content_type").isin("QUESTION", "MARK_SCHEME_ENTRY")).orderBy("ord").limit(size)
    return rows.select("chunk_id", "document_id", "question_number", F.col("page_start").alias("page"), "text", *_blank(*REVIEW))


def ocr_review(pages: DataFrame, size: int = 50) -> DataFrame:
    """The ``size`` pages most in need of review: OCR pages first, then the lowest quality."""
    rows = pages.orderBy(~F.coalesce("ocr_attempted", F.lit(False)), "quality_score", "document_id", "page_number").limit(size)
    return rows.select(
        "document_id", F.col("page_number").alias("page"), "ocr_engine", "quality_score", F.col("clean_text").alias("text"),
        *_blank("correct_words", "reviewed_words", "reviewer", "reviewed_at", "notes"),
    )


def append_answer_log(answers: DataFrame, path: str) -> None:
    answer_log(answers).write.mode("append").parquet(path)
