"""Answer disposition, official answers, source details, citation and cost columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T

# Default prices in USD per million tokens, log columns.
EMBEDDING_PRICE, INPUT_PRICE, OUTPUT_PRICE = 0.02, 0.40, 1.60
ANSWER_LOG = (
    "timestamp", "question", "generated_answer", "answer_type", "category", "difficulty", "execution_status",
    "retrieved_documents", "retrieved_pages", "citations", "citation_valid", "confidence", "latency_ms", "input_tokens",
    "output_tokens", "estimated_cost", "judge_status", "context_precision", "context_recall", "faithfulness",
    "answer_relevancy", "answer_correctness", "noise_sensitivity", "trace_id",
)


def disposition(sufficient: Column, exact_scheme: Column, generator_available: Column, intent: Column) -> Column:
    """What happens to a question: abstain, quote the scheme, skip, or generate."""
    generated = F.when(intent == "EXAM_ANSWER", "AI_GENERATED_MODEL_ANSWER").otherwise("CURRICULUM_EXPLANATION")
    kind = (
        F.when(~sufficient, "INSUFFICIENT_SOURCE").when(exact_scheme, "OFFICIAL_MARK_SCHEME_SUPPORTED_ANSWER")
        .when(~generator_available, "GENERATION_NOT_RUN").otherwise(generated)
    )
    status = (
        F.when(~sufficient, "COMPLETED_ABSTENTION").when(exact_scheme, "COMPLETED")
        .when(~generator_available, "SKIPPED_MISSING_API_KEY").otherwise("TO_GENERATE")
    )
    return F.struct(kind.alias("answer_type"), status.alias("execution_status"))


def official_answers(context_rows: DataFrame) -> DataFrame:
    """Scheme texts of each query joined in rank order; a paper's entries for one question are few."""
    rows = context_rows.filter((F.col("document_type") == "MARK_SCHEME") & (T.strip("text") != ""))
    return rows.groupBy("query_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("context_position", T.strip("text").alias("t")))), lambda r: r["t"]), "\n\n"
        ).alias("answer")
    )


def source_details(rows: DataFrame) -> DataFrame:
    """First row per (query, document, page, chunk) with the name fallbacks filled in."""
    have = set(rows.columns)
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n in have], F.lit(None).cast("string"))
    same = Window.partitionBy("query_id", "document_id", "page_start", "chunk_id").orderBy("position")
    return rows.withColumn("_rn", F.row_number().over(same)).filter(F.col("_rn") == 1).select(
        "query_id", "position", pick("book_name", "document_title", "document_id").alias("book_name"),
        pick("chapter", "section_title").alias("chapter"), pick("topic", "section_title", "content_type").alias("topic"),
        F.col("page_start").alias("page"), F.col("document_id").alias("source_document"), "chunk_id", "document_type",
    )


def canonical_citations(keys: Column, catalog: Column) -> Column:
    """Distinct cited sources in key order; ``catalog`` maps a source key to its struct."""
    return F.array_distinct(F.array_compact(F.transform(keys, lambda k: F.try_element_at(catalog, k))))


def invalid_citations(citations: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Cited (document, page, chunk) identities that were not retrieved for their query."""
    seen = retrieved.select("query_id", "document_id", F.col("page_start").alias("page"), "chunk_id")
    return citations.join(seen, ["query_id", "document_id", "page", "chunk_id"], "left_anti")


def embedding_cost(tokens: Column, price: float = EMBEDDING_PRICE) -> Column:
    return F.bround(tokens * F.lit(price) / 1_000_000, 8)


def generation_cost(input_tokens: Column, output_tokens: Column, input_price: float = INPUT_PRICE, output_price: float = OUTPUT_PRICE) -> Column:
    return F.bround((input_tokens * F.lit(input_price) + output_tokens * F.lit(output_price)) / 1_000_000, 8)


def usage_totals(requests: DataFrame, key: str) -> DataFrame:
    """Token and cost sums per ``key`` over all provider calls of a request."""
    cost = generation_cost(F.col("input_tokens"), F.col("output_tokens"))
    return requests.groupBy(key).agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum(cost), 8).alias("total_cost")
    )


def answer_log(answers: DataFrame) -> DataFrame:
    """The 24-column append-only answer log of finished answers.

    ``answers`` has ``question, answer, answer_type, profile, execution_status, retrieved, citations,
    citation_valid, confidence, latency_ms, input_tokens, output_tokens, estimated_cost, trace_id,
    timestamp``.
    """
    documents = F.array_sort(F.array_distinct(F.transform("retrieved", lambda r: r["document_id"])))
    pages = F.array_sort(F.array_distinct(F.array_compact(F.transform("retrieved", lambda r: r["page_start"]))))
    cited = F.transform("citations", lambda c: F.concat(c["document_id"], F.lit(" p."), c["page"].cast("string")))
    unmeasured = [F.lit(None).cast("double").alias(n) for n in ANSWER_LOG[17:23]]
    return answers.select(
        "timestamp", "question", F.col("answer").alias("generated_answer"), "answer_type",
        F.col("profile.category").alias("category"), F.col("profile.difficulty").alias("difficulty"), "execution_status",
        F.array_join(documents, ", ").alias("retrieved_documents"),
        F.array_join(F.transform(pages, lambda p: p.cast("string")), ", ").alias("retrieved_pages"),
        F.array_join(cited, "; ").alias("citations"), "citation_valid", "confidence", "latency_ms", "input_tokens",
        "output_tokens", "estimated_cost", F.lit("NOT_MEASURED").alias("judge_status"), *unmeasured, "trace_id",
    )
