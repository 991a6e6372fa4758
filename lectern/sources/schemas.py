"""Explicit schemas of the engine tables and the required-column check."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

AUTHORITY = {"MARK_SCHEME": 6, "SYLLABUS": 5, "TEXTBOOK": 4, "EXAMINER_REPORT": 4, "QUESTION_PAPER": 3}

SOURCE_INVENTORY = "path string, bytes bigint, sha256 string"
DOCUMENTS = (
    "document_id string, source_path string, source_filename string, checksum_sha256 string, level string, "
    "qualification string, subject_code string, document_type string, year int, session string, "
    "paper_number string, component string, variant string, page_count int, authority_level int, "
    "exact_pair_id string, native_text_available boolean, ocr_required_pages string, processing_status string"
)
PAGE_TEXT = (
    "document_id string, page_number int, engine string, text string, confidence double, has_images boolean"
)
PAGES = (
    "document_id string, page_number int, document_type string, raw_text string, clean_text string, "
    "blocks array<struct<block_type: string, text: string>>, native_text_available boolean, "
    "secondary_parser_used boolean, ocr_attempted boolean, ocr_used boolean, ocr_engine string, "
    "ocr_confidence double, quality_score double, contains_table boolean, contains_code boolean, "
    "contains_diagram boolean, figure_path string"
)
CHUNKS = (
    "chunk_id string, document_id string, document_type string, level string, subject_code string, year int, "
    "session string, component string, page_start int, page_end int, text string, retrieval_text string, "
    "content_hash string, token_count int, authority_level int, content_type string, contains_code boolean, "
    "contains_table boolean, contains_diagram boolean, figure_path string, parent_chunk_id string, "
    "question_number string, marks int, maximum_marks int, relationship string, ord bigint"
)
QUERIES = (
    "query_id string, query string, level string, exam_year int, document_type string, conversation_id string"
)
HITS = "query_id string, chunk_id string, lane string, variant int, rank int, score double"
VECTORS = "chunk_id string, document_type string, level string, embedding array<float>"
TURNS = "conversation_id string, turn bigint, role string, content string, ts timestamp"
REFERENCE = "array<struct<document_id: string, page: int, chunk_id: string>>"
BENCHMARK = (
    "id string, question string, category string, difficulty string, expected_intent string, "
    f"gold_answer string, ground_truth_references {REFERENCE}, expected_pages array<int>, "
    f"expected_topics array<string>, expected_citations {REFERENCE}, review_status string, "
    "generation_provenance string, question_chunk_id string, answer_chunk_id string, "
    "source_validation_terms array<string>, gold_match_policy string, exact_mark_scheme_available boolean, "
    "level string"
)
ANSWERS = (
    "id string, execution_status string, answer string, latency_ms double, input_tokens int, "
    f"output_tokens int, estimated_cost double, technical_failure boolean, citations {REFERENCE}, "
    "retrieved array<struct<document_id: string, page_start: int, chunk_id: string>>"
)
TRACES = (
    "trace_id string, session_id string, created_at timestamp, category string, intent string, "
    "success boolean, failure_category string, latency_ms double, input_tokens int, output_tokens int, "
    "total_cost double, cache_hit boolean, data string"
)
TOPICS = (
    "topic_id string, name string, chapter_id string, chapter_name string, level string, "
    "section_number string, book_page_start int, book_page_end int, pdf_page_start int, pdf_page_end int, "
    "allows_code boolean, code_kind string, content_phrases array<string>, paper_phrases array<string>, "
    "strict_phrases boolean"
)
QUESTION = (
    "struct<number: int, question: string, question_type: string, options: array<string>, "
    "correct_option: string, marks: int, model_answer: string, rubric: array<string>, "
    "content_source: string, topic_ids: array<string>, requires_coding: boolean, "
    "citations: array<struct<document_id: string, chunk_id: string, page: int, source_role: string>>>"
)
ASSESSMENTS = (
    "assessment_id bigint, owner_id bigint, topic string, difficulty string, type string, status string, "
    f"created_at timestamp, questions array<{QUESTION}>"
)
SUBMISSIONS = (
    "submission_id bigint, assessment_id bigint, student_id bigint, answer_text string, submitted_at timestamp"
)
GRADES = (
    "grade_id bigint, submission_id bigint, ai_score double, human_score double, max_score double, "
    "comments string, confidence_score double, reviewed_by bigint, reviewed_at timestamp"
)
REVIEWS = "grade_id bigint, reviewer_id bigint, human_score double, comments string, reviewed_at timestamp"


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df
