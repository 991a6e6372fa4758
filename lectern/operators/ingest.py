"""From candidate page extractions and file listings to documents and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T

UNKNOWN_SOURCE = {"level": "UNKNOWN", "subject_code": "", "expected_document_type": "UNKNOWN"}
READABLE = 0.75
ENGINES = ("native", "secondary", "paddle", "tesseract")


def source_for(path: Column, filename: Column, rules: Sequence[dict]) -> Column:
    """The first configured source whose folder and filename fragment fit, as a struct.

    Rules are configuration, so they become one CASE expression instead of a join.
    """
    where, name = F.lower(path), F.lower(filename)

    def row(rule: dict) -> Column:
        return F.struct(*[F.lit(rule[k]).alias(k) for k in ("level", "subject_code", "expected_document_type")])

    out = F.when(F.lit(False), row(UNKNOWN_SOURCE))
    for rule in rules:
        fits = F.contains(where, F.lit(rule["folder"].lower()))
        fragments = rule.get("filename_contains") or []
        if fragments:
            any_of = F.lit(False)
            for fragment in fragments:
                any_of = any_of | F.contains(name, F.lit(fragment.lower()))
            fits = fits & any_of
        out = out.when(fits, row(rule))
    return out.otherwise(row(UNKNOWN_SOURCE))


def document_type(filename: Column, first_pages: Column, folder: Column) -> Column:
    """Document type; what the filename says beats what the first pages say."""
    name = F.replace(F.lower(filename), F.lit("_"), F.lit("-"))
    body = F.lower(F.concat_ws(" ", filename, first_pages, folder))
    has = lambda c, *phrases: F.reduce(
        F.array(*[F.lit(p) for p in phrases]), F.lit(False), lambda acc, p: acc | F.contains(c, p)
    )
    return (
        F.when(has(name, "mark-scheme", "mark scheme"), "MARK_SCHEME")
        .when(has(name, "examiner-report", "examiner report"), "EXAMINER_REPORT")
        .when(has(name, "syllabus"), "SYLLABUS")
        .when(has(name, "book"), "TEXTBOOK")
        .when(has(body, "examiner report", "principal examiner"), "EXAMINER_REPORT")
        .when(has(body, "mark scheme", "maximum raw mark"), "MARK_SCHEME")
        .when(has(body, "question paper", "answer all questions", "past paper"), "QUESTION_PAPER")
        .when(has(body, "syllabus"), "SYLLABUS")
        .when(has(body, "book", "computer science"), "TEXTBOOK")
        .otherwise("UNKNOWN")
    )


def document_metadata(
    filename: Column, text: Column, level: Column, subject_code: Column, doc_type: Column
) -> Column:
    """Struct of year, session, component, exact_pair_id and document_id."""
    value = F.lower(F.concat(filename, F.lit(" "), F.substring(text, 1, 5000)))
    stem = F.regexp_replace(filename, r"(.)\.[^.]*\z", "$1")
    year = F.regexp_extract(value, r"(?U)\b(20\d{2})\b", 1).try_cast("int")
    session = (
        F.when(value.rlike(r"(?U)may\s*/\s*june"), "MJ")
        .when(value.rlike(r"(?U)february\s*/\s*march"), "FM")
        .when(value.rlike(r"(?U)october\s*/\s*november"), "ON")
    )
    component = F.coalesce(
        T.non_blank(F.regexp_extract(value, r"(?U)\b(2210|9618)\s*/\s*(\d{2})\b", 2)),
        T.non_blank(F.regexp_extract(value, r"(?U)(?:paper|component)\s*([123])\b", 1)),
    )
    paired = doc_type.isin("QUESTION_PAPER", "MARK_SCHEME") & year.isNotNull() & session.isNotNull() & component.isNotNull()
    pair = F.when(paired, F.concat_ws("_", subject_code, session, year.cast("string"), component))
    suffix = F.when(doc_type == "QUESTION_PAPER", "qp").otherwise("ms")
    return F.struct(
        year.alias("year"),
        session.alias("session"),
        component.alias("component"),
        pair.alias("exact_pair_id"),
        F.when(paired, F.concat_ws("_", pair, suffix))
        .otherwise(F.concat_ws("_", F.lower(level), T.slug(stem)))
        .alias("document_id"),
    )


def select_page_text(candidates: DataFrame) -> DataFrame:
    """One row per page with the text of the best engine.

    Native text stays unless it needs OCR; then a better second parser replaces it, and, when the page
    has images and the text is still poor, a better OCR result.  The first OCR engine is accepted at
    ``max(0.75, current)`` quality, otherwise the better of the two, the first winning ties.
    """
    pick = lambda engine, column: F.max(F.when(F.col("engine") == engine, F.col(column)))
    wide = candidates.groupBy("document_id", "page_number").agg(
        *[F.coalesce(pick(e, "text"), F.lit("")).alias(e) for e in ENGINES],
        *[pick(e, "confidence").alias(f"{e}_confidence") for e in ("paddle", "tesseract")],
        F.bool_or("has_images").alias("has_images"),
    )
    scored = wide.withColumns({f"{e}_q": T.quality_score(e) for e in ENGINES})
    poor = lambda text, q: (F.length(T.strip(text)) < 100) | (F.col(q) < READABLE)
    use_second = poor("native", "native_q") & (F.col("secondary_q") > F.col("native_q"))
    first = scored.withColumns({
        "secondary_parser_used": use_second,
        "_text": F.when(use_second, F.col("secondary")).otherwise(F.col("native")),
        "_q": F.when(use_second, F.col("secondary_q")).otherwise(F.col("native_q")),
    })
    blank = lambda e: T.strip(e) == ""
    primary = ~blank("paddle") & (
        (F.col("paddle_q") >= F.greatest(F.lit(READABLE), F.col("_q")))
        | blank("tesseract") | (F.col("paddle_q") >= F.col("tesseract_q"))
    )
    engine = F.when(F.col("ocr_attempted"), F.when(primary, "paddle").when(~blank("tesseract"), "tesseract"))
    tried = first.withColumn("ocr_attempted", poor("_text", "_q") & F.col("has_images")).withColumn("ocr_engine", engine)
    by_engine = lambda suffix: F.when(
        F.col("ocr_engine") == "paddle", F.col(f"paddle{suffix}")
    ).when(F.col("ocr_engine") == "tesseract", F.col(f"tesseract{suffix}"))
    ocr_text = by_engine("")
    better = ocr_text.isNotNull() & (by_engine("_q") > F.col("_q"))
    chosen = tried.withColumn("raw_text", F.when(better, ocr_text).otherwise(F.col("_text")))
    clean = T.clean_text("raw_text")
    return chosen.select(
        "document_id",
        "page_number",
        "raw_text",
        clean.alias("clean_text"),
        (~blank("native")).alias("native_text_available"),
        "secondary_parser_used",
        "ocr_attempted",
        (F.col("ocr_attempted") & (F.coalesce(ocr_text, F.lit("")) == F.col("raw_text"))).alias("ocr_used"),
        "ocr_engine",
        by_engine("_confidence").alias("ocr_confidence"),
        "has_images",
    ).withColumn("quality_score", T.quality_score("clean_text"))


def page_records(selected: DataFrame) -> DataFrame:
    """Blocks and content flags of selected page text; ``document_type`` and ``drawings`` are optional."""
    diagram = F.col("has_images")
    if {"drawings", "document_type"} <= set(selected.columns):
        diagram = diagram | ((F.col("document_type") == "QUESTION_PAPER") & (F.col("drawings") >= 15))
    return selected.withColumns({
        "blocks": T.line_blocks("clean_text"),
        "contains_table": T.contains_table("clean_text"),
        "contains_code": T.contains_code("clean_text"),
        "contains_diagram": diagram,
    })


def review_pages(pages: DataFrame) -> DataFrame:
    """Pages that went through OCR or stayed hard to read."""
    return pages.filter(F.col("ocr_attempted") | (F.col("quality_score") < READABLE))


def unknown_documents(documents: DataFrame) -> DataFrame:
    return documents.filter(F.col("document_type") == "UNKNOWN").select(
        "source_path", F.lit("Could not classify document").alias("reason")
    )


def document_rollup(pages: DataFrame) -> DataFrame:
    """Page count, native-text flag and the list of OCR pages per document."""
    return pages.groupBy("document_id").agg(
        F.count("*").alias("page_count"),
        F.bool_or("native_text_available").alias("native_text_available"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("ocr_attempted"), F.col("page_number")))),
                lambda p: p.cast("string"),
            ),
            ";",
        ).alias("ocr_required_pages"),
        F.lit("COMPLETE").alias("processing_status"),
    )


def build_report(documents: DataFrame, pages: DataFrame, chunk_totals: DataFrame) -> DataFrame:
    """One row of corpus counts; the three inputs are one-row aggregates when they meet."""
    docs = documents.agg(
        F.count("*").alias("documents"), F.count_if(F.col("document_type") == "UNKNOWN").alias("unknown_documents")
    )
    page = pages.agg(
        F.count("*").alias("pages"),
        F.count_if(F.col("ocr_attempted") | (F.col("quality_score") < READABLE)).alias("low_quality_or_ocr_pages"),
    )
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(docs).join(one(page), "_one").join(one(chunk_totals), "_one").drop("_one")


def coverage(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Extraction coverage, readable rate, OCR success and diagram image coverage, one row."""
    share = lambda hit, of: hit / F.greatest(F.lit(1), of)
    attempted = F.coalesce("ocr_attempted", F.lit(False))
    diagram = F.coalesce("contains_diagram", F.lit(False))
    found = pages.agg(
        F.count("*").alias("extracted_pages"),
        F.count_if(F.col("quality_score") >= READABLE).alias("_readable"),
        F.count_if(attempted).alias("ocr_candidate_count"),
        F.count_if(attempted & F.col("ocr_used")).alias("ocr_success_count"),
        F.count_if(diagram).alias("diagram_page_count"),
        F.count_if(diagram & (F.coalesce("figure_path", F.lit("")) != "")).alias("_figures"),
    )
    expected = documents.agg(
        F.count("*").alias("documents"), F.coalesce(F.sum("page_count"), F.lit(0)).alias("expected_pages")
    )
    both = expected.withColumn("_one", F.lit(1)).join(found.withColumn("_one", F.lit(1)), "_one")
    return both.select(
        "documents", "expected_pages", "extracted_pages",
        share(F.col("extracted_pages"), F.col("expected_pages")).alias("coverage"),
        share(F.col("_readable"), F.col("extracted_pages")).alias("readable_page_rate"),
        "ocr_candidate_count", "ocr_success_count",
        share(F.col("ocr_success_count"), F.col("ocr_candidate_count")).alias("ocr_success_rate"),
        "diagram_page_count",
        share(F.col("_figures"), F.col("diagram_page_count")).alias("diagram_image_coverage"),
    )
