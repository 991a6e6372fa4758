"""Question understanding as column expressions: paper reference, category, profile, variants."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T

# Subject codes, category rules in priority order, plan knobs, phrase lists.
SUBJECT_LEVELS = {"9618": "A_LEVEL", "2210": "O_LEVEL"}
CATEGORY_RULES = (
    ("ASSESSMENT_GENERATION", r"\b(?:generate|create|make)\b[^\n]*\b(?:quiz|mock paper|assessment|assignment)\b"),
    ("MCQ", r"(?:^|\n)\s*(?:[A-D][.)]|\([A-D]\))\s+"),
    ("FILL_IN_THE_BLANK", r"_{3,}|\bfill (?:in )?the blank\b"),
    ("SQL", r"\b(?:SQL|SELECT|INSERT|UPDATE|DELETE FROM|CREATE TABLE|JOIN|primary key|foreign key)\b"),
    ("DEBUGGING", r"\b(?:debug|fix|correct)[^\n]*\b(?:code|program|algorithm)\b|\b(?:syntax|logic|runtime) error\b"),
    ("TRACE_TABLE", r"\b(?:trace table|dry[ -]?run|trace the algorithm|variable values)\b"),
    ("PROGRAMMING", r"\b(?:pseudocode|algorithm|procedure|function|recursion|binary search|linear search"
                    r"|bubble sort|insertion sort|write (?:a )?program|Python)\b"),
    ("CALCULATION", r"\b(?:calculate|convert|show your working|binary addition|hexadecimal conversion"
                    r"|floating[ -]?point)\b"),
    ("COMPARISON", r"\b(?:compare|contrast|difference between|similarities and differences)\b"),
    ("DEFINITION", r"^\s*(?:define|what is|what does [^\n]+ mean)\b"),
    ("EXAMINER_FEEDBACK", r"\b(?:examiner report|candidate mistake|common mistake)\b"),
    ("SYLLABUS", r"\b(?:syllabus|learning objective|assessment objective)\b"),
)
INTENTS = {
    "SYLLABUS": "SYLLABUS_QUERY",
    "EXAMINER_FEEDBACK": "EXAMINER_FEEDBACK",
    "COMPARISON": "CONCEPT_EXPLANATION",
    "DEFINITION": "CONCEPT_EXPLANATION",
    "THEORY": "CONCEPT_EXPLANATION",
    "PROGRAMMING": "CODE_EXPLANATION",
    "SQL": "CODE_GENERATION",
    "DEBUGGING": "CODE_DEBUGGING",
    "TRACE_TABLE": "EXECUTION_TRACE",
    "CALCULATION": "WORKED_CALCULATION",
    "MCQ": "OPTION_SELECTION",
    "FILL_IN_THE_BLANK": "CONCISE_COMPLETION",
    "ASSESSMENT_GENERATION": "ASSESSMENT_GENERATION",
}
ADVANCED = r"\b(?:evaluate|justify|analyse|complexity|recursive|normal form)\b"
BEGINNER = r"^\s*(?:state|define|identify|name|what is)\b"
VARIANT_STOP = r"\b(?:answer|question|marks?|explain|state|give|write|show your working)\b"
VARIANT_SUFFIX = {
    "SQL": "SQL syntax example database",
    "PROGRAMMING": "algorithm pseudocode worked example",
    "DEBUGGING": "program error correction explanation",
    "TRACE_TABLE": "algorithm trace variable values",
    "MCQ": "definition concept evidence",
    "COMPARISON": "similarities differences advantages disadvantages",
}
CORRECTIVE_STOP = r"\b(?:please|could you|explain|describe|write|answer|question)\b"
CORRECTIVE_SUFFIX = {
    "PROGRAMMING": "algorithm prerequisite steps pseudocode",
    "SQL": "SQL syntax SELECT FROM WHERE example",
    "COMPARISON": "definition differences advantages disadvantages",
    "CALCULATION": "method formula worked example",
}
CORRECTIVE_DEFAULT = "definition explanation"


# The plan of each category.  Columns: category, strategy, context chunks, context characters,
# preferred document types, several query variants, dense depth, sparse depth, fused candidates, reranked.
PLAN_TABLE = """
ASSESSMENT_GENERATION  assessment_grounding     12  20000  TEXTBOOK,SYLLABUS,QUESTION_PAPER,MARK_SCHEME,EXAMINER_REPORT    yes  80  80  24  6
THEORY                 hybrid_conceptual         6  12000  TEXTBOOK,SYLLABUS                                               no   80  80  24  6
DEFINITION             concise_conceptual        5   9000  TEXTBOOK,SYLLABUS                                               no   80  80  24  6
COMPARISON             multi_aspect_comparison   8  15000  TEXTBOOK,SYLLABUS                                               yes  80  80  24  6
PROGRAMMING            code_aware                8  16000  TEXTBOOK,SYLLABUS,QUESTION_PAPER                                yes  80  80  24  6
SQL                    sql_aware                 8  16000  TEXTBOOK,SYLLABUS,QUESTION_PAPER                                yes  80  80  24  6
DEBUGGING              debugging                 8  16000  TEXTBOOK,QUESTION_PAPER,SYLLABUS                                yes  80  80  24  6
TRACE_TABLE            trace_execution           8  16000  QUESTION_PAPER,TEXTBOOK,MARK_SCHEME                             yes  80  80  24  6
CALCULATION            worked_calculation        7  13000  TEXTBOOK,QUESTION_PAPER,MARK_SCHEME                             no   80  80  24  6
MCQ                    mcq_evidence              5   9000  QUESTION_PAPER,MARK_SCHEME,TEXTBOOK,SYLLABUS                    yes  80  80  24  6
FILL_IN_THE_BLANK      concise_completion        5   9000  QUESTION_PAPER,MARK_SCHEME,TEXTBOOK                             no   80  80  24  6
EXAM_QUESTION          exam_authority            8  15000  QUESTION_PAPER,MARK_SCHEME,TEXTBOOK,SYLLABUS,MARKING_PATTERN    no   80  80  24  6
"""
PLAN_SCHEMA = (
    "plan_category string, strategy string, context_chunks int, context_chars int, "
    "preferred_types array<string>, multi_query boolean, dense_k int, sparse_k int, fusion_k int, rerank_k int"
)


def _text_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for pair in values.items() for v in pair])


def _group(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def paper_reference(query: Column | str) -> Column:
    """Struct of subject_code, component, session, year, question_number and marks; later, more
    specific patterns overwrite what the code header gave."""
    q = T._col(query)
    codes = "|".join(sorted(SUBJECT_LEVELS))
    header = (
        rf"(?iU)\b({codes})\s*/?\s*(\d{{2}})?\s*/?\s*(M/J|MJ|F/M|FM|O/N|ON)?\s*/?\s*(20\d{{2}}|\d{{2}})?"
    )
    header_year = _group(q, header, 4)
    full_year = F.when(F.length(header_year) == 2, F.concat(F.lit("20"), header_year)).otherwise(header_year)
    squeeze = lambda c: F.regexp_replace(c, rf"{T.WS}+", "")
    return F.struct(
        _group(q, header, 1).alias("subject_code"),
        F.coalesce(_group(q, r"(?iU)\bpaper\s*(\d)", 1), _group(q, header, 2)).alias("component"),
        F.nullif(F.upper(F.replace(F.regexp_extract(q, header, 3), F.lit("/"), F.lit(""))), F.lit(""))
        .alias("session"),
        F.coalesce(_group(q, r"(?U)\b(20\d{2})\b", 1), full_year).try_cast("int").alias("year"),
        squeeze(_group(q, r"(?iU)(?:question|q\.)\s*(\d+(?:\s*\([a-z0-9]+\))*)", 1)).alias("question_number"),
        _group(q, r"(?iU)\b(\d+)\s*marks?\b", 1).try_cast("int").alias("marks"),
    )


def category_matches(query: Column | str) -> Column:
    """Matched categories in priority order."""
    q = T._col(query)
    hits = [F.when(q.rlike(f"(?iU){pattern}"), F.lit(name)) for name, pattern in CATEGORY_RULES]
    return F.array_compact(F.array(*hits))


def with_profile(queries: DataFrame) -> DataFrame:
    """Add the ``profile`` struct to ``(query, level, exam_year)`` rows.

    The pattern matches are generated first, through an outer explode of one element: the optimizer
    cannot copy them into the many expressions and filters that read the profile.
    """
    base = F.struct(paper_reference("query").alias("ref"), category_matches("query").alias("matches"))
    based = queries.select("*", F.explode_outer(F.array(base)).alias("_base"))
    built = _profile(
        F.col("query"), F.col("_base.ref"), F.col("_base.matches"), F.col("level"), F.col("exam_year").cast("int")
    )
    return based.select("*", F.explode_outer(F.array(built)).alias("profile")).drop("_base")


def _profile(q: Column, ref: Column, matches: Column, level: Column, exam_year: Column) -> Column:
    is_exam = ref["question_number"].isNotNull() & ref["component"].isNotNull()
    category = (
        F.when(is_exam, "EXAM_QUESTION")
        .otherwise(F.coalesce(F.try_element_at(matches, F.lit(1)), F.lit("THEORY")))
    )
    confidence = F.when(is_exam, 0.99).when(F.size(matches) == 0, 0.64).otherwise(F.least(F.lit(0.96), F.lit(0.82)))
    evidence = (
        F.when(is_exam, F.array(F.lit("structured_paper_reference")))
        .when(F.size(matches) == 0, F.array(F.lit("default_conceptual")))
        .otherwise(F.transform(matches, lambda m: F.concat(F.lit("rule:"), F.lower(m))))
    )
    intent = F.when(is_exam, "EXAM_ANSWER").otherwise(
        F.coalesce(F.try_element_at(_text_map(INTENTS), category), F.lit("CONCEPT_EXPLANATION"))
    )
    difficulty = (
        F.when(q.rlike(f"(?iU){ADVANCED}"), "ADVANCED")
        .when(q.rlike(f"(?iU){BEGINNER}"), "BEGINNER")
        .otherwise("INTERMEDIATE")
    )
    objective = (
        F.when(category.isin("COMPARISON", "DEBUGGING", "TRACE_TABLE"), "ANALYSE")
        .when(category.isin("PROGRAMMING", "SQL", "CALCULATION"), "APPLY")
        .otherwise("UNDERSTAND")
    )
    reasoning = category.isin(
        "COMPARISON", "PROGRAMMING", "SQL", "DEBUGGING", "TRACE_TABLE", "CALCULATION", "MCQ"
    )
    return F.struct(
        category.alias("category"),
        intent.alias("intent"),
        difficulty.alias("difficulty"),
        objective.alias("educational_objective"),
        F.lower(category).alias("answer_style"),
        reasoning.alias("needs_reasoning"),
        F.lit(True).alias("needs_citations"),
        category.isin("PROGRAMMING", "SQL", "DEBUGGING").alias("needs_code"),
        confidence.alias("confidence"),
        evidence.alias("evidence"),
        F.coalesce(level, F.try_element_at(_text_map(SUBJECT_LEVELS), ref["subject_code"])).alias("level"),
        exam_year.alias("exam_year"),
        *[ref[name].alias(name) for name in
          ("subject_code", "component", "session", "year", "question_number", "marks")],
    )


def plan_rows() -> list[tuple]:
    """The plan table's rows in the order of ``PLAN_SCHEMA``."""
    fields = [line.split() for line in PLAN_TABLE.strip().splitlines()]
    return [
        (category, strategy, int(chunks), int(chars), types.split(","), several == "yes", *map(int, depths))
        for category, strategy, chunks, chars, types, several, *depths in fields
    ]


def plan_table(spark: SparkSession) -> DataFrame:
    """The category dimension: twelve fixed rows, safe to broadcast."""
    return spark.createDataFrame(plan_rows(), PLAN_SCHEMA)


def deepest(column: str) -> int:
    """The greatest value of a depth column of the plan table."""
    place = [field.split()[0] for field in PLAN_SCHEMA.split(", ")].index(column)
    return max(row[place] for row in plan_rows())


def with_plan(queries: DataFrame, requested_chunks: int | None = None) -> DataFrame:
    """Attach the plan of each query's ``profile`` (unknown categories fall back to THEORY)."""
    known = [row[0] for row in plan_rows()]
    wanted = (
        F.when(F.col("profile.intent") == "EXAM_ANSWER", "EXAM_QUESTION")
        .when(F.col("profile.category").isin(*known), F.col("profile.category"))
        .otherwise("THEORY")
    )
    plans = plan_table(queries.sparkSession)
    out = queries.withColumn("plan_category", wanted).join(F.broadcast(plans), "plan_category")
    if requested_chunks:
        out = out.withColumns({"rerank_k": F.lit(requested_chunks), "context_chunks": F.lit(requested_chunks)})
    return out


def _without(query: Column, pattern: str) -> Column:
    spaced = F.regexp_replace(query, f"(?iU){pattern}", " ")
    single = F.regexp_replace(spaced, rf"{T.WS}+", " ")
    return F.regexp_replace(single, r"^[ .:\-]+|[ .:\-]+\z", "")


def query_variants(query: Column | str, category: Column, multi_query: Column) -> Column:
    """At most two distinct query texts: the question and, when asked for, one rewording."""
    original = T.strip(query)
    bare = _without(T._col(query), VARIANT_STOP)
    suffix = F.try_element_at(_text_map(VARIANT_SUFFIX), category)
    seed = F.when(bare == "", T._col(query)).otherwise(bare)
    second = (
        F.when((bare != "") & (F.lower(bare) != F.lower(original)), bare)
        .when(suffix.isNotNull(), F.concat(seed, F.lit(" "), suffix))
    )
    both = F.array(original, F.when(multi_query, second))
    return F.slice(F.array_distinct(F.filter(both, lambda v: v.isNotNull() & (v != ""))), 1, 2)


def type_priority(document_type: Column, preferred_types: Column) -> Column:
    """High for early preferred types, zero for any other type."""
    position = F.array_position(preferred_types, document_type)
    return F.when(position > 0, F.size(preferred_types) + 1 - position).otherwise(F.lit(0))


def corrective_query(query: Column | str, category: Column) -> Column:
    """The single retry's wording: filler removed, a category-specific suffix added."""
    bare = _without(T._col(query), CORRECTIVE_STOP)
    suffix = F.coalesce(F.try_element_at(_text_map(CORRECTIVE_SUFFIX), category), F.lit(CORRECTIVE_DEFAULT))
    return F.trim(F.concat(bare, F.lit(" "), suffix))
