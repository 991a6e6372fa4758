"""Batch contracts over nested tables.

Every contract adds a struct ``passed, reason, item``: the first rule that failed and, where it is
about one question, that question's number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import rubric as R
from lectern.functions import text as T

# Status domain, provenance rules, request domains, topic stop words.
MEASURABLE = ("REVIEWED", "AUTO_VALIDATED_EXACT", "AUTO_VALIDATED_CURRICULUM")
STATUSES = (*MEASURABLE, "DRAFT", "REJECTED")
EXACT_PROVENANCE = "exact_question_mark_scheme_pair"
CURRICULUM_PROVENANCE = ("curated_question_source_validated", "source_derived_question")
REQUIRED = (
    "id", "question", "category", "difficulty", "expected_intent", "gold_answer", "ground_truth_references",
    "expected_pages", "expected_topics", "expected_citations", "review_status",
)
DIFFICULTIES = ("easy", "medium", "hard", "beginner", "intermediate", "advanced")
QUIZ_TYPES = ("quiz", "assignment")
FORMATS = ("mcq", "short_answer", "long_answer", "mixed")
LEVELS = ("O_LEVEL", "A_LEVEL")
TOPIC_STOP = (
    "explain", "describe", "state", "identify", "write", "give", "answer", "question", "computer", "program", "data",
    "value", "values", "correct", "using", "used", "each", "this", "that", "with", "from", "into", "result", "example",
)
BOOK, PAPER = "TEXTBOOK_CONTENT", "PAST_PAPER_STYLE"


def _blank(c: Column) -> Column:
    return T.strip(F.coalesce(c, F.lit(""))) == ""


def _first(*rules: tuple[Column, str]) -> Column:
    out = F.when(F.coalesce(rules[0][0], F.lit(False)), rules[0][1])
    for broken, reason in rules[1:]:
        out = out.when(F.coalesce(broken, F.lit(False)), reason)
    return out


def outcome(reason: Column, item: Column | None = None) -> Column:
    number = item if item is not None else F.lit(None)
    return F.struct(reason.isNull().alias("passed"), reason.alias("reason"), number.cast("int").alias("item"))


def _first_question(questions: Column, reason_of) -> Column:
    """The first failing question of the list as ``struct<reason, item>``."""
    judged = F.transform(questions, lambda q: F.struct(reason_of(q).alias("reason"), q["number"].alias("item")))
    return F.get(F.filter(judged, lambda r: r["reason"].isNotNull()), F.lit(0))


# --- benchmark records ---------------------------------------------------------------------------------


def benchmark_records(rows: DataFrame) -> DataFrame:
    """Schema, status, text, reference and provenance rules, and ids repeated on a later line.

    ``line_no`` orders the rows.  First lines come from a combined aggregate over ids.
    """
    firsts = rows.groupBy("id").agg(F.min("line_no").alias("_first"))
    measured = F.col("review_status").isin(*MEASURABLE)
    incomplete = F.exists(
        "ground_truth_references",
        lambda s: (F.coalesce(s["document_id"], F.lit("")) == "") | (F.coalesce(s["chunk_id"], F.lit("")) == "") | s["page"].isNull(),
    )
    missing = F.lit(False)
    for name in REQUIRED:
        missing = missing | F.col(name).isNull()
    none = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    exact, curated = F.col("review_status") == "AUTO_VALIDATED_EXACT", F.col("review_status") == "AUTO_VALIDATED_CURRICULUM"
    reason = _first(
        (missing, "MISSING_REQUIRED_FIELDS"),
        (~F.col("review_status").isin(*STATUSES), "INVALID_REVIEW_STATUS"),
        (_blank(F.col("question")) | _blank(F.col("gold_answer")), "EMPTY_QUESTION_OR_ANSWER"),
        (T.has_mojibake(F.concat("question", "gold_answer")), "CORRUPTED_TEXT"),
        (measured & ((F.size("ground_truth_references") == 0) | (F.size("expected_citations") == 0)), "NO_GROUND_TRUTH"),
        (measured & incomplete, "INCOMPLETE_GROUND_TRUTH"),
        (exact & (F.coalesce("generation_provenance", F.lit("")) != EXACT_PROVENANCE), "EXACT_PAIR_PROVENANCE"),
        (exact & (none("question_chunk_id") | none("answer_chunk_id")), "EXACT_PAIR_CHUNKS"),
        (curated & ~F.coalesce("generation_provenance", F.lit("")).isin(*CURRICULUM_PROVENANCE), "CURRICULUM_PROVENANCE"),
        (curated & (F.coalesce(F.size("source_validation_terms"), F.lit(0)) <= 0), "CURRICULUM_TERMS"),
        (F.col("line_no") > F.col("_first"), "DUPLICATE_ID"),
    )
    return rows.join(firsts, "id", "left").withColumn("outcome", outcome(reason)).drop("_first")


def measurable(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("outcome.passed") & F.col("review_status").isin(*MEASURABLE))


# --- model output and answers ------------------------------------------------------------------------------


def model_output(payload: Column, keys: Column) -> Column:
    """Contract of a generated answer: JSON object, text, list of known keys, no key labels inline."""
    data = F.from_json(payload, "answer_markdown string, source_keys array<string>", {"mode": "PERMISSIVE"})
    answer = T.strip(data["answer_markdown"])
    is_list = F.startswith(F.coalesce(F.get_json_object(payload, "$.source_keys"), F.lit("")), F.lit("["))
    is_text = F.get_json_object(payload, "$.answer_markdown").isNotNull()
    reason = _first(
        (data.isNull() | ~is_text | data["answer_markdown"].isNull(), "NOT_THE_ANSWER_CONTRACT"),
        ((answer == "") | ~is_list, "EMPTY_ANSWER_OR_INVALID_KEYS"),
        (F.exists(keys, lambda k: F.contains(answer, F.concat(F.lit("["), k, F.lit("]")))), "INLINE_SOURCE_LABEL"),
        (F.exists(data["source_keys"], lambda k: ~F.array_contains(keys, k)), "UNKNOWN_SOURCE_KEY"),
    )
    return outcome(reason)


def response(answer: Column, sufficient: Column, completed: Column, citations: Column, retrieved: Column, needs_citations: Column) -> Column:
    """Verification ladder: context, completion, text, citation identity, citation presence."""
    identity = lambda page: lambda x: F.struct(
        x["document_id"].alias("d"), x[page].alias("p"), x["chunk_id"].alias("c")
    )
    unknown = F.array_except(F.transform(citations, identity("page")), F.transform(retrieved, identity("page_start")))
    reason = _first(
        (~sufficient, "MISSING_CONTEXT"),
        (~completed, "GENERATION_NOT_COMPLETED"),
        (_blank(answer), "EMPTY_ANSWER"),
        (F.size(unknown) > 0, "INVALID_CITATION_IDENTITY"),
        (needs_citations & (F.size(citations) == 0), "MISSING_CITATIONS"),
    )
    return outcome(reason)


# --- assessments -------------------------------------------------------------------------------------------


def owned_question(question: Column, slot: Column, structure: Column, keys: Column) -> Column:
    """System-owned fields of a generated question: known slot and keys, four-option MCQ."""
    options = F.coalesce(question["options"], F.array().cast("array<string>"))
    bad_choice = (structure["question_type"] == "MCQ") & (
        (F.size(options) != 4) | ~F.array_contains(options, question["correct_option"])
    )
    reason = _first(
        (slot.isNull(), "UNKNOWN_QUESTION_NUMBER"),
        (F.exists(slot["source_keys"], lambda k: ~F.array_contains(keys, k)), "UNKNOWN_EVIDENCE"),
        (bad_choice, "INVALID_ONE_MARK_MCQ"),
    )
    return outcome(reason, question["number"])


def apply_slot(question: Column, slot: Column, structure: Column) -> Column:
    """The question with its lane, topics, type, marks and coding flag taken from the plan."""
    is_choice = structure["question_type"] == "MCQ"
    has = structure.isNotNull()
    empty = F.array().cast("array<string>")
    return F.struct(
        question["number"].alias("number"), question["question"].alias("question"),
        F.when(has, structure["question_type"]).otherwise(question["question_type"]).alias("question_type"),
        F.when(has & ~is_choice, empty).otherwise(question["options"]).alias("options"),
        F.when(has & ~is_choice, "").otherwise(question["correct_option"]).alias("correct_option"),
        F.when(has, structure["marks"]).otherwise(question["marks"]).alias("marks"),
        question["model_answer"].alias("model_answer"), question["rubric"].alias("rubric"),
        slot["content_source"].alias("content_source"), slot["topic_ids"].alias("topic_ids"),
        F.when(has, structure["requires_coding"]).otherwise(question["requires_coding"]).alias("requires_coding"),
    )


def role_pairing(content_source: Column, roles: Column) -> Column:
    """Textbook questions cite textbook evidence only; paper questions need both kinds."""
    allowed = F.when(content_source == "TEXTBOOK", F.array(F.lit(BOOK))).otherwise(F.array(F.lit(BOOK), F.lit(PAPER)))
    both = F.array_contains(roles, BOOK) & F.array_contains(roles, PAPER)
    broken = (F.size(F.array_except(roles, allowed)) > 0) | ((content_source == "PAST_PAPER") & ~both)
    return outcome(_first((broken, "MISSING_SOURCE_PAIRING")))


def source_distribution(questions: Column, textbook: Column, paper: Column, topic_ids: Column, count: Column) -> Column:
    """Lane counts equal the plan, every slot keeps its lane and topic, and citations match the lane."""
    lane = lambda name: F.size(F.filter(questions, lambda q: q["content_source"] == name))
    n = F.size(topic_ids)

    def judge(q: Column) -> Column:
        even = q["number"] % 2 == 0
        index = (F.floor((q["number"] - 1) / 2) + F.when(even, 1).otherwise(0)) % F.greatest(F.lit(1), n)
        planned = (n > 0) & q["number"].between(F.lit(1), count)
        wanted = F.array(F.get(topic_ids, index.cast("int")))
        lane_name = F.when(even, "PAST_PAPER").otherwise("TEXTBOOK")
        roles = F.array_distinct(F.transform(q["citations"], lambda c: c["source_role"]))
        only_book = (F.size(roles) == 1) & F.array_contains(roles, BOOK)
        return _first(
            (planned & ((q["content_source"] != lane_name) | (q["topic_ids"] != wanted)), "SOURCE_TOPIC_ASSIGNMENT_DRIFT"),
            ((q["content_source"] == "TEXTBOOK") & ~only_book, "INVALID_TEXTBOOK_CITATION_LANE"),
            ((q["content_source"] == "PAST_PAPER") & ~(F.array_contains(roles, BOOK) & F.array_contains(roles, PAPER)),
             "UNSUPPORTED_PAST_PAPER_ADAPTATION"),
        )

    found = _first_question(questions, judge)
    unbalanced = (lane("TEXTBOOK") != textbook) | (lane("PAST_PAPER") != paper)
    return outcome(
        F.when(unbalanced, "UNBALANCED_CONTENT_DISTRIBUTION").otherwise(found["reason"]),
        F.when(~unbalanced, found["item"]),
    )


def marking_quality(questions: Column, assessment_type: Column, allows_code: Column, code_kind: Column, count: Column) -> Column:
    """Rubrics that can support fair marking."""

    def judge(q: Column) -> Column:
        rubric = F.coalesce(q["rubric"], F.array().cast("array<string>"))
        joined = F.lower(F.array_join(rubric, " "))
        choice = F.upper(q["question_type"]) == "MCQ"
        mock = assessment_type == "mock_test"
        coding = mock & allows_code & (q["number"] == count)
        applied = ~mock & R.is_applied(q["question"])
        lacks = lambda dims: F.reduce(
            F.array(*[~R.has_any(joined, terms) for terms, _ in dims]), F.lit(False), lambda a, b: a | b
        )
        short = F.size(rubric) < F.least(q["marks"], F.lit(4))
        return _first(
            ((q["marks"] < 1) | (F.size(rubric) == 0) | (F.coalesce(q["model_answer"], F.lit("")) == ""), "INCOMPLETE_MARKING_KEY"),
            (choice & ((q["marks"] != 1) | (F.size(rubric) != 1)), "INVALID_MCQ_MARKING_PATTERN"),
            (~choice & (F.size(rubric) != q["marks"]), "INSUFFICIENT_RUBRIC_GRANULARITY"),
            (~choice & coding & (code_kind == "SQL") & (short | lacks(R.SQL_DIMENSIONS)), "SQL_RUBRIC_LACKS_QUERY_CRITERIA"),
            (~choice & coding & F.coalesce(code_kind != "SQL", F.lit(True)) & (short | lacks(R.PROGRAMMING_DIMENSIONS)),
             "PROGRAMMING_RUBRIC_LACKS_LOGIC_CRITERIA"),
            (~choice & applied & ~R.has_any(joined, R.APPLIED_TERMS), "APPLIED_ITEM_HAS_GENERIC_RUBRIC"),
        )

    found = _first_question(questions, judge)
    return outcome(found["reason"], found["item"])


def mock_scope(questions: Column, assessment_type: Column, topic_ids: Column, total_marks: Column, allows_code: Column) -> Column:
    """Total marks, question count, mark spread, one-mark MCQ, topic scope, coding and coverage."""
    marks = F.transform(questions, lambda q: F.coalesce(q["marks"], F.lit(0)))
    distinct = F.array_distinct(marks)
    total = F.aggregate(marks, F.lit(0), lambda a, m: a + m)
    coding = lambda q: F.coalesce(q["requires_coding"], F.lit(False)) | R.requires_coding(q["question"])

    def judge(q: Column) -> Column:
        topics = F.coalesce(q["topic_ids"], F.array().cast("array<string>"))
        return _first(
            ((F.size(topics) == 0) | (F.size(F.array_except(topics, topic_ids)) > 0), "MOCK_TEST_SCOPE_DEVIATION"),
            (~allows_code & coding(q), "THEORY_ONLY_MOCK_TEST_CONTAINS_CODING"),
        )

    found = _first_question(questions, judge)
    covered = F.flatten(F.transform(questions, lambda q: F.coalesce(q["topic_ids"], F.array().cast("array<string>"))))
    before = _first(
        (F.size(topic_ids) == 0, "MOCK_TEST_HAS_NO_SELECTED_SYLLABUS_TOPICS"),
        (total != total_marks, "MOCK_TEST_MARK_TOTAL_IS_NOT_25"),
        (F.size(questions) < 7, "MOCK_TEST_REQUIRES_AT_LEAST_SEVEN_QUESTIONS"),
        ((F.size(distinct) < 3) | ~F.exists(distinct, lambda m: m >= 4) | F.exists(distinct, lambda m: m > 6),
         "MOCK_TEST_MARK_DISTRIBUTION_IS_NOT_STRUCTURED"),
        (~F.exists(questions, lambda q: (q["question_type"] == "MCQ") & (q["marks"] == 1)), "MOCK_TEST_REQUIRES_A_ONE_MARK_MCQ"),
    )
    after = _first(
        (allows_code & ~F.exists(questions, coding), "CODING_CAPABLE_MOCK_TEST_REQUIRES_AN_APPLIED_CODING_ITEM"),
        (F.size(F.array_except(topic_ids, covered)) > 0, "MOCK_TEST_DOES_NOT_COVER_ALL_SELECTED_TOPICS"),
    )
    reason = F.when(assessment_type == "mock_test", F.coalesce(before, found["reason"], after))
    return outcome(reason, F.when((assessment_type == "mock_test") & before.isNull(), found["item"]))


def completeness(questions: Column, count: Column, question_format: Column) -> Column:
    """Numbers are exactly 1..count and every question has text, key, rubric, evidence and its format."""

    def valid(q: Column) -> Column:
        filled = ~(F.coalesce(q["question"], F.lit("")) == "") & ~(F.coalesce(q["model_answer"], F.lit("")) == "")
        choice = q["question_type"] == "MCQ"
        options = F.coalesce(q["options"], F.array().cast("array<string>"))
        correct = F.coalesce(q["correct_option"], F.lit(""))
        fits = F.when(choice, (F.size(options) == 4) & F.array_contains(options, correct)).otherwise(
            (F.size(options) == 0) & (correct == "")
        )
        wanted = (question_format == "MIXED") | (question_format == q["question_type"])
        return F.coalesce(
            filled & (F.size(q["rubric"]) > 0) & (F.size(q["citations"]) > 0) & fits & wanted, F.lit(False)
        )

    numbers = F.array_sort(F.array_distinct(F.transform(questions, lambda q: q["number"])))
    exactly = (F.size(questions) == count) & (numbers == F.sequence(F.lit(1), F.greatest(F.lit(1), count)))
    broken = ~(exactly & F.forall(questions, valid))
    return outcome(_first((broken, "QUESTION_CONTRACT_VIOLATION")))


def topic_alignment(text: Column, topic_ids: Column, evidence_text: Column, topics: Column) -> Column:
    """Assigned topics are known and, without evidence, share a phrase or term with the question.

    ``topics``: the plan's topics as ``array<struct<topic_id, phrases>>``.
    """
    lowered = F.lower(text)
    terms = T.long_terms(lowered, TOPIC_STOP)

    def aligned(topic_id: Column) -> Column:
        def fits(topic: Column) -> Column:
            phrases = topic["phrases"]
            own = F.array_except(
                F.filter(F.flatten(F.transform(phrases, T.tokens)), lambda t: F.length(t) > 2),
                F.array(*[F.lit(s) for s in TOPIC_STOP]),
            )
            exact = F.exists(phrases, lambda p: (F.length(p) > 2) & F.contains(lowered, F.lower(p)))
            return exact | (T.overlap(own, terms) >= 1)

        return F.exists(topics, lambda t: (t["topic_id"] == topic_id) & fits(t))

    known = F.forall(topic_ids, lambda i: F.exists(topics, lambda t: t["topic_id"] == i))
    reason = _first(
        ((F.size(topic_ids) > 0) & ~known, "UNKNOWN_TOPIC"),
        ((F.size(topic_ids) > 0) & _blank(evidence_text) & ~F.forall(topic_ids, aligned), "TOPIC_DRIFT"),
    )
    return outcome(reason)


def compiled_rubric(question: Column, structure: Column) -> Column:
    """One criterion per mark; the coding slot gets its four dimensions."""
    marks = F.coalesce(structure["marks"], question["marks"])
    atomic = R.atomic_rubric(
        question["question_type"], marks, question["rubric"], question["correct_option"], question["model_answer"]
    )
    coding = F.coalesce(structure["requires_coding"], F.lit(False))
    return F.when(coding, T.let(atomic, lambda r: R.coding_rubric(r, structure["coding_kind"]))).otherwise(atomic)


def combined(distribution: Column, marking: Column, scope: Column, complete: Column) -> Column:
    """The four assessment contracts in order; the first failure decides."""
    pick = lambda name: F.coalesce(*[F.when(~c["passed"], c[name]) for c in (distribution, marking, scope, complete)])
    provider = (
        F.when(~distribution["passed"], "distribution_validator").when(~marking["passed"], "marking_quality_validator")
        .when(~scope["passed"], "mock_test_scope_validator").otherwise("deterministic")
    )
    reason = pick("reason")
    return F.struct(reason.isNull().alias("passed"), reason.alias("reason"), pick("item").alias("item"), provider.alias("provider"))


# --- requests ------------------------------------------------------------------------------------------------


def assessment_request(topic: Column, difficulty: Column, kind: Column, count: Column, question_format: Column) -> Column:
    return outcome(_first(
        (~F.length(F.coalesce(topic, F.lit(""))).between(2, 200), "TOPIC_LENGTH"),
        (~F.coalesce(difficulty.isin(*DIFFICULTIES), F.lit(False)), "DIFFICULTY"),
        (~F.coalesce(kind.isin(*QUIZ_TYPES), F.lit(False)), "ASSESSMENT_TYPE"),
        (~F.coalesce(count.between(1, 20), F.lit(False)), "QUESTION_COUNT"),
        (~F.coalesce(question_format.isin(*FORMATS), F.lit(False)), "QUESTION_FORMAT"),
    ))


def mock_request(level: Column, chapter_ids: Column, topic_ids: Column, difficulty: Column) -> Column:
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return outcome(_first(
        (~F.coalesce(level.isin(*LEVELS), F.lit(False)), "LEVEL"),
        (~size(chapter_ids).between(1, 8), "CHAPTERS"),
        (~size(topic_ids).between(1, 8), "TOPICS"),
        (~F.coalesce(difficulty.isin(*DIFFICULTIES), F.lit(False)), "DIFFICULTY"),
    ))


def submission_request(answer: Column) -> Column:
    return outcome(_first((~F.length(F.coalesce(answer, F.lit(""))).between(1, 50_000), "ANSWER_LENGTH")))


def review_request(score: Column, comments: Column) -> Column:
    return outcome(_first(
        (F.coalesce(score < 0, F.lit(True)), "SCORE"), (F.length(F.coalesce(comments, F.lit(""))) > 5_000, "COMMENT_LENGTH")
    ))
