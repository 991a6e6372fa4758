"""Submissions, grades, reviews and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.sources.schemas import require_columns

ANSWER_LABEL = r"(?iU)(?:^|\n)\s*(?:q(?:uestion)?|answer)\s*(\d+)\s*[:.)-]?"
MARK = "\x1e"
OFFICIAL_TYPES = ("MARK_SCHEME", "EXAMINER_REPORT", "QUESTION_PAPER")


def extract_answers(answer: Column, numbers: Column) -> Column:
    """``map<int, string>`` of labelled answers; unknown numbers are skipped, the last label of a number
    wins, and an unlabelled text belongs to the first question."""
    marked = F.regexp_replace(answer, ANSWER_LABEL, f"{MARK}$1{MARK}")
    parts = F.split(marked, MARK)
    first = F.when(
        F.size(numbers) > 0, F.map_from_arrays(F.array(F.get(numbers, F.lit(0))), F.array(T.strip(answer)))
    ).otherwise(F.create_map().cast("map<int, string>"))

    def labelled(pieces: Column) -> Column:
        count = F.floor((F.size(pieces) - 1) / 2).cast("int")
        pairs = F.transform(
            F.sequence(F.lit(1), count),
            lambda i: F.struct(
                F.get(pieces, i * 2 - 1).try_cast("int").alias("number"), T.strip(F.get(pieces, i * 2)).alias("text"), i.alias("i")
            ),
        )
        known = F.filter(pairs, lambda p: F.array_contains(numbers, p["number"]))
        last = F.filter(
            known, lambda p: ~F.exists(known, lambda q: (q["number"] == p["number"]) & (q["i"] > p["i"]))
        )
        return F.map_from_entries(F.transform(last, lambda p: F.struct(p["number"], p["text"])))

    return F.when(answer.rlike(ANSWER_LABEL), T.let(parts, labelled)).otherwise(first)


def align(submissions: DataFrame, assessments: DataFrame) -> DataFrame:
    """One row per submission and question with the student's answer, '' when missing."""
    questions = assessments.select("assessment_id", "questions")
    joined = submissions.select("submission_id", "assessment_id", "answer_text").join(questions, "assessment_id")
    number = F.coalesce(F.col("q.number"), F.col("pos") + 1)
    numbered = joined.withColumn(
        "_answers",
        extract_answers(F.col("answer_text"), F.transform("questions", lambda q, i: F.coalesce(q["number"], i + 1))),
    )
    rows = numbered.select("submission_id", "assessment_id", "_answers", F.posexplode_outer("questions").alias("pos", "q"))
    return rows.filter(F.col("pos").isNotNull()).select(
        "submission_id", "assessment_id", number.alias("number"),
        F.coalesce(F.try_element_at("_answers", number), F.lit("")).alias("student_answer"),
        "q.question", "q.model_answer", "q.rubric", "q.marks", "q.citations",
    )


def listing(grades: DataFrame, submissions: DataFrame, assessments: DataFrame) -> DataFrame:
    """Grades with their submission and owner; ``pending`` marks grades without a human score.

    Sort or filter by owner, student and ``submitted_at``; both joins are on unique right-hand keys.
    """
    s = submissions.select("submission_id", "assessment_id", "student_id", "submitted_at")
    a = assessments.select("assessment_id", "owner_id")
    return (
        grades.join(s, "submission_id").join(a, "assessment_id").withColumn("pending", F.col("human_score").isNull())
    )


def newest_first(rows: DataFrame, limit: int, keys: list[str], order: str, tie: str) -> DataFrame:
    """The newest ``limit`` rows per key, e.g. a teacher's or student's page of grades or assessments."""
    window = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc(tie))
    return rows.withColumn("place", F.row_number().over(window)).filter(F.col("place") <= limit)


def list_assessments(assessments: DataFrame, owner_id: int | None = None, approved_only: bool = False) -> DataFrame:
    out = assessments if owner_id is None else assessments.filter(F.col("owner_id") == owner_id)
    out = out.filter(F.col("status") == "approved") if approved_only else out
    return out.orderBy(F.desc("created_at"))


def deletable_drafts(assessments: DataFrame, submissions: DataFrame) -> DataFrame:
    """Unapproved assessments nobody has submitted to."""
    open_drafts = assessments.filter(F.col("status").isin("draft", "pending_review"))
    return open_drafts.join(submissions.select("assessment_id"), "assessment_id", "left_anti")


def approvals(requests: DataFrame, assessments: DataFrame) -> DataFrame:
    """Approval requests ``(assessment_id, owner_id)``: accepted only for the owner."""
    owned = assessments.select("assessment_id", F.col("owner_id").alias("_owner"))
    return requests.join(owned, "assessment_id", "left").select(
        *requests.columns, F.coalesce(F.col("owner_id") == F.col("_owner"), F.lit(False)).alias("accepted")
    )


def submittable(requests: DataFrame, assessments: DataFrame) -> DataFrame:
    """Submission requests: accepted only for approved assessments."""
    state = assessments.select("assessment_id", F.col("status").alias("_status"))
    return requests.join(state, "assessment_id", "left").select(
        *requests.columns, F.coalesce(F.col("_status") == "approved", F.lit(False)).alias("accepted")
    )


def apply_reviews(grades: DataFrame, reviews: DataFrame, submissions: DataFrame, assessments: DataFrame) -> DataFrame:
    """Reviews with their outcome: accepted for the owner inside ``0..max_score``; the AI score stays
    and a missing comment falls back to the old one."""
    owner = (
        grades.select("grade_id", "submission_id", "ai_score", "max_score", F.col("comments").alias("_old"))
        .join(submissions.select("submission_id", "assessment_id"), "submission_id")
        .join(assessments.select("assessment_id", "owner_id"), "assessment_id")
    )
    joined = reviews.join(owner, "grade_id", "left")
    ok = F.coalesce(
        (F.col("owner_id") == F.col("reviewer_id")) & F.col("human_score").between(F.lit(0.0), F.col("max_score")), F.lit(False)
    )
    return joined.select(
        "grade_id", "reviewer_id", "ai_score",
        F.when(ok, F.col("human_score")).alias("human_score"),
        F.when(ok, F.coalesce("comments", "_old")).otherwise(F.col("_old")).alias("comments"),
        ok.alias("accepted"),
    )


def agreement(pairs: DataFrame) -> DataFrame:
    """Pair count, mean absolute error and Pearson correlation (null without variance)."""
    both = pairs.filter(F.col("ai_score").isNotNull() & F.col("human_score").isNotNull())
    spread = F.stddev_pop("ai_score") * F.stddev_pop("human_score")
    return both.agg(
        F.count("*").alias("count"),
        F.round(F.avg(F.abs(F.col("ai_score") - F.col("human_score"))), 4).alias("mae"),
        F.round(F.covar_pop("ai_score", "human_score") / F.nullif(spread, F.lit(0.0)), 4).alias("pearson_correlation"),
    )


def score_file_quality(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(counts, invalid lines)`` of a score table with text columns and a ``line_no``."""
    require_columns(rows, ("ai_score", "human_score", "line_no"))
    ok = F.col("ai_score").try_cast("double").isNotNull() & F.col("human_score").try_cast("double").isNotNull()
    counts = rows.agg(F.count("*").alias("total_rows"), F.count_if(ok).alias("valid_rows"))
    return counts, rows.filter(~ok).select("line_no")


def role_counts(users: DataFrame, assessments: DataFrame, grades: DataFrame) -> DataFrame:
    """One row of dashboard counters."""
    one = lambda df: df.withColumn("_one", F.lit(1))
    people = users.agg(
        F.count_if(F.col("role") == "teacher").alias("teachers"), F.count_if(F.col("role") == "student").alias("students")
    )
    waiting = assessments.agg(F.count_if(F.col("status") == "pending_review").alias("pending_assessments"))
    open_grades = grades.agg(F.count_if(F.col("human_score").isNull()).alias("pending_grade_reviews"))
    return one(people).join(one(waiting), "_one").join(one(open_grades), "_one").drop("_one")


def draft_bounds(items: DataFrame, drafts: DataFrame) -> DataFrame:
    """Grade drafts whose item scores and total lie within the question marks.

    ``items``: draft_id, number, score, marks (null for an unknown question).  ``drafts``: draft_id,
    total_score.
    """
    checked = items.groupBy("draft_id").agg(
        F.bool_and(F.coalesce(F.col("score").between(F.lit(0), F.col("marks")), F.lit(False))).alias("_items"),
        F.sum("marks").alias("max_score"),
    )
    inside = F.col("_items") & F.col("total_score").between(F.lit(0), F.col("max_score"))
    return drafts.join(checked, "draft_id", "left").select(
        "draft_id", "total_score", "max_score",
        F.when(F.coalesce(inside, F.lit(False)), "PENDING_TEACHER_REVIEW").otherwise("INVALID_GENERATION").alias("status"),
    )


def grading_queries(aligned: DataFrame) -> DataFrame:
    """Retrieval queries for supplementary marking evidence, one per submission question."""
    return aligned.select(
        F.concat_ws("#", F.col("submission_id").cast("string"), F.col("number").cast("string")).alias("query_id"),
        F.concat(F.col("question"), F.lit(" mark scheme examiner report marking guidance")).alias("query"),
    )


def official_only(context_rows: DataFrame) -> DataFrame:
    return context_rows.filter(F.col("document_type").isin(*OFFICIAL_TYPES))
