"""Rubric fragments, criteria and question-text detectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import text as T

# Split pattern, fallback criteria, marking dimensions, detectors, guarded claims.
FRAGMENT_SPLIT = r"(?iU)\s*(?:;|\n|(?=\b(?:award\s+)?1\s+mark\b)|(?<=\.)\s+)\s*"
MARK_PREFIX = r"(?iU)^(?:award\s+)?\d+\s+marks?\s*(?:for|:)?\s*"
FALLBACKS = (
    "an accurate core statement that answers the command word",
    "a relevant supporting explanation linked to the stated problem",
    "a correct application or intermediate step",
    "a complete result, consequence, or conclusion",
    "an additional relevant detail consistent with the model answer",
    "a second valid supporting detail consistent with the model answer",
)
PROGRAMMING_DIMENSIONS = (
    (("logic", "algorithm"), "1 mark for correct algorithm logic appropriate to the stated task."),
    (("condition", "comparison", "selection"), "1 mark for a correct condition or comparison."),
    (("loop", "iteration", "midpoint", "bounds", "index", "update", "search", "sort", "progression"),
     "1 mark for correct loop/iteration or progression through the data."),
    (("output", "termination", "stop", "not found", "result"), "1 mark for correct output and termination behaviour."),
)
SQL_DIMENSIONS = (
    (("select", "field", "column"), "1 mark for selecting the correct field(s)."),
    (("from", "table"), "1 mark for using the correct table in the FROM clause."),
    (("where", "condition", "criteria", "filter"), "1 mark for the correct WHERE condition or filtering criterion."),
    (("order", "aggregate", "count", "sum", "output", "result"),
     "1 mark for the correct ordering, aggregate, or resulting output required by the task."),
)
CODING_TASK = (
    r"\b(?:write|produce|develop|construct|design|amend|correct|debug|implement)\b[^\n]{0,100}"
    r"\b(?:pseudocode|program(?:\s+code)?|algorithm|sql(?:\s+query|\s+statement)?|query)\b",
    r"\b(?:complete|draw|construct|produce|create)\b[^\n]{0,70}\btrace\s+table\b",
    r"\bwrite\s+(?:an?\s+)?(?:sql\s+)?query\b",
    r"\b(?:write|produce|implement)\b[^\n]{0,60}\b(?:python|java|visual\s+basic)\b",
)
APPLIED_TASK = (
    r"\b(?:write|produce|develop|construct|design|amend|correct|debug)\b[^\n]{0,70}"
    r"\b(?:pseudocode|program(?:\s+code)?|algorithm|sql(?:\s+query|\s+statement)?|query)\b",
    r"\b(?:complete|draw|construct|produce)\b[^\n]{0,50}\btrace\s+table\b",
    r"\bwrite\s+(?:an?\s+)?(?:sql\s+)?query\b",
)
APPLIED_TERMS = ("logic", "algorithm", "sql", "query", "condition", "output", "result")
COMPLEXITY_CLAIMS = ("time complexity", "o(n", "quadratic complexity")


def has_any(text: Column, phrases: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(text, p))


def matches_any(text: Column, patterns: tuple[str, ...]) -> Column:
    return text.rlike("(?iU)" + "|".join(f"(?:{p})" for p in patterns))


def requires_coding(question: Column) -> Column:
    """Whether the learner is told to produce code, a query or a trace table."""
    return matches_any(F.regexp_replace(F.lower(question), rf"{T.WS}+", " "), CODING_TASK)


def is_applied(question: Column) -> Column:
    return matches_any(F.lower(question), APPLIED_TASK)


def unsupported_claim(question: Column, model_answer: Column, source: Column) -> Column:
    """Reason code when complexity terms appear that the source never uses."""
    said = F.lower(F.concat_ws(" ", question, model_answer))
    return F.when(has_any(said, COMPLEXITY_CLAIMS) & ~has_any(F.lower(source), COMPLEXITY_CLAIMS), "BIG_O_NOT_IN_SOURCE")


def fragments(value: Column) -> Column:
    """Separate marking points of a compressed rubric or answer."""
    parts = F.split(T.collapse(F.coalesce(value, F.lit(""))), FRAGMENT_SPLIT)
    return F.filter(F.transform(parts, lambda p: F.btrim(p, F.lit(" -.,"))), lambda p: F.length(p) >= 8)


def criterion(value: Column) -> Column:
    """One point as an explicit one-mark criterion, '' when nothing is left."""
    bare = F.btrim(F.regexp_replace(T.strip(value), MARK_PREFIX, ""), F.lit(" ."))
    return F.when(bare == "", "").otherwise(F.concat(F.lit("1 mark for "), bare, F.lit(".")))


def _distinct_criteria(candidates: Column, marks: Column) -> Column:
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, raw: Column) -> Column:
        def add(text: Column) -> Column:
            identity = F.regexp_replace(F.lower(text), r"(?U)\W+", "")
            grown = F.struct(
                F.concat(state["seen"], F.array(identity)).alias("seen"), F.concat(state["out"], F.array(text)).alias("out")
            )
            return F.when((text == "") | F.array_contains(state["seen"], identity), state).otherwise(grown)

        return T.let(criterion(raw), add)

    return F.slice(F.aggregate(candidates, start, step, lambda s: s["out"]), 1, marks)


def atomic_rubric(question_type: Column, marks: Column, rubric: Column, correct_option: Column, model_answer: Column) -> Column:
    """Exactly one distinct criterion per mark: the rubric's points, then the answer's, then fallbacks."""
    option = F.coalesce(T.non_blank(correct_option), T.non_blank(model_answer), F.lit("the correct option"))
    choice = F.array(F.concat(F.lit("1 mark for selecting "), F.rtrim(T.strip(option), F.lit(".")), F.lit(".")))
    own = F.flatten(F.transform(F.coalesce(rubric, F.array().cast("array<string>")), fragments))
    derived = F.transform(fragments(model_answer), lambda p: F.concat(F.lit("stating this model-answer point: "), p))
    candidates = F.concat(own, derived, F.array(*[F.lit(f) for f in FALLBACKS]))
    return (
        F.when(marks < 1, rubric)
        .when(question_type == "MCQ", choice)
        .otherwise(_distinct_criteria(candidates, F.greatest(marks, F.lit(1))))
    )


def coding_rubric(rubric: Column, coding_kind: Column) -> Column:
    """Four marking dimensions of the coding item: the first unused matching criterion, else a default."""

    def choose(dimensions: tuple) -> Column:
        def walk(state: Column, index: int) -> Column:
            terms, fallback = dimensions[index]

            def pick(current: Column) -> Column:
                fits = F.filter(
                    F.transform(rubric, lambda c, i: F.struct(i.alias("i"), c.alias("c"))),
                    lambda r: ~F.array_contains(current["used"], r["i"]) & has_any(F.lower(r["c"]), terms),
                )
                first = F.get(fits, F.lit(0))
                return F.struct(
                    F.concat(current["used"], F.array(F.coalesce(first["i"], F.lit(-1)))).alias("used"),
                    F.concat(current["out"], F.array(F.coalesce(first["c"], F.lit(fallback)))).alias("out"),
                )

            return T.let(state, pick)

        state = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<string>").alias("out"))
        for index in range(len(dimensions)):
            state = walk(state, index)
        return state["out"]

    return F.when(coding_kind == "SQL", choose(SQL_DIMENSIONS)).otherwise(choose(PROGRAMMING_DIMENSIONS))
