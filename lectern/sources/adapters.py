"""The test tables read as engine tables.

Each adapter derives identity columns from the key of the given table and keeps every row and the
whole text.  ``lectern.plans.sql`` holds the same mappings as SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions import understanding as U
from lectern.operators import chunking
from lectern.sources.schemas import AUTHORITY

TYPES = ("TEXTBOOK", "SYLLABUS", "QUESTION_PAPER", "MARK_SCHEME", "EXAMINER_REPORT")
PREFIXES = ("tb", "sy", "qp", "ms", "er")
SESSIONS = ("MJ", "FM", "ON")
CHUNK_WINDOW = (120, 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores when a table is a single small file; a scan with enough splits is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _div(column: str, n: int) -> Column:
    return F.floor(F.col(column) / F.lit(n)).cast("bigint")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-page documents of the five types; 25 consecutive source rows make five documents."""
    src = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    kind, shelf = F.col("doc_id") % 5, _div("doc_id", 25)
    return src.select(
        F.concat(_pick(PREFIXES, kind), F.lit("_"), shelf.cast("string")).alias("document_id"),
        (F.floor((F.col("doc_id") % 25) / 5) + 1).cast("int").alias("page_number"),
        _pick(TYPES, kind).alias("document_type"),
        F.when(shelf % 2 == 0, "O_LEVEL").otherwise("A_LEVEL").alias("level"),
        F.when(shelf % 2 == 0, "2210").otherwise("9618").alias("subject_code"),
        (2015 + shelf % 10).cast("int").alias("year"),
        _pick(SESSIONS, shelf % 3).alias("session"),
        (11 + shelf % 3).cast("string").alias("component"),
        _pick(tuple(str(AUTHORITY[t]) for t in TYPES), kind).cast("int").alias("authority_level"),
        (shelf * 5 + kind).alias("ord"),
        F.col("text").alias("raw_text"),
        T.clean_text("text").alias("clean_text"),
        T.contains_code(T.clean_text("text")).alias("contains_code"),
        T.contains_table(T.clean_text("text")).alias("contains_table"),
        "doc_id",
        "lang",
    )


def chunks(spark: SparkSession, sf_dir: str, flags: bool = False) -> DataFrame:
    """Parents and word-window children of every page, whatever its type; papers and schemes get a
    question label from page and window position.  ``flags`` adds those of the page, which few readers need."""
    rows = pages(spark, sf_dir).drop("contains_code", "contains_table")
    if flags:  # behind an outer explode, so that the text is cleaned once
        rows = rows.withColumn("clean_text", F.explode_outer(F.array("clean_text"))).withColumns(
            {"contains_code": T.contains_code("clean_text"), "contains_table": T.contains_table("clean_text")})
    built = chunking.textbook(rows, CHUNK_WINDOW)
    is_paper = F.col("document_type").isin("QUESTION_PAPER", "MARK_SCHEME") & F.col("parent_chunk_id").isNotNull()
    letter = F.char(97 + F.col("ord") % 3)
    return built.withColumn(
        "question_number",
        F.when(is_paper, F.concat(F.col("page_start").cast("string"), F.lit("("), letter, F.lit(")"))),
    )


def search_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.indexable(chunks(spark, sf_dir))


def question_text(item: Column, text: Column) -> Column:
    """A question built from the whole benchmark passage, in one of six forms by item id; the fifth
    form names a paper and question label that exist in the adapted pages."""
    parts = T.words(text)
    half = F.greatest(F.lit(1), F.floor(F.size(parts) / 2).cast("int"))
    first = F.array_join(F.slice(parts, 1, half), " ")
    second = F.array_join(F.slice(parts, half + 1, F.greatest(F.size(parts) - half, F.lit(0))), " ")
    both = F.concat(first, F.lit(" "), second)
    paper = F.concat(
        F.when(item % 2 == 0, "2210").otherwise("9618"), F.lit("/"), (11 + item % 3).cast("string"), F.lit("/"),
        _pick(("M/J", "F/M", "O/N"), item % 3), F.lit("/"), (15 + item % 10).cast("string"),
        F.lit(" Question "), (1 + item % 5).cast("string"), F.lit(" "),
    )
    forms = F.array(
        F.concat(F.lit("Compare "), first, F.lit(" and "), second),
        F.concat(F.lit("What is "), both),
        F.concat(F.lit("Explain the algorithm "), both),
        F.concat(F.lit("Write an SQL query for "), both),
        F.concat(F.lit("Answer "), paper, both),
        both,
    )
    return F.element_at(forms, (item % 6 + 1).cast("int"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per benchmark item: a question wrapped around its passage."""
    src = table(spark, sf_dir, "benchmark")
    item = F.col("item_id")
    return src.select(
        F.concat(F.lit("q"), item.cast("string")).alias("query_id"),
        question_text(item, F.col("text")).alias("query"),
        F.when(item % 3 == 0, F.lit("O_LEVEL")).alias("level"),
        F.lit(None).cast("int").alias("exam_year"),
        F.lit(None).cast("string").alias("document_type"),
        "item_id",
        F.col("text").alias("passage"),
    )


def profiled(queries: DataFrame) -> DataFrame:
    """Queries with their profile struct and plan columns."""
    return U.with_plan(U.with_profile(queries))


#: Consecutive conversations of one folded dialogue, and positions kept for the turns of a conversation.
DIALOGUE, TURNS = 40, 1_000_000


def dialogue(conv_id: str) -> Column:
    """Key of the long dialogue that a conversation is folded into."""
    return F.floor(F.col(conv_id) / DIALOGUE).cast("string")


def turn_position(conv_id: str, turn: str) -> Column:
    """Position of a turn in its dialogue; a conversation of more turns than there are places is refused."""
    fits = F.assert_true(F.col(turn).between(0, TURNS - 1), "a conversation has too many turns")
    return F.coalesce(fits.cast("bigint"), F.col(conv_id) * TURNS + F.col(turn))


def exchanges(spark: SparkSession, sf_dir: str, folded: bool = False) -> DataFrame:
    """User turns paired with the assistant turn that follows.

    ``folded`` joins consecutive conversations to long dialogues so that memory eviction is reached;
    without it each conversation is its own dialogue.
    """
    turns = table(spark, sf_dir, "conversations")
    user = turns.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("query"))
    reply = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    key = dialogue("conv_id") if folded else F.col("conv_id").cast("string")
    return user.join(reply, ["conv_id", "turn"]).select(
        key.alias("conversation_id"),
        turn_position("conv_id", "turn").alias("position"),
        "query",
        "answer",
    )


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = table(spark, sf_dir, "events")
    failed = F.col("event_type") == "error"
    tokens = F.get_json_object("props", "$.k").cast("int")
    return src.select(
        F.col("event_id").cast("string").alias("trace_id"),
        F.col("user_id").cast("string").alias("session_id"),
        F.col("ts").alias("created_at"),
        F.col("event_type").alias("category"),
        F.lit("CONCEPT_EXPLANATION").alias("intent"),
        (~failed).alias("success"),
        F.when(failed & (F.col("event_id") % 3 == 0), "MISSING_CONTEXT")
        .when(failed & (F.col("event_id") % 3 == 1), "INVALID_CITATION_IDENTITY")
        .when(failed, "EMPTY_ANSWER").alias("failure_category"),
        F.col("value").alias("latency_ms"),
        tokens.alias("input_tokens"),
        (tokens * 2).alias("output_tokens"),
        (F.col("value") / F.lit(1000.0)).alias("total_cost"),
        (F.col("event_id") % 4 == 0).alias("cache_hit"),
        F.when(F.col("event_id") % 5 == 0, F.lit("{}"))
        .otherwise(F.concat(F.lit('{"model":"m'), (F.col("event_id") % 3).cast("string"), F.lit('"}')))
        .alias("data"),
    )


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as submissions; the ordering customer is the assessment."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("submission_id"),
        F.col("o_custkey").alias("assessment_id"),
        (F.col("o_orderkey") % 977).alias("student_id"),
        F.col("o_orderdate").alias("submitted_at"),
    )


def grade_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as assessments, owned by their nation."""
    status = F.when(F.col("c_custkey") % 3 == 0, "draft").when(F.col("c_custkey") % 3 == 1, "pending_review")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("assessment_id"),
        F.col("c_nationkey").cast("bigint").alias("owner_id"),
        F.col("c_mktsegment").alias("topic"),
        status.otherwise("approved").alias("status"),
    )


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as grades: AI score from the quantity, human score absent for flag N."""
    src = table(spark, sf_dir, "lineitem")
    ai = F.col("l_quantity")
    human = F.least(F.lit(50.0), F.greatest(F.lit(0.0), ai + F.col("l_linenumber") - 4))
    return src.select(
        F.concat_ws(
            "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("bigint")
        ).alias("grade_id"),
        F.col("l_orderkey").alias("submission_id"),
        ai.alias("ai_score"),
        F.when(F.col("l_returnflag") != "N", human).alias("human_score"),
        F.lit(50.0).alias("max_score"),
        F.col("l_linestatus").alias("comments"),
        F.col("l_discount").alias("confidence_score"),
    )
