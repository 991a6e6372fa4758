"""Queries of single operators over the given tables: answers, citations, slots, phrases, user functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import hashing as H
from lectern.functions import text as T
from lectern.operators import answers, contracts, evidence, grading, search
from lectern.operators import index as indexing
from lectern.plans import sql as Q
from lectern.plans.records_queries import rounded
from lectern.plans.registry import query
from lectern.sources import adapters as A

big = lambda name: F.col(name).cast("bigint").alias(name)
text_of = lambda prefix, name: F.concat(F.lit(prefix), F.col(name).cast("string"))


@query("style_patterns", f"""
WITH f AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN n_chars % 7 END AS marks,
  array_to_string(list_filter({list(evidence.COMMANDS)}, lambda c: regexp_matches(lower(text), '(?:^|{Q.EDGE})' || c || '(?:{Q.EDGE}|$)')), ', ') AS found FROM documents)
SELECT doc_id, '{evidence.STYLE_PATTERN}' || coalesce(nullif(found, ''), '{evidence.STYLE_NO_COMMAND}') || '{evidence.STYLE_MARKS}'
  || CASE WHEN marks > 0 THEN CAST(marks AS VARCHAR) ELSE '{evidence.STYLE_NO_MARKS}' END || '{evidence.STYLE_END}' AS pattern FROM f""")
def style_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of every document as a question-style example."""
    docs = A.spread(A.table(spark, sf, "documents").select("doc_id", "text", "n_chars"))
    marks = F.when(F.col("doc_id") % 3 != 0, F.col("n_chars") % 7)
    return docs.select("doc_id", evidence.style_projection(F.coalesce("text", F.lit("")), marks).alias("pattern"))


@query("invalid_citations", """
SELECT CAST(l_orderkey AS VARCHAR) AS query_id, 'p' || l_partkey AS document_id, CAST(l_linenumber AS BIGINT) AS page, 's' || l_suppkey AS chunk_id
FROM lineitem c WHERE l_returnflag = 'R' AND NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_quantity >= 10 AND r.l_orderkey = c.l_orderkey
  AND r.l_partkey = c.l_partkey AND r.l_linenumber = c.l_linenumber AND r.l_suppkey = c.l_suppkey)""")
def invalid_citations(spark: SparkSession, sf: str) -> DataFrame:
    """Returned lines as citations of orders whose lines of ten and more were retrieved."""
    rows = A.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("query_id"), text_of("p", "l_partkey").alias("document_id"),
        F.col("l_linenumber").alias("page"), text_of("s", "l_suppkey").alias("chunk_id"), "l_quantity", "l_returnflag")
    cited = rows.filter("l_returnflag = 'R'").select("query_id", "document_id", "page", "chunk_id")
    seen = rows.filter("l_quantity >= 10").withColumnRenamed("page", "page_start")
    return answers.invalid_citations(cited, seen).select("query_id", "document_id", big("page"), "chunk_id")


@query("source_details", """
SELECT conv_id AS query_id, min(turn) AS position, CASE WHEN role = 'user' THEN role ELSE 'Answers' END AS book_name,
  CASE WHEN length(text) > 80 THEN 'long' END AS chapter, CASE WHEN length(text) > 80 THEN 'long' ELSE role END AS topic,
  role AS source_document, md5(text) AS chunk_id FROM conversations GROUP BY conv_id, role, text""")
def source_details(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as retrieved sources; a text that a role repeats in a conversation is one source."""
    long = F.when(F.length("text") > 80, "long")
    rows = A.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("query_id"), F.col("turn").alias("position"), F.col("role").alias("document_id"), F.lit(1).alias("page_start"),
        F.md5("text").alias("chunk_id"), F.when(F.col("role") != "user", "Answers").alias("document_title"), long.alias("section_title"),
        F.col("role").alias("content_type"), F.lit("TEXTBOOK").alias("document_type"))
    return answers.source_details(rows).select("query_id", "position", "book_name", "chapter", "topic", "source_document", "chunk_id")


@query("answer_alignment", """
WITH l AS (SELECT l_orderkey, l_linenumber, 'What is part ' || l_partkey AS question, l_quantity, 'part ' || l_partkey || ' of ' || l_suppkey AS said,
    printf('%03d-%012d-%012d-%09d', l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) % 1000000000) AS place FROM lineitem),
a AS (SELECT l_orderkey, l_linenumber, arg_max(said, place) AS said FROM l WHERE l_quantity > 20 GROUP BY ALL),
f AS (SELECT l_orderkey, min(l_linenumber) AS first, bool_or(l_quantity > 20) AS labelled FROM l GROUP BY 1)
SELECT l_orderkey AS submission_id, CAST(l_linenumber AS BIGINT) AS number, question, l_quantity AS marks,
  CASE WHEN labelled THEN coalesce(a.said, '') WHEN l_linenumber = first THEN 'order ' || l_orderkey || ' without labels' ELSE '' END AS student_answer
FROM l JOIN f USING (l_orderkey) LEFT JOIN a USING (l_orderkey, l_linenumber)""")
def answer_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as papers with a question per line; lines of more than twenty are answered under a label, in one text."""
    place = F.format_string("%03d-%012d-%012d-%09d", "l_linenumber", "l_partkey", "l_suppkey",
                            F.round(F.col("l_extendedprice") * 100).cast("bigint") % 1_000_000_000)
    said = F.when(F.col("l_quantity") > 20, F.concat(
        F.lit("Question "), F.col("l_linenumber").cast("string"), F.lit(": "), text_of("part ", "l_partkey"), text_of(" of ", "l_suppkey")))
    none = F.lit(None).cast("string")
    line = F.struct(place.alias("place"), said.alias("said"), F.struct(
        F.col("l_linenumber").alias("number"), text_of("What is part ", "l_partkey").alias("question"), none.alias("model_answer"), none.alias("rubric"),
        F.col("l_quantity").alias("marks"), F.array().cast("array<string>").alias("citations")).alias("question"))
    papers = A.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("_lines")).select(
        F.col("l_orderkey").alias("assessment_id"), F.col("l_orderkey").alias("submission_id"), F.col("_lines.question").alias("questions"),
        F.array_join(F.array_compact("_lines.said"), "\n").alias("answer_text"))
    texts = papers.select("submission_id", "assessment_id", F.when(F.col("answer_text") != "", F.col("answer_text")).otherwise(
        F.concat(text_of("order ", "submission_id"), F.lit(" without labels"))).alias("answer_text"))
    return grading.align(texts, papers).select("submission_id", big("number"), "question", "marks", "student_answer")


@query("topic_phrases", f"""
WITH b AS (SELECT item_id, text || ' (' || upper(left(regexp_replace(text, '[^A-Za-z]', '', 'g'), 3)) || ')' AS name, {Q.words('text')}[1] AS head, length(text) > 150 AS known FROM benchmark),
c AS (SELECT *, CASE WHEN known THEN [head, ''] ELSE list_concat([name], regexp_extract_all(name, '\\(([A-Z][A-Z0-9]{{1,8}})\\)', 1)) END AS own FROM b),
p AS (SELECT *, CASE WHEN known AND item_id % 2 = 1 THEN ['paper', head] ELSE list_concat(list_distinct(own), ['c' || item_id // 5]) END AS paper FROM c)
SELECT item_id, known AS strict_phrases, list_sort(list_filter(list_distinct(own), lambda x: x <> '')) AS content_phrases,
  list_sort(list_filter(paper, lambda x: x <> '')) AS paper_phrases FROM p""")
def topic_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Passages as topic headings with an acronym; the long ones have a configured profile."""
    item, known = F.col("item_id"), F.length("text") > 150
    letters = F.upper(F.substring(F.regexp_replace("text", "[^A-Za-z]", ""), 1, 3))
    src = A.table(spark, sf, "benchmark")
    head = F.get(T.words("text"), F.lit(0))
    topics = src.select("item_id", text_of("t", "item_id").alias("topic_id"), F.concat("text", F.lit(" ("), letters, F.lit(")")).alias("name"),
                        F.concat(F.lit("c"), F.floor(item / 5).cast("string")).alias("chapter_name"))
    profiles = src.filter(known).select(text_of("t", "item_id").alias("topic_id"), F.array(head, F.lit("")).alias("content"),
                                        F.when(item % 2 == 1, F.array(F.lit("paper"), head)).alias("past_paper"), F.lit(True).alias("strict"))
    return evidence.with_phrases(topics, profiles).select(
        "item_id", "strict_phrases", F.array_sort("content_phrases").alias("content_phrases"), F.array_sort("paper_phrases").alias("paper_phrases"))


@query("mock_structure", f"""
SELECT p_partkey, unnest(range(1, 9)) AS number, unnest({list(evidence.SLOT_MARKS)}::BIGINT[]) AS marks, unnest({list(evidence.SLOT_TYPES)}) AS question_type,
  unnest([false, false, false, false, false, false, false, p_size > 25]) AS requires_coding,
  unnest([NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN p_size > 25 THEN p_brand END]) AS coding_kind FROM part""")
def mock_structure(spark: SparkSession, sf: str) -> DataFrame:
    """The eight slots of a mock test for every part; large ones ask for code."""
    slots = F.explode(evidence.structure_slots(F.col("p_size") > 25, F.col("p_brand"))).alias("_slot")
    return rounded(A.table(spark, sf, "part").select("p_partkey", slots).select("p_partkey", "_slot.*"))


@query("scorer_rerank", """
SELECT conv_id AS query_id, turn AS place, length(text) - length(role) + 0.0::DOUBLE AS score,
  row_number() OVER (PARTITION BY conv_id ORDER BY length(text) - length(role) DESC, turn) AS rank FROM conversations QUALIFY rank <= 3""")
def scorer_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """The three turns of every conversation that a scorer of the user's own likes best."""

    def longer(queries: pd.Series, passages: pd.Series) -> pd.Series:
        return (passages.fillna("").str.len() - queries.fillna("").str.len()).astype(float)

    rows = A.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("query_id"), F.col("turn").alias("place"), F.col("role").alias("rerank_query"), F.col("text").alias("passage"))
    best = search.rerank(rows, 3, longer)
    return best.select("query_id", "place", F.col("reranker_score").alias("score"), F.col("rerank_rank").cast("bigint").alias("rank"))


@query("embedding_fill", """
WITH known AS (SELECT DISTINCT text FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN k.text IS NOT NULL THEN -1.0 ELSE length(c.text) END::DOUBLE AS value
FROM conversations c LEFT JOIN known k ON k.text = c.text WHERE c.text IS NOT NULL""")
def embedding_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of all turns; those of users' texts come from the cache, the others from the user's function."""
    rows = A.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    cache = rows.filter("role = 'user'").select("text").distinct().select(
        H.cache_key("own", F.col("text")).alias("cache_key"), F.lit("own").alias("model"), F.array(F.lit(-1.0)).cast("array<float>").alias("embedding"))

    def lengths(texts: list[str]) -> np.ndarray:
        return np.array([[len(t)] for t in texts], dtype=float).reshape(-1, 1)

    filled, _ = indexing.fill_cache(rows.filter("text IS NOT NULL"), cache, "own", lengths)
    return filled.select("conv_id", "turn", F.get("embedding", F.lit(0)).cast("double").alias("value"))


@query("score_file_lines", """
SELECT l_orderkey AS line_no FROM lineitem WHERE l_returnflag = 'R'""")
def score_file_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a score table whose scores are no numbers."""
    rows = A.table(spark, sf, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", "bad").otherwise(F.col("l_quantity").cast("string")).alias("ai_score"),
        F.col("l_quantity").cast("string").alias("human_score"), F.col("l_orderkey").alias("line_no"))
    return grading.score_file_quality(rows)[1]


_STOP = "[" + ", ".join(f"'{w}'" for w in sorted(contracts.TOPIC_STOP)) + "]"


@query("topic_alignment", f"""
WITH {Q.QUESTIONS},
j AS (SELECT q.item_id, q.query, n.text AS phrase, q.item_id % 4 = 1 AS proven FROM questions_t q LEFT JOIN benchmark n ON n.item_id = q.item_id + q.item_id % 3),
w AS (SELECT *, list_filter({Q.tokens('phrase')}, lambda t: length(t) > 2 AND NOT list_contains({_STOP}, t)) AS own,
  list_filter(list_distinct({Q.tokens('query')}), lambda t: length(t) > 2 AND NOT list_contains({_STOP}, t)) AS asked FROM j)
SELECT item_id, CASE WHEN phrase IS NULL THEN 'UNKNOWN_TOPIC' WHEN NOT proven AND NOT (length(phrase) > 2 AND contains(lower(query), lower(phrase)))
  AND len(list_intersect(own, asked)) = 0 THEN 'TOPIC_DRIFT' END AS reason FROM w""")
def topic_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Every question against the topic of its own passage or one of the next two; the last ones have no such topic."""
    named = A.table(spark, sf, "benchmark").select(F.col("item_id").alias("_topic"), F.col("text").alias("_phrase"))
    asked = A.questions(spark, sf).withColumn("_topic", F.col("item_id") + F.col("item_id") % 3).join(named, "_topic", "left")
    topic = F.struct(F.col("_topic").cast("string").alias("topic_id"), F.array("_phrase").alias("phrases"))
    known = F.filter(F.array(topic), lambda t: F.get(t["phrases"], F.lit(0)).isNotNull())
    source = F.when(F.col("item_id") % 4 == 1, "some evidence").otherwise("")
    found = contracts.topic_alignment(F.col("query"), F.array(F.col("_topic").cast("string")), source, known)
    return asked.select("item_id", found["reason"].alias("reason"))
