"""Scope, contract, report and table-exchange queries over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import rubric
from lectern.functions import text as T
from lectern.operators import answers, context, contracts, evaluate, evidence, grading, ingest, search
from lectern.plans import sql as Q
from lectern.plans.evidence_queries import topics
from lectern.plans.records_queries import rounded
from lectern.plans.registry import query
from lectern.session import checkpoint_dir
from lectern.sources import adapters as A
from lectern.sources import io

TOPICS = f"""
tp AS (SELECT item_id, 't' || item_id AS topic_id, 'c' || (item_id // 5) AS chapter_id, CASE WHEN item_id % 2 = 0 THEN 'O_LEVEL' ELSE 'A_LEVEL' END AS level,
  array_to_string({Q.words('text')}[1:6], ' ') AS name, array_to_string({Q.words('text')}[7:12], ' ') AS chapter_name, 1 + item_id % 40 AS first_page FROM benchmark)"""


def pick(of: Column, *values: str | None) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.pmod(of, F.lit(len(values))) + 1).cast("int"))


def picked(of: str, *values: str | None) -> str:
    listed = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"[{listed}][({of}) % {len(values)} + 1]"


# --- scope ---------------------------------------------------------------------------------------------


@query("scope_resolution", f"""
WITH {TOPICS},
r AS (SELECT item_id, level, CASE WHEN item_id % 7 = 3 THEN 'c999' ELSE 'c' || (item_id // 5) END AS chapter,
  CASE WHEN item_id % 11 = 5 THEN ['t' || item_id, 't' || (item_id + 10)] ELSE ['t' || item_id] END AS ids FROM tp),
w AS (SELECT r.item_id, r.level, x.id, tp.first_page, coalesce(tp.chapter_id = r.chapter, false) AS inside
  FROM r, unnest(r.ids) x(id) LEFT JOIN tp ON tp.topic_id = x.id AND tp.level = r.level),
bad AS (SELECT item_id, CASE WHEN item_id % 7 = 3 THEN 'INVALID_CHAPTER' ELSE 'INVALID_TOPIC' END AS reason FROM w WHERE NOT inside GROUP BY ALL)
SELECT 'r' || item_id AS request_id, id AS topic_id, first_page + CASE level WHEN 'O_LEVEL' THEN 12 ELSE 8 END AS pdf_page_start, NULL AS reason
FROM w WHERE item_id NOT IN (SELECT item_id FROM bad)
UNION ALL SELECT 'r' || item_id, NULL, NULL, reason FROM bad""")
def scope_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """A request per topic; some name an unknown chapter, some a topic of another chapter."""
    rows = topics(spark, sf)
    item = F.col("item_id")
    own = F.concat(F.lit("t"), item.cast("string"))
    asked = rows.select(
        F.concat(F.lit("r"), item.cast("string")).alias("request_id"), "level",
        F.array(F.when(item % 7 == 3, "c999").otherwise(F.col("chapter_id"))).alias("chapter_ids"),
        F.when(item % 11 == 5, F.array(own, F.concat(F.lit("t"), (item + 10).cast("string")))).otherwise(F.array(own)).alias("topic_ids"),
    )
    resolved, rejected = evidence.resolve_scope(asked, rows.drop("item_id"))
    none = F.lit(None).cast("string")
    return rounded(resolved.select("request_id", "topic_id", "pdf_page_start", none.alias("reason")).unionByName(
        rejected.select("request_id", none.alias("topic_id"), F.lit(None).cast("int").alias("pdf_page_start"), "reason")))


@query("topic_catalog", f"""
WITH {TOPICS}, {Q.PAGES}
SELECT level, chapter_id, chapter_name, string_agg(topic_id || ' ' || name || ' Book pp. ' || first_page || '–' || (first_page + 2), '; ' ORDER BY topic_id) AS listed
FROM tp WHERE level IN (SELECT level FROM pages_t WHERE document_type = 'SYLLABUS') GROUP BY ALL""")
def topic_catalog(spark: SparkSession, sf: str) -> DataFrame:
    out = evidence.available_catalog(topics(spark, sf), A.pages(spark, sf))
    line = lambda t: F.concat_ws(" ", t["topic_id"], t["name"], t["label"])
    return out.select("level", "chapter_id", "chapter_name", F.array_join(F.transform("topics", line), "; ").alias("listed"))


@query("scoped_questions", f"""
WITH {TOPICS}
SELECT topic_id, 'Explain. Chapter: ' || chapter_name || '. Topic: ' || name || '. Required concepts: ' || array_to_string(string_split(name, ' '), ', ') || '.' AS query FROM tp""")
def scoped_questions(spark: SparkSession, sf: str) -> DataFrame:
    asked = evidence.scoped_query(F.lit("Explain"), F.col("chapter_name"), F.col("name"), F.split("name", " "))
    return topics(spark, sf).select("topic_id", asked.alias("query"))


@query("assessment_plan", f"""
SELECT o_orderkey AS request_id, upper({picked('o_orderkey', 'BEGINNER', 'INTERMEDIATE', 'ADVANCED', 'other')}) AS difficulty,
  greatest(1, least(o_custkey % 30 - 2, 20)) AS question_count, upper(o_orderstatus) AS question_format,
  (greatest(1, least(o_custkey % 30 - 2, 20)) + 1) // 2 AS textbook_questions, greatest(1, least(o_custkey % 30 - 2, 20)) // 2 AS past_paper_questions FROM orders""")
def assessment_plan(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request_id"), pick(F.col("o_orderkey"), "Easy", "medium", "HARD", "other").alias("difficulty"),
        (F.col("o_custkey") % 30 - 2).alias("question_count"), F.lower("o_orderstatus").alias("question_format"),
    )
    return rounded(evidence.plan_columns(rows))


@query("assessment_readiness", """
SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 3 = 0 THEN 'NO_TEXTBOOK_EVIDENCE' WHEN o_custkey % 3 = 0 THEN 'NO_PAST_PAPER_EVIDENCE'
  WHEN o_orderkey % 4 = 1 THEN 'SELECTED_TOPIC_WITHOUT_TEXTBOOK' WHEN o_custkey % 5 = 0 THEN 'UNALLOCATABLE_SLOTS' END AS reason FROM orders""")
def assessment_readiness(spark: SparkSession, sf: str) -> DataFrame:
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    reason = evidence.readiness(key % 3, customer % 3, (key % 4 == 1).cast("int"), customer % 5)
    return A.table(spark, sf, "orders").select(key.alias("request_id"), reason.alias("reason"))


@query("scoped_merge", """
WITH c AS (SELECT o_custkey AS topic_id, o_orderkey % 97 AS chunk_id, CAST(o_orderkey % 13 - 1 AS DOUBLE) AS score FROM orders
  UNION ALL SELECT o_custkey, o_orderkey % 89, CAST(o_orderkey % 17 - 1 AS DOUBLE) FROM orders),
b AS (SELECT topic_id, chunk_id, max(score) AS score FROM c WHERE score >= 0 GROUP BY ALL)
SELECT topic_id, chunk_id, score, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, chunk_id) AS place FROM b QUALIFY place <= 6""")
def scoped_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as candidates of their customer's topic, found locally and by retrieval."""
    orders = A.table(spark, sf, "orders")
    found = lambda ids, scores: orders.select(
        F.col("o_custkey").alias("topic_id"), (F.col("o_orderkey") % ids).alias("chunk_id"), (F.col("o_orderkey") % scores - 1).cast("double").alias("score"))
    return rounded(evidence.merge_scoped(found(97, 13), found(89, 17)).select("topic_id", "chunk_id", "score", "place"))


# --- contexts and answers --------------------------------------------------------------------------------


@query("chunk_fetch", f"""
WITH {Q.CHUNKS}, d AS (SELECT document_id, min(chunk_id) AS lo, max(chunk_id) AS hi FROM chunks_t GROUP BY 1)
SELECT document_id AS request_id, hi AS chunk_id, 0 AS position FROM d UNION ALL SELECT document_id, lo, 2 FROM d""")
def chunk_fetch(spark: SparkSession, sf: str) -> DataFrame:
    """Each document asks for its last chunk, an unknown one and its first."""
    chunks = A.chunks(spark, sf)
    ids = chunks.groupBy(F.col("document_id").alias("request_id")).agg(F.array(F.max("chunk_id"), F.lit("unknown"), F.min("chunk_id")).alias("chunk_ids"))
    return rounded(search.fetch(ids, chunks).select("request_id", "chunk_id", "position"))


@query("citable_sources", f"""
WITH r AS (SELECT doc_id, doc_id // 8 AS query_id, {picked('doc_id', 'TEXTBOOK', 'MARKING_PATTERN', 'SYLLABUS')} AS kind,
  {picked('doc_id', None, 'EXACT', 'ASSESSMENT_PATTERN', None, 'PARENT')} AS rel, text FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS n FROM r WHERE kind <> 'MARKING_PATTERN' AND coalesce(rel, '') <> 'ASSESSMENT_PATTERN')
SELECT doc_id, 'S' || n AS source_key, coalesce(rel, 'CURRICULUM_EVIDENCE') AS source_role, md5(left(text, 2200)) AS text_hash FROM k""")
def citable_sources(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.col("doc_id")
    rows = A.table(spark, sf, "documents").select(
        "doc_id", F.floor(doc / 8).alias("query_id"), doc.alias("position"), pick(doc, "TEXTBOOK", "MARKING_PATTERN", "SYLLABUS").alias("document_type"),
        pick(doc, None, "EXACT", "ASSESSMENT_PATTERN", None, "PARENT").alias("relationship"), "text",
    )
    return context.citable_sources(rows).select("doc_id", "source_key", "source_role", F.md5("text").alias("text_hash"))


@query("official_answers", f"""
SELECT doc_id // 12 AS query_id, md5(string_agg({Q.strip('text')}, chr(10) || chr(10) ORDER BY doc_id)) AS answer_hash
FROM documents WHERE doc_id % 4 = 1 AND {Q.strip('text')} <> '' GROUP BY 1""")
def official_answers(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.col("doc_id")
    rows = A.table(spark, sf, "documents").select(
        F.floor(doc / 12).alias("query_id"), doc.alias("context_position"), pick(doc, "TEXTBOOK", "MARK_SCHEME", "SYLLABUS", None).alias("document_type"), "text")
    return answers.official_answers(rows).select("query_id", F.md5("answer").alias("answer_hash"))


@query("answer_disposition", f"""
WITH e AS (SELECT event_id % 7 > 1 AS sufficient, event_id % 3 = 0 AS exact, event_id % 5 > 0 AS available, {picked('event_id', 'EXAM_ANSWER', 'CONCEPT_EXPLANATION')} AS intent FROM events)
SELECT CASE WHEN NOT sufficient THEN 'INSUFFICIENT_SOURCE' WHEN exact THEN 'OFFICIAL_MARK_SCHEME_SUPPORTED_ANSWER' WHEN NOT available THEN 'GENERATION_NOT_RUN'
   WHEN intent = 'EXAM_ANSWER' THEN 'AI_GENERATED_MODEL_ANSWER' ELSE 'CURRICULUM_EXPLANATION' END AS answer_type,
  CASE WHEN NOT sufficient THEN 'COMPLETED_ABSTENTION' WHEN exact THEN 'COMPLETED' WHEN NOT available THEN 'SKIPPED_MISSING_API_KEY' ELSE 'TO_GENERATE' END AS execution_status,
  count(*) AS questions FROM e GROUP BY ALL""")
def answer_disposition(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    what = answers.disposition(e % 7 > 1, e % 3 == 0, e % 5 > 0, pick(e, "EXAM_ANSWER", "CONCEPT_EXPLANATION"))
    return A.table(spark, sf, "events").select(what.alias("w")).groupBy("w.answer_type", "w.execution_status").agg(F.count("*").alias("questions"))


@query("judge_eligible", f"""
SELECT doc_id AS id FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 5 > 0 AND coalesce(CASE WHEN doc_id % 7 <> 2 THEN text END, '') <> ''
  AND doc_id IN (SELECT doc_id FROM labels)""")
def judge_eligible(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.col("doc_id")
    rows = A.table(spark, sf, "documents").select(
        doc.alias("id"), F.when(doc % 3 == 0, "FAILED").otherwise("COMPLETED").alias("execution_status"),
        F.slice(F.array("lang", "source"), 1, (doc % 5).cast("int")).alias("contexts"), F.when(doc % 7 != 2, F.col("text")).alias("answer"))
    return evaluate.judge_eligible(rows, A.table(spark, sf, "labels").select(doc.alias("id"))).select("id")


@query("cited_sources", f"""
WITH s AS (SELECT conv_id, turn, 'S' || (turn % 3 + 1) AS key, role FROM conversations),
k AS (SELECT conv_id, list(key ORDER BY turn) AS keys FROM s GROUP BY 1)
SELECT conv_id, array_to_string([k.keys[i] FOR i IN range(1, len(k.keys) + 1) IF k.keys[i] <> 'S3' AND NOT list_contains(k.keys[1:i - 1], k.keys[i])], ',') AS cited FROM k""")
def cited_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as cited keys; the third source is not in the catalogue."""
    turns = A.table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("S"), (F.col("turn") % 3 + 1).cast("string")).alias("key"))
    keys = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "key"))), lambda t: t["key"]).alias("keys"))
    catalog = F.create_map(*[x for k in ("S1", "S2") for x in (F.lit(k), F.struct(F.lit(k).alias("source_key")))])
    cited = answers.canonical_citations(F.col("keys"), catalog)
    return keys.select("conv_id", F.array_join(F.transform(cited, lambda c: c["source_key"]), ",").alias("cited"))


@query("embedding_costs", """
SELECT doc_id, round(n_chars * 0.02 / 1000000, 8) AS cost FROM documents""")
def embedding_costs(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "documents").select("doc_id", answers.embedding_cost(F.col("n_chars")).alias("cost"))


# --- contracts --------------------------------------------------------------------------------------------


@query("request_contracts", f"""
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_totalprice AS p, length(o_orderstatus) AS s FROM orders)
SELECT k AS request_id,
  CASE WHEN k % 9 = 0 THEN 'TOPIC_LENGTH' WHEN k % 4 = 3 THEN 'DIFFICULTY' WHEN k % 3 = 2 THEN 'ASSESSMENT_TYPE' WHEN c % 25 NOT BETWEEN 1 AND 20 THEN 'QUESTION_COUNT'
    WHEN c % 5 = 4 THEN 'QUESTION_FORMAT' END AS assessment,
  CASE WHEN k % 3 = 2 THEN 'LEVEL' WHEN c % 11 NOT BETWEEN 1 AND 8 THEN 'CHAPTERS' WHEN k % 10 NOT BETWEEN 1 AND 8 THEN 'TOPICS' WHEN k % 4 = 3 THEN 'DIFFICULTY' END AS mock,
  CASE WHEN k % 6 = 0 THEN 'ANSWER_LENGTH' END AS submission,
  CASE WHEN c % 7 = 0 THEN 'SCORE' WHEN c % 8 = 0 THEN 'COMMENT_LENGTH' END AS review FROM o""")
def request_contracts(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    difficulty = pick(k, "easy", "hard", "advanced", "other")
    upto = lambda n: F.slice(F.array(*[F.lit(str(i)) for i in range(11)]), 1, n.cast("int"))
    return A.table(spark, sf, "orders").select(
        k.alias("request_id"),
        contracts.assessment_request(F.when(k % 9 == 0, "x").otherwise("arrays"), difficulty, pick(k, "quiz", "assignment", None), c % 25, pick(c, "mcq", "mixed", "long_answer", "short_answer", "essay"))["reason"].alias("assessment"),
        contracts.mock_request(pick(k, "O_LEVEL", "A_LEVEL", "X"), upto(c % 11), upto(k % 10), difficulty)["reason"].alias("mock"),
        contracts.submission_request(F.when(k % 6 != 0, "answer"))["reason"].alias("submission"),
        contracts.review_request(F.when(c % 7 != 0, F.col("o_totalprice")), F.when(c % 8 == 0, F.repeat(F.lit("x"), 5001)))["reason"].alias("review"),
    )


@query("question_ownership", f"""
SELECT l_orderkey AS order_id, l_linenumber AS number, CASE WHEN l_partkey % 5 = 0 THEN 'UNKNOWN_QUESTION_NUMBER' WHEN l_partkey % 7 = 0 THEN 'UNKNOWN_EVIDENCE'
  WHEN l_suppkey % 2 = 0 AND (l_suppkey % 3 = 0 OR l_partkey % 3 = 0) THEN 'INVALID_ONE_MARK_MCQ' END AS reason, count(*) AS n FROM lineitem GROUP BY ALL""")
def question_ownership(spark: SparkSession, sf: str) -> DataFrame:
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    options = F.when(s % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(*map(F.lit, "abcd")))
    question = F.struct(F.col("l_linenumber").alias("number"), options.alias("options"), F.when(p % 3 == 0, "z").otherwise("b").alias("correct_option"))
    slot = F.when(p % 5 != 0, F.struct(F.array(F.lit("S1"), F.when(p % 7 == 0, "S9").otherwise("S2")).alias("source_keys")))
    structure = F.struct(F.when(s % 2 == 0, "MCQ").otherwise("SHORT_ANSWER").alias("question_type"))
    out = contracts.owned_question(question, slot, structure, F.array(F.lit("S1"), F.lit("S2")))
    rows = A.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("number"), out["reason"].alias("reason"))
    return rounded(rows.groupBy("order_id", "number", "reason").agg(F.count("*").alias("n")))


@query("slot_application", """
SELECT l_orderkey AS order_id, l_linenumber AS number, CASE WHEN l_partkey % 3 = 0 THEN 'OWN' WHEN l_suppkey % 2 = 0 THEN 'MCQ' ELSE 'LONG_ANSWER' END AS question_type,
  CASE WHEN l_partkey % 3 = 0 OR l_suppkey % 2 = 0 THEN 4 ELSE 0 END AS options, CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE l_suppkey % 4 + 1 END AS marks,
  CASE WHEN l_partkey % 3 = 0 OR l_suppkey % 2 = 0 THEN 'b' ELSE '' END AS correct_option, l_partkey % 3 <> 0 AND l_suppkey % 5 = 0 AS requires_coding, count(*) AS n
FROM lineitem GROUP BY ALL""")
def slot_application(spark: SparkSession, sf: str) -> DataFrame:
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    question = F.struct(
        F.col("l_linenumber").alias("number"), F.lit("q").alias("question"), F.lit("OWN").alias("question_type"), F.array(*map(F.lit, "abcd")).alias("options"),
        F.lit("b").alias("correct_option"), F.lit(1).cast("long").alias("marks"), F.lit("m").alias("model_answer"), F.array(F.lit("r")).alias("rubric"), F.lit(False).alias("requires_coding"))
    slot = F.struct(F.lit("TEXTBOOK").alias("content_source"), F.array(F.lit("t")).alias("topic_ids"))
    structure = F.when(p % 3 != 0, F.struct(
        F.when(s % 2 == 0, "MCQ").otherwise("LONG_ANSWER").alias("question_type"), (s % 4 + 1).alias("marks"), (s % 5 == 0).alias("requires_coding")))
    out = A.table(spark, sf, "lineitem").select("l_orderkey", contracts.apply_slot(question, slot, structure).alias("q"))
    keys = [F.col("l_orderkey").alias("order_id"), "q.number", "q.question_type", F.size("q.options").alias("options"), "q.marks", "q.correct_option", "q.requires_coding"]
    rows = out.select(*keys)
    return rounded(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")))


@query("role_pairing", """
SELECT event_id % 2 = 0 AS textbook, event_id % 4 AS roles, CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 4 >= 2 THEN 'MISSING_SOURCE_PAIRING' END
  WHEN event_id % 4 <> 3 THEN 'MISSING_SOURCE_PAIRING' END AS reason, count(*) AS n FROM events GROUP BY ALL""")
def role_pairing(spark: SparkSession, sf: str) -> DataFrame:
    """Bit 0 of the id cites the textbook, bit 1 a past paper; even ids are textbook questions."""
    e = F.col("event_id")
    roles = F.array_compact(F.array(F.when(e % 2 == 1, contracts.BOOK), F.when(e % 4 >= 2, contracts.PAPER)))
    out = contracts.role_pairing(F.when(e % 2 == 0, "TEXTBOOK").otherwise("PAST_PAPER"), roles)["reason"]
    rows = A.table(spark, sf, "events").select((e % 2 == 0).alias("textbook"), (e % 4).alias("roles"), out.alias("reason"))
    return rounded(rows.groupBy("textbook", "roles", "reason").agg(F.count("*").alias("n")))


@query("unsupported_claims", """
SELECT doc_id, CASE WHEN doc_id % 3 > 0 AND doc_id % 4 <> 1 THEN 'BIG_O_NOT_IN_SOURCE' END AS reason FROM documents""")
def unsupported_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Questions and answers with a complexity claim, over sources with and without one."""
    doc = F.col("doc_id")
    said = F.concat("text", F.when(doc % 3 == 1, " It is O(n).").otherwise(""))
    answer = F.when(doc % 3 == 2, "Quadratic COMPLEXITY").otherwise("none")
    source = F.concat("text", F.when(doc % 4 == 1, " TIME Complexity").otherwise(""))
    return A.table(spark, sf, "documents").select("doc_id", rubric.unsupported_claim(said, answer, source).alias("reason"))


# --- reports and files ---------------------------------------------------------------------------------------


@query("build_report", f"""
WITH {Q.CHUNKS}, d AS (SELECT count(*) AS documents, count(*) FILTER (doc_id % 9 = 4) AS unknown_documents FROM documents),
p AS (SELECT count(*) AS pages, count(*) FILTER (page_id % 3 = 0 OR page_id % 100 < 75) AS low_quality_or_ocr_pages FROM pages), c AS (SELECT count(*) AS chunks FROM chunks_t)
SELECT * FROM d, p, c""")
def build_report(spark: SparkSession, sf: str) -> DataFrame:
    docs, pages = review_inputs(spark, sf)
    return ingest.build_report(docs, pages, A.chunks(spark, sf).agg(F.count("*").alias("chunks")))


def review_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = A.table(spark, sf, "documents").select(
        F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("source_path"), F.when(F.col("doc_id") % 9 == 4, "UNKNOWN").otherwise("TEXTBOOK").alias("document_type"))
    pages = A.table(spark, sf, "pages").select("page_id", (F.col("page_id") % 3 == 0).alias("ocr_attempted"), (F.col("page_id") % 100 / 100).alias("quality_score"))
    return docs, pages


@query("review_lists", """
SELECT 'page' AS kind, CAST(page_id AS VARCHAR) AS name FROM pages WHERE page_id % 3 = 0 OR page_id % 100 < 75
UNION ALL SELECT 'document', 'd/' || doc_id FROM documents WHERE doc_id % 9 = 4""")
def review_lists(spark: SparkSession, sf: str) -> DataFrame:
    docs, pages = review_inputs(spark, sf)
    listed = ingest.review_pages(pages).select(F.lit("page").alias("kind"), F.col("page_id").cast("string").alias("name"))
    return listed.unionByName(ingest.unknown_documents(docs).select(F.lit("document").alias("kind"), F.col("source_path").alias("name")))


@query("ocr_word_accuracy", """
SELECT count(*) AS rows, round(sum(doc_id % 17 + 1)::DOUBLE / sum(n_chars + 20), 6) AS accuracy FROM documents""")
def ocr_word_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.col("doc_id")
    rows = A.table(spark, sf, "documents").select(
        F.lit("r").alias("reviewer"), F.lit("today").alias("reviewed_at"), (F.col("n_chars") + 20).cast("string").alias("reviewed_words"), (doc % 17 + 1).cast("string").alias("correct_words"))
    return rounded(evaluate.word_accuracy(rows))


@query("unreviewed_words", "SELECT count(*) AS rows, CAST(NULL AS DOUBLE) AS accuracy FROM documents")
def unreviewed_words(spark: SparkSession, sf: str) -> DataFrame:
    """One row in ten without a reviewer: no accuracy is given."""
    doc = F.col("doc_id")
    rows = A.table(spark, sf, "documents").select(
        F.when(doc % 10 > 0, "r").alias("reviewer"), F.lit("t").alias("reviewed_at"), F.lit("5").alias("reviewed_words"), F.lit("4").alias("correct_words"))
    return rounded(evaluate.word_accuracy(rows))


@query("approved_assessments", """
SELECT c_custkey AS assessment_id FROM customer WHERE c_nationkey = 3 AND c_custkey % 3 = 2""")
def approved_assessments(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.grade_assessments(spark, sf).withColumn("created_at", F.col("assessment_id"))
    return grading.list_assessments(rows, owner_id=3, approved_only=True).select("assessment_id")


@query("json_exchange", "SELECT doc_id, lang, md5(text) AS text_hash, CASE WHEN doc_id % 3 = 0 THEN source END AS source FROM documents")
def json_exchange(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as JSON lines, with null fields, and read with a schema."""
    path = f"{checkpoint_dir(spark)}/lectern-{uuid.uuid4().hex}"
    docs = A.table(spark, sf, "documents").select("doc_id", "lang", "text", F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("source"))
    io.write_json(docs, path)
    back = io.read_jsonl(spark, path, "doc_id long, lang string, text string, source string")
    return back.select("doc_id", "lang", F.md5("text").alias("text_hash"), "source")


@query("csv_exchange", "SELECT c_custkey AS id, c_mktsegment AS topic, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS score FROM customer")
def csv_exchange(spark: SparkSession, sf: str) -> DataFrame:
    """Customers written as CSV and read by column name; values that don't parse are null."""
    path = f"{checkpoint_dir(spark)}/lectern-{uuid.uuid4().hex}"
    rows = A.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 == 0, "not scored").otherwise(F.col("c_acctbal").cast("string")).alias("score"),
        F.col("c_mktsegment").alias("topic"), F.lit("left out").alias("other"))
    io.write_csv(rows, path, ["score", "topic", "id"])
    return io.read_csv(spark, path, "id long, topic string, score double", required=["id", "score"]).select("id", "topic", "score")


@query("boundary_packet", f"""
WITH {Q.CHUNKS}
SELECT chunk_id, document_id, question_number, CAST(page_start AS BIGINT) AS page, '' AS reviewer FROM chunks_t WHERE question_number IS NOT NULL ORDER BY ord LIMIT 50""")
def boundary_packet(spark: SparkSession, sf: str) -> DataFrame:
    """The first fifty labelled entries in corpus order."""
    rows = A.chunks(spark, sf).withColumn("content_type", F.when(F.col("question_number").isNotNull(), "QUESTION").otherwise(F.col("content_type")))
    return rounded(io.boundary_review(rows).select("chunk_id", "document_id", "question_number", "page", "reviewer"))


@query("metadata_packet", "SELECT 'd/' || doc_id AS source_path, '' AS is_correct, '' AS notes FROM documents")
def metadata_packet(spark: SparkSession, sf: str) -> DataFrame:
    return io.metadata_review(review_inputs(spark, sf)[0]).select("source_path", "is_correct", "notes")


@query("event_fields", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def event_fields(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "events").select("event_id", T.json_field("props", "$.k").alias("k"))
