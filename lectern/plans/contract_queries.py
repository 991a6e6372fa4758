"""Contract, benchmark, answer and ingestion queries over tables derived from the given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import rubric
from lectern.functions import text as T
from lectern.functions import understanding as U
from lectern.operators import answers, benchmark, contracts, evaluate, grading, ingest
from lectern.plans import retrieval
from lectern.plans import sql as Q
from lectern.plans.records_queries import rounded
from lectern.plans.registry import SQL, query
from lectern.plans.retrieval_queries import settled_index
from lectern.plans.text_queries import quality_sql
from lectern.sources import adapters as A

# --- assessments: an order is an assessment, its line items are the questions --------------------------

QUESTION_WORDS = ("Write an SQL query for part ", "Explain the idea behind part ", "Complete the trace table for part ")


def assessments(spark: SparkSession, sf: str) -> DataFrame:
    line, part = F.col("l_linenumber"), F.col("l_partkey")
    kind = F.element_at(F.array(F.lit("MCQ"), F.lit("SHORT_ANSWER"), F.lit("LONG_ANSWER")), (part % 3 + 1).cast("int"))
    choice = part % 3 == 0
    words = F.element_at(F.array(*[F.lit(w) for w in QUESTION_WORDS]), (part % 3 + 1).cast("int"))
    points = F.when(choice, F.lit(1)).otherwise(line + F.when(part % 11 == 0, 1).otherwise(0)).cast("int")
    source = F.when(line % 2 == 1, "TEXTBOOK").otherwise("PAST_PAPER")
    cite = lambda role: F.struct(F.lit("d").alias("document_id"), part.cast("string").alias("chunk_id"), F.lit(1).alias("page"), F.lit(role).alias("source_role"))
    item = F.struct(
        line.cast("int").alias("number"), part.alias("part"), F.col("l_suppkey").alias("supp"),
        F.concat(words, part.cast("string")).alias("question"), kind.alias("question_type"),
        F.when(choice, F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d"))).otherwise(F.array().cast("array<string>")).alias("options"),
        F.when(choice, F.when(part % 13 == 0, "x").otherwise("a")).otherwise("").alias("correct_option"),
        F.when(choice, F.lit(1)).otherwise(line).cast("int").alias("marks"),
        F.when(part % 17 == 0, "").otherwise("model answer").alias("model_answer"),
        F.transform(F.sequence(F.lit(1), points), lambda i: F.concat(F.lit("point "), i.cast("string"), F.when(part % 5 == 0, " with output").otherwise(""))).alias("rubric"),
        source.alias("content_source"), F.array(F.concat(F.lit("t"), (part % 4).cast("string"))).alias("topic_ids"),
        F.lit(False).alias("requires_coding"),
        F.when((line % 2 == 1), F.array(cite("TEXTBOOK_CONTENT"))).otherwise(F.array(cite("PAST_PAPER_STYLE"), cite("TEXTBOOK_CONTENT"))).alias("citations"),
    )
    rows = A.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("assessment_id"), item.alias("q"))
    return rows.groupBy("assessment_id").agg(F.array_sort(F.collect_list("q")).alias("questions"))


ASSESS = f"""
item AS (SELECT l_orderkey AS assessment_id, l_linenumber AS number, l_partkey AS part, l_suppkey AS supp,
   ['MCQ','SHORT_ANSWER','LONG_ANSWER'][l_partkey % 3 + 1] AS question_type, l_partkey % 3 = 0 AS choice,
   CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE l_linenumber END AS marks,
   CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE l_linenumber + CASE WHEN l_partkey % 11 = 0 THEN 1 ELSE 0 END END AS points,
   l_partkey % 17 = 0 AS no_answer, l_partkey % 5 = 0 AS has_output, l_partkey % 13 = 0 AND l_partkey % 3 = 0 AS bad_option,
   't' || (l_partkey % 4) AS topic FROM lineitem),
judged AS (SELECT *, CASE WHEN marks < 1 OR no_answer THEN 'INCOMPLETE_MARKING_KEY'
   WHEN NOT choice AND points <> marks THEN 'INSUFFICIENT_RUBRIC_GRANULARITY'
   WHEN NOT choice AND part % 3 = 2 AND NOT has_output THEN 'APPLIED_ITEM_HAS_GENERIC_RUBRIC' END AS marking,
   row_number() OVER (PARTITION BY assessment_id ORDER BY number, part, supp) AS place FROM item)
"""


@query("marking_contract", f"""
WITH {ASSESS}
SELECT assessment_id, arg_min(marking, place) FILTER (marking IS NOT NULL) AS reason,
  CAST(arg_min(number, place) FILTER (marking IS NOT NULL) AS BIGINT) AS item FROM judged GROUP BY 1""")
def marking_contract(spark: SparkSession, sf: str) -> DataFrame:
    rows = assessments(spark, sf)
    checked = contracts.marking_quality(F.col("questions"), F.lit("quiz"), F.lit(True), F.lit(None).cast("string"), F.size("questions"))
    return _outcomes(rows, checked)


def _outcomes(rows: DataFrame, checked) -> DataFrame:
    out = rows.select("assessment_id", F.explode_outer(F.array(checked)).alias("o"))
    return out.select("assessment_id", F.col("o.reason").alias("reason"), F.col("o.item").cast("bigint").alias("item"))


@query("mock_scope_contract", f"""
WITH {ASSESS},
g AS (SELECT assessment_id, sum(marks) AS total, count(*) AS n, count(DISTINCT marks) AS spread, max(marks) AS top,
   bool_or(choice AND marks = 1) AS mcq, list_distinct(list(topic)) AS covered, bool_or(part % 3 IN (0, 2)) AS coding,
   min(place) FILTER (topic = 't3') AS bad, arg_min(number, place) FILTER (topic = 't3') AS bad_number FROM judged GROUP BY 1)
SELECT assessment_id, CASE WHEN total <> 25 THEN 'MOCK_TEST_MARK_TOTAL_IS_NOT_25' WHEN n < 7 THEN 'MOCK_TEST_REQUIRES_AT_LEAST_SEVEN_QUESTIONS'
   WHEN spread < 3 OR top < 4 OR top > 6 THEN 'MOCK_TEST_MARK_DISTRIBUTION_IS_NOT_STRUCTURED' WHEN NOT mcq THEN 'MOCK_TEST_REQUIRES_A_ONE_MARK_MCQ'
   WHEN bad IS NOT NULL THEN 'MOCK_TEST_SCOPE_DEVIATION' WHEN NOT coding THEN 'CODING_CAPABLE_MOCK_TEST_REQUIRES_AN_APPLIED_CODING_ITEM'
   WHEN len(list_filter(['t0','t1','t2'], lambda t: NOT list_contains(covered, t))) > 0 THEN 'MOCK_TEST_DOES_NOT_COVER_ALL_SELECTED_TOPICS' END AS reason,
   CAST(CASE WHEN total = 25 AND n >= 7 AND spread >= 3 AND top BETWEEN 4 AND 6 AND mcq THEN bad_number END AS BIGINT) AS item FROM g""")
def mock_scope_contract(spark: SparkSession, sf: str) -> DataFrame:
    topics = F.array(F.lit("t0"), F.lit("t1"), F.lit("t2"))
    return _outcomes(assessments(spark, sf), contracts.mock_scope(F.col("questions"), F.lit("mock_test"), topics, F.lit(25), F.lit(True)))


@query("distribution_contract", f"""
WITH {ASSESS},
g AS (SELECT assessment_id, count(*) FILTER (number % 2 = 1) AS book, count(*) AS n FROM judged GROUP BY 1),
d AS (SELECT j.*, book, n, CASE WHEN number BETWEEN 1 AND n AND topic <> ['t0','t1'][((number - 1) // 2 + CASE WHEN number % 2 = 0 THEN 1 ELSE 0 END) % 2 + 1]
   THEN 'SOURCE_TOPIC_ASSIGNMENT_DRIFT' END AS drift FROM judged j JOIN g USING (assessment_id))
SELECT assessment_id, CASE WHEN any_value(book) <> (any_value(n) + 1) // 2 THEN 'UNBALANCED_CONTENT_DISTRIBUTION'
    ELSE arg_min(drift, place) FILTER (drift IS NOT NULL) END AS reason,
  CAST(CASE WHEN any_value(book) = (any_value(n) + 1) // 2 THEN arg_min(number, place) FILTER (drift IS NOT NULL) END AS BIGINT) AS item FROM d GROUP BY 1""")
def distribution_contract(spark: SparkSession, sf: str) -> DataFrame:
    n = F.size("questions")
    checked = contracts.source_distribution(
        F.col("questions"), F.floor((n + 1) / 2), F.floor(n / 2), F.array(F.lit("t0"), F.lit("t1")), n
    )
    return _outcomes(assessments(spark, sf), checked)


@query("completeness_contract", f"""
WITH {ASSESS}
SELECT assessment_id, CASE WHEN list_sort(list_distinct(list(number))) <> range(1, count(*) + 1) OR bool_or(no_answer OR bad_option)
   THEN 'QUESTION_CONTRACT_VIOLATION' END AS reason, CAST(NULL AS BIGINT) AS item FROM judged GROUP BY 1""")
def completeness_contract(spark: SparkSession, sf: str) -> DataFrame:
    return _outcomes(assessments(spark, sf), contracts.completeness(F.col("questions"), F.size("questions"), F.lit("MIXED")))


@query("combined_contract", f"""
WITH d AS ({SQL['distribution_contract']}), m AS ({SQL['marking_contract']}), c AS ({SQL['completeness_contract']})
SELECT d.assessment_id, d.reason IS NULL AND m.reason IS NULL AND c.reason IS NULL AS passed, coalesce(d.reason, m.reason, c.reason) AS reason,
  CASE WHEN d.reason IS NOT NULL THEN 'distribution_validator' WHEN m.reason IS NOT NULL THEN 'marking_quality_validator' ELSE 'deterministic' END AS provider
FROM d JOIN m USING (assessment_id) JOIN c USING (assessment_id)""")
def combined_contract(spark: SparkSession, sf: str) -> DataFrame:
    q, n = F.col("questions"), F.size("questions")
    topics = F.array(F.lit("t0"), F.lit("t1"))
    parts = assessments(spark, sf).select(
        "assessment_id",
        F.explode_outer(F.array(F.struct(
            contracts.source_distribution(q, F.floor((n + 1) / 2), F.floor(n / 2), topics, n).alias("d"),
            contracts.marking_quality(q, F.lit("quiz"), F.lit(True), F.lit(None).cast("string"), n).alias("m"),
            contracts.mock_scope(q, F.lit("quiz"), topics, F.lit(25), F.lit(True)).alias("s"),
            contracts.completeness(q, n, F.lit("MIXED")).alias("c"),
        ))).alias("p"),
    )
    out = contracts.combined(F.col("p.d"), F.col("p.m"), F.col("p.s"), F.col("p.c"))
    return parts.select("assessment_id", out.alias("o")).select("assessment_id", "o.passed", "o.reason", "o.provider")


def _listed(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _dimension(step: int, dimensions, rows: str) -> str:
    """The criterion of one marking dimension: the first unused one with any of its terms, else its own text."""
    terms, fallback = dimensions[step]
    used = "".join(f" AND i <> coalesce(u{k}, 0)" for k in range(step))
    pick = f"list_filter(range(1, len(c) + 1), lambda i: len(list_filter({_listed(terms)}, lambda t: contains(lower(c[i]), t))) > 0{used})[1]"
    return f"SELECT *, {pick} AS u{step}, coalesce(c[{pick}], '{fallback}') AS d{step} FROM {rows}"


def _dimensions(name: str, dimensions) -> str:
    steps = [f"{name}0 AS ({_dimension(0, dimensions, 'ru')})"]
    steps += [f"{name}{k} AS ({_dimension(k, dimensions, f'{name}{k - 1}')})" for k in range(1, len(dimensions))]
    return ", ".join(steps)


RUBRIC_SQL = f"""
fr AS (SELECT item_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace({Q.collapse('text')},
    '\\s*;\\s*', chr(1), 'g'), '\\.\\s+', '.' || chr(1), 'g'), '(?i)\\s*\\b((?:award\\s+)?1\\s+mark\\b)', chr(1) || '\\1', 'g'), chr(1)),
    lambda x: trim(x, ' -.,')), lambda x: length(x) >= 8) AS f FROM benchmark),
cr AS (SELECT item_id, list_filter(list_transform(list_concat(f, list_transform(f, lambda x: 'stating this model-answer point: ' || x), {_listed(rubric.FALLBACKS)}),
    lambda x: '1 mark for ' || trim(regexp_replace({Q.strip('x')}, '(?i)^(?:award\\s+)?\\d+\\s+marks?\\s*(?:for|:)?\\s*', ''), ' .') || '.'), lambda x: x <> '1 mark for .') AS c FROM fr),
iu AS (SELECT item_id, c, list_transform(c, lambda x: regexp_replace(lower(x), '{Q.EDGE}', '', 'g')) AS k FROM cr),
ru AS (SELECT item_id, list_filter(range(1, len(c) + 1), lambda i: NOT list_contains(k[1:i - 1], k[i])) AS keep, [c[i] FOR i IN keep][1:item_id % 6 + 1] AS c FROM iu),
{_dimensions('sq', rubric.SQL_DIMENSIONS)}, {_dimensions('pg', rubric.PROGRAMMING_DIMENSIONS)},
co AS (SELECT item_id, [d0, d1, d2, d3] AS c FROM sq3 WHERE item_id % 8 = 0 UNION ALL SELECT item_id, [d0, d1, d2, d3] FROM pg3 WHERE item_id % 8 = 4
  UNION ALL SELECT item_id, c FROM ru WHERE item_id % 4 <> 0)
SELECT item_id, len(c) AS points, array_to_string(c, chr(10)) AS rubric FROM co"""


@query("rubric_compile", f"WITH {RUBRIC_SQL}")
def rubric_compile(spark: SparkSession, sf: str) -> DataFrame:
    """Rubrics compiled from whole benchmark passages; every fourth item is a coding task."""
    item = F.col("item_id")
    q = F.struct(
        F.lit("SHORT_ANSWER").alias("question_type"), F.lit("").alias("correct_option"), F.array("text").alias("rubric"),
        F.col("text").alias("model_answer"), (item % 6 + 1).cast("int").alias("marks"),
    )
    s = F.struct(
        F.lit(None).cast("int").alias("marks"), (item % 4 == 0).alias("requires_coding"),
        F.when(item % 8 == 0, "SQL").otherwise("PROGRAMMING").alias("coding_kind"),
    )
    rows = A.table(spark, sf, "benchmark").select("item_id", F.explode_outer(F.array(contracts.compiled_rubric(q, s))).alias("r"))
    return rows.select("item_id", F.size("r").cast("bigint").alias("points"), F.array_join("r", "\n").alias("rubric"))


# --- benchmark records -----------------------------------------------------------------------------------


def records(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    status = F.element_at(F.array(*[F.lit(s) for s in (*contracts.STATUSES, "OTHER")]), (i % 6 + 1).cast("int"))
    ref = F.array(F.struct(F.concat(F.lit("d"), i.cast("string")).alias("document_id"), F.when(i % 19 != 0, F.lit(1)).alias("page"), F.lit("c").alias("chunk_id")))
    none = F.array().cast(contracts_ref)
    return A.table(spark, sf, "documents").select(
        F.floor(i / 2).cast("string").alias("id"), i.alias("line_no"), F.col("text").alias("question"),
        F.col("source").alias("category"), F.lit("BEGINNER").alias("difficulty"), F.lit("X").alias("expected_intent"),
        F.when(i % 23 == 0, "").otherwise(F.col("lang")).alias("gold_answer"), F.when(i % 29 == 0, none).otherwise(ref).alias("ground_truth_references"),
        F.array(F.lit(1)).alias("expected_pages"), F.array(F.lit("t")).alias("expected_topics"), ref.alias("expected_citations"),
        status.alias("review_status"),
        F.when(i % 5 == 0, "source_derived_question").otherwise("exact_question_mark_scheme_pair").alias("generation_provenance"),
        F.lit("qc").alias("question_chunk_id"), F.when(i % 7 != 0, "ac").alias("answer_chunk_id"),
        F.array(F.lit("t")).alias("source_validation_terms"), F.when(i % 3 != 0, "O_LEVEL").alias("level"),
    )


contracts_ref = "array<struct<document_id: string, page: int, chunk_id: string>>"
RECORDS = """
rec AS (SELECT CAST(doc_id // 2 AS VARCHAR) AS id, doc_id AS i, text, source AS category, CASE WHEN doc_id % 23 = 0 THEN '' ELSE lang END AS gold,
  ['REVIEWED','AUTO_VALIDATED_EXACT','AUTO_VALIDATED_CURRICULUM','DRAFT','REJECTED','OTHER'][doc_id % 6 + 1] AS status,
  CASE WHEN doc_id % 5 = 0 THEN 'source_derived_question' ELSE 'exact_question_mark_scheme_pair' END AS prov,
  CASE WHEN doc_id % 3 <> 0 THEN 'O_LEVEL' END AS level FROM documents),
chk AS (SELECT *, CASE WHEN status = 'OTHER' THEN 'INVALID_REVIEW_STATUS' WHEN trim(text) = '' OR gold = '' THEN 'EMPTY_QUESTION_OR_ANSWER'
  WHEN regexp_matches(text || gold, 'Ã[^\\n]|â€|ï¬|\\x{FFFD}') THEN 'CORRUPTED_TEXT'
  WHEN i % 6 < 3 AND i % 29 = 0 THEN 'NO_GROUND_TRUTH' WHEN i % 6 < 3 AND i % 19 = 0 THEN 'INCOMPLETE_GROUND_TRUTH'
  WHEN status = 'AUTO_VALIDATED_EXACT' AND prov <> 'exact_question_mark_scheme_pair' THEN 'EXACT_PAIR_PROVENANCE'
  WHEN status = 'AUTO_VALIDATED_EXACT' AND i % 7 = 0 THEN 'EXACT_PAIR_CHUNKS'
  WHEN status = 'AUTO_VALIDATED_CURRICULUM' AND prov <> 'source_derived_question' THEN 'CURRICULUM_PROVENANCE'
  WHEN i % 2 = 1 THEN 'DUPLICATE_ID' END AS reason FROM rec)
"""


@query("benchmark_validate", f"WITH {RECORDS} SELECT id, i AS line_no, reason IS NULL AS passed, reason FROM chk")
def benchmark_validate(spark: SparkSession, sf: str) -> DataFrame:
    out = contracts.benchmark_records(records(spark, sf))
    return out.select("id", "line_no", "outcome.passed", "outcome.reason")


@query("benchmark_status", f"""
WITH {RECORDS}, d AS (SELECT * FROM (VALUES ('REVIEWED', true), ('AUTO_VALIDATED_EXACT', true), ('AUTO_VALIDATED_CURRICULUM', true), ('DRAFT', false), ('REJECTED', false)) t(review_status, measurable))
SELECT review_status, count(i) AS records, measurable FROM d LEFT JOIN rec ON status = review_status GROUP BY ALL""")
def benchmark_status(spark: SparkSession, sf: str) -> DataFrame:
    return benchmark.status_counts(records(spark, sf), spark)


@query("benchmark_audit", f"""
WITH {RECORDS}
SELECT 'category' AS dimension, category AS label, count(*) AS records FROM rec GROUP BY ALL
UNION ALL SELECT 'level', coalesce(level, 'UNKNOWN'), count(*) FROM rec GROUP BY ALL
UNION ALL SELECT 'measurable', CASE WHEN i % 6 < 3 THEN 'measurable' ELSE 'other' END, count(*) FROM rec GROUP BY ALL
UNION ALL SELECT 'total', 'total', count(*) FROM rec""")
def benchmark_audit(spark: SparkSession, sf: str) -> DataFrame:
    return benchmark.audit(records(spark, sf))


PAIRS = f"""{Q.CHUNKS},
sch AS (SELECT subject_code, year, session, component, question_number, arg_max({{'c': chunk_id, 't': text}}, ord) AS s FROM chunks_t
   WHERE document_type = 'MARK_SCHEME' AND question_number IS NOT NULL GROUP BY ALL HAVING len({Q.words("arg_max(text, ord)")}) >= 4),
pairs AS (SELECT c.chunk_id, s.c AS answer_chunk_id, c.ord, c.text, c.level FROM chunks_t c JOIN sch USING (subject_code, year, session, component, question_number)
   WHERE c.document_type = 'QUESTION_PAPER' AND c.question_number IS NOT NULL)
"""


@query("exact_pairs", f"WITH {PAIRS} SELECT chunk_id AS question_chunk_id, answer_chunk_id, CAST(ord AS BIGINT) AS place FROM pairs")
def exact_pairs(spark: SparkSession, sf: str) -> DataFrame:
    out = benchmark.exact_pairs(A.chunks(spark, sf))
    return out.select(F.col("chunk_id").alias("question_chunk_id"), F.col("scheme.chunk_id").alias("answer_chunk_id"), F.col("ord").alias("place"))


@query("round_robin_sample", f"""
WITH {PAIRS}, r AS (SELECT chunk_id, level, row_number() OVER (PARTITION BY level ORDER BY ord) AS turn FROM pairs)
SELECT chunk_id, level, turn FROM r ORDER BY turn, level LIMIT 120""")
def round_robin_sample(spark: SparkSession, sf: str) -> DataFrame:
    out = benchmark.round_robin(benchmark.exact_pairs(A.chunks(spark, sf)), "level", "ord", 120)
    return out.select("chunk_id", "level", F.col("turn").cast("bigint").alias("turn"))


@query("first_per_page", f"""
WITH {Q.CHUNKS}
SELECT document_id, CAST(page_start AS BIGINT) AS page_start, min(chunk_id) AS chunk_id FROM chunks_t
WHERE document_type = 'TEXTBOOK' AND len({Q.words('text')}) >= 45 GROUP BY ALL""")
def first_per_page(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(benchmark.first_per_page(A.chunks(spark, sf)).select("document_id", "page_start", "chunk_id"))


GENERATED = 600
DIFFICULTY_SQL = f"""CASE WHEN {Q.word_test('query', 'evaluate|justify|analyse|complexity|recursive|normal form')} THEN 'ADVANCED'
  WHEN regexp_matches(query, '(?i)^\\s*(?:state|define|identify|name|what is)(?:{Q.EDGE}|$)') THEN 'BEGINNER' ELSE 'INTERMEDIATE' END"""


CURRICULUM = f"""
case_w AS (SELECT item_id, {Q.words('text')} AS ws FROM benchmark),
case_t AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'O_LEVEL' ELSE 'A_LEVEL' END AS level, array_to_string(ws[1:6], ' ') AS query,
  list_distinct({Q.tokens("array_to_string(ws[1:2], ' ')")}) AS terms FROM case_w),
variants_t AS (SELECT CAST(item_id AS VARCHAR) AS query_id, 1 AS variant, query AS vquery, level FROM case_t), {Q.SPARSE},
case_hits AS (SELECT c.item_id, k.chunk_id, k.document_id, k.page_start, s.rank, CASE
    WHEN k.document_type = 'TEXTBOOK' AND len(list_filter(c.terms, lambda t: NOT list_contains({Q.words("replace(lower(k.retrieval_text), '’', chr(39))")}, t))) = 0 THEN 1
    WHEN k.document_type = 'TEXTBOOK' AND len(list_filter(c.terms, lambda t: NOT list_contains({Q.tokens('k.retrieval_text')}, t))) = 0 THEN 2
    WHEN k.document_type = 'SYLLABUS' AND len(list_filter(c.terms, lambda t: NOT list_contains({Q.tokens('k.retrieval_text')}, t))) = 0 THEN 3 END AS kind
  FROM sparse_r s JOIN case_t c ON s.query_id = CAST(c.item_id AS VARCHAR) JOIN chunks_t k USING (chunk_id) WHERE rank <= 40),
case_best AS (SELECT * FROM case_hits WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY kind, rank) = 1)"""


def curriculum_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Every passage as a case: its first six words asked, the tokens of the first two required."""
    words = T.words("text")
    return A.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("case_id"), F.array_join(F.slice(words, 1, 6), " ").alias("query"),
        F.when(F.col("item_id") % 2 == 0, "O_LEVEL").otherwise("A_LEVEL").alias("level"),
        T.token_set(F.array_join(F.slice(words, 1, 2), " ")).alias("terms"),
    )


@query("curriculum_evidence", f"""
WITH {Q.CHUNKS}, {Q.INDEX}, {CURRICULUM}
SELECT item_id AS case_id, chunk_id, document_id, CAST(page_start AS BIGINT) AS page_start, CAST(kind AS BIGINT) AS kind FROM case_best""")
def curriculum_evidence(spark: SparkSession, sf: str) -> DataFrame:
    found = benchmark.curriculum_sources(curriculum_cases(spark, sf), settled_index(spark, sf, vectors=False))
    return rounded(found.withColumn("case_id", F.col("case_id").cast("bigint")))


@query("benchmark_generate", f"""
WITH {PAIRS}, {Q.INDEX}, {CURRICULUM},
cur AS (SELECT item_id, text AS query, CASE WHEN item_id % 2 = 0 THEN 'O_LEVEL' ELSE 'A_LEVEL' END AS level FROM benchmark JOIN case_best USING (item_id)),
s1 AS (SELECT 1 AS stratum, row_number() OVER (ORDER BY item_id) AS o, 0 AS n, query AS question, {Q.CATEGORY} AS category, {DIFFICULTY_SQL} AS difficulty, level FROM cur),
pq AS (SELECT p.ord, c.text AS query, c.level, row_number() OVER (ORDER BY p.ord) AS n, 'Answer ' || c.subject_code || '/' || c.component || '/' ||
    CASE c.session WHEN 'MJ' THEN 'M/J' WHEN 'ON' THEN 'O/N' WHEN 'FM' THEN 'F/M' ELSE c.session END || '/' || right(CAST(c.year AS VARCHAR), 2) ||
    ' Question ' || c.question_number || '.' || chr(10) || chr(10) || c.text AS question FROM pairs p JOIN chunks_t c USING (chunk_id)),
pc AS (SELECT *, {Q.CATEGORY} AS category, {DIFFICULTY_SQL} AS difficulty FROM pq),
pt AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY ord) AS turn FROM pc),
s2 AS (SELECT 2 AS stratum, row_number() OVER (ORDER BY turn, category) AS o, n, question, category, difficulty, level FROM pt),
pg AS (SELECT document_id, page_start, arg_min(text, chunk_id) AS text, arg_min(level, chunk_id) AS level FROM chunks_t
   WHERE document_type = 'TEXTBOOK' AND len({Q.words('text')}) >= 45 GROUP BY ALL),
sq AS (SELECT *, 'Explain ' || rtrim(left({Q.collapse('text')}, 80), ' .') || ' using the textbook evidence provided.' AS query FROM pg),
s3 AS (SELECT 3 AS stratum, row_number() OVER (ORDER BY document_id, page_start) AS o, 0 AS n, query AS question, {Q.CATEGORY} AS category, {DIFFICULTY_SQL} AS difficulty, level FROM sq),
al AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 WHERE o <= {GENERATED} UNION ALL SELECT * FROM s3),
po AS (SELECT *, row_number() OVER (ORDER BY stratum, o) AS position FROM al QUALIFY position <= {GENERATED})
SELECT CASE stratum WHEN 1 THEN 'CURRICULUM_' || printf('%03d', o) WHEN 2 THEN 'BENCH_' || printf('%04d', n) ELSE 'SOURCE_' || printf('%04d', position) END AS id,
  category, difficulty, level, stratum, position, md5(question) AS question_hash FROM po""")
def benchmark_generate(spark: SparkSession, sf: str) -> DataFrame:
    """Curriculum questions of the passages that have a source, exact pairs by turns, and textbook questions up to the target."""
    built = settled_index(spark, sf, vectors=False)
    chunks = built.chunks
    sources = benchmark.curriculum_sources(curriculum_cases(spark, sf), built).select(F.col("case_id").cast("bigint").alias("item_id"))
    pairs = benchmark.pair_records(benchmark.exact_pairs(chunks))
    asked = A.table(spark, sf, "benchmark").join(sources, "item_id", "left_semi").select(
        F.col("item_id").alias("place"), F.col("text").alias("query"), F.when(F.col("item_id") % 2 == 0, "O_LEVEL").otherwise("A_LEVEL").alias("level"),
        F.lit(None).cast("int").alias("exam_year"))
    curriculum = U.with_profile(asked).select(
        "place", F.col("query").alias("question"), F.col("profile.category").alias("category"), F.col("profile.difficulty").alias("difficulty"), "level")
    out = benchmark.generate(curriculum, pairs, chunks, GENERATED)
    return rounded(out.select("id", "category", "difficulty", "level", "stratum", "position", F.md5("question").alias("question_hash")))


# --- answers and citations ---------------------------------------------------------------------------------


@query("model_json_contract", """
WITH p AS (SELECT item_id, text, item_id % 6 AS k FROM benchmark)
SELECT item_id, CASE k WHEN 0 THEN 'NOT_THE_ANSWER_CONTRACT' WHEN 1 THEN 'EMPTY_ANSWER_OR_INVALID_KEYS' WHEN 2 THEN 'UNKNOWN_SOURCE_KEY'
  WHEN 3 THEN 'INLINE_SOURCE_LABEL' END AS reason, k NOT IN (0, 1, 2, 3) AS passed FROM p""")
def model_json_contract(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("item_id") % 6
    keys = F.when(k == 2, F.array(F.lit("S1"), F.lit("S9"))).otherwise(F.array(F.lit("S1"), F.lit("S2")))
    text = F.when(k == 1, "").when(k == 3, F.concat("text", F.lit(" [S1]"))).otherwise(F.col("text"))
    body = F.to_json(F.struct(text.alias("answer_markdown"), keys.alias("source_keys")))
    payload = F.when(k == 0, F.concat(F.lit("not json "), F.col("text"))).otherwise(body)
    known = F.array(F.lit("S1"), F.lit("S2"), F.lit("S3"))
    rows = A.table(spark, sf, "benchmark").select("item_id", F.explode_outer(F.array(contracts.model_output(payload, known))).alias("o"))
    return rows.select("item_id", "o.reason", "o.passed")


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """Events as answered questions with citations, retrieved and expected sources."""
    e = F.col("event_id")
    place = lambda page, shift: F.struct(F.concat(F.lit("d"), (e % 7 + shift).cast("string")).alias("document_id"), F.lit(1).alias(page), F.concat(F.lit("c"), (e % 7 + shift).cast("string")).alias("chunk_id"))
    empty = F.array().cast(contracts_ref)
    return A.table(spark, sf, "events").select(
        e.cast("string").alias("id"), F.when(e % 11 == 0, "").otherwise(F.col("props")).alias("answer"),
        F.when(F.col("event_type") == "error", "FAILED_GENERATION").otherwise("COMPLETED").alias("execution_status"),
        (F.col("event_type") == "error").alias("technical_failure"), F.col("value").alias("latency_ms"),
        F.get_json_object("props", "$.k").cast("int").alias("input_tokens"), F.lit(10).alias("output_tokens"),
        (F.col("value") / F.lit(1000.0)).alias("estimated_cost"),
        F.when(e % 5 == 0, empty).otherwise(F.array(place("page", 0), place("page", e % 3))).alias("citations"),
        F.array(place("page_start", 0), place("page_start", 1)).alias("retrieved"),
        F.array(place("page", 1), place("page", 2)).alias("expected_citations"), (e % 13 != 0).alias("sufficient"),
    )


CITED = """
ans AS (SELECT event_id AS e, event_type = 'error' AS failed, event_id % 11 = 0 AS blank, value,
   CAST(json_extract(props, '$.k') AS INTEGER) AS tok, CASE WHEN event_id % 5 = 0 THEN []::BIGINT[] ELSE list_distinct([event_id % 7, event_id % 7 + event_id % 3]) END AS cited,
   [event_id % 7, event_id % 7 + 1] AS seen, [event_id % 7 + 1, event_id % 7 + 2] AS expected FROM events),
cm AS (SELECT *, CASE WHEN len(cited) > 0 THEN len(list_intersect(cited, seen)) / len(cited)::DOUBLE END AS ident,
   CASE WHEN len(cited) > 0 THEN len(list_intersect(cited, expected)) / len(cited)::DOUBLE END AS prec, len(list_intersect(cited, expected)) / 2.0::DOUBLE AS cov FROM ans)
"""


@query("citation_metrics", f"""
WITH {CITED}
SELECT CAST(e AS VARCHAR) AS id, round(ident, 6) AS citation_identity_accuracy, round(prec, 6) AS citation_gold_precision, round(cov, 6) AS citation_coverage FROM cm""")
def citation_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluate.citation_metrics(_answers(spark, sf))
    return rounded(out.select("id", "citation_identity_accuracy", "citation_gold_precision", "citation_coverage"))


@query("answer_summary", f"""
WITH {CITED}
SELECT count(*) AS attempted_count, count(*) FILTER (NOT failed) AS completed_count, count(*) FILTER (failed) AS failure_count,
  round(avg((NOT failed)::INT), 6) AS coverage, round(avg(ident) FILTER (NOT failed), 6) AS citation_identity_accuracy,
  round(avg(prec) FILTER (NOT failed), 6) AS citation_gold_precision, round(avg(cov) FILTER (NOT failed), 6) AS citation_coverage,
  round(avg(failed::INT), 6) AS technical_failure_rate, CAST(sum(tok) AS BIGINT) AS total_input_tokens,
  CAST(count(*) * 10 AS BIGINT) AS total_output_tokens, round(sum(value / 1000.0), 6) AS estimated_cost FROM cm""")
def answer_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate.answer_summary(evaluate.citation_metrics(_answers(spark, sf))))


@query("response_contract", f"""
WITH {CITED}
SELECT CAST(e AS VARCHAR) AS id, CASE WHEN e % 13 = 0 THEN 'MISSING_CONTEXT' WHEN failed THEN 'GENERATION_NOT_COMPLETED' WHEN blank THEN 'EMPTY_ANSWER'
  WHEN len(list_filter(cited, lambda x: NOT list_contains(seen, x))) > 0 THEN 'INVALID_CITATION_IDENTITY' WHEN len(cited) = 0 THEN 'MISSING_CITATIONS' END AS reason FROM cm""")
def response_contract(spark: SparkSession, sf: str) -> DataFrame:
    checked = contracts.response(
        F.col("answer"), F.col("sufficient"), F.col("execution_status") == "COMPLETED", F.col("citations"), F.col("retrieved"), F.lit(True)
    )
    return _answers(spark, sf).select("id", checked["reason"].alias("reason"))


@query("failure_taxonomy", f"""
WITH {CITED},
f AS (SELECT e, CASE WHEN e % 17 = 0 THEN 'RETRIEVAL_EXECUTION_FAILURE' WHEN e % 4 = 0 THEN 'RETRIEVAL_RELEVANCE_FAILURE'
   WHEN failed THEN 'ANSWER_EXECUTION_FAILURE' WHEN ident < 1 THEN 'CITATION_IDENTITY_FAILURE' END AS failure_category FROM cm)
SELECT failure_category, count(*) AS failures FROM f WHERE failure_category IS NOT NULL GROUP BY 1""")
def failure_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    rows = evaluate.citation_metrics(_answers(spark, sf))
    e = F.col("id").cast("bigint")
    found = rows.select(
        "id", F.when(e % 17 == 0, "FAILED").otherwise("COMPLETED").alias("execution_status"),
        F.when(e % 4 == 0, 0.0).otherwise(1.0).alias("recall_at_10"), F.lit(None).cast("string").alias("error"),
    )
    answered = rows.withColumn("error", F.lit(None).cast("string"))
    return evaluate.failure_counts(evaluate.failures(rows.select("id"), found, answered))


@query("answer_log", f"""
WITH {CITED}
SELECT CAST(e AS VARCHAR) AS trace_id, 'd' || e % 7 || ', d' || (e % 7 + 1) AS retrieved_documents, '1' AS retrieved_pages,
  CASE WHEN e % 5 = 0 THEN '' ELSE 'd' || e % 7 || ' p.1; d' || (e % 7 + e % 3) || ' p.1' END AS citations, 'NOT_MEASURED' AS judge_status FROM cm""")
def answer_log(spark: SparkSession, sf: str) -> DataFrame:
    rows = _answers(spark, sf).select(
        "*", F.col("id").alias("trace_id"), F.lit(None).cast("timestamp").alias("timestamp"), F.lit("q").alias("question"),
        F.lit("CURRICULUM_EXPLANATION").alias("answer_type"), F.struct(F.lit("SQL").alias("category"), F.lit("BEGINNER").alias("difficulty")).alias("profile"),
        F.lit(True).alias("citation_valid"), F.lit(None).cast("double").alias("confidence"),
    )
    return answers.answer_log(rows).select("trace_id", "retrieved_documents", "retrieved_pages", "citations", "judge_status")


@query("judge_summary", """
SELECT count(*) AS scored_count, 1.0::DOUBLE AS coverage, round(avg(value) FILTER (event_id % 9 <> 0), 6) AS faithfulness,
  round(avg(value / 2), 6) AS context_recall FROM events""")
def judge_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Scores with gaps: every ninth faithfulness is not a number."""
    rows = A.table(spark, sf, "events").select(
        F.when(F.col("event_id") % 9 == 0, float("nan")).otherwise(F.col("value")).alias("faithfulness"), (F.col("value") / 2).alias("context_recall")
    )
    return rounded(evaluate.judge_summary(rows))


@query("question_report", f"""
WITH {CITED}
SELECT CAST(e AS VARCHAR) AS id, CASE WHEN failed THEN 'FAILED_GENERATION' ELSE 'COMPLETED' END AS execution_status,
  CASE WHEN failed OR e % 4 = 0 OR e % 17 = 0 OR ident < 1 THEN 'FAIL' ELSE 'PASS' END AS row_result, round(cov, 6) AS citation_coverage, value AS latency_ms,
  'd' || e % 7 AS retrieved_documents FROM cm""")
def question_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = evaluate.citation_metrics(_answers(spark, sf)).withColumn("error", F.lit(None).cast("string"))
    e = F.col("id").cast("bigint")
    found = rows.select(
        "id", F.when(e % 17 == 0, "FAILED").otherwise("COMPLETED").alias("execution_status"), "error", F.lit(None).cast("double").alias("latency_ms"),
        F.array(F.concat(F.lit("d"), (e % 7).cast("string"))).alias("retrieved_document_ids"), F.array(F.lit(1)).alias("retrieved_pages"),
        *[F.when(e % 4 == 0, 0.0).otherwise(1.0).alias(n) for n in ("precision_at_5", "recall_at_5", "recall_at_10", "reciprocal_rank", "ndcg_at_10")],
    )
    records_ = rows.select("id", F.lit("q").alias("question"), F.lit("SQL").alias("category"), F.lit("BEGINNER").alias("difficulty"), F.lit("g").alias("gold_answer"))
    judged = rows.select("id", F.lit(1.0).alias("faithfulness"))
    out = evaluate.question_report(records_, found, rows, judged, evaluate.failures(records_, found, rows))
    return rounded(out.select("id", "execution_status", "row_result", "citation_coverage", "latency_ms", "retrieved_documents"))


@query("usage_costs", """
WITH u AS (SELECT user_id, CAST(json_extract(props, '$.k') AS INTEGER) AS i FROM events)
SELECT user_id, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(i * 2) AS BIGINT) AS output_tokens,
  round(sum(round((i * 0.40::DOUBLE + i * 2 * 1.60::DOUBLE) / 1000000, 8)), 6) AS total_cost FROM u GROUP BY 1""")
def usage_costs(spark: SparkSession, sf: str) -> DataFrame:
    calls = A.traces(spark, sf).select(F.col("session_id").cast("bigint").alias("user_id"), "input_tokens", "output_tokens")
    return rounded(answers.usage_totals(calls, "user_id"))


@query("answer_segments", """
WITH s AS (SELECT c.conv_id, c.text AS first, d.text AS second FROM conversations c JOIN conversations d ON d.conv_id = c.conv_id AND d.turn = c.turn + 1
  WHERE c.role = 'user' AND d.role = 'assistant')
SELECT conv_id, 1 AS number, md5(first) AS answer_hash, count(*) AS n FROM s GROUP BY ALL UNION ALL SELECT conv_id, 2, md5(second), count(*) FROM s GROUP BY ALL""")
def answer_segments(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.exchanges(spark, sf)
    sheet = F.concat(F.lit("Question 1: "), T.strip("query"), F.lit("\nAnswer 9) skipped\nQ2. "), T.strip("answer"))
    found = rows.select(F.floor(F.col("position") / A.TURNS).alias("conv_id"), F.explode_outer(F.array(
        grading.extract_answers(sheet, F.array(F.lit(1), F.lit(2))))).alias("m"))
    pairs = found.select("conv_id", F.explode("m").alias("number", "text"))
    return pairs.groupBy("conv_id", "number", F.md5("text").alias("answer_hash")).agg(F.count("*").alias("n")).select(
        "conv_id", F.col("number").cast("int").alias("number"), "answer_hash", "n")


# --- ingestion ---------------------------------------------------------------------------------------------

TAGLESS = "regexp_replace(html, '<[^>]*>', ' ', 'g')"
CANDIDATES = f"""
cand AS (SELECT page_id, {TAGLESS} AS full_text, regexp_extract(html, '<title>([^<]*)', 1) AS title, regexp_extract(html, '<p>([^<]*)', 1) AS para FROM pages),
eng AS (SELECT page_id, page_id % 2 = 0 AS has_images, CASE WHEN page_id % 3 = 0 THEN full_text ELSE title END AS native,
   CASE WHEN page_id % 3 = 1 THEN para ELSE '' END AS secondary, CASE WHEN page_id % 4 = 0 THEN full_text ELSE '' END AS paddle, para AS tesseract FROM cand),
q1 AS (SELECT *, {quality_sql('native')} AS nq, {quality_sql('secondary')} AS sq, {quality_sql('paddle')} AS pq, {quality_sql('tesseract')} AS tq FROM eng),
q2 AS (SELECT *, (length({Q.strip('native')}) < 100 OR nq < 0.75) AND sq > nq AS second FROM q1),
q3 AS (SELECT *, CASE WHEN second THEN secondary ELSE native END AS cur, CASE WHEN second THEN sq ELSE nq END AS cq FROM q2),
q4 AS (SELECT *, (length({Q.strip('cur')}) < 100 OR cq < 0.75) AND has_images AS tried FROM q3),
q5 AS (SELECT *, CASE WHEN NOT tried THEN NULL WHEN {Q.strip('paddle')} <> '' AND (pq >= greatest(0.75, cq) OR {Q.strip('tesseract')} = '' OR pq >= tq) THEN 'paddle'
    WHEN {Q.strip('tesseract')} <> '' THEN 'tesseract' END AS engine FROM q4),
q6 AS (SELECT *, CASE engine WHEN 'paddle' THEN paddle WHEN 'tesseract' THEN tesseract END AS ocr, CASE engine WHEN 'paddle' THEN pq WHEN 'tesseract' THEN tq END AS oq FROM q5),
q7 AS (SELECT *, CASE WHEN ocr IS NOT NULL AND oq > cq THEN ocr ELSE cur END AS raw_text FROM q6)
"""


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    src = A.spread(A.table(spark, sf, "pages"))
    full, title = F.regexp_replace("html", "<[^>]*>", " "), F.regexp_extract("html", "<title>([^<]*)", 1)
    para = F.regexp_extract("html", "<p>([^<]*)", 1)
    i = F.col("page_id")
    row = lambda engine, text, confidence: F.struct(F.lit(engine).alias("engine"), text.alias("text"), F.lit(confidence).cast("double").alias("confidence"))
    options = F.array(
        row("native", F.when(i % 3 == 0, full).otherwise(title), None), row("secondary", F.when(i % 3 == 1, para).otherwise(""), None),
        row("paddle", F.when(i % 4 == 0, full).otherwise(""), 0.9), row("tesseract", para, 0.7),
    )
    return src.select(
        F.concat(F.lit("w"), F.floor(i / 10).cast("string")).alias("document_id"), i.alias("page_number"), (i % 2 == 0).alias("has_images"),
        F.explode_outer(options).alias("o"),
    ).select("document_id", "page_number", "has_images", "o.*")


@query("page_select", f"""
WITH {CANDIDATES}
SELECT page_id AS page_number, md5({Q.clean('raw_text')}) AS text_hash, second AS secondary_parser_used, tried AS ocr_attempted,
  tried AND coalesce(ocr, '') = raw_text AS ocr_used, engine AS ocr_engine FROM q7""")
def page_select(spark: SparkSession, sf: str) -> DataFrame:
    out = ingest.select_page_text(_candidates(spark, sf))
    return out.select("page_number", F.md5("clean_text").alias("text_hash"), "secondary_parser_used", "ocr_attempted", "ocr_used", "ocr_engine")


@query("document_rollup", f"""
WITH {CANDIDATES}
SELECT 'w' || (page_id // 10) AS document_id, count(*) AS page_count, bool_or({Q.strip('native')} <> '') AS native_text_available,
  coalesce(string_agg(CASE WHEN tried THEN CAST(page_id AS VARCHAR) END, ';' ORDER BY page_id), '') AS ocr_required_pages FROM q7 GROUP BY 1""")
def document_rollup(spark: SparkSession, sf: str) -> DataFrame:
    out = ingest.document_rollup(ingest.select_page_text(_candidates(spark, sf)))
    return out.drop("processing_status")


@query("extraction_coverage", f"""
WITH {CANDIDATES}, c AS (SELECT *, {quality_sql(Q.clean('raw_text'))} AS quality FROM q7)
SELECT count(DISTINCT page_id // 10) AS documents, count(*) AS expected_pages, count(*) AS extracted_pages, 1.0::DOUBLE AS coverage,
  round(avg((quality >= 0.75)::INT), 6) AS readable_page_rate, count(*) FILTER (tried) AS ocr_candidate_count,
  count(*) FILTER (tried AND coalesce(ocr, '') = raw_text) AS ocr_success_count,
  round(count(*) FILTER (tried AND coalesce(ocr, '') = raw_text) / greatest(1, count(*) FILTER (tried))::DOUBLE, 6) AS ocr_success_rate,
  count(*) FILTER (has_images) AS diagram_page_count, round(count(*) FILTER (has_images AND page_id % 4 = 0) / greatest(1, count(*) FILTER (has_images))::DOUBLE, 6) AS diagram_image_coverage FROM c""")
def extraction_coverage(spark: SparkSession, sf: str) -> DataFrame:
    pages = ingest.page_records(ingest.select_page_text(_candidates(spark, sf))).withColumn(
        "figure_path", F.when(F.col("page_number") % 4 == 0, F.lit("f.png")))
    documents = pages.groupBy("document_id").agg(F.count("*").alias("page_count"))
    return rounded(ingest.coverage(documents, pages))


RULES = (
    {"folder": "/en", "filename_contains": ["1", "2"], "expected_document_type": "TEXTBOOK", "level": "O_LEVEL", "subject_code": "2210"},
    {"folder": "/fr", "expected_document_type": "SYLLABUS", "level": "A_LEVEL", "subject_code": "9618"},
    {"folder": "example", "filename_contains": ["3"], "expected_document_type": "QUESTION_PAPER", "level": "O_LEVEL", "subject_code": "2210"},
)


@query("source_rules", """
WITH f AS (SELECT page_id, lower(url) AS u, regexp_extract(lower(url), '[^/]*$') AS n FROM pages)
SELECT page_id, CASE WHEN contains(u, '/en') AND (contains(n, '1') OR contains(n, '2')) THEN 'TEXTBOOK' WHEN contains(u, '/fr') THEN 'SYLLABUS'
  WHEN contains(u, 'example') AND contains(n, '3') THEN 'QUESTION_PAPER' ELSE 'UNKNOWN' END AS expected_document_type FROM f""")
def source_rules(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.table(spark, sf, "pages").select("page_id", "url", F.regexp_extract("url", r"[^/]*$", 0).alias("n"))
    return rows.select("page_id", ingest.source_for(F.col("url"), F.col("n"), RULES)["expected_document_type"].alias("expected_document_type"))


CLASSIFY = """
named AS (SELECT doc_id, source || '_' || doc_id || CASE doc_id % 6 WHEN 0 THEN '_mark_scheme_may' WHEN 1 THEN '-book' WHEN 2 THEN '_syllabus' ELSE '' END || '.pdf' AS filename,
  CASE doc_id % 7 WHEN 3 THEN 'Principal Examiner ' WHEN 4 THEN 'Question Paper 2210/12 May/June 2018 ' WHEN 5 THEN 'Mark Scheme 9618/21 October / November 2020 ' ELSE '' END || text AS body FROM documents),
typed AS (SELECT *, CASE WHEN contains(replace(lower(filename), '_', '-'), 'mark-scheme') THEN 'MARK_SCHEME' WHEN contains(lower(filename), 'syllabus') THEN 'SYLLABUS'
  WHEN contains(lower(filename), 'book') THEN 'TEXTBOOK' WHEN contains(b, 'examiner report') OR contains(b, 'principal examiner') THEN 'EXAMINER_REPORT'
  WHEN contains(b, 'mark scheme') OR contains(b, 'maximum raw mark') THEN 'MARK_SCHEME' WHEN contains(b, 'question paper') OR contains(b, 'answer all questions') OR contains(b, 'past paper') THEN 'QUESTION_PAPER'
  WHEN contains(b, 'syllabus') THEN 'SYLLABUS' WHEN contains(b, 'book') OR contains(b, 'computer science') THEN 'TEXTBOOK' ELSE 'UNKNOWN' END AS document_type
  FROM (SELECT *, lower(filename || ' ' || body || ' ') AS b FROM named))
"""


@query("document_identity", f"""
WITH {CLASSIFY},
v AS (SELECT *, lower(filename || ' ' || left(body, 5000)) AS val, regexp_replace(filename, '\\.[^.]*$', '') AS stem FROM typed),
m AS (SELECT *, TRY_CAST(regexp_extract(val, '\\b(20\\d{{2}})\\b', 1) AS BIGINT) AS year,
  CASE WHEN regexp_matches(val, 'may\\s*/\\s*june') THEN 'MJ' WHEN regexp_matches(val, 'february\\s*/\\s*march') THEN 'FM' WHEN regexp_matches(val, 'october\\s*/\\s*november') THEN 'ON' END AS session,
  coalesce(nullif(regexp_extract(val, '\\b(2210|9618)\\s*/\\s*(\\d{{2}})\\b', 2), ''), nullif(regexp_extract(val, '(?:paper|component)\\s*([123])\\b', 1), '')) AS component FROM v),
p AS (SELECT *, CASE WHEN document_type IN ('QUESTION_PAPER','MARK_SCHEME') AND year IS NOT NULL AND session IS NOT NULL AND component IS NOT NULL
   THEN '2210_' || session || '_' || year || '_' || component END AS exact_pair_id FROM m)
SELECT doc_id, document_type, year, session, component, exact_pair_id, CASE WHEN exact_pair_id IS NOT NULL THEN exact_pair_id || CASE document_type WHEN 'QUESTION_PAPER' THEN '_qp' ELSE '_ms' END
   ELSE 'o_level_' || regexp_replace(regexp_replace(lower(stem), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') END AS document_id FROM p""")
def document_identity(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    name = F.concat("source", F.lit("_"), i.cast("string"), F.when(i % 6 == 0, "_mark_scheme_may").when(i % 6 == 1, "-book").when(i % 6 == 2, "_syllabus").otherwise(""), F.lit(".pdf"))
    lead = F.when(i % 7 == 3, "Principal Examiner ").when(i % 7 == 4, "Question Paper 2210/12 May/June 2018 ").when(
        i % 7 == 5, "Mark Scheme 9618/21 October / November 2020 ").otherwise("")
    rows = A.spread(A.table(spark, sf, "documents").select("doc_id", "source", "text")).select("doc_id", name.alias("filename"), F.concat(lead, "text").alias("body"))
    typed = rows.select("*", F.explode_outer(F.array(ingest.document_type(F.col("filename"), F.col("body"), F.lit("")))).alias("document_type"))
    meta = ingest.document_metadata(F.col("filename"), F.col("body"), F.lit("O_LEVEL"), F.lit("2210"), F.col("document_type"))
    out = typed.select("doc_id", "document_type", F.explode_outer(F.array(meta)).alias("m")).select("doc_id", "document_type", "m.*")
    return rounded(out)
