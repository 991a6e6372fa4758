"""Structured chunkers, Markdown blocks, snapshot, and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import markdown as M
from lectern.functions import text as T
from lectern.operators import chunking, context, index as indexing
from lectern.plans import sql as Q
from lectern.plans.records_queries import DIALOGUE_SQL, memory_rows, rounded
from lectern.plans.registry import query
from lectern.session import checkpoint_dir
from lectern.sources import adapters as A
from lectern.sources import io, snapshot
from lectern.streaming import memory as stream_memory_ops
from lectern.streaming import telemetry as stream_telemetry_ops


def scratch(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/lectern-{uuid.uuid4().hex}"


def _sentences(text):
    flat = T.collapse(text)
    return F.filter(F.split(flat, r"\. "), lambda s: s != "")


#: Page columns that no result here shows; chunkers write their pages with all columns they are given.
FLAGS = ("contains_code", "contains_table")


def labelled_pages(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """Pages whose sentences carry the labels of a ``kind``: every sentence of every page is kept."""

    def line(s, i):
        number = (F.floor(i / 3) + 1).cast("string")
        letter = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (i % 3 + 1).cast("int"))
        if kind == "QUESTION_PAPER":
            head = F.when(i % 3 == 0, F.concat(number, F.lit(" "))).otherwise(F.concat(F.lit("("), letter, F.lit(") ")))
            return F.concat(head, s, F.lit(" ["), (i % 4 + 1).cast("string"), F.lit("]"))
        if kind == "MARK_SCHEME":
            return F.concat(number, F.lit("("), letter, F.lit(")\n"), s)
        if kind == "SYLLABUS":
            return F.concat(number, F.lit("."), (i % 3 + 1).cast("string"), F.lit(" "), s)
        return F.concat(F.when(i % 3 == 0, F.concat(F.lit("Question "), number, F.lit(" "))).otherwise(""), s)

    pages = A.pages(spark, sf).drop(*FLAGS).filter(F.col("document_type") == kind)
    return pages.withColumn("clean_text", F.array_join(F.transform(_sentences(F.col("clean_text")), line), "\n"))


SECTIONS = """
lab AS (SELECT p.*, list_filter(string_split({flat}, '. '), lambda s: s <> '') AS ss FROM pages_t p WHERE document_type = '{kind}'),
lines AS (SELECT document_id, page_number, ord, unnest(ss) AS s, unnest(range(0, len(ss))) AS i FROM lab)
"""


@query("syllabus_sections", f"""
WITH {Q.PAGES}, {SECTIONS.format(flat=Q.collapse('clean_text'), kind='SYLLABUS')},
sec AS (SELECT document_id, page_number, i, s, (i // 3 + 1) || '.' || (i % 3 + 1) || ' ' || s AS t FROM lines),
k AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_number, i) AS sequence FROM sec WHERE {Q.token_count('t')} >= 18)
SELECT document_id, CAST(page_number AS BIGINT) AS page_start, sequence, md5(t) AS text_hash FROM k""")
def syllabus_sections(spark: SparkSession, sf: str) -> DataFrame:
    out = chunking.syllabus(labelled_pages(spark, sf, "SYLLABUS"))
    return rounded(out.select(
        "document_id", "page_start", (F.col("ord") % chunking.ORD_STRIDE).alias("sequence"), F.md5("text").alias("text_hash")
    ))


@query("examiner_sections", f"""
WITH {Q.PAGES}, {SECTIONS.format(flat=Q.collapse('clean_text'), kind='EXAMINER_REPORT')},
grp AS (SELECT document_id, page_number, i // 3 AS g, string_agg(s, chr(10) ORDER BY i) AS body FROM lines GROUP BY document_id, page_number, i // 3),
sec AS (SELECT *, 'Question ' || (g + 1) || ' ' || body AS t FROM grp),
k AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_number, g) AS sequence FROM sec WHERE {Q.token_count('t')} >= 25)
SELECT document_id, CAST(page_number AS BIGINT) AS page_start, sequence, regexp_extract(t, 'Question (\\d{{1,2}})', 1) AS question_number, md5({Q.strip('t')}) AS text_hash FROM k""")
def examiner_sections(spark: SparkSession, sf: str) -> DataFrame:
    out = chunking.examiner_report(labelled_pages(spark, sf, "EXAMINER_REPORT"))
    return rounded(out.select(
        "document_id", "page_start", (F.col("ord") % chunking.ORD_STRIDE).alias("sequence"), "question_number", F.md5("text").alias("text_hash")
    ))


def _parsed(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    out = chunking.assessment_entries(labelled_pages(spark, sf, kind), mark_scheme=kind == "MARK_SCHEME")
    return rounded(out.select(
        "chunk_id", "document_id", "page_start", "question_number", "marks", "maximum_marks", "relationship", F.md5("text").alias("text_hash"),
    ))


LETTERS = "len(regexp_extract_all({x}, '[A-Za-z]+'))"
NUMBER_PART = r"(?i)^\s*(\d{1,2})(?:\s*\(([a-z])\))?(?:\s*\(([ivx]+)\))?"
SUB_PART = r"(?i)^\s*\(([a-z])\)(?:\s*\(([ivx]+)\))?\s*(.*)$"
ROMAN_PART = r"(?i)^\s*\(([ivx]+)\)\s*(.*)$"


def entries_sql(kind: str, p: str) -> str:
    """Entries of papers or schemes, label by label, as ``{p}_entry``; ``{p}_`` marks the names of this kind."""
    scheme = kind == "MARK_SCHEME"
    number, letter = "(i // 3 + 1)", "['a','b','c'][i % 3 + 1]"
    if scheme:
        lines = f"[{number} || '(' || {letter} || ')', s]"
        label = NUMBER_PART + r"\s*$"
        useful, sub, roman, tail = "true", "false", "false", "''"
    else:
        lines = f"[CASE WHEN i % 3 = 0 THEN {number} || ' ' ELSE '(' || {letter} || ') ' END || s || ' [' || (i % 4 + 1) || ']']"
        label = NUMBER_PART + r"(?:\s+|\s*$)(.*)$"
        tail = Q.strip(f"regexp_extract(t, '{label}', 4)")
        useful = (f"regexp_extract(t, '{label}', 2) <> '' OR regexp_extract(t, '{label}', 3) <> '' OR {LETTERS.format(x='tail')} >= 3 "
                  f"OR regexp_matches(following, '{SUB_PART}') OR (tail = '' AND {LETTERS.format(x='following')} >= 3)")
        sub, roman = f"regexp_matches(t, '{SUB_PART}')", f"regexp_matches(t, '{ROMAN_PART}')"
    marks = r"(?i)\[\s*\d+\s*\]|\b\d+\s+marks?\b"
    content = "MARK_SCHEME_ENTRY" if scheme else "QUESTION"
    ahead = ", ".join(f"lead(t, {k}) OVER w AS t{k}" for k in (1, 2, 3))
    shown = ", ".join(f"nullif({Q.strip(f't{k}')}, '')" for k in (1, 2, 3))
    group = lambda pattern, i: f"nullif(lower(regexp_extract(t, '{pattern}', {i})), '')"
    return f"""
{p}_lab AS (SELECT p.*, list_filter(string_split({Q.collapse('clean_text')}, '. '), lambda s: s <> '') AS ss FROM pages_t p WHERE document_type = '{kind}'),
{p}_s AS (SELECT document_id, page_number, unnest(ss) AS s, unnest(range(0, len(ss))) AS i FROM {p}_lab),
{p}_l AS (SELECT document_id, page_number, unnest({lines}) AS raw, i * 2 + unnest(range(0, len({lines}))) AS line FROM {p}_s),
{p}_t AS (SELECT *, regexp_replace(raw, '{Q.WS}+$', '') AS t, row_number() OVER (PARTITION BY document_id ORDER BY page_number, line) AS gi FROM {p}_l),
{p}_a AS (SELECT *, {ahead} FROM {p}_t WINDOW w AS (PARTITION BY document_id ORDER BY gi)),
{p}_f AS (SELECT *, coalesce({shown}, '') AS following, {tail} AS tail FROM {p}_a),
{p}_k AS (SELECT *, CASE WHEN {sub} AND {roman} THEN 'B' WHEN {roman} THEN 'R' WHEN {sub} THEN 'S'
    WHEN regexp_matches(t, '{label}') AND CAST(regexp_extract(t, '{label}', 1) AS INTEGER) BETWEEN 1 AND 20 AND ({useful}) THEN 'N' END AS kind FROM {p}_f),
{p}_ev AS (SELECT document_id, page_number, gi, kind, row_number() OVER (PARTITION BY document_id ORDER BY gi) AS rn,
    CASE WHEN kind = 'N' THEN CAST(regexp_extract(t, '{label}', 1) AS INTEGER) END AS main, regexp_extract(t, '{label}', 1) AS number,
    CASE WHEN kind = 'N' THEN {group(label, 2)} ELSE {group(SUB_PART, 1)} END AS letter,
    CASE WHEN kind = 'N' THEN {group(label, 3)} ELSE {group(SUB_PART, 2)} END AS sub_roman, {group(ROMAN_PART, 1)} AS roman FROM {p}_k WHERE kind IS NOT NULL),
{p}_scan(document_id, rn, highest, letter, label, gi, page_number) AS (
  SELECT document_id, 0::BIGINT, 0, NULL::VARCHAR, NULL::VARCHAR, 0::BIGINT, 0 FROM {p}_ev GROUP BY 1
  UNION ALL
  SELECT e.document_id, e.rn, CASE WHEN e.kind = 'N' AND e.main IN (s.highest, s.highest + 1) THEN greatest(s.highest, e.main) ELSE s.highest END,
    CASE WHEN e.kind = 'N' AND e.main IN (s.highest, s.highest + 1) THEN e.letter
         WHEN s.highest > 0 AND (e.kind = 'S' OR (e.kind = 'B' AND s.letter IS NULL)) THEN e.letter ELSE s.letter END,
    CASE WHEN e.kind = 'N' AND e.main IN (s.highest, s.highest + 1) THEN e.number || coalesce('(' || e.letter || ')', '') || coalesce('(' || e.sub_roman || ')', '')
         WHEN s.highest > 0 AND s.letter IS NOT NULL AND e.kind IN ('B', 'R') THEN s.highest || '(' || s.letter || ')(' || e.roman || ')'
         WHEN s.highest > 0 AND e.kind IN ('B', 'S') THEN s.highest || '(' || e.letter || ')' || coalesce('(' || e.sub_roman || ')', '') END,
    e.gi, e.page_number
  FROM {p}_scan s JOIN {p}_ev e ON e.document_id = s.document_id AND e.rn = s.rn + 1),
{p}_span AS (SELECT *, coalesce(lead(gi) OVER (PARTITION BY document_id ORDER BY gi), 9223372036854775807) AS until FROM {p}_scan WHERE label IS NOT NULL),
{p}_text AS (SELECT x.document_id, x.gi, x.page_number, x.label, {Q.strip("string_agg(l.t, chr(10) ORDER BY l.gi)")} AS text
  FROM {p}_span x JOIN {p}_t l ON l.document_id = x.document_id AND l.gi >= x.gi AND l.gi < x.until GROUP BY ALL),
{p}_n AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY gi) AS sequence FROM {p}_text WHERE {Q.token_count('text')} >= 3),
{p}_entry AS (SELECT *, document_id || '_{content.lower()}_' || printf('%04d', sequence) || '_' || left(sha256(CAST(to_json({{'document_id': document_id,
    'page': page_number, 'sequence': sequence, 'text': text, 'type': '{content}'}}) AS VARCHAR)), 8) AS chunk_id,
  TRY_CAST(regexp_extract(regexp_extract_all(text, '{marks}')[-1], '(\\d+)', 1) AS BIGINT) AS marks, '{content}' AS content_type, '{kind}' AS document_type FROM {p}_n)"""


def parsed_sql(kind: str) -> str:
    marks, empty = ("maximum_marks", "marks") if kind == "MARK_SCHEME" else ("marks", "maximum_marks")
    relationship = "EXACT_MARK_SCHEME" if kind == "MARK_SCHEME" else "QUESTION_IDENTITY"
    return f"""WITH RECURSIVE {Q.PAGES}, {entries_sql(kind, "e")}
SELECT chunk_id, document_id, CAST(page_number AS BIGINT) AS page_start, label AS question_number, marks AS {marks}, NULL::BIGINT AS {empty},
  '{relationship}' AS relationship, md5(text) AS text_hash FROM e_entry"""


@query("paper_parse", parsed_sql("QUESTION_PAPER"))
def paper_parse(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(spark, sf, "QUESTION_PAPER")


@query("scheme_parse", parsed_sql("MARK_SCHEME"))
def scheme_parse(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(spark, sf, "MARK_SCHEME")


@query("corpus_build", f"""
WITH RECURSIVE {Q.chunks(360, 55)}, {entries_sql("QUESTION_PAPER", "q")}, {entries_sql("MARK_SCHEME", "m")},
sy_lab AS (SELECT p.*, list_filter(string_split({Q.collapse('clean_text')}, '. '), lambda s: s <> '') AS ss FROM pages_t p WHERE document_type = 'SYLLABUS'),
sy_lines AS (SELECT unnest(ss) AS s, unnest(range(0, len(ss))) AS i FROM sy_lab),
er_lab AS (SELECT p.*, list_filter(string_split({Q.collapse('clean_text')}, '. '), lambda s: s <> '') AS ss FROM pages_t p WHERE document_type = 'EXAMINER_REPORT'),
er_lines AS (SELECT doc_id, unnest(ss) AS s, unnest(range(0, len(ss))) AS i FROM er_lab),
every AS (
  SELECT document_type, content_type, text FROM chunks_t WHERE document_type = 'TEXTBOOK'
  UNION ALL SELECT 'SYLLABUS', 'LEARNING_OBJECTIVE', x FROM (SELECT (i // 3 + 1) || '.' || (i % 3 + 1) || ' ' || s AS x FROM sy_lines) WHERE {Q.token_count('x')} >= 18
  UNION ALL SELECT 'EXAMINER_REPORT', 'EXAMINER_COMMENT', x FROM (SELECT 'Question ' || (i // 3 + 1) || ' ' || string_agg(s, chr(10) ORDER BY i) AS x
    FROM er_lines GROUP BY doc_id, i // 3) WHERE {Q.token_count('x')} >= 25
  UNION ALL SELECT document_type, content_type, text FROM q_entry UNION ALL SELECT document_type, content_type, text FROM m_entry)
SELECT document_type, content_type, count(*) AS chunks, CAST(sum({Q.token_count('text')}) AS BIGINT) AS tokens FROM every GROUP BY ALL""")
def corpus_build(spark: SparkSession, sf: str) -> DataFrame:
    """All five chunkers over the labelled pages, with counts per type and content type."""
    kinds = ("SYLLABUS", "QUESTION_PAPER", "MARK_SCHEME", "EXAMINER_REPORT")
    pages = A.pages(spark, sf).drop(*FLAGS).filter(F.col("document_type") == "TEXTBOOK")
    for kind in kinds:
        pages = pages.unionByName(labelled_pages(spark, sf, kind))
    built = chunking.build(pages)
    return built.groupBy("document_type", "content_type").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))


@query("markdown_blocks")
def markdown_blocks(spark: SparkSession, sf: str) -> DataFrame:
    docs = A.spread(A.table(spark, sf, "documents").select("doc_id", "text"))
    out = M.blocks(docs, "doc_id", "text")
    return rounded(out.select("doc_id", "position", "type", F.md5(M.rendered()).alias("block_hash")))


@query("context_budget", f"""
WITH {Q.CHUNKS},
o AS (SELECT document_id, chunk_id, ord, text, length(text) AS len FROM chunks_t WHERE content_type <> 'PARENT_CONTEXT'),
r AS (SELECT *, coalesce(sum(least(len, 1800)) OVER (PARTITION BY document_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
   row_number() OVER (PARTITION BY document_id ORDER BY ord) AS rn FROM o)
SELECT document_id, chunk_id, 'S' || rn AS source_key, CAST(length(left(text, CAST(least(1800, 6000 - before) AS BIGINT))) AS BIGINT) AS chars FROM r WHERE before < 6000""")
def context_budget(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.search_chunks(spark, sf).select("document_id", "chunk_id", "ord", "text")
    out = context.source_catalog(rows, "document_id", "ord", maximum_chars=6_000)
    return out.select("document_id", "chunk_id", "source_key", F.length("text").cast("bigint").alias("chars"))


@query("cache_usage", """
WITH k AS (SELECT sha256('m' || chr(0) || text) AS key, count(*) AS n FROM documents GROUP BY 1),
c AS (SELECT DISTINCT sha256('m' || chr(0) || text) AS key FROM documents WHERE lang = 'en')
SELECT CAST(sum(n) FILTER (c.key IS NOT NULL) AS BIGINT) AS cache_hits, count(*) FILTER (c.key IS NULL) AS cache_misses FROM k LEFT JOIN c USING (key)""")
def cache_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Embedding cache that already holds the English documents."""
    from lectern.functions import hashing as H

    docs = A.table(spark, sf, "documents")
    cache = docs.filter(F.col("lang") == "en").select(H.cache_key("m", F.col("text")).alias("cache_key")).distinct().withColumn("model", F.lit("m"))
    return indexing.cache_usage(docs.select("text"), cache, "m")


@query("snapshot_publish", f"""
WITH {Q.CHUNKS}
SELECT document_type, count(*) AS chunks, count(DISTINCT document_id) AS documents FROM chunks_t GROUP BY 1""")
def snapshot_publish(spark: SparkSession, sf: str) -> DataFrame:
    """Stage and publish a build of the chunk corpus, then read it through the pointer."""
    root = scratch(spark)
    chunks = A.chunks(spark, sf, flags=True)
    build_id = snapshot.stage(spark, root, {"chunks": chunks}, {"source": sf, "schema": snapshot.SCHEMA_VERSION})
    stored = spark.read.parquet(f"{root}/build_id={build_id}/chunks")
    snapshot.publish(spark, root, build_id, {"postings": indexing.postings(stored)}, {"sparse": "bm25"})
    return snapshot.read(spark, root, "chunks").groupBy("document_type").agg(
        F.count("*").alias("chunks"), F.count_distinct("document_id").alias("documents")
    )


@query("ocr_review_packet", f"""
WITH {Q.PAGES}, q AS (SELECT document_id, page_number, CAST(length(raw_text) AS BIGINT) AS n FROM pages_t)
SELECT document_id, CAST(page_number AS BIGINT) AS page, n AS quality_score FROM q ORDER BY n, document_id, page_number LIMIT 50""")
def ocr_review_packet(spark: SparkSession, sf: str) -> DataFrame:
    """The fifty shortest pages as the ones to review."""
    pages = A.pages(spark, sf).withColumns({
        "ocr_attempted": F.lit(False), "ocr_engine": F.lit(None).cast("string"), "quality_score": F.length("raw_text").cast("bigint"),
    })
    return rounded(io.ocr_review(pages, 50).select("document_id", "page", "quality_score"))


# --- streams: the file source replays the given table, the result is read back from the sink ------------


@query("stream_memory", f"""
WITH {DIALOGUE_SQL},
s AS (SELECT *, list({{'n': n, 'q': query, 'a': left(answer, 1600), 'c': compact}}) OVER (PARTITION BY conversation_id ORDER BY n) AS hist,
  last_value(topic IGNORE NULLS) OVER (PARTITION BY conversation_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS active_topic FROM m)
SELECT conversation_id, n, active_topic,
  right(array_to_string(list_transform(list_filter(hist, lambda x: x.n <= gone), lambda x: x.c), ' | '), 2400) AS summary,
  2 * (n - gone) AS messages,
  md5(array_to_string(list_transform(list_filter(hist, lambda x: x.n > gone), lambda x: x.q || '/' || x.a), '|')) AS message_hash FROM s""")
def stream_memory(spark: SparkSession, sf: str) -> DataFrame:
    """The turns arrive in two files, answers before their questions, and some turns twice."""
    folder = scratch(spark)
    turns = A.table(spark, sf, "conversations").select(
        A.dialogue("conv_id").alias("conversation_id"), A.turn_position("conv_id", "turn").alias("position"), "role", F.col("text").alias("content"))
    turns.filter("role = 'assistant'").unionByName(turns.filter("position % 7 = 0")).write.mode("append").parquet(f"{folder}/inbox")
    turns.filter("role <> 'assistant'").write.mode("append").parquet(f"{folder}/inbox")
    stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/inbox")
    stream_memory_ops.write_states(stream, f"{folder}/rows", f"{folder}/state").awaitTermination()
    return memory_rows(stream_memory_ops.read_states(spark, f"{folder}/rows"))


DAILY = """
WITH v AS (SELECT event_id // 3 AS trace_id, arg_max(ts, event_id) AS ts, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value
  FROM events GROUP BY 1)
SELECT CAST(date_trunc('day', ts) AS VARCHAR)[1:10] AS day, event_type AS category, count(*) AS requests, count(*) FILTER (event_type = 'error') AS failures,
  round(avg(value), 6) AS average_latency_ms, round(sum(value / 1000.0), 6) AS total_cost FROM v GROUP BY ALL"""


def versions(spark: SparkSession, sf: str, folder: str, parts: tuple[str, ...]) -> DataFrame:
    """A stream of three versions of every trace, a batch for each of ``parts``: as many files as tasks write it."""
    traces = A.spread(A.table(spark, sf, "events")).select(
        F.floor(F.col("event_id") / 3).cast("string").alias("trace_id"), F.col("event_id").alias("version"), F.col("ts").cast("timestamp").alias("created_at"),
        F.col("event_type").alias("category"), (F.col("event_type") != "error").alias("success"), F.col("value").alias("latency_ms"),
        (F.col("value") / 1000.0).alias("total_cost"),
    )
    for part in parts:
        traces.filter(part).write.mode("append").parquet(f"{folder}/inbox")
    return spark.readStream.schema(traces.schema).option("maxFilesPerTrigger", traces.rdd.getNumPartitions()).parquet(f"{folder}/inbox")


@query("stream_telemetry", DAILY)
def stream_telemetry(spark: SparkSession, sf: str) -> DataFrame:
    """Two files, the later versions first; the last version counts."""
    folder = scratch(spark)
    stream = versions(spark, sf, folder, ("version % 2 = 1", "version % 2 = 0"))
    stream_telemetry_ops.write_traces(stream, f"{folder}/rows", f"{folder}/state").awaitTermination()
    rows = stream_telemetry_ops.daily(stream_telemetry_ops.read_traces(spark, f"{folder}/rows"))
    return rounded(rows.withColumn("day", F.col("day").cast("string")))


@query("stream_daily_totals", DAILY)
def stream_daily_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Totals written by the stream itself, from versions out of order and some of them twice."""
    folder = scratch(spark)
    stream = versions(spark, sf, folder, ("version % 3 = 1", "version % 3 = 2 AND version % 2 = 0", "version % 3 <> 2", "version % 3 = 2"))
    stream_telemetry_ops.write_daily(stream, f"{folder}/rows", f"{folder}/state").awaitTermination()
    rows = stream_telemetry_ops.read_daily(spark, f"{folder}/rows")
    return rounded(rows.withColumn("day", F.col("day").cast("string")))
