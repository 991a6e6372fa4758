"""Telemetry, memory, grading and evaluation queries."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import context, evaluate, grading, memory, search, skew, telemetry
from lectern.operators import index as indexing
from lectern.plans import retrieval
from lectern.plans import sql as Q
from lectern.plans.registry import query
from lectern.plans.retrieval_queries import settled_index
from lectern.sources import adapters as A

AS_OF = datetime(2024, 1, 31)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, integers widened, for value comparison."""
    out = []
    for name, kind in df.dtypes:
        if kind in ("double", "float") or kind.startswith("decimal"):
            out.append(F.round(F.col(name).cast("double"), places).alias(name))
        elif kind in ("int", "smallint"):
            out.append(F.col(name).cast("bigint").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


# --- telemetry -------------------------------------------------------------------------------------


@query("telemetry_summary", f"""
WITH {Q.TRACES}, w AS (SELECT * FROM traces_t WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY)
SELECT count(*) AS total_requests, count(DISTINCT session_id) AS active_sessions, round(avg(latency_ms), 6) AS average_latency_ms,
  round(avg(input_tokens + output_tokens), 6) AS average_tokens, round(avg(total_cost), 6) AS average_cost,
  round(sum(total_cost), 6) AS total_cost, round(sum(total_cost) / 30, 6) AS daily_cost, round(sum(total_cost) / 30 * 7, 6) AS weekly_cost,
  round(sum(total_cost) / 30 * 30, 6) AS monthly_projected_cost, round(avg(success::INT), 6) AS success_rate,
  round(1.0::DOUBLE - count(*) FILTER (failure_category = 'MISSING_CONTEXT') / count(*)::DOUBLE, 6) AS retrieval_success_rate,
  round(1.0::DOUBLE - count(*) FILTER (failure_category = 'INVALID_CITATION_IDENTITY') / count(*)::DOUBLE, 6) AS citation_identity_accuracy,
  round(avg(cache_hit::INT), 6) AS cache_hit_rate, CAST(30 AS BIGINT) AS window_days FROM w""")
def telemetry_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(telemetry.summary(A.traces(spark, sf), AS_OF, 30))


@query("telemetry_breakdown", f"""
WITH {Q.TRACES}, w AS (SELECT * FROM traces_t WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY),
s AS (SELECT 'failure' AS breakdown, coalesce(failure_category, 'NONE') AS label, total_cost FROM w
      UNION ALL SELECT 'category', coalesce(category, 'UNKNOWN'), total_cost FROM w
      UNION ALL SELECT 'model', coalesce(model, 'non_llm'), total_cost FROM w)
SELECT breakdown, label, count(*) AS requests, round(avg(total_cost), 6) AS mean_cost FROM s GROUP BY ALL""")
def telemetry_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(telemetry.breakdown(A.traces(spark, sf), AS_OF, 14))


@query("latest_trace", f"""
WITH {Q.TRACES}
SELECT session_id AS trace_id, arg_max(category, created_at) AS category, arg_max(latency_ms, created_at) AS latency_ms,
  arg_max(success, created_at) AS success FROM traces_t GROUP BY 1""")
def latest_trace(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated ids: here a session writes its trace again and again."""
    rows = A.traces(spark, sf).withColumn("trace_id", F.col("session_id"))
    return telemetry.latest(rows).select("trace_id", "category", "latency_ms", "success")


@query("latency_stats", """
SELECT count(*) AS count, round(median(value), 6) AS median_latency_ms,
  list_sort(list(value))[CAST(ceil(0.95 * count(*)) AS BIGINT)] AS p95_latency_ms, min(value) AS minimum_latency_ms,
  max(value) AS maximum_latency_ms, round(avg((event_type = 'error')::INT), 6) AS technical_failure_rate,
  round(sum(value / 1000.0), 6) AS estimated_cost FROM events""")
def latency_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.traces(spark, sf).select(
        "latency_ms", (~F.col("success")).alias("technical_failure"), F.col("total_cost").alias("estimated_cost")
    )
    return rounded(evaluate.latency(rows))


# --- memory ------------------------------------------------------------------------------------------

DIALOGUE_SQL = f"""{Q.EXCHANGES},
d AS (SELECT CAST(conv_id // {A.DIALOGUE} AS VARCHAR) AS conversation_id, conv_id * {A.TURNS} + turn AS position, query, answer,
        row_number() OVER (PARTITION BY conv_id // {A.DIALOGUE} ORDER BY conv_id, turn) AS n FROM ex_pairs),
m AS (SELECT *, CASE WHEN n <= 5 THEN 0 WHEN n % 2 = 0 THEN n - 4 ELSE n - 5 END AS gone,
        'user: ' || left({Q.collapse('query')}, 240) || ' | assistant: ' || left({Q.collapse('left(answer, 1600)')}, 240) AS compact,
        CASE WHEN {Q.token_count('query')} >= 3 THEN query END AS topic FROM d)"""


@query("memory_state", f"""
WITH {DIALOGUE_SQL},
s AS (SELECT *, list({{'n': n, 'q': query, 'a': left(answer, 1600), 'c': compact}}) OVER (PARTITION BY conversation_id ORDER BY n) AS hist,
  last_value(topic IGNORE NULLS) OVER (PARTITION BY conversation_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS active_topic FROM m)
SELECT conversation_id, n, active_topic,
  right(array_to_string(list_transform(list_filter(hist, lambda x: x.n <= gone), lambda x: x.c), ' | '), 2400) AS summary,
  2 * (n - gone) AS messages,
  md5(array_to_string(list_transform(list_filter(hist, lambda x: x.n > gone), lambda x: x.q || '/' || x.a), '|')) AS message_hash FROM s""")
def memory_state(spark: SparkSession, sf: str) -> DataFrame:
    out = memory.states(A.exchanges(spark, sf, folded=True), block=256)
    return memory_rows(out)


def memory_rows(out: DataFrame) -> DataFrame:
    """Memory states with their messages as one hash."""
    pairs = F.transform(
        F.sequence(F.lit(0), F.floor(F.size("recent_messages") / 2).cast("int") - 1),
        lambda i: F.concat(F.get("recent_messages", i * 2)["content"], F.lit("/"), F.get("recent_messages", i * 2 + 1)["content"]),
    )
    return out.select(
        "conversation_id", "n", "active_topic", "summary", F.size("recent_messages").cast("bigint").alias("messages"),
        F.md5(F.array_join(pairs, "|")).alias("message_hash"),
    )


@query("followup_rewrite", f"""
WITH {DIALOGUE_SQL},
s AS (SELECT *, last_value(topic IGNORE NULLS) OVER w AS before, lag(query) OVER (PARTITION BY conversation_id ORDER BY n) AS prior,
   {Q.word_test('query', 'it|that|this|those|these|the second point|the previous answer|same example|another example')}
   OR regexp_matches(query, '(?i)^\\s*(?:simplify|summari[sz]e|rewrite|convert|continue|what about|why|show another)(?:{Q.EDGE}|$)') AS dep
   FROM m WINDOW w AS (PARTITION BY conversation_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conversation_id, n, CASE WHEN dep AND coalesce(before, prior) IS NOT NULL
   THEN 'Previous topic: ' || coalesce(before, prior) || chr(10) || 'Current request: ' || {Q.strip('query')}
   ELSE {Q.strip('query')} END AS standalone_query FROM s""")
def followup_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    out = memory.rewritten(A.exchanges(spark, sf, folded=True), block=256)
    return out.select("conversation_id", "n", "standalone_query")


@query("relevant_history", f"""
WITH {DIALOGUE_SQL},
h AS (SELECT conversation_id, n, query, list({{'n': n, 'q': query, 'a': left(answer, 1600)}}) OVER
        (PARTITION BY conversation_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hist, gone FROM m),
e AS (SELECT conversation_id, n, {Q.tokens('query')} AS qt, unnest(list_filter(hist, lambda x: x.n > gone)) AS x, gone FROM h),
msgs AS (SELECT conversation_id, n, qt, x.q AS content, 2 * (x.n - gone) - 2 AS i, 2 * (n - gone) AS total FROM e
         UNION ALL SELECT conversation_id, n, qt, x.a, 2 * (x.n - gone) - 1, 2 * (n - gone) FROM e),
sc AS (SELECT *, row_number() OVER (PARTITION BY conversation_id, n ORDER BY
        len(list_intersect(list_distinct(qt), list_distinct({Q.tokens('content')}))) * 3 + (i + 1) / total::DOUBLE DESC, i DESC) AS rn FROM msgs)
SELECT conversation_id, n, count(*) AS kept, md5(string_agg(content, '|' ORDER BY i)) AS kept_hash FROM sc WHERE rn <= 4 GROUP BY ALL""")
def relevant_history(spark: SparkSession, sf: str) -> DataFrame:
    """Messages of the state after each exchange that matter for its own query."""
    state = memory.states(A.exchanges(spark, sf, folded=True), block=256)
    out = memory.relevant_messages(state, "query", "recent_messages")
    return out.select(
        "conversation_id", "n", F.size("relevant").cast("bigint").alias("kept"),
        F.md5(F.array_join(F.transform("relevant", lambda m: m["content"]), "|")).alias("kept_hash"),
    )


@query("memory_evaluation", f"""
WITH {Q.EXCHANGES},
r AS (SELECT conv_id * 1000 + turn AS id, query AS prior, 'Can you explain that more simply?' AS followup FROM ex_pairs),
w AS (SELECT *, 'Previous topic: ' || prior || chr(10) || 'Current request: ' || followup AS rewritten FROM r),
t AS (SELECT *, list_filter(list_distinct({Q.tokens('prior')}), lambda x: length(x) > 2) AS terms,
   greatest(0, length(rewritten) - length(followup)) / greatest(1, length(prior) + 23)::DOUBLE AS share FROM w)
SELECT count(*) AS scored_count, 'MEASURED' AS status,
  round(avg(len(list_intersect(terms, list_distinct({Q.tokens('rewritten')}))) / greatest(1, len(terms))::DOUBLE), 6) AS query_rewrite_accuracy,
  round(avg(len(list_intersect(terms, list_distinct({Q.tokens('rewritten')}))) / greatest(1, len(terms))::DOUBLE), 6) AS context_retention_accuracy,
  round(avg(share), 6) AS context_compression_ratio, round(avg(1 - least(1.0, share)), 6) AS token_savings FROM t""")
def memory_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.exchanges(spark, sf).select(
        F.col("position").alias("id"), F.col("query").alias("prior"),
        F.lit("Can you explain that more simply?").alias("followup"), F.col("query").alias("expected_topic"),
    )
    return rounded(memory.evaluation_summary(memory.evaluation_rows(rows)))


# --- grading -------------------------------------------------------------------------------------------


@query("grade_listing", f"""
WITH {Q.GRADES}
SELECT grade_id, o_orderkey AS submission_id, o_orderkey % 977 AS student_id, CAST(c_nationkey AS BIGINT) AS owner_id, ai_score, human_score,
  human_score IS NULL AS pending FROM grades_t JOIN orders ON o_orderkey = submission_id JOIN customer ON c_custkey = o_custkey""")
def grade_listing(spark: SparkSession, sf: str) -> DataFrame:
    rows = grading.listing(A.grades(spark, sf), A.submissions(spark, sf), A.grade_assessments(spark, sf))
    return rows.select("grade_id", "submission_id", "student_id", "owner_id", "ai_score", "human_score", "pending")


@query("newest_submissions", """
SELECT CAST(c_nationkey AS BIGINT) AS owner_id, o_orderkey AS submission_id, row_number() OVER (PARTITION BY c_nationkey
  ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders JOIN customer ON c_custkey = o_custkey QUALIFY place <= 20""")
def newest_submissions(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.submissions(spark, sf).join(A.grade_assessments(spark, sf).select("assessment_id", "owner_id"), "assessment_id")
    out = grading.newest_first(rows, 20, ["owner_id"], "submitted_at", "submission_id")
    return out.select("owner_id", "submission_id", F.col("place").cast("bigint").alias("place"))


@query("grade_agreement", f"""
WITH {Q.GRADES}
SELECT count(*) AS count, round(avg(abs(ai_score - human_score)), 4) AS mae, round(corr(ai_score, human_score), 4) AS pearson_correlation
FROM grades_t WHERE human_score IS NOT NULL""")
def grade_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return grading.agreement(A.grades(spark, sf))


def _reviews(spark: SparkSession, sf: str) -> DataFrame:
    line = F.col("ai_score").cast("bigint")
    return A.grades(spark, sf).select(
        "grade_id", (F.col("submission_id") % 25).alias("reviewer_id"), (F.col("ai_score") + 3).alias("human_score"),
        F.when(line % 2 == 0, F.lit("checked")).alias("comments"),
    )


@query("grade_review", f"""
WITH {Q.GRADES},
j AS (SELECT g.*, submission_id % 25 AS reviewer_id, ai_score + 3 AS review_score,
   CASE WHEN CAST(ai_score AS BIGINT) % 2 = 0 THEN 'checked' END AS review_comment, c_nationkey AS owner_id
   FROM grades_t g JOIN orders ON o_orderkey = submission_id JOIN customer ON c_custkey = o_custkey),
o AS (SELECT *, owner_id = reviewer_id AND review_score BETWEEN 0 AND max_score AS accepted FROM j)
SELECT grade_id, reviewer_id, ai_score, CASE WHEN accepted THEN review_score END AS human_score,
  CASE WHEN accepted THEN coalesce(review_comment, comments) ELSE comments END AS comments, accepted FROM o""")
def grade_review(spark: SparkSession, sf: str) -> DataFrame:
    return grading.apply_reviews(
        A.grades(spark, sf), _reviews(spark, sf), A.submissions(spark, sf), A.grade_assessments(spark, sf)
    )


@query("deletable_drafts", """
SELECT c_custkey AS assessment_id, CAST(c_nationkey AS BIGINT) AS owner_id FROM customer
WHERE c_custkey % 3 IN (0, 1) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')""")
def deletable_drafts(spark: SparkSession, sf: str) -> DataFrame:
    """Only orders still open (status O) count as submissions here; every customer has some order."""
    sent = A.table(spark, sf, "orders").filter(F.col("o_orderstatus") == "O").select(F.col("o_custkey").alias("assessment_id"))
    out = grading.deletable_drafts(A.grade_assessments(spark, sf), sent)
    return out.select("assessment_id", "owner_id")


@query("submission_rules", """
SELECT o_orderkey AS submission_id, c_custkey % 3 = 2 AS may_submit, c_nationkey = o_orderkey % 25 AS may_approve
FROM orders JOIN customer ON c_custkey = o_custkey""")
def submission_rules(spark: SparkSession, sf: str) -> DataFrame:
    assessments = A.grade_assessments(spark, sf)
    asked = A.submissions(spark, sf).select("submission_id", "assessment_id", (F.col("submission_id") % 25).alias("owner_id"))
    sent = grading.submittable(asked, assessments).withColumnRenamed("accepted", "may_submit")
    return grading.approvals(sent, assessments).select("submission_id", "may_submit", F.col("accepted").alias("may_approve"))


@query("role_counts", f"""
WITH {Q.GRADES}
SELECT (SELECT count(*) FROM nation) AS teachers, (SELECT count(*) FROM customer) AS students,
  (SELECT count(*) FROM customer WHERE c_custkey % 3 = 1) AS pending_assessments,
  (SELECT count(*) FROM grades_t WHERE human_score IS NULL) AS pending_grade_reviews""")
def role_counts(spark: SparkSession, sf: str) -> DataFrame:
    users = A.table(spark, sf, "nation").select(F.lit("teacher").alias("role")).unionAll(
        A.table(spark, sf, "customer").select(F.lit("student").alias("role"))
    )
    return grading.role_counts(users, A.grade_assessments(spark, sf), A.grades(spark, sf))


@query("draft_bounds", """
SELECT l_orderkey AS draft_id, round(sum(l_quantity), 6) AS total_score, CAST(sum(l_linenumber * 10) AS BIGINT) AS max_score,
  CASE WHEN bool_and(l_quantity BETWEEN 0 AND l_linenumber * 10) AND sum(l_quantity) BETWEEN 0 AND sum(l_linenumber * 10)
       THEN 'PENDING_TEACHER_REVIEW' ELSE 'INVALID_GENERATION' END AS status FROM lineitem GROUP BY 1""")
def draft_bounds(spark: SparkSession, sf: str) -> DataFrame:
    items = A.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("draft_id"), F.col("l_linenumber").alias("number"), F.col("l_quantity").alias("score"),
        (F.col("l_linenumber") * 10).cast("bigint").alias("marks"),
    )
    drafts = items.groupBy("draft_id").agg(F.sum("score").alias("total_score"))
    return rounded(grading.draft_bounds(items, drafts))


@query("score_file_quality", """
SELECT count(*) AS total_rows, count(TRY_CAST(l_returnflag AS DOUBLE)) AS valid_rows FROM (
  SELECT CASE WHEN l_returnflag = 'R' THEN 'bad' ELSE CAST(l_quantity AS VARCHAR) END AS l_returnflag FROM lineitem)""")
def score_file_quality(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.table(spark, sf, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", "bad").otherwise(F.col("l_quantity").cast("string")).alias("ai_score"),
        F.col("l_quantity").cast("string").alias("human_score"), F.col("l_orderkey").alias("line_no"),
    )
    return grading.score_file_quality(rows)[0]


# --- evaluation -----------------------------------------------------------------------------------------

DOCUMENT_HITS = f"""
doc_idx AS (SELECT 'd' || doc_id AS chunk_id, doc_id AS ord, {Q.tokens('text')} AS toks FROM documents),
post AS (SELECT chunk_id, ord, dl, term, count(*) AS tf FROM (SELECT chunk_id, ord, len(toks) AS dl, unnest(toks) AS term FROM doc_idx) GROUP BY ALL),
tdf AS (SELECT term, count(*) AS df FROM post GROUP BY 1), st AS (SELECT count(*) AS n, avg(len(toks)) AS average_length FROM doc_idx),
vt AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({Q.tokens('text')}) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT item_id, chunk_id, ord, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
     / (tf + 1.2 * (0.25 + 0.75 * dl / greatest(1.0, average_length)))), 9) AS score
   FROM vt JOIN post USING (term) JOIN tdf USING (term), st GROUP BY ALL),
hit AS (SELECT item_id, chunk_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, ord) AS rank FROM sc WHERE score <> 0 QUALIFY rank <= 10),
gold AS (SELECT item_id, 'd' || doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
ng AS (SELECT item_id, count(*) AS n_gold FROM gold GROUP BY 1),
cr AS (SELECT item_id, rank FROM hit SEMI JOIN gold USING (item_id, chunk_id)),
met AS (SELECT item_id, n_gold, count(*) FILTER (rank <= 5) / 5.0 AS p5, count(rank) / 10.0 AS p10,
   count(*) FILTER (rank <= 5) / n_gold::DOUBLE AS r5, count(rank) / n_gold::DOUBLE AS r10, coalesce(1.0 / min(rank), 0.0) AS rr,
   coalesce(sum(1 / log2(rank + 1)), 0) / list_sum(list_transform(range(1, least(10, n_gold) + 1), lambda i: 1 / log2(i + 1))) AS ndcg
   FROM ng LEFT JOIN cr USING (item_id) GROUP BY item_id, n_gold)
"""


def _document_hits(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """BM25 top ten documents per benchmark passage, and the documents that contain the passage."""
    docs = A.spread(A.table(spark, sf, "documents").select("doc_id", "text"))
    corpus = docs.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chunk_id"), F.col("doc_id").alias("ord"),
        F.lit("TEXTBOOK").alias("document_type"), F.lit(None).cast("string").alias("level"), F.lit("TEXT").alias("content_type"),
        F.lit(None).cast("string").alias("retrieval_text"), "text",
    )
    items = A.table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))
    packed = retrieval.settle(indexing.packed_postings(corpus))
    hits = search.bm25(items, indexing.of_packed(corpus, packed, indexing.packed_stats(corpus.select("content_type"), packed)), k=10)
    return hits.withColumns({"document_id": F.col("chunk_id"), "page_start": F.lit(1)}), _containing(items, corpus, hits)


def _containing(items: DataFrame, corpus: DataFrame, hits: DataFrame) -> DataFrame:
    """Gold: documents that contain a passage verbatim.

    A document can hold a passage only if it holds the rarest of its inner words, so candidates come from an
    equi-join on that word and the substring test runs on them alone.  What the items ask for travels to the documents,
    if it fits, and only documents that may be candidates are shuffled with their texts.
    """
    tokens = corpus.select("chunk_id", F.explode_outer(F.array_distinct(T.words("text"))).alias("word")).filter("word IS NOT NULL")
    frequency = tokens.groupBy("word").agg(F.count("*").alias("_df"))
    inner = F.slice(T.words("query"), 2, F.greatest(F.lit(1), F.size(T.words("query")) - 2))
    wanted = items.select("query_id", F.explode_outer(F.array_distinct(inner)).alias("word")).filter("word IS NOT NULL")
    asked = tokens.join(skew.maybe_broadcast(wanted.select("word").distinct()), "word", "left_semi").groupBy("word").agg(F.count("*").alias("_df"))
    rarest = asked.join(wanted, "word").groupBy("query_id").agg(F.min_by("word", F.struct("_df", "word")).alias("word"))
    # both words of a passage of one or two words may be parts of longer ones
    short = items.filter((F.size(T.words("query")) < 3) & (T.strip("query") != "")).select("query_id", F.get(T.words("query"), F.lit(0)).alias("_part"))
    if not short.isEmpty():
        rarest = rarest.unionByName(frequency.join(short, F.contains("word", "_part")).select("query_id", "word"))
    pairs = retrieval.settle(tokens.join(skew.maybe_broadcast(retrieval.settle(rarest)), "word").select("query_id", "chunk_id").distinct())
    texts = skew.narrowed(corpus.select("chunk_id", "text"), pairs, "chunk_id")
    held = pairs.join(items, "query_id").join(texts, "chunk_id").filter(F.contains("text", "query"))
    return held.select(
        "query_id", F.col("chunk_id").alias("document_id"), F.substring("chunk_id", 2, 20).cast("int").alias("ordinal"),
        F.lit(1).alias("page"), F.lit(1).alias("page_end"), "chunk_id", F.lit(None).cast("string").alias("parent_chunk_id"),
        F.lit("CHUNK").alias("policy"),
    )


@query("retrieval_quality", f"""
WITH {DOCUMENT_HITS}
SELECT CAST(item_id AS VARCHAR) AS query_id, n_gold, round(p5, 6)::DOUBLE AS precision_at_5, round(p10, 6)::DOUBLE AS precision_at_10,
  round(r5, 6) AS recall_at_5, round(r10, 6) AS recall_at_10, round(rr, 6)::DOUBLE AS reciprocal_rank, round(ndcg, 6) AS ndcg_at_10 FROM met""")
def retrieval_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: lexical index, BM25 top ten per passage, scored against the documents that hold it."""
    hits, gold = _document_hits(spark, sf)
    return rounded(evaluate.retrieval(hits, gold))


def _scheme_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Exact-scheme flags of every question; a scheme is available if the paper it names has one at all."""
    understood, chunks = retrieval.understand(A.questions(spark, sf)), A.chunks(spark, sf)
    paper = ("subject_code", "year", "session", "component")
    schemes = chunks.filter("document_type = 'MARK_SCHEME'").select(*paper).distinct().withColumn("exact_mark_scheme_available", F.lit(True))
    records = understood.select("query_id", *[F.col(f"profile.{c}").alias(c) for c in paper]).join(schemes, list(paper), "left")
    return evaluate.exact_scheme_rows(records, search.exact(understood, chunks))


SCHEME_FLAGS = f"""{Q.CHUNKS}, {Q.QUESTIONS}, {Q.PROFILE}, {Q.EXACT},
flags AS (SELECT query_id, EXISTS (SELECT 1 FROM chunks_t c WHERE c.document_type = 'MARK_SCHEME' AND c.subject_code = p.subject_code AND c.year = p.year
    AND c.session = p.session AND c.component = p.component) = EXISTS (SELECT 1 FROM exact_t e WHERE e.query_id = p.query_id AND e.document_type = 'MARK_SCHEME') AS correct
  FROM plan_t p)"""


@query("exact_scheme_flags", f"""
WITH {SCHEME_FLAGS} SELECT query_id, correct AS exact_scheme_correct FROM flags""")
def exact_scheme_flags(spark: SparkSession, sf: str) -> DataFrame:
    return _scheme_flags(spark, sf)


@query("quality_gates", f"""
WITH {DOCUMENT_HITS}, {SCHEME_FLAGS},
v AS (SELECT * FROM (SELECT 'benchmark_size' AS metric, count(*)::DOUBLE AS value FROM ng
  UNION ALL SELECT 'recall_at_5', round(avg(r5), 6) FROM met UNION ALL SELECT 'recall_at_10', round(avg(r10), 6) FROM met
  UNION ALL SELECT 'mrr', round(avg(rr), 6) FROM met UNION ALL SELECT 'ndcg_at_10', round(avg(ndcg), 6) FROM met
  UNION ALL SELECT 'exact_scheme_retrieval_accuracy', round(avg(correct::INT), 6) FROM flags
  UNION ALL SELECT 'median_latency_ms', median(value) FROM events UNION ALL SELECT 'p95_latency_ms',
     list_sort(list(value))[CAST(ceil(0.95 * count(*)) AS BIGINT)] FROM events
  UNION ALL SELECT 'technical_failure_rate', round(avg((event_type = 'error')::INT), 6) FROM events)),
g AS (SELECT * FROM (VALUES ('benchmark_size','>=',100.0),('recall_at_5','>=',0.9),('recall_at_10','>=',0.95),('mrr','>=',0.75),
  ('ndcg_at_10','>=',0.85),('exact_scheme_retrieval_accuracy','>=',0.98),('median_latency_ms','<=',5000.0),('p95_latency_ms','<=',10000.0),('technical_failure_rate','<=',0.01)) t(metric, operator, target))
SELECT metric, round(value, 6) AS value, operator, target::DOUBLE AS target, 'MEASURED' AS status,
  CASE operator WHEN '>=' THEN value >= target ELSE value <= target END AS passed FROM v JOIN g USING (metric)
UNION ALL SELECT metric, NULL, operator, target::DOUBLE, 'NOT_MEASURED', NULL FROM (VALUES ('retrieval_evaluation_coverage','>=',1.0),
  ('answer_evaluation_coverage','>=',1.0),('page_extraction_coverage','>=',0.99),
  ('citation_identity_accuracy','>=',1.0),('citation_coverage','>=',0.9),('metadata_accuracy','>=',0.98),('question_boundary_accuracy','>=',0.97),
  ('ocr_text_accuracy','>=',0.95),('judge_context_precision','INFORMATIONAL',NULL),('judge_context_recall','INFORMATIONAL',NULL),
  ('judge_faithfulness','INFORMATIONAL',NULL),('judge_answer_relevancy','INFORMATIONAL',NULL),('judge_answer_correctness','INFORMATIONAL',NULL),
  ('judge_noise_sensitivity','INFORMATIONAL',NULL)) t(metric, operator, target)""")
def quality_gates(spark: SparkSession, sf: str) -> DataFrame:
    hits, gold = _document_hits(spark, sf)
    scored = evaluate.retrieval(hits, gold).withColumn("execution_status", F.lit("COMPLETED"))
    summary = evaluate.retrieval_summary(scored).withColumn("benchmark_size", F.col("completed_count"))
    speed = evaluate.latency(A.traces(spark, sf).select(
        "latency_ms", (~F.col("success")).alias("technical_failure"), F.col("total_cost").alias("estimated_cost")))
    names = ("benchmark_size", "recall_at_5", "recall_at_10", "mrr", "ndcg_at_10")
    exact = _scheme_flags(spark, sf).agg(F.avg(F.col("exact_scheme_correct").cast("double")).alias("exact_scheme_retrieval_accuracy"))
    values = evaluate.summary_report(summary, names).unionByName(evaluate.summary_report(exact, exact.columns)).unionByName(
        evaluate.summary_report(speed, ("median_latency_ms", "p95_latency_ms", "technical_failure_rate"))
    )
    return rounded(evaluate.gates(values.select("metric", F.round("value", 6).alias("value"))))


POLICY_GOLD = """
held AS (SELECT q.query_id, q.item_id, c.document_id, c.page_start, c.chunk_id, c.parent_chunk_id, c.ord
  FROM questions_t q JOIN chunks_t c ON c.content_type <> 'PARENT_CONTEXT' AND contains(c.text, q.passage)),
gold_t AS (
  SELECT query_id, 'CHUNK' AS policy, document_id, page_start AS first, page_start AS last, chunk_id, parent_chunk_id, ord AS ordinal FROM held WHERE item_id % 2 = 1
  UNION ALL SELECT query_id, 'PAGE', document_id, min(page_start), max(page_start), NULL, NULL, min(ord) FROM held WHERE item_id % 2 = 0 GROUP BY query_id, document_id)"""


@query("retrieval_by_policy", f"""
WITH RECURSIVE {Q.CHUNKS}, {Q.INDEX}, {Q.QUESTIONS}, {Q.PROFILE}, {Q.VARIANTS}, {Q.SPARSE}, {POLICY_GOLD},
ten AS (SELECT s.query_id, s.chunk_id, s.rank, c.parent_chunk_id FROM sparse_r s JOIN chunks_t c USING (chunk_id) WHERE variant = 1 AND rank <= 10),
steps AS (SELECT query_id, chunk_id, rank, 0 AS step FROM ten UNION ALL SELECT query_id, parent_chunk_id, rank, 1 FROM ten WHERE parent_chunk_id IS NOT NULL),
hit AS (SELECT query_id, document_id, page_start, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, step) AS rank
  FROM (SELECT * FROM steps QUALIFY step = 0 OR row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY rank, step) = 1) JOIN chunks_t USING (chunk_id) QUALIFY rank <= 10),
met AS MATERIALIZED (SELECT h.query_id, h.rank, list(g.ordinal ORDER BY g.ordinal) AS os FROM hit h JOIN gold_t g ON g.query_id = h.query_id AND g.document_id = h.document_id
   AND CASE policy WHEN 'PAGE' THEN h.page_start BETWEEN g.first AND g.last ELSE h.chunk_id = g.chunk_id OR h.chunk_id = g.parent_chunk_id END GROUP BY ALL),
n AS MATERIALIZED (SELECT query_id, policy, count(*) AS n_gold FROM gold_t GROUP BY ALL),
walk(query_id, rank, taken, ranks) AS (
  SELECT query_id, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM n
  UNION ALL SELECT query_id, rank, CASE WHEN free IS NULL THEN taken ELSE list_append(taken, free) END, CASE WHEN free IS NULL THEN ranks ELSE list_append(ranks, rank) END
  FROM (SELECT w.query_id, w.rank + 1 AS rank, taken, ranks, list_filter(coalesce(os, []), lambda o: NOT list_contains(taken, o))[1] AS free
        FROM walk w LEFT JOIN met m ON m.query_id = w.query_id AND m.rank = w.rank + 1 WHERE w.rank < 10))
SELECT query_id, policy, n_gold, len(list_filter(ranks, lambda r: r <= 5)) / 5.0::DOUBLE AS precision_at_5, len(ranks) / 10.0::DOUBLE AS precision_at_10,
  round(len(list_filter(ranks, lambda r: r <= 5)) / n_gold::DOUBLE, 6) AS recall_at_5, round(len(ranks) / n_gold::DOUBLE, 6) AS recall_at_10,
  round(coalesce(1.0::DOUBLE / list_min(ranks), 0.0), 6) AS reciprocal_rank,
  round(coalesce(list_sum(list_transform(ranks, lambda r: 1 / log2(r + 1))), 0.0)
    / list_sum(list_transform(range(1, least(10, n_gold) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg_at_10
FROM walk JOIN n USING (query_id) WHERE rank = 10""")
def retrieval_by_policy(spark: SparkSession, sf: str) -> DataFrame:
    """Hits with their parents against gold chunks (odd items) or gold page ranges (even ones)."""
    questions, built = A.questions(spark, sf), settled_index(spark, sf, vectors=False)
    chunks, ids = built.chunks, built.packed.select(F.xxhash64("chunk_id"))
    if ids.distinct().count() < ids.count():  # the copies of a chunk count as one, with all their terms
        built = replace(built, packed=None)
    asked = retrieval.variants(retrieval.understand(questions)).filter("variant = 1")
    found = retrieval.settle(search.bm25(asked, built, k=evaluate.DEPTH).select("query_id", "chunk_id", F.col("rank").alias("position")))
    ten = chunks.select("chunk_id", "document_id", "page_start", "parent_chunk_id").join(found, "chunk_id").withColumn("relationship", F.lit(None).cast("string"))
    order = Window.partitionBy("query_id").orderBy("position", "step")
    hits = context.expand_parents(ten, chunks).withColumn("rank", F.row_number().over(order))
    children = indexing.chunking.indexable(chunks)
    held = _containing(questions.select("query_id", F.col("passage").alias("query")), children, found).select("query_id", "chunk_id")
    sources = held.join(children.select("chunk_id", "document_id", "page_start", "parent_chunk_id", "ord"), "chunk_id").join(
        questions.select("query_id", (F.col("item_id") % 2 == 0).alias("_paged")), "query_id")
    none = F.lit(None).cast("string")
    by_chunk = sources.filter(~F.col("_paged")).select(
        "query_id", "document_id", F.col("ord").alias("ordinal"), F.col("page_start").alias("page"), F.col("page_start").alias("page_end"),
        "chunk_id", "parent_chunk_id", F.lit("CHUNK").alias("policy"))
    by_page = sources.filter("_paged").groupBy("query_id", "document_id").agg(
        F.min("ord").alias("ordinal"), F.min("page_start").alias("page"), F.max("page_start").alias("page_end")
    ).select("*", none.alias("chunk_id"), none.alias("parent_chunk_id"), F.lit("PAGE").alias("policy"))
    gold = retrieval.settle(by_chunk.unionByName(by_page))
    policies = gold.groupBy("query_id").agg(F.min("policy").alias("policy"))
    return rounded(evaluate.retrieval(hits, gold).join(policies, "query_id"))


@query("source_recall", f"""
WITH {DOCUMENT_HITS}
SELECT CAST(item_id AS VARCHAR) AS query_id, count(rank) > 0 AS gold_source_recalled FROM ng LEFT JOIN cr USING (item_id) GROUP BY item_id""")
def source_recall(spark: SparkSession, sf: str) -> DataFrame:
    hits, gold = _document_hits(spark, sf)
    return evaluate.source_recall(hits, gold)


@query("review_accuracy", """
SELECT count(*) AS rows, count(*) AS reviewed_rows, round(avg(quality), 6) AS accuracy FROM labels""")
def review_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.table(spark, sf, "labels").select(
        F.col("quality").cast("string").alias("is_correct"), F.lit("r").alias("reviewer"), F.lit("2024-01-31").alias("reviewed_at")
    )
    return rounded(evaluate.review_accuracy(rows))
