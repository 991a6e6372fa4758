"""Indexing, search, fusion and context queries over the adapted chunks and questions."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import hashing as H
from lectern.functions import understanding as U
from lectern.operators import context, index as indexing, search
from lectern.plans import retrieval
from lectern.plans import sql as Q
from lectern.plans.registry import query
from lectern.sources import adapters as A

big = lambda name: F.col(name).cast("bigint").alias(name)


def settled_index(spark: SparkSession, sf: str, vectors: bool = True) -> indexing.Index:
    """The index with its base tables written once, for plans that read them several times."""
    unread = ("retrieval_text", "content_hash", "token_count", "contains_code", "contains_table", "contains_diagram", "figure_path")
    chunks = indexing.chunking.with_retrieval_text(retrieval.settle(A.chunks(spark, sf).drop(*unread)))
    packed = retrieval.settle(indexing.packed_postings(chunks))
    return indexing.of_packed(
        chunks, packed, retrieval.settle(indexing.packed_stats(chunks, packed)),
        retrieval.settle(indexing.packed_vectors(packed)) if vectors else None, H.HASH_MODEL,
    )


@query("corpus_stats", f"""
WITH {Q.CHUNKS}, {Q.INDEX}
SELECT term, df, n, round(average_length, 6) AS average_length FROM tdf, st""")
def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    words = retrieval.settle(indexing.vocabulary(A.chunks(spark, sf)))
    stats = indexing.summary(words)
    return words.filter("term IS NOT NULL").select(
        "term", "df", stats.select("n").scalar().alias("n"), F.round(stats.select("average_length").scalar(), 6).alias("average_length"),
    )


@query("query_profile", f"""
WITH {Q.QUESTIONS}, {Q.PROFILE}
SELECT query_id, category, subject_code, component, session, CAST(year AS BIGINT) AS year, question_number, level, multi_query,
  CAST(context_chunks AS BIGINT) AS context_chunks, CAST(context_chars AS BIGINT) AS context_chars,
  array_to_string(preferred_types, ',') AS preferred_types,
  CASE WHEN {Q.word_test('query', 'evaluate|justify|analyse|complexity|recursive|normal form')} THEN 'ADVANCED'
       WHEN regexp_matches(query, '(?i)^\\s*(?:state|define|identify|name|what is)(?:{Q.EDGE}|$)') THEN 'BEGINNER'
       ELSE 'INTERMEDIATE' END AS difficulty,
  CASE category WHEN 'EXAM_QUESTION' THEN 'EXAM_ANSWER' WHEN 'PROGRAMMING' THEN 'CODE_EXPLANATION' WHEN 'SQL' THEN 'CODE_GENERATION'
       ELSE 'CONCEPT_EXPLANATION' END AS intent,
  CASE category WHEN 'EXAM_QUESTION' THEN 0.99 WHEN 'THEORY' THEN 0.64 ELSE 0.82 END::DOUBLE AS confidence
FROM plan_t""")
def query_profile(spark: SparkSession, sf: str) -> DataFrame:
    p = A.profiled(A.questions(spark, sf))
    names = ("category", "subject_code", "component", "session", "question_number", "level", "difficulty", "intent")
    return p.select(
        "query_id", *[F.col(f"profile.{n}").alias(n) for n in names], F.col("profile.year").cast("bigint").alias("year"),
        F.col("profile.confidence").cast("double").alias("confidence"), "multi_query", big("context_chunks"),
        big("context_chars"), F.array_join("preferred_types", ",").alias("preferred_types"),
    )


@query("query_variants", f"""
WITH {Q.QUESTIONS}, {Q.PROFILE}, {Q.VARIANTS}
SELECT query_id, CAST(variant AS BIGINT) AS variant, vquery AS query, level FROM variants_t""")
def query_variants(spark: SparkSession, sf: str) -> DataFrame:
    understood = retrieval.understand(A.questions(spark, sf))
    return retrieval.variants(understood).select("query_id", big("variant"), "query", "level")


@query("corrective_query", f"""
WITH {Q.QUESTIONS}, {Q.PROFILE}
SELECT query_id, trim({Q._bare('please|could you|explain|describe|write|answer|question')} || ' ' || CASE category
  WHEN 'PROGRAMMING' THEN 'algorithm prerequisite steps pseudocode' WHEN 'SQL' THEN 'SQL syntax SELECT FROM WHERE example'
  WHEN 'COMPARISON' THEN 'definition differences advantages disadvantages' WHEN 'CALCULATION' THEN 'method formula worked example'
  ELSE 'definition explanation' END) AS corrected FROM plan_t""")
def corrective_query(spark: SparkSession, sf: str) -> DataFrame:
    p = A.profiled(A.questions(spark, sf))
    return p.select("query_id", U.corrective_query("query", F.col("profile.category")).alias("corrected"))


@query("bm25_topk", f"""
WITH {Q.CHUNKS}, {Q.INDEX}, {Q.QUESTIONS}, {Q.PROFILE}, {Q.VARIANTS}, {Q.SPARSE}
SELECT query_id, CAST(variant AS BIGINT) AS variant, chunk_id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM sparse_r""")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    asked = retrieval.variants(retrieval.understand(A.questions(spark, sf)))
    hits = search.bm25(asked, settled_index(spark, sf, vectors=False))
    return hits.select("query_id", big("variant"), "chunk_id", big("rank"), F.round("score", 6).alias("score"))


@query("hash_embedding", f"""
WITH cells AS ({Q.slots("(SELECT doc_id, unnest(" + Q.tokens('text') + ") AS term FROM documents)", "doc_id")})
SELECT doc_id, count(*) AS slots, CAST(sum(slot) AS BIGINT) AS slot_sum, round(sum(w / norm), 6) AS weight_sum,
  round(max(w / norm), 6) AS weight_max FROM cells GROUP BY 1""")
def hash_embedding(spark: SparkSession, sf: str) -> DataFrame:
    docs = A.spread(A.table(spark, sf, "documents").select("doc_id", "text"))
    add = lambda kind: lambda a, b: a + b.cast(kind)
    return H.hash_embedding(docs, "doc_id", "text").select(
        "doc_id",
        F.size("slots").cast("bigint").alias("slots"),
        F.aggregate("slots", F.lit(0).cast("bigint"), add("bigint")).alias("slot_sum"),
        F.round(F.aggregate("weights", F.lit(0.0), add("double")), 6).alias("weight_sum"),
        F.round(F.array_max("weights"), 6).alias("weight_max"),
    )


@query("dense_topk", f"""
WITH {Q.CHUNKS}, {Q.INDEX}, {Q.QUESTIONS}, {Q.PROFILE}, {Q.VARIANTS}, {Q.DENSE}
SELECT query_id, CAST(variant AS BIGINT) AS variant, chunk_id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM dense_r""")
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    asked = retrieval.hash_queries(retrieval.variants(retrieval.understand(A.questions(spark, sf))))
    hits = search.dense(asked, indexing.hash_vectors(A.chunks(spark, sf)))
    return hits.select("query_id", big("variant"), "chunk_id", big("rank"), F.round("score", 6).alias("score"))


@query("vector_neighbours", """
WITH parts AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings),
centre AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM parts GROUP BY ALL) GROUP BY 1),
scored AS (SELECT e.label, vec_id, round(list_dot_product(c, embedding::DOUBLE[])
    / sqrt(list_dot_product(c, c)) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 9) AS score
  FROM embeddings e JOIN centre USING (label))
SELECT CAST(label AS VARCHAR) AS query_id, 'v' || vec_id AS chunk_id, round(score, 6) AS score,
  row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM scored QUALIFY rank <= 80""")
def vector_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors closest to the centre of their own label."""
    src = A.table(spark, sf, "embeddings")
    label = F.col("label").cast("string")
    centre = (
        src.select(label.alias("label"), F.posexplode("embedding").alias("i", "x"))
        .groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
        .groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("cells"))
        .select(F.col("label").alias("query_id"), F.col("label").alias("level"), F.col("cells.m").alias("embedding"))
    )
    vectors = src.select(
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("chunk_id"), F.col("vec_id").alias("ord"),
        label.alias("level"), F.lit("VECTOR").alias("document_type"), "embedding",
    )
    hits = search.dense(centre, vectors)
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), big("rank"))


@query("exact_lookup", f"""
WITH {Q.CHUNKS}, {Q.QUESTIONS}, {Q.PROFILE}, {Q.EXACT}
SELECT query_id, chunk_id, document_type, CAST(page_start AS BIGINT) AS page_start, CAST(ord AS BIGINT) AS ord FROM exact_t""")
def exact_lookup(spark: SparkSession, sf: str) -> DataFrame:
    understood = retrieval.understand(A.questions(spark, sf))
    return search.exact(understood, A.chunks(spark, sf)).select(
        "query_id", "chunk_id", "document_type", big("page_start"), "ord"
    )


@query("rrf_fusion", f"""
WITH {Q.RETRIEVAL}
SELECT query_id, chunk_id, document_type AS chunk_type, round(rrf_score, 6) AS rrf_score, CAST(first_seen.l AS BIGINT) AS first_lane,
  CAST(first_seen.r AS BIGINT) AS first_rank FROM rrf_t""")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    understood = retrieval.understand(A.questions(spark, sf))
    fused = search.rrf(retrieval.rankings(understood, settled_index(spark, sf)))
    return fused.select(
        "query_id", "chunk_id", "chunk_type", F.round("rrf_score", 6).alias("rrf_score"),
        F.col("first_seen.lane").cast("bigint").alias("first_lane"), F.col("first_seen.rank").cast("bigint").alias("first_rank"),
    )


@query("hybrid_retrieve", f"""
WITH {Q.RETRIEVAL}
SELECT query_id, chunk_id, document_type AS chunk_type, route, CAST(place AS BIGINT) AS place, round(rrf_score, 6) AS rrf_score,
  CASE WHEN route = 'hybrid_rrf' THEN CASE document_type WHEN 'MARK_SCHEME' THEN 'ASSESSMENT_PATTERN'
     WHEN 'QUESTION_PAPER' THEN 'QUESTION_IDENTITY' ELSE 'CURRICULUM_EVIDENCE' END END AS relationship FROM cand_t""")
def hybrid_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    understood = retrieval.understand(A.questions(spark, sf))
    found = retrieval.candidates(understood, settled_index(spark, sf))
    return found.select(
        "query_id", "chunk_id", "chunk_type", "route", big("place"), F.round("rrf_score", 6).alias("rrf_score"), "relationship"
    )


@query("retrieval_diagnostics", f"""
WITH {Q.RETRIEVAL},
n AS (SELECT query_id, count(*) FILTER (lane = 0 AND variant = 1) AS sparse_1, count(*) FILTER (lane = 0 AND variant = 2) AS sparse_2,
  count(*) FILTER (lane = 1 AND variant = 1) AS dense_1, count(*) FILTER (lane = 1 AND variant = 2) AS dense_2 FROM both_r GROUP BY 1)
SELECT query_id, sparse_1, sparse_2, dense_1, dense_2, coalesce(n_exact, 0) AS exact_hits FROM n LEFT JOIN exact_n USING (query_id)""")
def retrieval_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    understood = retrieval.understand(A.questions(spark, sf))
    built = settled_index(spark, sf)
    return search.diagnostics(retrieval.rankings(understood, built), search.exact(understood, built.chunks))


def _ranked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, indexing.Index]:
    understood = retrieval.understand(A.questions(spark, sf))
    built = settled_index(spark, sf)
    found = retrieval.settle(retrieval.candidates(understood, built))
    return understood, retrieval.ranked(understood, found, built), built


@query("lexical_rerank", f"""
WITH {Q.RETRIEVAL}, {Q.RANKED}
SELECT query_id, chunk_id, route, CAST(position AS BIGINT) AS position, round(score, 6) AS score FROM ranked_t""")
def lexical_rerank(spark: SparkSession, sf: str) -> DataFrame:
    _, rows, _ = _ranked(spark, sf)
    return rows.select("query_id", "chunk_id", "route", big("position"), F.round("reranker_score", 6).alias("score"))


@query("coverage_check", f"""
WITH {Q.RETRIEVAL}, {Q.RANKED}
SELECT query_id, round(coalesce(coverage, 0.0), 6) AS evidence_coverage, coalesce(scheme, false) AS exact_scheme,
  coalesce(n_rows, 0) > 0 AND (coalesce(scheme, false) OR coalesce(coverage, 0.0) >= 0.2) AS sufficient
FROM plan_t LEFT JOIN cover_t USING (query_id)""")
def coverage_check(spark: SparkSession, sf: str) -> DataFrame:
    _, rows, _ = _ranked(spark, sf)
    return context.sufficiency(A.questions(spark, sf), rows)


@query("parent_expand", f"""
WITH {Q.RETRIEVAL}, {Q.RANKED},
steps AS (
  SELECT r.query_id, r.chunk_id, r.position, 0 AS step FROM ranked_t r
  UNION ALL SELECT r.query_id, c.parent_chunk_id, r.position, 1 FROM ranked_t r JOIN chunks_t c USING (chunk_id)
            JOIN chunks_t p ON p.chunk_id = c.parent_chunk_id AND p.content_type = 'PARENT_CONTEXT')
SELECT query_id, chunk_id, CAST(position AS BIGINT) AS position, CAST(step AS BIGINT) AS step FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY position, step) AS rn FROM steps) WHERE step = 0 OR rn = 1""")
def parent_expand(spark: SparkSession, sf: str) -> DataFrame:
    _, rows, built = _ranked(spark, sf)
    out = context.expand_parents(
        rows.select("query_id", "chunk_id", "position", "relationship", "parent_chunk_id", "text"), built.chunks
    )
    return out.select("query_id", "chunk_id", big("position"), big("step"))


@query("grounded_context", f"""
WITH RECURSIVE {Q.grounded()}
SELECT query_id, CAST(context_position AS BIGINT) AS context_position, chunk_id, document_id, document_type, CAST(page_start AS BIGINT) AS page_start,
  compressed, original AS original_chars, length(x.text) AS context_chars, md5(x.text) AS text_hash FROM context_t x JOIN chunks_t USING (chunk_id)""")
def grounded_context(spark: SparkSession, sf: str) -> DataFrame:
    """The whole path: two passes, parents, compression and budget."""
    rows, _ = retrieval.retrieve(A.questions(spark, sf), settled_index(spark, sf))
    return rows.select(
        "query_id", big("context_position"), "chunk_id", "document_id", "document_type", big("page_start"),
        "compressed", big("original_chars"), big("context_chars"), F.md5("text").alias("text_hash"),
    )


GUIDANCE = " mark scheme examiner report marking guidance"


GUIDED = Q.QUESTIONS.replace("questions_t AS (", "wording_t AS (") + f""",
questions_t AS (SELECT CAST(item_id AS VARCHAR) || '#1' AS query_id, item_id, passage, query || '{GUIDANCE}' AS query, NULL::VARCHAR AS level FROM wording_t)"""


@query("grading_evidence", f"""
WITH RECURSIVE {Q.grounded(GUIDED, 6)}
SELECT query_id, CAST(context_position AS BIGINT) AS context_position, chunk_id, document_type, compressed, md5(x.text) AS text_hash
FROM context_t x JOIN chunks_t USING (chunk_id) WHERE document_type IN ('MARK_SCHEME', 'EXAMINER_REPORT', 'QUESTION_PAPER')""")
def grading_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Marking evidence for every question as one that a submission answers."""
    asked = A.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("submission_id"), F.lit(1).alias("number"), A.question_text(F.col("item_id"), F.col("text")).alias("question"))
    rows = retrieval.grading_evidence(asked, settled_index(spark, sf))
    return rows.select("query_id", big("context_position"), "chunk_id", "document_type", "compressed", F.md5("text").alias("text_hash"))


ASSESSMENTS = ("MCQ", "STRUCTURED", "TRACE_TABLE")
LANES = f"""
questions_t AS (
  SELECT CAST(item_id AS VARCHAR) || '#' || lane AS query_id, item_id, text AS passage, query, CASE WHEN item_id % 3 = 0 THEN 'O_LEVEL' END AS level, wanted
  FROM (SELECT item_id, text, unnest([
      {{'lane': 'TEXTBOOK_CONTENT', 'query': text, 'wanted': 'TEXTBOOK'}},
      {{'lane': 'PAST_PAPER_STYLE', 'query': 'Cambridge Computer Science past paper question ' || text, 'wanted': 'QUESTION_PAPER'}},
      {{'lane': 'MARKING_PATTERN', 'query': 'Generate a Cambridge Computer Science ' || {list(ASSESSMENTS)}[item_id % 3 + 1]
          || ' using mark scheme marking criteria and answer quality patterns for ' || text, 'wanted': NULL}}], recursive := true) FROM benchmark))"""


@query("assessment_lanes", f"""
WITH RECURSIVE {Q.typed(Q.grounded(LANES))},
placed AS (SELECT split_part(query_id, '#', 1) AS request_id, split_part(query_id, '#', 2) AS lane, CAST(context_position AS BIGINT) AS context_position,
  chunk_id, document_type, md5(x.text) AS text_hash FROM context_t x JOIN chunks_t USING (chunk_id))
SELECT request_id, lane, CASE WHEN lane = 'MARKING_PATTERN' AND document_type = 'SYLLABUS' THEN 'CURRICULUM_SCOPE' ELSE lane END AS role,
  context_position, chunk_id, document_type, text_hash FROM placed
WHERE CASE lane WHEN 'TEXTBOOK_CONTENT' THEN document_type = 'TEXTBOOK' AND context_position <= 8
  WHEN 'PAST_PAPER_STYLE' THEN document_type = 'QUESTION_PAPER' AND context_position <= 10
  ELSE document_type IN ('MARK_SCHEME', 'EXAMINER_REPORT', 'SYLLABUS') END""")
def assessment_lanes(spark: SparkSession, sf: str) -> DataFrame:
    """Textbook, past-paper and marking evidence for an assessment on every benchmark passage."""
    item = F.col("item_id")
    requests = A.table(spark, sf, "benchmark").select(
        item.cast("string").alias("request_id"), F.col("text").alias("topic"),
        F.element_at(F.array(*[F.lit(a) for a in ASSESSMENTS]), (item % 3 + 1).cast("int")).alias("assessment_type"),
        F.when(item % 3 == 0, F.lit("O_LEVEL")).alias("level"))
    rows = retrieval.assessment_lanes(requests, settled_index(spark, sf))
    return rows.select("request_id", "lane", "role", big("context_position"), "chunk_id", "document_type", F.md5("text").alias("text_hash"))
