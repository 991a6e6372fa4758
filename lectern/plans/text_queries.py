"""Text, ingestion and chunking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import hashing as H
from lectern.functions import text as T
from lectern.operators import chunking
from lectern.plans import sql as Q
from lectern.plans.registry import query
from lectern.sources import adapters as A


@query("tokenize", f"""
SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_terms, md5(array_to_string(t, ' ')) AS token_hash
FROM (SELECT doc_id, {Q.tokens('text')} AS t FROM documents)""")
def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.spread(A.table(spark, sf, "documents")).select("doc_id", T.tokens("text").alias("t"))
    return rows.select(
        "doc_id",
        F.size("t").cast("bigint").alias("n_tokens"),
        F.size(F.array_distinct("t")).cast("bigint").alias("n_terms"),
        F.md5(F.array_join("t", " ")).alias("token_hash"),
    )


@query("clean_text", f"""
SELECT page_id, length(c) AS n_chars, md5(c) AS text_hash FROM (SELECT page_id, {Q.clean('html')} AS c FROM pages)
UNION ALL
SELECT -1 - doc_id AS page_id, length(c), md5(c) FROM (SELECT doc_id, {Q.clean('text')} AS c FROM documents)""")
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    html = A.spread(A.table(spark, sf, "pages")).select("page_id", T.clean_text("html").alias("c"))
    docs = A.spread(A.table(spark, sf, "documents")).select((-1 - F.col("doc_id")).alias("page_id"), T.clean_text("text").alias("c"))
    return html.unionByName(docs).select(
        "page_id", F.length("c").cast("bigint").alias("n_chars"), F.md5("c").alias("text_hash")
    )


@query("line_blocks", f"""
WITH {Q.PAGES},
lines AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(clean_text, chr(10)),
            lambda x: {Q.strip('x')}), lambda x: x <> '')) AS t FROM pages_t),
kinds AS (SELECT doc_id, CASE WHEN {Q.word_test('t', 'DECLARE|FOR|WHILE|IF|PROCEDURE|FUNCTION')} THEN 'CODE'
   WHEN length(t) < 120 AND ((regexp_matches(t, '\\p{{Lu}}') AND NOT regexp_matches(t, '[\\p{{Ll}}\\p{{Lt}}]'))
        OR regexp_matches(t, '^\\d+(\\.\\d+)*\\s')) THEN 'HEADING' ELSE 'PARAGRAPH' END AS block_type, t FROM lines)
SELECT doc_id, block_type, count(*) AS blocks, CAST(sum(length(t)) AS BIGINT) AS chars FROM kinds GROUP BY ALL""")
def line_blocks(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.pages(spark, sf).select("doc_id", F.explode(T.line_blocks("clean_text")).alias("b"))
    return rows.groupBy("doc_id", F.col("b.block_type").alias("block_type")).agg(
        F.count("*").alias("blocks"), F.sum(F.length("b.text")).alias("chars")
    )


QUALITY_SQL = (
    "CASE WHEN length({s}) = 0 THEN 0.0 ELSE round_even((length(regexp_replace({s}, "
    "'[^\\p{{L}}\\p{{N}}\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}.,:;()\\[\\]{{}}+\\-*/=<>\"''?!%&£#_]', '', 'g'))"
    " / CAST(length({s}) AS DOUBLE)) * least(length({s}) / 300.0, 1.0), 3) END"
)


def quality_sql(text: str) -> str:
    return QUALITY_SQL.format(s=Q.strip(text))


@query("page_quality", f"""
WITH {Q.PAGES}
SELECT doc_id, CAST(round({quality_sql('raw_text')}, 3) AS DOUBLE) AS quality_score,
  (length({Q.strip('raw_text')}) < 100 OR {quality_sql('raw_text')} < 0.75) AS needs_ocr,
  {Q.word_test('clean_text', 'DECLARE|PROCEDURE|FUNCTION|WHILE|FOR|SELECT|FROM')} AS contains_code,
  regexp_matches(clean_text, '(?:\\S+\\s{{3,}}){{2,}}|(?:^|{Q.EDGE})Table\\s+\\d+') AS contains_table
FROM pages_t""")
def page_quality(spark: SparkSession, sf: str) -> DataFrame:
    return A.pages(spark, sf).select(
        "doc_id",
        T.quality_score("raw_text").alias("quality_score"),
        T.needs_ocr("raw_text").alias("needs_ocr"),
        "contains_code",
        "contains_table",
    )


@query("text_hashes", f"""
SELECT doc_id, {Q.content_hash('text')} AS content_hash,
  left(sha256(CAST(to_json({{'lang': lang, 'source': source, 'text': text}}) AS VARCHAR)), 16) AS record_hash,
  trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS slug
FROM documents""")
def text_hashes(spark: SparkSession, sf: str) -> DataFrame:
    fields = {name: F.col(name) for name in ("text", "lang", "source")}
    return A.spread(A.table(spark, sf, "documents")).select(
        "doc_id",
        H.content_hash("text").alias("content_hash"),
        H.stable_hash(fields, 16).alias("record_hash"),
        T.slug("text").alias("slug"),
    )


@query("chunk_windows", f"""
WITH {Q.chunks(360, 55)}
SELECT chunk_id, document_id, CAST(page_start AS BIGINT) AS page_start, content_type, content_hash,
  CAST(token_count AS BIGINT) AS token_count, parent_chunk_id, md5(retrieval_text) AS text_hash, CAST(ord AS BIGINT) AS ord
FROM chunks_t WHERE document_type = 'TEXTBOOK'""")
def chunk_windows(spark: SparkSession, sf: str) -> DataFrame:
    pages = A.pages(spark, sf).filter(F.col("document_type") == "TEXTBOOK")
    return chunking.textbook(pages).select(
        "chunk_id", "document_id", F.col("page_start").cast("bigint").alias("page_start"), "content_type", "content_hash",
        F.col("token_count").cast("bigint").alias("token_count"), "parent_chunk_id",
        F.md5("retrieval_text").alias("text_hash"), "ord",
    )


@query("chunk_duplicates", f"""
WITH {Q.CHUNKS},
firsts AS (SELECT content_hash, min(ord) AS first_ord, arg_min(chunk_id, ord) AS duplicate_of FROM chunks_t
           GROUP BY 1 HAVING count(*) > 1)
SELECT chunk_id, duplicate_of FROM chunks_t JOIN firsts USING (content_hash) WHERE ord > first_ord""")
def chunk_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.duplicates(A.chunks(spark, sf))


@query("chunk_counts", f"""
WITH {Q.CHUNKS}
SELECT document_type AS measure, count(*) AS n FROM chunks_t GROUP BY 1
UNION ALL SELECT 'chunks', count(*) FROM chunks_t
UNION ALL SELECT 'dense_chunks', count(*) FROM chunks_t WHERE content_type <> 'PARENT_CONTEXT'
UNION ALL SELECT 'duplicate_chunks', count(*) - count(DISTINCT content_hash) FROM chunks_t""")
def chunk_counts(spark: SparkSession, sf: str) -> DataFrame:
    chunks = A.chunks(spark, sf)
    by_type = chunking.counts_by_type(chunks).select(F.col("document_type").alias("measure"), F.col("chunk_count").alias("n"))
    totals = chunking.totals(chunks).selectExpr(
        "stack(3, 'chunks', chunks, 'dense_chunks', dense_chunks, 'duplicate_chunks', duplicate_chunks) AS (measure, n)"
    )
    return by_type.unionByName(totals)
