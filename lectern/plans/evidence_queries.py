"""Topic evidence and slot queries over the adapted chunks; topics come from the benchmark passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import chunking, evidence
from lectern.plans import sql as Q
from lectern.plans.records_queries import rounded
from lectern.plans.registry import query
from lectern.sources import adapters as A


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Textbook pages are numbered after ten pages of front matter."""
    rows = chunking.indexable(A.chunks(spark, sf))
    return rows.withColumn("page_start", F.when(F.col("document_type") == "TEXTBOOK", F.col("page_start") + 10).otherwise(F.col("page_start") + 5))


def topics(spark: SparkSession, sf: str) -> DataFrame:
    item = F.col("item_id")
    long_words = F.array_sort(F.array_distinct(F.filter(
        F.transform(T.words("text"), lambda w: F.lower(F.regexp_replace(w, "[.,]+$", ""))), lambda w: F.length(w) > 5)))
    return A.table(spark, sf, "benchmark").select(
        F.concat(F.lit("t"), item.cast("string")).alias("topic_id"),
        F.array_join(F.slice(T.words("text"), 1, 6), " ").alias("name"),
        F.concat(F.lit("c"), F.floor(item / 5).cast("string")).alias("chapter_id"),
        F.array_join(F.slice(T.words("text"), 7, 6), " ").alias("chapter_name"),
        F.when(item % 2 == 0, "O_LEVEL").otherwise("A_LEVEL").alias("level"),
        (1 + item % 40).cast("int").alias("book_page_start"), (3 + item % 40).cast("int").alias("book_page_end"),
        F.when(item % 4 != 3, (11 + item % 3)).cast("int").alias("pdf_page_start"),
        F.when(item % 4 != 3, (13 + item % 3)).cast("int").alias("pdf_page_end"),
        long_words.alias("content_phrases"), long_words.alias("paper_phrases"), (item % 7 == 0).alias("strict_phrases"), "item_id",
    )


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """One request per benchmark item and level, over its own topic and the next one of the level."""
    rows = topics(spark, sf).select("topic_id", "level", "item_id")
    after = rows.select(F.col("topic_id").alias("_next"), (F.col("item_id") - 2).alias("item_id"))
    return rows.join(after, "item_id", "left").select(
        F.concat(F.lit("r"), F.col("item_id").cast("string")).alias("request_id"), "level",
        F.array_compact(F.array("topic_id", "_next")).alias("topic_ids"),
    )


LONG_WORDS = (f"list_sort(list_distinct(list_filter(list_transform({Q.words('text')}, "
              "lambda w: lower(regexp_replace(w, '[.,]+$', ''))), lambda w: length(w) > 5)))")
TOPICS_T = f"""SELECT 't' || item_id AS topic_id, item_id, CASE WHEN item_id % 2 = 0 THEN 'O_LEVEL' ELSE 'A_LEVEL' END AS level,
   CASE WHEN item_id % 4 <> 3 THEN 11 + item_id % 3 END AS p_from, CASE WHEN item_id % 4 <> 3 THEN 13 + item_id % 3 END AS p_to,
   {LONG_WORDS} AS phrases, item_id % 7 = 0 AS strict FROM benchmark"""


def scope_sql(topics_sql: str) -> str:
    return f"""{Q.CHUNKS},
ev AS (SELECT chunk_id, document_id, document_type, level, content_type, text, lower(text) AS low, token_count,
   page_start + CASE WHEN document_type = 'TEXTBOOK' THEN 10 ELSE 5 END AS page,
   lower(regexp_replace(left(text, 220), '{Q.WS}+', ' ', 'g')) AS opening FROM chunks_t WHERE content_type <> 'PARENT_CONTEXT'),
nav AS (SELECT *, list_distinct({Q.tokens('text')}) AS toks FROM ev WHERE NOT (contains(opening, 'contents') OR contains(opening, 'index') OR contains(opening, 'isbn')
   OR contains(opening, 'acknowledgements') OR contains(opening, 'endorsed for')) AND NOT (document_type = 'TEXTBOOK' AND page BETWEEN 1 AND 10)
   AND NOT (page <= 5 AND token_count < 180)),
topics_t AS ({topics_sql}),
pair AS (SELECT t.topic_id, t.phrases, t.strict, t.p_from, n.*,
   CAST(list_sum(list_transform(t.phrases, lambda p: least(5, (length(n.low) - length(replace(n.low, p, ''))) // length(p)))) AS BIGINT) AS exact,
   len(list_intersect(list_distinct(list_filter(flatten(list_transform(t.phrases, lambda p: {Q.tokens('p')})), lambda x: length(x) > 2)), n.toks)) AS shared,
   len(list_filter(t.phrases, lambda p: length(p) > 3 AND contains(regexp_replace(left(n.low, 240), '{Q.WS}+', ' ', 'g'), p))) > 0 AS heading,
   contains(n.low,'describe') OR contains(n.low,'explain') OR contains(n.low,'identify') OR contains(n.low,'write') OR contains(n.low,'state') OR contains(n.low,'complete') AS task
   FROM topics_t t JOIN nav n ON n.level = t.level AND n.document_type IN ('TEXTBOOK','QUESTION_PAPER')
     AND (n.document_type <> 'TEXTBOOK' OR t.p_from IS NULL OR n.page BETWEEN t.p_from AND t.p_to)),
scored AS (SELECT *, exact * 8.0 + shared + CASE WHEN heading THEN 5.0 ELSE 0.0 END + 2.0
     + CASE WHEN document_type = 'QUESTION_PAPER' AND task THEN 2.0 ELSE 0.0 END AS score FROM pair
   WHERE NOT (coalesce(exact, 0) = 0 AND (document_type = 'QUESTION_PAPER' OR (p_from IS NULL AND (strict OR shared < 1))))),
div1 AS (SELECT *, row_number() OVER (PARTITION BY topic_id, document_type, document_id, page ORDER BY score DESC, chunk_id) = 1 AS is_first FROM scored),
div_t AS (SELECT *, row_number() OVER (PARTITION BY topic_id, document_type ORDER BY is_first DESC, score DESC, chunk_id) AS place FROM div1)
"""


SCOPE = scope_sql(TOPICS_T)


@query("topic_evidence", f"""
WITH {SCOPE}
SELECT topic_id, chunk_id, document_type, round(score, 6)::DOUBLE AS score FROM scored""")
def topic_evidence(spark: SparkSession, sf: str) -> DataFrame:
    scored = evidence.topic_scores(topics(spark, sf), evidence.topic_index(chunks(spark, sf).filter(F.col("document_type").isin(*evidence.TOPICAL))))
    return rounded(scored.select("topic_id", "chunk_id", "document_type", "score"))


@query("diverse_topk", f"""
WITH {SCOPE}
SELECT topic_id, chunk_id, place, round(score, 6)::DOUBLE AS score FROM div_t WHERE document_type = 'TEXTBOOK' AND place <= 6""")
def diverse_topk(spark: SparkSession, sf: str) -> DataFrame:
    found = evidence.topic_candidates(topics(spark, sf), chunks(spark, sf), "TEXTBOOK")
    return rounded(evidence.diverse_top(found, ["topic_id"], 6).select("topic_id", "chunk_id", "place", "score"))


SYLLABUS_TOP = """
sy AS (SELECT level, chunk_id, text, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z]{3,}'), lambda x: lower(x))) AS terms FROM chunks_t
   WHERE document_type = 'SYLLABUS' AND content_type <> 'PARENT_CONTEXT'),
w AS (SELECT item_id, %s AS ws FROM benchmark),
tp AS (SELECT 't' || item_id AS topic_id, CASE WHEN item_id %% 2 = 0 THEN 'O_LEVEL' ELSE 'A_LEVEL' END AS level,
   array_to_string(ws[1:6], ' ') AS name, array_to_string(ws[7:12], ' ') AS chapter FROM w),
tt AS (SELECT topic_id, level, list_filter(list_distinct(list_transform(regexp_extract_all(name, '[A-Za-z]{3,}'), lambda x: lower(x))), lambda x: NOT list_contains(['and','the','for','with','its','use','uses','level','concept','concepts'], x)) AS a,
   list_filter(list_distinct(list_transform(regexp_extract_all(chapter, '[A-Za-z]{3,}'), lambda x: lower(x))), lambda x: NOT list_contains(['and','the','for','with','its','use','uses','level','concept','concepts'], x)) AS b FROM tp),
sc AS (SELECT topic_id, chunk_id, text, a, len(list_intersect(a, terms)) * 5 + len(list_intersect(b, terms)) AS score FROM tt JOIN sy USING (level) WHERE len(list_intersect(a, terms)) > 0),
top AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, chunk_id) AS place FROM sc QUALIFY place <= 3)""" % Q.words("text")


def merge_sql(scope: str) -> str:
    return f"""{scope}, {SYLLABUS_TOP},
syl AS (SELECT topic_id, list_sort(list(chunk_id)) AS ids FROM top GROUP BY 1),
req AS (SELECT 'r' || a.item_id AS request_id, a.level, CASE WHEN b.item_id IS NULL THEN [a.topic_id] ELSE [a.topic_id, b.topic_id] END AS topic_ids
   FROM topics_t a LEFT JOIN topics_t b ON b.item_id = a.item_id + 2),
sel AS (SELECT request_id, level, unnest(topic_ids) AS topic_id, unnest(range(0, len(topic_ids))) AS topic_pos,
   greatest(2, least(6, 18 // greatest(1, len(topic_ids)))) AS lim FROM req),
cmd AS (SELECT e.*, len(list_filter(['state','identify','describe','explain','complete','write','calculate','draw','suggest'],
     lambda c: regexp_matches(low, '(?:^|{Q.EDGE})' || c || '(?:{Q.EDGE}|$)'))) AS n_cmd FROM nav e WHERE document_type = 'QUESTION_PAPER'),
style1 AS (SELECT *, n_cmd * 4.0 + least(token_count, 180) / 180.0::DOUBLE AS score FROM cmd WHERE n_cmd > 0 AND token_count >= 12),
mark1 AS (SELECT *, CASE WHEN document_type = 'MARK_SCHEME' THEN 3.0 ELSE 2.0 END + least(token_count, 180) / 180.0::DOUBLE AS score
   FROM ev WHERE document_type IN ('MARK_SCHEME','EXAMINER_REPORT') AND token_count >= 8),
gen1 AS (SELECT 1 AS lane, level, chunk_id, document_id, page, score FROM style1 UNION ALL SELECT 2, level, chunk_id, document_id, page, score FROM mark1),
gen2 AS (SELECT *, row_number() OVER (PARTITION BY lane, level, document_id, page ORDER BY score DESC, chunk_id) = 1 AS is_first FROM gen1),
gen AS (SELECT *, row_number() OVER (PARTITION BY lane, level ORDER BY is_first DESC, score DESC, chunk_id) AS place FROM gen2
   QUALIFY place <= CASE lane WHEN 1 THEN 6 ELSE 4 END),
every AS (
  SELECT request_id, chunk_id, 0 AS lane, topic_pos, CASE document_type WHEN 'TEXTBOOK' THEN 0 ELSE 1 END AS step, place,
    CASE document_type WHEN 'TEXTBOOK' THEN 'TEXTBOOK_CONTENT' ELSE 'PAST_PAPER_STYLE' END AS role, topic_id, syl.ids AS syllabus
  FROM sel JOIN div_t USING (topic_id) LEFT JOIN syl USING (topic_id) WHERE place <= CASE document_type WHEN 'TEXTBOOK' THEN lim ELSE 2 END
  UNION ALL SELECT request_id, chunk_id, lane, 0, 0, place, CASE lane WHEN 1 THEN 'PAST_PAPER_STYLE' ELSE 'MARKING_PATTERN' END, NULL, NULL
  FROM req JOIN gen USING (level)),
merged AS (SELECT request_id, chunk_id, arg_min(role, {{'l': lane, 't': topic_pos, 's': step, 'p': place}}) AS role,
   min({{'l': lane, 't': topic_pos, 's': step, 'p': place}}) AS pos, list_sort(list_distinct(list(topic_id) FILTER (topic_id IS NOT NULL))) AS topic_ids,
   list_sort(list_distinct(flatten(list(syllabus) FILTER (syllabus IS NOT NULL)))) AS syllabus_ids FROM every GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY pos) AS position FROM merged)
"""


MERGE = merge_sql(SCOPE)


def built(spark: SparkSession, sf: str, asked: DataFrame, about: DataFrame) -> DataFrame:
    """Evidence of the requests with the syllabus excerpts of their topics."""
    rows = chunks(spark, sf)
    return evidence.build(asked, about, rows, evidence.syllabus_evidence(topics(spark, sf), rows))


@query("evidence_merge", f"""
WITH {MERGE}
SELECT request_id, chunk_id, role, position, coalesce(array_to_string(topic_ids, ','), '') AS topic_ids, coalesce(array_to_string(syllabus_ids, ','), '') AS syllabus_ids,
  md5(CASE WHEN role = 'PAST_PAPER_STYLE' THEN 'Cambridge question-style pattern. Command words: ' || coalesce(nullif(array_to_string(
     list_filter(['state','identify','describe','explain','complete','write','calculate','draw','suggest'],
     lambda c: regexp_matches(low, '(?:^|{Q.EDGE})' || c || '(?:{Q.EDGE}|$)')), ', '), ''), 'structured response') || '. Displayed marks: not parsed. '
     || 'Use only its command-word and response-shape pattern; its original subject matter is intentionally omitted.' ELSE text END) AS text_hash
FROM placed JOIN ev USING (chunk_id)""")
def evidence_merge(spark: SparkSession, sf: str) -> DataFrame:
    out = built(spark, sf, requests(spark, sf), topics(spark, sf))
    joined = [F.array_join(c, ",").alias(c) for c in ("topic_ids", "syllabus_ids")]
    return rounded(out.select("request_id", "chunk_id", "role", "position", *joined, F.md5("text").alias("text_hash")))


@query("evidence_lanes", f"""
WITH {MERGE}
SELECT request_id, count(*) FILTER (role = 'TEXTBOOK_CONTENT') AS textbook_chunks, count(*) FILTER (role = 'PAST_PAPER_STYLE') AS past_paper_chunks,
  count(*) FILTER (role = 'MARKING_PATTERN') AS marking_chunks, count(*) AS context_chunks FROM merged GROUP BY 1""")
def evidence_lanes(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evidence.lane_counts(evidence.build(requests(spark, sf), topics(spark, sf), chunks(spark, sf))))


@query("missing_topics", f"""
WITH {MERGE}, cov AS (SELECT request_id, role, unnest(topic_ids) AS topic_id FROM merged)
SELECT s.request_id, s.topic_id, r.role AS missing FROM sel s, (VALUES ('TEXTBOOK_CONTENT'), ('PAST_PAPER_STYLE')) r(role)
WHERE NOT EXISTS (SELECT 1 FROM cov c WHERE c.request_id = s.request_id AND c.topic_id = s.topic_id AND c.role = r.role)""")
def missing_topics(spark: SparkSession, sf: str) -> DataFrame:
    asked = requests(spark, sf)
    return evidence.missing_topics(asked, evidence.build(asked, topics(spark, sf), chunks(spark, sf)))


@query("catalog_readiness", f"""
WITH {MERGE}, cov AS (SELECT request_id, role, unnest(topic_ids) AS topic_id FROM merged),
miss AS (SELECT s.request_id, r.role FROM sel s, (VALUES ('TEXTBOOK_CONTENT'), ('PAST_PAPER_STYLE')) r(role)
  WHERE NOT EXISTS (SELECT 1 FROM cov c WHERE c.request_id = s.request_id AND c.topic_id = s.topic_id AND c.role = r.role)),
n AS (SELECT request_id, count(*) AS ctx FROM merged GROUP BY 1)
SELECT level, count(*) AS topics_checked, coalesce(max(ctx), 0) AS maximum_context_chunks,
  count(*) FILTER (request_id IN (SELECT request_id FROM miss WHERE role = 'PAST_PAPER_STYLE')) AS topics_without_topical_paper,
  count(*) FILTER (request_id IN (SELECT request_id FROM miss WHERE role = 'TEXTBOOK_CONTENT')) AS failing_topics
FROM req LEFT JOIN n USING (request_id) GROUP BY 1""")
def catalog_readiness(spark: SparkSession, sf: str) -> DataFrame:
    asked = requests(spark, sf)
    return evidence.catalog_readiness(asked, evidence.build(asked, topics(spark, sf), chunks(spark, sf)))


@query("slot_assignment", f"""
WITH {MERGE},
cat AS (SELECT request_id, list({{'k': 'S' || position, 'r': role, 't': coalesce(topic_ids, [])}} ORDER BY position) AS c FROM placed GROUP BY 1),
q AS (SELECT request_id, topic_ids, c, unnest(range(1, 9)) AS i FROM req JOIN cat USING (request_id)),
q2 AS (SELECT *, topic_ids[((i - 1) // 2 + CASE WHEN i % 2 = 0 THEN 1 ELSE 0 END) % len(topic_ids) + 1] AS topic FROM q),
q3 AS (SELECT *, list_filter(c, lambda x: x.r = 'TEXTBOOK_CONTENT' AND list_contains(x.t, topic)) AS book,
   list_filter(c, lambda x: x.r = 'PAST_PAPER_STYLE' AND list_contains(x.t, topic)) AS own, list_filter(c, lambda x: x.r = 'PAST_PAPER_STYLE') AS anyp FROM q2),
q4 AS (SELECT *, CASE WHEN len(own) > 0 THEN own ELSE anyp END AS paper FROM q3),
q5 AS (SELECT *, bool_or(len(book) = 0 OR (i % 2 = 0 AND len(paper) = 0)) OVER (PARTITION BY request_id)
   OR max(len(anyp)) OVER (PARTITION BY request_id) = 0 AS broken FROM q4)
SELECT request_id, i AS number, CASE WHEN i % 2 = 0 THEN 'PAST_PAPER' ELSE 'TEXTBOOK' END AS content_source, topic AS topic_id,
  CASE WHEN i % 2 = 0 THEN paper[(i - 1) % len(paper) + 1].k || ',' ELSE '' END || book[(i - 1) % len(book) + 1].k AS source_keys FROM q5 WHERE NOT broken""")
def slot_assignment(spark: SparkSession, sf: str) -> DataFrame:
    asked = requests(spark, sf)
    built = evidence.build(asked, topics(spark, sf), chunks(spark, sf))
    source = F.struct(F.concat(F.lit("S"), F.col("position").cast("string")).alias("source_key"), "role", "topic_ids")
    catalog = built.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("position", source.alias("s")))).alias("_c"))
    planned = asked.join(catalog, "request_id").select(
        "request_id",
        F.explode_outer(evidence.slots(F.lit(8), F.col("topic_ids"), F.col("_c.s"))).alias("slot"),
    ).filter(F.col("slot").isNotNull())
    return rounded(planned.select(
        "request_id", "slot.number", "slot.content_source", F.get("slot.topic_ids", F.lit(0)).alias("topic_id"),
        F.array_join("slot.source_keys", ",").alias("source_keys"),
    ))


@query("topic_ranges", """
WITH s AS (SELECT o_custkey AS chapter_id, o_orderkey AS place, CAST(floor(o_totalprice / 1000) AS BIGINT) AS page_start FROM orders)
SELECT chapter_id, place, page_start, greatest(page_start, coalesce(lead(page_start) OVER (PARTITION BY chapter_id ORDER BY place), 501) - 1) AS page_end FROM s""")
def topic_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Section ranges: customers as chapters, their orders as sections."""
    rows = A.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("chapter_id"), F.col("o_orderkey").alias("place"),
        F.floor(F.col("o_totalprice") / 1000).cast("bigint").alias("page_start"), F.lit(500).alias("chapter_end"),
    )
    return rounded(evidence.section_ranges(rows).drop("chapter_end"))


@query("syllabus_evidence", f"""
WITH {Q.CHUNKS}, {SYLLABUS_TOP}
SELECT topic_id, chunk_id, place, score, md5(substr(text, greatest(1, list_min(list_filter(list_transform(a, lambda t: position(t IN lower(text))), lambda p: p > 0)) - 140), 700)) AS excerpt_hash FROM top""")
def syllabus_evidence(spark: SparkSession, sf: str) -> DataFrame:
    found = evidence.syllabus_evidence(topics(spark, sf), chunks(spark, sf))
    return rounded(found.select("topic_id", "chunk_id", "place", "score", F.md5("excerpt").alias("excerpt_hash")))
