"""The registered queries of this folder, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import alignment, common, decontaminate, embeddings, language_id, licences, lm_score, minhash, packing, prefix_trie, secrets, suffix_dedup, token_counts, toxicity

SQL: dict[str, str] = {}


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeats(common.read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.read(spark, sf_dir, "documents"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(common.read(spark, sf_dir, "documents"))


def op4_product_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(common.read(spark, sf_dir, "embeddings"))


def op5_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    scored = lm_score.score(docs, docs.where(~lm_score.held_out()))
    return scored.withColumn("held_out", lm_score.held_out())


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(common.read(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s.kind == secrets.KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"),
        secrets.written(F.concat("base", "linked")).alias("spans"),
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"), toxicity.label_categories(), ["toxic"])


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.training_rows(docs)).withColumn("held_out", language_id.held_out())


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(common.read(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(common.read(spark, sf_dir, "conversations")).drop("hi", "lo")


def op12_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("matches", lambda m: m.kind == "base")
    places = F.transform(base, lambda m: m.first_word)
    return licences.scan(common.read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"), licences.labels(base).alias("base_labels"), licences.labels(F.col("matches")).alias("labels"),
        licences.freedom(F.col("matches")).alias("score"),
    )


def op13_merge_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(common.read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_packing": op2_packing,
    "op3_minhash": op3_minhash,
    "op4_product_quantisation": op4_product_quantisation,
    "op5_lattice_score": op5_lattice_score,
    "op6_secrets": op6_secrets,
    "op7_decontamination": op7_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_language": op9_language,
    "op10_token_counts": op10_token_counts,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_licences": op12_licences,
    "op13_merge_path": op13_merge_path,
    "pipeline": corpus_pipeline.run,
}

#: All pairs by shingle, and components by a recursive walk; the documents of one shingle meet in the join.
SQL["op3_minhash"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (SELECT doc_id, CASE WHEN ws IS NULL OR len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]) END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id,
  doc_id <= coalesce(m, doc_id) AS kept
FROM s LEFT JOIN low ON doc_id = a
"""

SQL["op4_product_quantisation"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
  AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n, 0) AS n_links, least(v.vec_id, coalesce(m, v.vec_id)) AS component_id,
  v.vec_id <= coalesce(m, v.vec_id) AS kept
FROM v LEFT JOIN low ON low.a = v.vec_id LEFT JOIN degree ON degree.a = v.vec_id
"""

#: The checksum is a fold over the digits' bits; subtree sums go to every prefix of the smallest member.
SQL["op11_prefix_trie"] = """
WITH t AS (SELECT conv_id, coalesce(text, '') AS x, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS s, turn
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, x, s, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, s) - 1 AS p FROM t),
c AS (SELECT conv_id AS c, count(*) AS n, conv_id - conv_id % 100 AS b,
  xor(list_reduce([4294967295::BIGINT] || flatten([[ascii(ch)::BIGINT] || [-1::BIGINT for _ in range(8)] for ch in string_split(conv_id::VARCHAR, '')]),
    lambda a, d: CASE WHEN d >= 0 THEN xor(a, d) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 6 AS h FROM o GROUP BY conv_id),
k AS (SELECT c.*, least(c.h, coalesce(base.n, 0)) AS k FROM c LEFT JOIN c base ON base.c = c.b),
r AS (SELECT k.c, o.p AS p, s, x FROM k JOIN o ON o.conv_id = k.b AND o.p < k.h
  UNION ALL SELECT k.c, o.p - k.h + k.k, s, x FROM k JOIN o ON o.conv_id = k.c AND o.p >= k.h),
m AS (SELECT c, p + 1 AS d, string_agg(s, '') OVER (PARTITION BY c ORDER BY p) AS path, length(x) AS chars FROM r UNION ALL SELECT c, 0, '', 0 FROM k),
depth AS (SELECT c, max(d) AS ends FROM m GROUP BY c),
node AS (SELECT d, path, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
  coalesce(string_agg(CASE WHEN d = ends THEN c::VARCHAR END, ',' ORDER BY c), '') AS ids FROM m JOIN depth USING (c) GROUP BY d, path),
child AS (SELECT d - 1 AS d, path[:-33] AS path, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
below AS (SELECT up.d, up.path, count(*) FILTER (WHERE child.n IS NULL) AS leaves, sum((node.n_convs - 1) * node.chars) AS saved
  FROM node LEFT JOIN child USING (d, path) JOIN m up ON up.c = node.conv_id AND up.d <= node.d GROUP BY up.d, up.path)
SELECT node.conv_id, node.d AS depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(child.n, 0) AS n_children, below.leaves AS n_leaves,
  CAST(below.saved AS BIGINT) AS saved_tokens, sha256(node.ids) AS ends_sha256
FROM node JOIN below USING (d, path) LEFT JOIN child USING (d, path) LEFT JOIN node up ON up.d = node.d - 1 AND up.path = node.path[:-33]
"""
