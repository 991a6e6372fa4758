"""From questions to grounded context: classify, search, fuse, rerank, check, retry once, assemble."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import hashing as H
from lectern.functions import text as T
from lectern.functions import understanding as U
from lectern.operators import context, grading, search, skew
from lectern.operators.index import Index
from lectern.session import settled

MIN_RERANKED = 8
Embedder = Callable[[DataFrame], DataFrame]


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage into the cluster's shared folder, as a table whose readers take only the columns they use."""
    return settled(df, "retrieval")


def hash_queries(variants: DataFrame) -> DataFrame:
    """Query vectors of the hash embedding; a query without tokens has no vector."""
    keyed = variants.withColumn("_key", F.concat_ws("#", "query_id", F.col("variant").cast("string")))
    sparse = H.hash_embedding(keyed, "_key", "query")
    return keyed.join(sparse, "_key").drop("_key")


def understand(queries: DataFrame) -> DataFrame:
    """Profile and plan of every query (``query_id, query, level, exam_year, document_type``)."""
    return U.with_plan(U.with_profile(queries))


def variants(understood: DataFrame) -> DataFrame:
    texts = U.query_variants("query", F.col("profile.category"), F.col("multi_query"))
    return understood.select(
        "query_id", F.col("profile.level").alias("level"), "document_type", F.posexplode_outer(texts).alias("_pos", "query")
    ).filter(F.col("query").isNotNull()).select("query_id", (F.col("_pos") + 1).alias("variant"), "query", "level", "document_type")


def rankings(understood: DataFrame, index: Index, embedder: Embedder | None = hash_queries) -> DataFrame:
    """Sparse and dense rankings of every variant, one long table, each as deep as the query's plan says."""
    asked = variants(understood)
    columns = ["query_id", "variant", "lane", "chunk_id", "document_type", "rank", "score"]

    def to_depth(found: DataFrame, depth: str) -> DataFrame:
        planned = understood.select("query_id", F.col(depth).alias("_depth"))
        return found.select(*columns).join(planned, "query_id").filter(F.col("rank") <= F.col("_depth")).select(*columns)

    found = to_depth(search.bm25(asked, index, U.deepest("sparse_k")), "sparse_k")
    if index.vectors is not None and embedder is not None:
        found = found.unionByName(to_depth(search.dense(embedder(asked), index.vectors, U.deepest("dense_k")), "dense_k"))
    return found


def candidates(understood: DataFrame, index: Index, limit: int = search.FUSED_LIMIT, embedder: Embedder | None = hash_queries) -> DataFrame:
    """Fused candidates with exact paper rows first."""
    return search.fuse(
        understood.select("query_id", "document_type", "preferred_types"),
        rankings(understood, index, embedder),
        search.exact(understood, index.chunks),
        limit,
    )


def ranked(
    understood: DataFrame, found: DataFrame, index: Index, scorer: search.Scorer | None = None,
    maximum_chunks: int | None = None,
) -> DataFrame:
    """Exact rows in place, then the reranked rest; adds chunk text and routing columns.

    ``found`` is a table; only chunks that may be in it cross a shuffle, and they are written once for their readers.
    When an exact question is known its wording replaces the paper reference as the rerank query.
    """
    columns = ["document_id", "page_start", "text", "retrieval_text", "authority_level", "parent_chunk_id", "content_type"]
    rows = settle(skew.narrowed(index.chunks.select("chunk_id", *columns), found, "chunk_id").join(found, "chunk_id"))
    is_exact = F.col("route") == "exact_metadata"
    question = (
        rows.filter(is_exact & (F.col("chunk_type") == "QUESTION_PAPER"))
        .groupBy("query_id")
        .agg(F.min_by("text", "place").alias("_question"))
    )
    depth = F.lit(maximum_chunks) if maximum_chunks else F.col("context_chunks")
    asked = understood.select("query_id", "query", F.greatest(depth, F.lit(MIN_RERANKED)).alias("_k"))
    semantic = (
        rows.filter(~is_exact)
        .join(asked, "query_id")
        .join(question, "query_id", "left")
        .withColumn("rerank_query", F.coalesce(T.non_blank("_question"), F.col("query")))
        .withColumn("passage", F.coalesce(T.non_blank("retrieval_text"), F.col("text")))
    )
    best = search.rerank(semantic, F.col("_k"), scorer)
    exact_count = found.filter(is_exact).groupBy("query_id").agg(F.count("*").alias("_exact"))
    keep = ["query_id", "chunk_id", "chunk_type", "route", "relationship", *columns]
    after = best.join(exact_count, "query_id", "left").select(
        *keep, "reranker_score", (F.coalesce("_exact", F.lit(0)) + F.col("rerank_rank")).cast("int").alias("position")
    )
    first = rows.filter(is_exact).select(
        *keep, F.lit(None).cast("double").alias("reranker_score"), F.col("place").cast("int").alias("position")
    )
    return first.unionByName(after)


def retrieve(
    queries: DataFrame, index: Index, scorer: search.Scorer | None = None, compress: bool = True,
    maximum_chunks: int | None = None, embedder: Embedder | None = hash_queries,
) -> tuple[DataFrame, DataFrame]:
    """``(context rows, per-query report)`` after at most one corrective pass.

    Pass two sees only the queries whose evidence was insufficient.  Both passes' ranked rows (at most
    a few dozen per query) are checkpointed, because three consumers read them.
    """

    def one_pass(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        understood = understand(asked)
        found = settle(candidates(understood, index, embedder=embedder))
        rows = settle(ranked(understood, found, index, scorer, maximum_chunks))
        report = understood.join(context.sufficiency(asked, rows), "query_id")
        return rows, settle(report.select("query_id", "query", "document_type", "profile", "context_chunks",
                                          "context_chars", "level", "exam_year", "evidence_coverage", "exact_scheme",
                                          "sufficient"))

    rows, report = one_pass(queries)
    weak = report.filter(~F.col("sufficient"))
    again = weak.select(
        "query_id", U.corrective_query("query", F.col("profile.category")).alias("query"), "level", "exam_year",
        "document_type",
    )
    rows_2, report_2 = one_pass(again)
    kept = rows.join(report.filter("sufficient").select("query_id"), "query_id", "left_semi").unionByName(rows_2)
    final = report.filter("sufficient").withColumn("retry_count", F.lit(0)).unionByName(
        report_2.withColumn("retry_count", F.lit(1))
    )
    if maximum_chunks:
        final = final.withColumn("context_chunks", F.lit(maximum_chunks))
    limits = final.select("query_id", "query", "context_chunks", "context_chars", "exact_scheme", "sufficient")
    joined = kept.join(limits, "query_id")
    official = joined.filter(F.col("exact_scheme") & (F.col("route") == "exact_metadata")).select(
        "query_id", F.col("position").alias("context_position"), "position", F.lit(0).alias("step"), "chunk_id", "text",
        F.lit(False).alias("compressed"), F.length("text").alias("original_chars"),
        F.length("text").alias("context_chars"),
    )
    budgeted = joined.filter(~F.col("exact_scheme") & F.col("sufficient"))
    expanded = context.expand_parents(
        budgeted.select("query_id", "chunk_id", "position", "relationship", "parent_chunk_id",
                        "document_id", "page_start", "text", "content_type"),
        index.chunks,
    )
    types = kept.select("query_id", "position", "chunk_type")
    filled = context.assemble(
        expanded.join(types, ["query_id", "position"]).join(
            limits.select("query_id", "query", "context_chunks", "context_chars"), "query_id"
        ),
        compress,
    )
    used = filled.select(*official.columns)
    identity = index.chunks.select("chunk_id", "document_id", "document_type", "page_start")
    return official.unionByName(used).join(identity, "chunk_id"), final


def assessment_lanes(requests: DataFrame, index: Index, scorer: search.Scorer | None = None) -> DataFrame:
    """Unscoped assessment evidence: textbook, past-paper and marking lanes of each request.

    ``requests``: request_id, topic, assessment_type, level.  The three lanes are one query table, so
    they share a single pass over the index.
    """
    lane = lambda name, text, kind: F.struct(
        F.lit(name).alias("lane"), text.alias("query"), F.lit(kind).cast("string").alias("document_type")
    )
    marking = F.concat(
        F.lit("Generate a Cambridge Computer Science "), F.col("assessment_type"),
        F.lit(" using mark scheme marking criteria and answer quality patterns for "), F.col("topic"),
    )
    lanes = F.array(
        lane("TEXTBOOK_CONTENT", F.col("topic"), "TEXTBOOK"),
        lane("PAST_PAPER_STYLE", F.concat(F.lit("Cambridge Computer Science past paper question "), F.col("topic")), "QUESTION_PAPER"),
        lane("MARKING_PATTERN", marking, None),
    )
    asked = requests.select("request_id", "level", F.explode(lanes).alias("l")).select(
        F.concat_ws("#", "request_id", "l.lane").alias("query_id"), "l.query", "level", F.lit(None).cast("int").alias("exam_year"),
        "l.document_type",
    )
    rows, _ = retrieve(asked, index, scorer)
    placed = rows.select(
        F.substring_index("query_id", "#", 1).alias("request_id"), F.substring_index("query_id", "#", -1).alias("lane"),
        "context_position", "chunk_id", "document_id", "document_type", "page_start", "text",
    )
    wanted = (
        ((F.col("lane") == "TEXTBOOK_CONTENT") & (F.col("document_type") == "TEXTBOOK") & (F.col("context_position") <= 8))
        | ((F.col("lane") == "PAST_PAPER_STYLE") & (F.col("document_type") == "QUESTION_PAPER") & (F.col("context_position") <= 10))
        | ((F.col("lane") == "MARKING_PATTERN") & F.col("document_type").isin("MARK_SCHEME", "EXAMINER_REPORT", "SYLLABUS"))
    )
    role = F.when((F.col("lane") == "MARKING_PATTERN") & (F.col("document_type") == "SYLLABUS"), "CURRICULUM_SCOPE").otherwise(F.col("lane"))
    return placed.filter(wanted).withColumn("role", role)


def grading_evidence(aligned: DataFrame, index: Index, level: str | None = None) -> DataFrame:
    """Official marking evidence for every submission question, six chunks at most."""
    asked = grading.grading_queries(aligned).withColumns({
        "level": F.lit(level).cast("string"), "exam_year": F.lit(None).cast("int"), "document_type": F.lit(None).cast("string"),
    })
    rows, _ = retrieve(asked, index, maximum_chunks=6)
    return grading.official_only(rows)
