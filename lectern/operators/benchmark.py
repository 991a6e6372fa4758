"""Benchmark generation from question/scheme pairs, curriculum cases and textbook pages; status counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions import understanding as U
from lectern.operators import chunking, search, skew
from lectern.operators.contracts import MEASURABLE, STATUSES
from lectern.operators.index import Index, unpacked
from lectern.session import settled

PAIR = ("subject_code", "year", "session", "component", "question_number")
SESSION_LABELS = {"MJ": "M/J", "ON": "O/N", "FM": "F/M"}
MINIMUM = 100
SOURCE_WORDS = 45
SOURCE_COLUMNS = (
    "question", "category", "difficulty", "expected_intent", "level", "gold_answer", "ground_truth_references",
    "expected_pages", "expected_topics", "expected_citations", "exact_mark_scheme_available", "review_status",
    "generation_provenance",
)


def exact_pairs(chunks: DataFrame) -> DataFrame:
    """Question chunks with the scheme of the same paper and label.

    Missing identity fields match each other; the last scheme in corpus order wins; schemes shorter
    than four words do not count.
    """
    labelled = F.coalesce("question_number", F.lit("")) != ""
    fields = ["chunk_id", "document_id", "page_start", "text", "level", "ord"]
    q = chunks.filter((F.col("document_type") == "QUESTION_PAPER") & labelled).select(*PAIR, *fields)
    s = (
        chunks.filter((F.col("document_type") == "MARK_SCHEME") & labelled)
        .groupBy(*PAIR)
        .agg(F.max_by(F.struct("chunk_id", "document_id", "page_start", "text"), "ord").alias("scheme"))
        .filter(F.size(T.words("scheme.text")) >= 4)
    )
    s = s.select(*[F.col(c).alias(f"_{c}") for c in PAIR], "scheme")
    condition = F.lit(True)
    for name in PAIR:
        condition = condition & F.col(name).eqNullSafe(F.col(f"_{name}"))
    return q.join(s, condition).drop(*[f"_{c}" for c in PAIR])


def pair_records(pairs: DataFrame) -> DataFrame:
    """Benchmark records of exact pairs; ``place`` keeps question order."""
    labels = F.create_map(*[F.lit(v) for pair in SESSION_LABELS.items() for v in pair])
    session = F.coalesce(F.try_element_at(labels, F.col("session")), F.col("session"))
    asked = U.with_profile(pairs.withColumnRenamed("text", "query").withColumn("exam_year", F.col("year")))
    text = F.concat(
        F.lit("Answer "), F.concat_ws("/", "subject_code", "component", session, F.right(F.col("year").cast("string"), F.lit(2))),
        F.lit(" Question "), F.col("question_number"), F.lit(".\n\n"), F.col("query"),
    )
    reference = F.array(F.struct(
        F.col("scheme.document_id").alias("document_id"), F.col("scheme.page_start").alias("page"), F.col("scheme.chunk_id").alias("chunk_id")
    ))
    return asked.select(
        F.col("ord").alias("place"), text.alias("question"), F.col("profile.category").alias("category"),
        F.col("profile.difficulty").alias("difficulty"), F.lit("EXAM_ANSWER").alias("expected_intent"), F.col("level"),
        F.col("scheme.text").alias("gold_answer"), reference.alias("ground_truth_references"),
        F.array("scheme.page_start").alias("expected_pages"), F.array("profile.educational_objective").alias("expected_topics"),
        reference.alias("expected_citations"), F.col("chunk_id").alias("question_chunk_id"),
        F.col("scheme.chunk_id").alias("answer_chunk_id"), F.lit(True).alias("exact_mark_scheme_available"),
        F.lit("AUTO_VALIDATED_EXACT").alias("review_status"), F.lit("exact_question_mark_scheme_pair").alias("generation_provenance"),
    )


def round_robin(rows: DataFrame, category: str, order: str, target: int, *ties: Column) -> DataFrame:
    """The first ``target`` rows when categories take turns; ``ties`` order rows of one category and ``order``.

    A category gives at most ``target`` rows, so each partition is trimmed before the shuffle.
    """
    window = Window.partitionBy(category).orderBy(order, *ties)
    turns = rows.withColumn("turn", F.row_number().over(window)).filter(F.col("turn") <= target)
    return turns.orderBy("turn", category).limit(target)


def first_per_page(chunks: DataFrame) -> DataFrame:
    """The first textbook chunk of 45 words or more on every page, by a combined aggregate."""
    rows = chunks.filter((F.col("document_type") == "TEXTBOOK") & (F.size(T.words("text")) >= SOURCE_WORDS))
    return rows.groupBy("document_id", "page_start").agg(
        F.min_by(F.struct("chunk_id", "text", "level"), "chunk_id").alias("_row")
    ).select("document_id", "page_start", "_row.*")


def source_records(chunks: DataFrame, limit: int) -> DataFrame:
    """Questions derived from textbook pages, the first ``limit`` in page order."""
    picked = first_per_page(chunks).orderBy("document_id", "page_start").limit(limit)
    flat = T.collapse("text")
    topic = F.rtrim(F.substring(flat, 1, 80), F.lit(" ."))
    question = F.concat(F.lit("Explain "), topic, F.lit(" using the textbook evidence provided."))
    reference = F.array(F.struct("document_id", F.col("page_start").alias("page"), "chunk_id"))
    asked = U.with_profile(picked.withColumn("query", question).withColumn("exam_year", F.lit(None).cast("int")))
    return asked.select(
        F.col("query").alias("question"), F.col("profile.category").alias("category"), F.col("profile.difficulty").alias("difficulty"),
        F.col("profile.intent").alias("expected_intent"), "level", flat.alias("gold_answer"),
        reference.alias("ground_truth_references"), F.array("page_start").alias("expected_pages"), F.array(topic).alias("expected_topics"),
        reference.alias("expected_citations"), F.lit(False).alias("exact_mark_scheme_available"),
        F.lit("AUTO_VALIDATED_CURRICULUM").alias("review_status"), F.lit("source_derived_question").alias("generation_provenance"),
        "document_id", "page_start", "chunk_id",
    )


def with_all_terms(hits: DataFrame, terms: DataFrame, index: Index) -> DataFrame:
    """``hits (case_id, chunk_id)``, a table, whose chunk has every one of the case's ``terms (case_id, term)``.

    The postings are intersected rarest term first, so the other terms are looked up only for chunks that have it;
    a term that no chunk has leaves nothing.  Only the asked terms are counted, and only their postings in chunks that may
    be hits are shuffled.
    """
    words = terms.select("term").distinct()
    few = skew.fits(words, search.BROADCAST_TERMS)
    wanted = terms.distinct().join(search.frequencies(terms, index) if few else index.terms, "term", "left")
    ordered = Window.partitionBy("case_id").orderBy(F.coalesce("df", F.lit(0)), "term")
    placed = wanted.withColumn("_at", F.row_number().over(ordered)).select("case_id", "term", "_at")
    held = skew.narrowed(index.postings if index.packed is None else index.packed, hits, "chunk_id")
    has = (held if index.packed is None else unpacked(held)).select("chunk_id", "term").join(skew.maybe_broadcast(words), "term", "left_semi")
    first = hits.select("case_id", "chunk_id").join(placed.filter("_at = 1"), "case_id").join(has, ["chunk_id", "term"], "left_semi")
    others = first.select("case_id", "chunk_id").join(placed.filter("_at > 1"), "case_id").join(has, ["chunk_id", "term"], "left_semi")
    found = others.groupBy("case_id", "chunk_id").agg(F.count("*").alias("_found"))
    needed = placed.groupBy("case_id").agg((F.count("*") - 1).alias("_needed"))
    counted = first.select("case_id", "chunk_id").join(found, ["case_id", "chunk_id"], "left").join(needed, "case_id")
    return counted.filter(F.coalesce("_found", F.lit(0)) == F.col("_needed")).select("case_id", "chunk_id")


def curriculum_sources(cases: DataFrame, index: Index, depth: int = 40) -> DataFrame:
    """The source chunk of each curriculum case ``(case_id, query, level, terms)``; a case has at least one term.

    Among the top BM25 chunks of the level: a textbook chunk with all terms as words, else as tokens,
    else a syllabus chunk; the best-ranked one of the first kind found.
    """
    asked = cases.select(F.col("case_id").cast("string").alias("query_id"), "query", "level")
    hits = settled(search.bm25(asked, index, depth).select(F.col("query_id").alias("case_id"), "chunk_id", "document_type", "rank"), "case_hits")
    keyed = cases.select(F.col("case_id").cast("string").alias("case_id"), "terms")
    # as words, punctuation and all: only the texts of the textbook hits tell
    texts = index.chunks.select("chunk_id", T.words(F.replace(F.lower("retrieval_text"), F.lit("’"), F.lit("'"))).alias("_words"))
    textbook = hits.filter("document_type = 'TEXTBOOK'").join(texts, "chunk_id").join(keyed, "case_id")
    plain = textbook.filter(F.size(F.array_except("terms", "_words")) == 0).select("case_id", "chunk_id", "rank", F.lit(1).alias("kind"))
    whole = with_all_terms(hits, keyed.select("case_id", F.explode("terms").alias("term")), index)
    kind = F.when(F.col("document_type") == "TEXTBOOK", 2).when(F.col("document_type") == "SYLLABUS", 3)
    as_tokens = hits.join(whole, ["case_id", "chunk_id"]).select("case_id", "chunk_id", "rank", kind.alias("kind")).filter("kind IS NOT NULL")
    best = plain.unionByName(as_tokens).groupBy("case_id").agg(F.min(F.struct("kind", "rank", "chunk_id")).alias("_row"))
    identity = index.chunks.select("chunk_id", "document_id", "page_start")
    return best.select("case_id", "_row.*").join(identity, "chunk_id").select("case_id", "chunk_id", "document_id", "page_start", "kind")


def generate(curriculum: DataFrame, pairs: DataFrame, chunks: DataFrame, target: int = 120) -> DataFrame:
    """Curriculum records, then round-robin exact pairs, then textbook questions up to ``target``.

    Pair ids count all pairs in corpus order, in blocks; the other ids and the memory tests of the
    first twenty records are given after the limit, when at most ``target`` rows are left.
    """
    columns = [c for c in curriculum.columns if c in pairs.columns and c in SOURCE_COLUMNS]
    counted = skew.dense_index(pairs.withColumn("_all", F.lit(0)), "_all", "place", chunking.ORD_STRIDE)
    exact = round_robin(counted, "category", "place", target, F.desc("n"))
    stratum = lambda n: F.lit(n).alias("stratum")
    order = lambda *keys: F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*keys)).alias("_order")
    first = curriculum.orderBy("place").limit(target).select(*columns, stratum(1), order("place"), F.lit(0).cast("bigint").alias("_n"))
    second = exact.select(*columns, stratum(2), order("turn", "category"), F.col("n").alias("_n"))
    third = source_records(chunks, target).select(
        *columns, stratum(3), order("document_id", "page_start"), F.lit(0).cast("bigint").alias("_n")
    )
    chosen = first.unionByName(second).unionByName(third).orderBy("stratum", "_order").limit(target)
    position = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("stratum", "_order"))
    placed = chosen.withColumn("position", position)
    number = (
        F.when(F.col("stratum") == 1, F.format_string("CURRICULUM_%03d", F.col("_order")))
        .when(F.col("stratum") == 2, F.format_string("BENCH_%04d", F.col("_n")))
        .otherwise(F.format_string("SOURCE_%04d", F.col("position")))
    )
    test = F.struct(
        F.col("question").alias("prior_question"), F.lit("Can you explain that more simply?").alias("followup"),
        F.col("question").alias("expected_topic"),
    )
    return placed.withColumns({"id": number, "memory_test": F.when(F.col("position") <= 20, test)}).drop("_order", "_n")


def status_counts(records: DataFrame, spark: SparkSession) -> DataFrame:
    """Records per review status, zero-filled over the five statuses."""
    dimension = spark.createDataFrame([(s,) for s in STATUSES], "review_status string")
    counted = records.groupBy("review_status").agg(F.count("*").alias("_n"))
    return dimension.join(counted, "review_status", "left").select(
        "review_status", F.coalesce("_n", F.lit(0)).alias("records"), F.col("review_status").isin(*MEASURABLE).alias("measurable")
    )


def audit(records: DataFrame) -> DataFrame:
    """``(dimension, label, records)`` by category and level, plus total and measurable rows."""
    level: Column = F.coalesce("level", F.lit("UNKNOWN"))
    measured = F.when(F.col("review_status").isin(*MEASURABLE), "measurable").otherwise("other")
    stacked = records.select("category", level.alias("level"), measured.alias("m")).selectExpr(
        "stack(4, 'category', category, 'level', level, 'measurable', m, 'total', 'total') AS (dimension, label)"
    )
    return stacked.groupBy("dimension", "label").agg(F.count("*").alias("records"))
