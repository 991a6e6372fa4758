"""Evidence sufficiency, parent expansion and budgeted context assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import skew

# Stop words, factual and full-text types, budgets.
COVERAGE_STOP = (
    "what", "when", "where", "which", "that", "this", "with", "from", "into", "about", "explain", "define",
    "answer", "question", "using", "write", "show",
)
COMPRESSION_STOP = (
    "what", "when", "where", "which", "that", "this", "with", "from", "into", "about", "explain", "define",
    "answer", "question", "state", "give", "describe", "identify",
)
FACTUAL_TYPES = ("TEXTBOOK", "SYLLABUS", "EXAMINER_REPORT")
FULL_TEXT_TYPES = ("MARK_SCHEME", "QUESTION_PAPER", "MARKING_PATTERN")
SUFFICIENT_COVERAGE = 0.20
CHUNK_CHARS = 2400
FILL_SHARE = 0.85


def evidence_coverage(query: Column, text: Column) -> Column:
    """Share of the query's content terms found in one chunk; zero when it has none."""
    wanted = T.long_terms(query, COVERAGE_STOP)
    return F.when(F.size(wanted) == 0, F.lit(0.0)).otherwise(
        T.overlap(wanted, T.token_set(text)) / F.size(wanted)
    )


def sufficiency(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """``(query_id, evidence_coverage, exact_scheme, sufficient)`` for every query.

    Coverage is that of the best single factual chunk.
    """
    factual = F.col("chunk_type").isin(*FACTUAL_TYPES)
    joined = ranked.join(queries.select("query_id", "query", F.col("document_type").alias("want_type")), "query_id")
    is_scheme = (F.col("route") == "exact_metadata") & (F.col("chunk_type") == "MARK_SCHEME")
    measured = joined.groupBy("query_id").agg(
        F.max(F.when(factual, evidence_coverage(F.col("query"), F.col("text"))).otherwise(0.0)).alias("_coverage"),
        F.bool_or(is_scheme).alias("_scheme"),
        F.count("*").alias("_rows"),
    )
    coverage = F.coalesce("_coverage", F.lit(0.0))
    scheme = F.coalesce("_scheme", F.lit(False))
    wants_paper = F.coalesce(F.col("document_type") == "QUESTION_PAPER", F.lit(False))
    enough = (F.coalesce("_rows", F.lit(0)) > 0) & (scheme | (coverage >= SUFFICIENT_COVERAGE) | wants_paper)
    return queries.join(measured, "query_id", "left").select(
        "query_id",
        F.round(coverage, 6).alias("evidence_coverage"),
        scheme.alias("exact_scheme"),
        enough.alias("sufficient"),
    )


def expand_parents(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Put each hit's parent after it unless that chunk is already in the list.

    ``ranked`` has ``query_id, chunk_id, position, parent_chunk_id`` and chunk columns; the parent's
    row takes its own chunk columns and the relationship PARENT_CONTEXT.  Only chunks that are a parent of ``ranked``
    (a table) may cross a shuffle.
    """
    shared = [c for c in ranked.columns if c not in ("query_id", "chunk_id", "position", "relationship", "parent_chunk_id")]
    parents = chunks.filter(F.col("content_type") == "PARENT_CONTEXT").select(
        F.col("chunk_id").alias("parent_chunk_id"),
        *[(F.col(c) if c in chunks.columns else F.lit(None)).alias(c) for c in shared],
    )
    wanted = ranked.select("query_id", "position", "parent_chunk_id").filter(F.col("parent_chunk_id").isNotNull())
    added = (
        wanted.join(skew.narrowed(parents, wanted, "parent_chunk_id"), "parent_chunk_id")
        .select(
            "query_id", F.col("parent_chunk_id").alias("chunk_id"), "position",
            F.lit("PARENT_CONTEXT").alias("relationship"), F.lit(None).cast("string").alias("parent_chunk_id"),
            F.lit(1).alias("step"), *shared,
        )
    )
    own = ranked.select("query_id", "chunk_id", "position", "relationship", "parent_chunk_id", F.lit(0).alias("step"), *shared)
    same = Window.partitionBy("query_id", "chunk_id").orderBy("position", "step")
    return (
        own.unionByName(added)
        .withColumn("_rn", F.row_number().over(same))
        .filter((F.col("step") == 0) | (F.col("_rn") == 1))
        .drop("_rn")
    )


def _scored_segments(query: Column, text: Column) -> Column:
    """Segments as ``struct<rank_score, pos, segment>``, best first."""
    wanted = T.long_terms(query, COMPRESSION_STOP)

    def score(terms: Column) -> Column:
        def one(segment: Column, position: Column) -> Column:
            def weigh(found: Column) -> Column:
                shared = T.overlap(terms, found)
                bonus = F.when((position == 0) | (F.length(segment) < 120), 0.2).otherwise(0.0)
                return (
                    shared / F.greatest(F.lit(1), F.size(terms)) * 4
                    + shared / F.greatest(F.lit(1), F.size(found)) * 2
                    + bonus
                )

            return F.struct(
                (-F.round(T.let(T.token_set(segment), weigh), 9)).alias("rank_score"),
                position.alias("pos"),
                segment.alias("segment"),
            )

        return F.array_sort(F.transform(T.segments(text), one))

    return T.let(wanted, score)


def _greedy(scored: Column, limit: Column) -> Column:
    """Best segments that fit ``limit`` characters, stopping at 85 % fill, in original order."""
    start = F.struct(
        F.lit(0).alias("used"),
        F.lit(False).alias("full"),
        F.array().cast("array<struct<pos: int, segment: string>>").alias("chosen"),
    )

    def step(state: Column, item: Column) -> Column:
        first = F.size(state["chosen"]) == 0
        piece = F.when(first, F.substring(item["segment"], F.lit(1), limit)).otherwise(item["segment"])
        addition = F.length(piece) + F.when(first, 0).otherwise(2)
        skip = state["full"] | (~first & (state["used"] + addition > limit))
        used = state["used"] + addition
        grown = F.struct(
            used.alias("used"),
            (used >= limit * F.lit(FILL_SHARE)).alias("full"),
            F.concat(state["chosen"], F.array(F.struct(item["pos"].alias("pos"), piece.alias("segment")))).alias("chosen"),
        )
        return F.when(skip, state).otherwise(grown)

    chosen = F.aggregate(scored, start, step, lambda s: s["chosen"])
    return F.array_join(F.transform(F.array_sort(chosen), lambda c: c["segment"]), "\n\n")


CONTEXT_FIELDS = "position: int, step: int, chunk_id: string, text: string, compressed: boolean, original_chars: int"


def assemble(expanded: DataFrame, compress: bool = True) -> DataFrame:
    """Fill each query's context budget in list order.

    ``expanded`` has ``query_id, query, position, step, chunk_id, chunk_type, text, context_chunks,
    context_chars``.  Only the first ``context_chunks`` rows with text can be used, so the per-query
    list that the fold sees is at most that long.
    """
    usable = expanded.filter(F.coalesce(F.length("text"), F.lit(0)) > 0)
    in_order = Window.partitionBy("query_id").orderBy("position", "step")
    head = usable.withColumn("_rn", F.row_number().over(in_order)).filter(F.col("_rn") <= F.col("context_chunks"))
    whole = F.col("chunk_type").isin(*FULL_TEXT_TYPES) | (F.coalesce("query", F.lit("")) == "") | F.lit(not compress)
    # Segments are needed only where the text may not fit: over the cap, or past the budget even if
    # every earlier row had used all it could.
    most = F.sum(F.least(F.length("text"), F.lit(CHUNK_CHARS))).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    head = head.withColumn("_may_cut", (F.length("text") > CHUNK_CHARS) | (most > F.col("context_chars")))
    nothing = F.array().cast("array<struct<rank_score: double, pos: int, segment: string>>")
    segments = F.when(~whole & F.col("_may_cut"), _scored_segments(F.col("query"), F.col("text")))
    prepared = head.select(
        "query_id", "context_chars",
        F.struct(
            "_rn", "position", "step", "chunk_id", "text", whole.alias("whole"),
            F.coalesce(segments, nothing).alias("segments"),
        ).alias("item"),
    )
    grouped = prepared.groupBy("query_id").agg(
        F.array_sort(F.collect_list("item")).alias("items"), F.max("context_chars").alias("budget")
    )
    start = F.struct(F.lit(0).alias("used"), F.array().cast(f"array<struct<{CONTEXT_FIELDS}>>").alias("out"))

    def step(state: Column, item: Column) -> Column:
        limit = F.least(F.col("budget") - state["used"], F.lit(CHUNK_CHARS))
        cut = F.substring(item["text"], F.lit(1), limit)

        def place(selected: Column) -> Column:
            row = F.struct(
                item["position"].cast("int").alias("position"), item["step"].cast("int").alias("step"),
                item["chunk_id"].alias("chunk_id"), selected.alias("text"),
                (F.length(selected) < F.length(item["text"])).alias("compressed"),
                F.length(item["text"]).alias("original_chars"),
            )
            return F.struct(
                (state["used"] + F.length(selected)).alias("used"), F.concat(state["out"], F.array(row)).alias("out")
            )

        picked = F.when((F.length(item["text"]) <= limit) | item["whole"], cut).otherwise(_greedy(item["segments"], limit))
        return F.when(state["used"] >= F.col("budget"), state).otherwise(T.let(picked, place))

    folded = grouped.select("query_id", F.aggregate("items", start, step, lambda s: s["out"]).alias("_out"))
    rows = folded.select("query_id", F.posexplode("_out").alias("_pos", "_row"))
    return rows.select("query_id", (F.col("_pos") + 1).alias("context_position"), "_row.*").withColumn(
        "context_chars", F.length("text")
    )


def source_catalog(rows: DataFrame, key: str, order: str, maximum_chars: int = 60_000, per_source: int = 1_800) -> DataFrame:
    """Numbered sources ``S1, S2, …`` inside one character budget per ``key``, in ``order``.

    Each source gets the first ``per_source`` characters, or what the running sum left over.
    """
    taken = F.least(F.length("text"), F.lit(per_source))
    window = Window.partitionBy(key).orderBy(order)
    before = F.coalesce(F.sum(taken).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        rows.withColumns({"_before": before, "_rn": F.row_number().over(window)})
        .filter(F.col("_before") < maximum_chars)
        .withColumn("source_key", F.concat(F.lit("S"), F.col("_rn").cast("string")))
        .withColumn(
            "text",
            F.substring("text", F.lit(1), F.least(F.lit(per_source), F.lit(maximum_chars) - F.col("_before")).cast("int")),
        )
        .drop("_before", "_rn")
    )


def citable_sources(rows: DataFrame, key: str = "query_id", order: str = "position", size: int = 2_200) -> DataFrame:
    """Numbered citable sources: style-only rows dropped, text cut to ``size`` characters."""
    style_only = (F.col("document_type") == "MARKING_PATTERN") | (
        F.coalesce("relationship", F.lit("")) == "ASSESSMENT_PATTERN"
    )
    window = Window.partitionBy(key).orderBy(order)
    return (
        rows.filter(~F.coalesce(style_only, F.lit(False)))
        .withColumn("source_key", F.concat(F.lit("S"), F.row_number().over(window).cast("string")))
        .withColumn("source_role", F.coalesce("relationship", F.lit("CURRICULUM_EVIDENCE")))
        .withColumn("text", F.substring("text", 1, size))
    )
