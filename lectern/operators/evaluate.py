"""Retrieval, citation and answer metrics, failure taxonomy, quality gates and report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import quantiles

# Cut-offs, failure advice, gates.
DEPTH = 10
# Widths of page buckets: a range is filed under the first one that is not below its length.
PAGE_WIDTHS = tuple(1 << bits for bits in range(0, 33, 4))
ADVICE = {
    "RETRIEVAL_EXECUTION_FAILURE": "Inspect the row error, build manifest, and provider configuration.",
    "RETRIEVAL_RELEVANCE_FAILURE": "Inspect chunk boundaries, query variants, filters, fusion, and reranker ranks.",
    "ANSWER_EXECUTION_FAILURE": "Inspect generation status/error; do not score missing output as a semantic answer.",
    "CITATION_IDENTITY_FAILURE": "Inspect source-key mapping and immutable chunk identities.",
}
GATES = (
    ("benchmark_size", ">=", 100.0),
    ("retrieval_evaluation_coverage", ">=", 1.0),
    ("answer_evaluation_coverage", ">=", 1.0),
    ("page_extraction_coverage", ">=", 0.99),
    ("recall_at_5", ">=", 0.90),
    ("recall_at_10", ">=", 0.95),
    ("mrr", ">=", 0.75),
    ("ndcg_at_10", ">=", 0.85),
    ("exact_scheme_retrieval_accuracy", ">=", 0.98),
    ("citation_identity_accuracy", ">=", 1.0),
    ("citation_coverage", ">=", 0.90),
    ("technical_failure_rate", "<=", 0.01),
    ("median_latency_ms", "<=", 5000.0),
    ("p95_latency_ms", "<=", 10000.0),
    ("metadata_accuracy", ">=", 0.98),
    ("question_boundary_accuracy", ">=", 0.97),
    ("ocr_text_accuracy", ">=", 0.95),
    ("judge_context_precision", "INFORMATIONAL", None),
    ("judge_context_recall", "INFORMATIONAL", None),
    ("judge_faithfulness", "INFORMATIONAL", None),
    ("judge_answer_relevancy", "INFORMATIONAL", None),
    ("judge_answer_correctness", "INFORMATIONAL", None),
    ("judge_noise_sensitivity", "INFORMATIONAL", None),
)
JUDGE_METRICS = (
    "context_precision", "context_recall", "answer_relevancy", "faithfulness", "answer_correctness", "noise_sensitivity",
)


def _gain(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank + F.lit(1.0))


def gold_matches(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """Ordinals of the gold sources each of the first ten hits matches.

    ``hits``: query_id, rank, document_id, page_start, chunk_id.  ``gold``: query_id, ordinal (unique inside a query),
    document_id, page, page_end, chunk_id, parent_chunk_id, policy.  A gold source of policy PAGE, or without a chunk,
    matches hits of its document that start on its pages; any other one matches its chunk or its parent.  Sources
    without page and chunk match nothing.

    Both are equi-joins: a page range lies in one or two buckets of the first width that is not below its length, and a
    hit looks into its bucket of every width.  At most ten ordinals per hit are kept: nine others at most can be
    taken before it, so the smallest free one is always among them.
    """
    top = hits.filter(F.col("rank") <= DEPTH).select("query_id", "document_id", "rank", "page_start", "chunk_id")
    chunk = F.nullif(F.col("chunk_id"), F.lit(""))
    g = gold.select(
        "query_id", "document_id", F.col("ordinal").cast("bigint").alias("ordinal"),
        (F.coalesce(F.col("policy") == "PAGE", F.lit(False)) | chunk.isNull()).alias("_by_page"),
        F.col("page").cast("bigint").alias("_first"), F.coalesce("page_end", "page").cast("bigint").alias("_last"),
        F.array_distinct(F.array_compact(F.array(chunk, "parent_chunk_id"))).alias("_chunks"),
    )
    length = F.col("_last") - F.col("_first") + 1
    bucket = lambda page, width: F.floor(page / width).cast("bigint")
    ranges = g.filter(F.col("_by_page") & (length >= 1)).withColumn(
        "width", F.coalesce(*[F.when(length <= w, F.lit(w)) for w in PAGE_WIDTHS])
    ).withColumn("bucket", F.explode(F.array_distinct(F.array(bucket(F.col("_first"), F.col("width")), bucket(F.col("_last"), F.col("width"))))))
    looked = F.array(*[F.struct(F.lit(w).alias("width"), bucket(F.col("page_start"), F.lit(w)).alias("bucket")) for w in PAGE_WIDTHS])
    on_page = (
        top.select("query_id", "document_id", "rank", "page_start", F.explode(looked).alias("_b"))
        .select("query_id", "document_id", "rank", "page_start", "_b.*")
        .join(ranges, ["query_id", "document_id", "width", "bucket"])
        .filter(F.col("page_start").between(F.col("_first"), F.col("_last")))
        .select("query_id", "rank", "ordinal")
    )
    named = g.filter(~F.col("_by_page")).select("query_id", "document_id", "ordinal", F.explode("_chunks").alias("chunk_id"))
    by_chunk = top.join(named, ["query_id", "document_id", "chunk_id"]).select("query_id", "rank", "ordinal")
    first = Window.partitionBy("query_id", "rank").orderBy("ordinal")
    kept = on_page.unionByName(by_chunk).withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= DEPTH)
    return kept.groupBy("query_id", "rank").agg(F.array_sort(F.collect_list("ordinal")).alias("ordinals"))


def exact_scheme_rows(records: DataFrame, found: DataFrame) -> DataFrame:
    """``(query_id, exact_scheme_correct)``: whether an official scheme was found just where the record says there is one.

    ``records``: query_id, exact_mark_scheme_available.  ``found``: query_id, document_type of exact rows; a query
    without any found nothing.  A null flag counts as none available.
    """
    official = found.groupBy("query_id").agg(F.bool_or(F.col("document_type") == "MARK_SCHEME").alias("_found"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return records.join(official, "query_id", "left").select(
        "query_id", (flag("_found") == flag("exact_mark_scheme_available")).alias("exact_scheme_correct")
    )


def retrieval(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """Per query with gold: P@5/10, R@5/10, reciprocal rank and nDCG@10; each gold source counts once."""
    totals = gold.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    ranked = gold_matches(hits, gold).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "ordinals"))).alias("_ranks")
    )
    start = F.struct(F.array().cast("array<bigint>").alias("taken"), F.array().cast("array<int>").alias("ranks"))

    def step(state: Column, item: Column) -> Column:
        free = F.get(F.filter(item["ordinals"], lambda o: ~F.array_contains(state["taken"], o)), F.lit(0))
        grown = F.struct(
            F.concat(state["taken"], F.array(free)).alias("taken"),
            F.concat(state["ranks"], F.array(item["rank"].cast("int"))).alias("ranks"),
        )
        return F.when(free.isNull(), state).otherwise(grown)

    credited = ranked.select("query_id", F.aggregate("_ranks", start, step, lambda s: s["ranks"]).alias("credit"))
    rows = totals.join(credited, "query_id", "left").withColumn(
        "credit", F.coalesce("credit", F.array().cast("array<int>"))
    )
    within = lambda k: F.size(F.filter("credit", lambda r: r <= k))
    dcg = F.aggregate("credit", F.lit(0.0), lambda a, r: a + _gain(r))
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.least(F.lit(DEPTH), F.col("n_gold")).cast("int")), F.lit(0.0), lambda a, r: a + _gain(r)
    )
    first = F.array_min("credit")
    return rows.select(
        "query_id",
        "n_gold",
        (within(5) / F.lit(5.0)).alias("precision_at_5"),
        (within(10) / F.lit(10.0)).alias("precision_at_10"),
        (within(5) / F.col("n_gold")).alias("recall_at_5"),
        (within(10) / F.col("n_gold")).alias("recall_at_10"),
        F.coalesce(1 / first, F.lit(0.0)).alias("reciprocal_rank"),
        (dcg / ideal).alias("ndcg_at_10"),
    )


def completed_mean(column: str) -> Column:
    """Mean over COMPLETED rows, ignoring nulls."""
    return F.avg(F.when(F.col("execution_status") == "COMPLETED", F.col(column).cast("double"))).alias(column)


def retrieval_summary(rows: DataFrame) -> DataFrame:
    names = ("precision_at_5", "precision_at_10", "recall_at_5", "recall_at_10", "reciprocal_rank", "ndcg_at_10")
    extra = ("exact_scheme_correct",) if "exact_scheme_correct" in rows.columns else ()
    done = F.count_if(F.col("execution_status") == "COMPLETED")
    return rows.agg(
        F.count("*").alias("attempted_count"),
        done.alias("completed_count"),
        F.coalesce(done / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("coverage"),
        *[completed_mean(n) for n in (*names, *extra)],
    ).withColumnRenamed("reciprocal_rank", "mrr")


def citation_metrics(answers: DataFrame) -> DataFrame:
    """Identity accuracy, gold precision and coverage from ``citations, retrieved, expected_citations``."""
    identity = lambda page: lambda x: F.struct(
        x["document_id"].alias("d"), x[page].alias("p"), x["chunk_id"].alias("c")
    )
    place = lambda x: F.struct(x["document_id"].alias("d"), x["page"].alias("p"))
    cited = F.array_distinct(F.transform("citations", identity("page")))
    seen = F.array_distinct(F.transform("retrieved", identity("page_start")))
    expected = F.array_distinct(F.transform("expected_citations", place))
    pages = F.transform(cited, lambda x: F.struct(x["d"].alias("d"), x["p"].alias("p")))
    ratio = lambda a, b: F.when(b > 0, a / b)
    based = answers.withColumns({"_cited": cited, "_seen": seen, "_expected": expected, "_pages": pages})
    gold = F.size(F.filter("_pages", lambda p: F.array_contains(F.col("_expected"), p)))
    return based.select(
        *answers.columns,
        F.size("citations").alias("citation_count"),
        ratio(T.overlap(F.col("_cited"), F.col("_seen")), F.size("_cited")).alias("citation_identity_accuracy"),
        ratio(gold, F.size("_cited")).alias("citation_gold_precision"),
        ratio(T.overlap(F.col("_pages"), F.col("_expected")), F.size("_expected")).alias("citation_coverage"),
    )


def answer_summary(rows: DataFrame) -> DataFrame:
    n = F.count("*")
    done = F.count_if(F.col("execution_status") == "COMPLETED")
    return rows.agg(
        n.alias("attempted_count"),
        done.alias("completed_count"),
        (n - done).alias("failure_count"),
        F.coalesce(done / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("coverage"),
        *[completed_mean(c) for c in ("citation_identity_accuracy", "citation_gold_precision", "citation_coverage")],
        F.avg(F.coalesce("technical_failure", F.lit(False)).cast("double")).alias("technical_failure_rate"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("total_input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("total_output_tokens"),
        F.coalesce(F.sum("estimated_cost"), F.lit(0.0)).alias("estimated_cost"),
    )


def latency(rows: DataFrame) -> DataFrame:
    """Median, nearest-rank p95, extremes, failure rate and cost of the values as they are."""
    value, one = F.col("latency_ms"), F.lit(1).alias("_one")
    totals = rows.agg(
        F.count("latency_ms").alias("count"),
        F.min(value).alias("minimum_latency_ms"),
        F.max(value).alias("maximum_latency_ms"),
        F.avg(F.coalesce("technical_failure", F.lit(False)).cast("double")).alias("technical_failure_rate"),
        F.coalesce(F.sum("estimated_cost"), F.lit(0.0)).alias("estimated_cost"),
    )
    picked = quantiles.at_ranks(rows, "latency_ms", lambda n: {
        "low": F.floor((n + 1) / 2), "high": F.floor(n / 2) + 1, "p95_latency_ms": F.floor((n * 95 + 99) / 100),
    }).select(((F.col("low") + F.col("high")) / 2).alias("median_latency_ms"), "p95_latency_ms", one)
    return totals.select("*", one).join(picked, "_one").select(
        "count", "median_latency_ms", "p95_latency_ms", "minimum_latency_ms", "maximum_latency_ms", "technical_failure_rate", "estimated_cost"
    )


def failures(records: DataFrame, retrieval_rows: DataFrame, answer_rows: DataFrame) -> DataFrame:
    """First failing stage of each record: retrieval run, relevance, answer run, citation identity."""
    r = retrieval_rows.select(
        "id", F.col("execution_status").alias("_r_status"), F.col("recall_at_10").alias("_recall"),
        F.col("error").alias("retrieval_error"),
    )
    a = answer_rows.select(
        "id", F.col("execution_status").alias("_a_status"), F.col("citation_identity_accuracy").alias("_identity"),
        F.col("error").alias("answer_error"), F.lit(True).alias("_answered"),
    )
    joined = records.select("id").join(r, "id", "left").join(a, "id", "left")
    category = (
        F.when(F.coalesce(F.col("_r_status") != "COMPLETED", F.lit(True)), "RETRIEVAL_EXECUTION_FAILURE")
        .when(F.coalesce("_recall", F.lit(0.0)) == 0, "RETRIEVAL_RELEVANCE_FAILURE")
        .when(F.col("_answered") & F.coalesce(F.col("_a_status") != "COMPLETED", F.lit(True)), "ANSWER_EXECUTION_FAILURE")
        .when(F.col("_identity") < 1, "CITATION_IDENTITY_FAILURE")
    )
    advice = F.create_map(*[F.lit(v) for pair in ADVICE.items() for v in pair])
    found = joined.withColumn("failure_category", category).filter(F.col("failure_category").isNotNull())
    return found.select(
        "id", "failure_category", F.try_element_at(advice, F.col("failure_category")).alias("recommendation"),
        "retrieval_error", "answer_error",
    )


def failure_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("failure_category").agg(F.count("*").alias("failures"))


def judge_eligible(answers: DataFrame, records: DataFrame) -> DataFrame:
    """Completed answers with contexts and text whose record is known."""
    usable = (F.col("execution_status") == "COMPLETED") & (F.size("contexts") > 0) & (F.coalesce("answer", F.lit("")) != "")
    return answers.filter(usable).join(records.select("id"), "id", "left_semi")


def judge_summary(scores: DataFrame, eligible_count: Column | None = None) -> DataFrame:
    """Per-metric mean over finite judge scores, and coverage."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))
    n = F.count("*")
    return scores.agg(
        n.alias("scored_count"),
        (n / (eligible_count if eligible_count is not None else F.nullif(n, F.lit(0)))).alias("coverage"),
        *[F.avg(finite(m)).alias(m) for m in JUDGE_METRICS if m in scores.columns],
    )


def gates_table(spark: SparkSession) -> DataFrame:
    """The gate dimension: 23 fixed rows."""
    rows = [(name, op, target, i) for i, (name, op, target) in enumerate(GATES)]
    return spark.createDataFrame(rows, "metric string, operator string, target double, place int")


def gates(metrics: DataFrame, measured: Sequence[str] | None = None) -> DataFrame:
    """Gate rows for ``(metric, value)``: value, status and a three-way ``passed``.

    Informational gates are reported but never pass; a metric outside ``measured`` counts as not run.
    """
    joined = gates_table(metrics.sparkSession).join(metrics, "metric", "left")
    ran = F.col("value").isNotNull() & (F.lit(True) if measured is None else F.col("metric").isin(*measured))
    passed = F.when(
        ran & (F.col("operator") != "INFORMATIONAL"),
        F.when(F.col("operator") == ">=", F.col("value") >= F.col("target")).otherwise(F.col("value") <= F.col("target")),
    )
    return joined.select(
        "metric", "value", "operator", "target",
        F.when(ran, "MEASURED").otherwise("NOT_MEASURED").alias("status"), passed.alias("passed"),
    )


def gate_verdict(gate_rows: DataFrame) -> DataFrame:
    """One row: measured and total gates, and whether the measured or all of them passed."""
    n, seen = F.count("*"), F.count("passed")
    ok = F.coalesce(F.bool_and("passed"), F.lit(False))
    return gate_rows.agg(
        seen.alias("measured_gate_count"),
        n.alias("total_gate_count"),
        ((seen > 0) & ok).alias("all_measured_gates_passed"),
        ((seen == n) & ok).alias("all_required_gates_passed"),
    )


def review_accuracy(rows: DataFrame) -> DataFrame:
    """Share of correct rows in a review table, null unless every row has been reviewed."""
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    done = filled("reviewer") & filled("reviewed_at") & F.col("is_correct").isin("0", "1")
    n = F.count("*")
    return rows.agg(
        n.alias("rows"),
        F.count_if(done).alias("reviewed_rows"),
        F.when((n > 0) & (F.count_if(done) == n), F.avg((F.col("is_correct") == "1").cast("double"))).alias("accuracy"),
    )


def word_accuracy(rows: DataFrame) -> DataFrame:
    """Share of correct words in an OCR review table, null unless every row has been reviewed."""
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    done = filled("reviewer") & filled("reviewed_at") & filled("reviewed_words")
    n = F.count("*")
    total = F.greatest(F.lit(1), F.sum(F.col("reviewed_words").try_cast("bigint")))
    return rows.agg(
        n.alias("rows"),
        F.when(
            (n > 0) & (F.count_if(done) == n), F.sum(F.col("correct_words").try_cast("bigint")) / total
        ).alias("accuracy"),
    )


def source_recall(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """Per query: whether any gold chunk was retrieved (assessment evidence reuse)."""
    found = gold.join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi")
    flags = found.select("query_id").distinct().withColumn("_hit", F.lit(True))
    return gold.select("query_id").distinct().join(flags, "query_id", "left").select(
        "query_id", F.coalesce("_hit", F.lit(False)).alias("gold_source_recalled")
    )


def question_report(records: DataFrame, retrieval_rows: DataFrame, answer_rows: DataFrame, judge_rows: DataFrame, found: DataFrame) -> DataFrame:
    """One report row per benchmark record: four left joins on the record id."""
    r = retrieval_rows.select("id", F.col("execution_status").alias("_r"), F.col("error").alias("_re"),
                              F.col("latency_ms").alias("_rl"), "retrieved_document_ids", "retrieved_pages",
                              "precision_at_5", "recall_at_5", "recall_at_10", F.col("reciprocal_rank").alias("mrr"), "ndcg_at_10")
    a = answer_rows.select("id", F.col("execution_status").alias("_a"), F.col("error").alias("_ae"),
                           F.col("latency_ms").alias("_al"), "answer", "citation_identity_accuracy",
                           "citation_gold_precision", "citation_coverage", "input_tokens", "output_tokens", "estimated_cost")
    j = judge_rows.select("id", *[m for m in JUDGE_METRICS if m in judge_rows.columns])
    f = found.select("id", "failure_category")
    status = F.coalesce(T.non_blank("_a"), T.non_blank("_r"), F.lit("NOT_RUN"))
    bad = F.col("failure_category").isNotNull() | (status != "COMPLETED")
    return (
        records.select("id", "question", "category", "difficulty", "gold_answer")
        .join(r, "id", "left").join(a, "id", "left").join(j, "id", "left").join(f, "id", "left")
        .withColumns({
            "execution_status": status,
            "row_result": F.when(bad, "FAIL").otherwise("PASS"),
            "execution_error": F.coalesce(T.non_blank("_ae"), T.non_blank("_re")),
            "latency_ms": F.coalesce("_al", "_rl"),
            "retrieved_documents": F.array_join("retrieved_document_ids", ", "),
            "retrieved_page_list": F.array_join(F.transform("retrieved_pages", lambda p: p.cast("string")), ", "),
            "reviewer_notes": F.lit(""),
        })
        .drop("_a", "_r", "_ae", "_re", "_al", "_rl", "retrieved_document_ids", "retrieved_pages")
    )


def summary_report(summary: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(metric, value, measurement_status)`` rows from one summary row."""
    pairs = ", ".join(f"'{n}', CAST({n} AS DOUBLE)" for n in names)
    rows = summary.selectExpr(f"stack({len(names)}, {pairs}) AS (metric, value)")
    return rows.withColumn(
        "measurement_status", F.when(F.col("value").isNull(), "NOT_MEASURED").otherwise("MEASURED")
    )
