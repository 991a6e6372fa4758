"""Query telemetry: latest trace, rolling summary and breakdowns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = (
    "trace_id", "session_id", "created_at", "category", "intent", "success", "failure_category", "latency_ms",
    "input_tokens", "output_tokens", "total_cost", "cache_hit", "data",
)


def latest(traces: DataFrame, order: str = "created_at") -> DataFrame:
    """The last row written per trace id; a combined aggregate, so one repeated id cannot pile up."""
    rest = [c for c in traces.columns if c != "trace_id"]
    return traces.groupBy("trace_id").agg(F.max_by(F.struct(*rest), order).alias("_row")).select("trace_id", "_row.*")


def recent(traces: DataFrame, as_of: datetime, days: int) -> DataFrame:
    since = F.lit(as_of) - F.make_dt_interval(F.lit(days))
    return traces.filter(F.col("created_at") >= since)


def summary(traces: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """One row of totals, means, cost projection and rates over the last ``days`` days."""
    n = F.count("*")
    share = lambda hit, of: F.lit(1.0) - hit / of
    lost = F.count_if(F.col("failure_category").isin("RETRIEVAL_FAILURE", "MISSING_CONTEXT"))
    wrong = F.count_if(F.col("failure_category") == "INVALID_CITATION_IDENTITY")
    totals = recent(traces, as_of, days).agg(
        n.alias("total_requests"),
        F.count_distinct("session_id").alias("active_sessions"),
        F.avg("latency_ms").alias("average_latency_ms"),
        F.avg(F.col("input_tokens") + F.col("output_tokens")).alias("average_tokens"),
        F.avg("total_cost").alias("average_cost"),
        F.coalesce(F.sum("total_cost"), F.lit(0.0)).alias("total_cost"),
        F.avg(F.col("success").cast("double")).alias("success_rate"),
        share(lost, F.greatest(F.lit(1), n)).alias("retrieval_success_rate"),
        F.when(n > 0, share(wrong, F.nullif(n, F.lit(0)))).alias("citation_identity_accuracy"),
        F.avg(F.col("cache_hit").cast("double")).alias("cache_hit_rate"),
    )
    daily = F.col("total_cost") / max(1, days)
    return totals.withColumns({
        "window_days": F.lit(days),
        "daily_cost": daily,
        "weekly_cost": daily * 7,
        "monthly_projected_cost": daily * 30,
    })


def breakdown(traces: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """``(breakdown, label, requests, mean_cost)`` by failure, category and model, from one scan.

    Grouping sets share the scan; the model is read from the JSON document once per row.
    """
    keyed = recent(traces, as_of, days).select(
        F.coalesce("failure_category", F.lit("NONE")).alias("failure"),
        F.coalesce("category", F.lit("UNKNOWN")).alias("category"),
        F.coalesce(F.get_json_object("data", "$.model"), F.lit("non_llm")).alias("model"),
        "total_cost",
    )
    stacked = keyed.selectExpr(
        "stack(3, 'failure', failure, 'category', category, 'model', model) AS (breakdown, label)", "total_cost"
    )
    return stacked.groupBy("breakdown", "label").agg(
        F.count("*").alias("requests"), F.avg("total_cost").alias("mean_cost")
    )
