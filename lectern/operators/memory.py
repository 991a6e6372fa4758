"""Bounded conversation memory, follow-up rewriting and their evaluation.

Exchanges are rows ``conversation_id, position, query, answer``; ``position`` is a BIGINT that orders
and identifies an exchange inside its conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import skew

# Message and summary sizes, the follow-up pattern.
MESSAGE_CHARS, ANSWER_CHARS, SUMMARY_CHARS = 240, 1600, 2400
FULL_MESSAGES, KEPT_MESSAGES = 10, 8
TOPIC_TOKENS = 3
FOLLOW_UP = (
    r"(?iU)\b(?:it|that|this|those|these|the second point|the previous answer|same example|another example)\b|"
    r"^\s*(?:simplify|summari[sz]e|rewrite|convert|continue|what about|why|show another)\b"
)
# A summary keeps 2400 characters and one evicted exchange adds at least 23 ("user: ", "assistant: "
# and two separators), so 112 earlier exchanges always cover it.
BLOCK, HALO = 4096, 112


def evicted_exchanges(n: Column) -> Column:
    """How many exchanges have left the message list after ``n``: the list is cut from twelve messages
    back to eight, so four (even ``n``) or five (odd ``n``) exchanges stay."""
    kept = F.when(n % 2 == 0, F.lit(KEPT_MESSAGES // 2)).otherwise(F.lit(FULL_MESSAGES // 2))
    return F.when(n <= FULL_MESSAGES // 2, F.lit(0)).otherwise(n - kept)


def _compact(role: str, text: Column) -> Column:
    return F.concat(F.lit(f"{role}: "), F.substring(T.collapse(text), 1, MESSAGE_CHARS))


def _blocks(exchanges: DataFrame, block: int) -> tuple[DataFrame, Column, Column]:
    """Numbered exchanges with halo copies, the topic before each row and the topic after it."""
    if block < HALO:
        raise ValueError(f"a block must hold the {HALO} exchanges that a summary may reach back")
    numbered = skew.dense_index(exchanges, "conversation_id", "position", block).withColumn(
        "_topic", F.when(T.token_count("query") >= TOPIC_TOKENS, F.col("query"))
    )
    carried = skew.carried_last(numbered, "conversation_id", F.col("_topic"))
    rows = skew.with_halo(numbered, block, HALO).join(carried, ["conversation_id", "block_id"], "left")
    inside = Window.partitionBy("conversation_id", "block_id").orderBy("n")
    own = F.when(~F.col("is_halo"), F.col("_topic"))
    before = F.coalesce(
        F.last(own, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("carry")
    )
    after = F.coalesce(F.last(own, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.col("carry"))
    return rows, before, after


def states(exchanges: DataFrame, block: int = BLOCK) -> DataFrame:
    """Memory after every exchange: kept messages, summary of evicted ones, active topic.

    Conversations are cut into blocks of ``block`` exchanges with a halo of earlier ones, so the
    frames are bounded and one endless conversation is still spread over many tasks.
    """
    rows, _, after = _blocks(exchanges, block)
    frame = Window.partitionBy("conversation_id", "block_id").orderBy("n").rowsBetween(-HALO, 0)
    item = F.struct(
        "n", "query", F.substring("answer", 1, ANSWER_CHARS).alias("answer"),
        F.concat_ws(" | ", _compact("user", F.col("query")),
                    _compact("assistant", F.substring("answer", 1, ANSWER_CHARS))).alias("compact"),
    )
    listed = rows.withColumns({"_item": item}).withColumns(
        {"_recent": F.collect_list("_item").over(frame), "active_topic": after}
    ).filter(~F.col("is_halo"))
    gone = evicted_exchanges(F.col("n"))
    evicted = F.transform(F.filter("_recent", lambda x: x["n"] <= gone), lambda x: x["compact"])
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    kept = F.flatten(F.transform(
        F.filter("_recent", lambda x: x["n"] > gone),
        lambda x: F.array(message("user", x["query"]), message("assistant", x["answer"])),
    ))
    return listed.select(
        "conversation_id", "position", "n", "query",
        kept.alias("recent_messages"),
        F.right(F.array_join(evicted, " | "), F.lit(SUMMARY_CHARS)).alias("summary"),
        "active_topic",
    )


def depends_on_memory(query: Column | str) -> Column:
    return T.strip(query).rlike(FOLLOW_UP)


def rewrite(query: Column, topic: Column, prior_user: Column) -> Column:
    """The standalone form of a follow-up; any other question stays as it is."""
    prior = F.coalesce(T.non_blank(topic), T.non_blank(prior_user))
    standalone = F.concat(F.lit("Previous topic: "), prior, F.lit("\nCurrent request: "), T.strip(query))
    return F.when(depends_on_memory(query) & prior.isNotNull(), standalone).otherwise(T.strip(query))


def rewritten(exchanges: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every exchange's query, rewritten from the memory before it where it is a follow-up."""
    rows, before, _ = _blocks(exchanges, block)
    inside = Window.partitionBy("conversation_id", "block_id").orderBy("n")
    placed = rows.withColumns({"_before": before, "_prior": F.lag("query").over(inside)}).filter(~F.col("is_halo"))
    return placed.select(
        "conversation_id", "position", "n", "query",
        rewrite(F.col("query"), F.col("_before"), F.col("_prior")).alias("standalone_query"),
    )


def relevant_messages(state: DataFrame, query: str = "query", messages: str = "messages", limit: int = 4) -> DataFrame:
    """The ``limit`` messages sharing most terms with the query, recent ones first among equals, in
    list order.  The message list of a memory state is never longer than ten."""
    count = F.greatest(F.lit(1), F.size(messages))

    def choose(wanted: Column) -> Column:
        scored = F.transform(
            F.col(messages),
            lambda m, i: F.struct(
                (T.overlap(wanted, T.token_set(m["content"])) * 3 + (i + 1) / count).alias("score"), i.alias("i"), m.alias("m")
            ),
        )
        best = F.slice(F.sort_array(scored, asc=False), 1, limit)
        in_order = F.array_sort(F.transform(best, lambda s: F.struct(s["i"].alias("i"), s["m"].alias("m"))))
        return F.transform(in_order, lambda s: s["m"])

    return state.withColumn("relevant", T.let(T.token_set(query), choose))


def evaluation_rows(records: DataFrame) -> DataFrame:
    """Rewrite and retention recall, injected share and savings of ``id, prior, followup, expected_topic``."""
    rewrite_of = rewrite(F.col("followup"), F.col("prior"), F.col("prior"))
    based = records.withColumn("rewritten_query", rewrite_of)
    recall = lambda expected: T.coverage(T.long_terms(expected), T.token_set("rewritten_query"))
    full = F.length("prior") + F.lit(len("Prior grounded response"))
    share = F.greatest(F.lit(0), F.length("rewritten_query") - F.length("followup")) / F.greatest(F.lit(1), full)
    return based.select(
        "id", "followup", "rewritten_query",
        recall(F.col("prior")).alias("query_rewrite_accuracy"),
        recall(F.col("expected_topic")).alias("context_retention_accuracy"),
        share.alias("context_compression_ratio"),
        (1 - F.least(F.lit(1.0), share)).alias("token_savings"),
    )


def evaluation_summary(rows: DataFrame) -> DataFrame:
    names = ("query_rewrite_accuracy", "context_retention_accuracy", "context_compression_ratio", "token_savings")
    return rows.agg(
        F.when(F.count("*") > 0, "MEASURED").otherwise("NOT_MEASURED").alias("status"),
        F.count("*").alias("scored_count"), *[F.avg(n).alias(n) for n in names],
    )
