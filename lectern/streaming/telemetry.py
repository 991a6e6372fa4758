"""Streaming telemetry: the last version of every trace, daily totals per category; the live answer log.

Daily totals are kept by difference.  The state store holds, per trace, what its last version counts; a newer version
takes that back and adds its own, an older or repeated one changes nothing, however late it comes.  Traces are kept
in hashed buckets, one state entry each, so a micro-batch makes as many state calls as it meets buckets and compares
whole columns.  It writes the sums of its differences per day and category and the buckets that changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lectern.operators.answers import answer_log
from lectern.streaming import folders

#: What the state keeps of a trace's last version, in the order that decides between equal versions.
STORED = pa.schema([
    ("trace_id", pa.string()), ("version", pa.int64()), ("day", pa.string()), ("category", pa.string()), ("success", pa.bool_()),
    ("latency_ms", pa.float64()), ("total_cost", pa.float64()),
])
COUNTED = STORED.names
#: Traces share a state per bucket; a stream keeps the number it was started with.
BUCKETS = 256
AMOUNTS = ("requests", "failures", "measured", "latency_ms", "total_cost")
DIFFERENCE = "day string, category string, requests long, failures long, measured long, latency_ms double, total_cost double"


def write_traces(traces: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep every micro-batch of ``trace_id, version, ...`` in its own folder, so a replayed batch replaces itself.

    A batch keeps the last version of each of its traces.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        latest(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return traces.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(traces: DataFrame) -> DataFrame:
    """The row of the greatest version of every trace; of equal versions, the greatest row."""
    rest = [c for c in traces.columns if c not in ("trace_id", "version")]
    return traces.groupBy("trace_id").agg(F.max(F.struct("version", *rest)).alias("_row")).select("trace_id", "_row.*")


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """One row per trace over all batches, however late its last version came."""
    return latest(spark.read.parquet(path).drop("batch"))


def daily(traces: DataFrame) -> DataFrame:
    """Requests, failures, mean latency and cost per day and category."""
    return traces.groupBy(F.to_date("created_at").alias("day"), F.coalesce("category", F.lit("UNKNOWN")).alias("category")).agg(
        F.count("*").alias("requests"),
        F.count_if(~F.col("success")).alias("failures"),
        F.avg("latency_ms").alias("average_latency_ms"),
        F.sum("total_cost").alias("total_cost"),
    )


class _Versions(StatefulProcessor):
    """Differences that the new versions of a bucket's traces make to the totals; the state is the bucket as one table."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "versions binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = pa.ipc.open_stream(self.last.get()[0]).read_pandas() if self.last.exists() else pd.DataFrame(columns=COUNTED)
        now = before.assign(known=True)
        for frame in rows:
            now = _last(pd.concat([now, frame[COUNTED].assign(known=False)], ignore_index=True) if len(now) else frame[COUNTED].assign(known=False))
        changed = now[~now["known"].astype(bool)]
        if len(changed):
            self.last.update((_packed(now[COUNTED]),))
            replaced = before[before["trace_id"].isin(changed["trace_id"])]
            yield pd.concat([_amounts(v, sign) for v, sign in ((replaced, -1), (changed, 1)) if len(v)]).groupby(["day", "category"], dropna=False, as_index=False).sum()

    def close(self) -> None:
        pass


def _last(versions: pd.DataFrame) -> pd.DataFrame:
    """The greatest version of every trace, missing values first; of equal ones the one known before."""
    return versions.sort_values([*COUNTED, "known"], na_position="first").drop_duplicates("trace_id", keep="last")


def _packed(versions: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(versions, schema=STORED, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _amounts(versions: pd.DataFrame, sign: int) -> pd.DataFrame:
    number = lambda name: sign * versions[name].astype(float)
    return pd.DataFrame({
        "day": versions["day"], "category": versions["category"], "requests": sign, "failures": sign * versions["success"].eq(False).astype(int),
        "measured": sign * versions["latency_ms"].notna().astype(int), "latency_ms": number("latency_ms").fillna(0.0),
        "total_cost": number("total_cost").fillna(0.0),
    })


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("day", "category").agg(*[F.sum(a).alias(a) for a in AMOUNTS])


def write_daily(traces: DataFrame, root: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Write the differences that every micro-batch of ``trace_id, version, ...`` makes to the daily totals below ``root``."""
    counted = traces.select(
        F.col("trace_id").cast("string").alias("trace_id"), F.col("version").cast("long").alias("version"), F.date_format(F.date_trunc("day", "created_at"), "yyyy-MM-dd").alias("day"),
        F.coalesce("category", F.lit("UNKNOWN")).alias("category"), "success", F.col("latency_ms").cast("double").alias("latency_ms"),
        F.col("total_cost").cast("double").alias("total_cost"),
    ).filter("version IS NOT NULL")
    keyed = counted.withColumn("bucket", F.pmod(F.xxhash64("trace_id"), F.lit(buckets)))
    differences = keyed.groupBy("bucket").transformWithStateInPandas(_Versions(), DIFFERENCE, "update", "None")
    return folders.start(differences, lambda batch, i: folders.save(_summed(batch), i, root, _summed), checkpoint)


def read_daily(spark: SparkSession, root: str) -> DataFrame:
    """The totals that the stream has written: requests, failures, mean latency and cost per day and category."""
    totals = folders.read(spark, root, _summed).filter("requests > 0")
    return totals.select(
        F.to_date("day").alias("day"), "category", "requests", "failures",
        (F.col("latency_ms") / F.nullif("measured", F.lit(0))).alias("average_latency_ms"), "total_cost",
    )


def append_answers(answers: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished answers to the log table."""
    return (
        answer_log(answers).writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
