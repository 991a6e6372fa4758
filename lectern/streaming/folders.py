"""Results of micro-batches as folders: a delta per batch, a snapshot now and then.

A replayed batch writes the same folders again.  A snapshot holds what ``resolve`` makes of the one before and of
the deltas since; readers take the last snapshot and the deltas after it, so neither reading nor compaction grows
with the number of batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
Resolve = Callable[[DataFrame], DataFrame]
#: Batches from one snapshot to the next; the first batch writes one.
SNAPSHOT_EVERY = 16


def save(batch: DataFrame, batch_id: int, root: str, resolve: Resolve, every: int = SNAPSHOT_EVERY) -> None:
    batch.write.mode("overwrite").parquet(f"{root}/deltas/batch={batch_id}")
    if batch_id % every == 0:
        known = _rows(batch.sparkSession, root, batch_id, before=batch_id)
        resolve(known).write.mode("overwrite").parquet(f"{root}/snapshots/upto={batch_id}")


def read(spark: SparkSession, root: str, resolve: Resolve) -> DataFrame:
    """Everything written so far, resolved; ``resolve`` sees a column ``batch``."""
    return resolve(_rows(spark, root, None, before=None))


def _rows(spark: SparkSession, root: str, upto: int | None, before: int | None) -> DataFrame:
    deltas = spark.read.parquet(f"{root}/deltas")
    if upto is not None:
        deltas = deltas.filter(F.col("batch") <= upto)
    if before == 0:
        return deltas
    snapshots = spark.read.parquet(f"{root}/snapshots")
    if before is not None:
        snapshots = snapshots.filter(F.col("upto") < before)
    last = snapshots.agg(F.max("upto")).first()[0]
    if last is None:  # an empty snapshot has no rows: all deltas count
        return deltas
    held = snapshots.filter(F.col("upto") == last).withColumn("batch", F.col("upto")).drop("upto")
    return held.unionByName(deltas.filter(F.col("batch") > last), allowMissingColumns=True)


def start(stream: DataFrame, save_batch: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run a stateful stream over what there is, with a state store that spills to disk and the shared folder."""
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKSDB)
    try:
        return stream.writeStream.outputMode("update").foreachBatch(save_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(PROVIDER, before) if before else conf.unset(PROVIDER)
