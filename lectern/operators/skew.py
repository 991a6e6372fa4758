"""Helpers that keep hot keys from landing in one task.

A group may hold a third of all rows.  These helpers split such groups by value range or by salt, and
combine small per-block summaries instead of whole groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
#: Rows whose offsets every task may hold (about 60 bytes each), and keys that ``narrowed`` may hold (about 8 bytes each).
OFFSET_ROWS = 4_000_000
NARROWING_KEYS = 16_000_000


def salted_join(big: DataFrame, small: DataFrame, on: list[str], spread_by: str, salts: int = 16) -> DataFrame:
    """Inner equi-join whose ``big`` side is spread over ``salts`` tasks per key.

    ``spread_by`` is a column of ``big`` that varies within a key; ``small`` is repeated once per salt.
    """
    if salts <= 1:
        return big.join(small, on)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"]).drop("_salt")


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows and ``size`` bytes (written as JSON); reads no more rows than that."""
    counted = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return counted[0] <= rows and counted[1] <= size


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint when the row count is checked to be small, no hint otherwise."""
    return F.broadcast(df) if fits(df, rows) else df


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` over all shuffle partitions: for small rows that much work or many rows follow from."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def running_offset(rows: DataFrame, group: str, order: str, count: Column) -> DataFrame:
    """``rows`` plus ``offset``: the sum of ``count`` over earlier ``order`` values of the group.

    Only (group, order, count) goes through the window.  Up to ``OFFSET_ROWS`` offsets travel to the wide rows, which
    stay where they are, under two hashes (128 bits) of (group, order); beyond that the wide row is shuffled by that
    key, which hashes evenly whatever the group sizes are.  ``rows`` are counted, so they had better be a table.
    """
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    light = rows.select(group, order, count.cast("bigint").alias("_n"))
    offsets = light.select(group, order, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("offset"))
    if rows.count() > OFFSET_ROWS:
        return rows.join(offsets, [group, order])
    known = F.col(group).isNotNull() & F.col(order).isNotNull()
    key, check = F.xxhash64(group, order), F.xxhash64(F.lit(1), group, order)
    small = offsets.filter(known).select(key.alias("_key"), check.alias("_check"), "offset")
    # as a difference, the second hash is no key of the join, whose table then has plain numbers as keys
    same = (F.col("_own") == F.col("_key")) & (F.col("_own_check") - F.col("_check") == 0)
    wide = rows.filter(known).withColumns({"_own": key, "_own_check": check})
    return wide.join(F.broadcast(small), same).drop("_own", "_own_check", "_key", "_check")


def narrowed(big: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """Rows of ``big`` whose ``key`` may be one in ``small``, without a shuffle: all that an inner join on it meets.

    The keys of ``small`` set one bit each among eight times as many, and every task gets the words that hold them; up
    to an eighth of the other rows stay as well, so the join must follow.  More than ``NARROWING_KEYS`` leave ``big`` whole.
    ``small`` is counted, so it had better be a table.
    """
    keys = small.count()
    if keys > NARROWING_KEYS:
        return big
    slot = F.pmod(F.xxhash64(key), F.lit(max(64, 8 * keys)))
    place = lambda of: (of % 64).cast("int")
    words = small.filter(F.col(key).isNotNull()).select(slot.alias("_s")).groupBy(F.shiftright("_s", 6).alias("_word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), place(F.col("_s")))).alias("_bits"))
    tested = big.withColumn("_slot", slot).join(F.broadcast(words), F.shiftright("_slot", 6) == F.col("_word"))
    return tested.filter(F.getbit("_bits", place(F.col("_slot"))) == 1).drop("_slot", "_word", "_bits")


def dense_index(rows: DataFrame, group: str, order: str, block: int = 4096) -> DataFrame:
    """``rows`` plus ``n`` (1-based position inside the group) and ``block_id``.

    The group is cut into ranges of ``block`` order values; positions inside a range and the running
    count of ranges are computed apart, so no task sorts a whole hot group.  ``order`` must be a
    BIGINT that is unique inside the group.
    """
    cut = rows.withColumn("_range", F.floor(F.col(order) / F.lit(block)).cast("bigint"))
    sizes = cut.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(group, "_range").orderBy(order)
    numbered = cut.withColumn("_rn", F.row_number().over(inside))
    return (
        numbered.join(offsets, [group, "_range"])
        .withColumn("n", F.col("_offset") + F.col("_rn"))
        .withColumn("block_id", F.floor((F.col("n") - 1) / F.lit(block)).cast("bigint"))
        .drop("_range", "_rn", "_offset")
    )


def with_halo(rows: DataFrame, block: int, halo: int) -> DataFrame:
    """Copy the last ``halo`` rows of every block into the next one (``is_halo`` marks the copies), so
    a frame of up to ``halo`` preceding rows can run inside (group, block_id)."""
    position = (F.col("n") - 1) % F.lit(block)
    targets = F.when(
        position >= block - halo,
        F.array(
            F.struct(F.col("block_id").alias("b"), F.lit(False).alias("h")),
            F.struct((F.col("block_id") + 1).alias("b"), F.lit(True).alias("h")),
        ),
    ).otherwise(F.array(F.struct(F.col("block_id").alias("b"), F.lit(False).alias("h"))))
    return (
        rows.withColumn("_t", F.explode(targets))
        .withColumns({"block_id": F.col("_t.b"), "is_halo": F.col("_t.h")})
        .drop("_t")
    )


def carried_last(rows: DataFrame, group: str, value: Column, order: str = "n") -> DataFrame:
    """``(group, block_id, carry)``: the last non-null ``value`` of all earlier blocks.

    One row per block reaches the window, however many rows the group has.
    """
    ends = rows.groupBy(group, "block_id").agg(
        F.max_by(value, F.when(value.isNotNull(), F.col(order))).alias("_last")
    )
    earlier = Window.partitionBy(group).orderBy("block_id").rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(group, "block_id", F.last("_last", ignorenulls=True).over(earlier).alias("carry"))
