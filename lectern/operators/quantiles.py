"""Exact order statistics without one task that sees all values.

Values are counted by value, the counts are sorted by ranges, and ranges are placed by their totals; a rank then
lies in one range, and only the ranges that hold an asked rank are numbered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import settled


def at_ranks(rows: DataFrame, value: str, ranks: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """One row with the values at 1-based ranks of the values that aren't null; ``ranks`` gives them from the count.

    Without values every column is null.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    ranged = settled(counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()), "value_counts")
    # one row a range from here on
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("part").agg(F.sum("n").alias("here")).withColumn("before", F.coalesce(F.sum("here").over(earlier), F.lit(0)))
    total = F.sum("here").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    asked = ranks(F.col("total"))
    wanted = parts.withColumn("total", total).select(
        "part", "before", "here", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("bigint").alias("rank")) for name, rank in asked.items()])).alias("_w")
    ).select("part", "before", "_w.*", "here").filter((F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("before") + F.col("here")))
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("value"))
    held = ranged.join(wanted.select("part").distinct(), "part", "left_semi").withColumn("upto", upto)
    place = (F.col("rank") > F.col("before") + F.col("upto") - F.col("n")) & (F.col("rank") <= F.col("before") + F.col("upto"))
    found = held.join(wanted.drop("here"), "part").filter(place)
    return found.agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in asked])
