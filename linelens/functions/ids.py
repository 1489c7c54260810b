"""Dense ids without a global sort of all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a window holds at most for dense keys.
BLOCK = 1 << 16


def running_start(df: DataFrame, key: str, size: Column, name: str, *, block: int = BLOCK) -> DataFrame:
    """Add the sum of `size` over all rows with a smaller key (a dense, unique number).

    Two levels: sums of blocks of keys meet in one window, which has a row for each
    block; inside a block a window of its own adds up.
    """
    marked = df.withColumn("__size", size).withColumn("__block", F.floor(F.col(key) / block))
    sums = marked.groupBy("__block").agg(F.sum("__size").alias("__sum"))
    ahead = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("__block", F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return marked.withColumn("__in", F.coalesce(F.sum("__size").over(inside), F.lit(0))).join(starts, "__block").withColumn(name, (F.col("__start") + F.col("__in")).cast("bigint")).drop("__size", "__block", "__start", "__in")


def dense_ids(df: DataFrame, order: list[str], name: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Number rows from 0 in an order, by a range shuffle and the counts of its partitions.

    `keep` writes a table and reads it again: the ranges are drawn from a sample, and
    the counts and the rows have to come from the same draw.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = keep(ranged.withColumn("__at", F.monotonically_increasing_id()))
    # The id's upper bits are the partition and its lower ones the place in it.
    marked = marked.withColumn("__part", F.shiftright("__at", 33)).withColumn("__place", F.col("__at").bitwiseAND((1 << 33) - 1))
    counts = marked.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__start"))
    # A row for each partition of the shuffle.
    return marked.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__place")).drop("__at", "__part", "__place", "__start")
