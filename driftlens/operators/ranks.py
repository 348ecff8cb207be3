"""Places and running sums over a whole table, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.sources import stores

PART, AT = "__part", "__at"


def dealt(rows: DataFrame, *order: str | Column) -> DataFrame:
    """The rows written in ranges of ``order``, sorted in each: ``__at`` ascends in that order over the whole table, ``__part`` is the range.

    Rows that are equal in all of ``order`` are one range: end it with something that tells them apart.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return stores.kept(ranged.withColumn(PART, F.spark_partition_id()).withColumn(AT, F.monotonically_increasing_id()), "dealt")


def running(table: DataFrame, value: Column, groups: list[str], before: str) -> DataFrame:
    """Add ``before``: the sum of ``value`` over the earlier rows of the same ``groups`` in a table of ``dealt``.

    A range is summed in itself and moved by what the ranges before it hold, one row a range and
    group. ``groups`` may not be null.
    """
    of = "__value"
    table = table.withColumn(of, value)
    by_range = Window.partitionBy(*groups).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    shares = table.groupBy(PART, *groups).agg(F.sum(of).alias("__sum"))
    shares = shares.select(PART, *groups, F.coalesce(F.sum("__sum").over(by_range), F.lit(0)).alias("__moved"))
    within = Window.partitionBy(PART, *groups).orderBy(AT).rowsBetween(Window.unboundedPreceding, -1)
    inside = table.withColumn("__inside", F.coalesce(F.sum(of).over(within), F.lit(0)))
    return inside.join(shares, [PART, *groups]).withColumn(before, F.col("__moved") + F.col("__inside")).drop(of, "__inside", "__moved")


def numbered(rows: DataFrame, *order: str | Column, name: str = "ord") -> DataFrame:
    """Add ``name``, the place from 0 in ``order``."""
    table = dealt(rows, *order)
    sizes = table.groupBy(PART).agg(F.count("*").alias("__size"), F.min(AT).alias("__first"))  # a row a range
    before = F.coalesce(F.sum("__size").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = sizes.select(PART, (before - F.col("__first")).alias("__moved"))
    return table.join(F.broadcast(moved), PART).withColumn(name, F.col(AT) + F.col("__moved")).drop(PART, AT, "__moved")
