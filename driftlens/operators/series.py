"""Time series: interpolation joins and distributions by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions import sizes
from driftlens.operators import profiles


def interpolated(points: DataFrame, series: DataFrame, value: str, clamp: bool = False, block_hours: int = 24) -> DataFrame:
    """(timestamp, value): the series interpolated linearly at each time of ``points``.

    Outside the series null, or its end value if ``clamp``; null at a null time. Both tables are
    dealt out once, by blocks of time. Within a block neighbours come from windows; where a block
    has none to a side, the nearest of the blocks before or after it is used, which is found from
    one first and one last row a block. No task sees a whole deployment. What follows comes from
    ``lead``, as a frame that ends with the partition is gone through anew for each row.
    """
    block = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(block_hours * 3_600_000_000))
    times = points.select(F.col("timestamp").alias("t")).distinct().select("t", F.lit(None).cast("double").alias("v"), F.lit(True).alias("asked"))
    known = series.select(F.col("time").alias("t"), F.col(value).alias("v"), F.lit(False).alias("asked")).where("t IS NOT NULL")
    both = times.unionByName(known).withColumn("block", block("t")).repartition("block")  # read by both the windows and the edges
    own = F.when(~F.col("asked"), F.struct("t", "v"))
    edges = both.groupBy("block").agg(F.min(own).alias("first"), F.max(own).alias("last"))
    before = Window.unboundedPreceding
    up, down = Window.orderBy("block"), Window.orderBy(F.col("block").desc())  # a row a block
    sides = edges.select("block", F.last("last", True).over(up.rowsBetween(before, -1)).alias("prev"), F.last("first", True).over(down.rowsBetween(before, -1)).alias("next"))
    by = Window.partitionBy("block").orderBy("t", "asked")
    near = both.withColumn("own", own).withColumn("lo", F.last("own", True).over(by.rowsBetween(before, 0))).withColumn("hi", F.expr("lead(own) IGNORE NULLS").over(by)).where("asked")
    near = near.join(sides, "block", "left").select("t", F.coalesce("lo", "prev").alias("lo"), F.when(F.col("lo.t") == F.col("t"), F.col("lo")).otherwise(F.coalesce("hi", "next")).alias("hi"))
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    span = seconds("hi.t") - seconds("lo.t")
    inside = F.when(span == 0, F.col("lo.v")).otherwise(F.col("lo.v") + (F.col("hi.v") - F.col("lo.v")) * (seconds("t") - seconds("lo.t")) / F.nullif(span, F.lit(0)))
    out = F.coalesce(inside, F.col("lo.v"), F.col("hi.v")) if clamp else inside
    return near.select(F.col("t").alias("timestamp"), out.alias(value))


def volume_series(particles: DataFrame, times: DataFrame, pixel_size: float, sample_volume: float) -> DataFrame:
    """A row for each time, in order: 52 volume columns (vd_0 ...), and d50; zeros and null where a time has no particles."""
    rows = times.select("timestamp").distinct().join(profiles.profiles(particles, pixel_size, ["timestamp"]), "timestamp", "left")
    rows = rows.select("timestamp", F.coalesce("n", profiles.counted(F.create_map().cast("map<int,double>"))).alias("n"))
    wide = profiles.measured(rows, sample_volume)
    return wide.select("timestamp", *[F.get("v", F.lit(k)).alias(f"vd_{k}") for k in range(sizes.COUNT)], "d50").orderBy("timestamp")
