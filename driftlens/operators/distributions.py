"""Size distributions, concentrations and what is derived from them, for all images at once.

Particles are summed to (image, class) first; everything after works on at most 52 rows an
image, whatever the number of particles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions import sizes

JUNGE_FROM, JUNGE_TO = 150.0, 300.0  # µm, exclusive


def counts(particles: DataFrame, pixel_size: float, keys: list[str]) -> DataFrame:
    """(keys, bin, n) of the classes that have particles."""
    return particles.select(*keys, sizes.bin_of(F.col("equivalent_diameter") * pixel_size).alias("bin")).where(F.col("bin").isNotNull()).groupBy(*keys, "bin").agg(F.count("*").cast("double").alias("n"))


def distribution(particles: DataFrame, pixel_size: float, keys: list[str], groups: DataFrame | None = None) -> DataFrame:
    """(keys, bin, dia, dd, n) with all 52 classes of every group; ``groups`` adds groups without particles."""
    bins = F.broadcast(sizes.size_bins(particles.sparkSession).select("bin", "dia", "dd"))  # 52 rows
    groups = particles.select(*keys).distinct() if groups is None else groups
    found = counts(particles, pixel_size, keys)
    every = groups.crossJoin(bins) if keys else bins
    return every.join(found, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)))


def hide_first(nd: DataFrame, keys: list[str]) -> DataFrame:
    """Null the first class with particles of every group: it is cut by the resolution."""
    first = F.min(F.when(F.col("n") > 0, F.col("bin"))).over(Window.partitionBy(*keys)) if keys else F.lit(None)
    return nd.withColumn("n", F.when(F.coalesce(F.col("bin") == first, F.lit(False)), F.lit(None)).otherwise(F.col("n")))


def d50(nd: DataFrame, keys: list[str]) -> DataFrame:
    """Median diameter by volume: the cumulative volume share, interpolated at one half.

    The last class at or below one half and the next one; below the first class its mid-point;
    null without volume.
    """
    by = Window.partitionBy(*keys).orderBy("bin")
    v = sizes.volume(F.col("n"), F.col("dia"))
    share = nd.withColumn("v", v).withColumn("cs", F.sum("v").over(by.rowsBetween(Window.unboundedPreceding, 0)) / F.nullif(F.sum("v").over(Window.partitionBy(*keys)), F.lit(0.0)))
    share = share.withColumn("cs2", F.lead("cs").over(by)).withColumn("dia2", F.lead("dia").over(by))
    at = share.groupBy(*keys).agg(F.max(F.when(F.col("cs") <= 0.5, F.struct("bin", "dia", "cs", "dia2", "cs2"))).alias("x"), F.min(F.struct("bin", "dia")).alias("first"), F.max("cs").alias("top"))
    x = F.col("x")
    between = x["dia"] + (0.5 - x["cs"]) * (x["dia2"] - x["dia"]) / F.nullif(x["cs2"] - x["cs"], F.lit(0.0))
    return at.select(*keys, F.when(F.col("top").isNotNull(), F.when(x.isNull(), F.col("first.dia")).otherwise(F.coalesce(between, x["dia"]))).alias("d50"))


def junge(nd: DataFrame, keys: list[str]) -> DataFrame:
    """Slope of ln n over ln d between JUNGE_FROM and JUNGE_TO, classes without particles left out."""
    use = (F.col("n") > 0) & (F.col("dia") > JUNGE_FROM) & (F.col("dia") < JUNGE_TO)
    y, x = F.when(use, F.log("n")), F.when(use, F.log("dia"))
    return nd.groupBy(*keys).agg(F.when(F.count(y) >= 2, F.regr_slope(y, x)).alias("junge"))


def rescaled(nd: DataFrame, sample_volume: float | Column) -> DataFrame:
    """Number per litre and µm; negative values null."""
    scaled = F.col("n") / sample_volume / F.col("dd")
    return nd.withColumn("nd", F.when(scaled >= 0, scaled))


def concentrations(nd: DataFrame, keys: list[str], sample_volume: float, junge_of: str = "nd") -> DataFrame:
    """nc (number/L), vc (µL/L), sample_volume and junge of every group; ``images`` images each."""
    scaled = hide_first(rescaled(nd, sample_volume), keys).withColumn("n", F.when(F.col("n").isNotNull(), F.col("nd")))
    totals = nd.groupBy(*keys).agg((F.sum("n") / sample_volume).alias("nc"), F.sum(sizes.volume(F.col("n"), F.col("dia"), sample_volume)).alias("vc"))
    slopes = junge(scaled, keys)
    return totals.join(slopes, keys) if keys else totals.crossJoin(slopes)
