"""Size profiles: the 52 counts of an image as one array, and what follows from it as expressions.

Particles are read once and summed to (keys, class), then to one row for each set of keys;
everything after is an expression on that row and needs no join, window or second scan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.functions import sizes
from driftlens.operators.distributions import JUNGE_FROM, JUNGE_TO


def profiles(particles: DataFrame, pixel_size: float, keys: list[str], firsts: list[str] | None = None) -> DataFrame:
    """(keys, n, particle_count, firsts): ``n`` has the counts of the 52 classes as doubles.

    ``firsts`` are columns that are the same for all particles of a row's keys. A particle
    outside all classes counts in ``particle_count`` only, a row without a diameter nowhere.
    """
    same = firsts or []
    classed = particles.select(*keys, *same, "equivalent_diameter", sizes.bin_of(F.col("equivalent_diameter") * pixel_size).alias("bin"))
    by_class = classed.groupBy(*keys, "bin").agg(F.count("equivalent_diameter").alias("k"), *[F.min(c).alias(c) for c in same])
    found = F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct(F.col("bin").cast("int"), F.col("k").cast("double")))))
    rows = by_class.groupBy(*keys).agg(found.alias("found"), F.sum("k").alias("particle_count"), *[F.min(c).alias(c) for c in same])
    return rows.select(*keys, counted(F.col("found")).alias("n"), "particle_count", *same)


def counted(found: Column) -> Column:
    """The 52 counts of a map from class to count; 0 where it has none, or is null."""
    return F.transform(F.sequence(F.lit(0), F.lit(sizes.COUNT - 1)), lambda k: F.coalesce(F.element_at(found, k), F.lit(0.0)))


def _constant(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def volumes(n: Column, sample_volume: float = 1.0) -> Column:
    """Volume of each class in microlitres (a litre)."""
    return F.zip_with(n, _constant(sizes.mid_points()), lambda x, d: sizes.volume(x, d, sample_volume))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def measured(rows: DataFrame, sample_volume: float) -> DataFrame:
    """Add d50, nc, vc, junge and ``v`` (the volume of each class) to rows with ``n``.

    d50 is the median diameter by volume, interpolated between the classes around one half, and
    null without volume. junge is the slope of ln(number a litre and micrometre) over
    ln(diameter) between JUNGE_FROM and JUNGE_TO, without the first class that has particles,
    which the resolution cuts; null with fewer than two classes. Each step is a column of its
    own, so that none is worked out again for every element of another.
    """
    dia, width = sizes.mid_points(), sizes.gradient(sizes.mid_points())
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("all"))
    running = F.aggregate(F.col("v"), start, lambda a, v: F.struct((a["sum"] + v).alias("sum"), F.concat(a["all"], F.array(a["sum"] + v)).alias("all")), lambda a: a["all"])
    rows = rows.withColumn("v", volumes(F.col("n"), sample_volume)).withColumn("_run", running).withColumn("vc", F.element_at("_run", -1))
    rows = rows.withColumn("_below", F.size(F.filter("_run", lambda x: x <= 0.5 * F.col("vc"))))
    at = lambda k: F.get(F.lit(dia), k)
    lo, hi, k = F.get("_run", F.col("_below") - 1), F.get("_run", "_below"), F.col("_below")
    between = at(k - 1) + (0.5 * F.col("vc") - lo) * (at(k) - at(k - 1)) / F.nullif(hi - lo, F.lit(0.0))
    rows = rows.withColumn("d50", F.when(F.col("vc") > 0, F.when(k == 0, at(k)).otherwise(F.coalesce(between, at(k - 1)))))
    rows = rows.withColumn("nc", total(F.col("n")) / sample_volume)
    inside = [k for k in range(sizes.COUNT) if JUNGE_FROM < dia[k] < JUNGE_TO]
    earlier = F.aggregate("n", F.struct(F.lit(0).alias("at"), F.lit(False).alias("seen")), lambda a, x: F.struct((a["at"] + F.when(a["seen"] | (x > 0), 0).otherwise(1)).alias("at"), (a["seen"] | (x > 0)).alias("seen")), lambda a: a["at"])
    rows = rows.withColumn("_first", earlier)
    points = [F.when((F.get("n", F.lit(k)) > 0) & (F.col("_first") != k), F.struct(F.lit(math.log(dia[k])).alias("x"), F.log(F.get("n", F.lit(k)) / sample_volume / float(width[k])).alias("y"))) for k in inside]
    rows = rows.withColumn("_points", F.filter(F.array(*points), lambda p: p.isNotNull()))
    size = F.nullif(F.size("_points"), F.lit(0))
    rows = rows.withColumns({"_x": F.aggregate("_points", F.lit(0.0), lambda a, p: a + p["x"]) / size, "_y": F.aggregate("_points", F.lit(0.0), lambda a, p: a + p["y"]) / size})
    over = F.aggregate("_points", F.lit(0.0), lambda a, p: a + (p["x"] - F.col("_x")) * (p["y"] - F.col("_y")))
    under = F.aggregate("_points", F.lit(0.0), lambda a, p: a + (p["x"] - F.col("_x")) * (p["x"] - F.col("_x")))
    rows = rows.withColumn("junge", F.when(F.size("_points") >= 2, over / F.nullif(under, F.lit(0.0))))
    return rows.drop("_run", "_below", "_first", "_points", "_x", "_y")


def image_stats(particles: DataFrame, pixel_size: float, sample_volume: float, key: str | list[str] = "timestamp", also: tuple[str, ...] = ()) -> DataFrame:
    """A row an image: filename, particle_count, saturation, d50, nc, vc, sample_volume, junge and ``also``.

    An image without particles is one row with a null diameter, as ``particles.extracted`` makes them, so refused, broken and empty
    frames are kept: they have counts and concentrations of 0 and no d50 or junge. ``also``
    are columns that are the same for all rows of an image.
    """
    keys = [key] if isinstance(key, str) else key
    firsts = [c for c in ("filename", "saturation", *also) if c not in keys]
    rows = measured(profiles(particles, pixel_size, keys, firsts), sample_volume)
    return rows.select(*dict.fromkeys([*keys, "filename", "particle_count", "saturation", "d50", "nc", "vc"]), F.lit(sample_volume).alias("sample_volume"), "junge", *also)


def last_image(stats: DataFrame, key: str = "timestamp") -> DataFrame:
    """The row of the latest image; of equal times that with the greatest filename."""
    return stats.orderBy(F.col(key).desc_nulls_last(), F.col("filename").desc_nulls_last()).limit(1)
