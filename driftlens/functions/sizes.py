"""Size classes and the column functions of size distributions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The first mid-point (µm), the ratio of neighbours, the lower limit's share of a mid-point, the number of classes.
FIRST, RATIO, LOWER, COUNT = 2.72, 1.18, 0.91, 52


def mid_points() -> list[float]:
    """Mid-points by repeated multiplication (powers differ in the last place)."""
    out = [FIRST]
    while len(out) < COUNT:
        out.append(out[-1] * RATIO)
    return out


def limits() -> list[float]:
    out = [FIRST * LOWER]
    while len(out) <= COUNT:
        out.append(out[-1] * RATIO)
    return out


def gradient(values: list[float]) -> list[float]:
    """Central differences, one-sided at the ends."""
    n = len(values)
    return [(values[min(i + 1, n - 1)] - values[max(i - 1, 0)]) / (min(i + 1, n - 1) - max(i - 1, 0)) for i in range(n)]


def size_bins(spark: SparkSession) -> DataFrame:
    """(bin, dia, lo, hi, dd): the 52 size classes; dd is the gradient of the mid-points."""
    dia, lim = mid_points(), limits()
    return spark.createDataFrame(list(zip(range(COUNT), dia, lim[:-1], lim[1:], gradient(dia))), "bin int, dia double, lo double, hi double, dd double")


def bin_of(um: Column) -> Column:
    """Size class of a diameter in µm; null outside. Half-open classes, the last one closed.

    The class comes from a logarithm and is then set right against the limits themselves, so
    there is no range join.
    """
    lim = limits()
    at = F.array(*[F.lit(x) for x in lim])
    guess = F.least(F.greatest(F.floor(F.log(um / lim[0]) / math.log(RATIO)).cast("int"), F.lit(0)), F.lit(COUNT - 1))
    fixed = F.when(um < F.element_at(at, guess + 1), guess - 1).when((um >= F.element_at(at, guess + 2)) & (guess < COUNT - 1), guess + 1).otherwise(guess)
    return F.when(um.between(lim[0], lim[-1]), fixed)


def volume(number: Column, dia: Column, sample_volume: float | Column = 1.0) -> Column:
    """Volume (µL/L) of ``number`` spheres of diameter ``dia`` µm in ``sample_volume`` litres."""
    return F.lit(4.0 / 3.0 * math.pi) * F.pow(dia / 2 * 1e-6, F.lit(3.0)) * number * 1e9 / sample_volume


def number(vol: Column, dia: Column) -> Column:
    """Inverse of ``volume`` for one litre."""
    return vol / (F.lit(4.0 / 3.0 * math.pi) * F.pow(dia / 2 * 1e-6, F.lit(3.0)) * 1e9)


def sample_volume(pixel_size: float, path_length: float, rows: int = 2048, cols: int = 2448) -> float:
    """Litres imaged by one frame: pixel_size in µm, path_length in mm."""
    return (rows * pixel_size / 1000) * (cols * pixel_size / 1000) * path_length * 1e-6
