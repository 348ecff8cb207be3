"""Background correction and thresholds on exploded pixels: (frame, pos, px)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def moving_background(pixels: DataFrame, frames: int, block: int = 256) -> DataFrame:
    """Add ``bg``, the mean of the pixel in the ``frames`` frames before; the first ``frames`` frames go.

    ``frame`` counts the frames without gaps. Frames are dealt out in blocks of at least
    ``frames`` frames, each with the last ``frames`` frames of the block before, so no task
    holds a pixel's whole history.
    """
    block = max(block, frames)
    own = F.floor(F.col("frame") / block)
    also = F.when(F.col("frame") % block >= block - frames, F.array(own, own + 1)).otherwise(F.array(own))
    by = Window.partitionBy("block", "pos").orderBy("frame").rowsBetween(-frames, -1)
    rows = pixels.withColumn("block", F.explode(also)).withColumn("bg", F.avg("px").over(by)).withColumn("seen", F.count("px").over(by))
    return rows.where((F.col("block") == own) & (F.col("seen") == frames)).select("frame", "pos", "px", "bg")


def static_background(pixels: DataFrame, frames: int) -> DataFrame:
    """Add ``bg``, the mean of the first ``frames`` frames (frame counts from 0), to the later ones.

    The background has one row a pixel, which the size of one frame bounds.
    """
    bg = pixels.where(F.col("frame") < frames).groupBy("pos").agg(F.avg("px").alias("bg"))
    return pixels.where(F.col("frame") >= frames).join(bg, "pos").select("frame", "pos", "px", "bg")


def _with(pixels: DataFrame, *aggs) -> DataFrame:
    return pixels.join(pixels.groupBy("frame").agg(*aggs), "frame")


def correct_subtract(pixels: DataFrame) -> DataFrame:
    """px - bg, moved so that the median is one half, then so that the maximum is one."""
    d = pixels.withColumn("d", F.col("px") - F.col("bg"))
    stat = _with(d, F.percentile("d", 0.5).alias("med"), F.max("d").alias("top"))
    level = F.col("d") + (0.5 - F.col("med"))
    return stat.select("frame", "pos", (level + (1 - (F.col("top") + (0.5 - F.col("med"))))).alias("im"))


def correct_divide(pixels: DataFrame) -> DataFrame:
    """px / bg (at least 1/255), median to one half, minimum to zero, clipped to 0..1."""
    d = pixels.withColumn("d", F.col("px") / F.greatest("bg", F.lit(1 / 255)))
    stat = _with(d, F.percentile("d", 0.5).alias("med"), F.min("d").alias("low"))
    level = F.col("d") + (0.5 - F.col("med")) - (F.col("low") + (0.5 - F.col("med")))
    return stat.select("frame", "pos", F.least(F.greatest(level, F.lit(0.0)), F.lit(1.0)).alias("im"))


def correct_fast(pixels: DataFrame) -> DataFrame:
    """px - bg + 215/255, clipped to 0..1."""
    return pixels.select("frame", "pos", F.least(F.greatest(F.col("px") - F.col("bg") + 215 / 255, F.lit(0.0)), F.lit(1.0)).alias("im"))


def threshold_fast(pixels: DataFrame, grey: float = 0.98) -> DataFrame:
    """(frame, pos, dark): whether the pixel is darker than ``grey`` times the frame's median."""
    return _with(pixels, F.percentile("px", 0.5).alias("med")).select("frame", "pos", (F.col("px") < grey * F.col("med")).alias("dark"))


def coverage(mask: DataFrame, most_percent: float = 30.0) -> DataFrame:
    """(frame, covered, accepted): share of dark pixels of what is allowed, and whether that is below 1."""
    covered = F.avg(F.col("dark").cast("double")) * 100 / most_percent
    return mask.groupBy("frame").agg(covered.alias("covered"), (covered < 1).alias("accepted"))


def stack_summary(pixels: DataFrame, depth: int) -> DataFrame:
    """(stack, pos, std, max): population deviation and maximum over the ``depth`` planes of each stack."""
    return pixels.groupBy(F.floor(F.col("frame") / depth).alias("stack"), "pos").agg(F.stddev_pop("px").alias("std"), F.max("px").alias("max"))


def inside_box(pixels: DataFrame, cols: int, r0: int, r1: int, c0: int, c1: int, fill: float = 1.0) -> DataFrame:
    """(frame, pos, im): pixels outside the half-open box are ``fill``."""
    row, col = F.floor(F.col("pos") / cols), F.col("pos") % cols
    inside = (row >= r0) & (row < r1) & (col >= c0) & (col < c1)
    return pixels.select("frame", "pos", F.when(inside, F.col("px")).otherwise(F.lit(fill)).alias("im"))


def inside_circle(pixels: DataFrame, rows: int, cols: int, radius: float, centre: tuple[float, float] | None = None) -> DataFrame:
    """(frame, pos, im): pixels not less than ``radius`` from the centre are 0; the centre is (rows // 2, cols // 2) unless told."""
    r, c = centre or (rows // 2, cols // 2)
    row, col = F.floor(F.col("pos") / cols), F.col("pos") % cols
    near = (row - r) * (row - r) + (col - c) * (col - c) < radius * radius
    return pixels.select("frame", "pos", F.when(near, F.col("px")).otherwise(F.lit(0.0)).alias("im"))


def prepared(channels: DataFrame) -> DataFrame:
    """(frame, pos, least, ref) of pixels by channel (frame, pos, channel, px): the darkest channel of each pixel, and its channels
    as an array scaled so that the frame goes from 0 to 1; a flat frame becomes 0."""
    stat = channels.groupBy("frame").agg(F.min("px").alias("low"), F.max("px").alias("high"))
    scaled = (F.col("px") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    rows = channels.join(stat, "frame").withColumn("ref", F.coalesce(scaled, F.lit(0.0)))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("channel", "ref"))), lambda x: x["ref"])  # a pixel's channels
    return rows.groupBy("frame", "pos").agg(F.min("px").alias("least"), ordered.alias("ref"))
