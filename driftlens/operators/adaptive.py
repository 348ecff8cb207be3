"""Contrast-limited equalisation by tiles, on exploded pixels (frame, pos, px), and the threshold that uses it.

A tile's histogram is summed by group, clipped, and turned into one array of its running shares; each pixel
meets the arrays of the four tiles around it in a join and takes their weighted mean. No task sees a frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.operators.background import _with


def level(px: Column, bins: int) -> Column:
    """The class of a value from 0 to 1; values outside go to the ends."""
    return F.greatest(F.least(F.floor(px * bins), F.lit(bins - 1)), F.lit(0)).cast("int")


def tile_shares(pixels: DataFrame, cols: int, tile_rows: int, tile_cols: int, bins: int, clip: float) -> DataFrame:
    """(frame, ti, tj, shares): for each tile the share of its pixels up to each class, after clipping.

    A class keeps at most max(1, floor(clip * pixels of the tile)); what is over is spread evenly over all classes.
    """
    row, col = F.floor(F.col("pos") / cols), F.col("pos") % cols
    placed = pixels.select("frame", F.floor(row / tile_rows).alias("ti"), F.floor(col / tile_cols).alias("tj"), level(F.col("px"), bins).alias("b"))
    counts = placed.groupBy("frame", "ti", "tj", "b").agg(F.count("*").alias("n"))
    tiles = counts.groupBy("frame", "ti", "tj").agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("found"), F.sum("n").alias("size"))  # at most one entry a class
    tiles = tiles.withColumn("most", F.greatest(F.floor(F.lit(clip) * F.col("size")), F.lit(1)))
    tiles = tiles.withColumn("over", F.aggregate(F.map_values("found"), F.lit(0).cast("long"), lambda a, n: a + F.greatest(n - F.col("most"), F.lit(0))) / bins)
    kept = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.least(F.coalesce(F.element_at("found", b), F.lit(0).cast("long")), F.col("most")))
    tiles = tiles.withColumn("kept", kept)
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<long>").alias("all"))
    running = F.aggregate("kept", start, lambda a, n: F.struct((a["sum"] + n).alias("sum"), F.concat(a["all"], F.array(a["sum"] + n)).alias("all")), lambda a: a["all"])
    return tiles.withColumn("running", running).select("frame", "ti", "tj", F.transform("running", lambda n, b: (n + (b + 1) * F.col("over")) / F.col("size")).alias("shares"))


def equalised(pixels: DataFrame, rows: int, cols: int, tile_rows: int | None = None, tile_cols: int | None = None, bins: int = 256, clip: float = 0.98) -> DataFrame:
    """Add ``eq``, the pixel's share in the tiles around it, from 0 to 1. Tiles are an eighth of a frame each way unless told.

    A pixel between the centres of four tiles takes their shares by its distance to each; beyond
    the outermost centres the nearest tiles alone count. Pixels without a value have none.
    """
    tile_rows, tile_cols = tile_rows or max(1, rows // 8), tile_cols or max(1, cols // 8)
    last = [-(-rows // tile_rows) - 1, -(-cols // tile_cols) - 1]
    known = pixels.where("px IS NOT NULL")
    shares = tile_shares(known, cols, tile_rows, tile_cols, bins, clip)
    y = (F.floor(F.col("pos") / cols) + 0.5) / tile_rows - 0.5
    x = (F.col("pos") % cols + 0.5) / tile_cols - 0.5

    def near(at: Column, top: int, name: str) -> list[Column]:
        low = F.floor(at)
        inside = lambda k: F.greatest(F.least(k, F.lit(top)), F.lit(0))
        return [F.struct(inside(low).alias(name), (1 - (at - low)).alias("w")), F.struct(inside(low + 1).alias(name), (at - low).alias("w"))]

    ways = [F.struct(a["ti"].alias("ti"), b["tj"].alias("tj"), (a["w"] * b["w"]).alias("w")) for a in near(y, last[0], "ti") for b in near(x, last[1], "tj")]
    around = known.select("frame", "pos", "px", level(F.col("px"), bins).alias("b"), F.explode(F.array(*ways)).alias("t")).select("frame", "pos", "px", "b", "t.*").where("w > 0")
    mean = F.sum(F.col("w") * F.element_at("shares", F.col("b") + 1)).alias("eq")
    return around.join(shares, ["frame", "ti", "tj"]).groupBy("frame", "pos", "px").agg(mean)


def threshold_accurate(pixels: DataFrame, rows: int, cols: int, grey: float = 0.98, bins: int = 256, **tiles: int) -> DataFrame:
    """(frame, pos, eq, dark): darker than ``grey`` times the frame's median, and after equalisation darker than ``grey`` times the
    0.75th percentile of the equalised frame. ``grey`` is also the clip limit. Values are compared to nine digits."""
    eq = equalised(pixels, rows, cols, bins=bins, clip=grey, **tiles).withColumn("eq", F.round("eq", 9))
    stat = _with(eq, F.percentile("px", 0.5).alias("med"), F.percentile("eq", 0.0075).alias("low"))
    return stat.select("frame", "pos", "eq", ((F.col("px") < grey * F.col("med")) & (F.col("eq") < F.round(grey * F.col("low"), 9))).alias("dark"))


def stretched(pixels: DataFrame) -> DataFrame:
    """(frame, pos, im): clipped to the lowest four fifths of a frame's values, then scaled to 0..1; a flat frame becomes 0."""
    stat = _with(pixels, F.min("px").alias("low"), F.percentile("px", 0.8).alias("high"))
    span = F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    return stat.select("frame", "pos", F.coalesce((F.least("px", "high") - F.col("low")) / span, F.lit(0.0)).alias("im"))


def brightened(pixels: DataFrame, brightness: float = 1.0) -> DataFrame:
    """(frame, pos, im): moved so that a frame's median is ``brightness``, at most 1."""
    stat = _with(pixels, F.percentile("px", 0.5).alias("med"))
    return stat.select("frame", "pos", F.least(F.col("px") + brightness - F.col("med"), F.lit(1.0)).alias("im"))
