"""Particles of frames: labels from a kernel, everything after that as DataFrame plans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions import kernels
from driftlens.sources import stores

BOX = ["minr", "minc", "maxr", "maxc"]


def labelled(masks: DataFrame) -> DataFrame:
    """(frame, pos, label) of the dark pixels of masks (frame, cols, dark array<boolean>); diagonals connect."""
    frame_type = masks.schema["frame"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for frame, cols, dark in zip(batch["frame"], batch["cols"], batch["dark"]):
                label = kernels.components(np.asarray(dark, bool).reshape(-1, cols)).ravel()
                pos = np.flatnonzero(label)
                yield pd.DataFrame({"frame": frame, "cols": cols, "pos": pos, "label": label[pos]})

    return masks.select("frame", "cols", "dark").mapInPandas(run, f"frame {frame_type}, cols int, pos long, label int")


def _shapes(labels: DataFrame, keys: list[str], also: list[str]) -> DataFrame:
    """Area, box and axes of each label of each frame (``keys``); ``also`` are the same on all rows of a label. Rows without a pixel are labels of no area."""
    r, c = F.floor(F.col("pos") / F.col("cols")).cast("double"), (F.col("pos") % F.col("cols")).cast("double")
    one = labels.withColumns({"r": r, "c": c}).groupBy(*keys, "label").agg(
        F.count("pos").alias("area"), F.min("r").alias("minr"), F.min("c").alias("minc"), (F.max("r") + 1).alias("maxr"), (F.max("c") + 1).alias("maxc"),
        F.var_pop("r").alias("vr"), F.var_pop("c").alias("vc"), F.covar_pop("r", "c").alias("vrc"), *[F.first(x, ignorenulls=True).alias(x) for x in also])
    half = F.sqrt(F.pow((F.col("vr") - F.col("vc")) / 2, 2) + F.pow("vrc", 2))
    mean = (F.col("vr") + F.col("vc")) / 2
    axis = lambda v: F.when(F.col("area") > 0, 4 * F.sqrt(F.greatest(F.round(v, 9), F.lit(0.0))))
    return one.withColumns({"major_axis_length": axis(mean + half), "minor_axis_length": axis(mean - half), "equivalent_diameter": F.when(F.col("area") > 0, F.sqrt(4 * F.col("area") / F.pi()))})


def measured(labels: DataFrame, most: int = 5000) -> DataFrame:
    """One row a particle: area, box (half-open), axes of the ellipse with its second moments, diameter of its area.

    Frames of more than ``most`` particles are not measured: their one row has an ``error``.
    """
    one = _shapes(labels, ["frame"], []).withColumn("found", F.count("*").over(Window.partitionBy("frame")))
    keep = ["area", *BOX, "major_axis_length", "minor_axis_length", "equivalent_diameter"]
    fits = F.col("found") <= most
    out = one.where(fits | (F.col("label") == 1))
    return out.select("frame", F.when(fits, F.col("label")).alias("label"), *[F.when(fits, F.col(x)).alias(x) for x in keep], F.when(~fits, F.concat(F.col("found").cast("string"), F.lit(" particles"))).alias("error"))


def extracted(frames: DataFrame, keys: list[str], max_coverage: float = 30.0, max_particles: int = 5000, rois: bool = False, expansion: float = 0.0) -> DataFrame:
    """One row a particle of every frame, and one row for each frame that has none.

    Frames have ``keys``, rows, cols, channels, px, dark and error. A row has the shape of a particle, the frame's ``saturation`` (dark
    pixels as a percentage of ``max_coverage`` percent) and, with ``rois``, its pixels as ``roi`` (the box grown by
    ``expansion`` as in ``exports.expand_bbox``). A frame without particles has nulls and the ``reason``: the error of a frame that
    could not be read or segmented, "covered" at or above the coverage allowed, "... particles" for more than ``max_particles``, null for an
    empty one. Frames are labelled where they are read; only dark pixels are dealt out.
    """
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "saturation double", "reason string", "cols int", "label int", "pos long", "roi struct<rows:int,cols:int,px:array<double>>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                saturation, reason, label = None, row["error"], None
                if row["dark"] is None:
                    reason = reason or "no pixels"
                else:
                    dark = np.asarray(row["dark"], bool).reshape(-1, int(row["cols"]))
                    saturation = float(dark.mean() * 100 / max_coverage * 100)
                    if saturation >= 100:
                        reason = "covered"
                    else:
                        label = kernels.components(dark)
                        found = int(label.max())
                        reason = f"{found} particles" if found > max_particles else None
                rows = {k: row[k] for k in keys} | {"saturation": saturation, "reason": reason, "cols": row["cols"], "label": None, "pos": None, "roi": None}
                if label is None or reason or not label.any():
                    yield pd.DataFrame([rows]).astype({"cols": "Int32", "label": "Int32", "pos": "Int64"})
                    continue
                pos = np.flatnonzero(label)
                yield pd.DataFrame(rows | {"label": label.ravel()[pos], "pos": pos}).astype({"cols": "Int32"})
                if rois:
                    im = np.asarray(row["px"], np.float64).reshape(*label.shape, -1)
                    cut = [{"rows": c.shape[0], "cols": c.shape[1], "px": c.ravel()} for c in kernels.crops(im, label, expansion)]
                    yield pd.DataFrame(rows | {"label": np.arange(1, found + 1), "roi": cut}).astype({"cols": "Int32", "pos": "Int64"})

    pixels = frames.select(*keys, "cols", "px", "dark", "error").mapInPandas(run, schema)
    found = _shapes(pixels, keys, ["saturation", "reason", "roi"])
    has = F.col("label").isNotNull()
    return found.select(*keys, "label", F.when(has, F.col("area")).alias("area"), *BOX, "major_axis_length", "minor_axis_length", "equivalent_diameter", "saturation", "reason", *(["roi"] if rois else []))


def _distance(prefix: str):
    return sum((F.abs(F.col(x) - F.col(prefix + x)) for x in BOX), F.lit(0.0))


def _cell(u, v, size):
    return F.floor(u / size), F.floor(v / size)


def nearest(boxes: DataFrame, regions: DataFrame) -> DataFrame:
    """(frame, box, region, ifocus): for each distinct box of a frame the region nearest to it, by a grid.

    The grid lies over twice the boxes' centres, u = minr + maxr and v = minc + maxc: boxes further apart
    than g in either are further apart than g. A box meets the regions of its own and the eight cells around it; if the
    best is at most one cell away nothing outside can be nearer, else it goes on in cells twice as
    wide. Cells start as wide as leaves about one region in each, by frame. Each round is a written table.
    """
    spark = boxes.sparkSession
    u, v = F.col("minr") + F.col("maxr"), F.col("minc") + F.col("maxc")
    both = boxes.select("frame", u.alias("u"), v.alias("v"), F.lit(0).alias("is_region")).unionByName(regions.select("frame", u.alias("u"), v.alias("v"), F.lit(1).alias("is_region")))
    span = F.greatest(F.max("u") - F.min("u"), F.max("v") - F.min("v"), F.lit(1.0))
    wide = both.groupBy("frame").agg(span.alias("span"), F.sum("is_region").alias("n")).where("n > 0")  # a row a frame
    grid = wide.select("frame", "span", F.greatest(F.col("span") / F.sqrt("n"), F.lit(1.0)).alias("size"))
    held = stores.kept(regions.join(grid, "frame").select("frame", "size", *[F.col(x).alias(f"r_{x}") for x in BOX], "region", "ifocus", u.alias("u"), v.alias("v")), "regions")
    open_ = stores.kept(boxes.join(grid, "frame").select("frame", *BOX, "size", "span", u.alias("u"), v.alias("v")), "boxes")
    done, step = [], 1
    while True:
        a, b = _cell(F.col("u"), F.col("v"), F.col("size") * step)
        around = F.explode(F.array(*[F.struct((a + i).alias("a"), (b + j).alias("b")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        probes = open_.withColumn("cell", around).select("frame", *BOX, F.col("cell.a").alias("a"), F.col("cell.b").alias("b"))
        cells = held.withColumns({"a": a, "b": b}).drop("size", "u", "v")
        key = F.struct(_distance("r_").alias("d"), F.col("region").alias("g"), F.col("ifocus").alias("f"))
        best = probes.join(cells, ["frame", "a", "b"]).groupBy("frame", *BOX).agg(F.min(key).alias("best"))
        now = stores.kept(open_.join(best, ["frame", *BOX], "left"), f"nearest{step}")
        sure = (F.col("best.d") <= F.col("size") * step) | (F.col("size") * step > F.col("span"))
        sure = F.coalesce(sure, F.lit(False))
        done.append(now.where(sure).select("frame", *BOX, F.col("best.g").alias("region"), F.col("best.f").alias("ifocus")))
        open_ = now.where(~sure).drop("best")
        if open_.isEmpty():
            break
        step *= 2
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def merged(particles: DataFrame, regions: DataFrame, low: float, step: float) -> DataFrame:
    """Add the focus plane and depth of the region of the same frame whose box is nearest to the particle's.

    Distance is the sum of the four differences; ties go to the smallest ``region``. Particles of
    frames without regions have nulls; those without a box take the frame's smallest region, and regions without a
    box are nearest to none. Equal boxes are looked up once.
    """
    boxed = lambda df: df.where(" AND ".join(f"{x} IS NOT NULL" for x in BOX))
    least = F.min(F.struct("region", "ifocus")).alias("least")
    one = boxed(regions).groupBy("frame", *BOX).agg(least).select("frame", *BOX, "least.*")
    found = nearest(boxed(particles).select("frame", *BOX).distinct(), one)
    first = regions.groupBy("frame").agg(least).select("frame", F.col("least.region").alias("first_region"), F.col("least.ifocus").alias("first_ifocus"))  # a row a frame
    out = particles.join(found, ["frame", *BOX], "left").join(first, "frame", "left")
    none = F.expr(" OR ".join(f"{x} IS NULL" for x in BOX))
    out = out.withColumns({"region": F.when(none, F.col("first_region")).otherwise(F.col("region")), "ifocus": F.when(none, F.col("first_ifocus")).otherwise(F.col("ifocus"))})
    return out.drop("first_region", "first_ifocus").withColumn("z", F.lit(low) + F.col("ifocus") * step)
