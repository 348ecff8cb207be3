"""Holograms: refocused planes one at a time, their summary and the plane where a box is sharpest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.functions import kernels


def _planes(px, rows, cols, low, high, step, pixel_um, wavelength_nm, index, clear):
    im = np.asarray(px, np.float64).reshape(int(rows), int(cols))
    for z in kernels.depths(low, high, step):
        yield z, kernels.refocused(im, z, pixel_um, wavelength_nm, index, clear) ** 2


def summarised(frames: DataFrame, low: float, high: float, step: float, pixel_um: float, wavelength_nm: float = 658.0, index: float = 1.33, clear: str = "dc") -> DataFrame:
    """(path, std, max): each pixel's population deviation and maximum over depths ``low``..``high`` mm.

    A task holds one plane and three sums, not the stack. Frames without pixels give nulls.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, px, rows, cols in zip(batch["path"], batch["px"], batch["rows"], batch["cols"]):
                std = top = None
                if px is not None:
                    n, mean, square = 0, 0.0, 0.0
                    for _, plane in _planes(px, rows, cols, low, high, step, pixel_um, wavelength_nm, index, clear):
                        n += 1
                        off = plane - mean
                        mean = mean + off / n
                        square = square + off * (plane - mean)
                        top = plane if top is None else np.maximum(top, plane)
                    std, top = np.sqrt(square / n).ravel(), top.ravel()
                yield pd.DataFrame({"path": [path], "std": [std], "max": [top]})

    return frames.select("path", "px", "rows", "cols").mapInPandas(run, "path string, std array<double>, max array<double>")


def focused(frames: DataFrame, boxes: DataFrame, low: float, high: float, step: float, pixel_um: float, wavelength_nm: float = 658.0, index: float = 1.33, clear: str = "dc") -> DataFrame:
    """(path, region, ifocus, z): the plane, from 0, whose box has the largest sum; ties go to the first.

    ``boxes`` (path, region, minr, minc, maxr, maxc) are gathered by frame, whose particles the
    segmentation bounds; each plane is made once a frame. Boxes of frames that are missing give no rows.
    """
    by_frame = boxes.groupBy("path").agg(F.collect_list(F.struct("region", "minr", "minc", "maxr", "maxc")).alias("boxes"))
    kind = boxes.schema["region"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, px, rows, cols, held in zip(batch["path"], batch["px"], batch["rows"], batch["cols"], batch["boxes"]):
                best = [(-np.inf, -1, None)] * len(held)
                for k, (z, plane) in enumerate(_planes(px, rows, cols, low, high, step, pixel_um, wavelength_nm, index, clear)):
                    for i, b in enumerate(held):
                        total = plane[int(b["minr"]) : int(b["maxr"]), int(b["minc"]) : int(b["maxc"])].sum()
                        if total > best[i][0]:
                            best[i] = (total, k, float(z))
                yield pd.DataFrame({"path": path, "region": [b["region"] for b in held], "ifocus": [x[1] for x in best], "z": [x[2] for x in best]})

    rows = frames.where("px IS NOT NULL").select("path", "px", "rows", "cols").join(by_frame, "path")
    return rows.mapInPandas(run, f"path string, region {kind}, ifocus long, z double")
