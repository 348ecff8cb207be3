"""Depth is found where a disc was put out of focus."""

import numpy as np
import pytest

from driftlens.functions import kernels
from driftlens.operators import holograms

OPTICS = {"low": 2.0, "high": 10.0, "step": 2.0, "pixel_um": 4.4}


def test_focus_and_summary(spark):
    y, x = np.ogrid[:64, :64]
    disc = ((y - 30) ** 2 + (x - 34) ** 2 < 16).astype(float)
    rows = [(f"f{k}", 64, 64, kernels.refocused(disc, -z, 4.4, 658.0, 1.33, "none").ravel().tolist()) for k, z in enumerate((4.0, 8.0))] + [("bad", None, None, None)]
    frames = spark.createDataFrame(rows, "path string, rows int, cols int, px array<double>")
    boxes = spark.createDataFrame([("f0", 1, 26.0, 30.0, 35.0, 39.0), ("f1", 1, 26.0, 30.0, 35.0, 39.0), ("f1", 2, 0.0, 0.0, 9.0, 9.0)], "path string, region long, minr double, minc double, maxr double, maxc double")
    got = {(r.path, r.region): (r.ifocus, r.z) for r in holograms.focused(frames, boxes, **OPTICS).collect()}
    assert len(got) == 3 and got["f0", 1] == (1, 4.0) and got["f1", 1] == (3, 8.0)
    out = {r.path: r for r in holograms.summarised(frames, **OPTICS).collect()}
    stack = np.stack([kernels.refocused(np.array(rows[0][3]).reshape(64, 64), z, 4.4, 658.0, 1.33) ** 2 for z in kernels.depths(2.0, 10.0, 2.0)])
    assert out["f0"].std == pytest.approx(stack.std(axis=0).ravel()) and out["f0"].max == pytest.approx(stack.max(axis=0).ravel())
    assert out["bad"].std is None
