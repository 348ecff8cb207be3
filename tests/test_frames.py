"""Frame kernels, sources and the streamed background against plain Python."""

import io

import numpy as np
from pyspark.sql import functions as F

from driftlens.functions import kernels
from driftlens.operators import particles
from driftlens.sources import frames
from driftlens.streaming import background


def flooded(mask, diagonal):
    """Labels by flood fill, in the order of first pixels."""
    out, k = np.zeros(mask.shape, int), 0
    near = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0) and (diagonal or i == 0 or j == 0)]
    for start in zip(*np.nonzero(mask)):
        if out[start]:
            continue
        k, todo = k + 1, [start]
        while todo:
            r, c = todo.pop()
            if 0 <= r < mask.shape[0] and 0 <= c < mask.shape[1] and mask[r, c] and not out[r, c]:
                out[r, c] = k
                todo += [(r + i, c + j) for i, j in near]
    return out


def test_components():
    rng = np.random.default_rng(0)
    for k in range(40):
        mask = rng.random((rng.integers(1, 30), rng.integers(1, 30))) < rng.choice([0.0, 0.3, 0.5, 0.6, 1.0])
        for diagonal in (True, False):
            assert np.array_equal(kernels.components(mask, diagonal), flooded(mask, diagonal))


def test_segment():
    im = np.ones((40, 40))
    im[10:20, 10:20] = 0.1
    im[13:15, 13:15] = 1.0  # a hole
    im[30:32, 30:32] = 0.1  # too small
    im[0:6, 30:36] = 0.1  # at the border
    want = np.zeros((40, 40), bool)
    want[10:20, 10:20] = True
    assert np.array_equal(kernels.segmented(im), want)
    assert kernels.segmented(im, fill=False).sum() == 96


def test_masks():
    im = np.full((9, 9), 0.5)
    assert kernels.inside_box(im, 2, 4, 3, 6).sum() == 6 * 0.5 + 75
    assert (kernels.inside_circle(im, 1.5) > 0).sum() == 9


def test_refocus_returns():
    rng = np.random.default_rng(1)
    im = rng.random((32, 48))
    assert np.allclose(kernels.refocused(im, 0.0, 4.4, 658, 1.33, "none"), im)
    assert abs(kernels.refocused(im, 10.0, 4.4, 658, 1.33).mean()) < 1e-12


def test_mosaic():
    flat = np.zeros((6, 7), np.uint8)
    y, x = np.mgrid[:6, :7]
    flat[:] = np.where((y + x) % 2 == 1, 50, np.where(y % 2 == 0, 200, 9))
    assert (frames.demosaiced(flat) == [200, 50, 9]).all()


def test_measured_limit(spark):
    dark = [True, False, True, False, False, False, True, False, True]
    df = spark.createDataFrame([(1, 3, dark), (2, 3, [True] * 9), (3, 3, [False] * 9)], "frame int, cols int, dark array<boolean>")
    got = {(r.frame, r.label): r for r in particles.measured(particles.labelled(df), most=3).collect()}
    assert set(got) == {(1, None), (2, 1)}
    assert got[1, None].error == "4 particles" and got[1, None].area is None
    assert (got[2, 1].area, got[2, 1].maxr, got[2, 1].error) == (9, 3.0, None)


def saved(px):
    out = io.BytesIO()
    np.save(out, px)
    return out.getvalue()


def test_read_and_stream(spark, tmp_path):
    rng = np.random.default_rng(2)
    folder = tmp_path / "in"
    folder.mkdir()
    px = rng.integers(0, 256, (7, 4, 5, 1), dtype=np.uint8)
    for k in range(7):
        (folder / f"D20260101T00000{k}.000000.msilc").write_bytes(saved(px[k]))
    (folder / "x-0003.pgm").write_bytes(b"P5\n3 2\n255\n" + bytes(range(6)) + (1_700_000_000).to_bytes(4, "little"))
    (folder / "D20260101T000009.silc").write_bytes(b"broken")
    rows = {r.path.rpartition("/")[2]: r for r in frames.read(spark, str(folder)).collect()}
    assert len(rows) == 9
    grey = rows["x-0003.pgm"]
    assert (grey.rows, grey.cols, grey.px[5]) == (2, 3, 5 / 255) and str(grey.timestamp) == "2023-11-14 22:13:20.000003"
    assert rows["D20260101T000009.silc"].px is None and rows["D20260101T000009.silc"].error
    assert np.allclose(rows["D20260101T000003.000000.msilc"].px, px[3].ravel() / 255)
    stream = frames.watch(spark, str(folder), "*.msilc").withColumn("instrument", F.lit("a"))
    query = background.moving_background(stream, 3).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out")).orderBy("timestamp").collect()
    assert len(out) == 4
    for k, r in enumerate(out, 3):
        assert np.allclose(r.px, px[k].ravel() / 255) and np.allclose(r.bg, px[k - 3 : k].reshape(3, -1).mean(axis=0) / 255)
