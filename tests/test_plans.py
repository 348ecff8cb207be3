"""Configured plans and stored tables."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlens.plans import pipeline
from driftlens.sources import frames, stores


def saved(px):
    out = io.BytesIO()
    np.save(out, px)
    return out.getvalue()


CONFIG = """
[general]
raw_files = "in/*.silc"
[steps.prep]
step = "darkest_channel"
[steps.mask]
step = "box_mask"
r0 = 0
r1 = 40
c0 = 0
c1 = 30
[steps.segment]
step = "segment"
threshold = 0.9
[steps.statistics]
step = "statistics"
"""


def test_plan(spark, tmp_path):
    (tmp_path / "c.toml").write_text(CONFIG)
    settings = pipeline.load(str(tmp_path / "c.toml"))
    assert pipeline.describe(settings).splitlines()[2] == "3. segment: segment(threshold=0.9)"
    (tmp_path / "in").mkdir()
    for k in range(3):
        px = np.full((40, 40, 3), 250, np.uint8)
        px[5:10, 5 : 10 + k, k] = 20
        px[20:26, 32:38] = 20  # outside the mask
        (tmp_path / "in" / f"D20260101T00000{k}.000000.silc").write_bytes(saved(px))
    (tmp_path / "in" / "D20260101T000007.000000.silc").write_bytes(b"broken")
    out = pipeline.build(frames.read(spark, str(tmp_path / "in")), settings).orderBy("timestamp").collect()
    assert [(r.area, r.minr, r.minc, r.maxr, r.maxc) for r in out[:3]] == [(5 * (5 + k), 5, 5, 10, 10 + k) for k in range(3)]
    assert len(out) == 4 and out[3].label is None and out[3].area is None and "ValueError" in out[3].reason
    assert out[0].saturation == pytest.approx(25 / 1600 * 100 / 30 * 100)
    with pytest.raises(ValueError):
        pipeline.find("nothing")


def test_store(spark, tmp_path):
    df = spark.range(10).select(F.expr("timestamp_ntz'2026-01-01 12:00:00' + make_interval(0, 0, 0, cast(id as int))").alias("timestamp"), F.col("id").cast("double").alias("equivalent_diameter"))
    one, two, all_ = (str(tmp_path / x) for x in ("one", "two", "all"))
    stores.append(df.limit(4), one, about={"pixel_size": 28.0})
    stores.append(df.where("equivalent_diameter >= 4"), one)
    stores.append(df.withColumn("more", F.lit(1)), two)
    assert stores.load(spark, one).count() == 10
    assert stores.about(spark.read.parquet(one + "/day=2026-01-01")) == {"pixel_size": 28.0}
    stores.merge(spark, [one, two], all_)
    got = stores.load(spark, all_)
    assert got.count() == 20 and got.where("more = 1").count() == 10
    assert stores.described(df).schema["equivalent_diameter"].metadata["units"] == "Pixels"
    more = stores.described(df.withColumns({"probability_oil": F.lit(0.5), "other": F.lit(1)}), {"other": {"units": "m"}}).schema
    assert more["probability_oil"].metadata["standard_name"] == "probability_of_oil" and more["other"].metadata == {"units": "m"} and more["timestamp"].metadata["level"] == 0
    with pytest.raises(ValueError):
        stores.merge(spark, [], all_)


def test_auxiliary(spark, tmp_path):
    path = tmp_path / "aux.csv"
    path.write_text("# remark\n# remark\n,metres,degC\nwhen,how deep,how warm\ntime,depth,temperature\n2022-06-08T18:40:00,0,5\n2022-06-08T18:41:00,5,x\n")
    got = stores.auxiliary(spark, str(path))
    assert got.schema["depth"].metadata == {"units": "metres", "long_name": "how deep"}
    assert [(str(r.time), r.depth, r.temperature) for r in got.orderBy("time").collect()] == [("2022-06-08 18:40:00", 0.0, 5.0), ("2022-06-08 18:41:00", 5.0, None)]
