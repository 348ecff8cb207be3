"""A stream whose frames come late and out of order, against the window over all of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlens.streaming import background

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(PROVIDER, before)


def write(spark, folder, batch, rows):
    frame = spark.createDataFrame([(i, float(s), [float(x) for x in px]) for i, s, px in rows], "instrument string, s double, px array<double>")
    frame = frame.select("instrument", F.expr("timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(0, 0, 0, s)").alias("timestamp"), "px")
    frame.coalesce(1).write.mode("append").parquet(f"{folder}/{batch}")


def run(spark, folder, out, log):
    stream = spark.readStream.schema("instrument string, timestamp timestamp_ntz, px array<double>").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    query = background.ordered_background(stream, 3, "10 seconds").writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(log)).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None


def expected(rows, window=3):
    want = {}
    for name in {r[0] for r in rows}:
        mine = sorted((s, np.asarray(px, float).tobytes()) for i, s, px in rows if i == name)
        last = []
        for s, px in mine:
            px = np.frombuffer(px)
            if last and len(last[0]) != len(px):
                last = []
            if len(last) == window:
                want.setdefault((name, s), []).append((tuple(px.tolist()), tuple(np.mean(last, axis=0).tolist())))
            last = (last + [px])[-window:]
    return want


def test_late_frames_are_put_in_order(spark, tmp_path, rocks):
    rng = np.random.default_rng(3)
    one = lambda n=4: rng.integers(0, 256, n)
    batches = [
        [("a", 1, one()), ("a", 5, one()), ("b", 2, one())],
        [("a", 3, one()), ("a", 2, one()), ("a", 5, one()), ("b", 8, one())],  # late, and a second frame of one time
        [("a", 9, one()), ("a", 4.5, one()), ("b", 4, one())],
        [("a", 20, one()), ("b", 21, one()), ("a", 12, one())],
        [("a", 31, one(6)), ("a", 33, one(6)), ("b", 30, one())],
    ]
    for k, rows in enumerate(batches[:3]):
        write(spark, tmp_path / "in", k, rows)
    run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "log")
    for k, rows in enumerate(batches[3:] + [[("a", 1000, one()), ("b", 1000, one())], [("c", 2000, one())]], 3):
        write(spark, tmp_path / "in", k, rows)
        run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "log")  # each time from the checkpoint
    got = {}
    for r in spark.read.schema(background.OUTPUT).parquet(str(tmp_path / "out")).collect():
        got.setdefault((r.instrument, (r.timestamp - r.timestamp.replace(hour=0, minute=0, second=0, microsecond=0)).total_seconds()), []).append((tuple(r.px), tuple(r.bg)))
    want = expected([r for b in batches for r in b])
    late = {k: v for k, v in got.items() if k[1] < 1000}
    assert {k: sorted(map(str, v)) for k, v in late.items()} == {k: sorted(map(str, v)) for k, v in want.items()}
    assert len(want) >= 5
