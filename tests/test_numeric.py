"""Operators against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlens.functions import sizes
from driftlens.operators import classes, distributions, exports, series


def test_bins_match_histogram(spark):
    rng = np.random.default_rng(0)
    um = np.concatenate([rng.uniform(0, 15000, 2000), rng.lognormal(4, 2, 2000), sizes.limits()])
    got = spark.createDataFrame([(float(x),) for x in um], "um double").select(sizes.bin_of(F.col("um")).alias("b")).where("b is not null").groupBy("b").count().collect()
    want, _ = np.histogram(um, sizes.limits())
    assert {r["b"]: r["count"] for r in got} == {k: n for k, n in enumerate(want) if n}


def test_d50_matches_interp(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(x)) for i in range(20) for x in rng.lognormal(4, 1, 30)]
    nd = distributions.distribution(spark.createDataFrame(rows, "g int, equivalent_diameter double"), 1.0, ["g"])
    got = {r["g"]: r["d50"] for r in distributions.d50(nd, ["g"]).collect()}
    dia = np.array(sizes.mid_points())
    for g in range(20):
        n, _ = np.histogram([x for i, x in rows if i == g], sizes.limits())
        v = np.cumsum(dia**3 * n)
        assert got[g] == pytest.approx(np.interp(0.5, v / v[-1], dia), rel=1e-9)


def test_per_class_fixture(spark):
    rows = [("2026-05-07 12:00:00", 0.9, 0.05, 0.05), ("2026-05-07 12:00:00", 0.8, 0.15, 0.05), ("2026-05-07 12:00:00", 0.1, 0.85, 0.05), ("2026-05-07 12:00:00", 0.4, 0.35, 0.25), ("2026-05-07 12:00:01", None, None, None)]
    p = spark.createDataFrame(rows, "timestamp string, probability_oil double, probability_bubble double, probability_other double")
    out = {r["timestamp"]: r for r in classes.per_class(p, p.select("timestamp").distinct(), 0.5, 1.0).collect()}
    first, second = (out[t] for t in sorted(out))
    assert (first["oil"], first["bubble"], first["other"], first["unclassified"], first["total"]) == (2, 1, 0, 1, 4)
    assert second["total"] == 0


def test_interpolation_matches_numpy(spark):
    rng = np.random.default_rng(2)
    t = np.unique(rng.integers(0, 10 * 86400, 40))
    v = rng.normal(size=len(t))
    ask = np.unique(rng.integers(-86400, 11 * 86400, 300))
    known = spark.createDataFrame([(int(a), float(b)) for a, b in zip(t, v)], "s long, depth double").select(F.timestamp_seconds("s").cast("timestamp_ntz").alias("time"), "depth")
    points = spark.createDataFrame([(int(a),) for a in ask], "s long").select(F.timestamp_seconds("s").cast("timestamp_ntz").alias("timestamp"))
    for clamp in (False, True):
        got = series.interpolated(points, known, "depth", clamp).select(F.unix_micros(F.col("timestamp").cast("timestamp")).alias("u"), "depth").collect()
        want = np.interp(ask, t, v, *(() if clamp else (np.nan, np.nan)))
        got = {r["u"] // 1_000_000: r["depth"] for r in got}
        for a, w in zip(ask.tolist(), want):
            assert (got[a] is None) if np.isnan(w) else got[a] == pytest.approx(w, abs=1e-9)


def test_chunk_rules(spark):
    files = spark.range(5).withColumnRenamed("id", "ord")
    with pytest.raises(ValueError):
        exports.chunked(files, 3, 5)
    assert [r["chunk"] for r in exports.chunked(files, 2, 5).orderBy("ord").collect()] == [0, 0, 0, 1, 1]


def test_moving_background_above_a_block(spark):
    from driftlens.operators import background

    pixels = spark.range(600).selectExpr("id AS frame", "0 AS pos", "double(id * id % 17) AS px")
    got = {r.frame: r.bg for r in background.moving_background(pixels, 300).collect()}
    want = {k: sum(i * i % 17 for i in range(k - 300, k)) / 300 for k in range(300, 600)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_image_stats_keeps_frames_without_particles(spark):
    from driftlens.operators import profiles

    rows = [("a", None, 100.0, "a.silc"), ("b", 9.0, 1.0, "b.silc"), ("b", 1e9, 1.0, "b.silc"), ("c", 10.0, 2.0, None), ("c", 12.0, 2.0, None)]
    got = {r.timestamp: r for r in profiles.image_stats(spark.createDataFrame(rows, "timestamp string, equivalent_diameter double, saturation double, filename string"), 28.0, 0.5).collect()}
    assert [(got[k].particle_count, got[k].nc, got[k].filename, got[k].saturation) for k in "abc"] == [(0, 0.0, "a.silc", 100.0), (2, 2.0, "b.silc", 1.0), (2, 4.0, None, 2.0)]
    assert got["a"].d50 is None and got["a"].junge is None and got["b"].d50 > 0


def test_chunks_and_append(spark):
    import pytest

    from driftlens.operators import exports

    exports.check_chunks(1, True)
    exports.check_chunks(4, False)
    for bad in ((0, False), (2, True)):
        with pytest.raises(ValueError):
            exports.check_chunks(*bad)


#: (minor, major) of particles, and whether minor / major > 0.3 by IEEE 754 with NaN above all numbers, as DuckDB has it.
SHAPES = [(0.0, 0.0, True), (-0.0, 0.0, True), (1.0, 0.0, True), (1.0, -0.0, False), (-1.0, -0.0, True), (-1.0, 0.0, False), (float("nan"), 0.0, True), (1.0, 2.0, True), (3.0, 10.0, False), (1.0, 4.0, False), (None, 0.0, False), (1.0, None, False)]


def oil_of_all_shapes(spark, oil, threshold):
    from driftlens.operators import filters

    rows = [(k, a, b, 0.99, oil, 0.1, 0.1) for k, (a, b, _) in enumerate(SHAPES)]
    p = spark.createDataFrame(rows, "k int, minor_axis_length double, major_axis_length double, solidity double, probability_oil double, probability_bubble double, probability_oily_gas double")
    return sorted(r["k"] for r in filters.extract_oil(p, threshold).select("k").collect())


def test_extract_oil_high_of_particles_without_length(spark):
    assert oil_of_all_shapes(spark, 0.9, 0.85) == [k for k, s in enumerate(SHAPES) if s[2]]


def test_extract_oil_low_of_particles_without_length(spark):
    assert oil_of_all_shapes(spark, 0.45, 0.4) == [k for k, s in enumerate(SHAPES) if s[2]]
    assert oil_of_all_shapes(spark, 0.4, 0.4) == []


def interpolated_plan(spark, name):
    """Words of the optimised plan of a query of the catalog; its windows' frames are among them."""
    from driftlens import catalog

    return catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().lower()


def with_null_times(spark, clamp):
    """Values by hour (null for a null time) in a series of two known hours, days apart, and a null time."""
    at = lambda c: F.timestamp_seconds(F.col(c) * 3600).cast("timestamp_ntz")
    known = spark.createDataFrame([(None, 77.0), (30, 1.0), (80, 2.0)], "h long, depth double").select(at("h").alias("time"), "depth")
    asked = spark.createDataFrame([(None,), (0,), (30,), (55,), (100,)], "h long").select(at("h").alias("timestamp"))
    got = series.interpolated(asked, known, "depth", clamp).select(F.unix_micros(F.col("timestamp").cast("timestamp")).alias("u"), "depth").collect()
    return {r["u"] if r["u"] is None else r["u"] // 3_600_000_000: r["depth"] for r in got}


def test_depth_interp_frames_do_not_end_with_the_partition(spark):
    plan = interpolated_plan(spark, "depth_interp")
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan  # such a frame takes the square of a block's rows


def test_depth_interp_of_null_times(spark):
    assert with_null_times(spark, True) == {None: None, 0: 1.0, 30: 1.0, 55: 1.5, 100: 2.0}


def test_aux_interp_frames_do_not_end_with_the_partition(spark):
    plan = interpolated_plan(spark, "aux_interp")
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan


def test_aux_interp_of_null_times(spark):
    assert with_null_times(spark, False) == {None: None, 0: None, 30: 1.0, 55: 1.5, 100: None}
