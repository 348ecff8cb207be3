"""Merging by parts: what is added, removed, appended or interrupted."""

import pytest
from pyspark.sql import functions as F

from driftlens.operators import ranks
from driftlens.sources import merges, stores

TIME = "timestamp_ntz'2026-01-01 12:00:00' + make_interval(0, 0, 0, cast(id as int))"


@pytest.fixture
def tables(spark, tmp_path):
    def write(name, *ids):
        rows = spark.createDataFrame([(i,) for i in ids], "id long").withColumn("timestamp", F.expr(TIME))
        stores.append(rows if name != "b" else rows.withColumn("extra", F.lit(1)), str(tmp_path / name))
        return str(tmp_path / name)

    return write


def ids(spark, folder):
    return sorted(r.id for r in merges.merged(spark, folder).collect())


def test_tables_that_come_between_lose_and_double_nothing(spark, tables, tmp_path):
    a, c, folder = tables("a", 1), tables("c", 3), str(tmp_path / "all")
    assert len(merges.merge_in_parts(spark, [c, a], folder, 2)) == 1
    b = tables("b", 2)
    assert len(merges.merge_in_parts(spark, [a, b, c], folder, 2)) == 1  # the first part stays
    assert ids(spark, folder) == [1, 2, 3]
    assert merges.merge_in_parts(spark, [a, b, c], folder, 2) == []
    assert {r.id: r.extra for r in merges.merged(spark, folder).collect()} == {1: None, 2: 1, 3: None}


def test_changed_and_removed_tables(spark, tables, tmp_path):
    paths, folder = [tables(x, k) for k, x in enumerate("acdef")], str(tmp_path / "all")
    assert len(merges.merge_in_parts(spark, paths, folder, 2)) == 3
    tables("c", 10, 11)
    assert len(merges.merge_in_parts(spark, paths + paths[:1], folder, 2)) == 1
    assert ids(spark, folder) == [0, 1, 2, 3, 4, 10, 11]
    assert len(merges.merge_in_parts(spark, paths[1:4], folder, 2)) == 1  # of a, c without a; the part of f goes
    assert ids(spark, folder) == [1, 2, 3, 10, 11]
    assert merges.drop_stale(spark, folder) == 3
    assert ids(spark, folder) == [1, 2, 3, 10, 11]
    assert len(merges.merge_in_parts(spark, paths[1:4], folder, 2, overwrite_parts=True)) == 2
    assert ids(spark, folder) == [1, 2, 3, 10, 11]


def test_a_stopped_merge_goes_on(spark, tables, tmp_path, monkeypatch):
    paths, folder = [tables(x, k) for k, x in enumerate("abcde")], str(tmp_path / "all")
    done, commit = [], merges._commit

    def stops(*args):
        if len(done) == 1:
            raise RuntimeError("stopped")
        done.append(1)
        return commit(*args)

    monkeypatch.setattr(merges, "_commit", stops)
    with pytest.raises(RuntimeError):
        merges.merge_in_parts(spark, paths, folder, 1, parts_per_job=2)
    monkeypatch.setattr(merges, "_commit", commit)
    first = ids(spark, folder)
    assert len(first) == 2
    assert len(merges.merge_in_parts(spark, paths, folder, 1, parts_per_job=2)) == 3  # the two that were stored but not named are built again
    assert ids(spark, folder) == [0, 1, 2, 3, 4]


def test_nothing_to_merge(spark, tables, tmp_path):
    (tmp_path / "empty").mkdir()
    folder = str(tmp_path / "all")
    assert merges.merge_in_parts(spark, [str(tmp_path / "empty")], folder, 2) == []
    with pytest.raises(ValueError):
        merges.merged(spark, folder)
    with pytest.raises(ValueError):
        merges.merge_in_parts(spark, [], folder, 2)
    with pytest.raises(ValueError):
        merges.merge_in_parts(spark, ["x"], folder, 0)


def test_put_twice_is_put_once(spark, tmp_path):
    path = str(tmp_path / "put")
    rows = spark.range(20).withColumn("chunk", F.col("id") % 3)
    stores.put(rows, path, "chunk")
    stores.put(rows.where("chunk = 1").withColumn("id", F.col("id") + 100), path, "chunk")
    stores.put(rows.where("chunk = 1").withColumn("id", F.col("id") + 100), path, "chunk")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == sorted([k for k in range(20) if k % 3 != 1] + [k + 100 for k in range(20) if k % 3 == 1])


def test_places_and_running_sums(spark):
    rows = [(k * 7 % 101, "a" if k % 3 else "b") for k in range(101)]
    table = spark.createDataFrame(rows, "v long, g string").repartition(5)
    assert all(r.ord == r.v for r in ranks.numbered(table, "v").collect())
    got = ranks.running(ranks.dealt(table, "v"), F.col("v"), ["g"], "before").collect()
    for r in got:
        assert r.before == sum(v for v, g in rows if g == r.g and v < r.v)
    assert ranks.numbered(table.where("false"), "v").collect() == []


def test_a_cluster_without_a_shared_folder_is_refused():
    class Fake:
        class conf:
            get = staticmethod(lambda key, default: None)

        class sparkContext:
            master = "spark://somewhere:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        stores.shared_root(Fake())
