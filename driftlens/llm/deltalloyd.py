"""Centroid clustering by delta Lloyd rounds on integer vectors.

Vectors are written once, bucketed by row. A round reads them beside the bucketed table of
owners (no exchange), compares a vector whose owner moved with all centroids and any other one
with its owner and the centroids that moved, and writes the new owners. The same pass leaves,
for each task, what left and what joined every cluster as signed integer sums; they are added
to the table of global sums, from which the next centroids come. Once no centroid moves, the
rounds that are left would change nothing and are not run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.llm.workspace import Workspace

#: Integer components are held to this size, so that every sum and squared distance is exact in 38 digits.
LARGEST = 1 << 59
#: Components up to here have squared distances that fit 64 bits for up to 512 components; larger ones go by Python's integers.
PLAIN = 1 << 26
LONG = (1 << 63) - 1
BUCKET_BYTES = 1 << 29
TOTAL = "decimal(38,0)"
PASS = f"kind int, row long, owner int, distance long, cluster int, sums array<{TOTAL}>"


def integers(vector: Column, dim: int, scale: int) -> Column:
    """floor(scale * x) of each component; null unless there are ``dim`` components, all of them finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    doubles = F.transform(vector, lambda x: x.cast("double"))
    held = lambda x: F.greatest(F.least(F.floor(x * float(scale)), F.lit(LARGEST)), F.lit(-LARGEST))
    return F.when((F.size(vector) == dim) & F.forall(doubles, finite), F.transform(doubles, held))


def seeds(vectors: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The vectors of the ``k`` smallest sha256 of ``salt:id``, ascending; equal ids go by their components."""
    name = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [list(r.v) for r in vectors.select(name.alias("h"), "v").orderBy("h", "v").limit(k).collect()]  # k rows


def _squares(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    d = x - centre
    return (d * d).sum(axis=1)


def nearest(x: np.ndarray, owner: np.ndarray, centres: np.ndarray, moved: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """New owners and squared distances; ties go to the smaller number. ``owner`` is -1 for vectors that have none.

    An owner that did not move still beats every other centroid that did not, so only those
    that moved can take a vector from it.
    """
    best, far = owner.astype(np.int32), np.zeros(len(x), x.dtype)
    every = (owner < 0) | np.isin(owner, moved)
    rows = np.flatnonzero(every)
    if len(rows):
        d = np.stack([_squares(x[rows], c) for c in centres])
        best[rows] = d.argmin(axis=0)  # the first of equals
        far[rows] = d.min(axis=0)
    rows = np.flatnonzero(~every)
    if len(rows):
        at, d = owner[rows].astype(np.int32), _squares(x[rows], centres[owner[rows]])
        for c in moved:
            new = _squares(x[rows], centres[c])
            closer = (new < d) | ((new == d) & (c < at))
            at, d = np.where(closer, np.int32(c), at), np.where(closer, new, d)
        best[rows], far[rows] = at, d
    return best, far


def compare(centres: list[list[int]], moved: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pass of a round: (row, v, owner) to a row of kind 0 for each vector, and of kind 1 for each cluster that a task's vectors left or joined."""
    k, dim = len(centres), len(centres[0])
    plain_centres = max(abs(v) for c in centres for v in c) <= PLAIN
    schema = pa.schema([("kind", pa.int32()), ("row", pa.int64()), ("owner", pa.int32()), ("distance", pa.int64()), ("cluster", pa.int32()), ("sums", pa.list_(pa.decimal128(38, 0)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transfers = [[0] * (dim + 1) for _ in range(k)]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.asarray(batch.column("v").flatten(), np.int64).reshape(n, dim)
            exact = plain_centres and np.abs(x).max() <= PLAIN
            c = np.array(centres, np.int64 if exact else object)
            x = x if exact else x.astype(object)
            owner = np.asarray(batch.column("owner").fill_null(-1))
            best, far = nearest(x, owner, c, moved)
            for at, sign in ((owner, -1), (best, 1)):
                for g in np.unique(at[(owner != best) & (at >= 0)]):
                    rows = x[(owner != best) & (at == g)]
                    transfers[g] = [a + sign * int(b) for a, b in zip(transfers[g], [len(rows), *rows.sum(axis=0)])]
            far = pa.array(far if exact else [min(int(v), LONG) for v in far], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), batch.column("row"), pa.array(best), far, pa.nulls(n, pa.int32()), pa.nulls(n, schema.field("sums").type)], schema=schema)
        found = [g for g in range(k) if any(transfers[g])]
        none = pa.nulls(len(found), pa.int64())
        sums = pa.array([transfers[g] for g in found], pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(found), np.int32)), none, none.cast(pa.int32()), none, pa.array(found, pa.int32()), sums], schema=schema)

    return run


def added(sums: DataFrame, dim: int) -> DataFrame:
    """(cluster, sums): arrays of a count and ``dim`` sums, added up place by place."""
    places = [F.sum(F.get("sums", F.lit(i))).cast(TOTAL) for i in range(dim + 1)]
    return sums.groupBy("cluster").agg(F.array(*places).alias("sums"))


def next_centres(totals: DataFrame, centres: list[list[int]]) -> list[list[int]]:
    """Componentwise floor(sum / count); clusters without vectors keep their centroid. Reads one row a cluster."""
    found = {r.cluster: [int(x) for x in r.sums] for r in totals.collect()}
    return [[x // found[c][0] for x in found[c][1:]] if found.get(c, [0])[0] else centre for c, centre in enumerate(centres)]


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, salt: str = "3", id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance) of every kept vector, and the final centroids.

    Kept are the vectors of exactly ``dim`` components, none null, NaN or infinite; the others
    have no row. Components become floor(scale * x), held to +-2^59. The first centroids are
    the vectors with the smallest hashes of their ids, so their numbers do not depend on the order of
    rows; with fewer than ``k`` vectors there are as many centroids. Distances over 2^63 - 1
    are shown as that, though vectors are compared by the exact ones. Rows that repeat an id or
    have none are vectors of their own. An empty table has no rows and no centroids. Other
    columns are not read.
    """
    spark = vectors.sparkSession
    space = Workspace(spark, "deltalloyd")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-vectors.count() * dim * 8 // BUCKET_BYTES))  # a task writes a bucket
    kept = vectors.select(F.col(id_col).alias("id"), integers(F.col(vector_col), dim, scale).alias("v")).where("v IS NOT NULL")
    held = space.keep_bucketed(kept.withColumn("row", F.monotonically_increasing_id()).repartition(buckets, "row"), "vectors", buckets, "row")
    centres = seeds(held, k, salt)
    if not centres:
        return held.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    moved, owners, totals = list(range(len(centres))), None, None
    for step in range(rounds + 1):  # the last one assigns only
        if not moved:
            break
        rows = held.select("row", "v")
        rows = rows.join(owners.select("row", "owner"), "row") if owners is not None else rows.withColumn("owner", F.lit(None).cast("int"))
        passed = space.keep_bucketed(rows.mapInArrow(compare(centres, moved), PASS), f"pass{step}", buckets, "row", partition_by="kind")
        owners = passed.where("kind = 0")
        if step == rounds:
            break
        new = passed.where("kind = 1").select("cluster", "sums")
        totals = space.keep(added(new if totals is None else totals.unionByName(new), dim), f"totals{step}")
        later = next_centres(totals, centres)
        moved = [c for c in range(len(centres)) if later[c] != centres[c]]
        centres = later
        if step:
            space.drop_bucketed(f"pass{step - 1}")
            space.drop(f"totals{step - 1}")
    out = held.select("row", "id").join(owners.select("row", "owner", "distance"), "row")
    out = space.keep(out.select(F.col("id").alias(id_col), F.col("owner").alias("cluster"), "distance"), "clusters")
    space.drop_all_bucketed()
    return out, centres


def inertia(assigned: DataFrame) -> DataFrame:
    """(cluster, cluster_inertia, inertia): distances summed over each cluster and over all; sums over 2^63 - 1 are shown as that."""
    held = lambda total: F.least(total, F.lit(LONG).cast(TOTAL)).cast("long")
    by = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast(TOTAL)).cast(TOTAL).alias("sum"))
    whole = by.agg(F.sum("sum").cast(TOTAL).alias("all"))
    return by.crossJoin(F.broadcast(whole)).select("cluster", held(F.col("sum")).alias("cluster_inertia"), held(F.col("all")).alias("inertia"))  # a row a cluster


def described(assigned: DataFrame, centres: list[list[int]]) -> DataFrame:
    """Each vector's row with the inertia and the digest of the centroid of its cluster."""
    text = F.lit(None).cast("string")
    for c, centre in enumerate(centres):
        text = F.when(F.col("cluster") == c, F.lit(",".join(map(str, centre)))).otherwise(text)
    about = inertia(assigned).withColumn("centroid_sha256", F.sha2(text.cast("binary"), 256))
    return assigned.join(F.broadcast(about), "cluster")  # a row a cluster
