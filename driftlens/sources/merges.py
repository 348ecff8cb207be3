"""Merging many small tables by parts, with a manifest of what each part was made of.

A folder holds ``parts`` (a table partitioned by part and day) and versions of a ``manifest``: (member,
mark, part), the mark being a digest of names, lengths and modification times of the
member's files. A part is named by its members and their marks, so a part that is stored and whose name
comes out again needs no work, whatever its place in the list; one that lost, gained or changed a member
gets another name and is built anew. The newest manifest alone says which parts count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.operators import ranks
from driftlens.sources import stores

MANIFEST = "member string, mark string, part string"


def qualified(spark: SparkSession, path: str) -> str:
    """A path as Spark names files: with its scheme, encoded."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(found).toUri().toString()


def member_of(file: Column) -> Column:
    """The table that a file lies in: its folder, without folders of partition values. One slash or three after ``file:`` are the same."""
    return F.regexp_replace(F.regexp_extract(file, r"^(.*?)(?:/[^/=]+=[^/]*)*/[^/]+$", 1), "^file:/+", "file:/")


def members(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(member, mark) of the tables that have files."""
    kept = [p for p in paths if stores.holds_rows(spark, p)]
    if not kept:
        return spark.createDataFrame([], "member string, mark string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(kept)  # names, lengths and times only: the content is not read
    about = files.select(F.col("_metadata.file_path").alias("file"), "length", "modificationTime")
    return about.groupBy(member_of(F.col("file")).alias("member")).agg(F.concat_ws(":", F.count("*"), F.sum(F.xxhash64("file", "length", "modificationTime").cast("decimal(38,0)"))).alias("mark"))


def manifest(spark: SparkSession, folder: str) -> tuple[int, DataFrame]:
    """The newest finished version, and its rows; version 0 is empty."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    found = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(jvm.org.apache.hadoop.fs.Path(root, "version=*/_SUCCESS"))
    versions = [int(f.getPath().getParent().getName().partition("=")[2]) for f in found or []]
    if not versions:
        return 0, spark.createDataFrame([], MANIFEST)
    return max(versions), spark.read.schema(MANIFEST).parquet(f"{folder}/manifest/version={max(versions)}")


def planned(now: DataFrame, known: DataFrame, part_size: int) -> DataFrame:
    """(member, mark, part, before) of the tables there are: those of a known part stay together (``before``), new ones fill new parts in order of name."""
    old = known.select("member", F.col("part").alias("before"))
    both = now.join(old, "member", "left")
    new = ranks.numbered(both.where("before IS NULL").drop("before"), "member", name="ord")
    new = new.select("member", "mark", F.lit(None).cast("string").alias("before"), F.concat(F.lit("new-"), F.floor(F.col("ord") / part_size).cast("string")).alias("group"))
    rows = both.where("before IS NOT NULL").withColumn("group", F.col("before")).select("member", "mark", "before", "group").unionByName(new)
    name = F.md5(F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", "member", "mark"))), "\n"))  # at most part_size members
    named = rows.groupBy("group").agg(name.alias("part"))
    return rows.join(named, "group").select("member", "mark", "part", "before")


def merge_in_parts(spark: SparkSession, paths: list[str], folder: str, part_size: int, overwrite_parts: bool = False, parts_per_job: int = 1000, time: str = "timestamp") -> list[str]:
    """Bring the merged table of ``folder`` up to date with the tables at ``paths``; returns the parts built.

    Tables that are new fill new parts of ``part_size``; a part is built anew if one of its
    tables was changed, removed from the list or emptied, and used as it is otherwise, unless
    ``overwrite_parts``. A job builds ``parts_per_job`` parts and then writes a version of the manifest, so a
    merge that was stopped goes on after its last finished job. Paths may repeat. Missing columns are null.
    """
    if part_size < 1 or parts_per_job < 1:
        raise ValueError("part_size and parts_per_job must be at least 1")
    if not paths:
        raise ValueError("nothing to merge")
    paths = sorted(set(paths))
    version, known = manifest(spark, folder)
    if overwrite_parts:
        known = known.where("false")
    plan = stores.kept(planned(members(spark, paths), known, part_size), "plan")
    todo = sorted(r.part for r in plan.join(known.select("part").distinct(), "part", "left_anti").select("part").distinct().collect())  # a name a part
    at = {qualified(spark, p).replace("file:///", "file:/"): p for p in paths}
    state = known
    for k in range(0, len(todo), parts_per_job):
        job = plan.where(F.col("part").isin(todo[k : k + parts_per_job]))
        rows = _rows(spark, [at[r.member] for r in job.select("member").collect()], time)
        placed = rows.join(job.select("member", "part"), "member").drop("member")
        placed = placed.repartitionByRange("part", "day", time).sortWithinPartitions("part", "day", time)
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "day").parquet(f"{folder}/parts")
        replaced = job.select(F.col("before").alias("part")).where("part IS NOT NULL").distinct()
        version, state = _commit(state.join(replaced, "part", "left_anti").unionByName(job.select("member", "mark", "part")), folder, version + 1)
    gone = state.join(plan.select("part").distinct(), "part", "left_anti")
    if version == 0 or not gone.isEmpty():  # parts whose tables are all gone
        _commit(state.join(plan.select("part").distinct(), "part", "left_semi"), folder, version + 1)
    return todo


def _rows(spark: SparkSession, paths: list[str], time: str) -> DataFrame:
    """All rows of some tables in one scan, with the table that each is from."""
    rows = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(*paths)
    return rows.withColumn("member", member_of(F.col("_metadata.file_path"))).withColumn("day", F.to_date(time))


def _commit(rows: DataFrame, folder: str, version: int) -> tuple[int, DataFrame]:
    rows.select("member", "mark", "part").write.mode("overwrite").parquet(f"{folder}/manifest/version={version}")
    return manifest(rows.sparkSession, folder)


def merged(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the parts that the newest manifest names; filters on ``day`` prune folders."""
    version, known = manifest(spark, folder)
    if known.isEmpty():
        raise ValueError("no stored rows")
    parts = spark.read.option("mergeSchema", "true").parquet(f"{folder}/parts")
    return parts.join(known.select("part").distinct(), "part", "left_semi").drop("part")


def drop_stale(spark: SparkSession, folder: str) -> int:
    """Delete the parts that the newest manifest does not name and older manifests; returns how many parts went. Not while a merge runs."""
    jvm = spark.sparkContext._jvm
    version, known = manifest(spark, folder)
    names = {r.part for r in known.select("part").distinct().collect()}
    root = jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stale = [f.getPath() for f in files.globStatus(jvm.org.apache.hadoop.fs.Path(root, "parts/part=*")) or [] if f.getPath().getName().partition("=")[2] not in names]
    old = [f.getPath() for f in files.globStatus(jvm.org.apache.hadoop.fs.Path(root, "manifest/version=*")) or [] if int(f.getPath().getName().partition("=")[2]) < version]
    for path in stale + old:
        files.delete(path, True)
    return len(stale)
