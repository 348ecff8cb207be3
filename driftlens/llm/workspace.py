"""Intermediate tables on storage that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files go as soon as an action ends; a bucket of one file counts as sorted.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a new local one only where that is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="driftlens-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


@contextmanager
def _set(spark: SparkSession, values: dict[str, str]):
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def shuffle_cleanup(spark: SparkSession):
    """For actions whose result is on disk when they end: their shuffle files go then, and sorted buckets are not sorted again."""
    return _set(spark, _WHILE_WRITING)


def as_buckets(spark: SparkSession):
    """Bucketed tables are read a bucket a task also where no join asks for it."""
    return _set(spark, {"spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"})


class Workspace:
    """Named Parquet tables of one run of one operator.

    A written table cuts the lineage: a lost executor costs the tasks of the current step
    only, and nothing is kept in executors' memory or on their own disks.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables: dict[str, str] = {}

    def keep(self, df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        with shuffle_cleanup(self.spark):
            writer.parquet(f"{self.path}/{label}")
        return self.read(label, df.schema)

    def read(self, label: str, schema, *more: str) -> DataFrame:
        """A table, or several of one schema as one scan."""
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{x}" for x in (label, *more)))

    def drop(self, label: str) -> None:
        """Delete a table that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{label}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def drop_like(self, prefix: str) -> None:
        """Delete the tables whose labels begin so."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        files = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for found in files.globStatus(jvm.org.apache.hadoop.fs.Path(root, f"{prefix}*")) or []:
            files.delete(found.getPath(), True)

    def keep_bucketed(self, df: DataFrame, label: str, buckets: int, *columns: str, partition_by: str | None = None) -> DataFrame:
        """A table of ``buckets`` by ``columns``, sorted by them: joins on them deal nothing out."""
        name = f"{label}_{uuid.uuid4().hex}"
        writer = df.write.bucketBy(buckets, *columns).sortBy(*columns).option("path", f"{self.path}/{name}")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        with shuffle_cleanup(self.spark):
            writer.saveAsTable(name)
        self.tables[label] = name
        return self.spark.table(name)

    def bucketed(self, label: str) -> DataFrame:
        return self.spark.table(self.tables[label])

    def drop_bucketed(self, label: str) -> None:
        name = self.tables.pop(label)
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.drop(name)

    def drop_all_bucketed(self) -> None:
        for label in list(self.tables):
            self.drop_bucketed(label)
