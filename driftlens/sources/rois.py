"""Pixels of exported particles as a table bucketed by frame, with lookups that read one bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write(rois: DataFrame, table: str, path: str, buckets: int = 64) -> None:
    """Append (frame, roi, rows, cols, px) to a table of ``buckets`` by frame, sorted by frame and name.

    One task writes a bucket, so it has one file for each append. ``buckets`` is to be chosen so that one fits a task.
    """
    rois.repartition(buckets, "frame").write.mode("append").bucketBy(buckets, "frame").sortBy("frame", "roi").option("path", path).saveAsTable(table)


def find(spark: SparkSession, table: str, export_name: str) -> DataFrame:
    """The pixels of one exported particle: reads its frame's bucket, and there the row groups that can hold the frame."""
    frame, _, roi = export_name.partition("-")
    return spark.table(table).where((F.col("frame") == frame) & (F.col("roi") == roi))


def with_pixels(spark: SparkSession, particles: DataFrame, table: str) -> DataFrame:
    """Exported particles with their stored pixels; the stored side is not dealt out. Null where nothing is stored."""
    named = particles.where(F.col("export_name") != "not_exported")
    named = named.withColumns({"frame": F.substring_index("export_name", "-", 1), "roi": F.substring_index("export_name", "-", -1)})
    return named.join(spark.table(table), ["frame", "roi"], "left")
