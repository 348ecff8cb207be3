"""A configured plan on a stream of frames, into a stored table."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftlens.plans import pipeline
from driftlens.sources import frames, stores


def watched(raw_files: str, folder: str | None = None) -> tuple[str, str]:
    """The folder to watch and the pattern of names of ``general.raw_files``."""
    head, name = posixpath.split(raw_files)
    return folder or head or ".", name or "*"


def run(stream: DataFrame, settings: dict, target: str, checkpoint: str, available_now: bool = False, every: str = "10 seconds") -> StreamingQuery:
    """Start the plan on each micro-batch; its rows go to ``target``/query=.../batch=....

    A batch's folder is named by the stream (as its checkpoint knows it) and the batch's number, and is written
    whole, so a batch that is replayed after a stop finds itself stored and is dropped, or replaces what a stopped
    writer left. A new checkpoint on the same target is another stream and adds its own rows.
    """
    spark = stream.sparkSession

    def sink(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        name = own.sparkContext.getLocalProperty("sql.streaming.queryId")
        path = f"{target}/query={name}/batch={number}"
        if not stores.exists(spark, f"{path}/_SUCCESS"):
            pipeline.build(batch, settings).write.mode("overwrite").parquet(path)

    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start()


def run_folder(spark: SparkSession, settings: dict, target: str, checkpoint: str, folder: str | None = None, files_per_batch: int = 100, **options: object) -> StreamingQuery:
    """``run`` on the files of ``general.raw_files``, those there are and those that come; each once."""
    folder, pattern = watched(settings["general"]["raw_files"], folder)
    return run(frames.watch(spark, folder, pattern, files_per_batch=files_per_batch), settings, target, checkpoint, **options)


def stored(spark: SparkSession, target: str) -> DataFrame:
    """The rows of all finished batches, with ``query`` and ``batch``."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(target)
    done = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(jvm.org.apache.hadoop.fs.Path(root, "query=*/batch=*/_SUCCESS"))
    paths = [f.getPath().getParent().toString() for f in done or []]
    if not paths:
        raise ValueError("no stored rows")
    return spark.read.option("basePath", target).option("mergeSchema", "true").parquet(*paths).withColumn("batch", F.col("batch").cast("long"))
