"""Views of the star-schema tables as particle data."""

from __future__ import annotations

import io
import struct

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def image_time() -> Column:
    return F.date_trunc("hour", "ts").cast("timestamp_ntz")


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A particle for each event; an image is an hour."""
    return as_particles(events(spark, sf_dir))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The particles as a stream of files; a pattern takes a file as well as a folder."""
    path = f"{sf_dir}/events.parquet"
    return as_particles(spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path + "*"))


def as_particles(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    oil = ((e * 7) % 100) / F.lit(100.0)
    ts = image_time()
    name = F.when(F.col("event_type") == "error", F.lit("not_exported")).otherwise(F.concat(F.date_format(ts, "'D'yyyyMMdd'T'HHmmss.SSSSSS"), F.lit("-PN"), e.cast("string")))
    v = F.col("value")
    return events.select(
        "event_id", ts.alias("timestamp"), v.alias("equivalent_diameter"), (v * 1.5).alias("major_axis_length"), (v * (F.lit(0.2) + F.lit(0.1) * (e % 8))).alias("minor_axis_length"),
        (F.lit(0.9) + F.lit(0.01) * (e % 10)).alias("solidity"), ((F.col("user_id") * 13) % 2048).cast("double").alias("minr"), ((e * 7) % 2448).cast("double").alias("minc"),
        ((F.col("user_id") * 13) % 2048 + 1 + e % 40).cast("double").alias("maxr"), ((e * 7) % 2448 + 1 + e % 30).cast("double").alias("maxc"),
        (F.hour(ts) * 4).cast("double").alias("saturation"), F.concat(F.date_format(ts, "'D'yyyyMMdd'T'HHmmss.SSSSSS"), F.lit(".silc")).alias("filename"),
        oil.alias("probability_oil"), ((1 - oil) * 0.6).alias("probability_bubble"), ((1 - oil) * 0.4).alias("probability_oily_gas"), name.alias("export_name"))


def auxiliary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(time, depth): a time series; one value a time."""
    return events(spark, sf_dir).where("event_type = 'signup'").groupBy(F.col("ts").alias("time")).agg(F.max("value").alias("depth"))


def image_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hours between the first and the last event, with or without particles."""
    span = events(spark, sf_dir).agg(F.min(image_time()).alias("lo"), F.max(image_time()).alias("hi"))
    return span.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 hour"))).alias("timestamp"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, pos, px): frames of 8 x 8 pixels, scaled to 0..1, in the order of vec_id."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("pos", "px")).select("frame", "pos", ((F.col("px").cast("double") + 4) / 8).alias("px"))


def frame_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, hex): the 64 bytes of each frame as hexadecimal digits, values cut to 0..255."""
    byte = lambda x: F.lpad(F.hex(F.greatest(F.least(F.floor((x.cast("double") + 4) / 8 * 256), F.lit(255)), F.lit(0)).cast("long")), 2, "0")
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("frame"), F.array_join(F.transform("embedding", byte), "").alias("hex"))


def frame_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, path, content): each frame as a file of one of four formats in turn: a grey map with a footer, a bitmap, an array of one channel, a Bayer mosaic."""
    text = lambda s: F.hex(F.lit(s).cast("binary"))
    head = lambda shape: _array_header(shape).hex().upper()
    rows = F.split(F.regexp_replace("hex", "(.{16})", "$1 "), " ")
    up = F.array_join(F.transform(F.reverse(F.slice(rows, 1, 8)), lambda r: F.regexp_replace(r, "(..)", "$1$1$1")), "")  # from the last row, each value for three colours
    little = F.concat(*[F.substring(F.lpad(F.hex(F.lit(1_700_000_000) + F.col("frame")), 8, "0"), 7 - 2 * k, 2) for k in range(4)])
    name = F.date_format(F.timestamp_seconds(F.col("frame")), "'D'yyyyMMdd'T'HHmmss")
    kinds = [(F.concat(F.lit("H-"), F.col("frame").cast("string"), F.lit(".pgm")), F.concat(text("P5\n8 8\n255\n"), F.col("hex"), little)),
             (F.concat(name, F.lit(".bmp")), F.concat(F.lit(_bitmap_header().hex().upper()), up)),
             (F.concat(name, F.lit(".msilc")), F.concat(F.lit(head((8, 8, 1))), F.col("hex"))), (F.concat(name, F.lit(".bsilc")), F.concat(F.lit(head((8, 8))), F.col("hex")))]
    path, content = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (p, c) in enumerate(kinds):
        path, content = F.when(F.col("frame") % 4 == k, p).otherwise(path), F.when(F.col("frame") % 4 == k, c).otherwise(content)
    return frame_bytes(spark, sf_dir).select("frame", path.alias("path"), F.unhex(content).alias("content"))


def _array_header(shape: tuple[int, ...]) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array_header_1_0(out, {"descr": "|u1", "fortran_order": False, "shape": shape})
    return out.getvalue()


def _bitmap_header() -> bytes:
    return b"BM" + struct.pack("<IHHI", 54 + 192, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 8, 8, 1, 24, 0, 192, 0, 0, 0, 0)
