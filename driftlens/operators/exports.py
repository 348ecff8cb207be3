"""Unions, chunks, bounding boxes and the interchange table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.operators import ranks

# Columns of the interchange table, what each comes from, and its type there.
INTERCHANGE = {
    "img_file_name": ("export_name", "[t]"), "img_rank": ("img_rank", "[f]"), "object_id": ("export_name", "[t]"), "object_lat": ("latitude", "[f]"), "object_lon": ("longitude", "[f]"),
    "object_date": ("timestamp", "[t]"), "object_time": ("timestamp", "[t]"), "object_depth_min": ("depth", "[f]"), "object_depth_max": ("depth", "[f]"),
    "object_major": ("major_axis_length", "[f]"), "object_minor": ("minor_axis_length", "[f]"), "object_circ.": ("equivalent_diameter", "[f]"),
    "process_id": ("process_id", "[f]"), "process_img_software_version": ("software_version", "[t]"), "process_img_resolution": ("process_img_resolution", "[f]"),
    "process_particle_pixel_size_?m": ("pixel_size", "[f]"), "process_date": ("process_date", "[t]"), "process_time": ("process_time", "[t]"),
    "acq_id": ("acq_id", "[f]"), "sample_id": ("sample_id", "[f]"), "sample_stationid": ("sample_stationid", "[t]"),
}
IN_PIXELS = ("object_major", "object_minor", "object_circ.")


def append(*tables: DataFrame) -> DataFrame:
    """UNION ALL by column name; missing columns are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def numbered(images: DataFrame, time: str = "timestamp", *ties: str) -> DataFrame:
    """Add ``ord``, the place in time order from 0; null times come first.

    Rows of equal times go by ``ties``; without them their order is that of this run only.
    """
    return ranks.numbered(images, F.col(time).asc_nulls_first(), *ties, name="ord")


def chunked(files: DataFrame, chunks: int, total: int, strategy: str = "block") -> DataFrame:
    """Add ``chunk``: contiguous blocks of ceil(total / chunks), or every chunks-th file. ``ord`` counts from 0."""
    if not 1 <= chunks <= max(1, total // 2):
        raise ValueError("chunks must be at least 1 and at most half the number of files")
    if strategy not in ("block", "interleave"):
        raise ValueError(f"unknown strategy {strategy!r}")
    size = -(-total // chunks)
    return files.withColumn("chunk", (F.floor(F.col("ord") / size) if strategy == "block" else F.col("ord") % chunks).cast("long"))


def with_background_files(files: DataFrame, window: int) -> DataFrame:
    """Add to each chunk the ``window`` files before its first one, marked ``is_background``."""
    first = files.groupBy("chunk").agg(F.min("ord").alias("first"))
    halo = first.where("first > 0").select("chunk", F.explode(F.sequence(F.greatest(F.col("first") - window, F.lit(0)), F.col("first") - 1)).alias("ord"))
    return files.withColumn("is_background", F.lit(False)).unionByName(halo.join(files.drop("chunk"), "ord").withColumn("is_background", F.lit(True)).select(*files.columns, "is_background"))


def expand_bbox(particles: DataFrame, fraction: float, rows: int, cols: int) -> DataFrame:
    """Pad each box by round(size * fraction / 2), halves to even, kept inside the frame."""
    if fraction < 0:
        raise ValueError("fraction must not be negative")
    pad = lambda a, b: F.bround((F.col(b) - F.col(a)) * fraction / 2)
    r, c = pad("minr", "maxr"), pad("minc", "maxc")
    return particles.withColumns({"minr": F.greatest(F.col("minr") - r, F.lit(0.0)), "maxr": F.least(F.col("maxr") + r, F.lit(float(rows))), "minc": F.greatest(F.col("minc") - c, F.lit(0.0)), "maxc": F.least(F.col("maxc") + c, F.lit(float(cols)))})


def parse_timestamp(name: Column, prefix_chars: int = 1) -> Column:
    """Time in a file name ``<prefix>yyyyMMddTHHmmss[.ffffff]<.ext>``; null if it is no time."""
    base = F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"\.[A-Za-z]+$", "")
    text = F.substring(base, F.lit(prefix_chars + 1), F.char_length(base))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("yyyyMMdd'T'HHmmss.SSSSSS", "yyyyMMdd'T'HHmmss.SSS", "yyyyMMdd'T'HHmmss")]).cast("timestamp_ntz")


def interchange(particles: DataFrame, pixel_size: float, attributes: dict[str, object]) -> DataFrame:
    """Rows of the interchange table, one for each exported particle, with the columns of INTERCHANGE.

    A value comes from the particle's row, else from the table's ``attributes``, else it is
    null. Lengths become micrometres. ``project_name``, ``station`` and ``modified`` (a time)
    among the attributes make the station's id and the process date and time.
    """
    rows = particles.where(F.col("export_name") != "not_exported")
    modified = F.to_timestamp(F.lit(attributes.get("modified")))
    told = {**attributes, "img_rank": 0, "pixel_size": float(pixel_size), "sample_stationid": "-".join(str(attributes.get(k, "")) for k in ("project_name", "station"))}
    made = {"object_date": F.date_format("timestamp", "yyyyMMdd"), "object_time": F.date_format("timestamp", "HHmmss"), "img_file_name": F.concat("export_name", F.lit(".png")),
            "process_date": F.date_format(modified, "yyyyMMdd"), "process_time": F.date_format(modified, "HHmmss")}

    def value(name: str, source: str, kind: str) -> Column:
        if name in made:
            return made[name]
        found = F.col(source) if source in particles.columns else F.lit(told.get(source))
        found = found.cast("string" if kind == "[t]" else "double")
        return found * pixel_size if name in IN_PIXELS else found

    return rows.select(*[value(name, *of).alias(name) for name, of in INTERCHANGE.items()])


def type_header(spark: SparkSession) -> DataFrame:
    """One row of [f] or [t] by column, to stand before the rows of an interchange file."""
    return spark.createDataFrame([tuple(kind for _, kind in INTERCHANGE.values())], ", ".join(f"`{c}` string" for c in INTERCHANGE))


def check_chunks(chunks: int, append: bool) -> None:
    """Several chunks write tables of their own, so they do not go with appending to one."""
    if chunks < 1:
        raise ValueError("chunks must be at least 1")
    if chunks > 1 and append:
        raise ValueError("several chunks need append to be off")


def with_first_files(files: DataFrame, first: int) -> DataFrame:
    """Add the first ``first`` files of all (by ``ord``) to every chunk but the first, marked ``is_background``: a static background's chunks."""
    chunks = files.select("chunk").distinct().where(F.col("chunk") > 0)
    halo = files.where(F.col("ord") < first).drop("chunk").crossJoin(F.broadcast(chunks))  # a row a chunk
    return files.withColumn("is_background", F.lit(False)).unionByName(halo.withColumn("is_background", F.lit(True)).select(*files.columns, "is_background"))


def roi_place(export_name: Column) -> list[Column]:
    """The frame and the name within it that an export name ``<frame>-<name>`` stands for."""
    return [F.substring_index(export_name, "-", 1).alias("frame"), F.substring_index(export_name, "-", -1).alias("roi")]


def with_rois(particles: DataFrame, rois: DataFrame) -> DataFrame:
    """The exported particles with what the region table (frame, roi, ...) has for them; null where it has nothing."""
    named = particles.where(F.col("export_name") != "not_exported")
    return named.withColumns({c: e for c, e in zip(("frame", "roi"), roi_place(F.col("export_name")))}).join(rois, ["frame", "roi"], "left")
