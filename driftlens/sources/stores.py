"""Stored tables: partitioned particle tables with column metadata, their merge, auxiliary series and file lists."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Standard name, unit and level (0 recorded, 1 measured, 2 derived) of each column.
_COLUMNS = {
    "major_axis_length": ("major_axis_length", "Pixels", 1), "minor_axis_length": ("minor_axis_length", "Pixels", 1), "equivalent_diameter": ("equivalent_circular_diameter", "Pixels", 1),
    "minr": ("minimum_row_index", "Pixels", 1), "maxr": ("maximum_row_index", "Pixels", 1), "minc": ("minimum_column_index", "Pixels", 1), "maxc": ("maximum_column_index", "Pixels", 1),
    "saturation": ("image_saturation", "percent", 1), "export_name": ("export_name", "", 1), "timestamp": ("timestamp", None, 0), "filename": ("filename", "", 0),
    "particle_count": ("particle_count", "1", 1), "d50": ("median_particle_diameter", "micrometers", 2), "nc": ("number_concentration", "L^-1", 2), "vc": ("volume_concentration", "uL L^-1", 2),
    "sample_volume": ("sample_volume", "L", 2), "junge": ("junge_parameter", "1", 2),
}
#: What the columns are, in our own words.
_LONG_NAMES = {
    "major_axis_length": "major axis of the ellipse with the same second moments", "minor_axis_length": "minor axis of the ellipse with the same second moments",
    "equivalent_diameter": "diameter of a circle of the same area", "minr": "first row of the box", "maxr": "row after the last of the box", "minc": "first column of the box", "maxc": "column after the last of the box",
    "saturation": "share of the allowed coverage", "export_name": "name under which the pixels are stored", "timestamp": "time of the frame", "filename": "file of the frame", "particle_count": "particles of the frame",
    "d50": "median diameter by volume", "nc": "particles a litre", "vc": "volume of particles a litre", "sample_volume": "volume of water of a frame", "junge": "slope of the number distribution",
}
PROBABILITY = "probability_"


def column_metadata(name: str) -> dict:
    """Standard name, long name, unit and level of a column; of ``probability_<class>`` too. Empty for others."""
    if name.startswith(PROBABILITY):
        of = name.removeprefix(PROBABILITY)
        return {"standard_name": f"probability_of_{of}", "long_name": f"probability of the class {of}", "units": "dimensionless fraction", "level": 1}
    if name not in _COLUMNS:
        return {}
    standard, unit, level = _COLUMNS[name]
    out = {"standard_name": standard, "long_name": _LONG_NAMES[name], "units": unit, "level": level}
    return {k: v for k, v in out.items() if v is not None}


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which the cluster shares. Where it is unset a session on one machine (tests) gets a folder there; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="driftlens-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once and read back: their deal does not change from use to use."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


def holds_rows(spark: SparkSession, path: str) -> bool:
    """Whether a folder has anything but marks such as _SUCCESS."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found, "[^_.]*"))
    return listed is not None and len(listed) > 0


def described(table: DataFrame, extra: dict[str, dict] | None = None) -> DataFrame:
    """The same columns with units and names as column metadata; what a column has already stays."""
    told = lambda name: {**column_metadata(name), **(extra or {}).get(name, {})}
    return table.select(*[F.col(f"`{f.name}`").alias(f.name, metadata={**told(f.name), **(f.metadata or {})}) for f in table.schema])


#: Columns that are text also in a table that has no value of them.
STRINGS = ("export_name", "holo_filename", "filename", "reason")


def typed(table: DataFrame, strings: tuple[str, ...] = STRINGS) -> DataFrame:
    """The same columns with types of their own: columns named in ``strings`` are text, other columns without a type (of nothing
    but nulls, as in a first frame without particles) are doubles, and ``timestamp`` is to the microsecond and without zone."""
    def cell(f) -> Column:
        kind = "string" if f.name in strings else "timestamp_ntz" if f.name == "timestamp" else "double" if f.dataType.simpleString() == "void" else None
        column = F.col(f"`{f.name}`")
        return column.cast(kind).alias(f.name, metadata=f.metadata or {}) if kind else column

    return table.select(*[cell(f) for f in table.schema])


def append(table: DataFrame, path: str, time: str = "timestamp", about: dict | None = None) -> None:
    """Append to a Parquet table with a folder a day; what is stored is not read or rewritten.

    ``about`` (settings, project) is kept as metadata of the time column. An empty table writes
    no rows. Rows without a time go to the folder of null days.
    """
    out = described(table, {time: {"about": json.dumps(about)}} if about else None)
    out.withColumn("day", F.to_date(time)).repartition("day", F.xxhash64(time)).write.mode("append").partitionBy("day").parquet(path)


def load(spark: SparkSession, *paths: str) -> DataFrame:
    """Tables of one or more folders as one, by column name; missing columns are null. Filters on ``day`` prune folders.

    A folder to which only empty tables were appended has no schema and is passed over.
    """
    tables = [spark.read.option("mergeSchema", "true").parquet(p) for p in paths if holds_rows(spark, p)]
    if not tables:
        raise ValueError("no stored rows")
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def about(table: DataFrame, time: str = "timestamp") -> dict | None:
    """What ``append`` was told of settings and project."""
    text = (table.schema[time].metadata or {}).get("about")
    return json.loads(text) if text else None


def merge(spark: SparkSession, paths: list[str], target: str, time: str = "timestamp") -> None:
    """One table of many small ones, in ranges of time, so that files can be skipped by their statistics."""
    if not paths:
        raise ValueError("nothing to merge")
    if not any(holds_rows(spark, p) for p in paths):
        return  # empty tables only
    rows = load(spark, *paths).drop("day").withColumn("day", F.to_date(time))
    rows.repartitionByRange("day", time).sortWithinPartitions("day", time).write.mode("overwrite").partitionBy("day").parquet(target)


def put(table: DataFrame, path: str, part: str) -> None:
    """Write rows so that writing them again changes nothing: what is stored under the same values of ``part`` is replaced, the rest stays.

    Writers of different parts do not disturb each other. A part without rows is not touched.
    """
    table.repartition(part, F.xxhash64(*[f"`{c}`" for c in table.columns])).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def write_file_list(files: DataFrame, path: str) -> None:
    """The column ``path`` as lines of text."""
    files.select("path").write.text(path)


def from_csv(spark: SparkSession, source: str, target: str) -> None:
    """A table of comma-separated values with a header, stored as Parquet."""
    spark.read.csv(source, header=True, inferSchema=True).write.mode("overwrite").parquet(target)


def auxiliary(spark: SparkSession, path: str) -> DataFrame:
    """A time series file: two lines of remarks, units, descriptions, header, rows.

    ``time`` is a time without zone, the other columns are doubles with their units and
    descriptions as metadata. A value that is no number, or a time that is none, is null.
    """
    head = [r.value for r in spark.read.text(path).limit(5).collect()]  # the five lines before the rows
    if len(head) < 5:
        raise ValueError("the file has no header line")
    units, names, columns = ([x.strip() for x in line.split(",")] for line in head[2:5])
    raw = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).csv(path, comment="#").where(F.col("`time`").rlike(r"^\s*\d{4}-\d\d-\d\d"))

    def cell(k: int, c: str) -> Column:
        kind = "timestamp_ntz" if c == "time" else "double"
        told = {key: values[k] for key, values in (("units", units), ("long_name", names)) if k < len(values) and values[k]}
        return F.trim(F.col(f"`{c}`")).try_cast(kind).alias(c, metadata=told)

    return raw.select(*[cell(k, c) for k, c in enumerate(columns)])


def file_list(spark: SparkSession, path: str) -> DataFrame:
    """(path) of the lines of a text file, ends stripped, empty lines left out."""
    return spark.read.text(path).select(F.rtrim("value").alias("path")).where("path <> ''")
