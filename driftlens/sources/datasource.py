"""Frames as a Spark data source: ``spark.read.format("driftlens_frames")`` and ``spark.readStream``.

``register`` makes the name known to a session. Options: ``path`` (a folder, local or of any store that
pyarrow's file systems know), ``pattern`` (of names), ``imageFormat`` (see ``frames.FORMATS``), ``prefixChars`` and
``partitionBytes``. Stores that only Spark's own readers open are read by ``frames.read`` instead; the rows are the same.
"""

from __future__ import annotations

import datetime
import fnmatch
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from driftlens.sources import frames

NAME = "driftlens_frames"
COLUMNS = pa.schema([("path", pa.string()), ("rows", pa.int32()), ("cols", pa.int32()), ("channels", pa.int32()), ("px", pa.list_(pa.float64())), ("error", pa.string()), ("timestamp", pa.timestamp("us"))])


def name_time(path: str, prefix_chars: int) -> datetime.datetime | None:
    """The time that a file is named by: ``<prefix>yyyyMMddTHHmmss[.f to .ffffff]<.ext>``."""
    base = re.sub(r"\.[A-Za-z]+$", "", path.rpartition("/")[2])[prefix_chars:]
    if not re.fullmatch(r"\d{8}T\d{6}(\.\d{1,6})?", base):
        return None
    try:
        return datetime.datetime.strptime(base, "%Y%m%dT%H%M%S.%f" if "." in base else "%Y%m%dT%H%M%S")
    except ValueError:
        return None


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class Reader:
    """What both readers share: the list of files, their partitions by bytes, and their rows."""

    def __init__(self, options: dict):
        self.path = options.get("path")
        if not self.path:
            raise ValueError(f"{NAME} needs a path")
        self.pattern, self.format = options.get("pattern", "*"), options.get("imageFormat", "infer")
        self.prefix, self.most = int(options.get("prefixChars", 1)), int(options.get("partitionBytes", 64 << 20))
        if self.format != "infer" and self.format.lower() not in frames.FORMATS:
            raise ValueError(f"unknown frame format {self.format!r}")

    def listed(self) -> list[tuple[int, str, int]]:
        """(modification time in nanoseconds, path, bytes) in ascending order."""
        store, root = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(root))
        return sorted((f.mtime_ns, f.path, f.size) for f in found if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.base_name, self.pattern) and f.base_name[0] not in "._")

    def packed(self, files: list[tuple[int, str, int]]) -> list[Files]:
        """Partitions of neighbouring files of about ``partitionBytes``; a larger file is one by itself."""
        out, size = [], 0
        for _, path, n in files:
            if not out or size + n > self.most:
                out.append([])
                size = 0
            out[-1].append(path)
            size += n
        return [Files(paths) for paths in out]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)
        for path in partition.paths:
            with store.open_input_stream(path) as f:
                row = frames.frame_row(path, f.read(), self.format)
            foot = row.pop("footer_s")
            number = re.search(r"-(\d+)\.[A-Za-z]+$", path)
            vignette = self.format.lower() == "vignette" or self.format == "infer" and path.lower().endswith(".png")
            time = name_time(path, 0 if vignette else self.prefix)
            if foot is not None:
                time = datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=foot, microseconds=int(number[1]) if number else 0)
            yield pa.RecordBatch.from_arrays([pa.array([(row | {"timestamp": time})[f.name]], f.type) for f in COLUMNS], schema=COLUMNS)


class BatchReader(Reader, DataSourceReader):
    def partitions(self) -> list[Files]:
        return self.packed(self.listed())


class StreamReader(Reader, DataSourceStreamReader):
    """Offsets are (modification time, path) of the last file read: later files are those that come after it in that order.

    A file that is moved in with an older time than those already read is not seen; ``frames.watch`` sees it.
    """

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        files = self.listed()
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        key = lambda o: (o["time"], o["path"])
        return self.packed([f for f in self.listed() if key(start) < f[:2] <= key(end)])

    def commit(self, end: dict) -> None:
        pass


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, rows int, cols int, channels int, px array<double>, error string, timestamp timestamp_ntz"

    def reader(self, schema) -> BatchReader:
        return BatchReader(self.options)

    def streamReader(self, schema) -> StreamReader:  # noqa: N802
        return StreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FrameSource)
