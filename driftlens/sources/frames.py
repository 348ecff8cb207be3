"""Frames from files: arrays, Bayer mosaics and portable grey maps, in batches and streams."""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.functions import images
from driftlens.operators.exports import parse_timestamp

SCHEMA = "path string, rows int, cols int, channels int, px array<double>, footer_s long, error string"
BINARY = "path string, modificationTime timestamp, length long, content binary"


def demosaiced(mosaic: np.ndarray) -> np.ndarray:
    """(H, W, 3) of a red-green / green-blue mosaic; a missing colour is its known neighbours' rounded mean."""
    rows, cols = mosaic.shape
    y, x = np.mgrid[:rows, :cols]
    kind = np.where((y + x) % 2 == 1, 1, np.where(y % 2 == 0, 0, 2))
    out = np.empty((rows, cols, 3), np.int64)
    near = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]
    for colour in range(3):
        known = np.pad((kind == colour).astype(np.int64), 1)
        value = np.pad(mosaic.astype(np.int64), 1) * known
        use = [(i, j) for i, j in near if colour != 1 or i == 0 or j == 0]  # greens: sides only
        part = lambda p: sum(p[1 + i : 1 + i + rows, 1 + j : 1 + j + cols] for i, j in use)
        count = part(known)
        out[..., colour] = np.where(kind == colour, mosaic, (part(value) + count // 2) // np.maximum(count, 1))
    return out


def portable_grey(content: bytes) -> tuple[np.ndarray, int | None]:
    """Pixels of a binary grey map of one byte a pixel, and the seconds in the four bytes after them, if any."""
    head = re.match(rb"P5\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s", content)
    if not head or int(head[3]) > 255:
        raise ValueError("not a grey map of one byte a pixel")
    w, h = int(head[1]), int(head[2])
    end = head.end() + w * h
    px = np.frombuffer(content[head.end() : end], np.uint8).reshape(h, w)
    foot = content[end : end + 4]
    return px, int.from_bytes(foot, "little", signed=True) if len(foot) == 4 else None


def _array(channels: int | None) -> Callable[[bytes], tuple[np.ndarray, None]]:
    def load(content: bytes) -> tuple[np.ndarray, None]:
        px = np.load(io.BytesIO(content), allow_pickle=False)
        if channels == 3 and (px.ndim != 3 or px.shape[2] != 3):
            raise ValueError("a colour frame has three channels")
        if channels != 3:
            px = px[..., 0] if px.ndim == 3 and px.shape[2] == 1 else px
            if px.ndim != 2:
                raise ValueError("this frame has one channel")
        return px / 255.0, None

    return load


def _mosaic(content: bytes) -> tuple[np.ndarray, None]:
    px = np.load(io.BytesIO(content), allow_pickle=False)
    px = px[..., 0] if px.ndim == 3 and px.shape[2] == 1 else px
    if px.ndim != 2:
        raise ValueError("this frame has one channel")
    return demosaiced(px) / 255.0, None


def _grey_map(content: bytes) -> tuple[np.ndarray, int | None]:
    px, foot = portable_grey(content)
    return px / 255.0, foot


#: Formats by name: each gives the frame scaled to 0..1, and the seconds in its footer if it has one. A vignette is light on dark and is inverted.
FORMATS: dict[str, Callable[[bytes], tuple[np.ndarray, int | None]]] = {
    "rgb8": _array(3), "mono8": _array(1), "bayer_rg8": _mosaic, "grey_map": _grey_map,
    "bitmap": lambda content: (images.bitmap(content) / 255.0, None), "vignette": lambda content: ((255.0 - images.network_graphic(content)) / 255.0, None),
}
EXTENSIONS = {"silc": "rgb8", "msilc": "mono8", "bsilc": "bayer_rg8", "pgm": "grey_map", "bmp": "bitmap", "png": "vignette"}


def decoded(name: str, content: bytes, image_format: str = "infer") -> tuple[np.ndarray, int | None]:
    """A frame scaled to 0..1, by its format or the extension of its file's name."""
    kind = name.rpartition(".")[2].lower()
    found = EXTENSIONS.get(kind) if image_format == "infer" else image_format.lower()
    if found not in FORMATS:
        raise ValueError(f"unknown frame format {kind if image_format == 'infer' else image_format!r}")
    return FORMATS[found](content)


def frame_row(path: str, content: bytes, image_format: str = "infer") -> dict:
    """The columns of SCHEMA; a file that cannot be read is a row with its reason, not a failed job."""
    row = {"path": path, "rows": None, "cols": None, "channels": None, "px": None, "footer_s": None, "error": None}
    try:
        px, foot = decoded(path, content, image_format)
        return row | {"rows": px.shape[0], "cols": px.shape[1], "channels": 1 if px.ndim == 2 else px.shape[2], "px": px.ravel(), "footer_s": foot}
    except Exception as e:
        return row | {"error": f"{type(e).__name__}: {e}"}


def frames(files: DataFrame, prefix_chars: int = 1, image_format: str = "infer") -> DataFrame:
    """Decode binary files. ``timestamp`` is the footer's second plus the file number as microseconds, else the name's time.

    ``image_format`` is "infer" (by extension) or a name of FORMATS. A vignette's name is its time, without a prefix.
    A file that cannot be read keeps its row, with ``error`` and null pixels.
    """
    if image_format != "infer" and image_format.lower() not in FORMATS:
        raise ValueError(f"unknown frame format {image_format!r}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                out = pd.DataFrame([frame_row(path, bytes(content), image_format)])
                yield out.astype({c: "Int64" for c in ("rows", "cols", "channels", "footer_s")})

    out = files.select("path", "content").mapInPandas(run, SCHEMA)
    number = F.regexp_extract("path", r"-(\d+)\.[A-Za-z]+$", 1).try_cast("long")
    foot = F.timestamp_micros(F.col("footer_s") * 1_000_000 + F.coalesce(number, F.lit(0))).cast("timestamp_ntz")
    plain = F.lower("path").endswith(".png") if image_format == "infer" else F.lit(image_format.lower() == "vignette")
    name = F.when(plain, parse_timestamp(F.col("path"), 0)).otherwise(parse_timestamp(F.col("path"), prefix_chars))
    return out.withColumn("timestamp", F.coalesce(foot, name)).drop("footer_s")


def read(spark: SparkSession, folder: str, pattern: str = "*", prefix_chars: int = 1, image_format: str = "infer") -> DataFrame:
    return frames(spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder), prefix_chars, image_format)


def watch(spark: SparkSession, folder: str, pattern: str = "*", prefix_chars: int = 1, files_per_batch: int = 100, image_format: str = "infer") -> DataFrame:
    """The same as a stream: each file once, by the checkpoint's log; earlier files come first."""
    stream = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch)
    return frames(stream.load(folder), prefix_chars, image_format)
