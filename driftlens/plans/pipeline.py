"""Steps named in a configuration, put together as one DataFrame plan."""

from __future__ import annotations

import importlib
import json
import tomllib
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.functions import kernels, sizes
from driftlens.operators import exports, particles, profiles
from driftlens.sources import stores

@dataclass
class Project:
    """What is told of a deployment; other values go into ``more``."""

    # Names, the word for what is not told, the licence.
    title: str = "NOT_SPECIFIED"
    project_name: str = "NOT_SPECIFIED"
    instrument: str = "NOT_SPECIFIED"
    seavox_instrument_identifier: str = "NOT_SPECIFIED"
    longitude: float | None = None
    latitude: float | None = None
    station: str = "NOT_SPECIFIED"
    creator_name: str = "NOT_SPECIFIED"
    creator_email: str = "NOT_SPECIFIED"
    creator_url: str = "NOT_SPECIFIED"
    institution: str = "NOT_SPECIFIED"
    license: str = "CC BY-SA 4.0 https://creativecommons.org/licenses/by-sa/4.0/"
    more: dict = field(default_factory=dict)

    @classmethod
    def of(cls, told: dict) -> Project:
        """From a dictionary, as read from JSON; a known field of the wrong type is an error."""
        known = {f.name: f.type for f in fields(cls) if f.name != "more"}
        for name in known:
            value = told.get(name)
            fits = isinstance(value, (int, float)) and not isinstance(value, bool) or value is None if "float" in known[name] else isinstance(value, str)
            if name in told and not fits:
                raise ValueError(f"{name} may not be {value!r}")
        more = {**told.get("more", {}), **{k: v for k, v in told.items() if k not in known and k != "more"}}
        return cls(**{k: told[k] for k in known if k in told}, more=more)


STEPS: dict[str, Callable[..., DataFrame]] = {}


def step(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    STEPS[f.__name__] = f
    return f


def _per_frame(frames: DataFrame, column: str, kind: str, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Add ``column``, the kernel's result on each frame as a flat array; a frame that fails gets null and its ``error``."""
    rest = [c for c in frames.columns if c not in (column, "error")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.select(*rest).schema) + f", `{column}` {kind}, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, errors = [], []
            for px, rows, cols, channels, error in zip(batch["px"], batch["rows"], batch["cols"], batch["channels"], batch["error"]):
                value = None
                if px is not None and error is None:
                    try:
                        im = np.asarray(px, np.float64).reshape((int(rows), int(cols)) if channels == 1 else (int(rows), int(cols), int(channels)))
                        value = kernel(im).ravel()
                    except Exception as e:  # one bad frame is a row with its reason, not a failed job
                        error = f"{type(e).__name__}: {e}"
                out.append(value)
                errors.append(error)
            yield batch[rest].assign(**{column: out, "error": errors})

    return frames.mapInPandas(run, schema)


@step
def box_mask(frames: DataFrame, r0: int, r1: int, c0: int, c1: int, fill: float = 1.0) -> DataFrame:
    return _per_frame(frames, "px", "array<double>", lambda im: kernels.inside_box(im, r0, r1, c0, c1, fill)).select(*frames.columns)


@step
def circle_mask(frames: DataFrame, radius: float) -> DataFrame:
    return _per_frame(frames, "px", "array<double>", lambda im: kernels.inside_circle(im, radius)).select(*frames.columns)


@step
def darkest_channel(frames: DataFrame) -> DataFrame:
    """One channel: the smallest of each pixel's."""
    out = _per_frame(frames, "px", "array<double>", lambda im: im if im.ndim == 2 else im.min(axis=2))
    return out.withColumn("channels", F.lit(1)).select(*frames.columns)


@step
def segment(frames: DataFrame, threshold: float = 0.98, minimum_area: int = 12, fill_holes: bool = True, method: str = "fast") -> DataFrame:
    """Add ``dark array<boolean>``."""
    if method != "fast":
        raise ValueError(f"unknown segmentation method {method!r}")
    return _per_frame(frames, "dark", "array<boolean>", lambda im: kernels.segmented(im, threshold, minimum_area, fill_holes))


@step
def statistics(frames: DataFrame, max_coverage: float = 30.0, max_particles: int = 5000, frame: str = "timestamp", export: bool = False, min_length: float = 0.0, bbox_expansion: float = 0.0) -> DataFrame:
    """One row a particle and one for each frame without any (see ``particles.extracted``), so empty, refused and broken frames stay.

    ``export_name`` is ``D<time>-PN<n>`` for particles longer than ``min_length`` and wider than 2
    pixels if ``export`` is set, which also adds their pixels as ``roi``, else ``not_exported``.
    """
    keys = [c for c in dict.fromkeys((frame, "path", "timestamp")) if c in frames.columns]
    rows = particles.extracted(frames, keys, max_coverage, max_particles, export, bbox_expansion)
    name = F.concat(F.date_format("timestamp", "'D'yyyyMMdd'T'HHmmss.SSSSSS"), F.lit("-PN"), (F.col("label") - 1).cast("string"))
    chosen = (F.col("major_axis_length") > min_length) & (F.col("minor_axis_length") > 2)
    rows = rows.withColumn("export_name", F.coalesce(F.when(chosen & F.lit(export), name), F.lit("not_exported")))
    if export:
        rows = rows.withColumn("roi", F.when(F.col("export_name") != "not_exported", F.col("roi")))
    return rows.withColumnRenamed("path", "filename") if "path" in keys else rows.withColumn("filename", F.lit(None).cast("string"))


@dataclass
class Outputs:
    """Particles, a row of image statistics for every frame, and the pixels of exported particles; all read the rows that were written once."""

    particles: DataFrame
    frames: DataFrame
    rois: DataFrame | None


def outputs(rows: DataFrame, pixel_size: float, sample_volume: float, key: str | list[str] = "timestamp") -> Outputs:
    """Write the result of ``statistics`` once and read it as three tables. ``frames`` has the ``reason`` of frames without particles."""
    held = stores.kept(rows, "statistics")
    frames = profiles.image_stats(held, pixel_size, sample_volume, key, ("reason",))
    rois = None
    if "roi" in held.columns:
        rois = held.where("roi IS NOT NULL").select(*exports.roi_place(F.col("export_name")), "roi.*")
    return Outputs(held.where("label IS NOT NULL").drop("roi", "reason"), frames, rois)


def load(path: str) -> dict:
    """A configuration file; ``general.raw_files`` is required."""
    with open(path, "rb") as f:
        settings = tomllib.load(f)
    if "raw_files" not in settings.get("general", {}):
        raise ValueError("general.raw_files is missing")
    return settings


def save(settings: dict, path: str) -> None:
    """Write a configuration file that ``load`` reads; values are numbers, booleans, text and lists of them."""

    def table(name: str, values: dict) -> list[str]:
        plain = {k: v for k, v in values.items() if not isinstance(v, dict)}
        lines = ([f"[{name}]"] if name and (plain or not values) else []) + [f"{json.dumps(k)} = {json.dumps(v)}" for k, v in plain.items()]
        for k, v in values.items():
            if isinstance(v, dict):
                lines += table(f"{name}.{json.dumps(k)}" if name else json.dumps(k), v)
        return lines

    with open(path, "w") as f:
        f.write("\n".join(table("", settings)) + "\n")


def find(name: str) -> Callable[..., DataFrame]:
    """A registered step, or any function (DataFrame, **settings) -> DataFrame by its dotted name."""
    if name in STEPS:
        return STEPS[name]
    module, _, function = name.rpartition(".")
    if not module:
        raise ValueError(f"unknown step {name!r}")
    return getattr(importlib.import_module(module), function)


def build(frames: DataFrame, settings: dict, only: list[str] | None = None) -> DataFrame:
    """The plan of all steps in their order, or of those named in ``only``; nothing runs until its result is read."""
    missing = set(only or []) - set(settings["steps"])
    if missing:
        raise ValueError(f"unknown steps {sorted(missing)}")
    out = frames
    for name, options in settings["steps"].items():
        if only is None or name in only:
            options = dict(options)
            out = find(options.pop("step"))(out, **options)
    return out


def changed(settings: dict, **changes: object) -> dict:
    """A copy with other values: ``changed(settings, segment__threshold=0.8)`` sets a step's option, ``general__pixel_size=...`` a general one."""
    out = {"general": dict(settings.get("general", {})), "steps": {k: dict(v) for k, v in settings["steps"].items()}}
    for name, value in changes.items():
        group, _, option = name.partition("__")
        target = out["general"] if group == "general" else out["steps"].get(group)
        if not option or target is None:
            raise ValueError(f"nothing to set for {name!r}")
        target[option] = value
    return out


def stored_with(rows: DataFrame, settings: dict, project: Project | None, path: str) -> None:
    """Append rows with the settings that made them and the project's metadata (see ``again``)."""
    stores.append(rows, path, about={"settings": settings, "project": asdict(project or Project())})


def again(spark: SparkSession, path: str, frames: DataFrame, **changes: object) -> tuple[DataFrame, Project]:
    """The plan that made a stored table, built anew over ``frames`` with ``changed`` settings, and the project it was stored with."""
    told = stores.about(stores.load(spark, path))
    if not told:
        raise ValueError(f"{path} has no settings")
    return build(frames, changed(told["settings"], **changes)), Project.of(told["project"])


def describe(settings: dict) -> str:
    lines = []
    for k, (name, options) in enumerate(settings["steps"].items(), 1):
        told = ", ".join(f"{a}={b!r}" for a, b in options.items() if a != "step")
        lines.append(f"{k}. {name}: {options['step']}({told})")
    return "\n".join(lines)


def run(frames: DataFrame, settings: dict, project: Project | None = None) -> Outputs:
    """Build the plan, write its rows once and append its tables under ``output.path``.

    ``particles`` and ``image_stats`` have the settings and the project as metadata; ``rois`` is
    there if the plan exports pixels. ``general`` needs pixel_size, and path_length (mm) for concentrations (40 unless told); rows and cols of a frame may be told.
    """
    general, path = settings["general"], settings["output"]["path"]
    size = [general[k] for k in ("rows", "cols") if k in general]
    volume = sizes.sample_volume(general["pixel_size"], general.get("path_length", 40.0), *size)
    out = outputs(build(frames, settings), general["pixel_size"], volume)
    about = {"settings": settings, "project": asdict(project or Project())}
    for name, table in (("particles", out.particles), ("image_stats", out.frames)):
        stores.append(stores.typed(table), f"{path}/{name}", about=about)
    if out.rois is not None:
        out.rois.repartitionByRange("frame").sortWithinPartitions("frame", "roi").write.mode("append").parquet(f"{path}/rois")
    return out
