"""Settings that instruments are usually run with; every value can be changed with ``pipeline.changed``."""

from __future__ import annotations


def colour_camera(raw_files: str, target: str | None = None) -> dict:
    """Colour frames of a backlit camera, background corrected beforehand."""
    # Pixel size (um), threshold.
    return _settings(raw_files, 28, target, {"prep": {"step": "darkest_channel"}, "segment": {"step": "segment", "threshold": 0.85}, "statistics": {"step": "statistics", "export": True}})


def vignettes(raw_files: str, target: str | None = None) -> dict:
    """Single light particles on dark ground, inverted when read."""
    # Pixel size (um), threshold.
    return _settings(raw_files, 80, target, {"segment": {"step": "segment", "threshold": 0.95}, "statistics": {"step": "statistics"}})


def focused_holograms(raw_files: str, target: str | None = None) -> dict:
    """Focused planes of holograms (see ``operators.holograms``, whose own values are in ``holo``)."""
    # Pixel size (um), threshold, wavelength (nm), index, depths (mm).
    out = _settings(raw_files, 4.4, target, {"segment": {"step": "segment", "threshold": 0.9}, "statistics": {"step": "statistics", "export": True}})
    out["general"]["holo"] = {"wavelength_nm": 658.0, "index": 1.33, "low": 0.0, "high": 50.0, "step": 0.5, "offset_mm": 27.0}
    return out


def _settings(raw_files: str, pixel_size: float, target: str | None, steps: dict) -> dict:
    out = {"general": {"raw_files": raw_files, "pixel_size": float(pixel_size), "path_length": 40.0}, "steps": steps}
    if target:
        out["output"] = {"path": target}
    return out


PRESETS = {"colour_camera": colour_camera, "vignettes": vignettes, "focused_holograms": focused_holograms}
