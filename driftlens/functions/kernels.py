"""NumPy kernels of one frame; they run inside tasks."""

from __future__ import annotations

import numpy as np


def components(mask: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Labels 1, 2, ... of connected dark pixels in the order of their first pixel; 0 elsewhere.

    Every pixel takes the smallest index among its neighbours' roots until none changes, with
    chains shortened in between, so rounds grow with the logarithm of a component's extent.
    """
    rows, cols = mask.shape
    at = np.arange(rows * cols).reshape(rows, cols)
    steps = [(at[:, :-1], at[:, 1:]), (at[:-1], at[1:])] + ([(at[:-1, :-1], at[1:, 1:]), (at[:-1, 1:], at[1:, :-1])] if diagonal else [])
    dark = mask.ravel()
    a, b = (np.concatenate([x[k].ravel() for x in steps]) for k in (0, 1))
    both = dark[a] & dark[b]
    a, b = a[both], b[both]
    root = np.arange(rows * cols)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while not np.array_equal(root, root[root]):
            root = root[root]
    firsts = np.unique(root[dark])
    out = np.zeros(rows * cols, np.int32)
    out[dark] = np.searchsorted(firsts, root[dark]) + 1
    return out.reshape(rows, cols)


def crops(im: np.ndarray, label: np.ndarray, expansion: float = 0.0) -> list[np.ndarray]:
    """The pixels of each label's box, grown by round(size * expansion / 2) on every side (halves to even) and kept inside the frame."""
    rows, cols = label.shape
    at = np.flatnonzero(label)
    of = label.ravel()[at] - 1
    n = int(label.max())
    low, high = np.full((2, n), max(rows, cols)), np.zeros((2, n), int)
    for k, x in enumerate((at // cols, at % cols)):
        np.minimum.at(low[k], of, x)
        np.maximum.at(high[k], of, x + 1)
    pad = np.rint((high - low) * expansion / 2).astype(int)
    low, high = np.maximum(low - pad, 0), np.minimum(high + pad, [[rows], [cols]])
    return [im[low[0, k] : high[0, k], low[1, k] : high[1, k]] for k in range(n)]


def without_small(mask: np.ndarray, least: int) -> np.ndarray:
    """Components (sides only) of fewer than ``least`` pixels go."""
    label = components(mask, diagonal=False)
    big = np.bincount(label.ravel()) >= least
    big[0] = False
    return big[label]


def without_border(mask: np.ndarray, buffer: int = 2) -> np.ndarray:
    """Components with a pixel within ``buffer`` pixels of the outermost ones go."""
    label = components(mask)
    edge = np.ones(mask.shape, bool)
    k = buffer + 1
    edge[k : mask.shape[0] - k, k : mask.shape[1] - k] = False
    return mask & ~np.isin(label, np.unique(label[edge & mask]))


def filled(mask: np.ndarray) -> np.ndarray:
    """Light areas that no path along sides joins to the border become dark."""
    light = np.pad(~mask, 1, constant_values=True)
    label = components(light, diagonal=False)
    return (label != label[0, 0])[1:-1, 1:-1]


def dark_pixels(im: np.ndarray, threshold: float = 0.98) -> np.ndarray:
    return im < threshold * np.median(im)


def segmented(im: np.ndarray, threshold: float = 0.98, least: int = 12, fill: bool = True, buffer: int = 2) -> np.ndarray:
    """Threshold, drop small and border components, fill holes."""
    mask = without_border(without_small(dark_pixels(im, threshold), least), buffer)
    return filled(mask) if fill else mask


def inside_box(im: np.ndarray, r0: int, r1: int, c0: int, c1: int, fill: float = 1.0) -> np.ndarray:
    """Pixels outside the half-open box become ``fill``."""
    out = np.full_like(im, fill)
    out[r0:r1, c0:c1] = im[r0:r1, c0:c1]
    return out


def inside_circle(im: np.ndarray, radius: float, centre: tuple[float, float] | None = None) -> np.ndarray:
    """Pixels not less than ``radius`` from the centre become 0."""
    r, c = centre if centre else (im.shape[0] // 2, im.shape[1] // 2)
    y, x = np.ogrid[: im.shape[0], : im.shape[1]]
    near = (y - r) ** 2 + (x - c) ** 2 < radius**2
    return im * (near if im.ndim == 2 else near[..., None])


def depths(low: float, high: float, step: float) -> np.ndarray:
    return np.arange(low, high + step, step)


def refocused(im: np.ndarray, depth_mm: float, pixel_um: float, wavelength_nm: float, index: float, clear: str = "dc") -> np.ndarray:
    """Real part of one plane of a hologram, by the Fresnel transfer function on its spectrum.

    ``clear``: "none", "dc" (the mean) or "axes" (the first row and column of the spectrum).
    """
    spectrum = np.fft.fft2(im)
    if clear == "dc":
        spectrum[0, 0] = 0
    elif clear == "axes":
        spectrum[0], spectrum[:, 0] = 0, 0
    fy, fx = (2 * np.pi * np.fft.fftfreq(n, pixel_um * 1e-6) for n in im.shape)
    k = 2 * np.pi / (wavelength_nm * 1e-9)
    phase = (fy[:, None] ** 2 + fx[None, :] ** 2) * (depth_mm * 1e-3 / index) / (2 * k)
    return np.fft.ifft2(spectrum * np.exp(-1j * phase)).real
