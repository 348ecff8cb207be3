"""Decoders of image files that need no library: bitmaps and portable network graphics."""

from __future__ import annotations

import struct
import zlib

import numpy as np

PNG = b"\x89PNG\r\n\x1a\n"
#: Samples a pixel by colour type: grey, colours, palette, grey and alpha, colours and alpha.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def bitmap(content: bytes) -> np.ndarray:
    """(H, W) of grey palettes, (H, W, 3) of others and of 24 or 32 bits a pixel; uncompressed only."""
    if content[:2] != b"BM":
        raise ValueError("not a bitmap")
    start, head, width, height, _, bits, packing = struct.unpack_from("<IIiiHHI", content, 10)
    if packing not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError(f"bitmaps of {bits} bits or packing {packing} are not read")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(content, np.uint8, stride * abs(height), start).reshape(abs(height), stride)
    px = rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)
    px = px[::-1] if height > 0 else px
    if bits > 8:
        return px[..., 2::-1]
    count = struct.unpack_from("<I", content, 46)[0] or 256
    palette = np.zeros((256, 3), np.uint8)
    palette[:count] = np.frombuffer(content, np.uint8, 4 * count, 14 + head).reshape(count, 4)[:, 2::-1]
    out = palette[px[..., 0]]
    return out[..., 0] if (palette == palette[:, :1]).all() else out


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A row of bytes from its differences to its left, upper and upper left neighbours."""
    if kind == 0:
        return row
    if kind == 2:
        return row + above
    if kind == 1:
        return np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    out, up = row.astype(int).tolist(), above.astype(int).tolist()
    for i in range(len(out)):
        left, corner = (out[i - step], up[i - step]) if i >= step else (0, 0)
        if kind == 3:
            guess = (left + up[i]) // 2
        elif kind == 4:
            p = left + up[i] - corner
            guess = min(((abs(p - left), 0, left), (abs(p - up[i]), 1, up[i]), (abs(p - corner), 2, corner)))[2]
        else:
            raise ValueError(f"unknown row filter {kind}")
        out[i] = (out[i] + guess) & 255
    return np.array(out, np.uint8)


def network_graphic(content: bytes) -> np.ndarray:
    """(H, W) of grey, (H, W, 3) of colours or palettes, of eight bits a sample and not interlaced; alpha is left out."""
    if content[:8] != PNG:
        raise ValueError("not a portable network graphic")
    at, data, palette, shape = 8, b"", None, None
    while at < len(content):
        size, kind = struct.unpack_from(">I4s", content, at)
        body = content[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", content, at + 8 + size)[0]:
            raise ValueError("damaged part of a portable network graphic")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    if shape is None:
        raise ValueError("no header")
    width, height, depth, colour, _, _, interlaced = shape
    if depth != 8 or interlaced or colour not in SAMPLES:
        raise ValueError("only eight bits a sample, not interlaced")
    step = SAMPLES[colour]
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height, width * step), np.uint8)
    above = np.zeros(width * step, np.uint8)
    for y in range(height):
        above = out[y] = _unfiltered(int(rows[y, 0]), rows[y, 1:], above, step)
    px = out.reshape(height, width, step)
    if colour == 3:
        return palette[px[..., 0]]
    return px[..., 0] if step < 3 else px[..., :3]
