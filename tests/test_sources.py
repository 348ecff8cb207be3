"""Frame files of all formats, as files, as a data source and as a stream."""

import io
import struct
import zlib

import numpy as np
import pytest

from driftlens.functions import images
from driftlens.sources import datasource, frames


def saved(px):
    out = io.BytesIO()
    np.save(out, px)
    return out.getvalue()


def bitmap(px, bits, top_down=False):
    """A bitmap file; 8 bits with a grey palette."""
    h, w = px.shape[:2]
    rows = px if top_down else px[::-1]
    rows = rows[..., ::-1] if bits > 8 else rows[..., None]
    if bits == 32:
        rows = np.concatenate([rows, np.zeros((h, w, 1), np.uint8)], axis=2)
    stride = (w * bits // 8 + 3) // 4 * 4
    body = b"".join(r.tobytes().ljust(stride, b"\0") for r in np.ascontiguousarray(rows))
    palette = b"".join(bytes((k, k, k, 0)) for k in range(256)) if bits == 8 else b""
    start = 54 + len(palette)
    return b"BM" + struct.pack("<IHHI", start + len(body), 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, w, -h if top_down else h, 1, bits, 0, len(body), 0, 0, 0, 0) + palette + body


def png(px, colour, filters, palette=None):
    """A portable network graphic with the given row filters in turn."""
    h, w = px.shape[:2]
    step = images.SAMPLES[colour]
    rows, raw = px.reshape(h, w * step).astype(int), b""
    for y in range(h):
        kind, row = filters[y % len(filters)], rows[y]
        up = rows[y - 1] if y else np.zeros_like(row)
        left, corner = (np.concatenate([np.zeros(step, int), v[:-step]]) for v in (row, up))
        if kind == 4:
            p = left + up - corner
            a, b, c = abs(p - left), abs(p - up), abs(p - corner)
            guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        else:
            guess = [0, left, up, (left + up) // 2][kind]
        raw += bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes()
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    data = zlib.compress(raw)
    return images.PNG + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + (part(b"PLTE", palette.tobytes()) if palette is not None else b"") + part(b"IDAT", data[:20]) + part(b"IDAT", data[20:]) + part(b"IEND", b"")


def test_bitmaps():
    rng = np.random.default_rng(1)
    for w in (5, 8):
        grey, colour = rng.integers(0, 256, (6, w), np.uint8), rng.integers(0, 256, (6, w, 3), np.uint8)
        assert (images.bitmap(bitmap(grey, 8)) == grey).all() and (images.bitmap(bitmap(grey, 8, True)) == grey).all()
        assert (images.bitmap(bitmap(colour, 24)) == colour).all() and (images.bitmap(bitmap(colour, 32, True)) == colour).all()
    with pytest.raises(ValueError):
        images.bitmap(b"PM")


def test_network_graphics():
    rng = np.random.default_rng(2)
    for colour, n in ((0, 1), (2, 3), (4, 2), (6, 4)):
        px = rng.integers(0, 256, (11, 7, n), np.uint8)
        got = images.network_graphic(png(px, colour, [0, 1, 2, 3, 4]))
        assert (got == (px[..., 0] if n < 3 else px[..., :3])).all()
    palette = rng.integers(0, 256, (16, 3), np.uint8)
    index = rng.integers(0, 16, (4, 5, 1), np.uint8)
    assert (images.network_graphic(png(index, 3, [1], palette)) == palette[index[..., 0]]).all()
    whole = bytearray(png(index, 0, [0]))
    whole[60] ^= 1
    with pytest.raises(ValueError):
        images.network_graphic(bytes(whole))


def test_mosaics_are_means_of_known_neighbours():
    """Every colour of every pixel of varied mosaics against a plain loop."""
    rng = np.random.default_rng(3)
    for h, w in ((6, 8), (5, 7), (2, 2)):
        m = rng.integers(0, 256, (h, w))
        kind = lambda y, x: 1 if (y + x) % 2 else 0 if y % 2 == 0 else 2
        got = frames.demosaiced(m)
        for y in range(h):
            for x in range(w):
                for c in range(3):
                    near = [m[j, i] for j in range(max(0, y - 1), min(h, y + 2)) for i in range(max(0, x - 1), min(w, x + 2)) if (j, i) != (y, x) and kind(j, i) == c and (c != 1 or j == y or i == x)]
                    want = m[y, x] if kind(y, x) == c else (sum(near) + len(near) // 2) // max(len(near), 1)
                    assert got[y, x, c] == want


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(4)
    at = tmp_path / "in"
    at.mkdir()
    px = lambda *shape: rng.integers(0, 256, shape, np.uint8)
    files = {
        "D20260101T000001.000000.silc": saved(px(4, 6, 3)), "D20260101T000002.5.silc": saved(px(4, 6, 3)), "D20260101T000003.000000.msilc": saved(px(4, 6, 1)), "D20260101T000004.bsilc": saved(px(4, 6)),
        "D20260101T000005.250.bmp": bitmap(px(4, 6), 8), "20260101T000006.png": png(px(4, 6, 1), 0, [0, 4]), "H-0007.pgm": b"P5\n6 4\n255\n" + px(4, 6).tobytes() + (1_700_000_000).to_bytes(4, "little"),
        "D20260101T000008.000000.silc": b"damaged", "D20260101T000009.000000.silc": saved(px(4, 6)), "other.txt": b"text", "_hidden": b"",
    }
    for name, content in files.items():
        (at / name).write_bytes(content)
    return at


COLUMNS = ["path", "rows", "cols", "channels", "px", "error", "timestamp"]


def shown(rows):
    return sorted((r.path.rpartition("/")[2], r.rows, r.cols, r.channels, tuple(r.px) if r.px is not None else None, r.error, str(r.timestamp)) for r in rows)


def test_source_gives_the_rows_of_the_files(spark, folder):
    datasource.register(spark)
    want = shown(frames.read(spark, str(folder)).select(COLUMNS).collect())
    for size in (100, 1 << 20):
        table = spark.read.format(datasource.NAME).option("partitionBytes", size).load(str(folder))
        assert shown(table.collect()) == want
        n = table.rdd.getNumPartitions()
        assert n == 1 if size > 1000 else n > 5
    by = {r[0]: r for r in want}
    assert len(want) == 10 and sum(r[5] is not None for r in want) == 3
    assert by["20260101T000006.png"][6] == "2026-01-01 00:00:06" and by["H-0007.pgm"][6] == "2023-11-14 22:13:20.000007" and by["D20260101T000005.250.bmp"][6] == "2026-01-01 00:00:05.250000"
    assert by["D20260101T000002.5.silc"][6] == "2026-01-01 00:00:02.500000" and by["D20260101T000004.bsilc"][3] == 3 and by["D20260101T000003.000000.msilc"][3] == 1
    dark = images.network_graphic((folder / "20260101T000006.png").read_bytes())
    assert np.allclose(by["20260101T000006.png"][4], 1 - dark.ravel() / 255)


def test_format_is_an_option(spark, folder):
    datasource.register(spark)
    one = spark.read.format(datasource.NAME).option("pattern", "*.bsilc").option("imageFormat", "MONO8").load(str(folder)).collect()
    assert shown(one) == shown(frames.read(spark, str(folder), "*.bsilc", image_format="mono8").collect()) and one[0].channels == 1
    with pytest.raises(ValueError):
        frames.read(spark, str(folder), image_format="jpeg")
    with pytest.raises(Exception, match="unknown frame format"):
        spark.read.format(datasource.NAME).option("imageFormat", "jpeg").load(str(folder)).collect()


def test_stream_reads_each_file_once(spark, folder, tmp_path):
    datasource.register(spark)

    def go():
        stream = spark.readStream.format(datasource.NAME).option("pattern", "D*").load(str(folder))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(once=True).start()
        query.awaitTermination(120)

    go()
    go()
    (folder / "D20260101T000010.000000.msilc").write_bytes(saved(np.zeros((2, 2), np.uint8)))
    go()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert shown(got) == shown(frames.read(spark, str(folder), "D*").select(COLUMNS).collect())
