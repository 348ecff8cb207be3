"""Vectorised helpers over the bytes of an Arrow batch of texts; they run inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_B = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BI = pow(_B, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]

#: Bytes of text that one step works on; a longer text is a step of its own.
STEP_BYTES = 512 << 10


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_B, _BI)):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
        if size > 4 * STEP_BYTES:  # one very long text: not kept
            out = _powers[0][:n], _powers[1][:n]
            _powers[:] = [np.ones(1, U64), np.ones(1, U64)]
            return out
    return _powers[0][:n], _powers[1][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """s with s[j] - s[i] = sum of (data[k] + 1) * base**k for i <= k < j."""
    p, _ = powers(len(data) + 1)
    s = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * p[: len(data)], out=s[1:])
    return s


def span_hashes(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes and length, the same wherever the span stands."""
    _, inverse = powers(len(s))
    h = (s[end] - s[start]) * inverse[start]
    return mix(h + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and n + 1 offsets; a null has no bytes."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def steps(batch: pa.RecordBatch, column: str = "text", step_bytes: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of parts of about ``step_bytes``."""
    n = batch.num_rows
    if not n:
        return
    buf, offs = binary(batch.column(batch.schema.get_field_index(column)))
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + step_bytes, "right")) - 1)
        b = min(b, n)
        yield a, b, buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word: a maximal run without ASCII white space in one text."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    white = WHITE[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[offs] = True
    before = np.empty(len(buf), bool)
    before[0] = True
    before[1:] = white[:-1]
    start = np.flatnonzero(~white & (before | first[:-1]))
    after = np.empty(len(buf), bool)
    after[-1] = True
    after[:-1] = white[1:]
    end = np.flatnonzero(~white & (after | first[1:])) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def counts_of(row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many entries each of n rows has, and where they start, given the sorted rows."""
    count = np.bincount(row, minlength=n)
    return count, np.concatenate(([0], np.cumsum(count)))


def shingle_sets(buf: np.ndarray, offs: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles, and n + 1 offsets into them.

    A-Z are lower-cased. A text of fewer words than ``width`` has its whole sequence as one
    shingle; one without words has none.
    """
    n = len(offs) - 1
    low = LOWER[buf]
    start, end, row = words(buf, offs)
    h = span_hashes(prefix_sums(low), start, end)
    count, at = counts_of(row, n)
    m = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    out_at = np.concatenate(([0], np.cumsum(m)))
    rows = np.repeat(np.arange(n), m)
    pos = np.arange(out_at[-1]) - out_at[rows] + at[rows]
    size = np.minimum(count[rows], width)
    value = mix(size.astype(U64) + U64(0xA5A5))
    for k in range(width):
        use = size > k
        nxt = h[np.minimum(pos + k, max(len(h) - 1, 0))] if len(h) else h
        value = np.where(use, mix(value * U64(_B) + nxt), value)
    for i in range(n):
        value[out_at[i] : out_at[i + 1]].sort()
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    new[out_at[:-1][m > 0]] = True
    kept = np.concatenate(([0], np.cumsum(new)))[out_at]
    return value[new], kept


def lists(values: np.ndarray, offs: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(values.view(np.int64)))
