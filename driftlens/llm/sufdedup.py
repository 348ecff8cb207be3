"""Removal of repeated 400-byte strings by column-wise multi-document suffix sorting.

A string of LENGTH bytes has an anchor: its GRAM-byte piece of least hash, the leftmost of
equals. Equal strings have equal anchors at equal places, so all equal strings meet in windows
around equal anchors: from LENGTH - GRAM bytes before to LENGTH after the anchor's start. The
windows of an anchor, laid one under another by the anchor, are a document collection. Its
suffixes are sorted column by column from the right: each round inserts one symbol of every
window, the collection's Burrows-Wheeler segment of that round gives the next order (LF
mapping), and common prefixes follow by range minima. A task holds one group of windows, of
bounded size, and the order and prefixes of the last round. As equal strings stand in
the same column, each column's order is all that is looked at, and no merge of columns is needed.

A start whose suffix has LENGTH bytes in common with a neighbour in the order is repeated.

Passages of over 50 words that another text holds too are found in the same way, with words for
bytes and strings of 51 of them; there, equal suffixes count if they stand in two texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.textkernel import U64, mix, powers, prefix_sums, span_hashes, steps, words
from driftlens.llm.workspace import Workspace

LENGTH = 400
GRAM = 200


@dataclass(frozen=True)
class Strings:
    """What is looked for: strings of ``length`` symbols of ``unit`` bytes, with anchors of ``gram`` symbols."""

    name: str
    length: int
    gram: int
    unit: int = 1  # 1: bytes of the text; 8: 63-bit hashes of its words
    across: bool = False  # strings of two texts only, else also those that are twice in one

    @property
    def side(self) -> int:
        return self.length - self.gram


BYTES = Strings("bytes", LENGTH, GRAM)
PASSAGES = Strings("passages", 51, 26, unit=8, across=True)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: An anchor with more different windows than this is split by longer common pieces.
MOST_WINDOWS = 20_000
#: Parts that an anchor's windows are dealt out in while it is not known how many there are.
PARTS = 64
#: Windows sorted together.
COLLECTION = 20_000
_PART = 1 << 21
_PLACE = U64((1 << 22) - 1)


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """Index of the least of each ``width`` consecutive hashes, the leftmost of equals (of the upper 42 bits)."""
    out = []
    for c in range(0, len(h) - width + 1, _PART):
        part = h[c : c + _PART + width - 1]
        value = (part & ~_PLACE) | np.arange(len(part), dtype=U64)
        blocks = np.full(-(-len(value) // width) * width, ~U64(0), U64)
        blocks[: len(value)] = value
        blocks = blocks.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(value) - width + 1
        out.append((np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & _PLACE).astype(np.int64) + c)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def symbols(batch: pa.RecordBatch, what: Strings) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, symbols, offsets of the texts) of parts of a batch."""
    for a, _, buf, offs in steps(batch):
        if what.unit == 1:
            yield a, buf, offs
        else:
            start, end, row = words(buf, offs)
            yield a, span_hashes(prefix_sums(buf), start, end) >> U64(1), np.searchsorted(row, np.arange(len(offs)))


def anchors(buf: np.ndarray, offs: np.ndarray, what: Strings = BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position, hash and row of the anchors of all strings of ``what.length`` symbols inside a text."""
    none = np.zeros(0, np.int64)
    if len(buf) < what.length:
        return none, none.astype(U64), none
    s = prefix_sums(buf)
    _, inverse = powers(len(s))
    h = mix((s[what.gram :] - s[: -what.gram]) * inverse[: len(s) - what.gram])
    least = sliding_least(h, what.side + 1)
    size = np.diff(offs)
    inside = np.repeat(offs[1:], size)[: len(least)] - np.arange(len(least)) >= what.length
    at = least[inside]
    at = at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at
    return at, h[at], np.searchsorted(offs, at, "right") - 1


def window(start: int, end: int, at: int, what: Strings = BYTES) -> tuple[int, int]:
    """Bounds of the window of the anchor ``at`` in the text from ``start`` to ``end``."""
    return max(start, at - what.side), min(end, at + what.length)


def _keys(what: Strings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, buf, offs in symbols(batch, what):
                _, key, row = anchors(buf, offs, what)
                if what.across and len(key):  # once for each text, so that the count is one of texts
                    order = np.lexsort((key, row))
                    key, row = key[order], row[order]
                    key = key[np.concatenate(([True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])))]
                if len(key):
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["key"])

    return run


def _occurrences(what: Strings):
    """Each anchor with its text's key, its place in the text, and a 128-bit digest of its window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, buf, offs in symbols(batch, what):
                at, key, row = anchors(buf, offs, what)
                if not len(at):
                    continue
                if what.unit == 1:
                    data, digests = buf.tobytes(), bytearray()
                    for p, r in zip(at.tolist(), row.tolist()):
                        lo, hi = window(int(offs[r]), int(offs[r + 1]), p, what)
                        digests += hashlib.blake2b(data[lo:hi], digest_size=16, salt=(p - lo).to_bytes(8, "little")).digest()
                    w = np.frombuffer(bytes(digests), np.int64).reshape(-1, 2)
                else:  # the symbols are hashes already: two sums of them over each window
                    lo, hi = np.maximum(offs[row], at - what.side), np.minimum(offs[row + 1], at + what.length)
                    w = np.stack([mix(span_hashes(prefix_sums(x), lo, hi) + (at - lo).astype(U64)) for x in (buf, mix(buf))], axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + a)), pa.array(at - offs[row]), pa.array(key.view(np.int64)), pa.array(np.ascontiguousarray(w[:, 0])), pa.array(np.ascontiguousarray(w[:, 1]))], names=["k", "at", "key", "w1", "w2"])

    return run


def _contents(what: Strings):
    """The windows that a text represents, from (text, [(at, key, w1, w2, low, high)])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in _CONTENT_TYPES]
            for a, buf, offs in symbols(batch, what):
                data, unit = buf.tobytes(), what.unit
                for r, (start, end) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
                    for x in batch.column(1)[a + r].as_py():
                        lo, hi = window(start, end, start + x["at"], what)
                        for c, v in zip(columns, (x["key"], x["w1"], x["w2"], start + x["at"] - lo, data[lo * unit : hi * unit], x["low"], x["high"])):
                            c.append(v)
                    if len(columns[0]) >= 4096:
                        yield _content_batch(columns)
                        columns = [[] for _ in _CONTENT_TYPES]
            if columns[0]:
                yield _content_batch(columns)

    return run


#: A window's anchor, digest, symbols before the anchor, symbols, and the least and greatest text that have it.
CONTENT = "key bigint, w1 bigint, w2 bigint, left int, bytes binary, low bigint, high bigint"
_CONTENT_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
_COLUMNS = ["key", "w1", "w2", "left", "bytes", "low", "high"]


def _content_batch(columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _CONTENT_TYPES)], names=_COLUMNS)


def range_minima(lcp: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(lcp[low..high]) for each pair, low <= high, by a table of powers of two."""
    levels = [lcp]
    while 2 << (len(levels) - 1) <= len(lcp):
        last, half = levels[-1], 1 << (len(levels) - 1)
        nxt = last.copy()
        np.minimum(last[:-half], last[half:], out=nxt[:-half])
        levels.append(nxt)
    table = np.stack(levels)
    k = np.log2(high - low + 1).astype(np.int64)
    return np.minimum(table[k, low], table[k, high - (1 << k) + 1])


def _columns(windows: list[bytes], left: list[int], what: Strings) -> tuple[np.ndarray, int]:
    """The windows' symbols by columns, and the symbol beyond a window's end, which is equal to nothing."""
    if what.unit == 1:
        rows, none = [np.frombuffer(data, np.uint8) for data in windows], 256
    else:
        known, rank = np.unique(np.frombuffer(b"".join(windows), U64), return_inverse=True)
        rows, none = np.split(rank, np.cumsum([len(data) // what.unit for data in windows])[:-1]), len(known)
    table = np.full((len(windows), what.side + what.length), none, np.uint16 if none < 1 << 16 else np.uint32)
    for i, (data, a) in enumerate(zip(rows, left)):
        table[i, what.side - a : what.side - a + len(data)] = data
    return np.ascontiguousarray(table.T), none


def repeated_starts(windows: list[bytes], left: list[int], what: Strings = BYTES, low: np.ndarray | None = None, high: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First and last column whose string of ``what.length`` another window has too, for each window; -1 if none.

    Column ``what.side`` is the anchor's first symbol. Rounds go from the last column to the first.
    With ``what.across``, the windows that have the string must come from two texts; ``low`` and
    ``high`` are the least and the greatest text of each.
    """
    n = len(windows)
    first, last = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    if n < 2:
        return first, last
    columns, none = _columns(windows, left, what)
    order, lcp = np.arange(n), np.zeros(n, np.uint16)
    for c in range(len(columns) - 1, -1, -1):
        segment = columns[c][order]  # this round's part of the transform
        step = np.argsort(segment, kind="stable")
        symbol = segment[step]
        new = np.zeros(n, np.uint16)
        same = np.flatnonzero((symbol[1:] == symbol[:-1]) & (symbol[1:] != none)) + 1
        if len(same):
            new[same] = np.minimum(range_minima(lcp, step[same - 1] + 1, step[same]) + np.uint16(1), np.uint16(what.length))
        order, lcp = order[step], new
        if c <= what.side:
            full = np.flatnonzero(lcp >= what.length)
            if len(full):
                if what.across:
                    run = np.flatnonzero(lcp < what.length)  # starts of the runs of windows with one string
                    size = np.diff(np.append(run, n))
                    texts = np.minimum.reduceat(low[order], run) != np.maximum.reduceat(high[order], run)
                    hit = order[np.repeat(texts & (size > 1), size)]
                else:
                    hit = order[np.unique(np.concatenate((full, full - 1)))]
                first[hit] = c
                last[hit] = np.where(last[hit] < 0, c, last[hit])
    return first, last


SPANS = "key bigint, w1 bigint, w2 bigint, lo int, hi int"


def _sort_collections(what: Strings):
    """Repeated part of each window (lo, hi from the anchor) of whole groups, which arrive one after another."""

    def solve(rows: list[tuple]) -> pa.RecordBatch | None:
        rows = list({r[1:4]: r for r in rows}.values())  # a window of two groups is one document, not a repeat of itself
        texts = [np.array([r[j] for r in rows], np.int64) for j in (6, 7)] if what.across else []
        first, last = repeated_starts([r[5] for r in rows], [r[4] for r in rows], what, *texts)
        hit = np.flatnonzero(first >= 0)
        if not len(hit):
            return None
        keys = [pa.array([rows[i][j] for i in hit], pa.int64()) for j in (1, 2, 3)]
        return pa.RecordBatch.from_arrays([*keys, pa.array((first[hit] - what.side).astype(np.int32)), pa.array((last[hit] + what.length - what.side).astype(np.int32))], names=["key", "w1", "w2", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held.extend(zip(*(c.to_pylist() for c in batch.columns)))
            if len(held) >= COLLECTION:
                cut = len(held)
                while cut and held[cut - 1][0] == held[-1][0]:
                    cut -= 1
                if cut and (out := solve(held[:cut])):
                    yield out
                held = held[cut:]
        if held and (out := solve(held)):
            yield out

    return run


def _longer_keys(extra: int, what: Strings):
    """Two rows for each window: the common piece longer by ``extra`` symbols to the left, and to the right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = what.unit
        for batch in batches:
            out = []
            for group, key, w1, w2, left, data, low, high, lo, hi in zip(*(c.to_pylist() for c in batch.columns)):
                for x, y in ((lo - extra, hi), (lo, hi + extra)):
                    if left + x >= 0 and (left + y) * unit <= len(data):
                        piece = hashlib.blake2b(data[(left + x) * unit : (left + y) * unit], digest_size=8, salt=(x + what.length).to_bytes(8, "little")).digest()
                        out.append((int.from_bytes(piece, "little", signed=True), key, w1, w2, left, data, low, high, x, y))
            if out:
                types = (pa.int64(), *_CONTENT_TYPES, pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["grp", *_COLUMNS, "lo", "hi"])

    return run


def repeated_spans(contents: DataFrame, space: Workspace, most_windows: int = MOST_WINDOWS, what: Strings = BYTES) -> DataFrame:
    """(key, w1, w2, lo, hi): the repeated part of each different window, from the anchor's start.

    A group of more than ``most_windows`` windows is dealt into groups with a longer common
    piece: a common string of ``what.length`` reaches half of what is missing beyond the piece on
    one side at least, so windows with such a string still meet. At ``what.length`` the
    piece is the string.
    """
    now = contents.select(F.col("key").alias("grp"), *_COLUMNS, F.lit(0).alias("lo"), F.lit(what.gram).alias("hi"))
    ready, same, piece, k = None, None, what.gram, 0
    while True:
        size = now.groupBy("grp").agg(F.count("*").alias("size"), F.min("low").alias("least"), F.max("high").alias("most")).where(F.col("size") > 1)
        size = space.keep((size.where(F.col("least") != F.col("most")) if what.across else size).select("grp", "size"), f"{what.name}-sizes{k}")
        if piece >= what.length:
            same = now.join(size, "grp").select("key", "w1", "w2", "lo", "hi")
            break
        few = now.join(size.where(F.col("size") <= most_windows).select("grp"), "grp", "left_semi").select("grp", *_COLUMNS)
        ready = few if ready is None else ready.unionByName(few)
        large = size.where(F.col("size") > most_windows).select("grp")
        if large.isEmpty():
            break
        extra = -(-(what.length - piece) // 2)
        rows = now.join(large, "grp", "left_semi").select("grp", *_COLUMNS, "lo", "hi")
        now = space.keep(rows.mapInArrow(_longer_keys(extra, what), f"grp bigint, {CONTENT}, lo int, hi int").dropDuplicates(["grp", "key", "w1", "w2"]), f"{what.name}-longer{k}")  # two ways may lead to one piece
        piece, k = piece + extra, k + 1
    # The groups of all rounds are sorted in one step. Should two of them have one number, they are sorted together, and as symbols are compared that changes nothing.
    found = ready.repartition("grp").sortWithinPartitions("grp").mapInArrow(_sort_collections(what), SPANS)
    return found if same is None else found.unionByName(same)


def _covered(spans: pa.ListArray, size: np.ndarray) -> np.ndarray:
    """How many of its ``size`` words each text's spans cover; the texts are laid one after another."""
    count = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(count)), count)
    s, e = (x.to_numpy(zero_copy_only=False) for x in spans.flatten().flatten())
    base = np.concatenate(([0], np.cumsum(size)))[row]
    s, e = s + base, np.minimum(e, size[row]) + base
    order = np.argsort(s, kind="stable")
    reach = np.maximum.accumulate(e[order])
    new = np.maximum(0, reach - np.maximum(s[order], np.concatenate(([0], reach))[:-1]))
    return np.bincount(row[order], new, len(count)).astype(np.int64)


def _cut(with_bytes: bool, id_col: str):
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "has_repeat", "n_shared_words"] + ["kept"] * with_bytes

    def merged(spans: list[dict] | None) -> list[list[int]]:
        out: list[list[int]] = []
        for x in sorted((s["s"], s["e"]) for s in spans or []):
            if out and x[0] <= out[-1][1]:
                out[-1][1] = max(out[-1][1], x[1])
            else:
                out.append([*x])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, n_words = [], np.zeros(batch.num_rows, np.int64)
            for i, (text, spans, passages) in enumerate(zip(*(batch.column(i) for i in (1, 2, 3)))):
                data, kept, at, removed, n = (text.as_py() or "").encode(), [], 0, 0, 0
                for s, e in merged(spans.as_py()):
                    kept.append(data[at:s])
                    removed, n, at = removed + e - s, n + 1, e
                kept.append(data[at:])
                left = b"".join(kept)
                if passages.is_valid:
                    n_words[i] = len(_WORD.findall(data))
                rows.append((len(data), removed, n, hashlib.sha256(left).hexdigest(), n > 0, left))
            if rows:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                columns.insert(5, pa.array(_covered(batch.column(3), n_words)))
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns[: len(names) - 1]], names=names)

    return run


def repeats(texts: DataFrame, space: Workspace, what: Strings, most_windows: int) -> DataFrame:
    """(k, spans): the repeated parts of each text, as places of symbols from s to e; e may lie beyond the text's end."""
    label = lambda x: f"{what.name}-{x}"
    texts = texts.where(F.octet_length("text") >= (what.length if what.unit == 1 else 2 * what.length - 1))
    shared = space.keep(texts.mapInArrow(_keys(what), "key bigint").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("key"), label("shared"))
    found = texts.mapInArrow(_occurrences(what), "k struct<k1:bigint,k2:bigint>, at bigint, key bigint, w1 bigint, w2 bigint")
    found = space.keep(found.join(shared, "key", "left_semi").select("k", "at", "key", "w1", "w2"), label("occurrences"))
    windows = found.groupBy("key", "w1", "w2").agg(F.count("*").alias("n"), F.min(F.struct("k", "at")).alias("of"), F.min("k.k1").alias("low"), F.max("k.k1").alias("high"))
    windows = space.keep(windows, label("windows"))
    # an anchor of very many windows is dealt out in PARTS parts
    parted = windows.withColumn("part", F.pmod("w1", F.lit(PARTS)))
    several = parted.groupBy("key", "part").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.collect_list("part").alias("parts")).where(F.col("n") > 1).select("key", F.explode("parts").alias("part"))
    wanted = parted.join(several, ["key", "part"], "left_semi").groupBy("of.k").agg(F.collect_list(F.struct(F.col("of.at").alias("at"), "key", "w1", "w2", "low", "high")).alias("wanted"))
    wanted = space.keep(wanted, label("wanted"))
    contents = space.keep(texts.join(wanted, "k").select("text", "wanted").mapInArrow(_contents(what), CONTENT).dropDuplicates(["key", "w1", "w2"]), label("contents"))
    sorted_spans = repeated_spans(contents, space, most_windows, what)
    # a window that occurs twice is repeated as a whole; its bounds are those of its text, so it reaches to them
    twice = windows.where(F.col("low") != F.col("high") if what.across else F.col("n") > 1).select("key", "w1", "w2", F.lit(-what.side).alias("lo"), F.lit(what.length).alias("hi"))
    spans = sorted_spans.unionByName(twice).groupBy("key", "w1", "w2").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    spans = space.keep(spans, label("spans"))
    by_text = found.join(spans, ["key", "w1", "w2"]).select("k", F.greatest(F.lit(0).cast("long"), F.col("at") + F.col("lo")).alias("s"), (F.col("at") + F.col("hi")).alias("e"))
    by_text = space.keep(by_text.groupBy("k").agg(F.collect_set(F.struct("s", "e")).alias("spans")), f"repeats_{what.name}")
    space.drop_like(label(""))
    return by_text


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """Remove each byte covered by a string of LENGTH bytes that starts anywhere else too.

    Returns the id, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs),
    ``kept_sha256`` (of the remaining bytes), ``has_repeat`` (whether any byte is removed),
    ``n_shared_words`` (words in passages of over 50 words, white space apart, that another row has
    too; these may have fewer than LENGTH bytes and are not removed) and, if
    asked for, ``kept`` (the remaining bytes). Texts are
    UTF-8 bytes; null and empty ones have none. Strings never cross texts and are judged on the
    input. Rows that repeat are texts of their own, so each is a repeat of the other. Ids may
    repeat or be null. Other columns are not looked at.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "sufdedup")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    keyed = docs.withColumn("k", F.struct(F.xxhash64("id", "text").alias("k1"), F.xxhash64(F.lit("second"), "text", "id").alias("k2")))
    texts = keyed.where(F.col("text").isNotNull()).select("k", "text")
    removed = repeats(texts, space, BYTES, most_windows)
    passages = repeats(texts, space, PASSAGES, most_windows).withColumnRenamed("spans", "passages")
    size = F.octet_length("text").cast("long")
    joined = keyed.join(removed, "k", "left").join(passages, "k", "left")
    joined = joined.select("id", "text", F.transform("spans", lambda x: F.struct(x["s"].alias("s"), F.least(x["e"], size).alias("e"))).alias("spans"), "passages")
    id_type = docs.schema["id"].dataType.simpleString()
    return joined.mapInArrow(_cut(with_bytes, id_col), f"`{id_col}` {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, has_repeat boolean, n_shared_words bigint" + ", kept binary" * with_bytes)
