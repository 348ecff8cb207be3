"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

A document is contaminated by an item if, from some start on, its normalised text is within ``floor(max_edit * n)`` edits of the item's n bytes. Starts are the characters after a space,
another ASCII character that is no letter or digit, or a character outside ASCII, so items inside
unspaced text or after ``Question:`` are seen. Item-sized windows at starts are embedded by the CGK random walk, which maps edit distance to Hamming distance; sampled
coordinates of the embedding are the LSH keys, drawn anew ``repeats`` times so that the
target recall is reached; colliding pairs are verified exactly.

Windows that cannot be within the distance are left out before the walk by the q-gram lemma:
an item of n bytes shares at least n - q + 1 - k * q of its q-grams with a text within k
edits. That test loses nothing. For items so short that the lemma asks for no q-gram (under 9
bytes, and a few lengths up to 26) there is an exact way instead: of k + 1 pieces of an item
one is untouched by k edits, so it stands in the text at most k bytes from its place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from driftlens.llm.textkernel import LOWER, U64, WHITE, mix, prefix_sums, span_hashes, steps

Q = 9
GRAM_BITS = 21
#: Edits allowed, as a share of the item's bytes.
MAX_EDIT = 0.08
#: LSH: sampled coordinates in a key, and independent walks.
SAMPLES = 4
REPEATS = 12
#: Windows of one class that are embedded together, and their bytes.
WINDOWS = 20_000
WINDOW_BYTES = 4 << 20
#: Bytes after which a window may start: all but ASCII letters and digits.
BREAK = np.ones(256, bool)
BREAK[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = False
#: Bytes of items in one index; more items are taken in blocks of this size.
BLOCK_BYTES = 8 << 20
RESULT = "item_id bigint, position bigint, n_edits int"


def normalised(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A-Z lower-cased, every run of ASCII white space one space."""
    if not len(buf):
        return buf, offs
    white = WHITE[buf]
    keep = np.ones(len(buf), bool)
    keep[1:] = ~(white[1:] & white[:-1])
    keep[offs[:-1][np.diff(offs) > 0]] = True
    low = LOWER[buf]
    low[white] = 32
    return low[keep], np.concatenate(([0], np.cumsum(keep)))[offs]


def normalised_text(text: str | None) -> bytes:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return normalised(data, np.array([0, len(data)]))[0].tobytes().strip()


def grams(buf: np.ndarray) -> np.ndarray:
    """Hash of the Q = 9 bytes from each position on (zeros after the end)."""
    wide = np.zeros(len(buf) + Q, np.uint8)
    wide[: len(buf)] = buf
    two = wide[:-1].astype(np.uint16) | wide[1:].astype(np.uint16) << np.uint16(8)
    four = two[:-2].astype(np.uint32) | two[2:].astype(np.uint32) << np.uint32(16)
    code = four[:-4].astype(U64) | four[4:].astype(U64) << U64(32)
    code = code[: len(buf)] * U64(0x9E3779B97F4A7C15)
    code += wide[8 : 8 + len(buf)]
    code *= U64(0xD6E8FEB86659FD93)
    return (code >> U64(64 - GRAM_BITS)).astype(np.int64)


def allowed(n: int, max_edit: float) -> int:
    """Edits for an item of n bytes."""
    return int(max_edit * n)


def is_short(n: int, max_edit: float) -> bool:
    """Whether the edits allowed may leave no whole q-gram."""
    return n - Q + 1 - allowed(n, max_edit) * Q < 1


def within(item: bytes, text: bytes, k: int) -> int | None:
    """Smallest edit distance of ``item`` to a prefix of ``text`` if it is at most k.

    If the item's head is already further than k from every prefix, so is the item.
    """
    if text.startswith(item):
        return 0
    head = max(48, 2 * k + 16)
    if len(item) > head and distance(item[:head], text, k) > k:
        return None
    best = distance(item, text, k)
    return best if best <= k else None


def distance(item: bytes, text: bytes, k: int) -> int:
    """Smallest edit distance of ``item`` to a prefix of ``text`` of up to k more bytes (Myers' bit vectors)."""
    m = len(item)
    peq: dict[int, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in text[: m + k]:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1 | 1) & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best = score
    return best


@dataclass
class ShortClass:
    """Short items of one length: their pieces are looked up at every start."""

    length: int
    edits: int
    items: list[tuple[int, bytes]]
    pieces: list[tuple[int, int, np.ndarray, np.ndarray]] = field(default_factory=list)  # offset, length, sorted hashes, their items

    def __post_init__(self):
        cuts = [self.length * j // (self.edits + 1) for j in range(self.edits + 2)]
        for a, b in zip(cuts, cuts[1:]):
            hashes = np.array([int(span_hashes(prefix_sums(np.frombuffer(t[a:b], np.uint8)), np.array([0]), np.array([b - a]))[0]) for _, t in self.items], U64)
            order = np.argsort(hashes, kind="stable")
            self.pieces.append((a, b - a, hashes[order], order))

    def hits(self, buf: np.ndarray, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(place among ``begin``, item, edits) of the starts where an item stands."""
        found = []
        for offset, size, hashes, owners in self.pieces:
            for shift in range(-self.edits, self.edits + 1):
                at = begin + (offset + shift)
                fits = np.flatnonzero((at >= begin) & (at + size <= end))
                h = span_hashes(sums, at[fits], at[fits] + size)
                low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
                for k in np.flatnonzero(high > low).tolist():
                    found += [(int(fits[k]), int(owners[j])) for j in range(low[k], high[k])]
        for place, own in sorted(set(found)):
            item, text = self.items[own]
            edits = within(text, buf[begin[place] : min(begin[place] + self.length + self.edits, end[place])].tobytes(), self.edits)
            if edits is not None:
                yield place, item, edits


@dataclass
class LengthClass:
    """Items of similar length: they share window width, q-gram threshold and sampled coordinates."""

    items: list[int]
    width: int
    need: int
    coordinates: np.ndarray  # REPEATS x SAMPLES, sorted
    keys: list[np.ndarray] = field(default_factory=list)  # for each repeat: sorted keys
    owners: list[np.ndarray] = field(default_factory=list)  # and the items they are of


class ItemIndex:
    """Index of a block of benchmark items; its size is bounded by BLOCK_BYTES."""

    def __init__(self, items: list[tuple[int, bytes]], max_edit: float = MAX_EDIT, samples: int = SAMPLES, repeats: int = REPEATS, seed: int = 11):
        self.items = sorted((i, t) for i, t in items if not is_short(len(t), max_edit))
        few: dict[int, list[tuple[int, bytes]]] = {}
        for i, t in sorted(items):
            if t and is_short(len(t), max_edit):
                few.setdefault(len(t), []).append((i, t))
        self.short = [ShortClass(n, allowed(n, max_edit), own) for n, own in sorted(few.items())]
        self.edits = [allowed(len(t), max_edit) for _, t in self.items]
        self.repeats = repeats
        #: for each gram, a bit for each (folded) class that has it
        self.known = np.zeros(1 << GRAM_BITS, np.uint32)
        rng = np.random.default_rng(seed)
        self.seed = int(rng.integers(1, 1 << 62))
        self.weights = rng.integers(1, 1 << 62, samples).astype(U64) | U64(1)
        by_length: dict[int, list[int]] = {}
        for k, (_, text) in enumerate(self.items):
            by_length.setdefault(int(np.log(len(text)) / np.log(1.15)), []).append(k)
        self.classes = []
        for _, members in sorted(by_length.items()):
            sizes = [len(self.items[k][1]) for k in members]
            need = min(n - Q + 1 - self.edits[k] * Q for n, k in zip(sizes, members))
            width = max(n + self.edits[k] for n, k in zip(sizes, members))
            reach = max(samples, int(0.8 * min(sizes)))
            coordinates = np.sort(np.stack([rng.choice(reach, samples, replace=False) for _ in range(repeats)]), axis=1)
            c = LengthClass(members, width, max(1, need), coordinates)
            for k in members:
                text = self.items[k][1]
                self.known[grams(np.frombuffer(text, np.uint8))[: len(text) - Q + 1]] |= np.uint32(1 << len(self.classes) % 32)
            table = np.zeros((len(members), width), np.uint8)
            for row, k in enumerate(members):
                table[row, : sizes[row]] = np.frombuffer(self.items[k][1], np.uint8)
            for keys in self.embed(table, c):
                order = np.argsort(keys, kind="stable")
                c.keys.append(keys[order])
                c.owners.append(np.array(members)[order])
            self.classes.append(c)

    def advance(self, r: int, j: int) -> np.ndarray:
        """Whether walk r moves on after writing each symbol as coordinates j to j + 255: hashed coins, so that no table grows with the items."""
        coins = np.arange(1 << 16, dtype=U64) + U64((self.seed + (r << 48) + (j << 8)) % (1 << 63))
        return (mix(coins) >> U64(63)).astype(np.int64).reshape(256, 256)

    def embed(self, windows: np.ndarray, c: LengthClass) -> Iterator[np.ndarray]:
        """For each repeat, the key of every window: its CGK symbols at the sampled coordinates."""
        flat = np.ascontiguousarray(windows).ravel()
        base = np.arange(len(windows)) * windows.shape[1]
        for r in range(self.repeats):
            at = base.copy()  # moves on by at most one symbol a coordinate, and there are fewer coordinates than symbols
            key = np.zeros(len(windows), U64)
            take = dict.fromkeys(c.coordinates[r].tolist())
            sample = 0
            for j in range(int(c.coordinates[r][-1]) + 1):
                symbol = flat[at]
                if j in take:
                    key += (symbol.astype(U64) + U64(1)) * self.weights[sample]
                    key *= U64(0x9E3779B97F4A7C15)
                    sample += 1
                if j % 256 == 0:
                    moves = self.advance(r, j)
                at += moves[j % 256][symbol]
            yield key

    def begins(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """All positions where a window may start."""
        first = np.zeros(len(buf) + 1, bool)
        first[offs] = True
        begin = (buf != 32) & ((buf & 0xC0) != 0x80)
        begin[1:] &= BREAK[buf[:-1]] | first[1:-1]
        return np.flatnonzero(begin)

    def short_hits(self, buf: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(row, item id, edits, position in the row) of short items, the best of each row and item."""
        if not self.short:
            return []
        begin, sums, best = self.begins(buf, offs), prefix_sums(buf), {}
        row = np.searchsorted(offs, begin, "right") - 1
        for c in self.short:
            for place, item, edits in c.hits(buf, sums, begin, offs[row + 1]):
                key, value = (int(row[place]), item), (edits, int(begin[place] - offs[row[place]]))
                best[key] = min(best.get(key, value), value)
        return [(*key, *value) for key, value in best.items()]

    def starts(self, buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each class: starts whose window may hold an item by the q-gram lemma, and their rows."""
        if not self.classes:
            return
        bits = self.known.take(grams(buf))
        hit = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(bits != 0, out=hit[1:])
        begin = self.begins(buf, offs)
        widest, least = max(c.width for c in self.classes), min(c.need for c in self.classes)
        begin = begin[hit[np.minimum(begin + widest, len(buf))] - hit[begin] >= least]
        row = np.searchsorted(offs, begin, "right") - 1
        at = np.flatnonzero(bits)
        bits = bits[at]
        for k, c in enumerate(self.classes):
            stop = np.minimum(begin + c.width, offs[row + 1])
            near = np.flatnonzero(hit[stop] - hit[begin] >= c.need)
            own = at[(bits >> np.uint32(k % 32)) & np.uint32(1) > 0]
            fits = near[np.searchsorted(own, stop[near]) - np.searchsorted(own, begin[near]) >= c.need]
            yield k, begin[fits], row[fits]

    def matches(self, k: int, windows: np.ndarray, texts: np.ndarray) -> list[tuple[int, int, int]]:
        """Verified (window, item, edits) of windows of class k, one for each text and item.

        ``texts`` numbers the text of each window. The windows that collide with an item in
        most repeats are verified first; once a text's window holds an item, its others need
        not be looked at for that item.
        """
        c, pairs = self.classes[k], []
        for r, keys in enumerate(self.embed(windows, c)):
            low, high = np.searchsorted(c.keys[r], keys, "left"), np.searchsorted(c.keys[r], keys, "right")
            n = high - low
            w = np.repeat(np.arange(len(keys)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[w]
            pairs.append(w * len(self.items) + c.owners[r][at])
        pair, collisions = np.unique(np.concatenate(pairs), return_counts=True)
        out, done = [], set()
        for p in pair[np.argsort(-collisions, kind="stable")].tolist():
            w, item = divmod(p, len(self.items))
            if (texts[w], item) in done:
                continue
            edits = within(self.items[item][1], windows[w].tobytes(), self.edits[item])
            if edits is not None:
                done.add((texts[w], item))
                out.append((w, item, edits))
        return out


def find_items(docs: DataFrame, index: ItemIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, position, n_edits): every item of the index that a document holds, with one window that shows it."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        arrow_id = None
        waiting: dict[int, list[tuple[object, int, bytes, int]]] = {k: [] for k in range(len(items.classes))}
        seen = 0

        def flush(k: int) -> pa.RecordBatch | None:
            rows, waiting[k] = waiting[k], []
            width = items.classes[k].width
            windows = np.frombuffer(b"".join(x[2] for x in rows), np.uint8).reshape(-1, width)
            found: dict[tuple[object, int], tuple[int, int]] = {}
            for w, item, edits in items.matches(k, windows, np.array([x[3] for x in rows])):
                key = (rows[w][0], item)
                found[key] = min(found.get(key, (1 << 30, 0)), (edits, rows[w][1]))
            if not found:
                return None
            return pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], arrow_id), pa.array([items.items[i][0] for _, i in found], pa.int64()), pa.array([p for _, p in found.values()], pa.int64()), pa.array([e for e, _ in found.values()], pa.int32())], names=[id_col, "item_id", "position", "n_edits"])

        for batch in batches:
            arrow_id = batch.column(0).type
            for a, b, raw, raw_offs in steps(batch.select(["text"])):
                buf, offs = normalised(raw, raw_offs)
                if not len(buf):
                    continue
                ids = batch.column(0).slice(a, b - a)
                if few := items.short_hits(buf, offs):
                    rows, found, edits, places = zip(*few)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(found, pa.int64()), pa.array(places, pa.int64()), pa.array(edits, pa.int32())], names=[id_col, "item_id", "position", "n_edits"])
                for k, begin, row in items.starts(buf, offs):
                    width = items.classes[k].width
                    for s, r in zip(begin.tolist(), row.tolist()):
                        waiting[k].append((ids[r].as_py(), s - int(offs[r]), buf[s : min(s + width, int(offs[r + 1]))].tobytes().ljust(width, b"\0"), seen + r))
                        if len(waiting[k]) >= min(WINDOWS, WINDOW_BYTES // width + 1) and (out := flush(k)):
                            yield out
                seen += b - a
        for k in waiting:
            if waiting[k] and (out := flush(k)):
                yield out

    from pyspark.sql import functions as F

    raw = docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {id_type}, {RESULT}")
    return raw.groupBy(id_col, "item_id").agg(F.min(F.struct("n_edits", "position")).alias("best")).select(id_col, "item_id", F.col("best.position").alias("position"), F.col("best.n_edits").alias("n_edits"))


def contaminated(docs: DataFrame, benchmark: DataFrame, max_edit: float = MAX_EDIT, samples: int = SAMPLES, repeats: int = REPEATS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document and benchmark item that it holds: id, item_id, position (a byte of the normalised text), n_edits.

    Items are read in blocks of at most BLOCK_BYTES (each a broadcast of bounded size, run
    against all documents). Items that are null or, normalised, empty match
    nothing; equal items match each. Null and empty texts hold nothing. Rows that repeat an id
    count as one document. A row without an id is reported under a null id.
    """
    out, block, size = None, [], 0

    def run(block: list[tuple[int, bytes]]) -> DataFrame:
        found = find_items(docs, ItemIndex(block, max_edit, samples, repeats), id_col, text_col)
        return found if out is None else out.unionByName(found)

    for r in benchmark.select("item_id", "text").orderBy("item_id").toLocalIterator():
        text = normalised_text(r["text"])
        if block and size + len(text) > BLOCK_BYTES:
            out, block, size = run(block), [], 0
        if r["item_id"] is not None:
            block.append((r["item_id"], text))
            size += len(text)
    return run(block) if block or out is None else out


def clean_documents(docs: DataFrame, benchmark: DataFrame, max_edit: float = MAX_EDIT) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    bad = contaminated(docs, benchmark, max_edit).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti")
