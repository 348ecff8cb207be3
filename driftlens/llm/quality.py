"""Quality rules: base rules and a calibrated logistic regression on hashed n-grams.

Features are word 1- and 2-grams and character (byte) 3- and 5-grams, hashed, as shares of
their text times SCALE. The fit reads a bounded sample of labelled rows; scoring reads every
whole text in Arrow batches and compares the calibrated probability with a fixed threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.textkernel import U64, WHITE, mix, prefix_sums, span_hashes, steps, words

BITS = 18
SCALE = 30.0
#: A text is kept if its calibrated probability of good quality is at least this.
THRESHOLD = 0.5
#: Base rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
SYMBOL = np.zeros(256, bool)
SYMBOL[list(SYMBOLS.encode())] = True
RESULT = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, probability double, kept boolean"


@dataclass
class QualityModel:
    """word and char: 2**BITS weights each; bias; calibration slope and offset."""

    word: np.ndarray
    char: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    offset: float = 0.0


def per_row(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return total[offs[1:]] - total[offs[:-1]]


def base_counts(buf: np.ndarray, offs: np.ndarray, sums: np.ndarray, spans: tuple[np.ndarray, np.ndarray, np.ndarray], h: np.ndarray) -> dict[str, np.ndarray]:
    """The five counts of each text; see ``score_documents``."""
    n = len(offs) - 1
    start, end, row = spans
    out = {"n_words": np.bincount(row, minlength=n)}
    solid = ~WHITE[buf]
    out["word_chars"] = per_row(solid & ((buf & 0xC0) != 0x80), offs)
    out["n_symbols"] = per_row(SYMBOL[buf], offs)
    breaks = np.flatnonzero(buf == 10)
    filled = offs[:-1][np.diff(offs) > 0]
    line_start = np.unique(np.concatenate((filled, breaks + 1)))
    line_start = line_start[line_start < len(buf)]
    line_row = np.searchsorted(offs, line_start, "right") - 1
    next_break = np.append(breaks, len(buf))[np.searchsorted(breaks, line_start)]
    line_end = np.minimum(next_break, offs[line_row + 1])
    seen = np.concatenate(([0], np.cumsum(solid)))
    has_word = seen[line_end] > seen[line_start]
    line_start, line_end, line_row = line_start[has_word], line_end[has_word], line_row[has_word]
    keyed = mix(span_hashes(sums, line_start, line_end) ^ mix(line_row.astype(U64)))
    _, first = np.unique(keyed, return_index=True)
    out["n_dup_lines"] = np.bincount(line_row, minlength=n) - np.bincount(line_row[first], minlength=n)
    repeated = np.zeros(len(h), bool)
    if len(h) >= 3:
        same = row[2:] == row[:-2]
        at = np.flatnonzero(same)
        window = mix(mix(mix(h[at] ^ mix(row[at].astype(U64))) + h[at + 1]) + h[at + 2])
        _, back, count = np.unique(window, return_inverse=True, return_counts=True)
        again = at[count[back] > 1]
        for k in range(3):
            repeated[again + k] = True
    out["n_repeat_words"] = np.bincount(row[repeated], minlength=n)
    return out


def word_slots(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed word 1- and 2-grams: slots and rows."""
    pair = np.flatnonzero(row[1:] == row[:-1]) if len(row) > 1 else np.zeros(0, np.int64)
    two = mix(h[pair] + U64(0x9E3779B97F4A7C15)) + h[pair + 1]
    return (mix(np.concatenate((h, two))) >> U64(64 - BITS)).astype(np.int64), np.concatenate((row, row[pair]))


def char_slots(buf: np.ndarray, order: int) -> np.ndarray:
    """Hashed byte n-gram starting at each position; the last ones of a text run past its end."""
    wide = np.zeros(len(buf) + order, U64)
    wide[: len(buf)] = buf
    code = np.zeros(len(buf), U64)
    for k in range(order):
        code = (code << U64(8)) | wide[k : k + len(buf)]
    return (((code + U64(order)) * U64(0x9E3779B97F4A7C15)) >> U64(64 - BITS)).astype(np.int64)


def char_parts(buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: slots, and which positions have a whole n-gram inside their text."""
    left = np.repeat(offs[1:], np.diff(offs)) - np.arange(len(buf))
    for order in (3, 5):
        yield char_slots(buf, order), left >= order


def linear_scores(model: QualityModel, buf: np.ndarray, offs: np.ndarray, row: np.ndarray, h: np.ndarray) -> np.ndarray:
    n = len(offs) - 1
    slots, owner = word_slots(h, row)
    z = np.bincount(owner, model.word[slots], n) / np.maximum(np.bincount(owner, minlength=n), 1)
    total, grams = np.zeros(n), np.zeros(n)
    for slots, whole in char_parts(buf, offs):
        total += per_row(model.char[slots] * whole, offs)
        grams += per_row(whole, offs)
    return SCALE * (z + total / np.maximum(grams, 1)) + model.bias


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset that fit sigmoid(slope * z + offset) to the held-back labels (Newton steps)."""
    a, b = 1.0, 0.0
    x = np.stack([z, np.ones_like(z)], axis=1)
    target = np.where(y > 0, 1 - 1 / (2 + weight[y > 0].sum()), 1 / (2 + weight[y == 0].sum()))
    for _ in range(rounds):
        p = sigmoid(a * z + b)
        grad = x.T @ (weight * (p - target)) + 1e-3 * np.array([a - 1, b])
        hess = (x.T * (weight * p * (1 - p))) @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def train(texts: list[str], y: np.ndarray, weight: np.ndarray, epochs: int = 60, rate: float = 0.1, l2: float = 1e-5) -> QualityModel:
    """Logistic regression by AdaGrad on four fifths of the rows, Platt calibration on the rest.

    ``weight`` is how many labelled rows a sampled row stands for. With one class or no rows
    the model says 1 for every text.
    """
    model = QualityModel(np.zeros(1 << BITS), np.zeros(1 << BITS))
    if len(set(y.tolist())) < 2 or len(y) < 10:
        return QualityModel(model.word, model.char, bias=40.0)
    n = len(texts)
    slots, values = [], []
    for text in texts:  # one text at a time: only its distinct features are held
        buf = np.frombuffer(text.encode(), np.uint8)
        start, end, row = words(buf, np.array([0, len(buf)]))
        word, count = np.unique(word_slots(span_hashes(prefix_sums(buf), start, end), row)[0], return_counts=True)
        char, char_count = np.unique(np.concatenate([c[whole] for c, whole in char_parts(buf, np.array([0, len(buf)]))]), return_counts=True)
        slots.append(np.concatenate((word, char + (1 << BITS))).astype(np.int32))
        values.append(np.concatenate((SCALE * count / max(count.sum(), 1), SCALE * char_count / max(char_count.sum(), 1))).astype(np.float32))
    owner = np.repeat(np.arange(n, dtype=np.int32), [len(x) for x in slots])
    slot, value = np.concatenate(slots), np.concatenate(values)
    del slots, values
    fold = np.arange(n) % 5 == 4
    balance = np.where(y > 0, 0.5 / max((y[~fold] > 0).sum(), 1), 0.5 / max((y[~fold] == 0).sum(), 1)) * ~fold  # classes weigh alike
    w, g2, bias, b2 = np.zeros(2 << BITS), np.full(2 << BITS, 1e-10), 0.0, 1e-10
    for _ in range(epochs):
        d = balance * (sigmoid(np.bincount(owner, w[slot] * value, n) + bias) - y)
        grad = np.bincount(slot, d[owner] * value, 2 << BITS) + l2 * w
        g2 += grad * grad
        w -= rate * grad / np.sqrt(g2)
        b2 += d.sum() ** 2
        bias -= rate * d.sum() / np.sqrt(b2)
    z = np.bincount(owner, w[slot] * value, n) + bias
    slope, offset = platt(z[fold], y[fold], weight[fold] / weight[fold].mean())
    return QualityModel(w[: 1 << BITS], w[1 << BITS :], bias, slope, offset)


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int, max_chars: int) -> DataFrame:
    """About ``per_class`` labelled rows of each class, at most twice as many in all classes together.

    Labels are drawn by a hash of the id; the drawn ids, bounded by ``per_class``, are broadcast
    to the documents, so no text is dealt out.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    chance = F.lit(0.0)
    for k, n in counts.items():
        chance = F.when(F.col("quality") == k, F.lit(min(1.0, per_class / n))).otherwise(chance)
    draw = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = known.where(draw < chance).withColumn("stands_for", F.try_divide(F.lit(1.0), chance)).limit(4 * per_class)
    texts = docs.where(F.col("text").isNotNull() & (F.char_length("text") <= max_chars)).select("doc_id", "text")
    return texts.join(F.broadcast(drawn), "doc_id").limit(4 * per_class)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 800, max_chars: int = 20_000) -> QualityModel:
    """Train on ``training_sample``, whose size the two parameters bound."""
    rows = sorted((r["doc_id"], r["text"], r["quality"], r["stands_for"]) for r in training_sample(docs, labels, per_class, max_chars).collect())
    return train([r[1] for r in rows], np.array([r[2] for r in rows], float), np.array([r[3] for r in rows], float))


def score_documents(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, the calibrated probability of good quality, and the verdict of every text.

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols``, ``n_dup_lines`` (lines
    with a word, equal to an earlier line), ``n_repeat_words`` (words in three-word windows
    found at least twice), ``base_failed``, ``probability``, ``kept``. A null or empty text has
    no words, so it fails the base rules. Rows that repeat an id are scored each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two arrays of 2**BITS weights
    id_type = docs.schema[id_col].dataType.simpleString()
    names = [id_col] + [x.split()[0] for x in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a, b, buf, offs in steps(batch.select(["text"])):
                spans = words(buf, offs)
                sums = prefix_sums(buf)
                h = span_hashes(sums, spans[0], spans[1])
                base = base_counts(buf, offs, sums, spans, h)
                p = sigmoid(m.slope * linear_scores(m, buf, offs, spans[2], h) + m.offset)
                failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"])
                counts = [pa.array(base[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *counts, pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))], names=names)

    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {id_type}, {RESULT}")
