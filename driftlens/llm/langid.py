"""Language identification by a linear-chain conditional random field over words.

Each word's emission is the sum of learned weights of its affixes and n-grams (of UTF-8 bytes,
hashed, with marks at both ends) and of its lexicon entry; transitions between neighbouring
words' languages are learned too. Marginals come from forward-backward over the whole text,
so a code-switched text has a language for every word; a document's language is the one with
the largest mean marginal.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.llm.textkernel import LOWER, U64, counts_of, prefix_sums, span_hashes, steps

ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 16
BLOCK = 32
#: Bytes of text whose words are labelled together (a longer text is a step of its own).
STEP = 256 << 10
LETTER = np.zeros(256, bool)
LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 0x100)]] = True


@dataclass
class LanguageModel:
    """labels: sorted languages; grams: BUCKETS x L; lexicon: sorted word hashes and L weights each."""

    labels: list[str]
    grams: np.ndarray
    lexicon: np.ndarray
    lexicon_weights: np.ndarray
    transition: np.ndarray


def lowered(buf: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals (in UTF-8) as small letters."""
    low = LOWER[buf]
    if len(low) > 1:
        second = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        low[1:][second] += 0x20
    return low


def letter_words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of ASCII letters and non-ASCII bytes."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    letter = LETTER[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[offs] = True
    before, after = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
    before[1:], after[:-1] = letter[:-1], letter[1:]
    start = np.flatnonzero(letter & (~before | first[:-1]))
    end = np.flatnonzero(letter & (~after | first[1:])) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def word_grams(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every n-gram of each marked word, the word it is of, and the words' gram counts."""
    length = end - start + 2
    at = np.concatenate(([0], np.cumsum(length)))
    word = np.repeat(np.arange(len(start)), length)
    inside = np.arange(at[-1]) - at[word]
    text = np.full(at[-1] + max(ORDERS), 1, np.uint32)
    body = (inside > 0) & (inside < length[word] - 1)
    text[: at[-1]][body] = low[(start[word] + inside - 1)[body]]
    text[: at[-1]][inside == length[word] - 1] = 2
    buckets, owners = [], []
    code = np.zeros(at[-1], np.uint64)
    for n in range(1, max(ORDERS) + 1):
        code = (code << U64(8)) | text[n - 1 : n - 1 + at[-1]].astype(U64)
        fits = inside + n <= length[word]
        if n == 1:
            fits &= body
        h = (code[fits] + U64(n * 0x51ED270B9F652295 & 0xFFFFFFFFFFFFFFFF)) * U64(0x9E3779B97F4A7C15)
        buckets.append((h >> U64(48)).astype(np.int64))
        owners.append(word[fits])
    buckets, owners = np.concatenate(buckets), np.concatenate(owners)
    return buckets, owners, np.maximum(np.bincount(owners, minlength=len(start)), 1)


def sums_by(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(owner, values[:, k], n) for k in range(values.shape[1])], axis=1)


def lexicon_rows(model: LanguageModel, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = np.minimum(np.searchsorted(model.lexicon, h), max(len(model.lexicon) - 1, 0))
    return k, (model.lexicon[k] == h) if len(model.lexicon) else np.zeros(len(h), bool)


def emissions(model: LanguageModel, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Log weights (words x L); each distinct word is worked out once."""
    h = span_hashes(prefix_sums(low), start, end)
    unique, first, back = np.unique(h, return_index=True, return_inverse=True)
    buckets, owners, count = word_grams(low, start[first], end[first])
    e = sums_by(owners, model.grams[buckets], len(unique)) / np.sqrt(count)[:, None]
    k, known = lexicon_rows(model, unique)
    if known.any():
        e[known] += model.lexicon_weights[k[known]]
    return e[back]


def marginals(e: np.ndarray, transition: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Forward-backward marginals (words x L) of n sequences laid one after another.

    Words are cut into blocks: products of step matrices over all blocks at once, vectors
    from block to block within each sequence, then vectors within all blocks at once. This
    is the plain recursion in another order of the same products.
    """
    words, labels = e.shape
    if not words:
        return e
    t = np.exp(transition - transition.max()).astype(np.float32)
    p = (np.exp(e - e.max(axis=1, keepdims=True)) + 1e-12).astype(np.float32)
    count, at = counts_of(row, n)
    blocks = -(-count // BLOCK)
    first = np.concatenate(([0], np.cumsum(blocks)))
    owner = np.repeat(np.arange(n), blocks)
    nth = np.arange(first[-1]) - first[owner]
    index = (at[owner] + nth * BLOCK)[:, None] + np.arange(BLOCK)
    live = index < at[owner + 1][:, None]
    index = np.minimum(index, words - 1)
    q = p[index]
    product = np.broadcast_to(np.eye(labels, dtype=np.float32), (len(owner), labels, labels)).copy()
    for k in range(BLOCK):
        nxt = (product @ t) * q[:, k, None, :]
        nxt /= nxt.sum(axis=(1, 2), keepdims=True)
        product = np.where(live[:, k, None, None], nxt, product)
    into, out = np.full((len(owner), labels), 1.0 / labels, np.float32), np.ones((len(owner), labels), np.float32)
    order = np.argsort(-blocks, kind="stable")
    longest = int(blocks.max())
    sizes = np.searchsorted(-blocks[order], -np.arange(1, longest + 1), "right")
    for j in range(1, longest):
        b = first[order[: sizes[j]]] + j
        v = np.einsum("bi,bij->bj", into[b - 1], product[b - 1])
        into[b] = v / v.sum(axis=1, keepdims=True)
        b = first[order[: sizes[j]] + 1] - 1 - j
        v = np.einsum("bij,bj->bi", product[b + 1], out[b + 1])
        out[b] = v / v.sum(axis=1, keepdims=True)
    alpha = np.empty((len(owner), BLOCK, labels), np.float32)
    v = into
    for k in range(BLOCK):
        nxt = (v @ t) * q[:, k]
        nxt /= nxt.sum(axis=1, keepdims=True)
        v = np.where(live[:, k, None], nxt, v)
        alpha[:, k] = v
    v = out
    for k in range(BLOCK - 1, -1, -1):
        alpha[:, k] *= v
        nxt = (q[:, k] * v) @ t.T
        nxt /= nxt.sum(axis=1, keepdims=True)
        v = np.where(live[:, k, None], nxt, v)
    gamma = alpha[live]
    return gamma / gamma.sum(axis=1, keepdims=True)


def chain_expectations(e: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (B x S x L) and expected transition counts (L x L) of B chains of S words."""
    t, p = np.exp(transition - transition.max()), np.exp(e - e.max(axis=2, keepdims=True)) + 1e-12
    alpha, beta = np.empty_like(p), np.ones_like(p)
    v = np.full(p[:, 0].shape, 1.0 / p.shape[2])
    for k in range(p.shape[1]):
        v = (v @ t) * p[:, k]
        v /= v.sum(axis=1, keepdims=True)
        alpha[:, k] = v
    for k in range(p.shape[1] - 2, -1, -1):
        v = (p[:, k + 1] * beta[:, k + 1]) @ t.T
        beta[:, k] = v / v.sum(axis=1, keepdims=True)
    gamma = alpha * beta
    gamma /= gamma.sum(axis=2, keepdims=True)
    joint = alpha[:, :-1, :, None] * t * (p * beta)[:, 1:, None, :]
    joint /= joint.sum(axis=(2, 3), keepdims=True)
    return gamma, joint.sum(axis=(0, 1))


def train(texts: list[str], langs: list[str], epochs: int = 6, segment: int = 40, lexicon_size: int = 2000, seed: int = 0) -> LanguageModel:
    """Fit the field on labelled texts: the words of a text all have its language.

    Half of the segments are cut and rejoined with the rest of a segment of any language, so
    that switches inside a text are seen.
    """
    labels = sorted(set(langs))
    size, rng = len(labels), np.random.default_rng(seed)
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    (_, _, buf, offs), = list(steps(batch, step_bytes=1 << 62)) or [(0, 0, np.zeros(0, np.uint8), np.zeros(1, np.int64))]
    low = lowered(buf)
    start, end, row = letter_words(buf, offs)
    h = span_hashes(prefix_sums(low), start, end)
    unique, first, back = np.unique(h, return_index=True, return_inverse=True)
    y = np.array([labels.index(x) for x in langs], np.int64)[row] if len(row) else np.zeros(0, np.int64)
    buckets, owners, count = word_grams(low, start[first], end[first])
    per_label = np.stack([np.bincount(back[y == k], minlength=len(unique)) for k in range(size)]) if size else np.zeros((0, len(unique)))
    common = np.unique(np.concatenate([np.argsort(-c, kind="stable")[:lexicon_size][c[np.argsort(-c, kind="stable")[:lexicon_size]] > 1] for c in per_label])) if size else np.zeros(0, np.int64)
    slot = np.full(len(unique), -1, np.int64)
    slot[common] = np.arange(len(common))
    model = LanguageModel(labels, np.zeros((BUCKETS, size), np.float32), unique[common], np.zeros((len(common), size), np.float32), np.zeros((size, size)))
    whole = len(row) // segment * segment
    if not whole or size < 2:
        return model
    seqs = np.arange(whole).reshape(-1, segment)
    seqs = rng.permutation(seqs)
    mixed = seqs.copy()
    half = len(seqs) // 2
    cuts = rng.integers(5, segment - 5, half)
    other = rng.permutation(len(seqs))[:half]
    take = np.arange(segment)[None, :] >= cuts[:, None]
    mixed[:half][take] = seqs[other][take]
    at = np.concatenate(([0], np.cumsum(np.bincount(owners, minlength=len(unique)))))
    order = np.argsort(owners, kind="stable")
    sorted_buckets = buckets[order]
    scale = 1 / np.sqrt(count)
    squares = [np.full_like(model.grams, 1e-6), np.full_like(model.lexicon_weights, 1e-6), np.full_like(model.transition, 1e-6)]
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(mixed), max(1, len(mixed) // 512)):
            ws = back[part.ravel()]
            u, w = np.unique(ws, return_inverse=True)
            n_grams = at[u + 1] - at[u]
            own = np.repeat(np.arange(len(u)), n_grams)
            g = sorted_buckets[np.arange(n_grams.sum()) - np.concatenate(([0], np.cumsum(n_grams)))[own] + at[u][own]]
            e = sums_by(own, model.grams[g], len(u)) * scale[u][:, None]
            lex = slot[u]
            e[lex >= 0] += model.lexicon_weights[lex[lex >= 0]]
            e = e[w]
            gamma, pairs = chain_expectations(e.reshape(*part.shape, size), model.transition)
            gamma = gamma.reshape(-1, size)
            target = y[part.ravel()]
            d = -gamma
            d[np.arange(len(d)), target] += 1
            by_word = sums_by(w, d, len(u))
            grads = [sums_by(g, (by_word * scale[u][:, None])[own], BUCKETS), sums_by(lex[lex >= 0], by_word[lex >= 0], len(common)) if len(common) else squares[1] * 0]
            pair = np.zeros((size, size))
            tt = target.reshape(part.shape)
            np.add.at(pair, (tt[:, :-1].ravel(), tt[:, 1:].ravel()), 1)
            grads.append(pair - pairs)
            for value, grad, square, rate in zip((model.grams, model.lexicon_weights, model.transition), grads, squares, (0.3, 0.3, 0.05)):
                grad = grad / len(part) - 1e-4 * value
                square += grad * grad
                value += (rate * grad / np.sqrt(square)).astype(value.dtype)
    return model


def held_out(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def training_sample(docs: DataFrame, per_language: int = 200, max_chars: int = 20_000) -> DataFrame:
    """About ``per_language`` labelled rows of each language, at most twice as many, chosen by a hash of the id.

    Only rows that are not held out, with text, language and at most ``max_chars`` characters.
    """
    rows = docs.where(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.char_length("text") <= max_chars)).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return rows.limit(0)
    chance = F.lit(0.0)
    for lang, n in counts.items():
        chance = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))).otherwise(chance)
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.where(draw < chance).limit(2 * per_language * len(counts))


def fit(docs: DataFrame, per_language: int = 200, max_chars: int = 20_000) -> LanguageModel:
    """Train on ``training_sample``; its size is bounded by the two parameters."""
    rows = sorted((r["doc_id"], r["lang"], r["text"]) for r in training_sample(docs, per_language, max_chars).collect() if r["doc_id"] is not None)
    return train([r[2] for r in rows], [r[1] for r in rows])


def word_marginals(model: LanguageModel, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    start, end, row = letter_words(buf, offs)
    e = emissions(model, lowered(buf), start, end)
    return start, end, row, marginals(e, model.transition, row, len(offs) - 1)


def _predicted(m: LanguageModel, text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, languages, scores) of parts of a column of texts."""
    for a, b, buf, offs in steps(pa.RecordBatch.from_arrays([text], names=["text"]), step_bytes=STEP):
        n = b - a
        letters = pc.fill_null(pc.match_substring_regex(text.slice(a, n).cast(pa.large_string()), r"\p{L}"), False).to_numpy(zero_copy_only=False)
        lang, score = np.full(n, "und", object), np.zeros(n)
        if m.labels:
            _, _, row, gamma = word_marginals(m, buf, offs)
            count, _ = counts_of(row, n)
            mean = sums_by(row, gamma, n) / np.maximum(count, 1)[:, None]
            best = mean.argmax(axis=1)
            ok = letters & (count > 0)
            lang[ok] = np.array(m.labels, object)[best[ok]]
            score[ok] = np.clip(mean[np.arange(n), best], 0, 1)[ok]
        yield a, b, lang, score


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred`` and ``score`` (the mean marginal of that language, 0 to 1) of every text.

    ``und`` with score 0 if the text is null, empty or has no letter, or if no language was
    learned. Ties go to the language that sorts first. Repeated rows give repeated results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS, lexicon size and number of languages bound it
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, lang, score in _predicted(shared.value, batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(lang, pa.string()), pa.array(score)], names=[id_col, "lang_pred", "score"])

    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {id_type}, lang_pred string, score double")


def accepted(docs: DataFrame, model: LanguageModel, min_score: float, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text has a language and a score of at least ``min_score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, lang, score in _predicted(shared.value, batch.column(at)):
                yield batch.slice(a, b - a).filter(pa.array(((lang != "und") & (score >= min_score)).astype(bool)))

    return docs.mapInArrow(run, docs.schema)


def label_words(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of words of one language in every text: (id, word_from, word_to, lang), word_to exclusive."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a, b, buf, offs in steps(batch.select(["text"]), step_bytes=STEP):
                _, _, row, gamma = word_marginals(m, buf, offs)
                if not len(row) or not m.labels:
                    continue
                best = gamma.argmax(axis=1)
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (best[1:] != best[:-1])
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(row))
                at = counts_of(row, b - a)[1]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[first] + a)), pa.array(first - at[row[first]]), pa.array(last - at[row[first]]), pa.array(np.array(m.labels, object)[best[first]], pa.string())], names=[id_col, "word_from", "word_to", "lang"])

    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {id_type}, word_from bigint, word_to bigint, lang string")
