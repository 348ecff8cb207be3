"""Fits against plain loops, random inputs against the definition, and tables that are empty, repeated, long or clash in names."""

import base64
import collections
import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlens.llm import bpe, decontam, langid, linededup, quality, queries, quotes, setjoin, sufdedup, warc
from driftlens.llm.textkernel import prefix_sums, span_hashes, words

DOC = "doc_id long, text string"


def features(text):
    """Share of each hashed n-gram among the word n-grams, and among the byte n-grams, of a text."""
    buf = np.frombuffer(text.encode(), np.uint8)
    offs = np.array([0, len(buf)])
    start, end, row = words(buf, offs)
    word = collections.Counter(quality.word_slots(span_hashes(prefix_sums(buf), start, end), row)[0].tolist())
    char = collections.Counter(s for slots, whole in quality.char_parts(buf, offs) for s in slots[whole].tolist())
    out = {s: quality.SCALE * n / sum(word.values()) for s, n in word.items()}
    return out | {s + (1 << quality.BITS): quality.SCALE * n / sum(char.values()) for s, n in char.items()}


def labelled(n, seed=2):
    rng = random.Random(seed)
    good, bad = ["river", "letter", "garden", "winter", "because"], ["win$", "click", "free!!", "buy", "now"]
    return [(" ".join(rng.choice(good if k % 2 else bad) for _ in range(rng.randint(5, 30))), k % 2) for k in range(n)]


def test_quality_fit_is_that_of_plain_loops():
    rows = labelled(40)
    y, weight = np.array([q for _, q in rows], float), np.array([1.0 + k % 3 for k in range(len(rows))])
    model = quality.train([t for t, _ in rows], y, weight, epochs=5)
    x = [features(t) for t, _ in rows]
    fitted = [k for k in range(len(rows)) if k % 5 != 4]
    share = {q: 0.5 / sum(rows[k][1] == q for k in fitted) for q in (0, 1)}
    w, g2, bias, b2 = collections.defaultdict(float), collections.defaultdict(lambda: 1e-10), 0.0, 1e-10
    for _ in range(5):
        d = {k: share[rows[k][1]] * (1 / (1 + math.exp(-sum(w[s] * v for s, v in x[k].items()) - bias)) - rows[k][1]) for k in fitted}
        grad = collections.defaultdict(float)
        for k in fitted:
            for s, v in x[k].items():
                grad[s] += d[k] * v
        for s in set(grad) | set(w):
            g = grad[s] + 1e-5 * w[s]
            g2[s] += g * g
            w[s] -= 0.1 * g / math.sqrt(g2[s])
        b2 += sum(d.values()) ** 2
        bias -= 0.1 * sum(d.values()) / math.sqrt(b2)
    both = np.concatenate((model.word, model.char))
    assert all(abs(both[s] - v) < 1e-5 for s, v in w.items()) and np.count_nonzero(both) <= len(w) and abs(model.bias - bias) < 1e-6
    assert model.slope > 0


def test_platt_is_at_the_minimum():
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 300).astype(float)
    z, weight = rng.normal(size=300) + 2 * y, rng.uniform(0.5, 2, 300)
    a, b = quality.platt(z, y, weight)
    target = np.where(y > 0, 1 - 1 / (2 + weight[y > 0].sum()), 1 / (2 + weight[y == 0].sum()))

    def loss(a, b):
        p = 1 / (1 + np.exp(-(a * z + b)))
        return -(weight * (target * np.log(p) + (1 - target) * np.log(1 - p))).sum() + 5e-4 * ((a - 1) ** 2 + b * b)

    assert all(loss(a, b) <= loss(a + i, b + j) + 1e-9 for i in (-1e-3, 0, 1e-3) for j in (-1e-3, 0, 1e-3))


def test_quality_verdicts(spark):
    """Scores of new texts separate the classes; the verdict is the fixed threshold's; empty labels refuse nothing but by the base rules."""
    rows = [(k, t * 4 + f" end{k}", q) for k, (t, q) in enumerate(labelled(300))]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t, _ in rows] + [(5, rows[5][1], "x", 1), (None, rows[7][1], None, None), (1000, None, None, None), (1001, "", None, None)], DOC + ", kept string, n_words int")
    labels = spark.createDataFrame([(k, q, None) for k, _, q in rows if k < 200] + [(3, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = [r for r in quality.score_documents(docs, quality.fit(docs, labels)).collect()]
    assert len(got) == 304 and all(r.kept == (not r.base_failed and r.probability >= quality.THRESHOLD) for r in got)
    by = {r.doc_id: r for r in got}
    right = sum((by[k].probability >= 0.5) == (q == 1) for k, _, q in rows if k >= 200)
    assert right >= 95 and by[1000].base_failed and not by[1001].kept
    none = quality.score_documents(docs, quality.fit(docs, labels.where("false"))).collect()
    assert all(r.kept == (not r.base_failed) and r.probability > 0.99 for r in none)
    empty = docs.where("false")
    assert quality.score_documents(empty, quality.fit(empty, labels)).collect() == []


def test_marginals_are_those_of_all_paths():
    """Every labelling of short sequences enumerated."""
    rng = np.random.default_rng(7)
    for size in (2, 3):
        lengths = [1, 2, 0, 6, 3]
        row = np.repeat(np.arange(len(lengths)), lengths)
        e, t = rng.normal(size=(len(row), size)) * 2, rng.normal(size=(size, size))
        got = langid.marginals(e, t, row, len(lengths))
        for r, n in enumerate(lengths):
            own, total, want = e[row == r], 0.0, np.zeros((n, size))
            for path in itertools.product(range(size), repeat=n):
                if n:
                    weight = sum(math.exp(t[s, path[0]]) for s in range(size)) * math.exp(own[0, path[0]])
                    for k in range(1, n):
                        weight *= math.exp(t[path[k - 1], path[k]] + own[k, path[k]])
                    total += weight
                    for k, y in enumerate(path):
                        want[k, y] += weight
            assert n == 0 or np.allclose(got[row == r], want / total, atol=1e-4)


def test_archives_of_random_pages(spark):
    """Random payloads of which many are equal, repeated ids, nulls, and one page of two megabytes."""
    rng = random.Random(13)
    pool = [None, "", "é" * 50] + ["".join(rng.choice("abc<>é😀\r\n") for _ in range(rng.randint(0, 400))) for _ in range(60)]
    rows = [(k, rng.choice(["http://x/é", None, ""]), rng.choice(pool)) for k in range(400)]
    rows += [(k, None, rows[k][2]) for k in range(0, 40, 3)] + [(7, "http://again", "other"), (5000, "http://long", "long é " * 300_000)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"payload_bytes": F.lit("x"), "refers_to": F.lit("y")})
    for least in (0, 100):
        got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_pages(table.repartition(6), least).collect())
        first, want = {}, collections.Counter()
        for i, _, html in rows:
            first[html or ""] = min(first.get(html or "", i), i)
        for i, _, html in rows:
            payload = (html or "").encode()
            again = len(payload) >= least and first[html or ""] != i
            want[i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if again else "response", first[html or ""] if again else None] += 1
        assert got == want


def test_tokens_of_random_texts_are_tiktoken(spark):
    import tiktoken

    path, pattern = queries.tokenizer()
    want = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: k for k, t in enumerate(bpe.load_ranks(path))}, special_tokens={})
    rng = random.Random(17)
    alphabets = ["abcdefgh ", "aA'stré ñß\t\n\r ", "0123456789.,- ", "日本語中文字 ", "😀👩‍👩‍👧‍👦🇩🇪é́ ", "\x00\x1f\x7f ﻿퟿\U0010ffff "]
    texts = ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(0, 300))) for _ in range(400)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(200)) for _ in range(50)]
    texts += ["x" * 60_000, "word " * 60_000, "é" * 30_000, " " * 30_000, "\n" * 30_000, None, ""]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[4])]
    got = bpe.encode_documents(spark.createDataFrame(rows, DOC).withColumn("n_tokens", F.lit("x")).repartition(6), path, pattern, with_ids=True).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for i, t in rows:
        ids = want.encode_ordinary(t or "")
        assert by[i].token_ids == ids and by[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert by[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_documents(spark.createDataFrame([], DOC), path, pattern).collect() == []


def test_language_of_repeated_long_and_clashing_rows(spark):
    model = langid.train(["the and of " * 100, "le la les " * 100], ["en", "fr"])
    rows = [(1, "the of and"), (1, "the of and"), (None, "les la"), (2, "the and of " * 200_000), (3, "le " * 3 + "the " * 400_000)]
    table = spark.createDataFrame(rows, DOC).withColumns({"lang": F.lit("zz"), "lang_pred": F.lit(1), "score": F.lit("x")})
    got = langid.predict(table, model).collect()
    assert sorted((str(r.doc_id), r.lang_pred) for r in got) == [("1", "en"), ("1", "en"), ("2", "en"), ("3", "en"), ("None", "fr")]


def test_pipeline_of_an_empty_table_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    english = "the house with water which would through should winter and the thing of the river " * 4
    rows = [(k, english + f"number {k} " * 5, "en", None, None) for k in range(30)] + [(3, english + "number 3 " * 5, "en", None, None), (None, english, None, None, None), (50, None, None, None, None)]
    for name, data in (("none", []), ("some", rows)):
        (tmp_path / name).mkdir()
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/none").collect() == []
    got = corpus_pipeline.run(spark, f"file://{tmp_path}/some").collect()
    assert 0 < len(got) <= len(rows) and 50 not in {r.doc_id for r in got}


LONG = "word " * 250_000


@pytest.mark.parametrize("operator", ["setjoin", "linededup", "sufdedup", "decontam", "quotes"])
def test_long_texts_and_clashing_names(spark, operator):
    """A megabyte in one text, and columns named like those that the operators make."""
    rows = [(1, LONG + "tail one"), (2, "short text of a few words only"), (3, None), (4, LONG + "tail two")]
    clash = {c: F.lit("x") for c in ("id", "k", "n", "lines", "h1", "h2", "pos", "doc", "tokens", "key", "component_id", "n_shingles", "item_id", "n_dropped", "rest", "spans", "msg", "level")}
    docs = spark.createDataFrame(rows, DOC).withColumns(clash)
    if operator == "setjoin":
        assert {r.doc_id: r.component_id for r in setjoin.similar_documents(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}  # few shingles each: the tails weigh
    elif operator == "linededup":
        assert {r.doc_id: r.n_dropped for r in linededup.dedup_lines(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    elif operator == "sufdedup":
        got = {r.doc_id: r.n_removed for r in sufdedup.remove_repeats(docs).collect()}
        assert got[2] == got[3] == 0 and got[1] >= len(LONG) - 5 and got[4] >= len(LONG) - 5
    elif operator == "decontam":
        items = spark.createDataFrame([(7, "short text of a few words only", "x")], "item_id long, text string, doc_id string")
        assert [(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()] == [(2, 7)]
    else:
        turns = docs.select(F.lit(1).alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("user").alias("role"), "text", *clash)
        assert {r.turn: r.n_quotes for r in quotes.reply_ordered(turns).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
