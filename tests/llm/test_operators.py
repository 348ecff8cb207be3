"""The llm operators against brute force on small fixtures, with nulls, ties and repeated rows."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftlens.llm import bpe, decontam, langid, linededup, pii, quality, queries, quotes, setjoin, sufdedup, warc

DOC = "doc_id long, text string"
KEY = "a key for tests"


def small(spark):
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    p, q, r, base = make(390), make(500), make(1500), make(1200)
    docs = []
    for i in range(25):
        t = make(rng.randint(0, 900))
        docs.append((r[rng.randint(0, 300) : rng.randint(700, 1500)] if i % 5 == 0 else "") + t + (q if i % 3 == 0 else "") + (p if i % 4 == 0 else ""))
    for _ in range(15):
        b = list(base)
        for _ in range(rng.randint(0, 3)):
            b[rng.randrange(len(b))] = "X"
        docs.append("".join(b))
    return list(enumerate(docs + ["a" * 1000, "ab" * 700, "", None, base, base, "z" * 399, r + r]))


@pytest.mark.parametrize("most_windows", [20000, 5])
def test_repeats(spark, most_windows):
    data = small(spark)
    seen = collections.Counter()
    for _, t in data:
        b = (t or "").encode()
        seen.update(b[k : k + 400] for k in range(len(b) - 399))
    want = {}
    for i, t in data:
        b = (t or "").encode()
        mark = bytearray(len(b))
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                mark[k : k + 400] = b"\1" * 400
        runs = sum(1 for k in range(len(b)) if mark[k] and (k == 0 or not mark[k - 1]))
        want[i] = (len(b), sum(mark), runs, hashlib.sha256(bytes(x for x, m in zip(b, mark) if not m)).hexdigest())
    got = sufdedup.remove_repeats(spark.createDataFrame(data, DOC).repartition(3), most_windows=most_windows).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


@pytest.mark.parametrize("most_windows", [20000, 3])
def test_passages_of_over_50_words(spark, most_windows):
    """Passages of fewer than 400 bytes in two documents are told; the contract's columns leave them alone."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 5)))
    prose = lambda n: [word() for _ in range(n)]
    base, texts = prose(90), []
    for size in (50, 51, 52, 58, 75, 200):
        passage = prose(size)
        for _ in range(2):
            texts.append(prose(rng.randint(0, 80)) + passage + prose(rng.randint(0, 80)))
        texts.append(passage[1:] + ["end"])
    for _ in range(14):  # near copies: many windows of one anchor
        b = list(base)
        for _ in range(rng.randint(0, 2)):
            b[rng.randrange(90)] = word()
        texts.append(prose(rng.randint(0, 3)) + b)
    alone = prose(60)
    texts += [alone + ["x"] + alone, ["die"] * 120, ["so"] * 51, ["so"] * 70, ["no"] * 50, ["no"] * 50]
    spaces = [" ", "\n", "\t ", "  "]
    data = list(enumerate(["".join(w + rng.choice(spaces) for w in t) for t in texts] + [None, "", " \n"]))
    holders = collections.defaultdict(set)
    for i, t in enumerate(texts):
        for k in range(len(t) - 50):
            holders[tuple(t[k : k + 51])].add(i)
    want = {i: 0 for i, _ in data}
    for i, t in enumerate(texts):
        want[i] = len({j for k in range(len(t) - 50) if len(holders[tuple(t[k : k + 51])]) > 1 for j in range(k, k + 51)})
    got = sufdedup.remove_repeats(spark.createDataFrame(data, DOC).repartition(3), most_windows=most_windows).collect()
    assert {r.doc_id: r.n_shared_words for r in got} == want
    assert sum(r.n_shared_words > 0 and r.n_removed == 0 for r in got) > 10


def test_set_join(spark):
    rng = random.Random(5)
    data = []
    for g in range(8):
        base = [f"w{g}_{rng.randrange(60)}" for _ in range(rng.choice([2, 4, 6, 30, 90]))]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
            data.append(" ".join(w).upper() if rng.random() < 0.3 else "\t".join(w))
    data = list(enumerate(data + [None, "", " ", "one", "ONE", "one two"]))

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in data}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = setjoin.similar_documents(spark.createDataFrame(data, DOC).repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s), find(i)) for i, s in sets.items()}


def test_prefix_signatures_lose_nothing():
    """Any two sets that link share a signature, whichever shingles are frequent."""
    rng = np.random.default_rng(0)
    for _ in range(2000):
        n = int(rng.integers(2, 60))
        x = rng.choice(400, n, replace=False)
        y = np.unique(np.concatenate((rng.permutation(x)[: n - rng.integers(0, n // 4 + 1)], rng.choice(400, rng.integers(0, n // 3 + 1), replace=False))))
        both = len(np.intersect1d(x, y))
        if 100 * both < 75 * (len(x) + len(y) - both):
            continue
        value = lambda s: np.sort(setjoin.mix(s.astype(np.uint64)))
        often = setjoin.mix(np.arange(400, dtype=np.uint64)[rng.random(400) < rng.random()])
        sigs = [setjoin.signatures(value(s), np.isin(value(s), often)) for s in (x, y)]
        assert len(np.intersect1d(*sigs)) or np.array_equal(np.sort(x), y)


def test_lines(spark):
    data = [(1, "Same long line here\nshort\nunique one of first"), (2, " same LONG line here \nshort\n"), (3, None), (4, ""), (5, "repeated in one doc\nrepeated in one doc"), (6, "same long line here\nsame long line here"), (6, "x"), (None, "same long line here")]
    rows = [(*r, "kept") for r in data]
    got = linededup.dedup_lines(spark.createDataFrame(rows, DOC + ", n_lines string"), batches=3).collect()
    out = sorted(((r.doc_id or 0), r.text, r.n_lines, r.n_dropped) for r in got)
    assert out == [(0, "same long line here", 1, 0), (1, data[0][1], 3, 0), (2, "short\n", 3, 1), (3, "", 1, 0), (4, "", 1, 0), (5, data[4][1], 2, 0), (6, "", 2, 2), (6, "x", 1, 0)]


def test_bpe_is_tiktoken(spark):
    import tiktoken

    path, pattern = queries.tokenizer()
    tokens = bpe.load_ranks(path)
    want = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})
    data = [(1, "Hello  world\r\n 123 <|endoftext|> <unk>"), (2, None), (3, ""), (4, "é😀 \x00 ▁仿" * 30), (5, "a" * 3000), (5, "a" * 3000)]
    for r in bpe.encode_documents(spark.createDataFrame(data, DOC), path, pattern, with_ids=True).collect():
        text = dict(data)[r.doc_id] or ""
        assert r.token_ids == want.encode_ordinary(text) and r.n_tokens == len(r.token_ids)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_warc(spark):
    data = [(3, "http://a", "<p>x</p>"), (1, "http://b", "<p>x</p>"), (2, None, None), (5, "http://c", ""), (9, "http://d", "é" * 5000), (None, "http://e", "lost")]
    got = {r.page_id: r for r in warc.archive_pages(spark.createDataFrame(data, "page_id long, url string, html string").repartition(2)).collect()}
    assert sorted(got) == [1, 2, 3, 5, 9]
    for i, _, html in data[:-1]:
        payload = (html or "").encode()
        assert got[i].payload_bytes == len(payload) and got[i].payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
    assert [(i, got[i].record_type, got[i].refers_to) for i in sorted(got)] == [(1, "response", None), (2, "response", None), (3, "revisit", 1), (5, "revisit", 2), (9, "response", None)]


def test_pii(spark):
    data = [(1, "Bosbt.42@Mail8.example.com, +1 (988) 555-2485, 4041894974608795; 152.143.123.131###"), (2, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" Mrs. Anna Schmidt and Mr Schmidt'), (3, None), (4, ""), (5, "v 4.0. of 3"), (5, "v 4.0. of 3"), (6, "bosbt.42@mail8.example.com 4111 1111 1111 1111")]
    out = [(r.doc_id, r.text) for r in pii.pseudonymise(spark.createDataFrame(data, DOC), KEY).collect()]
    by = dict(out)
    assert len(out) == 7 and by[3] is None and by[4] == "" and by[5] == "v 4.0. of 3"
    for secret in ("osbt.42", "555-2485", "4041894974608795", "152.143.123.131", "24be6443", "Schmidt", "4111 1111"):
        assert not any(secret in (t or "") for t in by.values())
    mail = by[6].split()[0]
    assert by[1].lower().startswith(mail) and mail.endswith(".com")  # one entity, one surrogate, each in its own case
    digits = [int(c) for c in by[6] if c.isdigit()][-16:]
    assert sum(sum(divmod(2 * d, 10)) if k % 2 == 0 else d for k, d in enumerate(digits)) % 10 == 0  # still a valid card
    names = re.match(r'.*Mrs\. (\w+) (\w+) and Mr (\w+)$', by[2])
    assert names and names[2] == names[3]


def test_pii_cards_beside_numbers(spark):
    texts = ["4785380592391139 2123465659789240", "70.23.22.57 4111111111111111", "2024 4111111111111111", "2024 4111 1111 1111 1111", "4111 1111 1111 1111 2027",
             "4111-1111-1111-1111 4222-2222-2222-2222", "+1 (988) 555-2485 4041 8949 7460 8795", "+1 (988) 555-2485 3782 822463 10005", "id 7 4111111111111111"]
    by = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), DOC), KEY).collect()}
    for i, t in enumerate(texts):
        for part in re.findall(r"\d{4,}", t):
            assert part in ("2024", "2027") or part not in by[i].text, (t, by[i].text)
        assert re.sub(r"\d+", "0", by[i].text) == re.sub(r"\d+", "0", t)
    assert [by[i].n_entities for i in range(9)] == [2, 2, 1, 1, 1, 2, 2, 2, 1]
    plain = by[1].text.split()[1]
    assert by[2].text == f"2024 {plain}" and by[8].text == f"id 7 {plain}" and by[3].text.replace(" ", "") == f"2024{plain}" and by[4].text.replace(" ", "") == f"{plain}2027"


def test_pii_long_short_and_punctuated_secrets(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abcXYZ019_-.") for _ in range(3000))
    mail = "".join(rng.choice("abc019") for _ in range(90))
    values = {0: (f"token={long} end", long), 1: ("".join(rng.choice("0123456789abcdef") for _ in range(300)),) * 2, 2: ("password: hunter2", "hunter2"), 3: ("password=P@ssw0rd!x9 end", "P@ssw0rd!x9"),
              4: ('{"password": "correct horse \\" battery", "n": 1}', 'correct horse \\" battery'), 5: ("secret='a b c' end", "a b c"), 6: (f"to {mail}@a.b.c.d.e.f.g.h.example.com end", mail + "@a.b.c.d.e.f.g.h.example"), 7: ("token=пароль! end", "пароль"),
              8: ("api_key = abc==def= end", "abc==def="), 9: ("password: **** end", "****"), 10: ('token="x', "x")}
    values |= {20 + k: (f"token: {k}", str(k)) for k in range(10)}
    by = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame([(k, t) for k, (t, _) in values.items()], DOC), KEY).collect()}
    for k, (t, v) in values.items():
        head, tail = t.split(v) if k not in (9, 10) else t.rsplit(v, 1)
        assert by[k].n_entities == 1 and by[k].text.startswith(head) and by[k].text.endswith(tail), (t, by[k].text)
        new = by[k].text[len(head) : len(by[k].text) - len(tail)]
        assert new and new != v and not (len(v) > 3 and any(v[i : i + 9] in new for i in range(max(1, len(v) - 8)))), (t, by[k].text)
    assert len({by[20 + k].text for k in range(10)}) == 10


def test_pii_names_and_later_mentions(spark):
    texts = ["Mrs. Anna Schmidt came. Anna Schmidt left; SCHMIDT's car, Schmidt, Smith", "Mr. J. Smith", "Dr. Anna Maria Schmidt and Maria", "my name is Anna Schmidt. Anna!", "Name: Anna von Schmidt\nx@y.org", "Best regards,\nAnna Schmidt", "Prof. Dr. Anna Schmidt", "Anna Schmidt", "Herr J.R.R. Tolkien", "Меня зовут Анна Иванова", "Mr " + "Anna " * 5000]
    by = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), DOC), KEY).collect()}
    for i in (0, 2, 3, 4, 5, 6, 10):
        assert not re.search("anna|maria|schmidt", by[i], re.I), by[i]
    first = re.fullmatch(r"Mrs\. (\w+) (\w+) came\. (\w+) (\w+) left; (\w+)'s car, (\w+), Smith", by[0])
    assert first and first[1] == first[3] and first[2] == first[4] == first[6] and first[5] == first[2].upper()
    assert re.fullmatch(r"Mr\. [A-IK-Z]\. \w+", by[1]) and "Smith" not in by[1]
    second = re.fullmatch(r"Dr\. (\w+) (\w+) (\w+) and (\w+)", by[2])
    assert second and second[3] == first[2] and second[2] == second[4] != second[1]
    assert re.fullmatch(r"my name is (\w+) (\w+)\. \1!", by[3]) and re.match(r"Name: \w+ von \w+\n", by[4]) and re.fullmatch(r"Best regards,\n\w+ \w+", by[5]) and re.fullmatch(r"Prof\. Dr\. \w+ \w+", by[6])
    assert by[7] == texts[7]  # nothing says that this is a name
    assert "J.R.R." not in by[8] and "Tolkien" not in by[8] and "Анна" not in by[9] and "Иванова" not in by[9]


def test_quotes(spark):
    rows = [(1, 0, "user", "Hello there.\n\nHow are you?"), (1, 1, "assistant", "> hello  there.\nFine, thanks\n> How are you?\nok"), (1, 2, "user", ">> How are you?\n> Fine, thanks\ngood"), (1, 3, "user", "> Hello there.\nlate"), (2, 0, "user", None), (3, 5, None, "> Fine, thanks\ncross"), (None, None, None, "> good\nlost")]
    got = sorted(tuple(r)[:10] for r in quotes.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("conv_id is not null").collect())
    assert [(r[0], r[1], r[2], r[4], r[7], r[8], r[9]) for r in got] == [(1, 0, 0, "Hello there.\n\nHow are you?", None, 0, 0), (1, 1, 1, "Fine, thanks\nok", 0, 0, 1), (1, 2, 2, "good", 1, 0, 2), (1, 3, 3, "late", 0, 0, 1), (2, 0, 0, "", None, 0, 0), (3, 0, 5, "cross", None, 5, 0)]


def test_quotes_pass_over_originals_that_cannot_be(spark):
    rows = [(1, 0, "user", "> said later\nfirst"), (1, 1, "user", "said later"), (2, 3, "user", "said later"), (3, 0, "user", "said later"), (4, 5, "user", "> said later\nthanks"),
            (None, 0, "user", "said later"), (1, None, "user", "said later"), (5, 0, "user", "own words"), (5, None, "user", "own words"), (5, 1, "user", "> own words\nyes"), (None, 1, "user", "> own words\nno")]
    got = quotes.link_quotes(quotes.numbered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), quotes.Workspace(spark, "quotes"))).collect()
    assert sorted((r.conv_id, r.turn, r.from_conv, r.from_turn) for r in got) == [(1, 0, 2, 3), (4, 5, 1, 1), (5, 1, 5, 0)]


def test_decontamination_recall(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9)))
    items = [(i, " ".join(word() for _ in range(rng.randint(18, 60)))) for i in range(40)] + [(90, None), (91, "tiny")]
    docs, planted = [], set()
    for i, (item, text) in enumerate(items[:40]):
        b = list(text)
        for _ in range(int(0.04 * len(b))):
            b[rng.randrange(3, len(b))] = rng.choice("etaoin")
        docs.append((i, " ".join(word() for _ in range(50)) + "\n" + "".join(b) + " " + word()))
        planted.add((i, item))
    docs += [(100 + i, " ".join(word() for _ in range(200))) for i in range(40)] + [(500, None), (501, "")]
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= planted and len(got) >= 0.9 * len(planted)


def test_edit_distance():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 30))).encode() for _ in range(2))
        rows = [list(range(len(b) + 1))]
        for i in range(1, len(a) + 1):
            rows.append([i] + [0] * len(b))
            for j in range(1, len(b) + 1):
                rows[i][j] = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        want = min(rows[-1][: len(a) + 6])
        assert decontam.within(a, b, 5) == (want if want <= 5 else None)


def test_marginals_are_those_of_the_chain():
    rng = np.random.default_rng(1)
    e, t, row = rng.normal(size=(200, 3)), rng.normal(size=(3, 3)), np.sort(rng.choice([0, 1, 2, 4], 200))
    g = langid.marginals(e, t, row, 6)
    for r in range(5):
        if (row == r).any():
            assert np.allclose(langid.chain_expectations(e[row == r][None], t)[0][0], g[row == r])


def test_language_held_out_accuracy(spark):
    out = queries.op9_language(spark, "/root/testdata/sf0.01").join(queries.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out) and all(0 <= r.score <= 1 for r in out)


def test_language_of_nothing(spark):
    model = langid.train(["the and of " * 100, "le la les " * 100], ["en", "fr"])
    got = {r.doc_id: r.lang_pred for r in langid.predict(spark.createDataFrame([(1, None), (2, ""), (3, "12 %"), (4, "les la")], DOC), model).collect()}
    assert got == {1: "und", 2: "und", 3: "und", 4: "fr"}
    runs = langid.label_words(spark.createDataFrame([(1, "the and of the and of le la les le la les")], DOC), model).orderBy("word_from").collect()
    assert [r.lang for r in runs] == ["en", "fr"]


def test_quality_counts(spark):
    texts = ["\n\n a\n a\nb\n a \n", "a b c a b c a b", None, "", "x #y$ é%\n" * 3]
    model = quality.QualityModel(np.zeros(1 << quality.BITS), np.zeros(1 << quality.BITS))
    got = {r.doc_id: r for r in quality.score_documents(spark.createDataFrame(list(enumerate(texts)), DOC), model).collect()}
    assert [(got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) for i in range(5)] == [(4, 4, 0, 1, 0), (8, 8, 0, 0, 8), (0, 0, 0, 0, 0), (0, 0, 0, 0, 0), (9, 18, 9, 2, 9)]
    assert all(got[i].base_failed and not got[i].kept for i in got)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOC + ", lang string")
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    assert linededup.dedup_lines(empty).count() == setjoin.similar_documents(empty).count() == sufdedup.remove_repeats(empty).count() == pii.pseudonymise(empty, KEY).count() == 0
    assert decontam.contaminated(empty, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert quotes.reply_ordered(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_set_join_of_large_groups_near_the_threshold(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    texts = []
    for k in range(150):
        words = [w if rng.random() > (k % 10) * 0.008 else f"x{rng.randrange(30)}" for w in base]
        texts.append(" ".join(words[: 120 - k % 4 * 7]))
    texts += [" ".join(base + [f"t{k}-{i}" for i in range(k)]) for k in range(40)] + texts[:20] + [None, ""]
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in setjoin.similar_documents(docs).collect()}
    assert got == {i: (len(s), top(i)) for i, s in enumerate(sets)}
    assert len(set(map(top, range(150)))) > 20


def test_set_join_reads_few_sets_of_copies_that_do_not_link(spark, monkeypatch):
    """Copies that keep some of a text's lines share signatures, but most cannot link: their sets are not compared."""
    rng = random.Random(11)
    lines = [" ".join(f"w{rng.randrange(300)}" for _ in range(12)) for _ in range(30)]
    texts = ["\n".join(lines)] + ["\n".join(x for x in lines if rng.random() < 0.6) for _ in range(200)]
    texts += ["\n".join([*texts[k].split("\n"), f"a line of its own {k} that hardly counts"]) for k in range(1, 40)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    root = list(range(len(sets)))
    for i, j in sorted(linked * 5, key=lambda p: rng.random()):
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root]
    read, compared = [], setjoin.compared

    def counted(pairs, *rest):
        read.append(pairs.count())
        return compared(pairs, *rest)

    monkeypatch.setattr(setjoin, "compared", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), DOC)
    got = {r["doc_id"]: r["component_id"] for r in setjoin.similar_documents(docs).collect()}
    assert got == dict(enumerate(root)) and len(set(root)) > 100
    assert sum(read) < 2 * len(linked) + 100


def test_sketches_never_differ_more_than_sets():
    """Parities of equal sets are equal, and a shingle more changes one place."""
    rng = np.random.default_rng(2)
    for _ in range(200):
        x, y = (np.unique(rng.integers(0, 900, rng.integers(1, 400)).astype(np.uint64)) for _ in range(2))
        a, b = setjoin.sketches(np.concatenate((x, y)), np.array([0, len(x), len(x) + len(y)]))
        assert np.bitwise_count(a ^ b).sum() <= len(np.setxor1d(x, y))


def test_lines_of_wide_ids_and_long_texts(spark):
    text = "a line of many documents\nother"
    ids = [2**60, 0, -(2**62 + 5), 2**62 + 5, None]
    got = {r.doc_id: (r.n_dropped, r.text) for r in linededup.dedup_lines(spark.createDataFrame([(i, text) for i in ids], DOC)).collect()}
    assert got == {i: (0, text) if i in (None, min(ids[:4])) else (1, "other") for i in ids}
    long = "\n".join(f"line number {i} of a long text" for i in range(100_000))
    got = linededup.dedup_lines(spark.createDataFrame([(1, long), (2, long + "\nnew")], DOC), batches=2).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped) for r in got} == {1: (100_000, 0), 2: (100_001, 100_000)} and [r.text for r in got if r.doc_id == 2] == ["new"]


def test_decontamination_against_all_documents_and_items(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 30)))) for i in range(10)] + [(10, "北京大学是中国的一所著名大学位于北京市海淀区"), (11, ""), (None, "no id"), (12, "It costs $5: (really)! " * 4)]
    docs = []
    for k in range(60):
        b = list(items[rng.choice([*range(11), 13])][1])
        for _ in range(rng.randint(0, max(1, len(b) // 9))):
            b[rng.randrange(len(b))] = rng.choice("etao")
        docs.append((k, rng.choice(["", "Question:", "前文", word() + " "]) + "".join(b) + rng.choice(["", " ", "后文"]) + " ".join(word() for _ in range(20))))
    docs += [(3, docs[3][1]), (100, None), (101, ""), (None, items[0][1])]
    want = set()
    for i, text in docs:
        t = decontam.normalised_text(text)
        starts = [p for p in range(len(t)) if t[p] != 32 and t[p] & 0xC0 != 0x80 and (p == 0 or decontam.BREAK[t[p - 1]])]
        for item, content in items:
            c = decontam.normalised_text(content)
            k = decontam.allowed(len(c), decontam.MAX_EDIT)
            if item is not None and len(c) >= decontam.Q and any(decontam.within(c, t[p:], k) is not None for p in starts):
                want.add((i, item))
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 30 and (None, 0) in got


def test_decontamination_memory_of_a_long_item():
    import tracemalloc

    rng = random.Random(4)
    text = "".join(rng.choice("etaoin ") for _ in range(100_000)).encode()
    tracemalloc.start()
    decontam.ItemIndex([(1, text)])
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


def test_quotes_of_a_generated_exchange_are_those_of_sql(spark):
    """Known links: any consecutive lines of an earlier message; and every column equals the SQL."""
    import duckdb

    rng = random.Random(6)
    line = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(rng.randint(3, 7)))
    rows, known = [], 0
    for conv in range(30):
        said = []
        for turn in range(rng.randint(1, 8)):
            parts = []
            if said and rng.random() < 0.7:
                lines = rng.choice(said[-3:])
                a = rng.randrange(len(lines))
                cut = lines[a : a + rng.randint(1, 4)]
                parts += [rng.choice(["> ", ">", ">> ", "> > "]) + x.upper() for x in cut]
                known += 1
            own = [line() for _ in range(rng.randint(1, 5))]
            if rng.random() < 0.3:
                own.insert(1, "")
            said.append([x for x in own if x])
            rows.append((conv, turn, rng.choice(["user", None]), "\n".join(parts + own)))
    rows += [(100, 0, "user", None), (100, 1, "user", ""), (101, 0, "user", "\n".join(f"> {line()}" for _ in range(3))), (102, 3, "user", "common line of all"), (103, 1, "user", "> common line of all\nyes"), (104, 0, "user", "x\n" * 20_000)]
    got = quotes.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("msg", queries.F.lit("clash")))
    have = [tuple(r) for r in got.collect()]
    assert known > 60 and sum(r.n_linked for r in got.collect()) >= 0.95 * known
    con = duckdb.connect()
    con.register("conversations", pa.table(list(zip(*rows)), names=["conv_id", "turn", "role", "text"]))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.OP2_SQL})").fetchall()
    key = lambda r: r[:2]
    assert sorted(have, key=key) == sorted(want, key=key)


def test_pii_full_formats_and_one_surrogate_a_person(spark):
    """Every value of a format in use: surrogates stay distinct, none is an entity, and no entity is left."""
    low = "abcdefghijklmnopqrstuvwxyz"
    mails = [f"{x}@{y}.co" for x in low for y in low]
    addresses = [f"{a}.{b}.0.{c}" for a in range(1, 10) for b in range(10) for c in range(10)]
    texts = [" ".join(mails[k::4]) for k in range(4)] + [", ".join(addresses)] + ["Dr. Peter Novak and Mr Peter Novak", "Mrs Kim Oz, Mr Kim Oz, Prof. Kim Oz", None]
    rows = list(enumerate(texts))
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], DOC + ", raws int")
    by = {r.doc_id: r.text for r in pii.pseudonymise(frame, KEY).collect()}
    new = [w for k in range(4) for w in by[k].split()]
    old = [w for k in range(4) for w in texts[k].split()]
    assert len(set(new)) == len(set(old)) == 676 and not set(new) & set(old) and all(w.endswith(".co") for w in new)
    ips = by[4].split(", ")
    assert len(set(ips)) == len(addresses) and not set(ips) & set(addresses)
    same = re.fullmatch(r"Dr\. (\w+) (\w+) and Mr (\w+) (\w+)", by[5])
    assert same and same[1] == same[3] and same[2] == same[4]
    kim = re.fullmatch(r"Mrs (\w+) (\w+), Mr (\w+) (\w+), Prof\. (\w+) (\w+)", by[6])
    assert kim and kim[2] == kim[4] == kim[6]


LONG_RUNS = ["a.", "12-34-", "%20", "a-b_c+", "Mr ", "Mr Anna ", "A. ", "4111 ", "+1 234 ", "token=", "name: ", "1.1.1.", "a@", "a@b.", "\n", "é ", "abcdef0123", "von der ", "secret=\"\\\" "]


def test_pii_reads_long_runs_once(spark):
    """Every shape of a megabyte, all in linear time: quadratic ones took minutes to hours."""
    import time

    pii.pseudonymise(spark.createDataFrame([(1, "a@b.org")], DOC), KEY).collect()  # code is compiled
    texts = [shape * ((1 << 20) // len(shape)) for shape in LONG_RUNS]
    began = time.time()
    got = spark.createDataFrame(list(enumerate(texts)), DOC).repartition(8).select("doc_id", F.size(pii.entities(F.col("text"))).alias("n")).collect()
    assert len(got) == len(texts) and time.time() - began < 5 * len(texts)


def test_pii_mail_after_punctuation(spark):
    texts = ["--bob@example.org, .bob@example.org (bob@example.org)", "x bob@example.org", "Mr Mr Anna Mr 5", "_%+A.b@example.org"]
    by = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), DOC), KEY).collect()}
    mail = by[1].text.split()[1]
    assert mail != "bob@example.org" and by[0].text == texts[0].replace("bob@example.org", mail) and by[0].n_entities == 3
    assert re.fullmatch(r"_%\+[A-Z]\.[a-z]@[a-z]{7}\.org", by[3].text) and "Anna" not in by[2].text


def test_pii_map_of_a_corpus_is_one_to_one(spark):
    """Of a whole table: no entity is left, equal ones have equal surrogates, and different ones different ones; another key gives others."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    before = {r.doc_id: r for r in docs.select("doc_id", pii.entities(F.col("text")).alias("raws"), F.split("text", pii.PATTERN, -1).alias("gaps")).collect()}
    out = {r.doc_id: r for r in pii.pseudonymise(docs, KEY).collect()}
    pairs = {}
    for i, r in before.items():
        assert out[i].n_entities == len(r.raws or [])
        at, text = 0, out[i].text or ""
        for raw, gap, after in zip(r.raws or [], r.gaps, r.gaps[1:] if r.gaps else []):
            assert text.startswith(gap, at), i
            at += len(gap)
            end = text.index(after, at) if after else len(text)
            if "@" in raw:
                pairs.setdefault(raw.lower(), set()).add(text[at:end].lower())
            at = end
    assert pairs and all(len(v) == 1 for v in pairs.values())
    fakes = [next(iter(v)) for v in pairs.values()]
    assert len(set(fakes)) == len(fakes) and not set(fakes) & set(pairs)
    other = {r.doc_id: r.text for r in pii.pseudonymise(docs, "another").collect()}
    assert all(other[i] != out[i].text for i in out if out[i].n_entities)


def test_quotes_of_many_equal_lines_take_linear_time(spark):
    import time

    schema = "conv_id long, turn long, role string, text string"
    times = []
    for n in (20_000, 200_000):
        rows = [(1, 0, "user", "same line\n" * n), (1, 1, "assistant", "> same line\n" * (n // 2) + "yes"), (1, 2, "user", "> same line\n" * (n // 2 + 7)), (1, 3, "user", "> same line\n" * (n + 1))]
        began = time.time()
        got = {r.turn: r for r in quotes.reply_ordered(spark.createDataFrame(rows, schema)).collect()}
        times.append(time.time() - began)
        assert [(got[t].n_quotes, got[t].n_linked, got[t].reply_to) for t in range(4)] == [(0, 0, None), (1, 1, 0), (1, 1, 0), (1, 0, None)]
    assert times[1] < 10 * times[0] + 30


def test_quotes_of_known_lines_are_found(spark):
    """Recall over thousands of quotations of one to forty lines, half of them in other conversations; and none where a line differs."""
    rng = random.Random(21)
    rows, known = [], []
    for conv in range(150):
        lines = [f"line {conv} {k} {rng.choice(['a', 'b'])}" for k in range(60)]
        rows.append((conv, 0, "user", "\n".join(lines)))
        for turn in range(1, 11):
            a, size = rng.randrange(20), rng.randint(1, 40)
            cut = [x.upper() for x in lines[a : a + size]]
            good = turn % 5 != 0
            if not good:
                cut[-1] += " x"
            rows.append((conv if turn % 2 else 1000 + conv, turn, "user", "\n".join("> " + x for x in cut) + f"\nanswer {conv} {turn}"))
            known.append((rows[-1][0], turn, good))
    got = {(r.conv_id, r.turn): r.n_linked for r in quotes.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).collect()}
    assert all(got[c, t] == good for c, t, good in known)


def test_runs_have_a_file_a_bucket_and_are_read_as_they_lie(spark):
    from driftlens.llm.workspace import Workspace, shuffle_cleanup

    space, name = Workspace(spark, "runs"), "spark.sql.autoBroadcastJoinThreshold"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    store, before = linededup.LineRuns(spark, space, fan_out=3, buckets=buckets), spark.conf.get(name)
    batch = lambda k: spark.range(k * 100, k * 100 + 150).select(*linededup.key_hashes(F.col("id").cast("string")), "id").groupBy("h1", "h2").agg(F.min("id").alias("first"))
    spark.conf.set(name, "-1")
    try:
        for k in range(10):
            found = store.mark_known(batch(k), f"batch{k}")
            assert found.where("known").count() == (50 if k else 0)
            store.add(found.where("NOT known"))
        assert [len(level) for level in store.levels] == [1, 0, 1]
        assert sum(r.count() for r in store.runs()) == 1050
        for level in store.levels:
            for run in level:
                assert len(spark.sql(f"SELECT DISTINCT input_file_name() AS f FROM {space.tables[run]}").collect()) == buckets
        with shuffle_cleanup(spark):
            plan = store.marked(batch(20))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    sides = plan.split("SortMergeJoin")[1:]
    assert len(sides) == 2 and plan.count("Sort [") == 1 and plan.count("Exchange") == 1  # of the batch alone
    store.close()
    assert not any(n.startswith("line_run") for n in space.tables)


def test_short_items_are_found_exactly(spark):
    """Items of one to thirty bytes against all starts of all documents."""
    rng = random.Random(31)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n)).strip() or "a"
    items = [(k, make(k % 30 + 1)) for k in range(60)] + [(100, "a"), (101, items_text := "gh ab ef"), (102, items_text), (103, " ")]
    short = [(i, c) for i, t in items if (c := decontam.normalised_text(t)) and decontam.is_short(len(c), decontam.MAX_EDIT)]
    docs = []
    for k in range(150):
        t = list(items[rng.randrange(60)][1])
        for _ in range(rng.randint(0, 2)):
            p = rng.randrange(len(t) + 1)
            t[p : p + rng.randint(0, 1)] = rng.choice(["", "x", "y"])
        docs.append((k, make(rng.randint(0, 15)) + rng.choice([" ", "-", "é"]) + "".join(t) + rng.choice(["", " z", "tail"])))
    docs += [(900, None), (901, ""), (None, "gh ab ef")]
    want = set()
    for i, text in docs:
        t = decontam.normalised_text(text)
        starts = [p for p in range(len(t)) if t[p] != 32 and t[p] & 0xC0 != 0x80 and (p == 0 or decontam.BREAK[t[p - 1]])]
        for item, c in short:
            k = decontam.allowed(len(c), decontam.MAX_EDIT)
            best = min((e for p in starts if (e := decontam.within(c, t[p:], k)) is not None), default=None)
            if best is not None:
                want.add((i, item, best))
    known = {item for item, _ in short}
    got = {(r.doc_id, r.item_id, r.n_edits) for r in decontam.contaminated(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string")).collect() if r.item_id in known}
    assert got == want and {(None, 101, 0), (None, 102, 0)} <= got and any(e for _, _, e in got) and len(got) > 300
