"""All five stages of the corpus pipeline as one chain, against brute force."""

import random

import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from driftlens.llm import decontam, queries


def test_pipeline_is_its_stages_one_after_another(spark, tmp_path):
    import tiktoken

    rng = random.Random(8)
    words = {"en": ["the", "house", "with", "water", "which", "thing", "would", "through", "should", "winter"], "fr": ["le", "maison", "avec", "eau", "quelque", "chose", "était", "toujours", "depuis", "hiver"]}
    line = lambda lang, n: " ".join(rng.choice(words[lang]) + rng.choice(["", "", "s", "e"]) for _ in range(n))
    texts = {}
    for i in range(60):
        lang = "en" if i % 2 else "fr"
        texts[i] = ("\n".join(line(lang, 40) for _ in range(3)), lang)
    item = line("en", 25)
    near = texts[4][0].split(" ")
    near[10] = "hivernale"
    texts |= {100: (None, None), 101: ("", "en"), 102: ("12 34 %", "en"), 103: (texts[3][0], "en"), 104: (line("en", 30) + " " + item + " end", "en"), 105: (texts[5][0].split("\n")[0] + "\n" + line("en", 40), "en"),
              106: (" ".join(near).replace("\n", " "), "fr"), 107: ("\n".join(line("en", 30) for _ in range(2000)), "en")}
    rows = [(i, t, lang, "s", len(t or "")) for i, (t, lang) in texts.items()]
    pq.write_table(pa.table(list(zip(*rows)), schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])), f"{tmp_path}/documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1, 2], pa.int64()), "text": pa.array([item, None])}), f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()}

    kept = {i: t for i, (t, _) in texts.items() if t and i != 102}
    first = {}
    for i in sorted(kept):
        for x in {x.strip(" \t\n\x0b\x0c\r").lower() for x in kept[i].split("\n")}:
            first.setdefault(x, i)
    held = {x: sum(x in {y.strip().lower() for y in t.split("\n")} for t in kept.values()) for x in first}
    for i, t in kept.items():
        key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
        kept[i] = "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or held[key(x)] < 2 or first[key(x)] == i)
    sets = {}
    for i, t in kept.items():
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    gone = {j for i in kept for j in kept if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert gone == {106}
    plain = decontam.normalised_text(item)
    kept = {i: t for i, t in kept.items() if i not in gone and plain not in decontam.normalised_text(t)}
    assert 104 not in kept and kept[103] == ""
    path, pattern = queries.tokenizer()
    from driftlens.llm import bpe

    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: k for k, t in enumerate(bpe.load_ranks(path))}, special_tokens={})
    assert {i: r.n_tokens for i, r in got.items()} == {i: len(encoding.encode_ordinary(t)) for i, t in kept.items()}
