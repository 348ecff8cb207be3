"""Operators 11 to 13 against brute force, with nulls, ties, repeated rows, empty tables and clashing names."""

import collections
import hashlib
import heapq
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from driftlens.llm import curriculum, deltalloyd, turnscan

# --- op11 ------------------------------------------------------------------------------------------------------------


def lloyd(rows, k, rounds, dim, salt="3"):
    """Plain rounds over Python integers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(1024 * float(x)) for x in v]))
    text = lambda i: "" if i is None else str(i)
    centres = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"{salt}:{text(r[0])}".encode()).hexdigest(), r[1]))[:k]]
    find = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[find(v)[1]].append(v)
        centres = [[sum(c) // len(groups[n]) for c in zip(*groups[n])] if groups[n] else centre for n, centre in enumerate(centres)]
    return sorted((text(i), *reversed(find(v))) for i, v in kept), centres


def vectors(n, dim, rng):
    hubs = [[rng.uniform(-3, 3) for _ in range(dim)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.4) for x in rng.choice(hubs)]) for i in range(n)]
    rows += [(7, rows[3][1]), (None, rows[4][1]), (None, [0.5] * dim), (901, None), (902, [1.0] * (dim - 1)), (903, [float("nan")] * dim), (904, [float("inf")] + [0.0] * (dim - 1)), (905, [None] + [0.0] * (dim - 1)), (906, [])]
    return rows + [(1000 + i, rows[9][1]) for i in range(60)]  # a third of all rows are one vector


@pytest.mark.parametrize("kind, big", [("float", 0), ("double", 0), ("double", 1e12)])
def test_clusters_are_those_of_plain_rounds(spark, kind, big):
    rng, dim = random.Random(11), 6
    rows = vectors(150, dim, rng) + ([(2000, [big] * dim), (2001, [big, -big, 3.0, 0.0, 0.0, big])] if big else [])
    if kind == "float":
        rows = [(i, v and [None if x is None else float(f"{x:.3g}") for x in v]) for i, v in rows]
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    seen = [(r.vec_id, r.embedding) for r in table.collect()]
    got, centres = deltalloyd.cluster(table.withColumns({"cluster": F.lit("x"), "row": F.lit(1), "id": F.lit(2), "v": F.lit(3)}), k=4, rounds=6, dim=dim)
    want, want_centres = lloyd(seen, 4, 6, dim)
    assert centres == want_centres
    assert sorted(("" if r.vec_id is None else str(r.vec_id), r.cluster, r.distance) for r in got.collect()) == [(i, c, min(d, deltalloyd.LONG)) for i, c, d in want]
    rows = deltalloyd.described(got, centres).collect()
    sums = collections.Counter()
    for _, c, d in want:
        sums[c] += d
    for r in rows:
        assert r.cluster_inertia == min(sums[r.cluster], deltalloyd.LONG) and r.inertia == min(sum(sums.values()), deltalloyd.LONG)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest()


def test_clusters_of_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    got, centres = deltalloyd.cluster(spark.createDataFrame([(1, [0.0, 1.0]), (2, [5.0, 5.0])], schema), k=8, dim=2)
    assert len(centres) == 2 and {(r.vec_id, r.distance) for r in got.collect()} == {(1, 0), (2, 0)}
    got, centres = deltalloyd.cluster(spark.createDataFrame([(1, None)], schema), dim=2)
    assert centres == [] and deltalloyd.described(got, centres).collect() == []


def test_rounds_read_buckets_as_they_lie(spark):
    from driftlens.llm.workspace import Workspace

    space, name = Workspace(spark, "plan"), "spark.sql.autoBroadcastJoinThreshold"
    held = space.keep_bucketed(spark.range(1000).select(F.col("id").alias("row"), F.array("id").alias("v")).repartition(4, "row"), "vectors", 4, "row")
    passed = space.keep_bucketed(spark.range(1000).select(F.lit(0).alias("kind"), F.col("id").alias("row"), F.lit(1).alias("owner")).repartition(4, "row"), "pass", 4, "row", partition_by="kind")
    before, ordering = spark.conf.get(name), "spark.sql.legacy.bucketedTableScan.outputOrdering"
    spark.conf.set(name, "-1")
    spark.conf.set(ordering, "true")
    try:
        joined = held.join(passed.where("kind = 0").select("row", "owner"), "row")
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
        spark.conf.set(ordering, "false")
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    space.drop_all_bucketed()


# --- op12 ------------------------------------------------------------------------------------------------------------

WHITE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if draw == 0:
            continue
        text = "" if draw == 1 else "".join(c for c in text if c not in ".!?") if draw == 2 else text
        out += [(conv, turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    return out


def cheapest(letters):
    """Dijkstra over (turns taken, state) with whole audits: (cost, audit)."""
    queue, seen = [(0, "", 0, 0)], set()
    while queue:
        cost, audit, i, state = heapq.heappop(queue)
        if i == len(letters) and state in (0, 3):
            return cost, audit
        if (i, state) in seen:
            continue
        seen.add((i, state))
        for initial, j in turnscan.NEXT[state].items():
            if initial in "ua":
                heapq.heappush(queue, (cost + 2, audit + "I", i, j))
        if i < len(letters):
            initial, truncated, gone = letters[i]
            heapq.heappush(queue, (cost + 3, audit + "D", i + 1, state))
            for want, j in {} if gone else turnscan.NEXT[state].items():
                if want == initial:
                    heapq.heappush(queue, (cost + truncated, audit + "K", i + 1, j))
                if want in "ua":
                    heapq.heappush(queue, (cost + 2 + truncated, audit + "R", i + 1, j))


def reported(rows):
    groups, out = collections.defaultdict(list), {}
    for r in damage(rows):
        groups[r[0]].append(r)
    for conv in {r[0] for r in rows}:
        turns = sorted(groups[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        faults, seen, letters = collections.Counter(), set(), []
        for _, _, role, text in turns:
            fault = "blank" if not text.strip(WHITE) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(WHITE)[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            letters.append((role[:1], fault == "truncated", fault in ("blank", "duplicate")))
        numbers = [r[1] for r in turns if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
        cost, audit = cheapest(letters)
        lines, k, state = [], 0, 0
        for edit in audit:
            if edit != "D":
                initial = turns[k][2][0] if edit == "K" else "a" if state == 2 else "u"
                role = turns[k][2] if edit == "K" else {"u": "user", "a": "assistant"}[initial]
                lines.append(f"{role}:{'' if edit == 'I' else turns[k][3]}")
                state = turnscan.NEXT[state][initial]
            k += edit != "I"
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def exchanges(rng, convs, most):
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No", " \t", "", None, "é\n", "Ok! \n", f"{rng.random()}", f"{rng.random()}?", "ü.", " "])
            rows.append((c, rng.choice([t, t, t, t + 3, None]), role, text))
    return rows + [(None, 1, "user", "a."), (None, None, "assistant", "b."), (None, 2, None, "c")]


@pytest.mark.parametrize("bits", [10, 2])
def test_repairs_are_the_cheapest(spark, monkeypatch, bits):
    monkeypatch.setattr(turnscan, "BLOCK_BITS", bits)
    monkeypatch.setattr(turnscan, "FAN_BITS", 1 if bits == 2 else 4)
    rows = exchanges(random.Random(5), 60, 12) + [(1000, t, "user", "same.") for t in range(150)] + [(1001, t, random.Random(t).choice(["user", "assistant"]), f"{t}.") for t in range(200)]
    rows += [(c, t, "user", "x.") for c, t in [(5000 + k, 1) for k in range(60)]]  # some lose their only turn
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"conv": F.lit(1), "at": F.lit("x"), "letter": F.lit(2), "cost": F.lit(3)}).repartition(5)
    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {r.conv_id: tuple(r[c] for c in columns) for r in turnscan.report(table).collect()}
    want = reported(rows)
    assert {k: v for k, v in got.items() if v != want.get(k)} == {} and set(got) == set(want)
    assert any(v[6] == "" for v in want.values())


def test_one_long_conversation_spans_blocks_and_tasks(spark):
    rng = random.Random(8)
    rows = [("c", t, rng.choice(["user", "assistant", "system"]), f"{t}{rng.choice(['.', ''])}") for t in range(20_000)]
    done = turnscan.repair(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").repartition(7))
    row = done.summary.first()
    assert row.audit.replace("I", "").__len__() == 20_000
    edits = {"K": 0, "R": 2, "D": 3, "I": 2}
    kept = done.turns.where("edit IN ('K', 'R') AND NOT rlike(text, '[.]$')").count()
    assert row.cost == sum(edits[e] for e in row.audit) + kept
    roles = "".join(r.role[0] for r in done.turns.where("edit <> 'D'").orderBy("place").collect())
    assert roles.lstrip("s").replace("ua", "") == "" and roles.count("s") <= 1
    letters = [(r[2][0], not r[3].endswith("."), False) for r in rows[:400]]
    assert turnscan.best(turnscan.product([turnscan.TURNS[a.upper() if b else a] for a, b, _ in letters])) == cheapest(letters)


def test_products_of_turns_are_associative():
    rng = random.Random(2)
    for _ in range(50):
        m = [turnscan.TURNS[rng.choice(turnscan.LETTERS + turnscan.GONE)] for _ in range(9)]
        k = rng.randint(1, 8)
        line = m[0]
        for x in m[1:]:
            line = turnscan.times(line, x)
        assert turnscan.product(m) == line == turnscan.times(turnscan.product(m[:k]), turnscan.product(m[k:]))


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turnscan.report(empty).collect() == []


# --- op13 ------------------------------------------------------------------------------------------------------------


def targets(sizes, weights, budget=1.5, most=2):
    """Shares by weight; what is over goes round again until none is above."""
    total, full = budget * sum(sizes), set()
    while True:
        left = total - sum(most * sizes[k] for k in full)
        weight = sum(w for k, w in enumerate(weights) if k not in full)
        share = [most * s if k in full else left * w / weight if weight else 0 for k, (s, w) in enumerate(zip(sizes, weights))]
        over = {k for k, s in enumerate(sizes) if share[k] > most * s and k not in full}
        if not over:
            return share
        full |= over


def corpus(rng, n=300):
    rows = []
    for i in range(n):
        source = rng.choice(["big"] * 10 + ["é", "Z", "a", "", None, "tiny"])
        text = rng.choice([None, "", " \t "]) if i % 29 == 0 else " ".join("w" * rng.randint(1, 5) for _ in range(rng.choice([1, 5, 40, 900]) if source != "tiny" else 2))
        rows.append((None if i % 37 == 0 else i % 250, text, source))
    return rows + [(5, "a b c\x0bd", "a"), (6, "x " * 50_000, "Z")] + [(9, "same text here", "big")] * 20


def test_mix_meets_its_targets(spark):
    rows = corpus(random.Random(1))
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit("x"), "target": F.lit(1), "name": F.lit(2), "pass": F.lit(3), "row": F.lit(4), "__at": F.lit(5)})
    order = curriculum.training_order(table.repartition(6))
    got = curriculum.taken_words(order).collect()
    names = sorted({s for _, _, s in rows if s is not None}, key=lambda s: [ord(c) for c in s]) + [None]
    words = lambda t: len([w for w in (t or "").replace("\t", " ").replace("\x0b", " ").split(" ") if w])
    sizes = [sum(words(t) for _, t, s in rows if s == name) for name in names]
    want = dict(zip(zip(sizes, names), targets(sizes, [[3, 1, 2][k % 3] for k in range(len(names))])))
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), words(t)) for i, t, _ in rows)
    assert len(set(sizes)) == len(sizes)
    for (size, _), target in want.items():
        of = [r for r in got if r.source_size == size]
        assert all(abs(r.target - target) < 1e-6 * max(1, target) and 0 <= r.taken <= 2 * r.size for r in of)
        assert abs(sum(r.taken for r in of) - target) <= 1
    key = lambda rows: sorted((str(r.doc_id), r.size, r.source_size, r.taken) for r in rows)
    again = curriculum.taken_words(curriculum.training_order(table.orderBy(F.rand(3)).repartition(3))).collect()
    assert key(again) == key(got)


def test_training_order_follows_the_schedules(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(1, 30), f"s{i % 3}") for i in range(1500)]
    order = curriculum.training_order(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    taken = order.join(spark.createDataFrame([(i, s) for i, _, s in rows], "doc_id long, source string"), "doc_id").where("words > 0").collect()
    for source, points in zip(("s0", "s1", "s2"), curriculum.SCHEDULES):
        mine = [r for r in taken if r.source == source]
        whole, area = sum(r.words for r in mine), curriculum.areas(points)[-1]
        for t in (0.1, 0.25, 0.5, 0.8):
            asked = 0.0
            for k in range(1000):  # midpoint sums
                u = t * (k + 0.5) / 1000
                (a, w), (b, x) = next((p, q) for p, q in zip(points, points[1:]) if p[0] <= u <= q[0])
                asked += (w + (x - w) * (u - a) / (b - a)) * t / 1000
            assert abs(sum(r.words for r in mine if r.position < t) - whole * asked / area) <= 31
    positions = [r.position for r in order.collect()]
    assert positions == sorted(positions, key=lambda p: (p is None, p))
    assert all(0 <= p <= 1 for p in positions if p is not None)


def test_mix_of_nothing(spark):
    schema = "doc_id long, text string, source string"
    assert curriculum.taken_words(curriculum.training_order(spark.createDataFrame([], schema))).collect() == []
    got = curriculum.taken_words(curriculum.training_order(spark.createDataFrame([(1, None, None), (2, "", "a")], schema))).collect()
    assert {(r.doc_id, r.size, r.target, r.taken) for r in got} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}
    with pytest.raises(ValueError):
        curriculum.training_order(spark.createDataFrame([], schema), schedules=[[(0.0, 0.0), (1.0, 0.0)]])
