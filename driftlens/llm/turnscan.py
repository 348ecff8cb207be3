"""Repair of conversation structure by a min-plus matrix scan.

A conversation is right when the initials of its roles are ``(s?(ua)+)?``. The automaton of that
pattern has four states, so a turn is a 4 x 4 matrix: in row i and column j stands the cheapest way to
go from state i to state j by keeping, re-roling or deleting the turn and then inserting any
number of empty turns (the insert closure). Entries are (cost, audit), the audit being the edits' initials; the smaller
pair wins and products add costs and join audits. Two ways of equal cost through the same turns never have
audits of which one begins with the other, since those would differ by inserts, which cost
something; so the order of audits is kept by joining on either side and the product is associative. Turns
are multiplied in blocks of neighbours, blocks in a tree, so a conversation of any length is
spread over tasks. The best audit is then cut at the blocks' borders, and each block is edited by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.llm.workspace import Workspace

# Costs of the edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NONWHITE = r"[^\x20\x09-\x0D]"
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn; ends in the first or the last.
NEXT = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
ENDS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
#: A turn is one letter: its initial (o for any other), a capital if it is truncated, the second row if it has to go.
LETTERS, GONE = "suaoSUAO", "1234"
#: Turns of a block, as a power of two, and blocks that one product of the tree takes.
BLOCK_BITS, FAN_BITS = 10, 4
Entry = tuple[int, str] | None
Matrix = list[list[Entry]]
ELEMENT = "costs array<long>, audits array<string>"


def times(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        row = out[i]
        for k in range(4):
            if (left := a[i][k]) is None:
                continue
            for j in range(4):
                if (right := b[k][j]) is not None:
                    way = (left[0] + right[0], left[1] + right[1])
                    if row[j] is None or way < row[j]:
                        row[j] = way
    return out


def unit() -> Matrix:
    return [[(0, "") if i == j else None for j in range(4)] for i in range(4)]


def closure() -> Matrix:
    """Any number of inserted turns. Ways of up to three cover all states; longer ones only come back."""
    once: Matrix = [[None] * 4 for _ in range(4)]
    for i, ways in enumerate(NEXT):
        for initial, j in ways.items():
            if initial in ROLES:
                once[i][j] = (INSERT, "I")
    out, power = unit(), unit()
    for _ in range(3):
        power = times(power, once)
        out = [[min((x for x in (a, b) if x is not None), default=None) for a, b in zip(r, s)] for r, s in zip(out, power)]
    return out


def turn_matrix(letter: str) -> Matrix:
    """What may be done with a turn, before inserts."""
    out: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        out[i][i] = (DELETE, "D")
        if letter in GONE:
            continue
        extra = TRUNCATED if letter.isupper() else 0
        for initial, j in NEXT[i].items():
            ways = [(extra, "K")] if initial == letter.lower() else []
            ways += [(REROLE + extra, "R")] if initial in ROLES else []
            if ways:
                out[i][j] = min(ways)
    return out


INSERTS = closure()
TURNS = {letter: times(turn_matrix(letter), INSERTS) for letter in LETTERS + GONE}


def product(matrices: list[Matrix]) -> Matrix:
    """The product in order, by halves, so that audits are joined a number of times that grows with the logarithm."""
    if not matrices:
        return unit()
    while len(matrices) > 1:
        matrices = [times(*matrices[k : k + 2]) if k + 1 < len(matrices) else matrices[k] for k in range(0, len(matrices), 2)]
    return matrices[0]


def best(whole: Matrix) -> tuple[int, str]:
    """The cheapest way from the start to an end, with inserts before the first turn."""
    first = times([INSERTS[0], [None] * 4, [None] * 4, [None] * 4], whole)[0]
    return min(first[j] for j in ENDS if first[j] is not None)


def _packed(m: Matrix) -> tuple[list, list]:
    flat = [x for row in m for x in row]
    return [x and x[0] for x in flat], [x and x[1] for x in flat]


def _unpacked(costs: list, audits: list) -> Matrix:
    flat = [None if c is None else (c, a) for c, a in zip(costs, audits)]
    return [flat[k : k + 4] for k in range(0, 16, 4)]


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the matrix of each block's letters."""
    for batch in batches:
        made = [_packed(product([TURNS[x] for x in letters])) for letters in batch.column("letters").to_pylist()]
        yield _with(batch.select(["conv", "block", "n"]), costs=pa.array([m[0] for m in made], pa.list_(pa.int64())), audits=pa.array([m[1] for m in made], pa.list_(pa.string())))


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The product of each row's list of elements."""
    for batch in batches:
        made = [_packed(product([_unpacked(e["costs"], e["audits"]) for e in row])) for row in batch.column("elements").to_pylist()]
        yield _with(batch.select(["conv", "k"]), costs=pa.array([m[0] for m in made], pa.list_(pa.int64())), audits=pa.array([m[1] for m in made], pa.list_(pa.string())))


def _with(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [best(_unpacked(c, a)) for c, a in zip(batch.column("costs").to_pylist(), batch.column("audits").to_pylist())]
        yield _with(batch.select(["conv"]), cost=pa.array([x[0] for x in found], pa.int64()), audit=pa.array([x[1] for x in found], pa.string()))


def cut(audit: str, blocks: list[str]) -> list[tuple[str, int, int]]:
    """The piece of the audit of each block of letters, the state before it, and how many turns the repaired conversation has by then.

    Inserts go with the turn before them, those before the first turn with the first block.
    """
    out, at, state, place = [], 0, 0, 0
    for letters in blocks:
        begin, before, passed, k = at, state, place, 0
        while at < len(audit) and (k < len(letters) or audit[at] == "I"):
            edit = audit[at]
            if edit != "D":
                initial = letters[k].lower() if edit == "K" else "u" if "u" in NEXT[state] else "a"
                state, place = NEXT[state][initial], place + 1
            k += edit != "I"
            at += 1
        out.append((audit[begin:at], before, passed))
    return out


def steps(piece: str, letters: str, state: int, place: int, first: int) -> Iterator[tuple[int, str, str | None, int]]:
    """(turn, edit, role, place) of a block's edits; an insert has the turn before it, or the first one where none is before."""
    k = 0
    for edit in piece:
        role = None
        if edit != "D":
            initial = letters[k].lower() if edit == "K" else "u" if "u" in NEXT[state] else "a"
            state, role = NEXT[state][initial], None if edit == "K" else ROLES[initial]
        yield first + (max(k - 1, 0) if edit == "I" else k), edit, role, place
        place += edit != "D"
        k += edit != "I"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a conversation's audit and blocks to a row for each block."""
    names = ["block", "first", "letters", "piece", "state", "place"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64()]
    for batch in batches:
        for audit, blocks in zip(batch.column("audit").to_pylist(), batch.column("blocks").to_pylist()):
            pieces = cut(audit, [b["letters"] for b in blocks])
            rows = [(b["block"], b["first"], b["letters"], *p) for b, p in zip(blocks, pieces)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=names)


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From blocks' pieces to a row for each edit."""
    names, kinds = ["at", "edit", "new_role", "place"], [pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        for r in batch.to_pylist():
            rows = list(steps(r["piece"], r["letters"], r["state"], r["place"], r["first"]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=names)


@dataclass
class Repair:
    """``summary``: a row a conversation with turns. ``turns``: the edits, with the turns as they were and their place in the repaired conversation."""

    summary: DataFrame
    turns: DataFrame


def letter_of(initial: Column, truncated: Column, gone: Column) -> Column:
    at = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(4)
    return F.when(gone, F.substring(F.lit(GONE), at, F.lit(1))).otherwise(F.substring(F.lit(LETTERS), at + F.when(truncated, 4).otherwise(0), F.lit(1)))


def with_faults(ordered: DataFrame, space: Workspace) -> DataFrame:
    """(conv, at, turn, blank, duplicate, truncated, initial, letter) of ordered turns, without their texts.

    A turn is a duplicate of one before it with the same role and text, compared by 128 bits of
    hashes; only the earliest of each is summed, so a text that fills a conversation meets in no one task.
    """
    last = F.regexp_extract("text", rf"({NONWHITE})[\x20\x09-\x0D]*+$", 1)
    slim = ordered.select("conv", "at", "turn", F.substring("role", 1, 1).alias("initial"), (~F.col("text").rlike(NONWHITE)).alias("blank"), (~last.isin(".", "!", "?")).alias("open"),
                          F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit("second"), "role", "text").alias("h2"))
    slim = space.keep(slim.withColumn("conv_hash", F.xxhash64("conv")), "slim")
    same = ["conv_hash", "conv", "h1", "h2"]
    again = slim.where("NOT blank").groupBy(*same).agg(F.min("at").alias("first_at"), F.count("*").alias("n")).where("n > 1")
    again = again.select(*[F.col(c).alias(f"r_{c}") for c in same], "first_at")
    on = F.lit(True)
    for c in same:
        on = on & (F.col(c).eqNullSafe(F.col(f"r_{c}")) if c == "conv" else F.col(c) == F.col(f"r_{c}"))
    rows = slim.join(again, on, "left")
    rows = rows.withColumn("duplicate", ~F.col("blank") & F.coalesce(F.col("at") > F.col("first_at"), F.lit(False)))
    rows = rows.withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & F.col("open"))
    return rows.select("conv", "at", "turn", "blank", "duplicate", "truncated", "initial", letter_of(F.col("initial"), F.col("truncated"), F.col("blank") | F.col("duplicate")).alias("letter"))


def reduced(elements: DataFrame, space: Workspace) -> DataFrame:
    """(conv, costs, audits): the ordered product of each conversation's blocks, as a tree of products of up to 2^FAN_BITS neighbours.

    Conversations of one block are passed on; each level of the others is a written table. How many
    levels there are depends on the longest conversation only.
    """
    counted = space.keep(elements.withColumn("k", F.row_number().over(Window.partitionBy("conv").orderBy("block")).cast("long") - 1), "level0")
    longest = 1 + (counted.agg(F.max("k")).first()[0] or 0)
    if longest <= 1:
        return counted.select("conv", "costs", "audits")
    blocks = counted.groupBy("conv").agg(F.max("k").alias("top"))
    counted = counted.join(blocks.select(F.col("conv").alias("c"), "top"), F.col("conv").eqNullSafe(F.col("c"))).drop("c")
    done = counted.where("top = 0").select("conv", "costs", "audits")
    level = counted.where("top > 0").select("conv", "k", "costs", "audits")
    depth = 0
    while longest > 1:
        depth += 1
        element = F.struct("k", "costs", "audits")
        groups = level.groupBy("conv", F.shiftright("k", FAN_BITS).alias("up")).agg(F.sort_array(F.collect_list(element)).alias("elements"))  # at most 2^FAN_BITS
        conv = elements.schema["conv"].dataType.simpleString()
        level = space.keep(groups.select("conv", F.col("up").alias("k"), "elements").mapInArrow(_products, f"conv {conv}, k long, {ELEMENT}"), f"level{depth}")
        longest = -(-longest >> FAN_BITS)
    return done.unionByName(level.select("conv", "costs", "audits"))


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repair:
    """Find the cheapest edits that make every conversation's roles ``(s?(ua)+)?``.

    Turns are taken by number, null ones first, then by role and text where numbers are equal.
    Null roles and texts count as empty. The first fault of a turn counts: blank (only white
    space), duplicate (role and text of an earlier turn of the conversation), truncated (the
    last character but white space is not ``.``, ``!`` or ``?``). Blank and duplicate turns are deleted (3), others are kept (0),
    given the role user or assistant (2) or deleted (3); truncated ones that stay cost 1 more; empty user and
    assistant turns may stand anywhere (2). Of the cheapest edits those with the least audit are
    taken. Turns with a null conversation are one conversation. Other columns are not read.

    ``summary``: conv, gaps (numbers missing between the first and the last, null if they do not
    fit 64 bits), blank, duplicate, truncated, illegal (neighbours other than system-user,
    user-assistant and assistant-user), cost, audit. ``turns``: conv, place, edit, role, text, turn; deleted turns have the place of the next one that stays.
    """
    spark = turns.sparkSession
    space = Workspace(spark, "turnscan")
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    by = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("tie")]
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by).select("conv", "turn", "role", "text", F.monotonically_increasing_id().alias("at"))
    ordered = space.keep(ordered, "ordered")
    faults = space.keep(with_faults(ordered, space), "faults")
    conv = turns.schema[conv_col].dataType.simpleString()
    block = F.shiftright("at", BLOCK_BITS)
    letters = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "letter"))), lambda x: x["letter"]), "")  # at most 2^BLOCK_BITS
    initials = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "initial"))), lambda x: F.when(x["initial"].isin("s", "u", "a"), x["initial"]).otherwise("o")), "")
    counts = [F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated")]
    blocks = faults.groupBy("conv", block.alias("block")).agg(F.min("at").alias("first"), F.count("*").alias("n"), letters.alias("letters"), initials.alias("initials"), *counts)
    blocks = space.keep(blocks, "blocks")
    elements = blocks.select("conv", "block", "n", "letters").mapInArrow(_elements, f"conv {conv}, block long, n long, {ELEMENT}")
    found = reduced(elements, space).mapInArrow(_best, f"conv {conv}, cost long, audit string")
    found = space.keep(found, "found")
    whole = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", c))), lambda x: x[c]), "")
    per_conv = blocks.groupBy("conv").agg(whole("initials").alias("initials"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    pairs = F.char_length("initials") - 1 - sum((F.regexp_count("initials", F.lit(p)) for p in ("s(?=u)", "u(?=a)", "a(?=u)")), F.lit(0))
    numbers = faults.groupBy("conv").agg(F.max("turn").alias("hi"), F.min("turn").alias("lo"), F.count_distinct("turn").alias("n"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    gaps = F.coalesce((wide("hi") - wide("lo") + 1 - F.col("n")).try_cast("long"), F.when(F.col("n") == 0, F.lit(0).cast("long")))
    pieces = [per_conv.select("conv", "blank", "duplicate", "truncated", pairs.cast("long").alias("illegal")), numbers.select("conv", gaps.alias("gaps")), found]
    joined = pieces[0]
    for more in pieces[1:]:
        joined = joined.unionByName(more, allowMissingColumns=True)
    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    summary = joined.groupBy("conv").agg(*[F.max(c).alias(c) for c in columns])  # a union by group instead of joins: null conversations meet
    listed = blocks.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "first", "letters"))).alias("blocks"))
    audits = listed.unionByName(found.select("conv", "audit"), allowMissingColumns=True).groupBy("conv").agg(F.max("audit").alias("audit"), F.first("blocks", ignorenulls=True).alias("blocks"))
    pieces = audits.select("audit", "blocks").mapInArrow(_pieces, "block long, first long, letters string, piece string, state int, place long")
    edits = space.keep(pieces.mapInArrow(_edits, "at long, edit string, new_role string, place long"), "edits")
    given = ordered.join(edits, "at")
    inserted = F.col("edit") == "I"
    out = given.select("conv", "place", "edit", F.coalesce("new_role", "role").alias("role"), F.when(inserted, F.lit("")).otherwise(F.col("text")).alias("text"), F.when(~inserted, F.col("turn")).alias("turn"))
    return Repair(summary.withColumnRenamed("conv", conv_col), out.withColumnRenamed("conv", conv_col))


def damaged(turns: DataFrame) -> DataFrame:
    """The table with known faults, by crc32(conv_id:turn) % 20: 0 drops the turn, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes it the user's. Null roles and texts, and nulls in the key, are one space."""
    space = F.lit(" ")
    word = lambda c: F.coalesce(F.col(c).cast("string"), space)
    draw = F.crc32(F.concat_ws(":", word("conv_id"), word("turn")).cast("binary")) % 20
    text = F.when(draw == 1, F.lit("")).when(draw == 2, F.regexp_replace(word("text"), "[.!?]", "")).otherwise(word("text"))
    rows = turns.select("conv_id", "turn", F.when(draw == 4, F.lit("user")).otherwise(word("role")).alias("role"), text.alias("text"), F.when(draw == 3, 2).otherwise(1).alias("copies"), draw.alias("draw")).where("draw <> 0")
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).drop("copy")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, digest) of the lines of sorted turns; holds one hash at a time."""
    held, state, kind = None, None, None
    for batch in batches:
        convs, convs_type = batch.column("conv").to_pylist(), batch.schema.field("conv").type
        kind, out = convs_type, []
        for conv, line in zip(convs, batch.column("line").to_pylist()):
            if state is not None and conv == held:
                state.update(b"\n")
            else:
                if state is not None:
                    out.append((held, state.hexdigest()))
                held, state = conv, sha256()
            state.update(line.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], kind), pa.array([d for _, d in out])], names=["conv", "digest"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held], kind), pa.array([state.hexdigest()])], names=["conv", "digest"])


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``role:text`` of the turns that stay, joined by \\n.

    A digest runs through a conversation from its first byte to its last, so one task streams
    over all of it; it holds a batch of rows.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    lines = turns.where("edit <> 'D'").select(F.col("conv_id").alias("conv"), "place", F.concat_ws(":", "role", "text").alias("line"))
    lines = lines.repartition("conv").sortWithinPartitions("conv", "place").select("conv", "line")
    return lines.mapInArrow(_digests, f"conv {kind}, digest string").withColumnsRenamed({"conv": "conv_id", "digest": "repaired_sha256"})


def report(turns: DataFrame) -> DataFrame:
    """A row for every conversation of ``turns`` after damage and repair, with the digest of what is left; zeros, an empty audit and the digest of nothing where no turn is."""
    done = repair(damaged(turns))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    every = turns.select("conv_id").distinct().select("conv_id", *[F.lit(0).cast("long").alias(c) for c in counts], F.lit("").alias("audit"))
    both = every.unionByName(done.summary).unionByName(digests(done.turns), allowMissingColumns=True)
    nothing = F.lit(sha256().hexdigest())
    return both.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in counts], F.max("audit").alias("audit"), F.coalesce(F.max("repaired_sha256"), nothing).alias("repaired_sha256"))
