"""Quotation linking for messages, with DataFrame functions only.

Quoted lines start with one ``>`` for each level (``> >`` and ``>>`` alike). Runs of lines of
one level are passages; a passage's normalised lines are hashed and joined with the hashes of
what the messages say themselves: the runs of their own lines that begin like a passage and have
as many lines. So a quotation of any consecutive lines meets its original.

The hash of a run of s lines is that of its first and its last 2^k lines, 2^k being the largest power
that is at most s; those of 2^k lines come from those of half as many. So each line has
one hash a power, and a run costs the same however many lines it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.llm.workspace import Workspace

MARKS = r"^((?:[ \t]*>)+)[ \t]?"
MESSAGE = ["msg", "conv_id", "turn"]


def level_of(line: Column) -> Column:
    """Quote level of a line: the number of leading > marks, 0 for the message's own words."""
    return F.char_length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", ""))


def normalised(text: Column) -> Column:
    """Lower case, white space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def hashed(*columns: Column | str) -> list[Column]:
    """Two independent 64-bit hashes."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)]


def with_powers(lines: DataFrame, key: list[str], most: int) -> DataFrame:
    """Add ``powers``: for k = 0, 1, ... the hashes of the 2^k lines from each on, up to runs of ``most`` lines. Lines have h1, h2 and pos.

    All windows are over the lines of one ``key`` in one order, so they are dealt out and sorted once.
    """
    window, names, k = Window.partitionBy(*key).orderBy("pos"), lines.columns, 0
    lines = lines.withColumns({"p0": F.col("h1"), "r0": F.col("h2")})
    while 2 << k <= most:
        nxt = lambda c: F.lead(c, 1 << k).over(window)  # noqa: B023, E731
        lines = lines.withColumns({f"p{k + 1}": F.xxhash64(f"p{k}", nxt(f"p{k}")), f"r{k + 1}": F.xxhash64(F.lit("second"), f"r{k}", nxt(f"r{k}"))})
        k += 1
    powers = F.array(*[F.struct(F.col(f"p{i}").alias("p"), F.col(f"r{i}").alias("r")) for i in range(k + 1)])
    return lines.select(*names, powers.alias("powers"))


def power_of(size: Column) -> Column:
    """The k of the largest 2^k that is at most ``size``."""
    return F.char_length(F.bin(size)) - 1


def tail_of(size: Column) -> Column:
    """How far from a run's first line its last 2^k lines begin."""
    return size - F.pow(F.lit(2.0), power_of(size)).cast("int")


def run_hashes(size: str, first: Column, last: Column) -> list[Column]:
    """The hashes of a run from those at its first line and at its tail."""
    return [F.xxhash64(size, first["p"], last["p"]).alias("h1"), F.xxhash64(F.lit("second"), size, first["r"], last["r"]).alias("h2")]


def numbered(messages: DataFrame, space: Workspace) -> DataFrame:
    """A table of the messages in which each row has a number of its own, fixed by being written."""
    rows = messages.select(F.monotonically_increasing_id().alias("msg"), F.col("conv_id"), F.col("turn"), F.col("role"), F.coalesce("text", F.lit("")).alias("text"))
    return space.keep(rows, "messages")


def passages(messages: DataFrame) -> DataFrame:
    """(msg, conv_id, turn, run, level, passage): runs of consecutive lines of one level, quoted or own.

    The window is over the lines of one message, never over a conversation.
    """
    lines = messages.select(*MESSAGE, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("level", level_of(F.col("line")))
    by_line = Window.partitionBy("msg").orderBy("pos")
    new = (F.col("level") != F.lag("level", 1, -1).over(by_line)).cast("int")
    runs = lines.withColumn("run", F.sum(new).over(by_line))
    line = F.struct("pos", F.regexp_replace("line", MARKS, "").alias("line"))
    return (runs.groupBy(*MESSAGE, "run", "level").agg(F.array_sort(F.collect_list(line)).alias("lines"))
            .select(*MESSAGE, "run", "level", F.array_join(F.col("lines.line"), "\n").alias("passage")))


def own_texts(messages: DataFrame) -> DataFrame:
    """Each message with ``own``: its text without quoted lines and without blank ends."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: level_of(x) == 0)
    return messages.withColumn("own", F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", ""))


def own_lines(text: Column) -> Column:
    """The normalised lines of a message's own words, without blank ones."""
    return spoken(F.filter(F.split(text, "\n", -1), lambda x: level_of(x) == 0))


def spoken(lines: Column) -> Column:
    return F.filter(F.transform(lines, normalised), lambda x: x != "")


def said_runs(messages: DataFrame, begins: DataFrame, most: int, space: Workspace) -> DataFrame:
    """(conv_id, turn, msg, h1, h2): hashes of the runs of own lines that a passage may quote.

    ``begins`` has the hash of the first line (head) and the number of lines (size) of every
    quoted passage, at most ``most``, so runs are made only where one begins.
    """
    lines = messages.select(*MESSAGE, own_lines(F.col("text")).alias("lines"))
    each = lines.select(*MESSAGE, F.size("lines").alias("n"), F.posexplode("lines").alias("pos", "line"))
    h1, h2 = hashed("line")
    each = with_powers(each.select(*MESSAGE, "n", "pos", h1.alias("h1"), h2.alias("h2")), ["msg"], most)
    each = space.keep(each.withColumnRenamed("h1", "head").drop("h2"), "own_lines")
    starts = each.join(begins, "head").where(F.col("pos") + F.col("size") <= F.col("n"))
    starts = starts.select(*MESSAGE, "size", F.get("powers", power_of(F.col("size"))).alias("first"), (F.col("pos") + tail_of(F.col("size"))).alias("pos"))
    ends = each.select("msg", "pos", "powers")
    runs = starts.join(ends, ["msg", "pos"]).select(*MESSAGE, *run_hashes("size", F.col("first"), F.get("powers", power_of(F.col("size")))))
    return runs.distinct()


def passage_hashes(quoted: DataFrame, most: int) -> DataFrame:
    """(msg, run, h1, h2, head) of passages (msg, run, lines)."""
    lines = quoted.select("msg", "run", F.size("lines").alias("size"), F.posexplode("lines").alias("pos", "line"))
    h1, h2 = hashed("line")
    lines = with_powers(lines.select("msg", "run", "size", "pos", h1.alias("h1"), h2.alias("h2")), ["msg", "run"], most)
    at = lambda pos: F.max(F.when(F.col("pos") == pos, F.get("powers", power_of(F.col("size")))))
    ends = lines.groupBy("msg", "run", "size").agg(at(F.lit(0)).alias("first"), at(tail_of(F.col("size"))).alias("last"), F.max(F.when(F.col("pos") == 0, F.col("h1"))).alias("head"))
    return ends.select("msg", "run", *run_hashes("size", F.col("first"), F.col("last")), "head")


def link_quotes(messages: DataFrame, space: Workspace | None = None) -> DataFrame:
    """(msg, conv_id, turn, run, level, from_msg, from_conv, from_turn) of every quoted passage with an original.

    The original is the earliest message of the same conversation, before the quoting one, that
    says the passage; else the earliest of all conversations other than the own one. Originals
    are cut to those of the two least conversations a hash before the join (one may be the own),
    so a passage that a third of all messages say makes one row a quotation. Messages without
    a conversation or turn are no originals.
    """
    space = space or Workspace(messages.sparkSession, "quotes")
    quoted = passages(messages).where(F.col("level") > 0).select(*MESSAGE, "run", "level", spoken(F.split("passage", "\n", -1)).alias("lines")).where(F.size("lines") > 0)
    quoted = space.keep(quoted.withColumn("size", F.size("lines")), "passages")
    most = quoted.agg(F.max("size")).first()[0] or 1
    hashes = passage_hashes(quoted, most)
    quoted = space.keep(quoted.drop("lines").join(hashes, ["msg", "run"]).select(*MESSAGE, "run", "level", "h1", "h2", "head", "size"), "quoted")
    said = said_runs(messages.where("conv_id is not null and turn is not null"), quoted.select("head", "size").distinct(), most, space)
    wanted = quoted.select("h1", "h2").distinct()
    said = space.keep(said.join(wanted, ["h1", "h2"], "left_semi"), "said")
    here = said.groupBy("conv_id", "h1", "h2").agg(F.min(F.struct("turn", "msg")).alias("here"))
    least = here.withColumn("nth", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("conv_id"))).where("nth <= 2")
    one = F.struct("conv_id", "here.turn", "here.msg")
    there = least.groupBy("h1", "h2").agg(F.min(one).alias("first"), F.max(one).alias("second"))
    both = quoted.drop("head", "size").join(here, ["conv_id", "h1", "h2"], "left").join(there, ["h1", "h2"], "left")
    both = both.withColumn("there", F.when(F.col("first.conv_id") != F.col("conv_id"), F.col("first")).otherwise(F.col("second")))
    own = F.col("here.turn") < F.col("turn")
    away = F.col("there.conv_id") != F.col("conv_id")
    choice = F.when(own, F.struct(F.col("conv_id").alias("c"), F.col("here.turn").alias("t"), F.col("here.msg").alias("m"))).when(away, F.struct(F.col("there.conv_id").alias("c"), F.col("there.turn").alias("t"), F.col("there.msg").alias("m")))
    return both.withColumn("choice", choice).where(F.col("choice").isNotNull()).select(*MESSAGE, "run", "level", F.col("choice.m").alias("from_msg"), F.col("choice.c").alias("from_conv"), F.col("choice.t").alias("from_turn"))


def quoted_schema(messages: DataFrame) -> str:
    kinds = dict(messages.dtypes)
    return f"msg long, conv_id {kinds['conv_id']}, turn {kinds['turn']}, run long, level int, h1 long, h2 long, head long, size int"


def roots(parents: DataFrame, space: Workspace) -> DataFrame:
    """(msg, root, depth) from (msg, parent), by doubling: each step joins every path with the next.

    A parent has a smaller turn, so there are no cycles and the steps end.
    """
    now, k = space.keep(parents.select("msg", F.col("parent").alias("root"), F.lit(1).alias("depth")), "paths0"), 0
    while True:
        k += 1
        up = now.select(F.col("msg").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        new = space.keep(now.join(up, "root", "left").select("msg", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")), f"paths{k}")
        if new.where("moved").isEmpty():
            return new.drop("moved")
        now = new.drop("moved")


def positions(rows: DataFrame, group: str, order: list[str], space: Workspace) -> DataFrame:
    """Add ``position`` (from 0) by ``order`` within ``group``, however large one group is.

    Rows are dealt out by range, so a large group is spread over many tasks; each task numbers
    its share, and the shares before it are summed, one row for each task and group.
    """
    keys = [group, *order]
    dealt = space.keep(rows.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "dealt")
    share = dealt.groupBy("part", group).agg(F.count("*").alias("size"))
    before = share.withColumn("before", F.coalesce(F.sum("size").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("part", group).orderBy(*order)) - 1
    before = before.select("part", F.col(group).alias("of"), "before")
    inside = dealt.withColumn("within", within)
    return inside.join(before, (inside["part"] == before["part"]) & inside[group].eqNullSafe(before["of"])).withColumn("position", F.col("before") + F.col("within")).drop(before["part"]).drop("part", "of", "before", "within")


def reply_ordered(messages: DataFrame) -> DataFrame:
    """Conversations in reply order without quotes, a row for each message.

    ``conv_id``, ``position`` (reply order: by thread, then turn, so a reply follows what it
    answers), ``turn``, ``role``, ``text`` (own words), ``n_quotes`` (quoted passages), ``n_linked``,
    ``reply_to`` (turn of the message answered: the original, in the same conversation, of the
    least quote level, the latest of those; null if none), ``thread`` (turn of the message that
    the thread starts from) and ``depth``. Null and empty texts have empty text. Messages that
    repeat a conversation and turn are kept, each a message; null conversations and turns are
    kept and link with nothing. Other columns are not looked at.
    """
    space = Workspace(messages.sparkSession, "quotes")
    rows = numbered(messages, space)
    linked = space.keep(link_quotes(rows, space), "links")
    per_message = linked.groupBy("msg").agg(F.count("*").alias("n_linked"))
    parent = linked.where(F.col("from_conv") == F.col("conv_id")).groupBy("msg").agg(F.min(F.struct("level", (-F.col("from_turn")).alias("late"), "from_msg")).alias("best"))
    parent = space.keep(parent.select("msg", F.col("best.from_msg").alias("parent"), (-F.col("best.late")).alias("reply_to")), "parents")
    path = roots(parent, space)
    start = path.join(rows.select(F.col("msg").alias("root"), F.col("turn").alias("thread")), "root").select("msg", "thread", "depth")
    quotes = space.read("quoted", quoted_schema(rows)).groupBy("msg").agg(F.count("*").alias("n_quotes"))
    out = own_texts(rows).join(per_message, "msg", "left").join(quotes, "msg", "left").join(parent.drop("parent"), "msg", "left").join(start, "msg", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = out.select("msg", "conv_id", "turn", "role", F.col("own").alias("text"), zero("n_quotes"), zero("n_linked"), "reply_to", F.coalesce("thread", "turn").alias("thread"), zero("depth"))
    return positions(out, "conv_id", ["thread", "turn", "msg"], space).select("conv_id", "position", "turn", "role", "text", "n_quotes", "n_linked", "reply_to", "thread", "depth")
