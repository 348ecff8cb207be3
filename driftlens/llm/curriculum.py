"""Mixing sources to target weights under a time-varying curriculum, with DataFrame functions only.

A source's schedule is its weight as a function of training time from 0 to 1, linear between
given points. Its integral over all time is the source's weight in the mix, from which its
target follows; its integral up to t, scaled to the target, is how many of its words training has asked
for by then. A document stands in its source's stream at the number of words before it, so the time at
which it is due is the inverse of that curve. Sorting by that time gives the training order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.llm.workspace import Workspace
from driftlens.operators import ranks

#: Points (time, weight) of the schedules that sources take in turn; their integrals are 3, 1 and 2.
SCHEDULES = [[(0.0, 4.5), (1.0, 1.5)], [(0.0, 1.0), (1.0, 1.0)], [(0.0, 1.0), (0.5, 2.0), (1.0, 3.0)]]
WORD = r"[^\x20\x09-\x0D]+"


def areas(points: list[tuple[float, float]]) -> list[float]:
    """The integral of a schedule up to each of its points, by trapezoids."""
    out = [0.0]
    for (t, w), (u, x) in zip(points, points[1:]):
        out.append(out[-1] + (u - t) * (w + x) / 2)
    return out


def checked(schedules: list[list[tuple[float, float]]]) -> None:
    for points in schedules:
        times = [t for t, _ in points]
        if times[0] != 0 or times[-1] != 1 or any(a >= b for a, b in zip(times, times[1:])) or min(w for _, w in points) < 0 or areas(points)[-1] <= 0:
            raise ValueError("a schedule runs from 0 to 1 in ascending times, with weights of at least 0 and not all 0")


def due(share: Column, points: list[tuple[float, float]]) -> Column:
    """The time at which a schedule has asked for ``share`` (0..1) of its whole integral."""
    at = areas(points)
    value = share * at[-1]
    out = F.lit(1.0)
    for k in range(len(points) - 2, -1, -1):
        (t, w), (u, x) = points[k], points[k + 1]
        rest = F.greatest(value - at[k], F.lit(0.0))
        root = F.sqrt(F.greatest(w * w + 2 * (x - w) / (u - t) * rest, F.lit(0.0)))
        inside = F.when(w + root > 0, F.least(t + 2 * rest / (w + root), F.lit(u))).otherwise(F.lit(t))
        out = F.when(value < at[k + 1], inside).otherwise(out)
    return out


def water_level(sources: DataFrame, total: float, most: float) -> float:
    """The words for one unit of weight: targets stop at ``most`` times a source's size, and what is over goes to the others by weight, until none is above.

    Each round reads one row of sums.
    """
    level, stopped = 0.0, -1
    while True:
        above = F.col("source_size") * most < F.col("weight") * level
        row = sources.agg(F.count(F.when(above, 1)).alias("n"), F.coalesce(F.sum(F.when(above, F.col("source_size"))), F.lit(0)).alias("size"), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("weight")).first()
        if row.n == stopped or not row.weight:
            return level
        level, stopped = (total - most * row.size) / row.weight, row.n


def training_order(docs: DataFrame, schedules: list[list[tuple[float, float]]] = SCHEDULES, budget: float = 1.5, most: int = 2, salt: str = "13", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Every taken copy of a document, in the order of training.

    Columns: row (one number a row of ``docs``), the id, size (words of the text), source_size
    and target of its source, pass (0 is the first), words (that this copy gives) and position
    (the time from 0 to 1 at which it is due). Sources in the order of their code points, null
    last, take ``schedules`` in turn; together they are to give ``budget`` times all words, none
    over ``most`` times what it has. A source gives its documents in the order of
    md5(``salt``:id), again from the start when they end; the last one is cut where the target,
    rounded to whole words, is reached. Rows of which nothing is taken stand at the end, with
    words 0 and null pass and position. Rows with a null id count as one id for the order; rows
    that repeat an id are documents of their own; null texts have no words. Other columns are not read.
    Nothing depends on how rows are dealt, so reruns agree.
    """
    checked(schedules)
    spark = docs.sparkSession
    space = Workspace(spark, "curriculum")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).isNull().alias("none"), F.coalesce(F.col(source_col), F.lit("")).alias("name"), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    order = F.md5(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))
    rows = space.keep(rows.withColumns({"draw": order, "tie": F.monotonically_increasing_id()}), "sizes")
    table = ranks.dealt(rows, "none", "name", "draw", "size", "tie").drop("draw", "tie")
    group = ["none", "name"]
    sources = ranks.numbered(table.groupBy(*group).agg(F.sum("size").alias("source_size")), *group, name="rank")
    weights = F.array(*[F.lit(areas(p)[-1]) for p in schedules])
    sources = sources.withColumn("turn", (F.col("rank") % len(schedules)).cast("int"))
    sources = space.keep(sources.withColumn("weight", F.get(weights, "turn")), "sources")
    everything = int(sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level = water_level(sources, budget * everything, float(most))
    sources = sources.withColumn("target", F.least(F.col("source_size") * float(most), F.col("weight") * level))
    placed = ranks.running(table, F.col("size"), group, "before").join(sources.select(*group, "source_size", "turn", "target"), group)
    give = F.least(F.round("target").cast("long"), F.col("source_size") * most)

    def copy(k: int) -> Column:
        start = F.col("before") + F.col("source_size") * k
        words = F.greatest(F.least(give - start, F.col("size")), F.lit(0))
        share = start / F.nullif(give, F.lit(0).cast("long"))
        time = F.lit(None).cast("double")
        for turn, points in enumerate(schedules):
            time = F.when(F.col("turn") == turn, due(share, points)).otherwise(time)
        return F.when(words > 0, F.struct(F.lit(k).alias("pass"), words.alias("words"), time.alias("position")))

    nothing = F.struct(F.lit(None).cast("int").alias("pass"), F.lit(0).cast("long").alias("words"), F.lit(None).cast("double").alias("position"))
    copies = F.filter(F.array(*[copy(k) for k in range(most)]), lambda c: c.isNotNull())
    copies = F.when(F.size(copies) > 0, copies).otherwise(F.array(nothing))
    taken = placed.select(F.col(ranks.AT).alias("row"), F.col("id").alias(id_col), "size", "source_size", "target", F.explode(copies).alias("c"))
    taken = taken.select("row", id_col, "size", "source_size", "target", "c.*")
    by = [F.col("position").asc_nulls_last(), F.col("row")]
    return taken.repartitionByRange(*by).sortWithinPartitions(*by)


def taken_words(order: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, size, source_size, target, taken) of every row of the documents: words over all its copies in the training order."""
    return order.groupBy("row", id_col, "size", "source_size", "target").agg(F.sum("words").alias("taken")).drop("row")
