"""Line deduplication over levelled sorted runs of line hashes.

The store is a log-structured set of runs. A run is a table of distinct line hashes, bucketed
and sorted by hash, one file a bucket. A batch's distinct hashes are dealt out by the same
buckets once and merge-joined with the runs as these lie: a run is neither dealt out nor sorted
again. The batch drops what an earlier batch or a smaller document of its own holds, and
adds the hashes that no run has as a run of level 0. When a level has ``fan_out`` runs they are compacted
into one of the next level, two at a time: a task merges the same bucket of both and writes it as one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.llm.workspace import Workspace, as_buckets

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASHES = ["h1", "h2"]
#: Text of one batch, at most, and text whose line hashes make one bucket of a run.
BATCH_BYTES = 1 << 40
BUCKET_BYTES = 4 << 30


def lines_of(text: Column) -> Column:
    """The \\n-split lines of a text; null and empty have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends and with A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(WHITE)), UPPER, LOWER)


def key_hashes(key: Column) -> list[Column]:
    """Two independent 64-bit hashes; together they stand for the key."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


class LineRuns:
    """Levelled sorted runs of line hashes.

    ``fan_out`` runs of a level are compacted into one of the next. Every run is written to
    the shared folder before it is used, so the store survives lost executors.
    """

    def __init__(self, spark: SparkSession, space: Workspace, fan_out: int = 3, buckets: int = 16):
        self.spark, self.space, self.fan_out, self.buckets = spark, space, fan_out, buckets
        self.levels: list[list[str]] = []
        self.written = 0

    def _write(self, hashes: DataFrame, level: int) -> None:
        """``hashes`` come with a bucket's rows in one task."""
        name, self.written = f"line_run{self.written}", self.written + 1
        self.space.keep_bucketed(hashes.select(*HASHES), name, self.buckets, *HASHES)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def runs(self) -> list[DataFrame]:
        return [self.space.bucketed(name) for level in self.levels for name in level]

    def mark_known(self, lines: DataFrame, label: str) -> DataFrame:
        """Write distinct ``lines`` in the runs' buckets, with ``known``: whether an earlier batch holds the line."""
        return self.space.keep_bucketed(self.marked(lines), label, self.buckets, *HASHES)

    def marked(self, lines: DataFrame) -> DataFrame:
        known = F.lit(False)
        if self.buckets != int(self.spark.conf.get("spark.sql.shuffle.partitions")):  # else they lie so already
            lines = lines.repartition(self.buckets, *HASHES)
        for k, run in enumerate(self.runs()):
            mark = f"__run{k}"
            lines = lines.join(run.withColumn(mark, F.lit(True)), HASHES, "left")
            known = known | F.coalesce(F.col(mark), F.lit(False))
        return lines.withColumn("known", known).drop(*[f"__run{k}" for k in range(len(self.runs()))])

    def add(self, hashes: DataFrame) -> None:
        """Add a batch's new hashes, read from a table of the same buckets, as a run; compact full levels."""
        with as_buckets(self.spark):
            self._write(hashes, 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fan_out:
            full, self.levels[level] = self.levels[level], []
            while len(full) > 1:  # two at a time, the smaller ones first as they are the later ones
                one, other = full.pop(), full.pop()
                self._write(self.merged(one, other), level + 1)
                full.append(self.levels[level + 1].pop())
                self.space.drop_bucketed(one)
                self.space.drop_bucketed(other)
            self.levels[level + 1].append(full[0])
            level += 1

    def merged(self, one: str, other: str) -> DataFrame:
        """The hashes of two runs: a merge of their sorted buckets, each in one task."""
        return self.space.bucketed(one).hint("merge").join(self.space.bucketed(other), HASHES, "full_outer")

    def close(self) -> None:
        for level in self.levels:
            for name in level:
                self.space.drop_bucketed(name)
        self.levels = []


def batch_bounds(docs: DataFrame, batches: int, id_col: str, text_col: str) -> tuple[list, int]:
    """First ids of the batches after the first one, at even shares of the documents, and the bytes of all texts.

    At least ``batches``, and more where a batch would have over BATCH_BYTES. Bounds need not be
    exact: any bounds keep smaller ids in earlier batches.
    """
    total = int(docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0])
    n = max(batches, -(-total // BATCH_BYTES))
    bounds = docs.agg(F.percentile_approx(id_col, [k / n for k in range(1, n)])).first()[0] if n > 1 else None
    return sorted(set(bounds or [])), total


def duplicate_lines(docs: DataFrame, space: Workspace, min_chars: int = 10, batches: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, pos) of each document's lines that a smaller document holds; pos counts from 0.

    Documents go through the store in batches of ascending ids, which are numbers of any size.
    """
    spark = docs.sparkSession
    bounds, total = batch_bounds(docs, batches, id_col, text_col)
    key = F.col("key")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), lines_of(F.col(text_col)).alias("lines"))  # the text itself goes along with no line
    rows = (rows.select("id", "text_hash", F.posexplode("lines").alias("pos", "line"))
            .select("id", "text_hash", "pos", line_key(F.col("line")).alias("key")).where(F.char_length(key) >= min_chars))
    part = F.when(F.col("id").isNotNull(), sum([F.when(F.col("id") >= F.lit(x), 1).otherwise(0) for x in bounds], F.lit(0))).alias("batch")
    staged = space.keep(rows.select("id", "text_hash", "pos", *key_hashes(key), part), "lines", partition_by="batch")
    store = LineRuns(spark, space, buckets=max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES)))
    dropped = staged.select("id", "text_hash", "pos").limit(0)
    try:
        for k in range(len(bounds) + 1):
            batch = staged.where(F.col("batch") == k).select("id", "text_hash", "pos", *HASHES)
            firsts = store.mark_known(batch.groupBy(*HASHES).agg(F.min("id").alias("first"), F.max("id").alias("last")), f"firsts{k}")
            plain = space.read(space.tables[f"firsts{k}"], firsts.schema)  # not by buckets: the join with a very common line is one that can be split
            shared = plain.where(F.col("known") | (F.col("first") != F.col("last"))).select(*HASHES, F.when(~F.col("known"), F.col("first")).alias("holder"))
            hits = batch.join(shared, HASHES).where(F.col("holder").isNull() | (F.col("id") != F.col("holder"))).select("id", "text_hash", "pos")
            dropped = dropped.unionByName(space.keep(hits, f"dropped{k}"))
            if k < len(bounds):
                store.add(firsts.where(~F.col("known")))
            space.drop_bucketed(f"firsts{k}")
    finally:
        store.close()
        space.drop("lines")
    return dropped


def dedup_lines(docs: DataFrame, min_chars: int = 10, batches: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep each repeated line only in the smallest document that holds it.

    Returns all columns of ``docs`` (where named like a result, they give way to it), with ``text`` (the kept lines joined by \\n), ``n_lines`` and ``n_dropped``.
    Null and empty texts have one empty line, which stays. Lines whose key is shorter than
    ``min_chars`` code points always stay. A line that one document repeats, and no other
    holds, stays. Rows that repeat an id count as one document; a row without an id keeps its text and
    counts for no other. Ids are numbers. Work and memory grow in proportion to a text's lines.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "linededup")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col, "n_lines", "n_dropped")]
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*rest).alias("rest") if rest else F.lit(None).alias("rest"))
    dropped = duplicate_lines(docs, space, min_chars, batches, "id", "text")
    gone = dropped.groupBy("id", "text_hash").agg(F.collect_list("pos").alias("gone"))
    rows = docs.withColumn("text_hash", F.xxhash64("text")).join(gone, ["id", "text_hash"], "left")
    rows = rows.select("id", "rest", lines_of(F.col("text")).alias("lines"), "gone")
    lines = F.col("lines")
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    rows = rows.select("id", "rest", lines, F.when(F.col("gone").isNull(), lines).otherwise(F.transform(places, lambda i: F.get(lines, i))).alias("kept"))
    return rows.select(F.col("id").alias(id_col), F.array_join("kept", "\n").alias(text_col), F.size("lines").cast("long").alias("n_lines"),
                       (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), *(["rest.*"] if rest else []))
