"""Classes of particles: best guesses, concentrations by class, agreement of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX = "probability_"


def probability_columns(particles: DataFrame) -> list[str]:
    return [c for c in particles.columns if c.startswith(PREFIX)]


def best_guess(columns: list[str]) -> tuple[Column, Column]:
    """Name and value of the largest probability; the first of equals; null if all are."""
    values = F.array(*[F.col(c) for c in columns])
    top = F.array_max(values)
    return F.get(F.array(*[F.lit(c) for c in columns]), (F.array_position(values, top) - 1).cast("int")), top


def with_best_guess(particles: DataFrame) -> DataFrame:
    name, value = best_guess(probability_columns(particles))
    return particles.withColumn("best_guess", name).withColumn("best_guess_value", value)


def per_class(particles: DataFrame, images: DataFrame, threshold: float, sample_volume: float) -> DataFrame:
    """Concentration by class of every image: the likeliest class if it reaches ``threshold``, else
    unclassified; particles with a null probability are left out; ``total`` is of those counted."""
    columns = probability_columns(particles)
    name, value = best_guess(columns)
    complete = particles.dropna("any", subset=columns).select("timestamp", F.when(value >= threshold, F.regexp_replace(name, PREFIX, "")).otherwise(F.lit("unclassified")).alias("class"))
    classes = [c.removeprefix(PREFIX) for c in columns] + ["unclassified"]
    found = complete.groupBy("timestamp").pivot("class", classes).count()
    out = images.join(found, "timestamp", "left")
    per_litre = [(F.coalesce(F.col(c), F.lit(0)) / sample_volume).alias(c) for c in classes]
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in classes), F.lit(0)) / sample_volume
    return out.select("timestamp", *per_litre, total.alias("total"))


def split_per_class(rows: DataFrame, label: str, identity: str, per_class: int, seed: int = 0) -> DataFrame:
    """Add ``part``: of each class min(per_class, n - 1) of its n identities, drawn by a hash, are for validation, the others for training.

    Rows that repeat an identity of a class go to the same part. The draw keeps ``per_class``
    identities a class before they meet, so a large class is in no one task. Rows without a class or an identity are for training.
    """
    draw = F.md5(F.concat(F.col(identity).cast("string"), F.lit(f"-{seed}")))
    each = rows.where(F.col(identity).isNotNull() & F.col(label).isNotNull()).select(label, identity).distinct()
    place = F.row_number().over(Window.partitionBy(label).orderBy("draw", identity))
    few = each.withColumn("draw", draw).withColumn("place", place).where(F.col("place") <= per_class)
    sizes = each.groupBy(label).agg(F.count("*").alias("size"))
    chosen = few.join(sizes, label).where(F.col("place") <= F.col("size") - 1).select(label, identity, F.lit("validation").alias("drawn"))
    return rows.join(chosen, [label, identity], "left").withColumn("part", F.coalesce("drawn", F.lit("training"))).drop("drawn")


def confusion(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """(truth, guess, n, share of the truth's rows)."""
    n = rows.groupBy(truth, guess).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(truth)))


def macro_f1(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """(macro_f1, agreement): mean F1 over the classes of the truth, share of equal labels."""
    n = rows.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count("*").alias("n"))
    by_t = n.groupBy(F.col("t").alias("c")).agg(F.sum("n").alias("in_t"), F.sum(F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0)).alias("hit"))
    by_g = n.groupBy(F.col("g").alias("c")).agg(F.sum("n").alias("in_g"))
    f1 = 2 * F.col("hit") / (F.col("in_t") + F.coalesce("in_g", F.lit(0)))
    return by_t.join(by_g, "c", "left").agg(F.avg(f1).alias("macro_f1"), (F.sum("hit") / F.sum("in_t")).alias("agreement"))
