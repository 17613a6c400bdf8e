"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import all_columns, materialize, row_hash, unused, word_count

#: Weights dealt to the sources in order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)


def rank_weights(sources: DataFrame, key: str = "source", weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Adds ``weight``: the weights dealt in turn to the sources, by code point, null last.

    The table has one row for each source.  Ranges of it are numbered on their own and shifted by the rows of
    the ranges before, so no task sees all of it.
    """
    parts = max(1, min(64, sources.sparkSession.sparkContext.defaultParallelism))
    order = F.col(key).asc_nulls_last()
    ranged = materialize(sources.repartitionByRange(parts, order).withColumn("_range", F.spark_partition_id()), "mix-ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    shift = shift.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))  # one row for each range
    own = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    numbered = ranged.withColumn("_own", own).join(shift, "_range")
    turn = (F.col("_own") + F.col("_shift")) % len(weights)
    picked = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    return numbered.withColumn("weight", picked).drop("_range", "_own", "_shift")


def water_fill(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """Adds ``target``.  Needs ``source_size`` and ``weight``.

    Every round shares what is left among the sources that are not clamped, by weight, and clamps those whose
    share is above ``max_epochs`` times their size.  It ends when none is.  A round passes three numbers to the
    driver.  ``total`` above the sum of all caps clamps every source.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level, clamped = 0.0, -1
    while True:
        # A source is clamped at a level when its cap is under level x weight; the level only rises.
        over = (cap < F.col("weight") * F.lit(level)) if clamped >= 0 else F.lit(False)
        row = sources.agg(
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)).alias("capped"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("weight"),
            F.coalesce(F.sum(over.cast("long")), F.lit(0)).alias("n"),
        ).first()
        if row.n == clamped or row.weight == 0:
            break
        clamped, level = row.n, max(level, (total - row.capped) / row.weight)
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(float(level))))


def order_key(doc_id: Column, seed: int) -> Column:
    """A seeded random place in [0, 2^32) and the full key that orders documents in it."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = 1.5,
    max_epochs: float = 2.0,
    weights: tuple[float, ...] = WEIGHTS,
    seed: int = 17,
) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, weight, target, whole, repeats, taken, th (a hash of the text).

    ``share`` of all words is dealt to the sources by weight, clamped at ``max_epochs`` times a source's size.
    A source whose target is r times its size takes floor(r) whole repetitions of every document.  For the rest
    it takes documents once more in a seeded random order: those whose middle word, in that order, lies within
    the words still wanted.  So a source misses its target by half a document at most, and no document is taken
    more than ceil(max_epochs) times.

    The running sum that this needs is taken in about sqrt(n) seeded sections of each source and shifted by the
    sums of the sections before, so that a source with a third of all rows is spread over many tasks.

    Null texts have size 0 and take 0.  Null is a source of its own and comes last.  Repeated rows count each.
    A table with no words has targets 0.  Other columns, whatever their names, are ignored.
    """
    key = order_key(F.col("doc_id"), seed)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), row_hash(F.col(text_col)).alias("th"))
    rows = materialize(rows.withColumn("place", key), "mix-rows")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = materialize(rank_weights(sources, "source", weights), "mix-sources")
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    sources = water_fill(sources, total, max_epochs)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = sources.withColumn("whole", F.floor(rate)).withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))
    sources = materialize(sources.withColumn("sections", F.ceil(F.sqrt("n"))), "mix-targets")

    same = rows["source"].eqNullSafe(sources["source"])
    placed = rows.join(sources, same).drop(sources["source"])
    spot = F.conv(F.substring("place", 1, 8), 16, 10).cast("long")
    placed = placed.withColumn("section", F.floor(spot * F.col("sections") / F.lit(float(1 << 32))))
    sums = placed.groupBy("source", "section").agg(F.sum("size").alias("section_size"))
    before = Window.partitionBy("source").orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s2"), F.col("section").alias("k2"), F.coalesce(F.sum("section_size").over(before), F.lit(0)).alias("shift"))
    placed = placed.join(sums, placed["source"].eqNullSafe(sums["s2"]) & (placed["section"] == sums["k2"]))
    within = Window.partitionBy("source", "section").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("shift") + F.coalesce(F.sum("size").over(within), F.lit(0)) + F.col("size") / 2
    repeats = F.col("whole") + (middle < F.col("extra")).cast("long")
    return placed.withColumn("repeats", repeats).select(
        "doc_id", "source", "size", "source_size", "weight", "target", "whole", "repeats", (F.col("size") * F.col("repeats")).alias("taken"), "th"
    )


def repeat_rows(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents themselves, each as often as the mix takes it, one repetition after the other; columns as they were.

    Rows alike in id and text are taken as often as the one of them that is taken most.
    """
    th, key_id, key_th, repeats, copy = (unused(n, docs) for n in ("_th", "_key_id", "_key_th", "_repeats", "_copy"))
    times = mixed.where("repeats > 0").groupBy("doc_id", "th").agg(F.max("repeats").alias(repeats))
    times = times.select(F.col("doc_id").alias(key_id), F.col("th").alias(key_th), repeats)
    marked = docs.withColumn(th, row_hash(F.col(text_col)))
    joined = marked.join(times, F.col(id_col).eqNullSafe(F.col(key_id)) & (F.col(th) == F.col(key_th)))
    copies = F.explode(F.sequence(F.lit(1), F.col(repeats).cast("int"))).alias(copy)
    return joined.select(*all_columns(docs), copies).drop(copy)
