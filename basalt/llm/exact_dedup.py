"""Exact deduplication: 128-bit content hash, then a comparison of the bytes inside each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, materialize, row_hash, strip_space


def content_hash(normal: Column) -> Column:
    """128 bits of the normalised text."""
    return F.unhex(F.md5(normal.cast("binary")))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalize=strip_space,
    hash_fn=content_hash,
) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256, n_chars, th (a hash of the text as it stands).

    Texts are equal when their normalised forms have the same bytes.  Of equal texts, the row with the most
    code points in its original text stays, then the smallest id.

    1. Ids, hashes and lengths are written once; hashes that occur twice or more are counted with map-side
       combination, so a group that holds a third of all rows costs one row for each task.
    2. Only texts under such a hash are read again and grouped by hash *and bytes*.  Copies collapse before
       the shuffle.  A hash with several texts is a collision; its rows find their class by their bytes.
    3. Rows find their class by hash.

    Null texts count as empty and form a group.  Rows that repeat an id count as separate rows of the group;
    all rows of the id that stays are marked kept only once per (id, length): the copies of an identical row
    are told apart by nothing, so each carries the same mark.  A null id comes after all others; where the longest
    texts have no other, ``keep_id`` is null.  An empty table gives an empty result.  Other columns, whatever their
    names, are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), normalize(text).alias("normal"), F.length(text).alias("n_chars"), row_hash(text).alias("th"))
    rows = rows.withColumn("h", hash_fn(F.col("normal")))
    keys = materialize(rows.select("doc_id", "n_chars", "th", "h", F.sha2(F.col("normal"), 256).alias("text_sha256")), "dedup-keys")
    again = materialize(keys.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "dedup-again")
    classes = (
        rows.join(again, "h", "left_semi")
        .groupBy("h", "normal", "n_chars")
        .agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
        .groupBy("h", "normal")
        .agg(F.max_by("first_id", "n_chars").alias("keep_id"), F.max("n_chars").alias("keep_chars"), F.sum("n").alias("group_size"))
    )
    # The text goes with the class only where the hash has several.
    per_hash = classes.groupBy("h").agg(
        F.count("*").alias("n_classes"),
        F.first("keep_id").alias("keep_id"),
        F.first("keep_chars").alias("keep_chars"),
        F.first("group_size").alias("group_size"),
        F.lit(True).alias("grouped"),
    )
    per_hash = materialize(per_hash, "dedup-classes")
    found = keys.join(per_hash.where("n_classes = 1").drop("n_classes"), "h", "left")
    collided = per_hash.where("n_classes > 1").select("h")
    if not collided.isEmpty():
        sure = found.join(collided, "h", "left_anti")
        mixed = rows.join(collided, "h", "left_semi")
        mixed = mixed.withColumn("text_sha256", F.sha2(F.col("normal"), 256)).join(classes.withColumn("grouped", F.lit(True)), ["h", "normal"])
        found = sure.unionByName(mixed.select(*sure.columns))
    keep = F.when(F.col("grouped"), F.col("keep_id")).otherwise(F.col("doc_id"))  # the id that stays may be null
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep) & F.col("n_chars").eqNullSafe(F.coalesce("keep_chars", "n_chars"))).alias("kept"),
        "text_sha256",
        F.col("n_chars").cast("long").alias("n_chars"),
        "th",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of equal texts, with all its columns: the one that ``exact_dedup`` keeps.

    Rows that repeat the id that stays, and its length, are one row too.
    """
    stays = exact_dedup(docs, id_col, text_col).where("kept")
    return keep_rows(docs, stays.groupBy("text_sha256").agg(F.first("doc_id").alias("doc_id"), F.min("th").alias("th")), id_col, text_col)
