"""Sharding by extendible hashing: a directory over hash-prefix bits that splits only what is too large."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Bits of the hash that a directory can use.
HASH_BITS = 63


def shard_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit_bytes: int = 8 << 20,
    seed: int = 29,
) -> DataFrame:
    """One row for each document: doc_id, n_bytes, depth, shard, shard_bytes, shard_docs.

    A document goes to the bucket of the first ``depth`` bits of its hash.  A bucket splits on its next bit as
    long as it holds more than ``limit_bytes`` of text in UTF-8; the others stay as they are.  ``shard`` is the
    bucket's bits as text ("" when all fit in one).

    Byte counts are first summed in fine cells, about eight for each limit, which combine map-side.  The cells
    roll up to shorter prefixes, a few bits at a time, and the directory holds the shortest prefixes that fit.  Cells
    that are still too large (a run of long documents) are split again with more bits until they fit.

    A bucket that cannot be split stays whole: a document larger than the limit has a shard of its own, as have
    rows whose 63 hash bits agree.  The hash takes id, length and content, so rows that only share an id part; exact
    repeats of a row stay together, and their shard may exceed the limit.  Null texts have 0 bytes and null ids
    hash like the empty text.  An empty table gives an empty result.  Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.xxhash64(text)), 64 - HASH_BITS)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), h.alias("h"))
    rows = materialize(rows, "shard-rows")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0

    cut = lambda bits: F.shiftrightunsigned(F.col("h"), HASH_BITS - bits)
    low, bits = 0, max(1, math.ceil(math.log2(max(1.0, 8 * total / limit_bytes))))
    open_rows, settled = rows, []
    while True:
        bits = min(bits, HASH_BITS)
        cells = open_rows.groupBy(cut(bits).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        cells = materialize(cells, "shard-cells")
        nodes = _prefix_sums(cells, low, bits)
        # A prefix fits when its bytes do, or when all in it share one hash value and cannot be split.  It is a leaf of
        # the directory when it fits and the prefix before it, one bit shorter, does not.
        fits = (F.col("shard_bytes") <= limit_bytes) | (F.col("lo") == F.col("hi"))
        parents = nodes.where(fits).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"))
        leaves = nodes.where(fits).withColumn("above", F.shiftright("prefix", 1)).join(parents, ["depth", "above"], "left_anti")
        shift = F.lit(bits) - F.col("depth")
        ends = [F.expr(f"shiftleft({p}, cast({bits} - depth as int))") for p in ("prefix", "prefix + 1")]
        within = F.when(shift == 0, F.array("prefix")).otherwise(F.sequence(ends[0], ends[1] - 1))
        directory = materialize(leaves.select(F.explode(within).alias("cell"), "depth", "prefix", "shard_bytes", "shard_docs"), "shard-directory")
        settled.append((bits, directory))
        more = cells.join(directory.select("cell"), "cell", "left_anti").select("cell")
        if bits == HASH_BITS or more.isEmpty():
            break
        open_rows = open_rows.join(more, cut(bits) == F.col("cell"), "left_semi")
        low, bits = bits + 1, bits + 6

    out, rest = [], rows
    for at, (bits, directory) in enumerate(settled):
        keyed = rest.withColumn("cell", cut(bits))
        out.append(keyed.join(directory, "cell").drop("cell"))
        if at + 1 < len(settled):
            rest = keyed.join(directory.select("cell"), "cell", "left_anti").drop("cell")
    found = out[0]
    for part in out[1:]:
        found = found.unionByName(part)
    name = F.when(F.col("depth") == 0, "").otherwise(F.expr("right(concat(repeat('0', 63), bin(prefix)), depth)"))
    return found.select("doc_id", "n_bytes", F.col("depth").cast("int").alias("depth"), name.alias("shard"), "shard_bytes", "shard_docs")


def _prefix_sums(cells: DataFrame, low: int, bits: int, step: int = 4) -> DataFrame:
    """(depth, prefix, shard_bytes, shard_docs, lo, hi) of every prefix of ``low`` to ``bits`` bits.

    Each level is summed from the next longer one that is written, so all levels together cost about ``step`` rows
    for each cell, whatever the number of bits.
    """
    sums = [F.sum("shard_bytes").alias("shard_bytes"), F.sum("shard_docs").alias("shard_docs"), F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    at = cells.select(F.lit(bits).alias("depth"), F.col("cell").alias("prefix"), F.col("b").alias("shard_bytes"), F.col("n").alias("shard_docs"), "lo", "hi")
    found, depth = at, bits
    while depth > low:
        to = max(low, depth - step)
        spread = at.withColumn("to", F.explode(F.sequence(F.lit(to), F.lit(depth - 1)))).withColumn("prefix", F.expr(f"shiftright(prefix, cast({depth} - to as int))"))
        level = materialize(spread.groupBy(F.col("to").alias("depth"), "prefix").agg(*sums), "shard-level")
        found, at, depth = found.unionByName(level), level.where(F.col("depth") == to), to
    return found


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Writes the documents as one folder for each shard; ids must be unique."""
    by = assigned.select(F.col("doc_id").alias("_id"), "shard")
    docs.join(by, docs[id_col] == F.col("_id")).drop("_id").repartition("shard").write.partitionBy("shard").parquet(path)
