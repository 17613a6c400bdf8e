"""Helpers that the training-text operators share: shared storage, Arrow buffers, ordering, components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize, new_path

#: White space as every operator here understands it: space and U+0009 to U+000D.
SPACE_CHARS = "\x20\x09\x0a\x0b\x0c\x0d"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
WORD_CLASS = "[^\\x20\\x09-\\x0D]"
#: Edges that a task connects by itself before any meet in a shuffle: 4 MB of them.
MOST_EDGES = 1 << 18


def strip_space(text: Column) -> Column:
    """The text without any white space; byte-wise replacement stays inside code generation."""
    for c in SPACE_CHARS:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-space characters; null counts as empty."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), WORD_CLASS + "+", "x")
    return F.length(strip_space(marks)).cast("long")


def crc_fold(doc_id: Column) -> Column:
    """crc32 of the id written as text, modulo 3; fold 1 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column without copying; nulls are empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], width)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data, offsets


def each_text(column):
    """The texts of an Arrow string column as bytes objects, one at a time."""
    data, offsets = text_buffers(column)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield data[a:b].tobytes()


def slices(batches, rows: int = 512):
    """Arrow batches cut so that a few hundred texts are in work at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def row_hash(text: Column) -> Column:
    """A hash of a text as it stands; with the id it names a row, and rows that share both are alike."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def unused(name: str, *frames: DataFrame) -> str:
    """A column name that none of the tables has, in any case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def all_columns(df: DataFrame) -> list[Column]:
    """A table's columns, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def keep_rows(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose (doc_id, th) is among the keys, with their own columns; of rows alike in both, one."""
    th, key_id, key_th, copy = (unused(n, docs) for n in ("_th", "_key_id", "_key_th", "_copy"))
    wanted = keys.select(F.col("doc_id").alias(key_id), F.col("th").alias(key_th)).distinct()
    marked = docs.withColumn(th, row_hash(F.col(text_col)))
    found = marked.join(wanted, F.col(id_col).eqNullSafe(F.col(key_id)) & (F.col(th) == F.col(key_th)), "left_semi")
    first = F.row_number().over(Window.partitionBy(id_col, th).orderBy(F.lit(0)))
    return found.withColumn(copy, first).where(F.col(copy) == 1).select(*all_columns(docs))


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its part) for every node of the edges."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            further = root[root]
            if np.array_equal(further, root):
                break
            root = further
    return nodes, nodes[root]


def _contracted(roots: bool):
    """Edges to (node, smallest node that a task's edges connect it to), by at most twice MOST_EDGES rows at a time."""

    def work(batches):
        import pyarrow as pa

        held: list[np.ndarray] = []

        def solve():
            u, v = forest(*np.concatenate(held, axis=1))
            keep = slice(None) if roots else u != v
            return pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], ["u", "v"])

        for batch in slices(batches, MOST_EDGES):
            held.append(np.stack([np.asarray(c) for c in batch.columns]))
            if sum(h.shape[1] for h in held) > MOST_EDGES:
                yield solve()
                held = []
        if held:
            yield solve()

    return work


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the edges; the component is its smallest node.

    Each task first connects the edges it has, which leaves an edge for each of its nodes, and as few tasks as the
    edges need (``MOST_EDGES``) do so again while that halves them.  What one task holds is then done; the rest goes on as
    ``_star_components``.
    """
    pairs = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    pairs = materialize(pairs.mapInArrow(_contracted(False), "u long, v long"), "cc")
    count = pairs.count()
    while True:
        tasks = max(1, -(-count // MOST_EDGES))
        pairs = materialize(pairs.coalesce(tasks).mapInArrow(_contracted(tasks == 1), "u long, v long"), "cc")
        if tasks == 1:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before, count = count, pairs.count()
        if 2 * count > before:
            return _star_components(pairs)


def _star_components(pairs: DataFrame) -> DataFrame:
    """Components of edges (u, v), u > v, by alternating large-star and small-star: rounds grow with the logarithm of the longest chain.

    Each half round is an aggregate and a join on the node, so a hub's rows are combined map-side and its join can be
    split.  Every round is a table in the shared folder, so nothing is computed again when an executor goes.
    """
    pairs = materialize(pairs.distinct(), "cc")
    state = _digest(pairs)
    while state[0]:
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.greatest("v", "m").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        pairs = materialize(small.where("u <> v").distinct(), "cc")
        now = _digest(pairs)
        if now == state:
            break
        state = now
    roots = pairs.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _digest(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1000003)).first()
    return tuple(row)
