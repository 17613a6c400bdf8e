"""Removal of byte strings that start in more than one place, by sharded suffix arrays."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_buffers
from .suffix_array import common_prefixes, packed_keys, suffix_array

#: Bytes of the anchor that every window of MATCH bytes picks by its content.
ANCHOR = 32
#: Text that is in work at a time; a longer text is cut, with windows running over.
PIECE = 1 << 20
#: Bytes of contexts in one suffix array.  An anchor whose contexts have more is dealt over several.
SHARD_BYTES = 2 << 20
#: Most tasks that shards are dealt to; a task solves its shards one after the other.
MOST_TASKS = 8192

_MUL = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ANCHOR bytes at each position where so many follow; by doubling."""
    h = _mix((data.astype(np.uint64) + np.uint64(1)) * _MUL)
    width = 1
    while width < ANCHOR:
        h = h[:-width] * _MUL + h[width:]
        h ^= h >> np.uint64(31)
        width *= 2
    return _mix(h)


def anchors(data: np.ndarray, match: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor hash): runs of windows of ``match`` bytes that pick the same anchor.

    A window picks the smallest hash among the ANCHOR-byte strings in it, the leftmost of equal ones.  So equal
    windows pick equal anchors at the same distance.
    """
    windows = len(data) - match + 1
    if windows <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = gram_hashes(data)
    bits = np.uint64(max(1, int(len(h) - 1).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    best = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    span, width = match - ANCHOR + 1, 1
    while 2 * width <= span:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if span > width:
        best = np.minimum(best[: windows], best[span - width : span - width + windows])
    at = (best[:windows] & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(new[1:], windows) - 1
    return new, last, h[at[new]].view(np.int64)


def _occurrences(match: int):
    """Arrow batches of (doc_id, th, text) to one row for each run of windows of an anchor."""

    def work(batches):
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            rows: list[np.ndarray] = []
            first: list[np.ndarray] = []
            size: list[np.ndarray] = []
            hashes: list[np.ndarray] = []
            contents: list[int] = []
            gathered = 0

            def flush():
                take = pa.array(np.concatenate(rows))
                columns = [batch.column(0).take(take), batch.column(1).take(take)]
                columns += [pa.array(np.concatenate(first)), pa.array(np.concatenate(size)), pa.array(np.concatenate(hashes))]
                content = np.array(contents, np.uint64).view(np.int64)
                return pa.RecordBatch.from_arrays([*columns, pa.array(content)], ["doc_id", "th", "first", "size", "v", "c"])

            for r, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                for at in range(a, b - match + 1, PIECE):
                    piece = data[at : min(b, at + PIECE + match - 1)]
                    lo, hi, v = anchors(piece, match)
                    raw = memoryview(piece)
                    contents += [xxh3_64_intdigest(raw[x : y + match]) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]
                    rows.append(np.full(len(lo), r))
                    first.append(lo + (at - a))
                    size.append((hi - lo + match).astype(np.int32))
                    hashes.append(v)
                    gathered += len(lo)
                if gathered > 100_000:
                    yield flush()
                    rows, first, size, hashes, contents, gathered = [], [], [], [], [], 0
            if gathered:
                yield flush()

    return work


def repeated_windows(texts: list[bytes], match: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each context, which of its windows also start elsewhere in these contexts; and which of them equal the
    one before them in suffix order, so that one of each set of equal windows is left."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    symbols = np.zeros(int((sizes + 1).sum()), np.int16)  # a zero ends each context
    joined = np.frombuffer(b"".join(texts), np.uint8)
    inside = np.ones(len(symbols), bool)
    inside[starts + sizes] = False
    symbols[inside] = joined.astype(np.int16) + 1
    keys = packed_keys(symbols)
    sa, rank = suffix_array(symbols, keys)
    steps = sizes - match + 1
    lcp = common_prefixes(symbols, keys, sa, rank, starts, steps, match)
    # A position's prefix is shared with its neighbour before it or with the one after it.  The one after may
    # stand outside every chain, but then its stretch is shorter than a window.
    behind = lcp[sa] >= match
    shared = np.zeros(len(symbols), bool)
    shared[sa] = behind | np.append(behind[1:], False)
    at = list(zip(starts.tolist(), steps.tolist(), strict=True))
    return [shared[s : s + k] for s, k in at], [lcp[s : s + k] >= match for s, k in at]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of true values."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _by_shard(match: int):
    """Sorted rows (shard, v, c, n, hot, text) to rows (v, c, lo, hi, d1, d2): runs of windows that repeat inside the
    shard, and for anchors that lie in several shards a digest of each different window, ``hi`` = -1 if it repeats there."""

    def work(batches):
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        held: list = []

        def solve(rows):
            repeated, later = repeated_windows([r[5] for r in rows], match)
            out: list[list] = [[] for _ in range(6)]
            for (_, v, c, n, hot, text), flags, known in zip(rows, repeated, later, strict=True):
                if n == 1:
                    for lo, hi in zip(*_runs(flags), strict=True):
                        for column, x in zip(out, (v, c, int(lo), int(hi), None, None), strict=True):
                            column.append(x)
                if hot:
                    for at in np.flatnonzero(~known).tolist():
                        d = xxh3_128_digest(text[at : at + match])
                        row = (v, c, at, -1 if flags[at] or n > 1 else at, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True))
                        for column, x in zip(out, row, strict=True):
                            column.append(x)
            names = ["v", "c", "lo", "hi", "d1", "d2"]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][0] != row[0]:
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)

    return work


def _across_shards(batches):
    """Rows (v, c, lo, hi, d1, d2) sorted by digest: runs of windows pass; of windows with a digest, those pass that do
    not repeat in their shard but do in another.  The windows of all shards are one sorted list here; a binary search
    finds where a digest's begin and end."""
    import pyarrow as pa

    names = ["v", "c", "lo", "hi"]
    held: list[np.ndarray] = []

    def solve(rows):
        d1, d2 = rows[4], rows[5]
        group = np.cumsum(np.concatenate([[True], (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])]))
        alone = np.flatnonzero(rows[3] >= 0)
        count = np.searchsorted(group, group[alone], "right") - np.searchsorted(group, group[alone], "left")
        hit = alone[count > 1]
        return pa.RecordBatch.from_arrays([pa.array(rows[k][hit]) for k in (0, 1, 2, 2)], names)

    for batch in batches:
        runs = batch.filter(batch.column(4).is_null())
        if runs.num_rows:
            yield pa.RecordBatch.from_arrays(runs.columns[:4], names)
        windows = batch.filter(batch.column(4).is_valid())
        if windows.num_rows:
            held.append(np.stack([np.asarray(c) for c in windows.columns]))
            if held[0][4, 0] != held[-1][4, -1]:
                rows = np.concatenate(held, axis=1)
                cut = int(np.searchsorted(rows[4], rows[4, -1]))
                held = [rows[:, cut:].copy()]
                yield solve(rows[:, :cut])
    if held:
        yield solve(np.concatenate(held, axis=1))


def _remove(match: int):
    """Rows (doc_id, text, spans) to the result."""

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            out: list[list] = [[] for _ in range(4)]
            for a, b, spans in zip(offsets[:-1].tolist(), offsets[1:].tolist(), batch.column(2), strict=True):
                raw = data[a:b]
                gone = n_spans = 0
                digest = hashlib.sha256()
                at = 0
                for lo, hi in merged(np.array([(s["lo"], s["hi"]) for s in spans.as_py() or []], np.int64).reshape(-1, 2)):
                    digest.update(raw[at:lo])
                    at, gone, n_spans = hi, gone + hi - lo, n_spans + 1
                digest.update(raw[at:])
                for column, x in zip(out, (b - a, gone, n_spans, digest.hexdigest()), strict=True):
                    column.append(x)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            arrays = [batch.column(0), *(pa.array(x, t) for x, t in zip(out, types, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return work


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Half-open spans joined where they overlap or touch."""
    out: list[list[int]] = []
    for lo, hi in sorted(map(tuple, spans.tolist())):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", match: int = 200) -> tuple[DataFrame, DataFrame]:
    """(documents with th, spans): spans are (doc_id, th, lo, hi), half open, not merged, and cover every byte of
    every ``match``-byte string that starts at two places or more.  ``th`` is a hash of the text: rows that share
    id and text are alike in every respect.

    1. Every window of ``match`` bytes picks an anchor by content, so equal windows share it.  About one position
       in 85 is an anchor; each stands for a run of windows, its *context* of up to ~370 bytes.
    2. Contexts whose anchor occurs once anywhere cannot repeat and go.  Equal contexts collapse to one with a count.
    3. Contexts of the same anchor meet in a shard; its suffix array and common prefixes give the windows that
       repeat there.  An anchor with very many different contexts is dealt over several shards, whose windows are
       merged by binary search.
    4. The windows go back to every document that has the context.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    found = rows.select("doc_id", "th", "text").where(F.octet_length("text") >= match)
    found = materialize(found.mapInArrow(_occurrences(match), "doc_id long, th long, first long, size int, v long, c long"), "anchors")
    # As a table of its own, so that the join can split an anchor that very many rows share.
    often = materialize(found.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").select("v"), "anchors-often")
    found = materialize(found.join(often, "v", "left_semi"), "anchors-again")

    contexts = found.groupBy("v", "c").agg(F.count("*").alias("n"), *[F.first(x).alias(x) for x in ("doc_id", "th", "first", "size")])
    contexts = materialize(contexts, "contexts")
    per_anchor = contexts.groupBy("v").agg(F.count("*").alias("different"), F.sum("size").alias("bytes")).where("different > 1")
    per_anchor = materialize(per_anchor, "anchors-several")
    total = per_anchor.agg(F.sum("bytes")).first()[0] or 0
    shards = max(1, math.ceil(total / SHARD_BYTES))
    several = contexts.join(per_anchor, "v")
    salts = F.ceil(F.col("bytes") / SHARD_BYTES)
    several = several.withColumn("hot", salts > 1).withColumn("salt", F.pmod(F.col("c"), salts))
    several = several.withColumn("shard", F.pmod(F.xxhash64("v", "salt"), F.lit(shards)))

    wanted = several.select(F.col("doc_id").alias("d2"), F.col("th").alias("t2"), "shard", "v", "c", "n", "hot", "first", "size")
    bound = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")))
    cut = F.substring(F.col("text").cast("binary"), (F.col("first") + 1).cast("int"), F.col("size"))
    # Rows that repeat an id and a text bring a context twice.
    bound = bound.select("shard", "v", "c", "n", "hot", cut.alias("context"))
    tasks = min(shards, MOST_TASKS)
    bound = bound.repartition(tasks, "shard") if tasks > 1 else bound.repartition(1)
    sharded = bound.dropDuplicates(["shard", "v", "c"]).sortWithinPartitions("shard", "v", "c")
    solved = sharded.mapInArrow(_by_shard(match), "v long, c long, lo long, hi long, d1 long, d2 long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    solved = solved.repartition(parts, F.coalesce("d1", F.xxhash64("v", "c"))).sortWithinPartitions("d1", "d2")
    inside = solved.mapInArrow(_across_shards, "v long, c long, lo long, hi long")
    copies = contexts.where("n > 1").select("v", "c", F.lit(0).cast("long").alias("lo"), (F.col("size") - match).cast("long").alias("hi"))
    windows = copies.union(inside)
    spans = found.join(windows, ["v", "c"]).select(
        "doc_id", "th", (F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi") + match).alias("hi")
    )
    return rows, spans


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", match: int = 200) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Every byte goes that a string of ``match`` bytes covers which also starts anywhere else, in the same document
    or another; strings are judged on the input.  Matches never cross documents.  Null texts count as empty;
    texts shorter than ``match`` keep all.  A repeated row counts as another document, so its whole text repeats.
    Null ids are ids like any other.  An empty table gives an empty result.  Other columns are ignored.
    """
    rows, spans = repeated_spans(docs, id_col, text_col, match)
    lists = spans.groupBy("doc_id", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    lists = lists.select(F.col("doc_id").alias("d2"), F.col("th").alias("t2"), "spans")
    joined = rows.join(lists, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")), "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return joined.select("doc_id", "text", "spans").mapInArrow(_remove(match), schema)
