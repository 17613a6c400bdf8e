"""Texts whose sets of word shingles are alike: a prefix filter finds every candidate, exact Jaccard decides."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, each_text, materialize, row_hash, slices

#: Texts that tell which shingles are common; the order of shingles decides how fast links are found, never which.
SAMPLE = 16_000
MOST_COMMON = 400_000
#: Runs of one shingle with more members are compared with a pivot, and then by groups (``_group_pairs``).
SHORT_RUN = 8
PIVOTS = 4
#: Members of a block of a group; a larger group is compared block by block.
BLOCK = 4096
#: Rounds that try few pairs of a group, those that would connect all that may be alike, before the rest is compared.
TREE_ROUNDS = 2
#: Up to so many texts are looked up by a broadcast list of their hashes, more by a join that shuffles.
MOST_BROADCAST = 1_000_000
_LEAST = 1e-9


def shingle_set(raw: bytes, size: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    from .simhash import shingle_hashes

    return _set_of(list(shingle_hashes(raw, size)))


def _set_of(parts: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def prefix_of(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles in the order common to all texts, rare ones first: two alike sets share one of these."""
    n = len(hashes)
    if not n:
        return hashes
    times = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        times = np.where(common[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, times))[: n - int(np.ceil(similarity * n - _LEAST)) + 1]]


def _common_shingles(docs: DataFrame, text_col: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in two or more texts of a sample, sorted, and in how many they are."""
    part = -(-docs.count() // SAMPLE)

    def work(batches):
        import pyarrow as pa

        for batch in slices(batches):
            for t in each_text(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t, size).view(np.int64))], ["h"])

    text = F.col(text_col).cast("string")
    picked = docs.select(text.alias("text")).where(F.pmod(row_hash(F.col("text")), F.lit(max(part, 1))) == 0)
    found = picked.mapInArrow(work, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n >= 2")
    got = found.orderBy(F.desc("n"), "h").limit(MOST_COMMON).toArrow()
    h, n = np.asarray(got["h"]).astype(np.int64).view(np.uint64), np.asarray(got["n"]).astype(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def set_marks(docs: DataFrame, size: int, similarity: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, th, size, prefix, bins, bits): ``fp`` is a hash of the set of shingles, ``th`` one of the text as it stands.

    ``bins`` counts the shingles by their lowest byte, up to 255; ``bits`` is the text's fingerprint.
    """
    common, counts = _common_shingles(docs, text_col, size)

    def work(batches):
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        from .simhash import fingerprint_of, shingle_hashes

        for batch in slices(batches):
            fps, sizes, heads, bins, bits = [], [], [], [], []
            for t in each_text(batch.column(1)):
                hashed = list(shingle_hashes(t, size))
                s = _set_of(hashed)
                bits.append(fingerprint_of(hashed))
                fps.append(xxh3_64_intdigest(s.tobytes()))
                sizes.append(len(s))
                bins.append(np.minimum(np.bincount((s & np.uint64(255)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes())
                heads.append(prefix_of(s, common, counts, similarity).view(np.int64))
            ends = np.cumsum([0, *map(len, heads)]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(heads)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), batch.column(2), pa.array(sizes, pa.int64()), prefix, pa.array(bins, pa.binary()), pa.array(bits, pa.int64())],
                ["doc_id", "fp", "th", "size", "prefix", "bins", "bits"],
            )

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), row_hash(F.col(text_col)).alias("th"))
    return picked.mapInArrow(work, "doc_id long, fp long, th long, size long, prefix array<long>, bins binary, bits long")


def _may_link(size_a, at_a, size_b, at_b, similarity):
    """Whether two sets whose first common shingle is at these places can be alike at all."""
    need = np.ceil(similarity / (1 + similarity) * (size_a + size_b) - _LEAST)
    return (np.minimum(size_a, size_b) >= similarity * np.maximum(size_a, size_b) - _LEAST) & (np.minimum(size_a - at_a, size_b - at_b) >= need)


def _whole_runs(batches):
    """Arrow batches sorted by their first column as arrays of rows, no value of it in two of them."""
    held: list[np.ndarray] = []
    for batch in batches:
        if batch.num_rows:
            held.append(np.stack([np.asarray(c) for c in batch.columns]))
            if held[0][0, 0] != held[-1][0, -1]:
                rows = np.concatenate(held, axis=1)
                last = np.searchsorted(rows[0], rows[0, -1])
                held = [rows[:, last:].copy()]
                if last:
                    yield rows[:, :last]
    if held:
        yield np.concatenate(held, axis=1)


def _first_pairs(similarity: float):
    """Rows (token, fp, size, at) sorted by token to pairs of short runs (kind 0) and the members of long runs beside
    their pivot: kind 1 where the sizes let them be alike, kind 2 where not.

    The pivot is the member that comes first in an order that no token bears on, so the tokens of one group of copies
    have the same pivot as a rule.
    """

    def work(batches):
        import pyarrow as pa

        def out(kind, pairs):
            a, b = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.zeros((2, 0), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind)), pa.array(a), pa.array(b)], ["kind", "a", "b"])

        for rows in _whole_runs(batches):
            again = (rows[0, 1:] == rows[0, :-1]) & (rows[1, 1:] == rows[1, :-1])  # documents of equal sets
            rows = rows[:, np.concatenate([[True], ~again])]
            _, start, inverse, times = np.unique(rows[0], return_index=True, return_inverse=True, return_counts=True)
            members = times[inverse]
            token, fp, size, at = rows[:, (members > 1) & (members <= SHORT_RUN)]
            found: list[list] = [[], [], []]
            for d in range(1, SHORT_RUN):
                ok = (token[:-d] == token[d:]) & _may_link(size[:-d], at[:-d], size[d:], at[d:], similarity)
                found[0].append(np.stack([np.minimum(fp[:-d], fp[d:])[ok], np.maximum(fp[:-d], fp[d:])[ok]]))
            for s, n in zip(start[times > SHORT_RUN].tolist(), times[times > SHORT_RUN].tolist(), strict=True):
                _, fp, size, _ = rows[:, s : s + n]
                p = int(np.argmin(fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                near = np.minimum(size, size[p]) >= similarity * np.maximum(size, size[p]) - _LEAST
                near[p] = False  # a member of its own group, not a pair
                found[1].append(np.stack([np.full(int(near.sum()), fp[p]), fp[near]]))
                found[2].append(np.stack([np.full(int((~near).sum()), fp[p]), fp[~near]]))
            for kind in range(3):
                yield out(kind, found[kind])

    return work


def _may_be_alike(x: np.ndarray, y: np.ndarray, both: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the counts by byte allow two sets to be alike: they have at most the lesser counts in common."""
    low = np.minimum(x, y)
    return (low.sum(1, dtype=np.int64) >= similarity / (1 + similarity) * both - 1e-6) | (low == 255).any(1)


def block_pairs(
    fps: np.ndarray, parts: np.ndarray, sides: np.ndarray, sizes: np.ndarray, bins: np.ndarray, similarity: float, tree: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members of different parts whose sizes and counts allow them to be alike; of two ``sides``, if there are.

    A ``tree`` has only pairs of parts that none before them connects: fewer pairs than parts, and where all are alike
    they connect what all pairs connect.
    """
    _, number, times = np.unique(parts, return_inverse=True, return_counts=True)
    largest, two = int(np.argmax(times)), len(np.unique(sides)) > 1
    before = np.zeros(len(fps), bool)  # what has asked already
    left, right = [], []
    root = np.arange(len(times))  # the tree that a part is in
    for i in np.flatnonzero(number != largest).tolist():
        trees = root[number]
        ok = (trees != trees[i]) & ~before & (np.minimum(sizes, sizes[i]) >= similarity * np.maximum(sizes, sizes[i]) - _LEAST)
        if two:
            ok &= sides != sides[i]
        near = np.flatnonzero(ok)
        near = near[_may_be_alike(bins[near], bins[i], sizes[near] + sizes[i], similarity)]
        if tree and len(near):  # of each tree the likeliest
            share = np.minimum(bins[near], bins[i]).sum(1, dtype=np.int64) / np.maximum(sizes[near] + sizes[i], 1)
            near = near[np.argsort(-share, kind="stable")]
            met, first = np.unique(trees[near], return_index=True)
            near = near[first]
            root[np.isin(root, met)] = trees[i]
        left.append(np.full(len(near), fps[i]))
        right.append(fps[near])
        before[i] = True
    if not left:
        return fps[:0], fps[:0]
    a, b = np.concatenate(left), np.concatenate(right)
    return np.minimum(a, b), np.maximum(a, b)


def _by_block(similarity: float, tree: bool):
    """Rows (key, side, fp, part, size, bins) sorted by key to the pairs of each block."""

    def work(batches):
        import pyarrow as pa

        held: list = []

        def solve():
            _, sides, fps, parts, sizes = (np.concatenate([np.asarray(b.column(k)) for b in held]) for k in range(5))
            bins = np.concatenate([np.frombuffer(b"".join(b.column(5).to_pylist()), np.uint8).reshape(-1, 256) for b in held])
            found = block_pairs(fps, parts, sides, sizes, bins, similarity, tree)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["a", "b"])

        for batch in batches:
            keys = np.asarray(batch.column(0))
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if held and hi > lo and held[-1].column(0)[0].as_py() != int(keys[lo]):
                    yield solve()
                    held = []
                if hi > lo:
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield solve()

    return work


def _group_pairs(groups: DataFrame, links: DataFrame, distinct: DataFrame, similarity: float, tree: bool) -> DataFrame | None:
    """The pairs inside groups (pivot, fp) that no link connects yet and whose counts allow them to be alike, or a
    ``tree`` of them (``block_pairs``); None if no group has two parts.

    A group meets in one task, or, where it is large, in a task for each two of its blocks.
    """
    parts = connected_components(links)
    placed = groups.join(parts, groups["fp"] == parts["node"], "left").select("pivot", "fp", F.coalesce("component", "fp").alias("part"))
    placed = materialize(placed, "similar-groups")
    per = placed.groupBy("pivot").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("n"))
    per = materialize(per.where("lo <> hi").select("pivot", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "similar-mixed")
    if per.isEmpty():
        return None
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("mine")).alias("i"), F.greatest(k, F.col("mine")).alias("j")))
    dealt = placed.join(per, "pivot").withColumn("mine", mine).select("fp", "part", "mine", "pivot", F.explode(pairs).alias("p"))
    dealt = dealt.select("fp", "part", "mine", F.xxhash64("pivot", "p.i", "p.j").alias("key"))
    number = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = dealt.join(distinct.select("fp", "size", "bins"), "fp").select("key", "mine", "fp", "part", "size", "bins")
    met = met.repartition(number, "key").sortWithinPartitions("key")
    return materialize(met.mapInArrow(_by_block(similarity, tree), "a long, b long").distinct(), "similar-rest")


def _sets_of(wanted: DataFrame, distinct: DataFrame, docs: DataFrame, size: int, text_col: str) -> DataFrame:
    """(fp, hashes): the sets that are wanted, read from one text of each."""
    wanted = materialize(distinct.join(wanted, "fp", "left_semi").select("fp", F.col("th").alias("fp_th")), "similar-wanted")
    count = wanted.count()
    texts = docs.select(F.col(text_col).cast("string").alias("text"), row_hash(F.col(text_col)).alias("th"))
    texts = texts.join(F.broadcast(wanted) if count <= MOST_BROADCAST else wanted, F.col("th") == F.col("fp_th")).select("fp", "text")

    def sets(batches):
        import pyarrow as pa

        for batch in slices(batches):
            found = [shingle_set(t, size).tobytes() for t in each_text(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["fp", "hashes"])

    held = materialize(texts.mapInArrow(sets, "fp long, hashes binary"), "similar-sets")
    return materialize(held.dropDuplicates(["fp"]), "similar-sets") if held.count() > count else held  # equal texts


def verified(pairs: DataFrame, distinct: DataFrame, docs: DataFrame, size: int, similarity: float, text_col: str, counted: bool = False) -> DataFrame:
    """The pairs whose sets are alike: those that the counts by byte allow, from the sets themselves.

    Pairs that are ``counted`` have met by their counts before (``_group_pairs``).
    """

    def possible(batches):
        import pyarrow as pa

        for batch in slices(batches, 4096):
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, 256) for i in (4, 5))
            ok = _may_be_alike(x, y, np.asarray(batch.column(2)) + np.asarray(batch.column(3)), similarity)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    side = lambda k, n: distinct.select(F.col("fp").alias(k), F.col("size").alias(f"n{n}"), F.col("bins").alias(f"x{n}"))
    if not counted:
        binned = pairs.join(side("a", 1), "a").join(side("b", 2), "b").select("a", "b", "n1", "n2", "x1", "x2")
        pairs = materialize(binned.mapInArrow(possible, "a long, b long"), "similar-possible")

    def alike(batches):
        import pyarrow as pa

        for batch in slices(batches, 16):
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= similarity * (len(x) + len(y) - both) - _LEAST)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    held = _sets_of(pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).distinct(), distinct, docs, size, text_col)
    left, right = held.select(F.col("fp").alias("a"), F.col("hashes").alias("x")), held.select(F.col("fp").alias("b"), F.col("hashes").alias("y"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return materialize(joined.mapInArrow(alike, "a long, b long"), "similar-links")


def _apart(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The pairs that the links do not connect."""
    parts = materialize(connected_components(links), "similar-known")
    of = lambda k: parts.select(F.col("node").alias(k), F.col("component").alias(f"part_{k}"))
    placed = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return materialize(placed.where("part_a is null or part_b is null or part_a <> part_b").select("a", "b"), "similar-apart")


def set_links(marks: DataFrame, distinct: DataFrame, docs: DataFrame, size: int, similarity: float, text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """(a, b): sets that are alike, enough of them to connect what all alike pairs connect.

    ``known`` are links found before; a pair that they connect is not tried again, and they are among the links returned.

    Two sets of which a share of ``similarity`` is common have one of their first shingles in common (prefix
    filter), whatever order all texts take the shingles in.  Rare ones come first, so runs are short.  In a long
    run every member is compared with a pivot; then the members of all runs with that pivot that are still in
    different parts are compared by their counts, inside a task, and only what may be alike leaves it.  Two rounds
    take a tree of those pairs, so a large group whose members are alike gives a pair for each member and not for
    each two; the last takes all that are still apart, so none is lost.
    """
    tokens = marks.select("fp", "size", F.posexplode("prefix").alias("at", "token")).select("token", "fp", "size", F.col("at").cast("long"))
    number = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = tokens.repartition(number, "token").sortWithinPartitions("token", "size", "fp")
    first = materialize(runs.mapInArrow(_first_pairs(similarity), "kind long, a long, b long"), "similar-first")
    pivots = first.where("kind = 1").groupBy("b").agg(F.slice(F.sort_array(F.collect_set("a")), 1, PIVOTS).alias("a"))
    pairs = first.where("kind = 0").select("a", "b").union(pivots.select(F.explode("a").alias("a"), "b"))
    pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "similar-pairs")
    if known is None:
        links = verified(pairs, distinct, docs, size, similarity, text_col)
    else:
        links = known.union(verified(_apart(pairs, known), distinct, docs, size, similarity, text_col))
    groups = first.where("kind > 0").select(F.col("a").alias("pivot"), F.col("b").alias("fp")).distinct()
    groups = materialize(groups, "similar-members")
    for at in range(TREE_ROUNDS + 1):
        rest = _group_pairs(groups, links, distinct, similarity, tree=at < TREE_ROUNDS)
        if rest is None or rest.isEmpty():
            break
        links = links.union(verified(rest, distinct, docs, size, similarity, text_col, counted=True))
    return links
