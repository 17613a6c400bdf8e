"""SimHash near-duplicates through Golay-code fuzzy hashing of fingerprint segments."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, each_text, keep_rows, materialize, row_hash, slices
from .golay import Golay
from .similar_sets import set_links, set_marks, verified

#: Texts are cut into words in pieces of about this many bytes, so that a very long text needs little memory.
PIECE = 1 << 20
MOST_BITS = 3
#: Bits of a fingerprint in each segment, from the lowest.
SEGMENTS = (23, 23, 18)
#: A run of one key with more pairs than this is linked by pivots instead of pair by pair.
RUN_PAIRS = 256
#: A run with more rows is parted further: each fingerprint is filed under four parts of the bits that the key leaves open.
MOST_RUN = 1 << 14

_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(raw: bytes, size: int = 3, seed: int = 42):
    """Yields arrays with the XXH64 of every word shingle, repeats included; A-Z count as lower case.

    A text with fewer words than a shingle is one shingle; a text without words gives nothing.
    """
    from xxhash import xxh64_intdigest

    def hashed(words):
        runs = zip(*(words[i:] for i in range(size)), strict=False)
        n = len(words) - size + 1
        return np.fromiter((xxh64_intdigest(b" ".join(r), seed) for r in runs), np.uint64, n)

    at, carry, total = 0, [], 0
    while at < len(raw):
        end = len(raw)
        if end - at > PIECE:
            cut = _SPACE.search(raw, at + PIECE)
            end = cut.start() if cut else end
        words = carry + raw[at:end].lower().split()
        at = end
        if len(words) >= size:
            total += len(words) - size + 1
            yield hashed(words)
            carry = words[len(words) - size + 1 :]
        else:
            carry = words
    if not total and carry:
        yield np.array([xxh64_intdigest(b" ".join(carry), seed)], np.uint64)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    out = np.empty((8, 8), np.int64)
    starts = np.arange(0, len(h), 255)  # a byte lane holds sums up to 255
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & _LANES, starts)
        out[:, k] = lanes.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return out.ravel()


def fingerprint(raw: bytes, size: int = 3) -> int:
    """64 bits, each set if it is set in over half the shingle hashes; 0 without words.  Signed."""
    return fingerprint_of(shingle_hashes(raw, size))


def fingerprint_of(parts) -> int:
    """The fingerprint from arrays of shingle hashes."""
    counts, n = np.zeros(64, np.int64), 0
    for h in parts:
        counts += bit_counts(h)
        n += len(h)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0]) if n else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(doc_id, fp, th): the fingerprint as a signed 64-bit number, and a hash of the text as it stands."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), row_hash(F.col(text_col)).alias("th"))

    def work(batches):
        import pyarrow as pa

        for batch in slices(batches):
            fps = [fingerprint(t, size) for t in each_text(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), batch.column(2)], ["doc_id", "fp", "th"])

    return picked.mapInArrow(work, "doc_id long, fp long, th long")


@lru_cache(maxsize=1)
def _code() -> Golay:
    return Golay()


def _parity(x: np.ndarray) -> np.ndarray:
    return (np.bitwise_count(x) & 1).astype(np.int64)


def keys_of(fps: np.ndarray, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs.  Two fingerprints within three bits share a key, one as probe and one as index.

    Three errors spread over three segments in one of two ways:

    * A segment i has none.  Of the other two, one (j) has at most one.  Key: i as it is, and a codeword near j.
    * Each has exactly one.  Key: codewords near segments 0 and 1, and the half of segment 2 that has no error.
      One error turns a segment's parity, so the probe asks for the opposite parities.

    The index side files a segment under its nearest codeword; the probe side asks for every codeword within
    four bits.
    """
    u = fps.view(np.uint64)
    seg = [(u & np.uint64((1 << 23) - 1)).astype(np.int64), ((u >> np.uint64(23)) & np.uint64((1 << 23) - 1)).astype(np.int64), (u >> np.uint64(46)).astype(np.int64)]
    n, code = len(u), _code()
    near = [code.nearby(s) if probe else (np.arange(n), code.decode(s)[0]) for s in seg]
    rows, keys = [], []
    tag = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                r, c = near[j]
                rows.append(r)
                keys.append((tag << 40) | (seg[i][r] << 12) | c)
                tag += 1
    (r0, c0), (r1, c1) = near[0], near[1]
    # All pairs of a codeword of segment 0 and one of segment 1 of the same fingerprint.
    order1 = np.argsort(r1, kind="stable")
    count1 = np.bincount(r1, minlength=n)
    start1 = np.concatenate([[0], np.cumsum(count1)[:-1]])
    times = count1[r0]
    r = np.repeat(r0, times)
    first = np.repeat(c0, times)
    inner = np.arange(len(r)) - np.repeat(np.cumsum(times) - times, times)
    second = c1[order1][start1[r] + inner]
    turned = 1 if probe else 0
    p01 = ((_parity(seg[0]) ^ turned) << 1) | (_parity(seg[1]) ^ turned)
    for half in range(2):
        exact, other = (seg[2] & 511, seg[2] >> 9) if half == 0 else (seg[2] >> 9, seg[2] & 511)
        rest = (exact << 3) | (p01 << 1) | (_parity(other) ^ turned)
        rows.append(r)
        keys.append(((6 + half) << 40) | (rest[r] << 24) | (first << 12) | second)
    return np.concatenate(rows), np.concatenate(keys)


def link_run(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what links within the bits connect, among distinct fingerprints; far fewer than all pairs.

    Pivots are taken until each fingerprint is a pivot or within the bits of one.  Two balls that are not yet
    connected are compared only if their pivots are near enough, and only until a link is found.
    """
    u = fps.view(np.uint64)
    n = len(u)
    root = np.arange(n)
    left, right, balls, pivots = [], [], [], []
    covered = np.zeros(n, bool)
    for p in range(n):
        if covered[p]:
            continue
        ball = np.flatnonzero(np.bitwise_count(u ^ u[p]) <= MOST_BITS)
        fresh = ball[~covered[ball]]
        # One link to each new member, and one to each part that older members already form.
        old = ball[covered[ball]]
        old = old[np.unique(root[old], return_index=True)[1]]
        others = np.concatenate([fresh[fresh != p], old])
        covered[ball] = True
        left.append(np.full(len(others), p))
        right.append(others)
        pivots.append(p)
        balls.append(ball)
        joined = np.unique(root[ball])
        root[np.isin(root, joined)] = joined[0]
    pivots_u = u[pivots]
    for a in range(len(pivots)):
        near = np.flatnonzero(np.bitwise_count(pivots_u[a + 1 :] ^ pivots_u[a]) <= 3 * MOST_BITS) + a + 1
        for b in near.tolist():
            if root[pivots[a]] == root[pivots[b]]:
                continue
            for x in balls[a].tolist():
                hit = np.flatnonzero(np.bitwise_count(u[balls[b]] ^ u[x]) <= MOST_BITS)
                if len(hit):
                    y = balls[b][hit[0]]
                    left.append(np.array([x]))
                    right.append(np.array([y]))
                    root[root == root[y]] = root[x]
                    break
    if not left:
        return fps[:0], fps[:0]
    return fps[np.concatenate(left)], fps[np.concatenate(right)]


def run_links(keys: np.ndarray, fps: np.ndarray, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges among rows sorted by key: pairs of an index row and a probe row of a key, verified."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    probes = np.add.reduceat(probe.astype(np.int64), starts)
    index = sizes - probes
    a_out, b_out = [], []
    busy = (probes > 0) & (index > 0)
    for s, z in zip(starts[busy & (probes * index > RUN_PAIRS)].tolist(), sizes[busy & (probes * index > RUN_PAIRS)].tolist(), strict=True):
        a, b = link_run(np.unique(fps[s : s + z]))
        a_out.append(a)
        b_out.append(b)
    small = np.flatnonzero(busy & (probes * index <= RUN_PAIRS))
    if len(small):
        take = np.repeat(starts[small], sizes[small]) + _within(sizes[small])
        run = np.repeat(np.arange(len(small)), sizes[small])
        pr, ir = take[probe[take]], take[~probe[take]]
        prun, irun = run[probe[take]], run[~probe[take]]
        icount = np.bincount(irun, minlength=len(small))
        istart = np.cumsum(icount) - icount
        times = icount[prun]
        a = np.repeat(fps[pr], times)
        b = fps[ir[np.repeat(istart[prun], times) + _within(times)]]
        ok = (a != b) & (np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= MOST_BITS)
        a_out.append(a[ok])
        b_out.append(b[ok])
    if not a_out:
        return fps[:0], fps[:0]
    a, b = np.concatenate(a_out), np.concatenate(b_out)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pairs[0], pairs[1]


def _within(sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


@lru_cache(maxsize=1)
def _open_bits() -> np.ndarray:
    """For each kind of key four masks that part the bits which the key does not fix."""
    starts = np.cumsum((0, *SEGMENTS))
    bits = [list(range(a, b)) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
    fixed = [bits[i] for i in range(3) for j in range(3) if i != j] + [bits[2][:9], bits[2][9:]]
    out = []
    for known in fixed:
        left = [b for b in range(64) if b not in known]
        out.append([sum(1 << b for b in left[k::4]) for k in range(4)])
    return np.array(out, np.uint64)


def part_run(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, fingerprint) four times each: the key mixed with one part of the bits that it leaves open.

    Two fingerprints of a key that differ in three bits or fewer agree in one of the four parts.
    """
    masks, u = _open_bits()[keys >> 40], fps.view(np.uint64)
    out = []
    for k in range(4):
        x = (u & masks[:, k]) ^ (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out.append((x ^ (x >> np.uint64(29))).view(np.int64))
    return np.concatenate(out), np.tile(fps, 4)


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """(a, b): fingerprints within three bits.  All links of a short run of a key, connecting ones of a long run.

    A task holds MOST_RUN rows of a key; a key with more is parted by a second shuffle.
    """
    spark = distinct.sparkSession

    def spread(batches):
        import pyarrow as pa

        for batch in slices(batches, 4096):
            fps = np.asarray(batch.column(0))
            for probe in (False, True):
                rows, keys = keys_of(fps, probe)
                yield pa.RecordBatch.from_arrays([pa.array(keys * 2 + probe), pa.array(fps[rows])], ["key", "fp"])

    def link(batches):
        """Links as (0, a, b), rows of long runs as (1, key, fingerprint)."""
        import pyarrow as pa

        held: list[np.ndarray] = []
        count, long = 0, None

        def out(kind, a, b):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)], ["kind", "a", "b"])

        def edges(rows):
            return out(0, *run_links(rows[0] >> 1, rows[1], (rows[0] & 1).astype(bool)))

        for batch in batches:
            rows = np.stack([np.asarray(batch.column(0)), np.asarray(batch.column(1))])
            if long is not None:  # the long run goes on
                cut = int(np.searchsorted(rows[0] >> 1, long, "right"))
                yield out(1, rows[0, :cut] >> 1, rows[1, :cut])
                rows = rows[:, cut:]
            if not rows.shape[1]:
                continue
            long = None
            held.append(rows)
            count += rows.shape[1]
            if held[0][0, 0] >> 1 != rows[0, -1] >> 1:  # else one key goes on
                rows = np.concatenate(held, axis=1)
                last = int(np.searchsorted(rows[0] >> 1, rows[0, -1] >> 1))
                held = [rows[:, last:].copy()]
                count = rows.shape[1] - last
                yield edges(rows[:, :last])
            if count > MOST_RUN:
                rows = np.concatenate(held, axis=1)
                long = int(rows[0, 0] >> 1)
                yield out(1, rows[0] >> 1, rows[1])
                held, count = [], 0
        if held:
            yield edges(np.concatenate(held, axis=1))

    def part(batches):
        import pyarrow as pa

        for batch in slices(batches, 1 << 14):
            keys, fps = part_run(np.asarray(batch.column(0)), np.asarray(batch.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps)], ["key", "fp"])

    def link_parts(batches):
        import pyarrow as pa

        held: list[np.ndarray] = []

        def edges(rows):
            cuts = np.flatnonzero(rows[0, 1:] != rows[0, :-1]) + 1
            found = [link_run(run[1]) for run in np.split(rows, cuts, axis=1) if run.shape[1] > 1]
            a, b = (np.concatenate([f[k] for f in found] or [rows[1, :0]]) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(np.stack([np.asarray(batch.column(0)), np.asarray(batch.column(1))]))
                if held[0][0, 0] != held[-1][0, -1]:
                    rows = np.concatenate(held, axis=1)
                    last = int(np.searchsorted(rows[0], rows[0, -1]))
                    held = [rows[:, last:].copy()]
                    yield edges(rows[:, :last])
        if held:
            yield edges(np.concatenate(held, axis=1))

    keyed = distinct.select("fp").mapInArrow(spread, "key long, fp long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_runs = keyed.repartition(parts, F.shiftright("key", 1)).sortWithinPartitions("key", "fp")
    found = materialize(sorted_runs.mapInArrow(link, "kind int, a long, b long"), "simhash-runs")
    links, long = found.where("kind = 0").select("a", "b").distinct(), found.where("kind = 1").select("a", "b").distinct()
    if long.isEmpty():
        return links
    parted = long.mapInArrow(part, "key long, fp long").repartition(parts, "key").sortWithinPartitions("key", "fp")
    return links.union(parted.mapInArrow(link_parts, "a long, b long")).distinct()


def checked_links(distinct: DataFrame, docs: DataFrame, size: int, similarity: float, text_col: str = "text") -> DataFrame:
    """(a, b): sets whose fingerprints are within three bits and that are alike; of equal fingerprints one set stands for all.

    ``distinct`` has a row for each set: fp, th, size, bins and its fingerprint as ``bits``.
    """
    heads = materialize(distinct.groupBy("bits").agg(F.min("fp").alias("head")), "simhash-heads")
    same = distinct.join(heads, "bits").where("fp <> head").select(F.col("head").alias("a"), F.col("fp").alias("b"))
    near = fingerprint_links(heads.select(F.col("bits").alias("fp")))
    of = lambda k: heads.select(F.col("bits").alias(k), F.col("head").alias(f"head_{k}"))
    apart = near.join(of("a"), "a").join(of("b"), "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    pairs = same.union(apart).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return verified(materialize(pairs, "simhash-pairs"), distinct, docs, size, similarity, text_col)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, similarity: float | None = None) -> DataFrame:
    """One row for each document: doc_id, fp, fingerprint (16 hex digits), component_id, fp_docs, component, th.

    ``component`` is the smallest fingerprint that links reach: it tells components apart even where ids repeat.
    ``th`` is a hash of the text as it stands.

    Documents link when their fingerprints differ in three bits or fewer; the component is the smallest id that
    links reach.  Equal fingerprints collapse first, so a group of copies costs one row for each task.  Distinct
    fingerprints meet under Golay keys (``keys_of``), each pair is verified, and components come from the
    verified links.

    Null texts and texts without words have fingerprint zero and link like any other.  Repeated ids are separate
    rows of one component.  Rows with a null id take part but never name a component unless it has no id at all.
    An empty table gives an empty result.  Other columns are ignored.

    With a ``similarity``, documents link when the Jaccard similarity of their sets of shingles of ``size`` words is
    that or more; ``fp`` is then a hash of the set, and texts without words have the same set.  The fingerprints meet
    under the same Golay keys first, and an exact check of the sets keeps the alike ones of those (``checked_links``).  What
    these links leave apart may still be alike, so the sets themselves are compared for it (``similar_sets``).
    """
    counted = [F.min("doc_id").alias("least_id"), F.count("*").alias("fp_docs")]
    if similarity is None:
        fps = materialize(fingerprints(docs, id_col, text_col, size), "simhash")
        distinct = materialize(fps.groupBy("fp").agg(*counted), "simhash-fp")
        links = materialize(fingerprint_links(distinct), "simhash-links")
    else:
        fps = materialize(set_marks(docs, size, similarity, id_col, text_col), "similar")
        distinct = materialize(fps.groupBy("fp").agg(*counted, F.min("th").alias("th"), F.first("size").alias("size"), F.first("bins").alias("bins"), F.min("bits").alias("bits")), "similar-fp")
        known = checked_links(distinct, docs, size, similarity, text_col)
        links = set_links(fps, distinct, docs, size, similarity, text_col, known)
    parts = connected_components(links)
    grouped = distinct.join(parts, distinct["fp"] == parts["node"], "left").select("fp", "least_id", "fp_docs", F.coalesce("component", "fp").alias("component"))
    named = grouped.groupBy("component").agg(F.min("least_id").alias("component_id"))
    # As a table of its own, so that the join with the documents can split a fingerprint that very many share.
    named = materialize(grouped.join(named, "component").select("fp", "component", "component_id", "fp_docs"), "simhash-named")
    return fps.join(named, "fp").select(
        "doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "fp_docs", "component", "th"
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, similarity: float | None = None) -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest id."""
    near = near_duplicates(docs, id_col, text_col, size, similarity)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")
    stays = near.groupBy("component").agg(F.min(order).alias("s")).select("s.doc_id", "s.th")
    return keep_rows(docs, stays, id_col, text_col)
