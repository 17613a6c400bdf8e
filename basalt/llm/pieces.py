"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice; lossless decoding."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codes import by_bytes
from .common import slices, text_buffers

#: Where the public vocabulary lies; a parameter everywhere.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The model's mark for a space.
MARK = "▁"
#: Words of more code points are filtered on their own, so many points at a time.
LONG, SEGMENT = 64, 1 << 14
#: Code points in work at a time; a longer word goes alone.
CHUNK = 1 << 19
#: Every weight is raised by this for each code point.  All segmentations of a word gain the same, so their
#: probabilities stay, and the forward sums stay near one.
TILT = 2.3
_MUL = 0x9E3779B97F4A7C15


class Lattice:
    """The vocabulary as a trie in a hash table, with a weight for each piece.

    A BPE model has merge ranks for scores.  The weight of a piece is the Zipf probability of its rank,
    1 / (rank + 2.7), to the power ``alpha``.  Control pieces are left out.  A character that no piece spells
    becomes its UTF-8 bytes.
    """

    def __init__(self, model_path: str = MODEL, alpha: float = 1.0) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = sp.get_piece_size()
        self.byte_ids = np.zeros(256, np.int32)
        self.bytes_of: list[bytes] = [b""] * size
        next_node, table, piece_of = 1, {}, [-1]
        ranks = []
        for i in range(size):
            piece = sp.id_to_piece(i)
            ranks.append(max(0.0, -sp.get_score(i)))
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.bytes_of[i] = bytes([value])
                continue
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                continue
            text = piece.replace(MARK, " ")
            self.bytes_of[i] = text.encode()
            node = 0
            for c in text:
                key = (node << 21) | ord(c)
                if key not in table:
                    table[key] = next_node
                    piece_of.append(-1)
                    next_node += 1
                node = table[key]
            piece_of[node] = i
        weight = (np.minimum(np.array(ranks), size) + 2.7) ** -alpha
        self.weight = weight / weight.sum()
        self.fallback = float((size + 2.7) ** -alpha / weight.sum())
        length = np.array([len(b.decode("utf-8", "ignore")) for b in self.bytes_of])
        #: Tilted weights; the last is that of a character as bytes.
        self.tilted = np.append(self.weight * np.exp(TILT * length), self.fallback * np.exp(TILT))
        self.longest = int(length.max())
        #: All pieces' bytes, one after the other, and where each piece's begin.
        self.spelled = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.spelled_at = np.concatenate([[0], np.cumsum([len(b) for b in self.bytes_of])])
        self.piece_of = np.array(piece_of, np.int32)
        # Pairs of characters that lie side by side in some piece, over numbers of the characters in longer pieces.
        texts = [b.decode("utf-8", "ignore") for b in self.bytes_of]
        seen = sorted({c for t in texts if len(t) > 1 for c in t})
        self.number = np.zeros(0x110000, np.uint16)
        self.number[[ord(c) for c in seen]] = np.arange(1, len(seen) + 1)
        self.beside = np.zeros((len(seen) + 1, len(seen) + 1), bool)
        for t in texts:
            at = self.number[[ord(c) for c in t]]
            self.beside[at[:-1], at[1:]] = True
        self.root = np.zeros(0x110000, np.int32)
        for key, node in table.items():
            if key >> 21 == 0:
                self.root[key] = node
        bits = max(4, int(8 * len(table)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.nodes = np.zeros(1 << bits, np.int32)
        for key, node in table.items():
            slot = (key * _MUL & (1 << 64) - 1) >> (64 - bits)
            while self.keys[slot] >= 0:
                slot = (slot + 1) & ((1 << bits) - 1)
            self.keys[slot], self.nodes[slot] = key, node

    def parts(self, points: np.ndarray) -> np.ndarray:
        """True at each point but the first whose border with the point before no piece crosses."""
        at = self.number[points]
        return ~self.beside[at[:-1], at[1:]]

    def children(self, nodes: np.ndarray, points: np.ndarray) -> np.ndarray:
        """The node under each node for a code point, or 0."""
        want = (nodes.astype(np.int64) << 21) | points
        slot = ((want.view(np.uint64) * np.uint64(_MUL)) >> self.shift).astype(np.int64)
        out = np.zeros(len(want), np.int32)
        left = np.arange(len(want))
        last = len(self.keys) - 1
        while len(left):
            found = self.keys[slot[left]]
            hit = found == want[left]
            out[left[hit]] = self.nodes[slot[left[hit]]]
            left = left[~hit & (found >= 0)]
            slot[left] = (slot[left] + 1) & last
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_starts(lat: Lattice, points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where a word of the lattice begins: with a text, and at borders that no piece crosses; words do not bear on each other."""
    new = np.ones(len(points), bool)
    new[1:] = lat.parts(points)
    new[np.cumsum(sizes)[:-1]] = True
    return np.flatnonzero(new)


def _places(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All places of the stretches, one stretch after the other."""
    sizes = end - start
    return np.arange(int(sizes.sum())) + np.repeat(start - (np.cumsum(sizes) - sizes), sizes)


def distinct_words(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each word's first equal, words that are first), by a hash of the word that is then verified.

    The hash is a difference of sums of code points times powers of an odd number, shifted back by the inverse
    power.  Words whose code points differ from those of the word they were matched with count as distinct.
    """
    n = len(points)
    power = np.cumprod(np.full(n, np.uint64(_MUL)))
    back = np.cumprod(np.full(n, np.uint64(pow(_MUL, -1, 1 << 64))))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power)])
    h = _mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))
    order = np.argsort(h)
    heads = np.concatenate([[True], h[order[1:]] != h[order[:-1]]])
    first, word = order[heads], np.empty(len(h), np.int64)
    word[order] = np.cumsum(heads) - 1
    own = _places(start, end)
    shift = np.repeat(start[first[word]] - start, end - start)
    # The hash covers the length too, but lengths are compared first: a longer partner's places would not line up.
    if (end - start != (end - start)[first[word]]).any() or (points[own + shift] != points[own]).any():
        return np.arange(len(start)), np.arange(len(start))
    return word, first


def edges(lat: Lattice, points: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, size, piece) of all pieces that fit in the room at each point; piece -2 is a character as bytes."""
    begin, node = np.arange(len(points), dtype=np.int32), lat.root[points]
    froms, sizes, pieces = [], [], []
    length = 1
    while len(begin):
        ok = np.flatnonzero(node)
        begin, node = begin[ok], node[ok]
        piece = lat.piece_of[node]
        has = np.flatnonzero(piece >= 0)
        froms.append(begin[has])
        sizes.append(np.full(len(has), length, np.int32))
        pieces.append(piece[has])
        if length == 1:
            known = np.zeros(len(points), bool)
            known[begin[has]] = True
            bare = np.flatnonzero(~known).astype(np.int32)
            froms.append(bare)
            sizes.append(np.ones(len(bare), np.int32))
            pieces.append(np.full(len(bare), -2, np.int32))
        go = np.flatnonzero(room[begin] > length)
        begin, node = begin[go], node[go]
        node = lat.children(node, points[begin + length].astype(np.int64))
        length += 1
    return np.concatenate(froms), np.concatenate(sizes), np.concatenate(pieces)


def forward(lat: Lattice, points: np.ndarray, start: np.ndarray, end: np.ndarray):
    """(from, piece, share so far, bounds, group): the edges of the lattice of words, by the place where they end.

    Forward filtering sums, for every place in a word, the weights of all segmentations that reach it; an edge's
    share is its part of the sum at its end.  ``group`` gives a place's edges, between two bounds.  Words have at
    most LONG points, which bounds the sums; all words go on together, a place at a time.
    """
    n = len(points)
    sizes_of = (end - start).astype(np.int32)
    at = np.arange(n, dtype=np.int32)
    frm, size, piece = edges(lat, points, np.repeat(end.astype(np.int32), sizes_of) - at)
    # By the place in the word that they end at, then by position and length; no two keys are equal.
    depth = (at - np.repeat(start.astype(np.int32), sizes_of))[frm] + size
    order = np.argsort((depth.astype(np.int64) << 40) | ((frm + size).astype(np.int64) << 7) | size)
    frm, size, piece, depth = frm[order], size[order], piece[order], depth[order]
    to = frm + size
    weight = lat.tilted[np.where(piece >= 0, piece, len(lat.weight))]
    first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))  # the edges that end at one place lie together
    place = to[first]
    steps = np.searchsorted(depth[first], np.arange(1, LONG + 2))
    reach = np.zeros(n + 1)
    reach[start] = 1.0
    opens = np.zeros(n + 1, bool)
    opens[start] = True
    share = np.empty(len(frm))
    bounds = np.append(first, len(frm))
    for d in range(LONG):
        lo, hi = steps[d], steps[d + 1]
        if lo == hi:
            break
        a, b = bounds[lo], bounds[hi]
        part = reach[frm[a:b]] * weight[a:b]
        sums = np.add.reduceat(part, first[lo:hi] - a)
        share[a:b] = part / np.repeat(sums, np.diff(bounds[lo : hi + 1]))
        at = place[lo:hi]
        go = np.flatnonzero(~opens[at])  # a word's end is the next one's start, which keeps its own sum
        reach[at[go]] = sums[go]
    group = np.zeros(n + 1, np.int32)
    group[place] = np.arange(len(place), dtype=np.int32)
    # Shares so far in each place's edges; summed inside the place, so that they depend on the word alone.
    count = np.diff(bounds)
    for k in range(1, int(count.max(initial=0))):
        more = first[count > k] + k
        share[more] += share[more - 1]
    return frm, piece, share, bounds, group


def _segment(lat: Lattice, points: np.ndarray, lo: int, hi: int, before: list[float]):
    """(sums at the last places, from, piece, share so far, bounds) of the edges that end after ``lo``, up to ``hi``.

    ``before`` has the sums at the last places up to ``lo``, as far back as a piece reaches.  Only their ratios
    count, so they are scaled whenever they become very large or small: a word may have any length.
    """
    begin = max(0, lo - lat.longest + 1)
    frm, size, piece = edges(lat, points[begin:hi], hi - np.arange(begin, hi))
    frm = frm + begin
    to = frm + size
    keep = np.flatnonzero(to > lo)
    keep = keep[np.argsort((to[keep].astype(np.int64) << 7) | size[keep])]
    frm, piece, to = frm[keep], piece[keep], to[keep]
    weight = lat.tilted[np.where(piece >= 0, piece, len(lat.weight))].tolist()
    bounds = np.searchsorted(to, np.arange(lo + 1, hi + 2)).tolist()
    back = (frm - (lo - lat.longest + 1)).tolist()
    sums, share = list(before), []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        part = [sums[back[k]] * weight[k] for k in range(a, b)]
        total, so_far = sum(part), 0.0
        for x in part:
            so_far += x
            share.append(so_far / total)
        sums.append(total)
        if not 1e-100 < total < 1e100:
            sums[-lat.longest :] = [x / total for x in sums[-lat.longest :]]
    last = sums[-lat.longest :]
    return last, frm.tolist(), piece.tolist(), share, bounds


def sample_long(lat: Lattice, points: np.ndarray, draw) -> np.ndarray:
    """As ``sample_rows``, for one word of any length; ``draw(lo, hi)`` gives the numbers of its places.

    The sums are kept at the ends of segments alone; a segment is filtered again when the way back comes to it.
    """
    n = len(points)
    cuts, held = list(range(0, n, SEGMENT)), [[0.0] * (lat.longest - 1) + [1.0]]
    for lo in cuts[:-1]:
        held.append(_segment(lat, points, lo, lo + SEGMENT, held[-1])[0])
    out, at = np.full(n, -1, np.int32), n
    for lo, before in zip(reversed(cuts), reversed(held), strict=True):
        hi = min(n, lo + SEGMENT)
        _, frm, piece, share, bounds = _segment(lat, points, lo, hi, before)
        draws = draw(lo, hi).tolist()
        while at > lo:
            k, last, u = bounds[at - lo - 1], bounds[at - lo] - 1, draws[at - lo - 1]
            while share[k] <= u and k < last:
                k += 1
            at = frm[k]
            out[at] = piece[k]
    return out


def sample_rows(lat: Lattice, points: np.ndarray, sizes: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """The piece that begins at each code point, -1 where none does, -2 for bytes; ``sizes`` parts the texts.

    The lattice is filtered forward once for each distinct word.  Backward sampling starts at the end of every
    word and picks the last piece by its share of the sum there, then goes on from its start, until the word's
    start.  ``draws`` has a number in [0, 1) for each place, so a draw belongs to a place of a row and not to the
    order of work.
    """
    out = np.full(len(points), -1, np.int32)
    start = word_starts(lat, points, sizes)
    end = np.append(start[1:], len(points))
    long = end - start > LONG
    for s, e in zip(start[long].tolist(), end[long].tolist(), strict=True):
        out[s:e] = sample_long(lat, points[s:e], lambda lo, hi, s=s: draws[s + lo : s + hi])
    start, end = start[~long], end[~long]
    if not len(start):
        return out
    word, first = distinct_words(points, start, end)
    sizes = (end - start)[first]
    ends = np.cumsum(sizes)
    frm, piece, share, bounds, group = forward(lat, points[_places(start[first], end[first])], ends - sizes, ends)
    at, stop = ends[word], (ends - sizes)[word]
    shift = start - stop
    while len(at):
        g = group[at]
        pick, last, draw = bounds[g], bounds[g + 1] - 1, draws[at + shift - 1]
        left = np.flatnonzero((share[pick] <= draw) & (pick < last))
        while len(left):
            pick[left] += 1
            now = pick[left]
            left = left[(share[now] <= draw[left]) & (now < last[left])]
        at = frm[pick].astype(np.int64)
        out[at + shift] = piece[pick]
        go = np.flatnonzero(at > stop)
        at, stop, shift = at[go], stop[go], shift[go]
    return out


def _uniform(keys, places: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) for places of rows with these keys."""
    return (_mix(keys + places.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(11)) * 2.0**-53


def _spell(lat: Lattice, picked: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece ids, places where a piece begins, ids of each): pieces as they are, characters as their bytes."""
    at = np.flatnonzero(picked != -1)
    chosen, cp = picked[at], points[at]
    width = np.where(chosen == -2, 1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF), 1)
    flat = np.repeat(chosen, width)
    raw = np.flatnonzero(chosen == -2)
    if len(raw):
        own = cp[raw].astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        flat[flat == -2] = lat.byte_ids[np.frombuffer(own, np.uint8)]
    return flat, at, width


def _next_cut(lat: Lattice, points: np.ndarray, at: int) -> int:
    """The last border of words up to CHUNK points on, or the first one after that, or the end."""
    to = min(len(points), at + CHUNK)
    if to == len(points):
        return to
    found = np.flatnonzero(lat.parts(points[at : to + 1]))
    while not len(found) and to < len(points):
        at, to = to, min(len(points), to + CHUNK)
        found = np.flatnonzero(lat.parts(points[at : to + 1]))[:1]
    return at + 1 + int(found[-1]) if len(found) else len(points)


def encode_batch(lat: Lattice, column, row_keys: np.ndarray, seed: int, copies: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(piece ids, offsets) of the texts of an Arrow column.  A space goes before each text that is not empty.

    Draws come from the row's key, its copy number if there is one, the place and the seed.
    """
    data, offsets = text_buffers(column)
    ids, counts = [], np.zeros(len(offsets) - 1, np.int64)
    keys = _mix(row_keys.astype(np.int64).view(np.uint64) * np.uint64(_MUL) + np.uint64(seed))
    if copies is not None:
        keys = np.where(copies > 0, _mix(keys + copies.astype(np.uint64)), keys)
    held: list[np.ndarray] = []
    owner: list[tuple[int, int, int]] = []  # (row, points, place of the first in the text)
    gathered = 0

    def flush():
        nonlocal held, owner, gathered
        if not gathered:
            return
        points = np.concatenate(held)
        sizes = np.array([o[1] for o in owner])
        place = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes - np.array([o[2] for o in owner]), sizes)
        # Words end with their text: a stretch of another row is another lattice.
        picked = sample_rows(lat, points, sizes, _uniform(np.repeat(keys[[o[0] for o in owner]], sizes), place))
        flat, at, width = _spell(lat, picked, points)
        ids.append(flat)
        part = np.repeat(np.arange(len(owner)), sizes)[at]
        np.add.at(counts, [o[0] for o in owner], np.bincount(part, weights=width, minlength=len(owner)).astype(np.int64))
        held, owner, gathered = [], [], 0

    for r, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if a == b:
            continue
        points = np.frombuffer((" " + data[a:b].tobytes().decode("utf-8", "surrogatepass")).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = 0
        while at < len(points):
            to = _next_cut(lat, points, at)
            if to - at > 2 * CHUNK:  # one word
                flush()
                own = points[at:to]
                picked = sample_long(lat, own, lambda lo, hi, at=at, r=r: _uniform(keys[r], np.arange(at + lo, at + hi)))
                flat, _, _ = _spell(lat, picked, own)
                ids.append(flat)
                counts[r] += len(flat)
            else:
                held.append(points[at:to])
                owner.append((r, to - at, at))
                gathered += to - at
            at = to
            if gathered >= CHUNK:
                flush()
    flush()
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    return flat, np.concatenate([[0], np.cumsum(counts)])


def decoded(lat: Lattice, ids: np.ndarray) -> bytes:
    """The UTF-8 text of piece ids: their bytes joined, without the space that encoding put first."""
    out = []
    for lo in range(0, len(ids), CHUNK):
        part = ids[lo : lo + CHUNK]
        out.append(lat.spelled[_places(lat.spelled_at[part], lat.spelled_at[part + 1])].tobytes())
    return b"".join(out)[1:]


def decode_ids(lat: Lattice, ids) -> str:
    return decoded(lat, np.asarray(ids, np.int64)).decode("utf-8", "surrogatepass")


def _lattice(spark, model_path: str, alpha: float):
    """The vocabulary is read once, by the driver; what is sent is bounded by its 32,000 pieces."""
    return spark.sparkContext.broadcast(Lattice(model_path, alpha))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL, alpha: float = 1.0, seed: int = 7) -> DataFrame:
    """(doc_id, piece_ids): one sampled segmentation for each row, drawn from all in proportion to their weight.

    Draws depend on the row's id, the place in the text and the seed alone: any partitioning gives the same
    pieces.  Null and empty texts have no pieces; rows that repeat an id and a text get the same pieces; null ids
    draw like id 0.  Other columns are ignored.
    """
    held = _lattice(docs.sparkSession, model_path, alpha)

    def work(batches):
        import pyarrow as pa

        for batch in by_bytes(batches, 1 << 20):
            keys = np.asarray(batch.column(0).fill_null(0), np.int64)
            flat, offsets = encode_batch(held.value, batch.column(1), keys, seed)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "piece_ids"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(work, "doc_id long, piece_ids array<int>")


def decode(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """(doc_id, text) of (doc_id, piece_ids); null for a null list."""
    held = _lattice(encoded.sparkSession, model_path, 1.0)

    def work(batches):
        import pyarrow as pa

        for batch in slices(batches, 256):
            texts = [None if ids is None else decode_ids(held.value, ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "piece_ids").mapInArrow(work, "doc_id long, text string")


def _copy_numbers(ids: list, texts, before: list) -> np.ndarray:
    """How many rows directly before each one have its id and text; ``before`` holds the last row and its number."""
    out = np.zeros(len(ids), np.int64)
    for r, i in enumerate(ids):
        if before and before[0] == i and before[1].equals(texts[r]):
            before[2] += 1
        else:
            before[:] = [i, texts[r], 0]
        out[r] = before[2]
    return out


def with_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL, alpha: float = 1.0, seed: int = 7, copies: bool = False) -> DataFrame:
    """The documents with all their columns and n_pieces, piece_ids, decoded_chars, decoded_sha256, lossless.

    Each text is encoded, its pieces decoded, and the result held against the text.  Null texts count as empty:
    no pieces, and the empty text back.  Columns that already have one of the new names are replaced.

    With ``copies``, repetitions of a document that lie one after the other, as a mix of sources writes them, get
    samples of their own: the draws are seeded by id and repetition.  Without, equal rows get equal pieces.
    """
    from pyspark.sql import types as T

    held = _lattice(docs.sparkSession, model_path, alpha)
    new = [
        T.StructField("n_pieces", T.LongType()), T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded_chars", T.LongType()),
        T.StructField("decoded_sha256", T.StringType()), T.StructField("lossless", T.BooleanType()),
    ]
    rows = docs.drop(*[f.name for f in new])
    schema = T.StructType([*rows.schema, *new])
    id_at, text_at = rows.columns.index(id_col), rows.columns.index(text_col)

    def work(batches):
        import pyarrow as pa

        before: list = []
        for batch in by_bytes(batches, 1 << 20, text_at):
            ids, texts = batch.column(id_at).cast(pa.int64()), batch.column(text_at)
            numbers = _copy_numbers(ids.to_pylist(), texts, before) if copies else None
            flat, offsets = encode_batch(held.value, texts, np.asarray(ids.fill_null(0), np.int64), seed, numbers)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            data, at = text_buffers(texts)
            sizes, digests, same = [], [], []
            for r in range(batch.num_rows):
                raw = decoded(held.value, flat[offsets[r] : offsets[r + 1]])
                sizes.append(int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
                digests.append(hashlib.sha256(raw).hexdigest())
                same.append(raw == data[at[r] : at[r + 1]].tobytes())
            columns = [*batch.columns, pa.array(np.diff(offsets)), lists, pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(work, schema)


def encode_and_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL, alpha: float = 1.0, seed: int = 7) -> DataFrame:
    """(doc_id, n_chars, n_pieces, piece_ids, decoded_sha256, lossless) of every document; see ``with_pieces``."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    done = with_pieces(picked, "doc_id", "text", model_path, alpha, seed)
    return done.select("doc_id", F.col("decoded_chars").alias("n_chars"), "n_pieces", "piece_ids", "decoded_sha256", "lossless")
